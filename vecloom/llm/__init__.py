"""Training-data operators: tokenising, deduplicating, mixing, archiving and scoring text on Spark.

Nothing else in the library imports this subpackage.  Functions that run in Python workers are shipped by
value, so executors need the third-party libraries but not this repository.
"""

import importlib
import pkgutil

from pyspark import cloudpickle


def _ship_by_value() -> None:
    for m in pkgutil.iter_modules(__path__):
        if m.name != "queries":
            cloudpickle.register_pickle_by_value(importlib.import_module(f"{__name__}.{m.name}"))


_ship_by_value()
