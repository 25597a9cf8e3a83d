"""Parameters of a search: one table of them, presets, checks; and the cost rule for filtered searches."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any, NamedTuple

from pyspark.sql import SparkSession

MAX_K = 16384
#: Session parameters are Spark settings with this prefix.
PREFIX = "vecloom."

_WORDS = {"true": True, "t": True, "1": True, "yes": True, "false": False, "f": False, "0": False, "no": False}


def _finite(text: Any) -> float:
    x = float(text)
    if not math.isfinite(x):
        raise ValueError(text)
    return x


class Kind(NamedTuple):
    """How a value is read from the text of a setting, and what it must be."""

    read: Callable[[Any], Any]
    what: str


TEXT = Kind(str, "text")
WHOLE = Kind(lambda v: int(str(v)), "an integer")
NUMBER = Kind(_finite, "a number")
YES_NO = Kind(lambda v: _WORDS[str(v).lower()], "true or false")


class Parameter(NamedTuple):
    kind: Kind
    ok: Callable[[Any], bool]
    message: str  # what is said of a value that isn't ok; {0} is the value


#: Every parameter of a search.  None as a value: the preset of the precision.
PARAMETERS = {
    "k": Parameter(WHOLE, lambda v: 1 <= v <= MAX_K, "k must be 1 to 16384, not {0}"),
    "precision": Parameter(TEXT, {"fast", "balanced", "best", "exact"}.__contains__, "precision must be fast, balanced, best or exact, not '{0}'"),
    "freshness": Parameter(TEXT, {"snapshot", "exact"}.__contains__, "freshness must be snapshot or exact, not '{0}'"),
    "ef_search": Parameter(WHOLE, lambda v: 0 <= v <= 100000, "ef_search must be 0 (preset) to 100000"),
    "oversampling": Parameter(NUMBER, lambda v: 1 <= v <= 100, "oversampling must be 1 to 100"),
    "threads": Parameter(WHOLE, lambda v: 0 <= v <= 64, "threads must be 0 (one per core) to 64"),
    "exact": Parameter(YES_NO, lambda v: True, ""),
    "rescore": Parameter(YES_NO, lambda v: True, ""),
}


def parameters(spark: SparkSession | None, call: Mapping | None = None, index: Mapping | None = None) -> dict[str, Any]:
    """The parameters that are given somewhere: those of the call before those of the session, these before the index' defaults.

    A value that can't be read names where it comes from.
    """
    out = {}
    for name, p in PARAMETERS.items():
        if (call or {}).get(name) is not None:
            out[name] = call[name]
            continue
        settings = ("session parameter", None if spark is None else spark.conf.get(PREFIX + name, None)), ("index default", (index or {}).get(name))
        for source, value in settings:
            if value is not None:
                try:
                    out[name] = p.kind.read(value)
                except (ValueError, KeyError):
                    raise ValueError(f"{source} {name} = '{value}' is not {p.kind.what}") from None
                break
    return out


@dataclass(frozen=True)
class SearchSettings:
    k: int
    precision: str
    freshness: str
    ef: int
    exact: bool
    rescore: bool
    oversampling: float
    radius: float | None

    def use_graph(self, index_type: str) -> bool:
        return index_type == "hnsw" and not self.exact

    def use_codes(self, quantization: str) -> bool:
        return quantization == "sq8" and not self.exact


def resolve(given: Mapping[str, Any], dims: int, radius: float | None = None) -> SearchSettings:
    """Checked settings with the presets of the precision levels."""
    for name, value in given.items():
        p = PARAMETERS[name]
        if not p.ok(value):
            raise ValueError(p.message.format(value))
    if radius is not None and not math.isfinite(radius):
        raise ValueError("radius must be a finite number")
    k, precision = int(given.get("k", 10)), given.get("precision", "balanced")
    narrow = 32 if radius is not None else max(2 * k, 32)
    ef, factor = {"best": (400, 4.0), "balanced": (100, 4.0 if dims >= 512 else 2.0)}.get(precision, (narrow, 1.0))
    return SearchSettings(
        k, precision, given.get("freshness", "exact"), int(given.get("ef_search", 0)) or ef, bool(given.get("exact", False)) or precision == "exact",
        bool(given.get("rescore", precision != "fast")), float(given.get("oversampling", factor)), radius,
    )


def filter_exact_limit(ef: int, count: int) -> int:
    """Allowed rows below which a filtered graph search compares them all instead."""
    return max(10_000, math.isqrt(64 * ef * count))


def filter_is_exact(graph: bool, allowed: int, count: int, ef: int, queries: int, codes: bool) -> bool:
    """Whether a filtered search compares the allowed rows exactly (else all rows are searched with the others masked)."""
    if graph:
        return allowed < filter_exact_limit(ef, count)
    return allowed * (queries + 8) * (4 if codes else 1) < count * queries
