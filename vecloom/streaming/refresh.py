"""Journals that arrive as streams, and indexes that are refreshed by them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.catalog import Catalog
from ..plans.refresh import refresh


def append_and_refresh(stream: DataFrame, catalog: Catalog, name: str, checkpoint: str, every: str | None = None, mode: str | None = None) -> StreamingQuery:
    """Append each micro-batch to the journal folder of the index and refresh the index.

    The journal must be a folder of Parquet files.  A batch is written under its own number, so a batch that is run
    again after a failure replaces itself and the journal has each row once.  Without `every` all that is there is
    taken and the query ends.
    """
    m = catalog.get(name, "stream")

    def take(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{m.source}/batch={number}")
        if catalog.source(catalog.get(name)).limit(1).count():
            refresh(catalog, name, mode)

    w = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    w = w.trigger(processingTime=every) if every else w.trigger(availableNow=True)
    return w.start()


def schedule(stream_clock: DataFrame, catalog: Catalog, name: str, checkpoint: str, every: str = "1 minute") -> StreamingQuery:
    """Refresh an index at every trigger of a clock (for instance the rate source), whatever writes its journal."""

    def tick(_: DataFrame, __: int) -> None:
        refresh(catalog, name)

    return stream_clock.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
