"""Append-only journals of vectors: the newest row of an id wins, a delete wins a tie."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class JournalSpec:
    """Columns of a journal; without `ver` the table is static and each id stands once."""

    id: str = "id"
    vec: str = "vec"
    op: str | None = None
    ver: str | None = None


def _deleted(df: DataFrame, spec: JournalSpec) -> Column:
    if spec.op is None:
        return F.lit(False)
    if dict(df.dtypes)[spec.op] == "boolean":
        return F.coalesce(F.col(spec.op), F.lit(False))
    return F.coalesce(F.col(spec.op).cast("long"), F.lit(1)) < 0


def _version(df: DataFrame, spec: JournalSpec) -> Column:
    kind = dict(df.dtypes)[spec.ver]
    if kind == "timestamp":
        return F.unix_micros(F.col(spec.ver))
    if kind == "timestamp_ntz":
        return F.unix_micros(F.to_timestamp_ltz(F.col(spec.ver)))
    return F.col(spec.ver).cast("long")


def normalise(df: DataFrame, spec: JournalSpec) -> DataFrame:
    """id long, vec array<float>, del boolean, ver long (timestamps in microseconds); rows without id are left out."""
    ver = F.lit(None).cast("long") if spec.ver is None else _version(df, spec)
    return df.where(F.col(spec.id).isNotNull()).select(
        F.col(spec.id).cast("long").alias("id"), F.col(spec.vec).cast("array<float>").alias("vec"), _deleted(df, spec).alias("del"), ver.alias("ver")
    )


def latest(rows: DataFrame) -> DataFrame:
    """The newest row of each id; of equal versions the delete.

    max_by keeps one row an id on the map side, so an id with many versions never meets in one task.
    """
    newest = F.max_by(F.struct("vec", "del", "ver"), F.struct(F.coalesce("ver", F.lit(-(1 << 63))), F.col("del").cast("int")))
    return rows.groupBy("id").agg(newest.alias("r")).select("id", "r.vec", "r.del", "r.ver")


def live_rows(rows: DataFrame, boundary: int | None = None) -> DataFrame:
    """id, vec of the rows that live at the boundary (all versions without one)."""
    upto = rows if boundary is None else rows.where(F.col("ver") <= F.lit(boundary))
    return latest(upto).where(~F.col("del")).select("id", "vec")


def changes(rows: DataFrame, after: int, upto: int) -> DataFrame:
    """The newest row of each id with after < ver <= upto, deletes included."""
    return latest(rows.where((F.col("ver") > F.lit(after)) & (F.col("ver") <= F.lit(upto))))


def delta(rows: DataFrame, boundary: int) -> DataFrame:
    """All journal rows after the boundary; the literal reaches the scan."""
    return rows.where(F.col("ver") > F.lit(boundary))


def boundary_of(rows: DataFrame, margin: int, previous: int | None = None, previous_max: int | None = None, now: int | None = None) -> tuple[int, int]:
    """(boundary, highest version): the highest version, or `now` if that is less, minus the margin; never before the previous boundary.

    now: the clock, in the unit of the versions, where they are timestamps.  A version from the future then stays in the
    delta until its time has come, and doesn't drag the boundary past rows that are still to be written.
    """
    new = rows if previous is None else rows.where(F.col("ver") > F.lit(previous))
    top = max(new.agg(F.max("ver")).first()[0] or 0, previous_max or 0)
    upto = (top if now is None else min(top, now)) - margin
    return (upto if previous is None else max(upto, previous)), top


def digest(rows: DataFrame, *boundaries: int) -> list[tuple[int, int]]:
    """(rows, sum of their hashes) up to each boundary, all in one scan."""
    h = F.xxhash64("id", "vec", "del", "ver").cast("decimal(38,0)")
    aggs = []
    for b in boundaries:
        inside = F.col("ver") <= F.lit(b)
        aggs += [F.count(F.when(inside, 1)), F.coalesce(F.sum(F.when(inside, h)), F.lit(0).cast("decimal(38,0)"))]
    got = rows.where(F.col("ver") <= F.lit(max(boundaries))).agg(*aggs).first()
    return [(got[2 * i], int(got[2 * i + 1])) for i in range(len(boundaries))]
