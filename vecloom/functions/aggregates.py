"""Element-wise sums and averages of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import doubles


def _totals(df: DataFrame, vec: str, by: list[str]) -> DataFrame:
    """One row a group: n (vectors that are not NULL) and parts, their sums by position.

    Elements are summed per (group, position) with map-side combining, so a group of any size costs one small row a
    task and position; vectors of different lengths in a group are an error.
    """
    v = doubles(vec)
    keys = [F.col(c) for c in by]
    size = F.when(v.isNotNull(), F.size(v))
    facts = df.groupBy(*keys).agg(F.count(v).alias("__n"), F.min(size).alias("__lo"), F.max(size).alias("__hi"))
    cells = df.where(v.isNotNull()).select(*keys, F.posexplode(v).alias("__pos", "__x")).groupBy(*keys, "__pos").agg(F.sum("__x").alias("__s"))
    parts = cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__pos", "__s"))).alias("__parts"))
    if by:
        same = None
        for c in by:
            e = facts[c].eqNullSafe(parts[c])
            same = e if same is None else same & e
        joined = facts.join(parts, same, "left").select(*[facts[c] for c in by], "__n", "__lo", "__hi", "__parts")
    else:
        joined = facts.crossJoin(parts)  # one row each
    bad = F.raise_error(F.concat(F.lit("vector_sum: the vectors have different lengths: "), F.col("__lo").cast("string"), F.lit(" and "), F.col("__hi").cast("string"), F.lit(" elements")))
    sums = F.transform(F.coalesce("__parts", F.array().cast("array<struct<__pos:int,__s:double>>")), lambda p: p["__s"])
    return joined.withColumn("__sum", F.when(F.col("__n") > 0, F.when(F.col("__lo") != F.col("__hi"), bad.cast("array<double>")).otherwise(sums)))


def vector_sum(df: DataFrame, vec: str = "vec", by: list[str] | None = None, name: str = "vector_sum") -> DataFrame:
    """Element-wise sum per group; NULL vectors are skipped, a group of NULLs only gives NULL."""
    by = by or []
    return _totals(df, vec, by).select(*by, F.col("__sum").alias(name))


def vector_avg(df: DataFrame, vec: str = "vec", by: list[str] | None = None, name: str = "vector_avg") -> DataFrame:
    """Element-wise sum divided by the number of vectors that are not NULL."""
    by = by or []
    return _totals(df, vec, by).select(*by, F.transform("__sum", lambda x: x / F.col("__n")).alias(name))
