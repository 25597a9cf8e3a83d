"""Usual compositions of a search with joins and aggregates."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aggregates import vector_avg
from ..functions.vectors import METRICS, check_metric, vector_l2sq, vector_sub
from . import workers
from .exact import scan

cloudpickle.register_pickle_by_value(workers)

#: Elements of a block of theta_join; two blocks are in a task at once.
JOIN_ELEMENTS = 1_000_000


def with_payload(found: DataFrame, payload: DataFrame) -> DataFrame:
    """found(qid, id, score, rank) with the columns of payload(id, ...)."""
    return found.join(payload, "id")


def post_filter(found: DataFrame, payload: DataFrame, condition, k: int, metric: str) -> DataFrame:
    """The k best of an over-fetched result that meet a condition on their payload, ranked anew."""
    from .exact import merge

    kept = found.join(payload.where(condition).select("id"), "id", "left_semi")
    return merge(kept.select("qid", "id", "score"), metric, k)


def centroid_difference(rows: DataFrame, plus, minus, k: int = 10, metric: str = "cosine") -> DataFrame:
    """Search with (average of the rows that meet plus) - (average of those that meet minus)."""
    a, b = vector_avg(rows.where(plus), "vec", name="a"), vector_avg(rows.where(minus), "vec", name="b")
    q = a.crossJoin(b).select(F.lit(0).cast("long").alias("qid"), vector_sub("a", "b").alias("qvec"))  # one row each
    return scan(rows, q, k, metric)


def spread_to_centroid(rows: DataFrame, group: str) -> DataFrame:
    """group, members, spread: the sum of squared distances of a group's vectors to their average."""
    centre = vector_avg(rows, "vec", [group], "centre").withColumnRenamed(group, "__g")
    j = rows.join(centre, F.col(group).eqNullSafe(F.col("__g")))
    return j.groupBy(group).agg(F.count("vec").alias("members"), F.sum(vector_l2sq("vec", "centre")).alias("spread"))


def near_duplicates(rows: DataFrame, queries: DataFrame, threshold: float, k: int = 2, metric: str = "cosine") -> DataFrame:
    """Pairs (qid, id) of rows close to a query row, from the k nearest of each query; each pair once."""
    found = scan(rows, queries, k, metric)
    near = F.col("score") >= threshold if not METRICS[metric][1] else F.col("score") <= threshold
    return found.where(near & (F.col("qid") < F.col("id"))).select("qid", "id", "score")


def all_near_duplicates(rows: DataFrame, threshold: float, k: int = 2, metric: str = "cosine") -> DataFrame:
    """near_duplicates with every row as a query, so that qid < id only drops the second finding of a pair."""
    ok = rows.where(F.col("id").isNotNull() & F.col("vec").isNotNull())
    return near_duplicates(rows, ok.select(F.col("id").alias("qid"), F.col("vec").alias("qvec")), threshold, k, metric)


def theta_join(rows: DataFrame, threshold: float, metric: str = "cosine") -> DataFrame:
    """Every pair (a, b), a < b, of rows(id, vec) within a threshold: the join of a table with itself on a distance.

    Rows are dealt by hash into blocks of at most JOIN_ELEMENTS elements, and every two blocks meet once, in one task.
    There matrix products leave few pairs, which are scored exactly; they are put out piece by piece, however many.
    """
    check_metric(metric)
    ok = rows.where(F.col("id").isNotNull() & F.col("vec").isNotNull()).select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    n, least, most = ok.agg(F.count("*"), F.min(F.size("vec")), F.max(F.size("vec"))).first()
    if n and least != most:
        raise ValueError(f"theta_join: the vectors have different lengths: {least} and {most} elements")
    of = max(4, -(-n * (most or 0) // JOIN_ELEMENTS))
    own, other = F.col("own"), F.col("other")
    dealt = ok.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(of))).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(of - 1))))
    dealt = dealt.select("id", "vec", "own", (F.least(own, other) * of + F.greatest(own, other)).alias("pair"))

    def run(batches):
        import pyarrow as pa

        for t in workers.grouped(batches, ["pair"]):
            i, j = divmod(t.column("pair")[0].as_py(), of)
            ids, x, where = t.column("id").to_numpy(), workers.matrix(t.column("vec")), t.column("own").to_numpy()
            for a, b, s in workers.close_pairs(ids[where == i], x[where == i], ids[where == j], x[where == j], metric, threshold, i == j):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s)], names=["a", "b", "score"])

    return dealt.repartition(of * (of + 1) // 2, "pair").sortWithinPartitions("pair").mapInArrow(run, "a long, b long, score double")


def ties(found: DataFrame, digits: int = 6) -> DataFrame:
    """found(qid, id, score, rank) with tied: the row before or after it in its query has the same rounded score."""
    w, s = Window.partitionBy("qid").orderBy("rank"), F.round("score", digits)
    return found.withColumn("tied", F.coalesce(s == F.lag(s).over(w), F.lit(False)) | F.coalesce(s == F.lead(s).over(w), F.lit(False)))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one of two results has and the other lacks, with side a or b; repeated rows count (none: equal results)."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))
