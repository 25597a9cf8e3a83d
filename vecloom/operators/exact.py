"""Exact k-nearest-neighbour search over any relation.

Two forms with the same result: `scan`, where each partition keeps its k best per query in NumPy and only those meet
in the final window; and `scan_sql`, the same as one Catalyst expression (a score column and a row_number window,
which Spark turns into a local and a final group limit).
"""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import METRICS, check_metric
from . import workers

cloudpickle.register_pickle_by_value(workers)

FOUND = "qid long, id long, score double"
#: Queries go to all executors in blocks of at most so many vector elements (8 bytes each).
BLOCK_ELEMENTS = 4_000_000
#: scan_sql: elements that become columns at most (a method of more code is not compiled); one row in so many gives the bound.
MOST_COLUMNS, BOUND_SHARE = 100, 64


def check_k(k: int) -> None:
    if not 1 <= k <= 16384:
        raise ValueError(f"k must be 1 to 16384, not {k}")


def merge(found: DataFrame, metric: str, k: int) -> DataFrame:
    """The k best of (qid, id, score) per query with rank from 1; ties: the smaller id first."""
    near = F.col("score") if METRICS[metric][1] else -F.col("score")
    w = Window.partitionBy("qid").orderBy(near, "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qid", "id", "score", "rank")


def checked(queries: DataFrame) -> tuple[DataFrame, int, int]:
    """(qid long, qvec array<double>), their number and length; NULLs and different lengths are errors."""
    q = queries.select(F.col("qid").cast("long").alias("qid"), F.col("qvec").cast("array<double>").alias("qvec"))
    n, least, most, no_id, no_vec = q.agg(F.count("*"), F.min(F.size("qvec")), F.max(F.size("qvec")), F.count(F.when(F.col("qid").isNull(), 1)), F.count(F.when(F.col("qvec").isNull(), 1))).first()
    if no_id:
        raise ValueError("a query row needs a qid")
    if no_vec:
        raise ValueError("a query row needs a vector")
    if n and least != most:
        raise ValueError(f"the queries have different lengths: {least} and {most} elements")
    if n and not most:
        raise ValueError("the query has no elements")
    return q, n, most or 0


def query_blocks(queries: DataFrame):
    """(qids, vectors as a matrix, whether it is the last) of blocks small enough to send to every executor.

    A query set beyond the block size is dealt into hash classes that are fetched one by one, when the caller asks.
    """
    import numpy as np

    q, n, dims = checked(queries)
    blocks = max(1, -(-n * dims // BLOCK_ELEMENTS))
    for b in range(blocks if n else 0):
        rows = (q if blocks == 1 else q.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b)).collect()  # bounded by BLOCK_ELEMENTS
        if rows:
            yield [r.qid for r in rows], np.array([r.qvec for r in rows], np.float64), b + 1 == blocks


def scan(rows: DataFrame, queries: DataFrame, k: int = 10, metric: str = "l2", radius: float | None = None) -> DataFrame:
    """rows(id, vec), queries(qid, qvec) -> qid, id, score, rank.

    Queries of up to BLOCK_ELEMENTS elements are sent to the rows; more are dealt into blocks that meet blocks of rows
    on the executors (scan_blocks), so the driver never holds them.  Rows with a NULL id or vector are skipped; a vector
    of another length is an error.  No query or no row: no result.
    """
    check_metric(metric)
    check_k(k)
    spark = rows.sparkSession
    clean = rows.where(F.col("id").isNotNull() & F.col("vec").isNotNull()).select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    q, n, dims = checked(queries)
    if not n:
        return merge(spark.createDataFrame([], FOUND), metric, k)
    if n * dims > BLOCK_ELEMENTS:
        return merge(scan_blocks(clean, q, n, dims, k, metric, radius), metric, k)
    asked = q.collect()  # bounded by BLOCK_ELEMENTS
    sent = spark.sparkContext.broadcast(([r.qid for r in asked], [r.qvec for r in asked]))

    def run(batches):
        import numpy as np

        qids, vecs = sent.value
        top = workers.TopK(qids, np.array(vecs, np.float64), metric, k, radius)
        for b in batches:
            if b.num_rows:
                top.add_batch(b.column(0), b.column(1))
        yield top.batch()

    return merge(clean.mapInArrow(run, FOUND), metric, k)


def scan_blocks(clean: DataFrame, queries: DataFrame, n: int, dims: int, k: int, metric: str, radius: float | None) -> DataFrame:
    """The k best of each block of rows for each query: (qid, id, score).

    Rows and queries are dealt by hash into blocks of at most BLOCK_ELEMENTS elements; every pair of blocks meets in one
    task, which returns k rows a query at most.  Rows travel once for each block of queries and the other way round.
    """
    of_queries = -(-n * dims // BLOCK_ELEMENTS)
    of_rows = max(1, -(-clean.count() * dims // BLOCK_ELEMENTS))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    a = clean.select("id", "vec", F.pmod(F.xxhash64("id"), F.lit(of_rows)).cast("int").alias("r"), every(of_queries).alias("q"))
    b = queries.select("qid", "qvec", F.pmod(F.xxhash64("qid"), F.lit(of_queries)).cast("int").alias("q"), every(of_rows).alias("r"))

    def meet(left, right):
        import numpy as np
        import pyarrow as pa

        if not right.num_rows:
            return pa.table({"qid": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        top = workers.TopK(right.column("qid").to_pylist(), workers.matrix(right.column("qvec")), metric, k, radius)
        if left.num_rows:
            left = left.combine_chunks()
            top.add_batch(left.column("id").chunk(0), left.column("vec").chunk(0))
        return pa.Table.from_batches([top.batch()])

    return a.groupBy("r", "q").cogroup(b.groupBy("r", "q")).applyInArrow(meet, FOUND)


def scan_sql(rows: DataFrame, queries: DataFrame, k: int = 10, metric: str = "l2", radius: float | None = None) -> DataFrame:
    """As scan, in Catalyst alone, for query sets of at most BLOCK_ELEMENTS elements, which are broadcast.

    Elements are columns, so that generated code adds up a pair's score (beyond MOST_COLUMNS elements arrays, by lambda
    functions).  The k-th score of each query over a BOUND_SHARE of the rows is a bound that joins on: of all pairs
    only those that reach it are sorted, and the k best are among them.
    """
    check_metric(metric)
    check_k(k)
    smaller = METRICS[metric][1]
    q, n, dims = checked(queries)
    if n * dims > BLOCK_ELEMENTS:
        raise ValueError(f"scan_sql is for at most {BLOCK_ELEMENTS} elements of queries, these have {n * dims}: use scan")
    spark = rows.sparkSession
    if not n:
        return merge(spark.createDataFrame([], FOUND), metric, k)
    clean = rows.where(F.col("id").isNotNull() & F.col("vec").isNotNull()).select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    # an exchange, so that the code that takes a row apart and the code of a pair are methods of their own
    left = spread(clean, "id", "vec", "v", dims).repartition(4 * spark.sparkContext.defaultParallelism)
    right = spread(q, "qid", "qvec", "q", dims)
    score = score_of(dims, metric)

    def scored(some: DataFrame, asked: DataFrame, *more) -> DataFrame:
        pairs = some.crossJoin(F.broadcast(asked)).where(~F.isnan(score))
        if radius is not None:
            pairs = pairs.where(score <= radius if smaller else score >= radius)
        for condition in more:
            pairs = pairs.where(condition)
        return pairs.select("qid", "id", score.alias("score"))

    share = scored(left.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(BOUND_SHARE)) == 0), right)
    bound = merge(share, metric, k).where(F.col("rank") == k).select(F.col("qid").alias("__b"), F.col("score").alias("bound"))
    right = right.join(bound, F.col("qid") == F.col("__b"), "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf") if smaller else float("-inf"))))
    return merge(scored(left, right, score <= F.col("bound") if smaller else score >= F.col("bound")), metric, k)


def spread(rows: DataFrame, key: str, vec: str, name: str, dims: int) -> DataFrame:
    """The key, the columns <name>0 .. of the elements (or the array <name>) and the norm <name>n; no row with a NULL element, another length is an error."""
    right_size = F.when(F.size(vec) != dims, F.raise_error(F.concat(F.lit("scan_sql: the vectors have different lengths: "), F.size(vec).cast("string"), F.lit(f" and {dims} elements"))).cast("boolean")).otherwise(True)
    known = rows.where(F.forall(vec, lambda x: x.isNotNull()) & right_size)
    norm = F.coalesce(F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x * x)), F.lit(0.0)).alias(f"{name}n")
    if dims > MOST_COLUMNS:
        return known.select(key, F.col(vec).alias(name), norm)
    return known.select(key, *[F.coalesce(F.get(vec, F.lit(i)), F.lit(0.0)).alias(f"{name}{i}") for i in range(dims)], norm)


def score_of(dims: int, metric: str):
    """Score of a pair of what spread returns with v and q, added up in the order of the elements."""
    of = {"l2": lambda x, y: (x - y) * (x - y), "l1": lambda x, y: F.abs(x - y)}.get(metric, lambda x, y: x * y)
    if dims > MOST_COLUMNS:
        total = F.aggregate(F.zip_with("q", "v", of), F.lit(0.0), lambda s, x: s + x)
    else:
        total = of(F.col("q0"), F.col("v0"))
        for i in range(1, dims):
            total = total + of(F.col(f"q{i}"), F.col(f"v{i}"))
    if metric == "l2":
        return F.sqrt(total)
    norms = F.col("qn") * F.col("vn")
    return total if metric != "cosine" else F.when(norms > 0, total / F.nullif(norms, F.lit(0.0))).otherwise(F.lit(0.0))


def scan_single(rows: DataFrame, vector: list[float], k: int = 10, metric: str = "l2") -> DataFrame:
    """One query as ORDER BY score LIMIT k: (id, score) without a window."""
    score, smaller = METRICS[metric]
    q = F.array(*[F.lit(float(x)) for x in vector])
    s = rows.where(F.col("id").isNotNull() & F.col("vec").isNotNull()).select("id", score(F.col("vec"), q).alias("score"))
    return s.orderBy(F.col("score") if smaller else F.col("score").desc(), "id").limit(k)
