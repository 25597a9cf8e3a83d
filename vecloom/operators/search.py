"""Search of an index: snapshot and journal, exact or approximate, with allow-list and radius."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.catalog import Catalog, Manifest
from ..plans.settings import SearchSettings, filter_is_exact, parameters, resolve
from ..plans.workspace import workspace
from ..sources.journal import latest
from ..sources.text import parse_queries
from .approximate import search_codes, search_graph
from .exact import merge, scan


def overlay(snapshot: DataFrame, changes: DataFrame) -> DataFrame:
    """snapshot(id, vec) with the newest change of each id applied: masked ids go, live vectors come."""
    new = latest(changes)
    return snapshot.select("id", "vec").join(new.select("id"), "id", "left_anti").unionByName(new.where(~F.col("del")).select("id", "vec"))


def as_queries(catalog: Catalog, queries: DataFrame | None, query: str | None, query_list: str | None = None) -> DataFrame:
    if queries is not None:
        return queries.select("qid", "qvec")
    return catalog.spark.createDataFrame(parse_queries(query, query_list), "qid long, qvec array<double>")


def search(
    catalog: Catalog, name: str, queries: DataFrame | None = None, query: str | None = None, allow: DataFrame | None = None, radius: float | None = None, **params
) -> DataFrame:
    """queries(qid, qvec) or query='[...]' -> qid, id, score, rank: the k nearest rows of the index.

    params: k, precision, freshness, ef_search, exact, rescore, oversampling, threads.  allow(id) restricts the
    results to its ids (an empty one gives no rows; unknown ids do nothing); radius cuts by score.  With freshness
    exact the journal rows after the boundary are overlaid, and they are always compared exactly.
    """
    m = catalog.get(name)
    s = resolve(parameters(catalog.spark, params, m.defaults), m.dims or 0, radius)
    q = as_queries(catalog, queries, query)
    changes = latest(catalog.delta(m)) if s.freshness == "exact" and m.ver_col is not None else None
    return _search(catalog, m, s, q, changes, allow)


def _search(catalog: Catalog, m: Manifest, s: SearchSettings, q: DataFrame, changes: DataFrame | None, allow: DataFrame | None) -> DataFrame:
    """Search of the snapshot by the index' own means, of the live changes(id, vec, del) by a scan; both are merged."""
    rows = catalog.snapshot(m)
    extra = masked = None
    if changes is not None:
        masked, extra = changes.select("id"), changes.where(~F.col("del")).select("id", "vec")
    if allow is not None:
        allow = allow.select(F.col("id").cast("long").alias("id")).where("id is not null").distinct()
        extra = None if extra is None else extra.join(allow, "id", "left_semi")
    graph, codes = s.use_graph(m.index_type), s.use_codes(m.quantization)
    exact = not graph and not codes
    if allow is not None and not exact:
        exact = filter_is_exact(graph, allow.count(), m.vector_count, s.ef, q.count(), codes)
    sq8 = (m.sq8_offset, m.sq8_scale) if codes else None
    if graph and not exact:
        hidden = rows if masked is None else rows.join(masked.withColumn("__m", F.lit(True)), "id", "left").withColumn("dead", F.col("dead") | F.col("__m").isNotNull())
        positions = lambda r: r.groupBy("seg", "shard").agg(F.collect_list("pos").alias("pos"))  # noqa: E731  at most a shard's rows
        only = None if allow is None else positions(hidden.where(~F.col("dead")).join(allow, "id", "left_semi"))
        marked = positions(hidden.where("dead")) if allow is None and (masked is not None or len(m.chain) > 1) else None
        found = search_graph(catalog.graph(m), q, s.k, m.metric, s.ef, s.radius, marked, only, sq8, s.rescore, s.oversampling, s.precision != "fast")
    else:
        live = rows.where(~F.col("dead"))
        live = live if masked is None else live.join(masked, "id", "left_anti")
        live = live if allow is None else live.join(allow, "id", "left_semi")
        if exact:
            both = live.select("id", "vec")
            return scan(both if extra is None else both.unionByName(extra), q, s.k, m.metric, s.radius)
        found = search_codes(live, q, s.k, m.metric, *sq8, s.rescore, s.oversampling, s.radius)
    found = found.select("qid", "id", "score")
    if extra is not None:
        found = found.unionByName(scan(extra, q, s.k, m.metric, s.radius).select("qid", "id", "score"))
    return merge(found, m.metric, s.k)


def knn_join(catalog: Catalog, name: str, left: DataFrame, vec: str, k: int = 10, query: str | None = None, **params) -> DataFrame:
    """Each row of left with its k nearest rows of the snapshot: the columns of left and id, score, rank.

    A row with a NULL vector takes `query` if given, else it has no neighbours.  The journal is not read.
    """
    from .exact import check_k

    check_k(k)
    # numbered once and written: a second evaluation could number the rows of left otherwise
    path = workspace(catalog.spark, "knn-left")
    left.withColumn("__qid", F.monotonically_increasing_id()).write.parquet(path)
    keyed = catalog.spark.read.parquet(path)
    vector = F.col(vec).cast("array<double>")
    if query is not None:
        vector = F.coalesce(vector, F.array(*[F.lit(x) for x in parse_queries(query)[0][1]]))
    keyed = keyed.withColumn("__qvec", vector)
    q = keyed.where(F.col("__qvec").isNotNull()).select(F.col("__qid").alias("qid"), F.col("__qvec").alias("qvec"))
    found = search(catalog, name, q, k=k, freshness="snapshot", **params)
    found = found.select(F.col("qid").alias("__qid"), F.col("id").alias("__id"), "score", "rank")
    clash = [c for c in ("id", "score", "rank") if c in left.columns]
    names = [F.col(c) if c not in clash else F.col(c).alias(f"left_{c}") for c in left.columns]
    return keyed.select("__qid", *names).join(found, "__qid").drop("__qid").withColumnRenamed("__id", "id")


def vsearch(catalog: Catalog, name: str, rows: DataFrame, filtered: bool = False, **params) -> DataFrame:
    """The seven-column form: rows(qid, qvec, id, vec, del, ver, snapshot_id), whose NULLs tell a row's role.

    qid with qvec: a query; id with vec or del: a journal row; id alone: allowed; snapshot_id alone: the snapshot the
    rows belong to.  Journal rows in the input replace the index's own delta.
    """
    bad = rows.agg(
        F.count(F.when(F.col("qvec").isNotNull() & F.col("qid").isNull(), 1)).alias("q"), F.count(F.when(F.col("qid").isNotNull() & F.col("qvec").isNull(), 1)).alias("v"),
        F.count(F.when(F.col("id").isNull() & F.col("qid").isNull() & (F.col("vec").isNotNull() | F.col("del").isNotNull() | F.col("ver").isNotNull()), 1)).alias("i"),
        F.count("qid").alias("n"), F.max("snapshot_id").alias("sid"), F.count(F.when(_is_allow(), 1)).alias("allow"),
    ).first()
    if bad.q:
        raise ValueError("a query row needs a qid")
    if bad.v:
        raise ValueError("a query row needs a vector")
    if bad.i:
        raise ValueError("a journal row needs an id")
    query = params.pop("query", None)
    if not bad.n and query is None:
        raise ValueError("no query: give rows with qid and qvec or the parameter query")
    m = catalog.get(name)
    if bad.sid is not None and bad.sid > (m.active_snapshot or 0):
        raise ValueError(f"snapshot cache stale: snapshot {bad.sid} is newer than {m.active_snapshot}")
    s = resolve(parameters(catalog.spark, params, m.defaults), m.dims or 0, params.pop("radius", None))
    q = rows.where(F.col("qid").isNotNull()).select("qid", "qvec")
    if query is not None:
        q = q.unionByName(as_queries(catalog, None, query))
    journal = rows.where(F.col("qid").isNull() & F.col("id").isNotNull() & ~_is_allow()).select("id", F.col("vec").cast("array<float>").alias("vec"), F.coalesce("del", F.lit(False)).alias("del"), F.col("ver").cast("long").alias("ver"))
    allow = rows.where(_is_allow()).select("id") if filtered or bad.allow else None
    return _search(catalog, m, s, q, latest(journal), allow)


def _is_allow():
    return F.col("qid").isNull() & F.col("id").isNotNull() & F.col("vec").isNull() & F.col("del").isNull() & F.col("ver").isNull()


def recall(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """Share of the exact neighbours (qid, id) that the other result has."""
    a = approximate.select("qid", "id", F.lit(1).alias("hit"))
    return exact.select("qid", "id").join(a, ["qid", "id"], "left").agg((F.count("hit") / F.count("*")).alias("recall"))


def best_per_group(found: DataFrame, groups: DataFrame, group: str) -> DataFrame:
    """found(qid, id, score, rank) joined with groups(id, group): the best match of each group."""
    w = Window.partitionBy("qid", group).orderBy("rank")
    return found.join(groups.select("id", group), "id").withColumn("__r", F.row_number().over(w)).where("__r = 1").select("qid", group, "id", "score", "rank")
