"""One query per operator over the embeddings table, with the same in DuckDB SQL.

Searches take every row whose id is divisible by 50 as a query, against all rows.  The journal is derived from the
table: every vector is an insert, every seventh is replaced by its successor's vector, every eleventh is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import aggregates as agg
from .functions import vectors as v
from .operators import exact, recipes, search
from .operators.approximate import search_codes, search_graph, sq8_bytes, train_sq8
from .plans import admin
from .plans.catalog import Catalog, register, set_options
from .plans.refresh import classify, refresh, verify
from .plans.sizing import sizing
from .plans.workspace import workspace
from .sources.journal import JournalSpec, changes, delta, digest, live_rows, normalise
from .sources.text import parse_queries
from .streaming.refresh import append_and_refresh

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
K = 10
#: Versions of replacements and deletes in the derived journal begin here; all inserts lie before.
REPLACED, DELETED = 1_000_000_000, 2_000_000_000
BOUNDARY = REPLACED - 1

#: DuckDB: score of r.e and q.e, and the order in which smaller is closer.
SCORE_SQL = {
    "l2": ("list_distance(r.e, q.e)", "score"),
    "l1": ("list_sum(list_transform(list_zip(r.e, q.e), lambda z: abs(z[1] - z[2])))", "score"),
    "cosine": ("coalesce(nullif(list_cosine_similarity(r.e, q.e), 'nan'::DOUBLE), 0)", "-score"),
    "dot": ("list_inner_product(r.e, q.e)", "-score"),
}
ROWS_SQL = "SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings"
JOURNAL_SQL = f"""
SELECT vec_id AS id, embedding::DOUBLE[] AS e, false AS del, vec_id AS ver FROM embeddings
UNION ALL SELECT a.vec_id, b.embedding::DOUBLE[], false, {REPLACED} + a.vec_id FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 7 = 0
UNION ALL SELECT vec_id, NULL, true, {DELETED} + vec_id FROM embeddings WHERE vec_id % 11 = 0"""
LIVE_SQL = f"""
SELECT id, e FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ver DESC, del DESC) AS rn FROM ({JOURNAL_SQL})) WHERE rn = 1 AND NOT del"""


def knn_sql(rows: str = ROWS_SQL, metric: str = "l2", k: int = K, where: str = "true") -> str:
    score, order = SCORE_SQL[metric]
    return f"""
WITH r AS ({rows}), q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT qid, id, {score} AS score FROM r, q),
t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {order}, id)::INTEGER AS rank FROM s WHERE {where})
SELECT qid, id, round(score, 6) AS score, rank FROM t WHERE rank <= {k}"""


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return put


def emb(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def asked(spark: SparkSession, d: str) -> DataFrame:
    return emb(spark, d).where("id % 50 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))


def journal(spark: SparkSession, d: str) -> DataFrame:
    e = emb(spark, d).select("id", "vec")
    ins = e.select("id", "vec", F.lit(False).alias("del"), F.col("id").alias("ver"))
    b = e.select((F.col("id") - 1).alias("id"), F.col("vec"))
    rep = b.where("id % 7 = 0 and id >= 0").join(e.select("id"), "id", "left_semi").select("id", "vec", F.lit(False).alias("del"), (F.col("id") + REPLACED).alias("ver"))
    gone = e.where("id % 11 = 0").select("id", F.lit(None).cast("array<float>").alias("vec"), F.lit(True).alias("del"), (F.col("id") + DELETED).alias("ver"))
    return ins.unionByName(rep).unionByName(gone)


def shown(found: DataFrame) -> DataFrame:
    return found.select("qid", "id", F.round("score", 6).alias("score"), "rank")


# scalar functions: each vector with its successor

PAIR_SQL = "SELECT a.vec_id AS id, a.embedding::DOUBLE[] AS a, b.embedding::DOUBLE[] AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"


def pairs(spark: SparkSession, d: str) -> DataFrame:
    e = emb(spark, d)
    return e.select("id", F.col("vec").alias("a")).join(e.select((F.col("id") - 1).alias("id"), F.col("vec").alias("b")), "id")


def cells(df: DataFrame, value) -> DataFrame:
    return df.select("id", F.posexplode(value).alias("pos", "x")).select("id", F.col("pos").cast("long").alias("pos"), F.round("x", 9).alias("value"))


def _elementwise(name: str, build, sql: str) -> None:
    query(name, f"SELECT id, (i - 1)::BIGINT AS pos, round({sql}, 9) AS value FROM (SELECT id, a, b, unnest(range(1, len(a) + 1)) AS i, sqrt(list_sum(list_transform(a, lambda x: x * x))) AS n FROM ({PAIR_SQL}))")(
        lambda s, d: cells(pairs(s, d), build())
    )


_elementwise("vf_add", lambda: v.vector_add("a", "b"), "a[i] + b[i]")
_elementwise("vf_sub", lambda: v.vector_sub("a", "b"), "a[i] - b[i]")
_elementwise("vf_mul", lambda: v.vector_mul("a", "b"), "a[i] * b[i]")
_elementwise("vf_scale", lambda: v.scalar_vector_mul(F.lit(2.5), "a"), "2.5::DOUBLE * a[i]")
_elementwise("vf_normalize", lambda: v.vector_normalize("a"), "a[i] / n")


def _scalar(name: str, build, sql: str) -> None:
    query(name, f"SELECT id, {sql} AS value FROM ({PAIR_SQL})")(lambda s, d: pairs(s, d).select("id", build().alias("value")))


def bits(c: str):
    return F.transform(F.col(c), lambda x: F.when(x > 0, 1).otherwise(0).cast("long"))


_BITS = "list_transform({0}, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END)"
_AND = f"list_sum(list_transform(list_zip({_BITS.format('a')}, {_BITS.format('b')}), lambda z: z[1] * z[2]))"
_XOR = f"list_sum(list_transform(list_zip({_BITS.format('a')}, {_BITS.format('b')}), lambda z: abs(z[1] - z[2])))"
_scalar("vf_l1", lambda: F.round(v.vector_l1("a", "b"), 6), "round(list_sum(list_transform(list_zip(a, b), lambda z: abs(z[1] - z[2]))), 6)")
_scalar("vf_l2sq", lambda: F.round(v.vector_l2sq("a", "b"), 6), "round(list_sum(list_transform(list_zip(a, b), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6)")
_scalar("vf_hamming", lambda: v.vector_hamming(bits("a"), bits("b")), f"({_XOR})::BIGINT")
_scalar("vf_jaccard", lambda: F.round(v.vector_jaccard(bits("a"), bits("b")), 9), f"CASE WHEN {_AND} + {_XOR} = 0 THEN 1.0::DOUBLE ELSE round({_AND}::DOUBLE / ({_AND} + {_XOR}), 9) END")
_scalar("hb_l2", lambda: F.round(v.l2_distance("a", "b"), 6), "round(list_distance(a, b), 6)")
_scalar("hb_cosine", lambda: F.round(v.cosine_similarity("a", "b"), 6), "round(coalesce(nullif(list_cosine_similarity(a, b), 'nan'::DOUBLE), 0), 6)")
_scalar("hb_dot", lambda: F.round(v.dot_product("a", "b"), 6), "round(list_inner_product(a, b), 6)")
_scalar("hb_magnitude", lambda: F.round(v.vector_magnitude("a"), 6), "round(sqrt(list_sum(list_transform(a, lambda x: x * x))), 6)")
_scalar("hb_apply_sum", lambda: F.round(v.apply_sum("a"), 6), "round(list_sum(a), 6)")
_scalar("hb_array_length", lambda: v.array_length("a"), "len(a)::BIGINT")


@query("vf_sql_functions", f"SELECT id, round(list_sum(list_transform(list_zip(a, b), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6) AS l2sq, ({_XOR})::BIGINT AS hamming FROM ({PAIR_SQL})")
def vf_sql_functions(s: SparkSession, d: str) -> DataFrame:
    v.register_sql(s)
    p = pairs(s, d).select("id", F.col("a").cast("array<double>").alias("a"), F.col("b").cast("array<double>").alias("b"), bits("a").alias("x"), bits("b").alias("y"))
    return s.sql("SELECT id, round(vector_l2sq(a, b), 6) AS l2sq, vector_hamming(x, y) AS hamming FROM {p}", p=p)


# aggregates


def _aggregate(name: str, build, sql: str, by: bool) -> None:
    g = "label, " if by else ""
    query(name, f"SELECT {g}(i - 1)::BIGINT AS pos, round({sql}(embedding[i]::DOUBLE), 6) AS value FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY {g}i")(
        lambda s, d: build(emb(s, d), by=["label"] if by else None, name="x").select(*(["label"] if by else []), F.posexplode("x").alias("pos", "y")).select(*(["label"] if by else []), F.col("pos").cast("long").alias("pos"), F.round("y", 6).alias("value"))
    )


_aggregate("vec_sum_by_label", agg.vector_sum, "sum", True)
_aggregate("vec_sum_all", agg.vector_sum, "sum", False)
_aggregate("vec_avg_by_label", agg.vector_avg, "avg", True)
_aggregate("vec_avg_all", agg.vector_avg, "avg", False)

# exact scans

for _m in ("l2", "cosine", "dot", "l1"):
    query(f"scan_{_m}", knn_sql(metric=_m))(lambda s, d, m=_m: shown(exact.scan(emb(s, d), asked(s, d), K, m)))
query("scan_catalyst", knn_sql(metric="cosine"))(lambda s, d: shown(exact.scan_sql(emb(s, d), asked(s, d), K, "cosine")))
query("scan_k_over_rows", knn_sql(f"{ROWS_SQL} WHERE label = 3", k=16384))(lambda s, d: shown(exact.scan(emb(s, d).where("label = 3"), asked(s, d), 16384)))
query("scan_filtered", knn_sql(f"{ROWS_SQL} WHERE label = 3", "cosine"))(lambda s, d: shown(exact.scan(emb(s, d).where("label = 3"), asked(s, d), K, "cosine")))
query("range_l2", knn_sql(k=16384, where="score <= 1.2"))(lambda s, d: shown(exact.scan(emb(s, d), asked(s, d), 16384, "l2", 1.2)))
query("range_cosine", knn_sql(metric="cosine", k=16384, where="score >= 0.2"))(lambda s, d: shown(exact.scan(emb(s, d), asked(s, d), 16384, "cosine", 0.2)))
TIES_SQL = f"{ROWS_SQL} UNION ALL SELECT vec_id + {REPLACED}, embedding::DOUBLE[] FROM embeddings"
query("scan_ties", knn_sql(TIES_SQL))(lambda s, d: shown(exact.scan(emb(s, d).select("id", "vec").unionByName(emb(s, d).select((F.col("id") + REPLACED).alias("id"), "vec")), asked(s, d), K)))
query("scan_nulls_skipped", knn_sql(f"{ROWS_SQL} WHERE label <> 2"))(
    lambda s, d: shown(exact.scan(emb(s, d).select("id", F.when(F.col("label") != 2, F.col("vec")).alias("vec")).unionByName(emb(s, d).select(F.lit(None).cast("long").alias("id"), "vec")), asked(s, d), K))
)
query("scan_join_filter", knn_sql("SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings JOIN documents ON doc_id = vec_id WHERE lang = 'en'", "cosine"))(
    lambda s, d: shown(exact.scan(emb(s, d).join(s.read.parquet(f"{d}/documents.parquet").where("lang = 'en'").select(F.col("doc_id").alias("id")), "id", "left_semi"), asked(s, d), K, "cosine"))
)
_ONE = [1.0 if i % 2 else -0.5 for i in range(64)]
query("scan_single_limit", f"SELECT vec_id AS id, round(list_distance(embedding::DOUBLE[], {_ONE}::DOUBLE[]), 6) AS score FROM embeddings ORDER BY list_distance(embedding::DOUBLE[], {_ONE}::DOUBLE[]), vec_id LIMIT 10")(
    lambda s, d: exact.scan_single(emb(s, d), _ONE).select("id", F.round("score", 6).alias("score"))
)


@query(
    "scan_text_queries",
    f"WITH q AS (SELECT 1::BIGINT AS qid, {_ONE}::DOUBLE[] AS e UNION ALL SELECT 2, {_ONE[::-1]}::DOUBLE[]), r AS ({ROWS_SQL}), s AS (SELECT qid, id, list_distance(r.e, q.e) AS score FROM r, q), "
    "t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score, id)::INTEGER AS rank FROM s) SELECT qid, id, round(score, 6) AS score, rank FROM t WHERE rank <= 10",
)
def scan_text_queries(s: SparkSession, d: str) -> DataFrame:
    q = s.createDataFrame(parse_queries(queries=f"{_ONE}; {_ONE[::-1]};"), "qid long, qvec array<double>")
    return shown(exact.scan(emb(s, d), q, K))


_ONE_SQL = f"list_distance(embedding::DOUBLE[], {_ONE}::DOUBLE[])"


def _view(s: SparkSession, d: str) -> None:
    emb(s, d).select("id", F.col("vec").cast("array<double>").alias("vec")).createOrReplaceTempView("emb_view")
    v.register_view_functions(s, "emb_view")


@query("sql_knn_function", f"SELECT * FROM (SELECT vec_id AS id, round({_ONE_SQL}, 6) AS score, row_number() OVER (ORDER BY {_ONE_SQL}, vec_id)::INTEGER AS rank FROM embeddings) WHERE rank <= 10")
def sql_knn_function(s: SparkSession, d: str) -> DataFrame:
    _view(s, d)
    return s.sql(f"SELECT id, round(score, 6) AS score, rank FROM emb_view_knn(array({', '.join(f'{x}D' for x in _ONE)}), 10)")


@query("sql_within_function", f"SELECT vec_id AS id, round({_ONE_SQL}, 6) AS score FROM embeddings WHERE {_ONE_SQL} <= 6.3")
def sql_within_function(s: SparkSession, d: str) -> DataFrame:
    _view(s, d)
    return s.sql(f"SELECT id, round(score, 6) AS score FROM emb_view_within(array({', '.join(f'{x}D' for x in _ONE)}), 6.3D)")


@query("sql_vector_aggregates", "SELECT (i - 1)::INTEGER AS pos, round(sum(embedding[i]::DOUBLE), 6) AS total, round(avg(embedding[i]::DOUBLE), 6) AS mean FROM (SELECT embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY i")
def sql_vector_aggregates(s: SparkSession, d: str) -> DataFrame:
    _view(s, d)
    return s.sql("SELECT a.pos, round(a.value, 6) AS total, round(b.value, 6) AS mean FROM emb_view_vector_sum() a JOIN emb_view_vector_avg() b ON a.pos = b.pos")


# journals

SPEC = JournalSpec("id", "vec", "del", "ver")
FLAT = "id, round(list_sum(e), 6) AS total"


def totals(df: DataFrame, *more: str) -> DataFrame:
    return df.select("id", *more, F.round(v.apply_sum("vec"), 6).alias("total"))


query("journal_live", f"SELECT {FLAT} FROM ({LIVE_SQL})")(lambda s, d: totals(live_rows(normalise(journal(s, d), SPEC))))
query("journal_delta", f"SELECT {FLAT}, del, ver FROM ({JOURNAL_SQL}) WHERE ver > {BOUNDARY}")(lambda s, d: totals(delta(normalise(journal(s, d), SPEC), BOUNDARY), "del", "ver"))
query("journal_changes", f"SELECT {FLAT}, del FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ver DESC, del DESC) AS rn FROM ({JOURNAL_SQL}) WHERE ver > {BOUNDARY} AND ver <= {DELETED + 1_000_000_000}) WHERE rn = 1")(
    lambda s, d: totals(changes(normalise(journal(s, d), SPEC), BOUNDARY, DELETED + 1_000_000_000), "del")
)
query("journal_int_op", f"SELECT {FLAT} FROM ({LIVE_SQL})")(
    lambda s, d: totals(live_rows(normalise(journal(s, d).withColumn("op", F.when(F.col("del"), -1)).drop("del"), JournalSpec("id", "vec", "op", "ver"))))
)
query("journal_timestamp_ver", f"SELECT {FLAT} FROM ({LIVE_SQL})")(
    lambda s, d: totals(live_rows(normalise(journal(s, d).withColumn("ts", F.timestamp_seconds(F.col("ver"))).drop("ver"), JournalSpec("id", "vec", "del", "ts"))))
)


@query(
    "digest_counts",
    f"SELECT (SELECT count(*) FROM ({JOURNAL_SQL}) WHERE ver <= {BOUNDARY}) AS before, (SELECT count(*) FROM ({JOURNAL_SQL})) AS upto, true AS same_in_any_order, true AS tells_a_changed_vector, true AS tells_a_changed_version, true AS adds_up",
)
def digest_counts(s: SparkSession, d: str) -> DataFrame:
    """The counts, and what the digest is for: other partitioning gives the same, any changed row another; parts add up."""
    j, top = normalise(journal(s, d), SPEC), DELETED + 1_000_000_000
    (a, x), (b, y) = digest(j, BOUNDARY, top)
    moved = digest(j.repartition(7, "ver"), BOUNDARY, top) == [(a, x), (b, y)]
    first = F.col("ver") == j.agg(F.min("ver")).first()[0]
    bent = digest(j.withColumn("vec", F.when(first, F.reverse("vec")).otherwise(F.col("vec"))), top)[0]
    late = digest(j.withColumn("ver", F.when(first, F.col("ver") - 1).otherwise(F.col("ver"))), top)[0]
    rest = digest(j.where(F.col("ver") > BOUNDARY), top)[0]
    return s.createDataFrame([(a, b, moved, bent[0] == b and bent[1] != y, late[0] == b and late[1] != y, (a + rest[0], x + rest[1]) == (b, y))], "before long, upto long, same_in_any_order boolean, tells_a_changed_vector boolean, tells_a_changed_version boolean, adds_up boolean")


query(
    "refresh_classify",
    f"WITH base AS (SELECT id, e FROM ({JOURNAL_SQL}) WHERE ver <= {BOUNDARY}), n AS (SELECT id, e, del FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ver DESC, del DESC) AS rn FROM ({JOURNAL_SQL}) WHERE ver > {BOUNDARY}) WHERE rn = 1) "
    "SELECT CASE WHEN del AND base.id IS NULL THEN 'absent' WHEN del THEN 'deleted' WHEN base.id IS NULL THEN 'appended' WHEN n.e = base.e THEN 'unchanged' ELSE 'replaced' END AS what, count(*) AS n FROM n LEFT JOIN base ON n.id = base.id GROUP BY 1",
)(
    lambda s, d: classify(live_rows(normalise(journal(s, d), SPEC), BOUNDARY), changes(normalise(journal(s, d), SPEC), BOUNDARY, DELETED + 1_000_000_000)).groupBy("what").agg(F.count("*").alias("n"))
)

# indexes


def index(s: SparkSession, d: str, kind: str = "flat", metric: str = "l2", at: int | None = BOUNDARY, **options) -> Catalog:
    """A catalog with one index `x` over the derived journal, refreshed up to `at` (None: all of it)."""
    root = workspace(s, "index")
    journal(s, d).write.parquet(f"{root}/journal")
    c = Catalog(s, root)
    register(c, "x", f"{root}/journal", "id", "vec", "del", "ver", metric, 0, kind)
    set_options(c, "x", **options)
    if at is not None:  # the snapshot is that of a journal that ended there
        upto(c, at)
    refresh(c, "x")
    if at is not None:
        m = c.get("x")
        m.source = f"{root}/journal"
        c.put(m)
    return c


def upto(c: Catalog, version: int) -> None:
    m = c.get("x")
    part = f"{c.root}/journal_upto"
    c.spark.read.parquet(m.source).where(F.col("ver") <= version).write.parquet(part)
    m.source = part
    c.put(m)


BASE_SQL = ROWS_SQL
query("search_snapshot", knn_sql(BASE_SQL))(lambda s, d: shown(search.search(index(s, d), "x", asked(s, d), k=K, freshness="snapshot")))
query("search_exact_overlay", knn_sql(LIVE_SQL, "cosine"))(lambda s, d: shown(search.search(index(s, d, metric="cosine"), "x", asked(s, d), k=K, freshness="exact")))
query("search_allow", knn_sql(f"{BASE_SQL} WHERE label = 3"))(lambda s, d: shown(search.search(index(s, d), "x", asked(s, d), allow=emb(s, d).where("label = 3"), k=K, freshness="snapshot")))
query("search_allow_empty", knn_sql(BASE_SQL, where="false"))(lambda s, d: shown(search.search(index(s, d), "x", asked(s, d), allow=emb(s, d).where("label < 0"), k=K, freshness="snapshot")))
query("search_allow_unknown", knn_sql(BASE_SQL, where="false"))(lambda s, d: shown(search.search(index(s, d), "x", asked(s, d), allow=emb(s, d).select((F.col("id") + REPLACED).alias("id")), k=K, freshness="snapshot")))
query("search_allow_overlay", knn_sql(f"SELECT l.id, l.e FROM ({LIVE_SQL}) l JOIN embeddings ON vec_id = l.id WHERE label = 3", "dot"))(
    lambda s, d: shown(search.search(index(s, d, metric="dot"), "x", asked(s, d), allow=emb(s, d).where("label = 3"), k=K))
)
query("search_allow_radius", knn_sql(f"SELECT l.id, l.e FROM ({LIVE_SQL}) l JOIN embeddings ON vec_id = l.id WHERE label = 3", k=16384, where="score <= 1.25"))(
    lambda s, d: shown(search.search(index(s, d), "x", asked(s, d), allow=emb(s, d).where("label = 3"), radius=1.25, k=16384))
)


@query("search_static", knn_sql(ROWS_SQL, "l1"))
def search_static(s: SparkSession, d: str) -> DataFrame:
    root = workspace(s, "index")
    emb(s, d).select("id", "vec").write.parquet(f"{root}/rows")
    c = Catalog(s, root)
    register(c, "x", f"{root}/rows", "id", "vec", metric="l1", index_type="flat")
    refresh(c, "x")
    return shown(search.search(c, "x", asked(s, d), k=K))


@query("search_seven_columns", knn_sql(f"SELECT l.id, l.e FROM ({LIVE_SQL}) l JOIN embeddings ON vec_id = l.id WHERE label = 3"))
def search_seven_columns(s: SparkSession, d: str) -> DataFrame:
    c = index(s, d)
    c.make_views(c.get("x"))
    rows = s.table("x_delta").unionByName(asked(s, d), allowMissingColumns=True).unionByName(emb(s, d).where("label = 3").select("id"), allowMissingColumns=True)
    rows = rows.unionByName(s.table("x_snap"), allowMissingColumns=True)
    return shown(search.vsearch(c, "x", rows, filtered=True, k=K))


query(
    "knn_join_related",
    "WITH r AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT q.vec_id AS left_id, q.label, r.vec_id AS id, list_distance(r.e, q.e) AS score FROM r, r q WHERE q.vec_id % 50 = 0), "
    "t AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY score, id)::INTEGER AS rank FROM s) SELECT left_id, label, id, round(score, 6) AS score, rank FROM t WHERE rank <= 3",
)(lambda s, d: search.knn_join(index(s, d), "x", emb(s, d).where("id % 50 = 0"), "vec", 3).select("left_id", "label", "id", F.round("score", 6).alias("score"), "rank"))

# recipes

FOUND_SQL = f"({knn_sql(metric='cosine', k=50)})"


def found50(s: SparkSession, d: str) -> DataFrame:
    return exact.scan(emb(s, d), asked(s, d), 50, "cosine")


query("recipe_payload_join", f"SELECT qid, id, score, rank, label FROM {FOUND_SQL} JOIN embeddings ON vec_id = id")(
    lambda s, d: recipes.with_payload(shown(found50(s, d)), emb(s, d).select("id", "label")).select("qid", "id", "score", "rank", "label")
)
query("recipe_best_per_group", f"SELECT qid, label, id, score, rank FROM (SELECT f.*, label, row_number() OVER (PARTITION BY qid, label ORDER BY rank) AS rn FROM {FOUND_SQL} f JOIN embeddings ON vec_id = id) WHERE rn = 1")(
    lambda s, d: search.best_per_group(shown(found50(s, d)), emb(s, d), "label")
)
query("recipe_post_filter", f"SELECT qid, id, score, rn AS rank FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY rank)::INTEGER AS rn FROM {FOUND_SQL} JOIN embeddings ON vec_id = id WHERE label <> 1) WHERE rn <= 10")(
    lambda s, d: shown(recipes.post_filter(found50(s, d), emb(s, d), F.col("label") != 1, K, "cosine"))
)
query("recipe_near_duplicates", f"SELECT qid, id, score FROM ({knn_sql(metric='cosine', k=2)}) WHERE score >= 0.3 AND qid < id")(
    lambda s, d: recipes.near_duplicates(emb(s, d), asked(s, d), 0.3).select("qid", "id", F.round("score", 6).alias("score"))
)
query("recipe_near_duplicates_all", f"SELECT qid, id, score FROM ({knn_sql(metric='cosine', k=2).replace(' WHERE vec_id % 50 = 0', '')}) WHERE score >= 0.3 AND qid < id")(
    lambda s, d: recipes.all_near_duplicates(emb(s, d), 0.3).select("qid", "id", F.round("score", 6).alias("score"))
)
query(
    "recipe_centroid_diff",
    "WITH c AS (SELECT i, avg(embedding[i]::DOUBLE) FILTER (label = 1) - avg(embedding[i]::DOUBLE) FILTER (label = 2) AS x FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY i), "
    "q AS (SELECT list(x ORDER BY i) AS e FROM c), s AS (SELECT vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], q.e) AS score FROM embeddings, q) "
    "SELECT 0::BIGINT AS qid, id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, id)::INTEGER AS rank FROM s ORDER BY score DESC, id LIMIT 10",
)(lambda s, d: shown(recipes.centroid_difference(emb(s, d), F.col("label") == 1, F.col("label") == 2)))
query(
    "recipe_spread",
    "WITH x AS (SELECT vec_id, label, i, embedding[i]::DOUBLE AS x FROM (SELECT vec_id, label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)), c AS (SELECT label, i, avg(x) AS m FROM x GROUP BY label, i) "
    "SELECT x.label, count(DISTINCT vec_id) AS members, round(sum((x - m) * (x - m)), 6) AS spread FROM x JOIN c ON c.label = x.label AND c.i = x.i GROUP BY x.label",
)(lambda s, d: recipes.spread_to_centroid(emb(s, d), "label").select("label", "members", F.round("spread", 6).alias("spread")))
query(
    "result_full_outer_compare",
    f"SELECT count(*) AS n, count(a.id) AS of_a, count(b.id) AS of_b FROM ({knn_sql(metric='l2')}) a FULL JOIN ({knn_sql(metric='cosine')}) b ON a.qid = b.qid AND a.id = b.id",
)(
    lambda s, d: exact.scan(emb(s, d), asked(s, d), K, "l2").select("qid", "id", F.lit(1).alias("a"))
    .join(exact.scan(emb(s, d), asked(s, d), K, "cosine").select("qid", "id", F.lit(1).alias("b")), ["qid", "id"], "full_outer").agg(F.count("*").alias("n"), F.count("a").alias("of_a"), F.count("b").alias("of_b"))
)

# refresh, codes, graphs


@query("refresh_incremental_equals_full", f"SELECT {FLAT} FROM ({LIVE_SQL})")
def refresh_incremental_equals_full(s: SparkSession, d: str) -> DataFrame:
    c = index(s, d)
    refresh(c, "x", "incremental")
    return totals(c.live(c.get("x")))


@query(
    "sq8_range",
    "WITH p AS (SELECT embedding, row_number() OVER (ORDER BY vec_id) - 1 AS pos, count(*) OVER () AS rows, least(count(*) OVER (), 1563) AS take FROM embeddings), "
    "e AS (SELECT unnest(embedding) AS x FROM p WHERE floor(ceil(pos * take / rows) * rows / take) = pos), n AS (SELECT *, row_number() OVER (ORDER BY x) - 1 AS i, count(*) OVER () AS c FROM e), "
    "b AS (SELECT max(x) FILTER (i = floor(0.001 * (c - 1))) AS lo, max(x) FILTER (i = ceil(0.999 * (c - 1))) AS hi FROM n) SELECT lo::DOUBLE AS lo, ((hi - lo)::FLOAT / 255::FLOAT)::FLOAT::DOUBLE AS scale FROM b",
)
def sq8_range(s: SparkSession, d: str) -> DataFrame:
    e = emb(s, d)
    lo, scale = train_sq8(e, e.count(), 64)
    return s.createDataFrame([(lo, scale)], "lo double, scale double")


def _codes(s: SparkSession, d: str, rescore: bool, oversampling: float) -> DataFrame:
    e = emb(s, d)
    lo, scale = train_sq8(e, e.count(), 64)
    coded = sq8_bytes(e, lo, scale, "l2")
    return shown(search_codes(coded, asked(s, d), K, "l2", lo, scale, rescore, oversampling))


query("sq8_search_rescored", knn_sql())(lambda s, d: _codes(s, d, True, 4.0))
query("sq8_search_codes_only", "SELECT vec_id AS qid, 10::BIGINT AS n, true AS close FROM embeddings WHERE vec_id % 50 = 0")(  # approximate scores of 256 levels an element
    lambda s, d: _codes(s, d, False, 1.0).alias("c").join(exact.scan(emb(s, d), asked(s, d), K).alias("e"), ["qid", "rank"])
    .groupBy("qid").agg(F.count("*").alias("n"), (F.max(F.abs(F.col("c.score") - F.col("e.score"))) < 0.02).alias("close"))
)
query("sq8_index_search", knn_sql(LIVE_SQL, "cosine"))(lambda s, d: shown(search.search(index(s, d, metric="cosine", quantization="sq8"), "x", asked(s, d), k=K)))
query("hnsw_full_ef", knn_sql())(lambda s, d: shown(search.search(index(s, d, "hnsw"), "x", asked(s, d), k=K, ef_search=100000, freshness="snapshot")))
query("hnsw_balanced", knn_sql())(lambda s, d: shown(search.search(index(s, d, "hnsw"), "x", asked(s, d), k=K, freshness="snapshot")))
query("hnsw_cosine_best", knn_sql(metric="cosine"))(lambda s, d: shown(search.search(index(s, d, "hnsw", "cosine"), "x", asked(s, d), k=K, precision="best", freshness="snapshot")))
query("hnsw_sq8", knn_sql(metric="cosine"))(lambda s, d: shown(search.search(index(s, d, "hnsw", "cosine", quantization="sq8"), "x", asked(s, d), k=K, precision="best", freshness="snapshot")))
query("hnsw_range", knn_sql(k=16384, where="score <= 1.2"))(lambda s, d: shown(search.search(index(s, d, "hnsw"), "x", asked(s, d), radius=1.2, k=16384, freshness="snapshot")))
query("hnsw_filtered", knn_sql(f"{BASE_SQL} WHERE label = 3"))(lambda s, d: shown(search.search(index(s, d, "hnsw"), "x", asked(s, d), allow=emb(s, d).where("label = 3"), k=K, freshness="snapshot")))


@query("hnsw_filtered_masked", knn_sql(f"{BASE_SQL} WHERE label <> 3"))
def hnsw_filtered_masked(s: SparkSession, d: str) -> DataFrame:
    """The walk that passes through rows that aren't allowed, whatever the cost rule would choose."""
    c = index(s, d, "hnsw")
    m = c.get("x")
    allowed = c.snapshot(m).join(emb(s, d).where("label <> 3").select("id"), "id", "left_semi")
    only = allowed.groupBy("seg", "shard").agg(F.collect_list("pos").alias("pos"))
    return shown(search_graph(c.graph(m), asked(s, d), K, "l2", 100, only=only))


@query("hnsw_after_incremental", knn_sql(LIVE_SQL))
def hnsw_after_incremental(s: SparkSession, d: str) -> DataFrame:
    c = index(s, d, "hnsw")
    refresh(c, "x", "incremental")
    return shown(search.search(c, "x", asked(s, d), k=K, precision="best"))


@query("hnsw_unreachable", "SELECT 0::BIGINT AS unreachable, (SELECT count(*) FROM embeddings) AS n")
def hnsw_unreachable(s: SparkSession, d: str) -> DataFrame:
    c = index(s, d, "hnsw")
    return c.graph(c.get("x")).agg(F.sum("unreachable").alias("unreachable"), F.sum("n").alias("n"))


PRECISIONS = {"fast": 0.7, "balanced": 0.95, "best": 0.98}


@query("recall_report", " UNION ALL ".join(f"SELECT '{p}' AS precision, {least}::DOUBLE AS least, true AS enough" for p, least in PRECISIONS.items()))
def recall_report(s: SparkSession, d: str) -> DataFrame:
    """Whether each precision finds the share of the exact neighbours that is expected of it."""
    c = index(s, d, "hnsw")
    best = search.search(c, "x", asked(s, d), k=K, precision="exact", freshness="snapshot")
    out = None
    for p, least in PRECISIONS.items():
        r = search.recall(best, search.search(c, "x", asked(s, d), k=K, precision=p, freshness="snapshot")).select(F.lit(p).alias("precision"), F.lit(least).alias("least"), (F.col("recall") >= least).alias("enough"))
        out = r if out is None else out.unionByName(r)
    return out


@query("recall_codes", "SELECT 'codes only' AS form, 0.8::DOUBLE AS least, true AS enough UNION ALL SELECT 'rescored', 0.98, true")
def recall_codes(s: SparkSession, d: str) -> DataFrame:
    best = exact.scan(emb(s, d), asked(s, d), K)
    out = None
    for form, rescore, least in (("codes only", False, 0.8), ("rescored", True, 0.98)):
        r = search.recall(best, _codes(s, d, rescore, 2.0)).select(F.lit(form).alias("form"), F.lit(least).alias("least"), (F.col("recall") >= least).alias("enough"))
        out = r if out is None else out.unionByName(r)
    return out


# comparisons of results

query("result_ties", f"SELECT *, score IS NOT DISTINCT FROM lag(score) OVER w OR score IS NOT DISTINCT FROM lead(score) OVER w AS tied FROM ({knn_sql(TIES_SQL)}) WINDOW w AS (PARTITION BY qid ORDER BY rank)")(
    lambda s, d: recipes.ties(shown(exact.scan(emb(s, d).select("id", "vec").unionByName(emb(s, d).select((F.col("id") + REPLACED).alias("id"), "vec")), asked(s, d), K)))
)
query(
    "result_difference",
    f"WITH a AS ({knn_sql(metric='l2')}), b AS ({knn_sql(metric='cosine')}), x AS (SELECT qid, id FROM a EXCEPT ALL SELECT qid, id FROM b), y AS (SELECT qid, id FROM b EXCEPT ALL SELECT qid, id FROM a) SELECT *, 'a' AS side FROM x UNION ALL SELECT *, 'b' FROM y",
)(lambda s, d: recipes.difference(exact.scan(emb(s, d), asked(s, d), K, "l2").select("qid", "id"), exact.scan(emb(s, d), asked(s, d), K, "cosine").select("qid", "id")))
query("recipe_theta_join", "SELECT x.vec_id AS a, y.vec_id AS b, round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6) AS score FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id AND list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) >= 0.4")(
    lambda s, d: recipes.theta_join(emb(s, d), 0.4).select("a", "b", F.round("score", 6).alias("score"))
)

# administration

_MB = "1048576.0"


def _sizing_sql(n: int, dims: int, hnsw: bool, sq8: bool) -> str:
    stride = (dims + 15) // 16 * 16
    parts = [f"{n}::DOUBLE * {stride} * 4 / {_MB}", f"{n}::DOUBLE * 8 / {_MB}", f"{n}::DOUBLE * (33 * 4 + 5 + 17 * 4 / 15.0::DOUBLE) / {_MB}" if hnsw else "0::DOUBLE", f"{n}::DOUBLE * ({stride} + 4) / {_MB}" if sq8 else "0::DOUBLE"]
    parts.append(f"{n}::DOUBLE * 4 / {_MB}")
    total = " + ".join(parts[:4])
    return f"SELECT round({parts[0]}, 3) AS vectors_mb, round({parts[1]}, 3) AS ids_mb, round({parts[2]}, 3) AS graph_mb, round({parts[3]}, 3) AS sq8_mb, round({total}, 3) AS total_mb, round({total} + {parts[4]}, 3) AS build_mb"


for _name, _args in {"sizing_hnsw": (10_000_000, 768, "hnsw", "none"), "sizing_flat_sq8": (2_000_000, 1536, "flat", "sq8")}.items():
    query(_name, _sizing_sql(_args[0], _args[1], _args[2] == "hnsw", _args[3] == "sq8"))(
        lambda s, d, a=_args: sizing(s, *a).select(*[F.round(c, 3).alias(c) for c in ("vectors_mb", "ids_mb", "graph_mb", "sq8_mb", "total_mb", "build_mb")])
    )
_FACTS = ["index_name", "snapshot_id", "max_ver", "vector_count", "dims", "metric", "index_type", "quantization", "tombstones", "base_snapshot", "loaded", "capacity", "unreachable"]
query(
    "index_info",
    "SELECT 'x' AS index_name, 1::BIGINT AS snapshot_id, max(vec_id) AS max_ver, count(*) AS vector_count, max(len(embedding))::BIGINT AS dims, 'l2' AS metric, 'hnsw' AS index_type, 'none' AS quantization, 0::BIGINT AS tombstones, "
    "1::BIGINT AS base_snapshot, true AS loaded, count(*) AS capacity, 0::BIGINT AS unreachable FROM embeddings",
)(lambda s, d: admin.info(index(s, d, "hnsw"), "x").select(*_FACTS))
query(
    "index_status",
    "SELECT 'notice' AS level, 'index x: flat index, ' || count(*) || ' live vectors, 0 tombstones (tombstone_ratio 0.2), refresh_mode auto, 0 incremental refreshes since the last full build (rebuild_every never)' AS message FROM embeddings "
    "UNION ALL SELECT 'notice', 'index x: journal digest verified at every refresh (verify_every 1); 0 refreshes since the last verification or full build' "
    "UNION ALL SELECT 'notice', 'index x: a chain of 1 snapshots from 1' "
    "UNION ALL SELECT 'notice', 'index x: ' || (count(*) FILTER (vec_id % 7 = 0 AND vec_id < (SELECT max(vec_id) FROM embeddings)) + count(*) FILTER (vec_id % 11 = 0)) || ' journal rows in the delta' FROM embeddings",
)(  # what depends on the machine or the clock is left out
    lambda s, d: admin.status(index(s, d), "x").where("level = 'notice' and not message rlike 'sizing|last refresh'").select("level", F.regexp_replace("message", ", read in .*", "").alias("message"))
)
query("library_version", f"SELECT '{admin.__version__}' AS library_version, {admin.FORMAT_VERSION}::INTEGER AS format_version")(lambda s, d: admin.version(s).drop("build_flags"))
query("index_verify", "SELECT 1::BIGINT AS segment, unnest(['checksum', 'live rows', 'ids that live twice']) AS what, true AS fine")(lambda s, d: verify(index(s, d), "x").select("segment", "what", "fine"))


@query("streaming_refresh", f"SELECT {FLAT} FROM ({LIVE_SQL})")
def streaming_refresh(s: SparkSession, d: str) -> DataFrame:
    """The journal arrives as a stream in several files; the index ends where one refresh of the whole would."""
    root = workspace(s, "stream")
    j = journal(s, d)
    schema = j.schema
    for name, part in (("0", j.where(F.col("ver") <= BOUNDARY)), ("1", j.where(F.col("ver").between(REPLACED, DELETED - 1))), ("2", j.where(F.col("ver") >= DELETED))):
        part.coalesce(1).write.parquet(f"{root}/in/{name}")
    c = Catalog(s, f"{root}/catalog")
    j.limit(0).write.parquet(f"{root}/journal/batch=-1")
    register(c, "x", f"{root}/journal", "id", "vec", "del", "ver", "l2", 0, "flat")
    stream = s.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{root}/in")
    append_and_refresh(stream, c, "x", f"{root}/check").awaitTermination()
    return totals(c.live(c.get("x")))
