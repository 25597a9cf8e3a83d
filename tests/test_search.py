"""Exact and approximate search, journals, indexes and their refresh, against NumPy."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from vecloom.operators import exact, search
from vecloom.operators.workers import Graph
from vecloom.plans import admin
from vecloom.plans.catalog import Catalog, register, set_options, unregister
from vecloom.plans.refresh import refresh, verify
from vecloom.plans.settings import filter_exact_limit, parameters, resolve
from vecloom.plans.sizing import estimate


def table(spark, ids, x):
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "id long, vec array<double>")


def asked(spark, q):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "qid long, qvec array<double>")


def scores(x, q, metric):
    if metric == "l2":
        return np.linalg.norm(x - q, axis=1)
    if metric == "l1":
        return np.abs(x - q).sum(axis=1)
    d = x @ q
    n = np.linalg.norm(x, axis=1) * np.linalg.norm(q)
    return d if metric == "dot" else np.divide(d, n, out=np.zeros_like(d), where=n > 0)


def brute(ids, x, qs, metric, k, radius=None):
    out, sign = {}, 1 if metric in ("l2", "l1") else -1
    for j, q in enumerate(qs):
        s = scores(x, q, metric)
        ok = np.ones(len(s), bool) if radius is None else sign * s <= sign * radius
        order = np.lexsort((ids[ok], sign * np.round(s[ok], 9)))[:k]
        out[j] = [(int(ids[ok][o]), float(s[ok][o])) for o in order]
    return out


def got(found):
    out = {}
    for r in found.orderBy("qid", "rank").collect():
        out.setdefault(r.qid, []).append((r.id, r.score))
        assert r.rank == len(out[r.qid])
    return out


def same(a, b):
    assert {q: [i for i, _ in v] for q, v in a.items()} == {q: [i for i, _ in v] for q, v in b.items() if v}
    for q, v in a.items():
        assert np.allclose([s for _, s in v], [s for _, s in b[q]], rtol=1e-5, atol=1e-6)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 12))
    x[50:60] = x[:10]  # ties
    x[60] = 0
    return np.arange(400), x, np.vstack([rng.normal(size=(5, 12)), x[3:4]])


@pytest.mark.parametrize("metric", ["l2", "l1", "cosine", "dot"])
@pytest.mark.parametrize("k,radius", [(7, None), (1000, None), (1000, 0.3), (5, 4.0)])
def test_scan_in_both_forms(spark, data, metric, k, radius):
    ids, x, q = data
    want = brute(ids, x, q, metric, k, radius)
    same(got(exact.scan(table(spark, ids, x).repartition(3), asked(spark, q), k, metric, radius)), want)
    if k == 7:
        same(got(exact.scan_sql(table(spark, ids, x), asked(spark, q), k, metric, radius)), want)


def test_scan_rules(spark, data):
    ids, x, q = data
    t = table(spark, ids, x)
    odd = t.unionByName(spark.createDataFrame([(None, x[0].tolist()), (9999, None)], "id long, vec array<double>"))
    same(got(exact.scan(odd, asked(spark, q), 3)), brute(ids, x, q, "l2", 3))
    assert exact.scan(t.limit(0), asked(spark, q)).collect() == [] and exact.scan(t, asked(spark, q).limit(0)).collect() == []
    with pytest.raises(ValueError, match="k must be 1 to 16384, not 0"):
        exact.scan(t, asked(spark, q), 0)
    with pytest.raises(ValueError, match="metric must be l2, cosine, dot or l1, not 'x'"):
        exact.scan(t, asked(spark, q), 1, "x")
    with pytest.raises(PySparkException, match="another length"):
        exact.scan(t, asked(spark, q[:, :5])).collect()
    with pytest.raises(ValueError, match="a query row needs a vector"):
        exact.scan(t, spark.createDataFrame([(1, None)], "qid long, qvec array<double>"))
    r = exact.scan_single(t, q[0].tolist(), 4).collect()
    assert [x.id for x in r] == [i for i, _ in brute(ids, x, q[:1], "l2", 4)[0]]


def test_query_blocks_cover_all_queries(spark, data, monkeypatch):
    ids, x, q = data
    monkeypatch.setattr(exact, "BLOCK_ELEMENTS", 24)
    same(got(exact.scan(table(spark, ids, x), asked(spark, q), 5)), brute(ids, x, q, "l2", 5))


def test_blocks_of_queries_and_rows_meet_on_the_executors(spark, data, monkeypatch):
    ids, x, q = data
    monkeypatch.setattr(exact, "BLOCK_ELEMENTS", 600)
    t = table(spark, ids, x).repartition(3)
    found = exact.scan(t, table(spark, ids, x).withColumnsRenamed({"id": "qid", "vec": "qvec"}), 4)
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()
    same(got(found), brute(ids, x, x, "l2", 4))


def test_graph_is_exact_with_a_long_list_and_passes_through_masked_nodes():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 8))
    for metric in ("l2", "cosine", "dot", "l1"):
        g = Graph(x, np.arange(600), metric, 8, 60).build()
        assert g.reached().all() and g.unreachable == 0 and all((n[:, :1] != -1).all() for n in g.links[:1])
        again = Graph.unpack(x, g.pack(), metric)
        queries = rng.normal(size=(4, 8))
        for q, found, packed in zip(queries, g.search(queries, 10, 600), again.search(queries, 10, 600)):
            want = [i for i, _ in brute(np.arange(600), x, [q], metric, 10)[0]]
            assert found.tolist() == packed.tolist() == want
            hidden = np.zeros(600, bool)
            hidden[want[:5]] = True
            assert g.search(q[None], 5, 600, hidden)[0].tolist() == want[5:]


def test_unreachable_nodes_are_counted_and_linked():
    g = Graph(np.random.default_rng(1).normal(size=(300, 6)), np.arange(300), "l2", 8, 60).build()
    g.links[0][g.links[0] == 7] = -1
    assert not g.reached()[7] and g.repair() == 1 and g.reached().all() and g.unreachable == 0


def test_recall_over_several_shards_with_a_real_list(spark):
    from vecloom.operators.approximate import build_graph, search_codes, search_graph, sq8_bytes, train_sq8
    from vecloom.sources.texmex import generate

    rows = generate(spark, 24_000, 32, clusters=200).repartition(8).cache()
    q = rows.where("id % 400 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    best = exact.scan(rows, q, 10).cache()
    lo, scale = train_sq8(rows, 24_000, 32)
    graph = build_graph(rows, "l2", 24_000, shard_rows=3000, sq8=(lo, scale)).withColumn("seg", F.lit(1)).cache()
    assert graph.count() >= 8 and graph.agg(F.sum("n"), F.sum("unreachable")).first() == (24_000, 0)
    recall = lambda found: search.recall(best, found).first().recall
    assert recall(search_graph(graph, q, 10, "l2", 100)) >= 0.95
    assert recall(search_graph(graph, q, 10, "l2", 100, sq8=(lo, scale), oversampling=2.0)) >= 0.95
    codes = sq8_bytes(rows, lo, scale, "l2")
    assert recall(search_codes(codes, q, 10, "l2", lo, scale, True, 2.0)) >= 0.98
    assert recall(search_codes(codes, q, 10, "l2", lo, scale, False, 1.0)) >= 0.8
    # half of the rows are allowed: the walk passes through the others
    allowed = rows.where("id % 2 = 0")
    from vecloom.operators.approximate import graph_rows

    at = graph_rows(graph).where("id % 2 = 0").withColumn("seg", F.lit(1)).groupBy("seg", "shard").agg(F.collect_list("pos").alias("pos"))
    found = search_graph(graph, q, 10, "l2", 100, only=at)
    assert found.where("id % 2 = 1").count() == 0
    assert search.recall(exact.scan(allowed, q, 10), found).first().recall >= 0.95
    near = exact.scan(rows, q, 16384, "l2", 4.5)
    assert search.recall(near, search_graph(graph, q, 16384, "l2", 100, radius=4.5)).first().recall >= 0.95
    rows.unpersist(), best.unpersist(), graph.unpersist()


class World:
    """A journal as a dictionary beside the index under test."""

    def __init__(self, spark, root, metric, kind, **options):
        self.spark, self.path, self.version, self.live = spark, f"{root}/j", 0, {}
        self.c = Catalog(spark, str(root))
        self.write([(0, [0.0] * 8, True)])
        register(self.c, "w", self.path, "id", "vec", "del", "ver", metric, 0, kind)
        set_options(self.c, "w", **options)
        self.metric = metric

    def write(self, rows):
        out = []
        for i, v, gone in rows:
            self.version += 1
            out.append((i, v, gone, self.version))
            self.live.pop(i, None)
            if not gone:
                self.live[i] = np.array(v, np.float32).astype(float)
        self.spark.createDataFrame(out, "id long, vec array<double>, del boolean, ver long").coalesce(1).write.mode("append").parquet(self.path)

    def want(self, q, k):
        ids = np.array(sorted(self.live))
        return brute(ids, np.array([self.live[i] for i in ids]), q, self.metric, k)


@pytest.mark.parametrize("metric,kind,options", [("l2", "flat", {}), ("cosine", "hnsw", {"m": 8, "ef_construction": 50}), ("dot", "flat", {"quantization": "sq8"}), ("cosine", "hnsw", {"m": 8, "quantization": "sq8"})])
def test_random_changes_and_refreshes(spark, tmp_path, metric, kind, options):
    rng = np.random.default_rng(7)
    w = World(spark, tmp_path, metric, kind, **options)
    row = lambda i: (int(i), rng.normal(size=8).tolist(), False)
    w.write([row(i) for i in range(120)])
    assert refresh(w.c, "w").startswith("full (first build): 120 vectors")
    q = rng.normal(size=(4, 8))
    for n in range(2):
        w.write([row(i) for i in rng.choice(200, 15, False)] + [(int(i), None, True) for i in rng.choice(200, 8, False)])
        same(got(search.search(w.c, "w", asked(spark, q), k=6, precision="exact")), w.want(q, 6))
        same(got(search.search(w.c, "w", asked(spark, q), k=6, ef_search=1000, oversampling=100.0)), w.want(q, 6))
        note = refresh(w.c, "w")
        assert note.startswith("incremental" if n == 0 else ("incremental", "full"))
        assert {r.id for r in w.c.live(w.c.get("w")).collect()} == {*w.live}
        same(got(search.search(w.c, "w", asked(spark, q), k=6, ef_search=1000, oversampling=100.0, freshness="snapshot")), w.want(q, 6))
    before = w.c.get("w").active_snapshot
    w.write([(i, w.live[i].tolist(), False) for i in sorted(w.live)[:5]] + [(777, None, True)])
    assert "0 appended, 0 tombstoned, 5 unchanged, 1 absent" in refresh(w.c, "w", "incremental") and w.c.get("w").active_snapshot == before
    allow = spark.createDataFrame([(i,) for i in sorted(w.live)[::3]] + [(99999,), (None,)], "id long")
    keep = {i: v for i, v in w.live.items() if i in set(sorted(w.live)[::3])}
    ids = np.array(sorted(keep))
    same(got(search.search(w.c, "w", asked(spark, q), allow=allow, k=5)), brute(ids, np.array([keep[i] for i in ids]), q, metric, 5))
    assert search.search(w.c, "w", asked(spark, q), allow=allow.limit(0), k=5).collect() == []
    left = asked(spark, q).withColumnRenamed("qvec", "v").unionByName(spark.createDataFrame([(9, None)], "qid long, v array<double>"))
    j = search.knn_join(w.c, "w", left, "v", 2, precision="exact")
    assert j.count() == 8 and j.columns == ["qid", "v", "id", "score", "rank"]


def test_full_build_triggers_and_verification(spark, tmp_path):
    w = World(spark, tmp_path, "l2", "flat")
    w.write([(i, [float(i)] * 8, False) for i in range(30)])
    refresh(w.c, "w")
    assert refresh(w.c, "w").startswith("incremental: 0 appended")
    assert refresh(w.c, "w", "full").startswith("full (mode full)")
    set_options(w.c, "w", quantization="sq8")
    assert "built with" in refresh(w.c, "w")
    w.write([(i, None, True) for i in range(10)])
    set_options(w.c, "w", tombstone_ratio=0.2)
    assert refresh(w.c, "w").startswith("incremental: 0 appended, 10 tombstoned")
    assert "positions are dead" in refresh(w.c, "w")
    set_options(w.c, "w", rebuild_every=1)
    w.write([(50, [1.0] * 8, False)])
    refresh(w.c, "w")
    assert "rebuild_every is 1" in refresh(w.c, "w")
    m = w.c.get("w")
    m.journal_digest = "1"
    w.c.put(m)
    set_options(w.c, "w", verify_every=0, rebuild_every=0)
    assert "not verified" in refresh(w.c, "w")
    set_options(w.c, "w", verify_every=1)
    assert "other digest" in refresh(w.c, "w")
    owner = w.c.lock(w.c.get("w"))
    with pytest.raises(RuntimeError, match="another refresh is running"):
        refresh(w.c, "w")
    w.c.unlock(w.c.get("w"), "somebody else")
    assert w.c._held(f"{w.c.root}/catalog/w.lock")["by"] == owner
    w.c.unlock(w.c.get("w"), owner)
    w.c._create(f"{w.c.root}/catalog/w.lock", '{"by": "gone", "at": 1}')  # stale: taken over
    owner = w.c.lock(w.c.get("w"))
    assert w.c._held(f"{w.c.root}/catalog/w.lock")["by"] == owner
    w.c.unlock(w.c.get("w"), owner)
    assert all(r.fine for r in verify(w.c, "w").collect())
    m = w.c.get("w")
    good, m.checksums = m.checksums, {k: "0" for k in m.checksums}
    w.c.put(m)
    assert not verify(w.c, "w").where("what = 'checksum'").first().fine and w.c.names() == ["w"] and admin.warm(w.c)["broken"] == 1
    m.checksums = good
    w.c.put(m)
    assert {r.level for r in admin.status(w.c, "w").collect()} <= {"notice", "warning"}
    assert admin.info(w.c).first().vector_count == len(w.live) and admin.warm(w.c)["fine"] == 1
    unregister(w.c, "w")
    with pytest.raises(ValueError, match="index w is not registered"):
        refresh(w.c, "w")


def test_a_version_from_the_future_stays_in_the_delta(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    rows = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.0, 1.0], 100), (3, [5.0, 5.0], 10**9)], "id long, vec array<double>, s long")
    rows.select("id", "vec", F.timestamp_seconds(F.unix_timestamp() - 10_000 + F.col("s")).alias("ver")).write.parquet(f"{tmp_path}/j")
    register(c, "t", f"{tmp_path}/j", "id", "vec", None, "ver", "l2", 60, "flat")
    assert ": 2 vectors" in refresh(c, "t") and c.delta(c.get("t")).count() == 1
    assert admin.status(c, "t").where("level = 'warning' and message like '%version in the future%'").count() == 1
    q = spark.createDataFrame([(1, [5.0, 5.0])], "qid long, qvec array<double>")
    assert search.search(c, "t", q, k=1).first().id == 3 and search.search(c, "t", q, k=1, freshness="snapshot").first().id == 2
    unregister(c, "t")


def test_generated_rows_depend_on_seed_and_row_alone(spark):
    from vecloom.sources.texmex import generate

    whole = {r.id: r.vec for r in generate(spark, 700, 4, clusters=5).collect()}
    part = {r.id: r.vec for r in generate(spark, 300, 4, clusters=5, first=200).repartition(3).collect()}
    assert part == {i: whole[i] for i in range(200, 500)}
    assert whole[0] != generate(spark, 1, 4, clusters=5, queries=True).first().vec


def test_registration_checks(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    spark.createDataFrame([(1, [1.0], "x", 1)], "id long, vec array<double>, s string, ver long").write.parquet(f"{tmp_path}/t")
    t = f"{tmp_path}/t"
    for args, why in [
        (("bad name", t, "id", "vec"), "index name must be"), (("a", t, "id", "no"), "column no does not exist"), (("a", t, "s", "vec"), "id_col s must be INT"), (("a", t, "id", "s"), "vec_col s must be ARRAY"),
        (("a", t, "id", "vec", "s"), "op_col needs ver_col"), (("a", t, "id", "vec", None, "ver"), "explicit margin"), (("a", t, "id", "vec", None, "ver", "l2", -1), "margin must not be negative"), (("a", t, "id", "vec", None, None, "x"), "metric must be"),
    ]:
        with pytest.raises(ValueError, match=why):
            register(c, *args)
    register(c, "a", t, "id", "vec", index_type="flat")
    with pytest.raises(ValueError, match="already registered"):
        register(c, "a", t, "id", "vec")
    for option, why in [({"m": 1}, "m must be 2 to 256"), ({"memory_mode": "compact"}, "needs quantization sq8"), ({"tombstone_ratio": 0}, "above 0"), ({"nope": 1}, "no option")]:
        with pytest.raises(ValueError, match=why):
            set_options(c, "a", **option)


def test_settings_precedence_and_presets(spark):
    spark.conf.set("vecloom.ef_search", "77")
    try:
        assert resolve(parameters(spark, {"ef_search": 5}, {"ef_search": 9}), 8).ef == 5
        assert resolve(parameters(spark, {}, {"ef_search": 9}), 8).ef == 77
        spark.conf.set("vecloom.ef_search", "many")
        with pytest.raises(ValueError, match="session parameter ef_search = 'many' is not an integer"):
            resolve(parameters(spark), 8)
    finally:
        spark.conf.unset("vecloom.ef_search")
    s = lambda **p: resolve(parameters(None, p), 8)
    assert (s(precision="fast", k=20).ef, s(precision="fast").rescore, s().ef, s(precision="best").ef, s(precision="best").oversampling) == (40, False, 100, 400, 4.0)
    assert resolve({}, 512).oversampling == 4.0 and resolve({}, 511).oversampling == 2.0
    for p, why in [({"k": 16385}, "k must be"), ({"precision": "x"}, "precision must be"), ({"oversampling": 0.5}, "oversampling must be"), ({"threads": 65}, "threads must be"), ({"freshness": "x"}, "freshness must be")]:
        with pytest.raises(ValueError, match=why):
            s(**p)
    assert filter_exact_limit(100, 1_000_000) == 80_000 and filter_exact_limit(100, 1000) == 10_000


def test_sizing_examples():
    e = estimate(10_000_000, 768, "hnsw")
    assert [round(x, 1) for x in e.values()] == [29296.9, 76.3, 1349.8, 0.0, 30722.9]
    e = estimate(2_000_000, 1536, "flat", "sq8")
    assert [round(x, 1) for x in e.values()] == [11718.8, 15.3, 0.0, 2937.3, 14671.3]


def test_queries_and_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["qid", "id", "score", "rank"]
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 75
    assert q["recall_report"](spark, "/root/testdata/sf0.001").agg(F.min("recall")).first()[0] >= 0.9


def test_near_duplicates_take_every_row_as_a_query(spark, data):
    from vecloom.operators import recipes
    from vecloom.queries import QUERIES

    ids, x, _ = data
    near = brute(ids, x, x, "cosine", 2)
    want = {(q, i) for q, v in near.items() for i, s in v if s >= 0.3 and q < i}
    assert {(r.qid, r.id) for r in recipes.all_near_duplicates(table(spark, ids, x), 0.3).collect()} == want
    assert sum(q % 50 != 0 for q, _ in want) > 50
    found = QUERIES["recipe_near_duplicates_all"](spark, "/root/testdata/sf0.1").select("qid", "id").collect()
    assert len(found) == 990 and len(set(found)) == 990
