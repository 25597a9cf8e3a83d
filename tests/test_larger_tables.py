"""Exact searches and joins of larger tables: the same rows by less work."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_search import asked, brute, got, same, scores, table

from vecloom.operators import exact, recipes
from vecloom.operators.approximate import search_codes, sq8_bytes
from vecloom.operators.workers import sq8_pack, sq8_unpack


@pytest.mark.parametrize("metric,threshold", [("cosine", 0.5), ("l2", 2.0), ("l1", 5.0), ("dot", 6.0)])
def test_theta_join_has_every_pair_and_no_limit_of_partners(spark, monkeypatch, metric, threshold):
    """F3"""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 6))
    x[100:140] = x[0]  # more partners than the blocks' share
    x[7] = 0
    monkeypatch.setattr(recipes, "JOIN_ELEMENTS", 300)  # six blocks
    found = [(r.a, r.b, r.score) for r in recipes.theta_join(table(spark, np.arange(300), x).repartition(3), threshold, metric).collect()]
    sign = 1 if metric in ("l2", "l1") else -1
    want = {(a, b) for a in range(300) for b, s in enumerate(scores(x, x[a], metric)) if a < b and sign * s <= sign * threshold}
    assert len(found) == len(want) and {(a, b) for a, b, _ in found} == want
    assert all(np.isclose(s, scores(x[b : b + 1], x[a], metric)[0]) for a, b, s in found)


def test_theta_join_passes_16384_partners(spark):
    """an id with so many was an error."""
    x = np.zeros((16_500, 2))
    x[:, 0], x[100:, 1] = 1, np.arange(16_400) * 1e-9
    x[:100, 0] = -1  # no partners of the others
    rows = table(spark, np.arange(16_500), x).where("id >= 100 or id < 2")
    near = recipes.theta_join(rows, 0.99)
    assert near.where("a = 100").count() == 16_399 and near.where("a < 100").count() == 1


@pytest.mark.parametrize("metric", ["l2", "l1", "cosine", "dot"])
@pytest.mark.parametrize("columns", [100, 4])
def test_catalyst_scan_sorts_few_pairs(spark, monkeypatch, metric, columns):
    """by columns and by arrays, with ties at the bound, a zero row, NULL elements and NaN."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(2000, 8))
    x[500:900] = x[5]
    x[60] = 0
    q = np.vstack([rng.normal(size=(4, 8)), x[5], np.zeros(8)])
    monkeypatch.setattr(exact, "MOST_COLUMNS", columns)
    odd = spark.createDataFrame([(5000, [None] * 8), (5001, [float("nan")] * 8), (None, [0.0] * 8), (5002, None)], "id long, vec array<double>")
    rows = table(spark, np.arange(2000), x).unionByName(odd).repartition(3)
    for k, radius in ((3, None), (40, None), (5, 1.0)):
        found = exact.scan_sql(rows, asked(spark, q), k, metric, radius)
        same(got(found), brute(np.arange(2000), x, q, metric, k, radius))
    assert "aggregate(" not in found._jdf.queryExecution().executedPlan().toString().split("BroadcastNestedLoopJoin")[1].split("\n")[0] or columns == 4


@pytest.mark.parametrize("metric", ["l2", "l1", "cosine", "dot"])
def test_searches_over_codes_are_completed(spark, metric):
    """many rows as close as their codes can tell, copies, elements far outside of the range of the codes."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 8)).astype(np.float32)
    x[200:260] = x[0] + rng.normal(size=(60, 8)).astype(np.float32) * 1e-4
    x[300:340] = x[1]
    x[rng.integers(0, 1500, 40), rng.integers(0, 8, 40)] = 30.0
    rows, q = table(spark, np.arange(1500), x).repartition(3), x[:8].astype(float)
    coded = sq8_bytes(rows, -3.0, np.float32(6 / 255).item(), metric)
    found = search_codes(coded, asked(spark, q), 10, metric, -3.0, np.float32(6 / 255).item(), True, 1.0)
    same(got(found), got(exact.scan(rows, asked(spark, q), 10, metric)))
    bare = coded.withColumn("code", F.substring("code", 9, 8))  # as older files have it
    same(got(search_codes(bare, asked(spark, q), 10, metric, -3.0, np.float32(6 / 255).item(), True, 1.0)), got(found))


def test_scores_of_codes_are_off_by_what_the_codes_miss_at_most(spark):
    """queries aren't coded, and elements outside of the range of the codes are kept."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 8)).astype(np.float32)
    x[::7, 2] = 9.0
    scale = np.float32(4 / 255).item()
    found = search_codes(sq8_bytes(table(spark, np.arange(500), x), -2.0, scale, "l2"), asked(spark, x[:20].astype(float)), 10, "l2", -2.0, scale, False)
    most = 8**0.5 * scale / 2 * 1.01
    assert all(abs(r.score - np.linalg.norm(x[r.id].astype(float) - x[r.qid])) <= most for r in found.collect()) and found.count() == 200
    got_, miss = sq8_unpack(pa.array(sq8_pack(x, -2.0, scale)), 8, -2.0, scale)
    assert (np.linalg.norm(got_ - x, axis=1) <= miss).all() and (got_[::7, 2] == 9).all() and miss.max() <= most
