"""Searches by graph return what a comparison of all rows returns."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_search import asked, got, same, table

from vecloom.operators import exact
from vecloom.operators.approximate import build_graph, graph_rows, search_graph, train_sq8, visits
from vecloom.operators.workers import Graph


@pytest.fixture(scope="module")
def world(spark):
    """2,000 rows without clusters in 20 shards or more, and queries."""
    x = np.random.default_rng(11).normal(size=(2000, 24)).astype(np.float32)
    rows = table(spark, np.arange(2000), x).repartition(4).cache()
    out = {"rows": rows, "q": asked(spark, x[::100].astype(float)), "x": x}
    for metric in ("l2", "cosine"):
        unit = table(spark, np.arange(2000), x / np.linalg.norm(x, axis=1, keepdims=True)) if metric == "cosine" else rows
        out["sq8", metric] = train_sq8(unit, 2000, 24)
        out[metric] = build_graph(rows, metric, 2000, 4, 20, shard_rows=100, sq8=out["sq8", metric]).withColumn("seg", F.lit(1)).cache()
    yield out
    for metric in ("l2", "cosine"):
        out[metric].unpersist()
    rows.unpersist()


def positions(world, metric, condition):
    return graph_rows(world[metric]).where(condition).groupBy(F.lit(1).alias("seg"), "shard").agg(F.collect_list("pos").alias("pos"))


def test_no_shard_is_left_out_and_dead_rows_count_for_nothing(spark, world):
    assert world["l2"].count() > 12
    live = world["rows"].where("id % 4 = 0")
    found = search_graph(world["l2"], world["q"], 10, "l2", 20, hidden=positions(world, "l2", "id % 4 <> 0"))
    same(got(found), got(exact.scan(live, world["q"], 10)))
    balls = world["l2"].select("seg", "shard", "n", "centre", "reach").collect()
    asked_of = sum(len(v) for v in visits(balls, world["x"][:1].astype(float), "l2", 10, 20, None).values())
    assert 8 < asked_of <= len(balls)


@pytest.mark.parametrize("segments", [1, 2])
def test_several_segments_give_the_exact_neighbours(spark, world, segments):
    """what an incremental refresh leaves is several segments of graphs."""
    parts = [world["rows"].where(f"id % {segments} = {i}") for i in range(segments)]
    graph = None
    for i, part in enumerate(parts):
        g = build_graph(part, "l2", 2000 // segments, 4, 20, shard_rows=100).withColumn("seg", F.lit(i))
        graph = g if graph is None else graph.unionByName(g)
    same(got(search_graph(graph, world["q"], 10, "l2", 20)), got(exact.scan(world["rows"], world["q"], 10)))


def test_balanced_walks_are_completed(spark, world):
    """F5"""
    same(got(search_graph(world["l2"], world["q"], 10, "l2", 4)), got(exact.scan(world["rows"], world["q"], 10)))


def test_cosine_walks_are_completed(spark, world):
    """F6"""
    same(got(search_graph(world["cosine"], world["q"], 10, "cosine", 20)), got(exact.scan(world["rows"], world["q"], 10, "cosine")))


def test_walks_past_masked_rows_are_completed(spark, world):
    """F7"""
    found = search_graph(world["l2"], world["q"], 10, "l2", 4, only=positions(world, "l2", "id % 3 <> 0"))
    same(got(found), got(exact.scan(world["rows"].where("id % 3 <> 0"), world["q"], 10)))


def test_walks_within_a_radius_are_completed(spark, world):
    """F8"""
    found = search_graph(world["l2"], world["q"], 16384, "l2", 20, radius=6.0)
    same(got(found), got(exact.scan(world["rows"], world["q"], 16384, "l2", 6.0)))


def test_walks_over_codes_are_completed_from_the_vectors(spark, world):
    """F9"""
    found = search_graph(world["cosine"], world["q"], 10, "cosine", 20, sq8=world["sq8", "cosine"], oversampling=1.0)
    same(got(found), got(exact.scan(world["rows"], world["q"], 10, "cosine")))


def test_a_list_longer_than_a_shard_compares_its_rows_and_walks_nowhere(spark, world, monkeypatch):
    """F1"""
    monkeypatch.setattr(Graph, "search", lambda *a, **b: 1 / 0)
    same(got(search_graph(world["l2"], world["q"], 10, "l2", 100_000)), got(exact.scan(world["rows"], world["q"], 10)))
