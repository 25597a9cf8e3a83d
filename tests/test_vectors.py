"""Vector functions, aggregates, text and files: literals, NULLs, errors, random pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from vecloom.functions import aggregates, vectors
from vecloom.sources import texmex
from vecloom.sources.text import VectorTextError, parse_queries, parse_vector


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def vec(*x):
    return F.lit(list(map(float, x))) if x else F.array().cast("array<double>")


def test_literals(spark):
    a, b = vec(1, 2, 3), vec(4, 5, 7)
    assert one(spark, vectors.vector_add(a, b)) == [5, 7, 10]
    assert one(spark, vectors.vector_sub(a, b)) == [-3, -3, -4]
    assert one(spark, vectors.vector_mul(a, b)) == [4, 10, 21]
    assert one(spark, vectors.scalar_vector_mul(F.lit(2), a)) == [2, 4, 6]
    assert one(spark, vectors.vector_normalize(vec(3, 4))) == [0.6, 0.8]
    assert one(spark, vectors.vector_normalize(vec(0, 0))) == [0, 0]
    assert one(spark, vectors.vector_l1(a, b)) == 10 and one(spark, vectors.vector_l2sq(a, b)) == 34
    longs = lambda *x: F.lit(list(x)).cast("array<bigint>")
    assert one(spark, vectors.vector_hamming(longs(-1, 15), longs(0, 255))) == 68
    assert one(spark, vectors.vector_jaccard(longs(1, 1, 0), longs(1, 0, 0))) == 0.5
    assert one(spark, vectors.vector_jaccard(longs(0, 0), longs(0, 0))) == 1.0
    assert one(spark, vectors.cosine_similarity(vec(0, 0), vec(1, 0))) == 0.0
    assert one(spark, vectors.vector_add(vec(), vec())) == [] and one(spark, vectors.vector_l1(vec(), vec())) == 0 and one(spark, vectors.vector_magnitude(vec())) == 0


def test_nulls(spark):
    null, hole = F.lit(None).cast("array<double>"), F.array(F.lit(1.0), F.lit(None).cast("double"))
    for f in (vectors.vector_add, vectors.vector_l1, vectors.l2_distance, vectors.cosine_similarity):
        assert one(spark, f(null, vec(1, 2))) is None and one(spark, f(vec(1, 2), null)) is None
    assert one(spark, vectors.scalar_vector_mul(F.lit(None), vec(1))) is None
    assert one(spark, vectors.l2_distance(hole, vec(1, 2))) is None and one(spark, vectors.vector_magnitude(hole)) is None
    with pytest.raises(PySparkException, match="vector_l2sq: element 2 of the first vector is NULL"):
        one(spark, vectors.vector_l2sq(hole, vec(1, 2)))
    with pytest.raises(PySparkException, match="vector_add: element 2 of the second vector is NULL"):
        one(spark, vectors.vector_add(vec(1, 2), hole))


@pytest.mark.parametrize("f", [vectors.vector_add, vectors.vector_l2sq, vectors.dot_product])
def test_lengths_differ(spark, f):
    with pytest.raises(PySparkException, match="the vectors have different lengths: 2 and 3 elements"):
        one(spark, f(vec(1, 2), vec(1, 2, 3)))


def test_random_pairs_and_sql_functions(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(200, 16)), rng.normal(size=(200, 16))
    df = spark.createDataFrame([(i, x.tolist(), y.tolist()) for i, (x, y) in enumerate(zip(a, b))], "id long, a array<double>, b array<double>")
    vectors.register_sql(spark)
    df.createOrReplaceTempView("pairs")
    sql = {r.id: r for r in spark.sql("SELECT id, vector_l1(a, b) AS l1, vector_l2sq(a, b) AS l2, vector_normalize(a) AS n, vector_sub(a, b) AS d, scalar_vector_mul(2, a) AS s FROM pairs").collect()}
    got = df.select("id", vectors.vector_l1("a", "b").alias("l1"), vectors.vector_l2sq("a", "b").alias("l2"), vectors.cosine_similarity("a", "b").alias("c")).collect()
    for r in got:
        x, y = a[r.id], b[r.id]
        assert math.isclose(r.l1, np.abs(x - y).sum(), rel_tol=1e-12) and math.isclose(r.l2, ((x - y) ** 2).sum(), rel_tol=1e-12)
        assert math.isclose(r.c, x @ y / np.linalg.norm(x) / np.linalg.norm(y), rel_tol=1e-10)
        assert (sql[r.id].l1, sql[r.id].l2) == (r.l1, r.l2) and np.allclose(sql[r.id].n, x / np.linalg.norm(x)) and np.allclose(sql[r.id].d, x - y)
    with pytest.raises(PySparkException, match="vector_add: the vectors have different lengths: 1 and 2"):
        spark.sql("SELECT vector_add(array(1D), array(1D, 2D))").collect()


def test_sum_and_average(spark):
    df = spark.createDataFrame([("acme", [0.0, 1.0]), ("acme", [2.0, 4.0]), ("acme", None), ("none", None), (None, [1.0, 1.0])], "g string, vec array<double>")
    assert {r.g: r.vector_sum for r in aggregates.vector_sum(df, by=["g"]).collect()} == {"acme": [2, 5], "none": None, None: [1, 1]}
    assert {r.g: r.vector_avg for r in aggregates.vector_avg(df, by=["g"]).collect()} == {"acme": [1, 2.5], "none": None, None: [1, 1]}
    assert aggregates.vector_sum(df).first()[0] == [3, 6]
    with pytest.raises(PySparkException, match="different lengths: 1 and 2"):
        aggregates.vector_sum(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "vec array<double>")).collect()


@pytest.mark.parametrize("text,want", [("[1, 2]", [1, 2]), (" [ -1.5e1,+.5 , 2. ]\n", [-15, 0.5, 2])])
def test_vector_text(text, want):
    assert parse_vector(text) == want


@pytest.mark.parametrize(
    "text,why", [("", "expected '[' at character 1"), ("[]", "the list is empty at character 2"), ("[1 2]", "expected ',' or ']' at character 4"), ("[1,nan]", "expected a number at character 4"), ("[1e99]", "not a finite float32 value at character 2"), ("[1] x", "unexpected text after ']' at character 5"), ("[1", "expected ',' or ']' at character 3")]
)
def test_vector_text_errors(text, why):
    with pytest.raises(VectorTextError) as e:
        parse_vector(text)
    assert why in str(e.value)


def test_queries_text():
    assert parse_queries(queries="[1,2]; ;[3,4];") == [(1, [1, 2]), (2, [3, 4])] and parse_queries("[5]") == [(0, [5])]
    with pytest.raises(ValueError, match="a query is required"):
        parse_queries()
    with pytest.raises(ValueError, match="query 2 has 1 elements, the first has 2"):
        parse_queries(queries="[1,2];[3]")


def test_vector_files(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(5)]) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, vec array<float>")
    path = str(tmp_path / "x.fvecs")
    assert texmex.write_vectors(df, path) == 50 and texmex.info(spark, path) == (50, 5)
    back = {r.id: r.vec for r in texmex.read_vectors(spark, path, rows_per_task=7).collect()}
    assert back == {r.id: r.vec for r in df.collect()}
    part = texmex.read_vectors(spark, path, first=10, limit=5, id_base=100).collect()
    assert sorted(r.id for r in part) == [110, 111, 112, 113, 114]
    texmex.write_vectors(spark.createDataFrame([(0, [3, 1, 2]), (1, [0, 5, 4])], "id long, vec array<int>"), str(tmp_path / "g.ivecs"))
    gt = texmex.read_ground_truth(spark, str(tmp_path / "g.ivecs"), 2)
    assert sorted(map(tuple, gt.collect())) == [(0, 1, 3), (0, 2, 1), (1, 1, 0), (1, 2, 5)]
    out = texmex.load_dataset(spark, f"file://{tmp_path}/t", "d", path, path, str(tmp_path / "g.ivecs"))
    assert spark.read.parquet(out["base"]).columns == ["id", "vec", "del", "ts"] and spark.read.parquet(out["gt"]).count() == 6


def test_generated_rows_depend_on_seed_and_row_alone(spark):
    a = {r.id: r.vec for r in texmex.generate(spark, 40, 8, 7).collect()}
    b = {r.id: r.vec for r in texmex.generate(spark, 20, 8, 7).repartition(3).collect()}
    assert all(a[i] == b[i] for i in b) and a[0] != texmex.generate(spark, 1, 8, 8).first().vec
