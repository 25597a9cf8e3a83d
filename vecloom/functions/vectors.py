"""Element-wise arithmetic, distances and bit similarity of vectors; all NULL-strict, double precision, index order.

A NULL vector gives NULL.  A NULL element or vectors of different lengths are errors that name the function.  Every
builder is a Catalyst expression: it runs in the JVM, below filters and joins like any other column.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def doubles(v) -> Column:
    return _col(v).cast("array<double>")


def fold(a: Column, zero: str = "double") -> Column:
    """Sum in index order."""
    return F.aggregate(a, F.lit(0).cast(zero), lambda s, x: s + x)


def _null_at(v: Column) -> Column:
    return F.array_position(F.transform(v, lambda x: x.isNull()), True)


def _guard(fn: str, body: Column, a: Column, b: Column | None = None) -> Column:
    """body behind the checks of fn; NULL arguments win over errors."""
    which = "" if b is None else "first "
    bad = F.when(
        F.exists(a, lambda x: x.isNull()), F.raise_error(F.concat(F.lit(f"{fn}: element "), _null_at(a).cast("string"), F.lit(f" of the {which}vector is NULL")))
    )
    if b is None:
        return F.when(a.isNotNull(), bad.otherwise(body))
    lengths = F.concat(F.lit(f"{fn}: the vectors have different lengths: "), F.size(a).cast("string"), F.lit(" and "), F.size(b).cast("string"), F.lit(" elements"))
    bad = bad.when(F.exists(b, lambda x: x.isNull()), F.raise_error(F.concat(F.lit(f"{fn}: element "), _null_at(b).cast("string"), F.lit(" of the second vector is NULL"))))
    bad = bad.when(F.size(a) != F.size(b), F.raise_error(lengths))
    return F.when(a.isNotNull() & b.isNotNull(), bad.otherwise(body))


def vector_add(a, b) -> Column:
    a, b = doubles(a), doubles(b)
    return _guard("vector_add", F.zip_with(a, b, lambda x, y: x + y), a, b)


def vector_sub(a, b) -> Column:
    a, b = doubles(a), doubles(b)
    return _guard("vector_sub", F.zip_with(a, b, lambda x, y: x - y), a, b)


def vector_mul(a, b) -> Column:
    a, b = doubles(a), doubles(b)
    return _guard("vector_mul", F.zip_with(a, b, lambda x, y: x * y), a, b)


def scalar_vector_mul(s, a) -> Column:
    s, a = _col(s).cast("double"), doubles(a)
    return F.when(s.isNotNull(), _guard("scalar_vector_mul", F.transform(a, lambda x: s * x), a))


def vector_normalize(a) -> Column:
    """Unit length; a zero vector stays zero."""
    a = doubles(a)
    n = F.sqrt(fold(F.transform(a, lambda x: x * x)))
    return _guard("vector_normalize", F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a), a)


def vector_l1(a, b) -> Column:
    a, b = doubles(a), doubles(b)
    return _guard("vector_l1", fold(F.zip_with(a, b, lambda x, y: F.abs(x - y))), a, b)


def vector_l2sq(a, b) -> Column:
    a, b = doubles(a), doubles(b)
    return _guard("vector_l2sq", fold(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))), a, b)


def vector_hamming(a, b) -> Column:
    """Differing bits of two array<bigint>: elements 0/1 or 64 packed bits."""
    a, b = _col(a).cast("array<bigint>"), _col(b).cast("array<bigint>")
    bits = F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long"))
    return _guard("vector_hamming", fold(bits, "long"), a, b)


def vector_jaccard(a, b) -> Column:
    """Common bits over bits in either; 1 if there are none."""
    a, b = _col(a).cast("array<bigint>"), _col(b).cast("array<bigint>")
    both = fold(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y)).cast("long")), "long")
    either = fold(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseOR(y)).cast("long")), "long")
    return _guard("vector_jaccard", F.when(either == 0, F.lit(1.0)).otherwise(both / F.nullif(either, F.lit(0).cast("long"))), a, b)


# Built-ins of the host: NULL for a NULL vector or a NULL element, an error for different lengths.


def _known(a: Column) -> Column:
    return a.isNotNull() & F.forall(a, lambda x: x.isNotNull())


def _host(fn: str, body: Column, a: Column, b: Column) -> Column:
    lengths = F.concat(F.lit(f"{fn}: the vectors have different lengths: "), F.size(a).cast("string"), F.lit(" and "), F.size(b).cast("string"), F.lit(" elements"))
    return F.when(_known(a) & _known(b), F.when(F.size(a) != F.size(b), F.raise_error(lengths)).otherwise(body))


def l2_distance(a, b) -> Column:
    a, b = doubles(a), doubles(b)
    return _host("VECTOR_L2", F.sqrt(fold(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))), a, b)


def l1_distance(a, b) -> Column:
    a, b = doubles(a), doubles(b)
    return _host("VECTOR_L1", fold(F.zip_with(a, b, lambda x, y: F.abs(x - y))), a, b)


def dot_product(a, b) -> Column:
    a, b = doubles(a), doubles(b)
    return _host("DOT_PRODUCT", fold(F.zip_with(a, b, lambda x, y: x * y)), a, b)


def vector_magnitude(a) -> Column:
    a = doubles(a)
    return F.when(_known(a), F.sqrt(fold(F.transform(a, lambda x: x * x))))


def cosine_similarity(a, b) -> Column:
    """0 if either vector is zero."""
    a, b = doubles(a), doubles(b)
    norms = F.sqrt(fold(F.transform(a, lambda x: x * x))) * F.sqrt(fold(F.transform(b, lambda x: x * x)))
    dot = fold(F.zip_with(a, b, lambda x, y: x * y))
    return _host("COSINE_SIMILARITY", F.when(norms > 0, dot / F.nullif(norms, F.lit(0.0))).otherwise(F.lit(0.0)), a, b)


def apply_sum(a) -> Column:
    return fold(doubles(a))


def array_length(a) -> Column:
    return F.when(_col(a).isNotNull(), F.size(_col(a))).cast("long")


#: metric -> (score expression of two vectors, does a smaller score mean closer)
METRICS = {"l2": (l2_distance, True), "l1": (l1_distance, True), "cosine": (cosine_similarity, False), "dot": (dot_product, False)}


def check_metric(metric: str) -> None:
    if metric not in METRICS:
        raise ValueError(f"metric must be l2, cosine, dot or l1, not '{metric}'")


def finite_vector(v, what: str = "vector") -> Column:
    """v as array<float>; a NULL element or one that is not a finite float32 is an error."""
    d = doubles(v)
    ok = F.forall(d, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= 3.4028234663852886e38))
    return F.when(d.isNotNull(), F.when(ok, d.cast("array<float>")).otherwise(F.raise_error(F.lit(f"{what}: an element is NULL or not a finite float32 value")).cast("array<float>")))


#: Bodies for SQL users; {f} is the function's name.
_PAIR = "CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN exists(a, x -> x IS NULL) THEN raise_error('{f}: element ' || array_position(transform(a, x -> x IS NULL), true) || ' of the first vector is NULL') WHEN exists(b, x -> x IS NULL) THEN raise_error('{f}: element ' || array_position(transform(b, x -> x IS NULL), true) || ' of the second vector is NULL') WHEN size(a) <> size(b) THEN raise_error('{f}: the vectors have different lengths: ' || size(a) || ' and ' || size(b) || ' elements') ELSE {body} END"
_ONE = "CASE WHEN a IS NULL THEN NULL WHEN exists(a, x -> x IS NULL) THEN raise_error('{f}: element ' || array_position(transform(a, x -> x IS NULL), true) || ' of the vector is NULL') ELSE {body} END"
_D, _L = "ARRAY<DOUBLE>", "ARRAY<BIGINT>"
SQL_FUNCTIONS = {
    "vector_add": (f"a {_D}, b {_D}", _D, _PAIR, "zip_with(a, b, (x, y) -> x + y)"),
    "vector_sub": (f"a {_D}, b {_D}", _D, _PAIR, "zip_with(a, b, (x, y) -> x - y)"),
    "vector_mul": (f"a {_D}, b {_D}", _D, _PAIR, "zip_with(a, b, (x, y) -> x * y)"),
    "scalar_vector_mul": (f"s DOUBLE, a {_D}", _D, _ONE, "if(s IS NULL, NULL, transform(a, x -> s * x))"),
    "vector_normalize": (f"a {_D}", _D, _ONE, "transform(a, x -> coalesce(x / nullif(sqrt(aggregate(a, 0D, (t, y) -> t + y * y)), 0D), x))"),
    "vector_l1": (f"a {_D}, b {_D}", "DOUBLE", _PAIR, "aggregate(zip_with(a, b, (x, y) -> abs(x - y)), 0D, (t, x) -> t + x)"),
    "vector_l2sq": (f"a {_D}, b {_D}", "DOUBLE", _PAIR, "aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (t, x) -> t + x)"),
    "vector_hamming": (f"a {_L}, b {_L}", "BIGINT", _PAIR, "aggregate(zip_with(a, b, (x, y) -> CAST(bit_count(x ^ y) AS BIGINT)), 0L, (t, x) -> t + x)"),
    "vector_jaccard": (
        f"a {_L}, b {_L}", "DOUBLE", _PAIR,
        "coalesce(aggregate(zip_with(a, b, (x, y) -> CAST(bit_count(x & y) AS BIGINT)), 0L, (t, x) -> t + x) / nullif(aggregate(zip_with(a, b, (x, y) -> CAST(bit_count(x | y) AS BIGINT)), 0L, (t, x) -> t + x), 0L), 1D)",
    ),
}


def register_sql(spark: SparkSession) -> list[str]:
    """Make the nine functions callable from SQL in this session; their bodies are inlined into the plan."""
    for name, (args, kind, frame, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {frame.format(f=name, body=body)}")
    return [*SQL_FUNCTIONS]


#: metric -> SQL score of the column vec and the parameter query, and the order in which closer comes first.
_SCORES = {
    "l2": ("sqrt(vector_l2sq(vec, query))", "ASC"), "l1": ("vector_l1(vec, query)", "ASC"), "dot": ("aggregate(vector_mul(vec, query), 0D, (t, x) -> t + x)", "DESC"),
    "cosine": ("aggregate(vector_mul(vector_normalize(vec), vector_normalize(query)), 0D, (t, x) -> t + x)", "DESC"),
}


def register_view_functions(spark: SparkSession, view: str, metric: str = "l2") -> list[str]:
    """Table functions over a view with the columns id and vec (array<double>), callable from SQL in this session.

    <view>_knn(query, k): id, score, rank; <view>_within(query, radius): id, score; <view>_vector_sum() and
    <view>_vector_avg(): pos, value.  Their bodies are inlined, so the plans are those of the DataFrame functions: local
    and final group limits, sums that are combined on the map side.
    """
    check_metric(metric)
    register_sql(spark)
    score, order = _SCORES[metric]
    scored = f"(SELECT id, {score} AS score FROM {view} WHERE id IS NOT NULL AND vec IS NOT NULL)"
    cells = f"(SELECT posexplode(vec) AS (pos, x) FROM {view})"
    bodies = {
        "knn": ("query ARRAY<DOUBLE>, k INT", "id BIGINT, score DOUBLE, rank INT", f"SELECT id, score, rank FROM (SELECT id, score, row_number() OVER (ORDER BY score {order}, id) AS rank FROM {scored}) WHERE rank <= k"),
        "within": ("query ARRAY<DOUBLE>, radius DOUBLE", "id BIGINT, score DOUBLE", f"SELECT id, score FROM {scored} WHERE score {'<=' if order == 'ASC' else '>='} radius"),
        "vector_sum": ("", "pos INT, value DOUBLE", f"SELECT pos, sum(x) FROM {cells} GROUP BY pos"),
        "vector_avg": ("", "pos INT, value DOUBLE", f"SELECT pos, avg(x) FROM {cells} GROUP BY pos"),
    }
    for name, (args, table, body) in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {view}_{name}({args}) RETURNS TABLE({table}) RETURN {body}")
    return [f"{view}_{name}" for name in bodies]
