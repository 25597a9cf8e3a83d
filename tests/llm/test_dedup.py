"""SimHash, cover tree, components, line spread: against brute force on small tables with awkward rows."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vecloom.llm import cover_tree, line_spread, simhash
from vecloom.llm.components import components

DOCS = "doc_id long, text string, source string, extra string"


def roots(n, edges):
    up = list(range(n))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components_of_a_random_graph_a_star_and_a_path(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(300, 300 + k) for k in range(1, 80)] + [(400 + k, 401 + k) for k in range(60)]
    df = spark.createDataFrame([*edges, (None, 1), (5, 5), edges[0]], "u long, v long")
    got = {r.node: r.root for r in components(df).collect()}
    want = roots(500, edges)
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: want[x] for x in touched if want[x] != x}
    assert components(df.limit(0)).collect() == []


def plain_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [None, "", " \t\n", "A", "a b", "A b C", "the cat sat on the mat " * 40, "é漢  x y z w", "x" * 50_000])
def test_fingerprint_is_the_bitwise_majority(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_links_are_those_of_a_full_comparison(spark, radius):
    rng = random.Random(radius)
    fps = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(40):
            x = base
            for b in rng.sample(range(64), rng.choice([0, 1, 1, 2, 3])):
                x ^= 1 << b
            fps.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in sorted(fps)]
    got = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), radius, cap=8).collect()
    pairs = [(r.u, r.v) for r in got]
    want = {(min(a, b), max(a, b)) for i, a in enumerate(signed) for b in signed[:i] if bin((a ^ b) & (1 << 64) - 1).count("1") <= radius}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_simhash_components_with_nulls_copies_and_clashing_names(spark):
    rows = [(3, "One two THREE four", "a", "x"), (1, "one two three four", "a", "x"), (2, None, None, None), (4, "", "b", None), (None, "other words here now", "b", None), (3, "One two THREE four", "a", "x")]
    df = spark.createDataFrame(rows, DOCS).withColumnRenamed("extra", "fp")
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(True, 3, 1), (True, 1, 1), (True, 2, 2), (True, 4, 2), (False, 0, None), (True, 3, 1)], key=str)
    assert simhash.near_duplicates(df.limit(0)).collect() == []


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_cover_tree_equals_a_full_comparison(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(6, 16))
    x = np.vstack([centres[rng.integers(0, 6, 150)] + 0.12 * rng.normal(size=(150, 16)), rng.normal(size=(150, 16))])
    x = np.vstack([x, x[:20], 3 * x[5:8]]).astype(np.float32)
    ids = rng.permutation(len(x)).tolist()
    rows = [(i, v.tolist()) for i, v in zip(ids, x)]
    odd = [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] + [1.0] * 15), (1003, [1.0, 2.0]), (1004, [None] + [1.0] * 15), (1005, []), (None, x[0].tolist())]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumns({"h": F.lit("clash"), "node": F.lit(1), "dim": F.lit("x")})
    got = {r.vec_id: r for r in cover_tree.near_duplicates(df, block=64).collect()}
    u = unit(x.astype(np.float64))
    close = u @ u.T >= 0.95
    np.fill_diagonal(close, False)
    by_id = np.argsort(ids)
    c = close[np.ix_(by_id, by_id)]
    want = roots(len(x), zip(*np.nonzero(c)))
    for i in range(len(x)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (int(c[i].sum()), want[i], want[i] == i)
    for i in range(1000, 1006):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert (got[None].n_links, got[None].component_id, got[None].kept) == (0, None, False)
    assert cover_tree.near_duplicates(df.limit(0)).collect() == []


@pytest.mark.parametrize("dims,spread", [(8, 0.002), (8, 0.08), (1536, 0.02)])
def test_blocks_of_a_dense_group_and_many_dimensions(spark, dims, spread):
    """A third of the rows in one tight group: most of its blocks are linked as wholes."""
    rng = np.random.default_rng(dims)
    n = 600
    x = rng.normal(size=(n, dims))
    x[: n // 3] = rng.normal(size=dims) + spread * rng.normal(size=(n // 3, dims))
    x[n // 3 : n // 2] = x[0] + rng.uniform(0.1, 0.5, size=(n // 2 - n // 3, 1)) * rng.normal(size=(n // 2 - n // 3, dims))  # around the threshold
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(i, x[3].tolist()) for i in range(n, n + 40)]
    x = np.vstack([x, np.repeat(x[3:4], 40, axis=0)])
    got = {r.vec_id: r for r in cover_tree.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), block=32).collect()}
    u = unit(x)
    close = u @ u.T >= 0.95
    np.fill_diagonal(close, False)
    want = roots(len(x), zip(*np.nonzero(close)))
    assert [(got[i].n_links, got[i].component_id) for i in range(len(x))] == [(int(close[i].sum()), want[i]) for i in range(len(x))]


def test_dual_traversal_of_dense_and_sparse_trees():
    rng = np.random.default_rng(2)
    for spread, share in [(0.02, 0.5), (0.2, 0.9), (0.22, 1.0)]:
        m = rng.normal(size=(400, 24))
        k = int(400 * share)
        m[:k] = rng.normal(size=(3, 24))[rng.integers(0, 3, k)] + spread * rng.normal(size=(k, 24))
        a, w = unit(m), rng.integers(1, 4, 400)
        up = cover_tree.tree(a.astype(np.float32))
        got, _, label, _ = cover_tree.join_trees(a, up, w, a, up, w, 0.95, True)
        h = a @ a.T >= 0.95
        np.fill_diagonal(h, False)
        assert (got == h @ w).all()
        assert label.tolist() == roots(400, zip(*np.nonzero(h)))


def test_unclustered_rows_are_compared_in_few_directions():
    """Where no ball prunes, nearly all pairs are told apart by bounds that are never below their products."""
    rng = np.random.default_rng(4)
    a, b = unit(rng.normal(size=(3000, 64))), unit(rng.normal(size=(1500, 64)))
    for k in range(300):  # around the threshold
        b[k] = a[k] + (0.035 + 0.00004 * k) * rng.normal(size=64)
    b = unit(b)
    x, y = cover_tree.narrow(a, b, 0.95)
    bound, dots = x @ y.T, a @ b.T
    assert x.shape[1] <= 33 and (bound >= dots - 1e-5).all() and (bound >= 0.95).mean() < 0.01
    wa, wb = rng.integers(1, 4, 3000), rng.integers(1, 4, 1500)
    ua, ub = (cover_tree.tree(m.astype(np.float32)) for m in (a, b))
    got_a, got_b, la, lb = cover_tree.join_trees(a, ua, wa, b, ub, wb, 0.95, False)
    h = dots >= 0.95
    assert 20 < h.sum() < 300 and (got_a == h @ wb).all() and (got_b == wa @ h).all()
    assert [*la, *lb] == roots(4500, [(i, 3000 + j) for i, j in zip(*np.nonzero(h))])


def test_copies_of_a_row_do_not_grow_with_the_table():
    assert [-(-n // cover_tree.block_size(n, 64)) for n in (2_000, 50_000, 500_000)] == [1, 4, 4]
    assert cover_tree.block_size(10**7, 1536) * 1536 <= 1 << 23


def test_lines_on_many_sites_go(spark):
    rows = [(i, f"own text number {i} with some words\nAll rights reserved.\nmore of {i}", f"s{i % 7}", None) for i in range(14)]
    rows += [(100 + i, "the very same document\nin two lines", f"s{i}", None) for i in range(9)]
    long = "\n".join(f"line {k} of a very long text" for k in range(30_000))
    rows += [(300, long + "\nAll rights reserved.", "s1", None), (None, long[:60], "s1", None), (None, "All rights reserved.", "s2", None), (5, "another text of that id\nAll rights reserved.", "s2", None)]
    rows += [(200, None, "s1", None), (201, "", None, None), (202, "All rights reserved.\r\n\nlonger line of its own", None, None), (203, "seen on few sites\nand longer text " + "x" * 90, "s1", "y")]
    df = spark.createDataFrame(rows, DOCS).withColumnRenamed("extra", "clean_text")
    every = line_spread.remove_boilerplate(df, min_sites=5).collect()
    joined = line_spread.remove_boilerplate(df, min_sites=5, few=0)  # more lines than are sent: a join
    assert sorted(map(str, joined.collect())) == sorted(map(str, every))
    odd = ["a", " ñandú\t", "\r", "", "x" * 3000, "日本 語", "\u00a0nbsp"]
    keys = spark.createDataFrame([(t,) for t in odd], "t string").select("t", line_spread.line_key(F.col("t")).alias("k")).collect()
    assert all(line_spread.hash_of(r.t) == r.k for r in keys)
    assert len(every) == len(rows) and {r.clean_text for r in every if r.doc_id is None} == {long[:60], ""}
    assert {r.clean_text for r in every if r.doc_id == 5} == {"own text number 5 with some words\nmore of 5", "another text of that id"}
    assert [r.clean_text for r in every if r.doc_id == 300] == [long]
    got = {r.doc_id: r for r in every if r.text != "another text of that id\nAll rights reserved."}
    assert all(got[i].clean_text == f"own text number {i} with some words\nmore of {i}" and got[i].n_removed == 1 for i in range(14))
    assert all(got[100 + i].clean_text == "" and got[100 + i].n_removed == 2 for i in range(9))
    assert (got[200].clean_text, got[200].n_lines) == (None, 0) and (got[201].clean_text, got[201].n_lines) == ("", 1)
    assert got[202].clean_text == "\nlonger line of its own" and got[203].n_removed == 0
    assert line_spread.remove_boilerplate(df.limit(0)).collect() == []


def test_near_threshold_lines_are_counted_exactly(spark):
    rows = [(n * 100 + i, f"line on {n} sites\nown {n} {i} and more text", f"site{i}", None) for n in range(2, 9) for i in range(n)]
    bad, _ = line_spread.boilerplate_lines(spark.createDataFrame(rows, DOCS), min_sites=5)
    assert sorted(r.sites for r in bad.collect()) == [5, 6, 7, 8]


def test_spread_lines_leave_short_pages_and_lines_of_copies_stay(spark):
    head, foot = "All rights reserved by the owner", "Read our terms of use before you go on"
    rows = [(i, f"{head}\nshort {i}\n{foot}", f"s{i % 6}", None) for i in range(12)]
    story = [f"line {k} of a story that nine sites print " + " ".join(f"w{k}{j}" for j in range(12)) for k in range(6)]
    rows += [(100 + i, "\n".join([*story, f"printed by {i}"]), f"s{i}", None) for i in range(9)]
    rows += [(200, f"{head}\n{foot}", "s1", None), (201, None, "s1", None), (202, f"{head}\nlonger text of its own " + "x" * 90, None, None), (None, f"{head}\nshort\n{foot}", "s2", None), (0, rows[0][1], "s0", None)]
    df = spark.createDataFrame(rows, DOCS)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.clean_text, r.n_removed) for r in line_spread.remove_boilerplate(df, copy_share=0.5).collect() if r.text is not None)
    want = [(-1, "short", 2), (0, "short 0", 2), *((i, f"short {i}", 2) for i in range(12)), *((100 + i, rows[12 + i][1], 0) for i in range(9)), (200, "", 2), (202, "longer text of its own " + "x" * 90, 1)]
    assert got == sorted(want)
    joined = sorted((r.doc_id if r.doc_id is not None else -1, r.clean_text, r.n_removed) for r in line_spread.remove_boilerplate(df, copy_share=0.5, few=0).collect() if r.text is not None)
    assert joined == got
    assert line_spread.remove_boilerplate(df.limit(0), copy_share=0.5).collect() == []
