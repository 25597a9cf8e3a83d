"""The near-duplicate stage of the pipeline against all pairs."""

import random

from pyspark.sql import functions as F

from corpus_pipeline import near_dedup
from vecloom.llm import near_copies

DOCS = "doc_id long, text string, source string"


def edited(rng, text, share):
    w = text.split()
    return " ".join(f"new{rng.randrange(10**6)}" if rng.random() < share else x for x in w)


def test_near_copies_go_as_a_comparison_of_all_pairs_says(spark):
    rng = random.Random(5)
    texts = [None, "", "  ", "Two words", "two  WORDS", "a b c d e", "a b c d e f"]
    for k in range(40):
        base = " ".join(rng.choice("abcdefghij") + str(rng.randrange(60)) for _ in range(rng.choice([6, 30, 200])))
        base += " all rights reserved by the owner of this page" * (k % 2)
        texts += [base, base.upper(), *(edited(rng, base, s) for s in (0.004, 0.01, 0.02, 0.03, 0.05, 0.2))]
    family = " ".join(f"w{k}" for k in range(120))
    texts += [f"{family} {k}" for k in range(60)]
    rng.shuffle(texts)
    sets = [set(near_copies.shingles(t)) for t in texts]
    up = list(range(len(texts)))

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    close = [(i, j) for i in range(len(texts)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    assert sum(texts[i] != texts[j] and len(sets[i] & sets[j]) < len(sets[i] | sets[j]) for i, j in close) > 100
    for i, j in close:
        i, j = root(i), root(j)
        up[max(i, j)] = min(i, j)
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], DOCS)
    got = sorted(r.doc_id for r in near_dedup(spark, df.repartition(3), "").collect())
    assert got == [i for i in range(len(texts)) if root(i) == i]
    assert near_dedup(spark, df.limit(0), "").collect() == []


def test_rows_that_share_an_id_are_told_apart_by_their_texts(spark):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(7, long, "a"), (7, "an altogether other text", "a"), (7, long, "a"), (7, long + " x", "a"), (9, long.upper(), "b"), (9, "only here", "b"), (None, long, "c"), (None, long, "c")]
    got = near_dedup(spark, spark.createDataFrame(rows, DOCS), "").collect()
    assert sorted((r.doc_id or 0, len(r.text.split())) for r in got if r.doc_id == 9 or r.doc_id is None) == [(0, 60), (0, 60), (9, 2)]
    seven = sorted(len(r.text.split()) for r in got if r.doc_id == 7)
    assert len(seven) == 2 and seven[0] == 4 and seven[1] in (60, 61)


def test_a_family_of_texts_is_never_a_table_of_its_pairs(spark, monkeypatch):
    """300 texts around one, most pairs of them just below the similarity: rows stay in proportion to the texts."""
    rng = random.Random(8)
    base, texts = [f"w{k}" for k in range(150)], []
    for k in range(300):
        w = list(base)
        for at in rng.sample(range(150), 3 if k % 10 else 1):
            w[at] = f"x{rng.randrange(10**9)}"
        texts.append(" ".join(w))
    sets = [set(near_copies.shingles(t)) for t in texts]
    up = list(range(300))

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for i in range(300):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    counted, write = [], near_copies.stage

    def stage(df, label):
        out = write(df, label)
        counted.append((out.count(), label))
        return out

    monkeypatch.setattr(near_copies, "stage", stage)
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], DOCS)
    got = sorted(r.doc_id for r in near_dedup(spark, df.repartition(3), "").collect())
    assert got == [i for i in range(300) if root(i) == i] and len(got) > 1
    assert max(counted)[0] < 40 * 300, max(counted)


def test_frequent_shingles_are_counted_over_all_texts(spark):
    """Each different text counts once, however many rows it has, and none is left out."""
    texts = [f"{k} a{k} b{k} c{k} d{k} e{k}" for k in range(9000)] + [f"one two three four five {k}" for k in range(5)] + ["six seven eight nine ten"] * 50
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(near_copies.text_key(F.col("text")).alias("key"), "text")
    assert near_copies.frequent(df, 5, share=5 / 9006).tolist() == near_copies.hashes("one two three four five").tolist()
    assert near_copies.frequent(df, 5, share=6 / 9006).tolist() == []
