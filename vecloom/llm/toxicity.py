"""Toxicity by a weighted lexicon.

Texts are folded (lower case, homoglyphs and digit substitutions to letters, anything else to one space) and matched
against an Aho-Corasick automaton of word beginnings and whole words.  A hit that lies inside an exception phrase does
not count.  The summed weights are normalised by the number of words and put through a logistic function.

Lexicon, exceptions and logistic are learned from labelled rows, a bounded sample of `max_rows` of them in the order of
a seeded hash (equal texts count once): a word beginning that toxic texts have far more often than others is an entry,
its weight the log odds; a phrase of two or three words around an entry that other texts have clearly more often than
toxic ones is an exception.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage, worker_cache

#: Letters of other scripts and symbols that look like Latin letters.
LOOKALIKES = (
    "аaсcеeоoрpхxуyіiјjѕsԁdһhкkмmтtвbнhгrпnлlԛqԝw"
    "αaβbεeηnιiκkνvοoρpτtυuχxωw"
    "ıiłløoðdþpɑaɡgɩiʏy"
)
#: Digits and signs that stand for letters inside a word.
SUBSTITUTES = "0o1i3e4a5s7t8b9g@a$s!i|l€e+t"


def fold_table() -> dict[int, str]:
    return {ord(a): b for a, b in zip(LOOKALIKES[::2], LOOKALIKES[1::2])}


def fold(text: str) -> str:
    """' word word ... ' in lower case.

    Full-width forms and the like are taken to plain ones and accents on letters that are lookalikes only are kept;
    a digit or sign counts as its letter only between or beside letters of the same word; what remains of digits and
    signs parts words.
    """
    import re

    t = text.lower()
    if not t.isascii():
        import unicodedata

        t = unicodedata.normalize("NFKC", t).translate(worker_cache("tox-fold", 0, fold_table))
        t = re.sub("[­​-‍⁠﻿]", "", t)
    subs = dict(zip(SUBSTITUTES[::2], SUBSTITUTES[1::2]))
    cls = re.escape("".join(subs))
    if any(c in t for c in subs):
        # runs of letters and at most as many substitutes, at least two letters in all
        t = re.sub(
            rf"[^\W\d_]*(?:[{cls}]+[^\W\d_]+)+[{cls}]*|[^\W\d_]{{2,}}[{cls}]+(?![^\W_])",
            lambda m: _unmask(m.group(), subs),
            t,
        )
    return " " + re.sub(r"[\W\d_]+", " ", t).strip() + " "


def _unmask(run: str, subs: dict[str, str]) -> str:
    inner = run.rstrip("!|+$")
    signs = sum(c in subs for c in inner)
    letters = len(inner) - signs
    if signs == 0 or signs > letters + 1 or letters < 2:
        return run
    return "".join(subs.get(c, c) for c in inner) + run[len(inner) :]


def training_rows(doc_id: Column) -> Column:
    """The rows that may be learned from: crc32 of the id as text, modulo 3, is not 1 (a null id counts as text 'null')."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % 3 != 1


def _beginnings(folded: str, lo: int, hi: int) -> set[str]:
    out = set()
    for w in set(folded.split()):
        n = len(w)
        for k in range(lo, min(n, hi) + 1):
            out.add(" " + w[:k])
        if n >= lo:
            out.add(f" {w} ")
    return out


class Lexicon:
    """entries: {pattern: weight}; a pattern starts with a space (start of a word) and may end with one (end of it)."""

    def __init__(self, entries: dict[str, float], exceptions: tuple[str, ...] = (), slope: float = 1.0, bias: float = 0.0):
        self.entries, self.exceptions, self.slope, self.bias = entries, exceptions, slope, bias

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for p, w in self.entries.items():
            a.add_word(p, (len(p), w))
        for e in self.exceptions:
            p = fold(e)
            a.add_word(p, (len(p), self.entries[p] if p in self.entries else None))
        if len(a):
            a.make_automaton()
        return a

    @staticmethod
    def weigh(automaton, folded: str) -> tuple[float, int]:
        """(summed weights, words); each word start counts its heaviest entry once, none inside an exception phrase."""
        words = folded.count(" ") - 1
        if not len(automaton) or not folded.strip():
            return 0.0, max(words, 0)
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (n, w) in automaton.iter(folded):
            at = end - n + 1
            if w is None:
                spared.append((at, end))
            elif best.get(at, 0.0) < w:
                best[at] = w
        if spared:
            best = {k: w for k, w in best.items() if not any(a <= k < b for a, b in spared)}
        return sum(best.values()), words

    def score(self, weight: float, words: int) -> float:
        """Logistic of the logarithm of weight per word; the prior of 5 words keeps a lone hit in a tiny text moderate."""
        x = self.slope * math.log((weight + 1e-3) / (words + 5)) + self.bias
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, x))))


def fit(
    docs: DataFrame, labels: DataFrame, max_rows: int = 16_000, lo: int = 3, hi: int = 10, min_docs: int = 4, exceptions: tuple[str, ...] = ()
) -> Lexicon:
    """docs(doc_id, text), labels(doc_id, toxic) -> Lexicon; `exceptions` are phrases beside those that are learned.

    The sample of at most max_rows labelled ids is staged; candidates are counted over its toxic texts, then over the
    others, by tasks that emit one row per candidate.  What comes to the driver are the beginnings that stand in at
    least one of 500 (and min_docs) toxic texts of the sample.  Rows with a null label, id or text are not learned
    from.  An id or a text with labels that disagree counts as toxic; repeated rows count once.
    """
    spark = docs.sparkSession
    labelled = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = labelled.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(max_rows)
    # picked has at most max_rows rows of two numbers
    sample = stage(docs.where("text is not null").select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic")), "tox-sample")
    totals = dict(sample.groupBy("toxic").count().collect())
    n1, n0 = totals.get(1, 0), sum(v for k, v in totals.items() if k != 1)
    if not n1:
        return Lexicon({}, exceptions, 1.0, -4.0)

    def count(wanted=None):
        def run(batches):
            from collections import Counter

            import pyarrow as pa

            seen: Counter = Counter()
            for b in batches:
                for t in b.column(0).to_pylist():
                    f = _beginnings(fold(t), lo, hi)
                    seen.update(f if wanted is None else f & wanted.value)
            items = list(seen.items())
            for i in range(0, len(items), 50_000):
                part = items[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in part], pa.string()), pa.array([v for _, v in part], pa.int64())], names=["p", "n"])

        return run

    toxic = sample.where("toxic = 1").select("text").mapInArrow(count(), "p string, n long")
    need = max(min_docs, n1 // 500)
    cand = dict(toxic.groupBy("p").agg(F.sum("n").alias("n")).where(F.col("n") >= need).collect())
    # bounded by the sample: every candidate stands in one of 500 of its toxic texts
    wanted = spark.sparkContext.broadcast(frozenset(cand))
    other = dict(sample.where("toxic <> 1").select("text").mapInArrow(count(wanted), "p string, n long").groupBy("p").agg(F.sum("n").alias("n")).collect())
    entries = _select(cand, other, n1, n0)
    lex = Lexicon(entries, (*exceptions, *_exceptions(sample, entries, n1, n0, min_docs)))

    def weigh(batches):
        import pyarrow as pa

        a = lex.automaton()
        for b in batches:
            got = [Lexicon.weigh(a, fold(t)) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([float(g[0]) for g in got]), pa.array([g[1] for g in got], pa.int64()), b.column(1).cast(pa.int64())], names=["w", "n", "y"])

    rows = sample.select("text", F.col("toxic").cast("long").alias("toxic")).mapInArrow(weigh, "w double, n long, y long").collect()
    lex.slope, lex.bias = _logistic([(math.log((r.w + 1e-3) / (r.n + 5)), r.y) for r in rows])
    return lex


def phrases(automaton, folded: str) -> set[str]:
    """The phrases of two and three words of a folded text that have a word with an entry."""
    words, starts, at = folded.split(), {}, 0
    for k, w in enumerate(words):
        starts[at] = k
        at += len(w) + 1
    hits = {starts[end - n + 1] for end, (n, _) in automaton.iter(folded)} if len(automaton) and words else set()
    return {" ".join(words[i:j]) for k in hits for i in range(max(0, k - 2), k + 1) for j in range(max(k + 1, i + 2), min(len(words), i + 3) + 1)}


def _exceptions(sample: DataFrame, entries: dict[str, float], n1: int, n0: int, min_docs: int) -> list[str]:
    """Phrases around an entry in min_docs texts that aren't toxic, ten times as many as toxic ones, by shares too (the rule of entries reversed)."""
    plain = Lexicon(entries)

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        a = plain.automaton()
        n: Counter = Counter()
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n.update((p, int(y == 1)) for p in phrases(a, fold(t)))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in n], pa.string()), pa.array([v * (y == 0) for (_, y), v in n.items()], pa.int64()), pa.array([v * y for (_, y), v in n.items()], pa.int64())], names=["p", "b", "a"])

    found = sample.select("text", "toxic").mapInArrow(run, "p string, b long, a long").groupBy("p").agg(F.sum("b").alias("b"), F.sum("a").alias("a"))
    good = []
    for r in found.where(F.col("b") >= min_docs).collect():  # at most a few of each text of the bounded sample
        if r.a <= 0.1 * r.b and (r.a + 0.5) / (n1 + 1) < (r.b + 0.5) / (n0 + 1):
            good.append(r.p)
    return [p for p in sorted(good) if not any(q != p and f" {q} " in f" {p} " for q in good)]


def _select(cand: dict[str, int], other: dict[str, int], n1: int, n0: int) -> dict[str, float]:
    """Word beginnings whose odds in toxic texts are high even at the low end of their error; of nested ones the shorter, unless the longer is clearly purer."""
    good = {}
    for p, a in cand.items():
        b = other.get(p, 0)
        w = math.log((a + 0.5) / (n1 + 1)) - math.log((b + 0.5) / (n0 + 1))
        low = w - 1.64 * math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        if low > 1.0 and b <= 0.1 * a:
            good[p] = (w, low, a, b)
    kept: dict[str, float] = {}
    for p in sorted(good, key=lambda p: (len(p.strip()), p.endswith(" "), p)):
        w, low, a, b = good[p]
        stem = p.rstrip(" ")
        inside = any(stem[:k] in kept and stem[:k] != p for k in range(3, len(stem) + 1))
        if not inside:
            kept[p] = round(w, 4)
    return kept


def _logistic(points: list[tuple[float, int]], steps: int = 200) -> tuple[float, float]:
    """Newton's method with a ridge, classes weighed alike; at most max_rows points."""
    import numpy as np

    x, y = (np.array(v, float) for v in zip(*points))
    if y.min() == y.max():
        return 1.0, 4.0 if y[0] else -4.0
    c = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())) * len(y)
    X = np.column_stack([x, np.ones_like(x)])
    b = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(X @ b, -30, 30)))
        g = X.T @ (c * (p - y)) + 0.01 * len(y) * np.array([b[0], 0]) * 0.01
        H = X.T @ (X * (c * p * (1 - p))[:, None]) + np.diag([1e-4 * len(y), 1e-9 * len(y)])
        d = np.linalg.solve(H, g)
        b -= np.clip(d, -5, 5)
        if abs(d).max() < 1e-9:
            break
    return float(b[0]), float(b[1])


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """docs(doc_id, text, ...) + tox_score double, tox_weight double, tox_words long.

    Null and empty texts have no words and the low score of no hits.  Whole texts are matched.  Rows of equal text get
    equal scores, whatever their ids.  Empty table: no rows.  Columns of the same
    names are replaced; other columns pass through.
    """
    from pyspark.sql.types import DoubleType, LongType, StructField, StructType

    docs = docs.drop("tox_score", "tox_weight", "tox_words")

    def run(batches):
        import pyarrow as pa

        a = lexicon.automaton()
        for b in batches:
            got = [Lexicon.weigh(a, fold(t or "")) for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            new = [pa.array([lexicon.score(*g) for g in got], pa.float64()), pa.array([float(g[0]) for g in got], pa.float64()), pa.array([int(g[1]) for g in got], pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, "tox_score", "tox_weight", "tox_words"])

    extra = [StructField("tox_score", DoubleType()), StructField("tox_weight", DoubleType()), StructField("tox_words", LongType())]
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *extra]))
