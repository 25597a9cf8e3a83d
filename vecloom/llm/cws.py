"""Document fingerprints by consistent weighted sampling.

A text is a weighted set: its five-word shingles with their counts.  Lane k of the fingerprint is one consistent
sample of the set: each term S has gamma draws r, c ~ Gamma(2, 1) and a uniform b that depend on (S, k) alone; with
weight w, t = floor(ln w / r + b), y = exp(r (t - b)), a = c / (y exp(r)), the sample is the term of smallest a together
with its t.  Two texts agree in a lane with the probability of their generalised Jaccard similarity, the sum of the
smaller weights over the sum of the larger.

The draws come from a table of 2**16 triples; (S, k) picks one by a multiplicative hash, so a lane of a term of weight
one costs a multiplication and a look-up.  Equal values are told apart by the term.  A lane keeps 16 bits of (S, t).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, worker_cache

LANES, SHINGLE = 64, 5


class Sampler:
    def __init__(self, lanes: int = LANES, shingle: int = SHINGLE, seed: int = 17):
        import numpy as np

        rng = np.random.Generator(np.random.PCG64(seed))
        self.lanes, self.shingle = lanes, shingle
        self.r, self.lc, self.b = rng.gamma(2, 1, 1 << 16), np.log(rng.gamma(2, 1, 1 << 16)), rng.random(1 << 16)
        self.unit = (self.lc + self.r * self.b - self.r).astype(np.float32)
        odd = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.pick, self.name = odd(lanes), odd(lanes)
        self.base = odd(1)[0]

    def terms(self, text: str):
        """(hashes, counts) of the shingles; fewer words than a shingle: one term of all words (no words: of none)."""
        import numpy as np
        from xxhash import xxh64_intdigest

        lower = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
        words = text.encode("utf-8", "surrogatepass").translate(lower).split()
        n, s = len(words), self.shingle
        w = np.fromiter(map(xxh64_intdigest, words), np.uint64, n)
        with np.errstate(over="ignore"):
            if n < s:
                h = np.full(1, n, np.uint64)
                for x in w:
                    h = h * self.base + x
            else:
                h = w[: n - s + 1].copy()
                for k in range(1, s):
                    h = h * self.base + w[k : n - s + 1 + k]
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            return np.unique(h ^ (h >> np.uint64(31)), return_counts=True)

    def fingerprint(self, text: str):
        """LANES 16-bit numbers."""
        import numpy as np

        h, w = self.terms(text)
        lane = np.arange(self.lanes)
        best, at, level = np.full(self.lanes, np.inf, np.float32), np.zeros(self.lanes, np.int64), np.zeros(self.lanes, np.int64)
        for s in range(0, len(h), 4096):
            x, many = h[s : s + 4096], np.flatnonzero(w[s : s + 4096] > 1)
            draw = (self.pick[:, None] * x[None, :] >> np.uint64(48)).astype(np.intp)
            a = self.unit.take(draw)
            if len(many):
                d, lw = draw[:, many], np.log(w[s + many])
                t = np.floor(lw / self.r[d] + self.b[d])
                a[:, many] = self.lc[d] - self.r[d] * (t - self.b[d]) - self.r[d]
            k = a.argmin(axis=1)
            v = a[lane, k]
            t = np.zeros(self.lanes, np.int64)
            if len(many):
                d = draw[lane, k]
                t = np.floor(np.log(w[s + k]) / self.r[d] + self.b[d]).astype(np.int64)
            less = v < best
            best, at, level = np.where(less, v, best), np.where(less, s + k, at), np.where(less, t, level)
        with np.errstate(over="ignore"):
            mark = (h[at] + level.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * self.name
            return (mark >> np.uint64(48)).astype(">u2")


def likeness(a, b) -> float:
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
STAGED = ROW + ", part int, first boolean, last boolean, text string"


def _row(sampler: Sampler, doc_id, text: str, fp, following: str, following_fp) -> tuple:
    import hashlib

    e = edited(text, following)
    efp = sampler.fingerprint(e)
    return doc_id, len(text), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), fp.tobytes().hex(), efp.tobytes().hex(), likeness(fp, efp), likeness(fp, following_fp)


def _batch(rows: list[tuple], schema: str):
    import pyarrow as pa

    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
    cols = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), cols)], names=[n for n, _ in cols])


def fingerprints(docs: DataFrame, lanes: int = LANES) -> DataFrame:
    """docs(doc_id, text) -> ROW: fingerprints of each text, of its edited text, and their likenesses.

    One range shuffle brings the documents into doc_id order (of equal ids by the texts' beginnings, so that one id or
    null in many rows is dealt to many tasks); a task handles each document with its successor.  The
    last document of a partition and the first of the next (two rows a partition) meet in a small second step.

    Null and empty texts are the term of no words.  Null doc_ids come first.  Rows of equal doc_id follow each other in
    the order of their texts.  A single document is its own successor.  Empty table: no rows.  Other columns are
    ignored.
    """
    spark = docs.sparkSession
    make = lambda: Sampler(lanes)

    def run(batches):
        from pyspark import TaskContext

        s, part = worker_cache("cws", lanes, make), TaskContext.get().partitionId()
        before, first, rows = None, True, []
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                text = text or ""
                fp = s.fingerprint(text)
                if before is not None:
                    rows.append((*_row(s, *before, text, fp), part, first, False, before[1] if first else None))
                    first = False
                before = (doc_id, text, fp)
                if len(rows) >= 500:
                    yield _batch(rows, STAGED)
                    rows = []
        if before is not None:
            rows.append((before[0], None, None, None, None, None, None, part, first, True, before[1]))
            yield _batch(rows, STAGED)

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id", F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")
    done = stage(ordered.mapInArrow(run, STAGED), "cws")
    ends = done.where("last or first")
    parts = sorted(r.part for r in ends.where("last").select("part").collect())  # one small number a partition
    pairs = spark.createDataFrame([(p, parts[(i + 1) % len(parts)]) for i, p in enumerate(parts)], "part int, follower int")
    heads = ends.where("first").select(F.col("part").alias("follower"), F.col("text").alias("following"))
    open_rows = ends.where("last").select("part", "doc_id", "text").join(pairs, "part").join(heads, "follower").select("doc_id", "text", "following")

    def close(batches):
        s = worker_cache("cws", lanes, make)
        for b in batches:
            for doc_id, text, following in zip(*(c.to_pylist() for c in b.columns)):
                yield _batch([_row(s, doc_id, text or "", s.fingerprint(text or ""), following or "", s.fingerprint(following or ""))], ROW)

    names = [x.split()[0] for x in ROW.split(", ")]
    return done.where("not last").select(*names).unionByName(open_rows.mapInArrow(close, ROW))
