"""SimHash near-dedup with bit-sliced comparison.

A fingerprint is the bitwise majority of the hashes of a text's word shingles.  Fingerprints within `radius` bits are
linked.  Of `radius + 2` blocks of the 64 bits any two close fingerprints share at least two (for radius 2: four
blocks of 16), so each distinct fingerprint goes to one bucket per pair of blocks; the search is exact.

Inside a bucket the fingerprints are stored as vertical bit planes, 64 of them to a machine word.  One query is
compared with 64 others at once: the planes are added up by carry-save counters that start so high that a carry out
of the top means "more than radius", and a block of comparisons is abandoned as soon as all of it has overflowed.

Buckets of more than `cap` fingerprints are split by hash into blocks and meet pair of blocks by pair of blocks, so no
task holds more than two blocks of one bucket.  Only distinct fingerprints are compared; copies share a fingerprint.
"""

from __future__ import annotations

from itertools import combinations, repeat

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage
from .components import components


LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def majority(h) -> int:
    """The bits set in over half of the uint64 hashes."""
    import numpy as np

    total = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 14):
        bits = np.unpackbits(h[i : i + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * total > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit fingerprint of a whole text; no words (or null): 0."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    pieces = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    return majority(np.fromiter(map(xxh64_intdigest, pieces, repeat(seed)), np.uint64, max(1, len(words) - shingle + 1)))


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """docs(doc_id, text) -> doc_id, fp (the fingerprint as a signed long)."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            fp = [fingerprint(t, shingle, seed) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x - (1 << 64) if x >> 63 else x for x in fp], pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def close_pairs(fp, start, stop, radius: int):
    """Pairs (i, j), i < j < stop[i], of positions in the uint64 array fp at most `radius` bits apart.

    start/stop: for each position the range of its group; the groups lie one after another.
    """
    import numpy as np

    n = len(fp)
    words = -(-n // 64)
    padded = np.zeros(words * 64, np.uint64)
    padded[:n] = fp
    bits = np.unpackbits(padded.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    planes = np.ascontiguousarray(np.packbits(bits.reshape(words, 64, 64).transpose(0, 2, 1), axis=2, bitorder="little")).view("<u8")[:, :, 0]
    ones, zero = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0)
    width = (radius + 1).bit_length()
    bias = (1 << width) - 1 - radius
    here = np.arange(n)
    first, last = (here + 1) // 64, (stop - 1) // 64
    count = np.where(stop - here > 1, last - first + 1, 0)
    found_i, found_j = [], []
    ends = np.cumsum(count)
    at = 0
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + (1 << 18), side="right")))
        c = count[at:to]
        q = np.repeat(here[at:to], c)
        w = np.repeat(first[at:to], c) + (np.arange(len(q)) - np.repeat(np.cumsum(c) - c, c))
        at = to
        if not len(q):
            continue
        low, high = np.clip(q + 1 - w * 64, 0, 63).astype(np.uint64), np.clip(stop[q] - w * 64, 1, 64).astype(np.uint64)
        mask = (ones << low) & (ones >> (np.uint64(64) - high))
        counters = [np.full(len(q), ones if bias >> k & 1 else zero) for k in range(width)]
        over = np.zeros(len(q), np.uint64)
        mine = fp[q]
        for b in range(64):
            carry = planes[w, b] ^ (zero - (mine >> np.uint64(b) & np.uint64(1)))
            for k in range(width):
                counters[k], carry = counters[k] ^ carry, counters[k] & carry
            over |= carry
            if b % 8 == 7:
                alive = (mask & ~over) != 0
                if not alive.any():
                    q = q[:0]
                    break
                if alive.mean() < 0.7:
                    q, w, mask, over, mine = q[alive], w[alive], mask[alive], over[alive], mine[alive]
                    counters = [x[alive] for x in counters]
        if len(q):
            hit = mask & ~over
            r, bit = np.nonzero(np.unpackbits(hit.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            found_i.append(q[r])
            found_j.append(w[r] * 64 + bit)
    if not found_i:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_i), np.concatenate(found_j)


def within_buckets(rows: DataFrame, keys: list[str], radius: int, name: str = "fp", more: list[str] | None = None, allowed=None, cap: int = 2048, before: str | None = None, weight: str | None = None, lists: tuple = (), emit=None, kinds: str = "u long, v long") -> DataFrame:
    """rows(*keys, fp, name, *more), keys long -> u < v: names of the pairs of rows of a bucket at most `radius` bits apart, once.

    Rows of a bucket have different names.  allowed(a, b): of two dictionaries of the columns `more` of the rows to be
    paired, which pairs count.  before: a column array<long> of other buckets of the row; rows that have one in common
    there are not paired here, so a pair that meets in many buckets is put out in one.  Buckets of more than `cap` rows (or more than `cap` of the sum of
    a column `weight`) are split by hash of the name into blocks and meet pair of blocks by pair of blocks.

    With emit(c, i, j) its record batches (of the columns `kinds`) are returned instead of the pairs: c has the columns as
    arrays, `lists` as arrays of arrays, and __g, the number of the bucket or pair of blocks; i, j are the pairs' positions.
    """
    more = more or []
    cols = [*keys, *dict.fromkeys(["fp", name, *more, *([before] if before else []), *lists])]
    big = rows.groupBy(*keys).agg((F.sum(weight) if weight else F.count("*")).alias("__n")).where(F.col("__n") > cap)
    blocks = F.coalesce(F.ceil(F.col("__n") / cap).cast("long"), F.lit(1).cast("long"))
    dealt = rows.join(big, keys, "left").select(*cols, blocks.alias("__nb")).withColumn("__own", F.pmod(F.xxhash64(name), F.col("__nb")))
    dealt = dealt.withColumn("__other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__nb") - 1)))
    block = ["__a", "__b"]
    dealt = dealt.select(*cols, "__own", F.least("__own", "__other").alias("__a"), F.greatest("__own", "__other").alias("__b"))
    dealt = dealt.repartition(*keys, *block).sortWithinPartitions(*keys, *block)
    bucket = [*keys, *block]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def compare(c):
            key = np.stack([c[k] for k in bucket])
            edge = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            begin = np.concatenate([[0], edge])
            size = np.diff(np.concatenate([begin, [key.shape[1]]]))
            several = np.repeat(size > 1, size)
            c = {k: x[several] for k, x in c.items()}
            size = size[size > 1]
            if not len(size):
                return None
            start = np.repeat(np.cumsum(size) - size, size)
            c["__g"] = np.repeat(np.arange(len(size)), size)
            i, j = close_pairs(c["fp"].view(np.uint64), start, start + np.repeat(size, size), radius)
            ok = (c["__a"][i] == c["__b"][i]) | (c["__own"][i] != c["__own"][j])
            if allowed is not None:
                ok &= allowed({k: c[k][i] for k in more}, {k: c[k][j] for k in more})
            i, j = i[ok], j[ok]
            if before:
                there: dict = {}

                def others(k):
                    if k not in there:
                        there[k] = set(c[before][k])
                    return there[k]

                apart = np.fromiter((others(p).isdisjoint(others(q)) for p, q in zip(i.tolist(), j.tolist())), bool, len(i))
                i, j = i[apart], j[apart]
            if emit is not None:
                return emit(c, i, j) if len(i) else None
            x, y = c[name][i], c[name][j]
            pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1) if len(x) else np.zeros((2, 0), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["u", "v"])

        held = None
        for batch in batches:
            c = {k: x.to_numpy(zero_copy_only=False) for k, x in zip(batch.schema.names, batch.columns)}
            c = {k: x if k == before or k in lists else x.astype(np.int64) for k, x in c.items()}
            if held is not None:
                c = {k: np.concatenate([held[k], x]) for k, x in c.items()}
            if not len(c["fp"]):
                continue
            differs = np.flatnonzero(np.any(np.stack([c[k] != c[k][-1] for k in bucket]), axis=0))
            cut = int(differs[-1]) + 1 if len(differs) else 0
            held = {k: x[cut:] for k, x in c.items()}
            if cut and (out := compare({k: x[:cut] for k, x in c.items()})) is not None:
                yield out
        if held is not None and len(held["fp"]) and (out := compare(held)) is not None:
            yield out

    found = dealt.mapInArrow(run, kinds)
    return found if emit is not None else found.distinct()


def links(distinct: DataFrame, radius: int = 2, cap: int = 2048) -> DataFrame:
    """distinct(fp) -> u, v: every pair of different fingerprints at most `radius` bits apart, once.  Null fingerprints have no pairs."""
    parts = radius + 2
    cuts = [64 * k // parts for k in range(parts + 1)]
    masks = [((1 << cuts[k + 1]) - (1 << cuts[k])) for k in range(parts)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    tables = [signed(masks[i] | masks[j]) for i, j in combinations(range(parts), 2)]
    keyed = distinct.where("fp is not null").select(
        "fp", F.explode(F.array(*[F.struct(F.lit(t).cast("long").alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(tables)])).alias("k")
    )
    return within_buckets(keyed.select("fp", "k.t", "k.key"), ["t", "key"], radius, cap=cap)


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, fp, component_id: the smallest doc_id reachable by links between fingerprints.

    Null and empty texts have fingerprint zero and are linked like any other.  Null doc_ids never name a component;
    where all ids of one are null, component_id is null.  Repeated rows are returned each.  Empty table: no rows.
    Other columns are ignored.
    """
    fps = stage(fingerprints(docs, shingle, seed), "simhash")
    reps = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-distinct")
    comp = components(stage(links(reps.select("fp"), radius), "simhash-links"))
    rooted = reps.join(comp, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")
