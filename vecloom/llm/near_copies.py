"""SimHash near-dedup by similarity: bit-sliced comparison of fingerprints, then an exact check of the shingles.

Two texts are near copies if the Jaccard similarity of their sets of word shingles reaches a threshold t.  Which pairs
are compared follows from their shingles in one common order: of two such texts of n and m shingles the first
n - ceil(t n) + 1 and m - ceil(t m) + 1 share at least one, so they meet in the bucket of one of these prefix shingles.
Far fewer will do where the order is that of a hash: the first shingles of the union of both are common with probability
t each, so `few` of them are all unshared with probability (1 - t)**few.  So a text keeps its first `few` = 12 prefix
shingles, 4e-9 at 0.8, and the whole prefix if over a tenth of its shingles are frequent ones, which the order puts last
(of a pair with fewer the other shingles have a similarity of 0.75 at least: 6e-8).  Sizes and positions rule out further
pairs.  Inside a bucket the fingerprints of simhash.py, here of
the set of shingles, are compared bit-sliced, and only pairs within `radius` bits go on to the check of their shingles.

The radius loses few links, too.  A pair at similarity 0.8 has a cosine of 0.89, so each of the
64 bits differs with probability 0.15: 9.7 bits in the mean, 2.9 their standard deviation.  24 bits are five of these;
the chance of a miss is below one in a hundred thousand at the threshold and far smaller above it.

The order puts frequent shingles last, counted over all texts among the first of each in hash order, then goes by hash:
any order gives the same pairs, this one gives small buckets.

No pair is a row of a table.  The first pass over the buckets returns the rows that have a partner within the radius, each
pair in its first common bucket.  Only their shingles are fetched, as 64-bit hashes, and meet in the same buckets; a
bucket counts the shingles that its members have in common by posting lists, leaves out pairs that it has linked already
and returns a spanning forest of its near copies, so a family of n texts costs n rows.
"""

from __future__ import annotations

from itertools import repeat

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import PandasUDFType

from .common import Temporary, discard, sent, stage
from .components import components
from .simhash import LOWER, majority, within_buckets


def text_key(text: Column) -> Column:
    """Hash by which equal texts are one; null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def shingles(text: str | None, shingle: int = 5) -> list[bytes]:
    """Word shingles in ASCII lower case; a shorter text is one shingle, one without words (or null) the empty shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    return [b" ".join(words)] if len(words) < shingle else [b" ".join(x) for x in zip(*(words[i:] for i in range(shingle)))]


def hashes(text: str | None, shingle: int = 5, seed: int = 42):
    """The distinct shingles of a text as sorted 64-bit hashes."""
    import numpy as np
    from xxhash import xxh64_intdigest

    pieces = shingles(text, shingle)
    return np.unique(np.fromiter(map(xxh64_intdigest, pieces, repeat(seed)), np.uint64, len(pieces)).view(np.int64))


def frequent(texts: DataFrame, shingle: int, share: float = 3 / 8000, least: int = 3, look: int = 32):
    """Sorted hashes of the shingles that are among the first `look` of their text in hash order in a share of all different texts.

    All texts are counted, and at least `least` of them must have it.  look / share numbers come to the driver at most.
    """
    import numpy as np

    def run(batches):
        import pyarrow as pa

        seen: set = set()
        for b in batches:
            new = [(key, text) for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if not (key in seen or seen.add(key))]
            if new:
                yield pa.RecordBatch.from_arrays([pa.array([key for key, _ in new], pa.int64()), pa.array([hashes(text, shingle)[:look] for _, text in new], pa.list_(pa.int64()))], names=["key", "h"])

    first = stage(texts.mapInArrow(run, "key long, h array<long>").groupBy("key").agg(F.first("h").alias("h")), "near-first")
    enough = max(least, share * first.count())
    rows = first.select(F.explode("h").alias("h")).groupBy("h").count().where(F.col("count") >= enough).select("h").collect()
    discard(first)
    return np.sort(np.array([r.h for r in rows], np.int64))


def sketches(texts: DataFrame, shingle: int, similarity: float, last, few: int = 12, share: float = 0.1) -> DataFrame:
    """texts(key, text) -> key, n, fp, prefix: the shingles of each text counted, their fingerprint, the prefix shingles.

    Shingles in `last` come last; a text with at most `share` of them keeps `few` prefix shingles.  A task puts out
    copies once.
    """
    frequent_ones = texts.sparkSession.sparkContext.broadcast(last)  # bounded by `most`

    def run(batches):
        import math

        import numpy as np
        import pyarrow as pa

        last, seen = frequent_ones.value, set()
        for b in batches:
            keys, ns, fps, prefix = [], [], [], []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if key in seen:
                    continue
                seen.add(key)
                h = hashes(text, shingle)
                n = len(h)
                fps.append(majority(h.view(np.uint64)))
                take = n - math.ceil(similarity * n - 1e-9) + 1
                late = last[np.minimum(np.searchsorted(last, h), len(last) - 1)] == h if len(last) else np.zeros(n, bool)
                if late.mean() <= share:
                    take = min(take, few)
                keys.append(key), ns.append(n), prefix.append(np.concatenate([h[~late], h[late]])[:take])
            if keys:
                ends = np.cumsum([0, *map(len, prefix)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(prefix)))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ns, pa.int32()), pa.array(np.array(fps, np.uint64).view(np.int64)), lists], names=["key", "n", "fp", "prefix"])

    return texts.mapInArrow(run, "key long, n int, fp long, prefix array<long>")


def chosen(texts: DataFrame, nodes: DataFrame, block: int = 4_000_000, blocks: int = 4) -> DataFrame:
    """The rows of texts whose key is in nodes(key).

    Up to blocks * block keys go to the executors as sorted arrays, so no text is shuffled for it; more meet the texts
    in a shuffle join.
    """
    import numpy as np

    out, need = None, max(1, -(-nodes.count() // block))
    if need > blocks:
        return texts.join(nodes.hint("merge"), "key", "left_semi")
    for k in range(need):
        part = np.sort(np.array([r.key for r in nodes.where(F.pmod(F.xxhash64("key"), F.lit(need)) == k).collect()], np.int64))
        held = texts.sparkSession.sparkContext.broadcast(part)  # bounded by `block`

        def among(keys, held=held):
            for key in keys:
                at = np.searchsorted(held.value, key.to_numpy()) if len(held.value) else None
                yield key != key if at is None else key == held.value[np.minimum(at, len(held.value) - 1)]

        rows = texts.where(F.pandas_udf(among, "boolean", PandasUDFType.SCALAR_ITER)("key"))
        out = rows if out is None else out.unionByName(rows)
    return out


def free_shuffles(spark) -> None:
    """Let Spark's cleaner delete the shuffle files of plans that have been written and are no longer held."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def near_in_buckets(c, i, j, similarity: float) -> list[tuple[int, int]]:
    """Of the candidate pairs of positions (i, j) in c (arrays set, __g) a spanning forest of the near copies of each bucket.

    A shingle's posting list names the members that have it; those of one member's shingles, counted, are what it has in
    common with all others.
    """
    import numpy as np

    out = []
    order = np.lexsort((j, i, c["__g"][i]))
    i, j = i[order], j[order]
    for part in np.split(np.arange(len(i)), np.flatnonzero(np.diff(c["__g"][i])) + 1):
        rows, local = np.unique(np.concatenate([i[part], j[part]]), return_inverse=True)
        a, b = local[: len(part)], local[len(part) :]
        n = np.array([len(c["set"][k]) for k in rows.tolist()])
        inv = np.unique(np.concatenate([c["set"][k] for k in rows.tolist()]), return_inverse=True)[1]
        posting = np.repeat(np.arange(len(rows)), n)[np.argsort(inv, kind="stable")]
        at, begin = np.concatenate([[0], np.cumsum(np.bincount(inv))]), np.concatenate([[0], np.cumsum(n)])
        label = np.arange(len(rows))
        for mates in np.split(np.arange(len(a)), np.flatnonzero(np.diff(a)) + 1):
            x, y = a[mates[0]], b[mates]
            y = y[label[y] != label[x]]
            if not len(y):
                continue
            mine = inv[begin[x] : begin[x + 1]]
            size = at[mine + 1] - at[mine]
            both = np.bincount(posting[np.repeat(at[mine] - np.cumsum(size) + size, size) + np.arange(size.sum())], minlength=len(rows))[y]
            y = y[both + 1e-9 >= similarity * (n[x] + n[y] - both)]
            if len(y):
                linked, first = np.unique(label[y], return_index=True)
                out += [(int(rows[x]), int(rows[k])) for k in y[first].tolist()]
                label[np.isin(label, linked)] = label[x]
    return out


def links(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 24, few: int = 500_000) -> DataFrame:
    """docs(text) -> u, v: links between text_keys whose components are those of all near-copy pairs.

    Null and empty texts are one text.  Texts of fewer words than a shingle are near copies only of equal ones.
    Repeated texts count once.  Empty table: no rows.  Other columns are ignored.
    """
    texts = docs.select(text_key(F.col("text")).alias("key"), "text")

    def allowed(a, b):
        """Sizes and positions allow it; the bucket of their first common shingle lets near copies by."""
        import numpy as np

        (an, ap), (bn, bp) = ([x[c] for c in ("n", "pos")] for x in (a, b))
        ok = np.minimum(an, bn) + 1e-6 >= similarity * np.maximum(an, bn)
        return ok & (np.minimum(an - ap, bn - bp) + 1e-6 >= similarity / (1 + similarity) * (an + bn))

    def partnered(c, i, j):
        import numpy as np
        import pyarrow as pa

        at = np.unique(np.concatenate([i, j]))
        return pa.RecordBatch.from_arrays([pa.array(c[k][at]) for k in ("h", "key")], names=["h", "key"])

    def near(c, i, j):
        import pyarrow as pa

        found = [sorted((int(c["key"][x]), int(c["key"][y]))) for x, y in near_in_buckets(c, i, j, similarity)]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

    def sets(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([hashes(t, shingle) for t in b.column(1).to_pylist()], pa.list_(pa.int64()))], names=["key", "set"])

    with Temporary() as mine:
        sketch = stage(sketches(texts, shingle, similarity, frequent(texts, shingle)), "near-sketch")
        rows = sketch.select("key", F.explode("prefix").alias("h"))
        shared = stage(rows.groupBy("h").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo < hi").select("h"), "near-shared")
        rows = sketch.select("key", "n", "fp", "prefix", F.posexplode("prefix").alias("pos", "h")).select("key", "n", "fp", "pos", "h", F.slice("prefix", F.lit(1), F.col("pos")).alias("before"))
        met = stage(rows.join(sent(shared, few), "h").dropDuplicates(["h", "key"]).select("h", "key", "n", "fp", "pos", "before"), "near-met")
        free_shuffles(docs.sparkSession)
        busy = stage(within_buckets(met, ["h"], radius, "key", ["n", "pos"], allowed, cap=1024, before="before", emit=partnered, kinds="h long, key long").distinct(), "near-busy")
        nodes = stage(busy.select("key").distinct(), "near-nodes")
        held = stage(chosen(texts, nodes).mapInArrow(sets, "key long, set array<long>").groupBy("key").agg(F.first("set").alias("set")), "near-sets")
        again = met.join(busy, ["h", "key"]).join(held, "key")
        out = within_buckets(again, ["h"], radius, "key", ["n", "pos"], allowed, cap=1 << 18, before="before", weight="n", lists=("set",), emit=near)
        out = mine.keep(stage(out.distinct(), "near-links"))
        free_shuffles(docs.sparkSession)
    return out


def kept(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, few: int = 500_000) -> DataFrame:
    """docs(doc_id, text, ...) -> of each group linked by near copies the row with the smallest doc_id, once.

    Rows are told apart by (doc_id, text): of rows that share an id each text counts for itself.  Rows with a null
    doc_id all stay.  Null and empty texts are copies of one another.  Empty table: no rows.  What goes is found as
    pairs of numbers; up to `few` of them are broadcast, so no text is shuffled then.
    """
    d = docs.withColumn("__key", text_key(F.col("text")))
    with Temporary() as mine:
        ids = stage(d.where("doc_id is not null").groupBy("doc_id", "__key").agg(F.count("*").alias("n")), "near-ids")
        first = ids.groupBy("__key").agg(F.min("doc_id").alias("__id"))
        roots = components(links(docs, shingle, similarity))
        grouped = first.join(roots, F.col("__key") == F.col("node"), "left").groupBy(F.coalesce("root", "__key").alias("root"))
        stay = grouped.agg(F.min(F.struct("__id", "__key")).alias("x")).select(F.col("x.__id").alias("doc_id"), F.col("x.__key").alias("__key"))
        gone = mine.keep(stage(ids.join(stay, ["doc_id", "__key"], "left_anti").select("doc_id", "__key"), "near-gone"))
        many = mine.keep(stage(ids.where("n > 1").select("doc_id", "__key"), "near-repeated"))
    left = d.join(sent(gone, few), ["doc_id", "__key"], "left_anti")
    if not many.isEmpty():
        once = left.join(many, ["doc_id", "__key"], "left_semi").dropDuplicates(["doc_id", "__key"])
        left = left.join(many, ["doc_id", "__key"], "left_anti").unionByName(once)
    return left.select(*docs.columns)
