"""Token ids in a content-addressed store.

Texts are encoded with the tokenizers library and an end id is appended to each.  A rolling (gear) hash over the ids
cuts each document's stream into chunks at places that depend on the ids nearby only, so equal passages give equal
chunks wherever they stand.  A chunk is addressed by the digest of its bytes and stored once, in the pack row of the
first document that has it; a document's recipe is its list of digests.  The Merkle root over a recipe names the
document's content, and the roots of the documents of a pack are hashed into the pack's manifest.

Layout under one folder, all Parquet: `packs` (rows in ascending doc_id order: recipe, root, owned chunks compressed
with Zstandard) and `manifest` (one row per pack).  Ids are little-endian, 16 bits where the vocabulary allows it.

Plan: encode once into a staged table; owners of digests by an aggregation over (digest, place) rows without payload;
one range shuffle of the compressed payloads by doc_id, which meets the few rows about shared chunks on the way and
writes the packs.  Reading back, documents that own all their chunks are checked in place; only chunks that are shared
move, and equal documents are reconstructed once per root.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, new_path, stage, worker_cache

#: Chunks: a cut where the low MASK_BITS of the rolling hash are zero, at least LEAST and at most MOST ids.
MASK_BITS, LEAST, MOST = 9, 128, 4096

ENCODED = "doc_id long, uid long, n int, root binary, digests array<binary>, sizes array<int>, payload binary"
PACK = "doc_id long, uid long, part int, local_start long, n int, root binary, digests array<binary>, sizes array<int>, owned array<int>, lent array<int>, payload binary"


def digest(data: bytes) -> bytes:
    import hashlib

    return hashlib.blake2b(b"\0" + data, digest_size=16).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Pairs are hashed level by level; an odd node moves up as it is."""
    import hashlib

    while len(leaves) > 1:
        up = [hashlib.blake2b(b"\1" + a + b, digest_size=16).digest() for a, b in zip(leaves[::2], leaves[1::2])]
        leaves = up + leaves[len(up) * 2 :]
    return leaves[0] if leaves else b"\0" * 16


def gear_table(size: int):
    """A fixed 32-bit random number for each id (splitmix64 of the id)."""
    import numpy as np

    with np.errstate(over="ignore"):
        x = (np.arange(size, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(31))) >> np.uint64(32)).astype(np.uint32)


def cut_points(ids, gear) -> list[int]:
    """Ends of the chunks of one document.

    h[i] = sum of gear[ids[i - j]] << j modulo 2**32 over the last 32 ids, summed by doubling.
    """
    import numpy as np

    n = len(ids)
    if n <= LEAST:
        return [n]
    h = gear[ids]
    for k in (1, 2, 4, 8, 16):
        if k < n:
            h[k:] += h[:-k] << np.uint32(k)
    ends, last = [], 0
    # bits that ids further back can't reach are the low ones: take the cut bits from the top
    for c in (np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0) + 1).tolist():
        while c - last > MOST:
            last += MOST
            ends.append(last)
        if c - last >= LEAST:
            ends.append(c)
            last = c
    while n - last > MOST:
        last += MOST
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


class Encoder:
    """Whole texts to ids with a byte-level BPE of the tokenizers library.

    Its pre-tokenizer never joins characters over a single space between two characters that are not white space: the
    space begins the next pre-token.  So texts are cut there, every different piece of a batch is encoded once by the
    library, and the pieces' ids are put together.  One closing mark after letters is a pre-token of its own, so
    'word,' shares the ids of 'word'.

    A text that spells an added token of the vocabulary is encoded by one plain call of the library, which takes the
    token as such; with `plain_text` the library is told to read such spellings as ordinary text.

    Of the pieces, those of at most `longest` characters are kept: the first limit / 2 of them, then those that come a
    second time, up to `limit`.
    """

    MARKS = ".,!?;:"

    def __init__(self, path: str, dtype: str, limit: int = 600_000, longest: int = 12, plain_text: bool = False):
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, CharDelimiterSplit

        self.tok, self.words = Tokenizer.from_file(path), Tokenizer.from_file(path)
        added = [] if plain_text else [re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values() if t.content]
        self.tok.encode_special_tokens = self.words.encode_special_tokens = plain_text
        self.added = re.compile("|".join(added)) if added else None
        # Latin letters after a space are one pre-token: the same model gets them in its own spelling of bytes, parted already
        self.words.pre_tokenizer = CharDelimiterSplit(" ")
        spell = ByteLevel(add_prefix_space=False, use_regex=False)
        # one character for each byte of UTF-8; a zero byte stands for the space in front of a word, a space parts words
        byte = {}
        for c in map(chr, range(0x21, 0x250)):
            byte.update(zip(c.encode(), spell.pre_tokenize_str(c)[0][0]))
        self.spelling = "".join("\u0120" if b == 0 else byte.get(b, " ") for b in range(256))
        self.dtype, self.limit, self.longest = dtype, limit, longest
        self.known, self.heads, self.seen = {}, {}, np.zeros(1 << 23, bool)
        self.marks = dict(zip(self.MARKS, self.ids([*self.MARKS])))
        self.spaced = np.zeros(self.tok.get_vocab_size(), bool)
        self.spaced[[i for t, i in self.tok.get_vocab().items() if t.startswith("\u0120")]] = True  # how byte-level BPE writes a space

    def spell(self, words: list[str]) -> str:
        """' ' + word for each in the model's spelling of bytes, parted by spaces."""
        import codecs

        return codecs.charmap_decode(("\0" + " \0".join(words)).encode(), "strict", self.spelling)[0]

    def ids(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        return [np.array(e.ids, self.dtype).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def spaced_ids(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of ' ' + piece for each: long texts of many pieces, parted at the tokens that begin with a space."""
        import numpy as np

        out = {}
        odd = [x for x in pieces if " " in x]
        if odd:
            out.update(zip(odd, self.ids([" " + x for x in odd])))
            pieces = [x for x in pieces if " " not in x]
        latin, rest = [], []
        for x in pieces:
            (latin if x.isalpha() and (x.isascii() or max(x) < "\u0250") else rest).append(x)
        for text, kind, part in [
            *((self.spell(q), self.words, q) for at in range(0, len(latin), 20_000) if (q := latin[at : at + 20_000])),
            *((" " + " ".join(q), self.tok, q) for at in range(0, len(rest), 20_000) if (q := rest[at : at + 20_000])),
        ]:
            ids = np.array(kind.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
            begin = np.flatnonzero(self.spaced[ids])
            if len(begin) != len(part):
                out.update(zip(part, self.ids([" " + x for x in part])))
                continue
            raw, w = ids.tobytes(), ids.itemsize
            at_byte = (begin * w).tolist()
            out.update(zip(part, map(raw.__getitem__, map(slice, at_byte, [*at_byte[1:], len(raw)]))))
        return out

    def learn(self, new: set[str]) -> dict[str, bytes]:
        """Ids of pieces that are not known; some of them are known from now on."""
        import numpy as np

        known, marks = self.known, self.marks
        whole, stems = [], {}
        for x in new:
            if x[-1:] in marks and (stem := x[:-1]).isalpha():
                stems[x] = stem
            else:
                whole.append(x)
        need = set(stems.values()).difference(known)
        got = self.spaced_ids([*need.union(whole)])
        get = lambda stem: got[stem] if stem in got else known[stem]
        got.update({x: get(stem) + marks[x[-1]] for x, stem in stems.items()})
        if len(known) < self.limit:
            keep = [x for x in got if len(x) <= self.longest]
            at = np.fromiter(map(hash, keep), np.int64, len(keep)) & (len(self.seen) - 1)
            if len(known) < self.limit // 2:
                known.update({x: got[x] for x in keep})
            else:
                known.update({keep[i]: got[keep[i]] for i in np.flatnonzero(self.seen[at]).tolist()})
            self.seen[at] = True
        return got

    @staticmethod
    def pieces(text: str) -> list[str]:
        import re

        # only spaces and line ends are white space, and none of them next to a space: every space is a cut
        if text.replace("\n", "").isprintable() and not ("  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " "):
            return text.split(" ")
        return re.split(r"(?<=\S) (?=\S)", text)

    def encode(self, texts: list[str]) -> list[bytes]:
        odd = {k for k, t in enumerate(texts) if self.added.search(t)} if self.added else ()
        if odd:
            plain = dict(zip(sorted(odd), self.ids([texts[k] for k in sorted(odd)])))
            rest = iter(self.encode([t for k, t in enumerate(texts) if k not in odd]))
            return [plain[k] if k in odd else next(rest) for k in range(len(texts))]
        if not texts:
            return []
        known, heads = self.known, self.heads
        if len(heads) > 50_000:
            heads.clear()
        cut = [self.pieces(t) for t in texts]
        new = list({p[0] for p in cut}.difference(heads))
        heads.update(zip(new, self.ids(new)))
        first = [heads[p[0]] for p in cut]
        rest = [p[1:] for p in cut]
        found = [list(map(known.get, r)) for r in rest]
        gaps = [[i for i, x in enumerate(f) if x is None] if None in f else [] for f in found]
        got = self.learn({r[i] for r, g in zip(rest, gaps) for i in g})
        for r, f, g in zip(rest, found, gaps):
            for i in g:
                f[i] = got[r[i]]
        return [a + b"".join(f) for a, f in zip(first, found)]


def encode(docs: DataFrame, path: str, end_id: int = 0, plain_text: bool = False) -> DataFrame:
    """docs(doc_id, text) -> ENCODED rows, not yet stored; plain_text: spellings of added tokens are ordinary text."""
    from tokenizers import Tokenizer

    size = Tokenizer.from_file(path).get_vocab_size()
    dtype = "<u2" if size <= 1 << 16 else "<u4"

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        enc = worker_cache("token-store", (path, plain_text), lambda: Encoder(path, dtype, plain_text=plain_text))
        gear = worker_cache("gear", size, lambda: gear_table(max(size, end_id + 1)))
        pack, end = zstandard.ZstdCompressor(level=1), np.array([end_id], dtype).tobytes()
        uid, w = TaskContext.get().partitionId() << 36, np.dtype(dtype).itemsize
        for b in batches:
            ids, texts = b.column(0), [t or "" for t in b.column(1).to_pylist()]
            for at in range(0, len(texts), 256):
                n, root, digests, sizes, payload, uids = [], [], [], [], [], []
                for raw in enc.encode(texts[at : at + 256]):
                    raw += end
                    ends = cut_points(np.frombuffer(raw, dtype), gear)
                    begins = [0, *ends[:-1]]
                    d = [digest(raw[x * w : y * w]) for x, y in zip(begins, ends)]
                    n.append(ends[-1]), digests.append(d), sizes.append([y - x for x, y in zip(begins, ends)])
                    root.append(merkle_root(d)), payload.append(pack.compress(raw)), uids.append(uid)
                    uid += 1
                yield pa.RecordBatch.from_arrays(
                    [ids[at : at + 256], pa.array(uids, pa.int64()), pa.array(n, pa.int32()), pa.array(root, pa.binary()), pa.array(digests, pa.list_(pa.binary())), pa.array(sizes, pa.list_(pa.int32())), pa.array(payload, pa.binary())],
                    names=["doc_id", "uid", "n", "root", "digests", "sizes", "payload"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ENCODED)


def _chunks(data: bytes, sizes: list[int], width: int) -> list[bytes]:
    out, at = [], 0
    for s in sizes:
        out.append(data[at : at + s * width])
        at += s * width
    return out


def write(docs: DataFrame, path: str, folder: str | None = None, end_id: int = 0) -> str:
    """Store docs(doc_id, text) under folder (default: a new one in the shared folder) and return it.

    Null text: the end id only.  Null doc_ids come first.  Repeated rows are stored as documents of their own with the
    same root.  Empty table: empty packs.  Other columns are ignored.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "tokens")
    enc = stage(encode(docs, path, end_id), "encoded")
    places = enc.select("doc_id", "uid", F.posexplode("digests").alias("k", "digest"))
    place = F.struct("doc_id", "uid", "k")
    shared = places.groupBy("digest").agg(F.min(place).alias("own"), F.count("*").alias("c")).where("c > 1").select("digest", "own.uid", "own.k")
    shared = stage(shared.withColumnsRenamed({"uid": "o_uid", "k": "o_k", "digest": "o_digest"}), "shared-chunks")
    mine = (F.col("uid") == F.col("o_uid")) & (F.col("k") == F.col("o_k"))
    facts = (
        places.join(shared, F.col("digest") == F.col("o_digest"))
        .groupBy("doc_id", "uid")
        .agg(F.collect_list(F.when(~mine, F.col("k"))).alias("foreign"), F.collect_list(F.when(mine, F.col("k"))).alias("lent"))
    )
    none = F.lit(None)
    both = enc.select("*", none.cast("array<int>").alias("foreign"), none.cast("array<int>").alias("lent")).unionByName(facts, allowMissingColumns=True)
    both = both.select("doc_id", "uid", "n", "root", "digests", "sizes", "payload", "foreign", "lent")
    dealt = both.repartitionByRange("doc_id", "uid").sortWithinPartitions("doc_id", "uid", F.col("n").asc_nulls_first())

    def pack(batches):
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        part, start = TaskContext.get().partitionId(), 0
        z, unz = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        told = (None, [], [])
        schema = None
        for b in batches:
            rows = []
            for doc_id, uid, n, root, digests, sizes, payload, foreign, lent in zip(*(c.to_pylist() for c in b.columns)):
                if n is None:
                    told = (uid, foreign, lent)
                    continue
                away, given = (told[1], told[2]) if told[0] == uid else ((), ())
                owned = list(range(len(sizes)))
                if away:
                    gone = set(away)
                    owned = [k for k in owned if k not in gone]
                    data = unz.decompress(payload)
                    c = _chunks(data, sizes, len(data) // n)
                    payload = z.compress(b"".join(c[k] for k in owned))
                rows.append((doc_id, uid, part, start, n, root, digests, sizes, owned, sorted(given), payload))
                start += n
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
            names = [x.split()[0] for x in PACK.split(", ")]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    dealt.mapInArrow(pack, PACK).write.option("compression", "zstd").parquet(f"{folder}/packs")
    discard(enc)
    discard(shared)
    manifest(spark, folder).write.parquet(f"{folder}/manifest")
    return folder


MANIFEST = "part int, docs long, ids long, root binary"


def manifest(spark, folder: str) -> DataFrame:
    """A row for each pack of a store: its documents, their ids, and the Merkle root over the documents' roots in order."""

    def run(batches):
        import pyarrow as pa

        for t in _parts(batches):
            roots = t.column(3).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([t.column(0)[0].as_py()], pa.int32()), pa.array([len(roots)], pa.int64()), pa.array([sum(t.column(2).to_pylist())], pa.int64()), pa.array([merkle_root(roots)], pa.binary())], names=["part", "docs", "ids", "root"])

    rows = spark.read.schema(PACK).parquet(f"{folder}/packs").select("part", "local_start", "n", "root")
    return rows.repartition("part").sortWithinPartitions("part", "local_start").mapInArrow(run, MANIFEST)


def _parts(batches):
    """Arrow batches sorted by their first column -> one table for each value."""
    import numpy as np
    import pyarrow as pa

    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([held, t]) if held is not None else t
        k = t.column(0).to_numpy()
        at = 0
        for c in (np.flatnonzero(k[1:] != k[:-1]) + 1).tolist():
            yield t.slice(at, c - at)
            at = c
        held = t.slice(at)
    if held is not None and held.num_rows:
        yield held


def _checked(raw: bytes, sizes: list[int], digests: list[bytes], root: bytes, n: int) -> int:
    """crc32 of the ids as 32-bit numbers, after checking every chunk and the root."""
    import zlib

    import numpy as np

    width = len(raw) // n
    if [digest(c) for c in _chunks(raw, sizes, width)] != digests or merkle_root(digests) != root:
        raise ValueError("a document doesn't match its recipe")
    return zlib.crc32(np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes())


def read(spark, folder: str) -> DataFrame:
    """The documents of a store, reconstructed and verified: doc_id, start, n_tokens, ids_crc32, chunks, owned.

    start: ids of all documents before it in doc_id order.
    """
    packs = spark.read.schema(PACK).parquet(f"{folder}/packs")
    told = sorted(map(tuple, spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").collect()))  # one row a pack
    if told != sorted(map(tuple, manifest(spark, folder).collect())):
        raise ValueError("the packs don't match the manifest")
    offsets, at = [], 0
    for part, _, ids, _ in told:
        offsets.append((part, at))
        at += ids
    kinds = "root binary, n_tokens long, ids_crc32 long"
    whole = "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long, chunks int, owned int"

    def out(rows):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], names=["root", "n_tokens", "ids_crc32"])

    def in_place(batches):
        import pyarrow as pa
        import zstandard

        unz = zstandard.ZstdDecompressor()
        for b in batches:
            doc_id, part, start, *rest = b.columns
            crc = pa.array([_checked(unz.decompress(p), sizes, digests, root, n) for n, root, digests, sizes, p in zip(*(c.to_pylist() for c in rest))], pa.int64())
            chunks = pa.array([len(x) for x in rest[3].to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([doc_id, part, start, rest[0].cast(pa.int64()), crc, chunks, chunks], names=["doc_id", "part", "local_start", "n_tokens", "ids_crc32", "chunks", "owned"])

    full = F.size("owned") == F.size("digests")
    alone = packs.where(full).select("doc_id", "part", "local_start", "n", "root", "digests", "sizes", "payload").mapInArrow(in_place, whole)
    # the others: of each root the first document is put together from its own chunks and those others lend
    first = packs.where(~full).groupBy("root").agg(F.min(F.struct("doc_id", "uid")).alias("f")).select(F.col("f.uid").alias("f_uid"))
    mixed = packs.where(~full).join(first, F.col("uid") == F.col("f_uid"), "left_semi")

    def explode(lend: bool):
        def run(batches):
            import pyarrow as pa
            import zstandard

            unz = zstandard.ZstdDecompressor()
            for b in batches:
                rows = []
                for uid, n, digests, sizes, owned, lent, payload in zip(*(c.to_pylist() for c in b.columns)):
                    data = unz.decompress(payload)
                    total = sum(sizes[k] for k in owned)
                    have = dict(zip(owned, _chunks(data, [sizes[k] for k in owned], len(data) // total if total else 1)))
                    rows += [(uid, k, digests[k], have[k]) for k in (lent if lend else owned)]
                for i in range(0, len(rows), 2000):
                    c = list(zip(*rows[i : i + 2000]))
                    yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.binary()), pa.array(c[3], pa.binary())], names=["uid", "k", "digest", "data"])

        return run

    piece = "uid long, k int, digest binary, data binary"
    cols = ["uid", "n", "digests", "sizes", "owned", "lent", "payload"]
    own = mixed.select(*cols).mapInArrow(explode(False), piece).select("uid", "k", "data")
    lent = packs.where(F.size("lent") > 0).select(*cols).mapInArrow(explode(True), piece).select("digest", "data")
    wanted = mixed.select("uid", "owned", F.posexplode("digests").alias("k", "digest")).where(~F.array_contains("owned", F.col("k"))).select("uid", "k", "digest")
    fetched = wanted.join(lent, "digest").select("uid", "k", "data")
    recipe = mixed.select("uid", F.lit(-1).alias("k"), F.lit(None).cast("binary").alias("data"), "n", "root", "digests", "sizes")
    parts = own.unionByName(fetched).unionByName(recipe, allowMissingColumns=True)

    def assemble(batches):
        rows, head, held = [], None, []

        def close():
            n, root, digests, sizes = head
            rows.append((root, n, _checked(b"".join(held), sizes, digests, root, n)))

        for b in batches:
            for _, k, data, n, root, digests, sizes in zip(*(c.to_pylist() for c in b.columns)):
                if k < 0:
                    if head is not None:
                        close()
                    head, held = (n, root, digests, sizes), []
                else:
                    held.append(data)
            if rows:
                yield out(rows)
                rows = []
        if head is not None:
            close()
            yield out(rows)

    joined = parts.repartition("uid").sortWithinPartitions("uid", "k").select("uid", "k", "data", "n", "root", "digests", "sizes").mapInArrow(assemble, kinds)
    starts = spark.createDataFrame(offsets, "part int, before long")
    shared = packs.where(~full).select("doc_id", "part", "local_start", "root", F.size("digests").alias("chunks"), F.size("owned").alias("owned"))
    docs = alone.unionByName(shared.join(joined, "root").drop("root"))
    return docs.join(F.broadcast(starts), "part").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32", "chunks", "owned")
