"""SentencePiece encoding and decoding with exact N-best segmentations.

The vocabulary is that of a public SentencePiece model.  A unigram model's own log-probabilities are used; a BPE model
has none (its scores are ranks of merges), and there a piece's log-probability follows Zipf's law over its rank in the
file.  Both are taken in whole thousandths of a nat, so that scores add up exactly.  Characters that are no piece fall back to
their bytes.  The best segmentation is the highest sum over the piece lattice of the whole text.

N-best: a forward Viterbi pass gives every lattice node its best score from the start; these are exact heuristics for
a backward A-star search from the end, whose n-th completed path is the n-th best segmentation.

A piece has its word marks in front, so segmentations meet at every mark that follows another character and the
lattice falls apart into units there.  Units are solved once per worker, many at a time, with the two best scores of
each.  An n-best segmentation differs from the best only in the n - 1 units whose second-best segmentation costs
least (any other change is beaten by the best one and n - 1 single changes), so A-star runs over the lattice of those
units, joined in text order, with the rest of the text fixed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trim, worker_cache

MARK = "▁"
#: ids of the byte pieces begin here in SentencePiece models with byte fallback; `score` thousandths of a nat below the rarest piece.
BYTE_PENALTY = 10_000

SCHEMA = "ids array<int>, n_tokens int, ids_crc32 long, score long, n_best int, losses array<long>, edits array<array<struct<unit: int, ids: array<int>>>>, decoded string"


def piece_scores(own: list[float]) -> list[int]:
    """Thousandths of a nat of each piece from the scores in its model.

    Scores that are all whole numbers are ranks, not log-probabilities: Zipf's law over the order of the pieces then.
    """
    import math

    if any(x != int(x) for x in own):
        return [round(1000 * x) for x in own]
    h = math.log(sum(1 / (r + 2) for r in range(len(own))))
    return [-round(1000 * (math.log(r + 2) + h)) for r in range(len(own))]


class Pieces:
    """The vocabulary: pieces, scores, byte pieces and a trie with vectorised transitions."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        names = [sp.id_to_piece(i) for i in range(n)]
        self.byte_id = {int(names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.id = {names[i]: i for i in range(n) if not special[i] and not sp.is_byte(i)}
        bad = [p for p in self.id if MARK in p.lstrip(MARK)]
        if bad or len(self.byte_id) != 256:
            raise ValueError("a model with byte fallback and word marks only in front of pieces is needed")
        self.score = dict(zip(self.id.values(), piece_scores([sp.get_score(i) for i in self.id.values()])))
        self.code = "H" if n <= 1 << 16 else "I"
        self.byte_score = min(self.score.values()) - BYTE_PENALTY
        self.bytes = [b""] * n
        for p, i in self.id.items():
            self.bytes[i] = p.replace(MARK, " ").encode()
        for b, i in self.byte_id.items():
            self.bytes[i] = bytes([b])
        self._trie()

    def _trie(self):
        import numpy as np

        child, end = {}, [-1]
        for p, i in self.id.items():
            node = 0
            for c in p:
                key = node << 21 | ord(c)
                if key not in child:
                    child[key] = len(end)
                    end.append(-1)
                node = child[key]
            end[node] = i
        self.child, self.end = child, end
        self.end_id = np.array(end, np.int32)
        self.end_score = np.array([self.score[i] if i >= 0 else 0 for i in end], np.int64)
        keys = np.array(sorted(child), np.int64)
        # open addressing with linear probing, at most a quarter full
        bits = max(4, int(len(keys) * 4).bit_length())
        self.shift, size = np.uint64(64 - bits), 1 << bits
        slot_key, slot_to = np.full(size, -1, np.int64), np.full(size, -1, np.int32)
        home = self._home(keys)
        self.probes = 1
        for k, s in zip(keys.tolist(), home.tolist()):
            probe = 1
            while slot_key[s] >= 0:
                s = (s + 1) & (size - 1)
                probe += 1
            slot_key[s], slot_to[s] = k, child[k]
            self.probes = max(self.probes, probe)
        self.slot_key, self.slot_to = slot_key, slot_to

    def _home(self, keys):
        import numpy as np

        with np.errstate(over="ignore"):
            return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def step(self, node, char):
        """Vectorised transition: the child of each node by each character, -1 if there is none."""
        import numpy as np

        key = node.astype(np.int64) << 21 | char
        at = self._home(key)
        out = np.where(self.slot_key[at] == key, self.slot_to[at], -1)
        left = np.flatnonzero((out < 0) & (self.slot_key[at] >= 0))
        for p in range(1, self.probes):
            if not len(left):
                break
            s = (at[left] + p) & (len(self.slot_key) - 1)
            hit = self.slot_key[s] == key[left]
            out[left[hit]] = self.slot_to[s[hit]]
            left = left[~hit & (self.slot_key[s] >= 0)]
        return out

    def fallback(self, c: str) -> tuple[list[int], int]:
        raw = c.encode("utf-8", "surrogatepass")
        return [self.byte_id[b] for b in raw], self.byte_score * len(raw)

    def edges(self, unit: str) -> list[list[tuple[int, object, int]]]:
        """Lattice of one unit: for each end position the edges (start, ids, score) into it."""
        into: list[list[tuple[int, object, int]]] = [[] for _ in range(len(unit) + 1)]
        for i in range(len(unit)):
            node, j, alone = 0, i, False
            while j < len(unit) and (node := self.child.get(node << 21 | ord(unit[j]), -1)) >= 0:
                j += 1
                if self.end[node] >= 0:
                    into[j].append((i, (self.end[node],), self.score[self.end[node]]))
                    alone = alone or j == i + 1
            if not alone:
                ids, s = self.fallback(unit[i])
                into[i + 1].append((i, tuple(ids), s))
        return into


def nbest(into: list[list[tuple[int, object, int]]], n: int) -> list[tuple[int, list]]:
    """The n best paths of a lattice as (score, [(start, end, ids), ...]): Viterbi forward, A-star backward.

    Of equal promises the one nearest to the start goes first, so a lattice of many equal paths costs n paths only.
    """
    import heapq

    size = len(into)
    best = [0] + [None] * (size - 1)
    for j in range(1, size):
        best[j] = max((best[i] + s for i, _, s in into[j] if best[i] is not None), default=None)
    heap, made, out = [(-(best[-1] or 0), size - 1, 0, 0, None)], 0, []
    while heap and len(out) < n:
        total, j, _, behind, path = heapq.heappop(heap)
        if j == 0:
            steps = []
            while path is not None:
                step, path = path
                steps.append(step)
            out.append((-total, steps))
            continue
        for i, ids, s in into[j]:
            if best[i] is not None:
                made += 1
                heapq.heappush(heap, (-(best[i] + s + behind), i, made, behind + s, ((i, j, ids), path)))
    return out


def solve(units: list[str], v: Pieces) -> tuple[list[list[int]], "np.ndarray", "np.ndarray"]:  # noqa: F821
    """Best ids, best score and loss of the second-best segmentation (a huge number if there is none) of each unit."""
    import numpy as np

    order = sorted(range(len(units)), key=lambda k: len(units[k]))
    ids: list = [None] * len(units)
    score, loss = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and (to - at + 1) * (len(units[order[to]]) + 1) <= 100_000:
            to += 1
        part = order[at:to]
        at = to
        a, b, c = _solve_block([units[k] for k in part], v)
        for k, x in zip(part, a):
            ids[k] = x
        score[part], loss[part] = b, c
    return ids, score, loss


NONE = -(1 << 60)


def _solve_block(units: list[str], v: Pieces):
    import numpy as np

    n = len(units)
    length = np.array([len(u) for u in units])
    char = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    first = np.cumsum(length) - length
    unit = np.repeat(np.arange(n), length)
    here = np.arange(len(char))
    rel, room = here - first[unit], first[unit] + length[unit] - here
    # edges: walk the trie from every position at once
    node, live, depth = np.zeros(len(char), np.int32), here, 0
    single = np.zeros(len(char), bool)
    es, el, eid, esc = [], [], [], []
    while len(live):
        node = v.step(node, char[live + depth])
        ok = node >= 0
        node, live = node[ok], live[ok]
        depth += 1
        done = v.end_id[node] >= 0
        if done.any():
            p = live[done]
            if depth == 1:
                single[p] = True
            es.append(p), el.append(np.full(len(p), depth)), eid.append(v.end_id[node[done]]), esc.append(v.end_score[node[done]])
        more = room[live] > depth
        node, live = node[more], live[more]
    odd = np.flatnonzero(~single)
    if len(odd):
        c = char[odd]
        width = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
        es.append(odd), el.append(np.ones(len(odd), np.int64)), eid.append((-1 - c).astype(np.int32)), esc.append(width * v.byte_score)
    es, el, eid, esc = (np.concatenate(x) for x in (es, el, eid, esc))
    end = rel[es] + el
    by = np.lexsort((el, unit[es], end))
    es, el, eid, esc, end = es[by], el[by], eid[by].astype(np.int64), esc[by], end[by]
    eu = unit[es]
    top = int(length.max())
    one, two = np.full((n, top + 1), NONE), np.full((n, top + 1), NONE)
    back = np.full((n, top + 1), -1)
    one[:, 0] = 0
    bounds = np.searchsorted(end, np.arange(1, top + 2))
    for j in range(1, top + 1):
        a, b = bounds[j - 1], bounds[j]
        if a == b:
            continue
        u, s, start = eu[a:b], esc[a:b], j - el[a:b]
        x, y = one[u, start] + s, two[u, start] + s
        begin = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
        w = u[begin]
        m = np.maximum.reduceat(x, begin)
        size = np.diff(np.concatenate([begin, [b - a]]))
        is_top = x == np.repeat(m, size)
        nth = np.cumsum(is_top)
        base = np.repeat(nth[begin] - is_top[begin], size)
        is_first = is_top & (nth - base == 1)
        one[w, j], back[w, j] = m, a + np.flatnonzero(is_first)
        two[w, j] = np.maximum(np.maximum.reduceat(np.where(is_first, NONE, x), begin), np.maximum.reduceat(y, begin))
    rows = np.arange(n)
    score, second = one[rows, length], two[rows, length]
    loss = np.where(second < NONE // 2, 1 << 60, score - second)
    # paths, from the ends
    cur, got = length.copy(), []
    while (act := np.flatnonzero(cur > 0)).size:
        e = back[act, cur[act]]
        step = np.full(n, 0, np.int64)
        step[act] = eid[e] + (1 << 31)
        got.append(step)
        cur[act] -= el[e]
    table = np.stack(got[::-1], axis=1)
    filled = table != 0
    flat = (table[filled] - (1 << 31)).tolist()
    ends = np.cumsum(filled.sum(axis=1)).tolist()
    ids = [flat[x:y] for x, y in zip([0, *ends[:-1]], ends)]
    if len(odd):
        for k in np.unique(unit[odd]).tolist():
            ids[k] = [t for i in ids[k] for t in ((i,) if i >= 0 else v.fallback(chr(-1 - i))[0])]
    return ids, score, loss


def units_of(text: str) -> list[str]:
    """The units of mark + text, each without its first mark; none for an empty text."""
    import re

    if not text:
        return []
    text = text.replace(MARK, " ")
    if text[0] != " " and "  " not in text:
        return text.split(" ")
    return [u[1:].replace(" ", MARK) for u in re.findall(" +[^ ]*", " " + text)]


class Segmenter:
    """Encodes and decodes whole texts.

    The first `limit` units of at most `longest` characters stay solved (frequent units come early); the others are
    solved anew in each batch of texts that has them.  The limit bounds memory only, about 180 bytes a unit.
    """

    def __init__(self, pieces: str | Pieces, limit: int = 50_000, longest: int = 12):
        import numpy as np

        self.v, self.limit, self.longest = pieces if isinstance(pieces, Pieces) else Pieces(pieces), limit, longest
        self.known, self.ids, self.score, self.loss = {}, [], np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, units: set[str]) -> list[str]:
        """Solve what is not known; returns the units that are to be forgotten after the batch."""
        import array

        import numpy as np

        new = sorted(units.difference(self.known), key=len)
        keep = 0
        while keep < len(new) and len(new[keep]) <= self.longest and len(self.known) + keep < self.limit:
            keep += 1
        if new:
            ids, score, loss = solve([MARK + u for u in new], self.v)
            self.known.update(zip(new, range(len(self.ids), len(self.ids) + len(new))))
            self.ids += [array.array(self.v.code, x).tobytes() for x in ids]
            self.score, self.loss = np.concatenate([self.score, score]), np.concatenate([self.loss, loss])
        return new[keep:]

    def forget(self, units: list[str]) -> None:
        for u in units:
            del self.known[u]
        n = len(self.known)
        del self.ids[n:]
        self.score, self.loss = self.score[:n].copy(), self.loss[:n].copy()

    def encode(self, texts: list[str], n_best: int) -> list[tuple]:
        """(ids as bytes, 16 bits each where the vocabulary allows it, score, [(loss, [(unit, ids), ...]), ...]) of each text, the best segmentation first."""
        import numpy as np

        cut = [units_of(t) for t in texts]
        passing = self.learn(set().union(*cut))
        out = []
        for units in cut:
            if not units:
                out.append((b"", 0, [(0, [])]))
                continue
            at = np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))
            raw = b"".join(map(self.ids.__getitem__, at.tolist()))
            loss = self.loss[at]
            few = np.sort(np.argpartition(loss, n_best - 2)[: n_best - 1] if len(units) >= n_best > 1 else np.arange(len(units) if n_best > 1 else 0))
            out.append((raw, int(self.score[at].sum()), self.alternatives([(int(k), units[k]) for k in few], n_best)))
        self.forget(passing)
        return out

    def alternatives(self, few: list[tuple[int, str]], n: int) -> list[tuple[int, list]]:
        into, place, shift = [[]], [], 0
        for k, u in few:
            e = self.v.edges(MARK + u)
            into += [[(i + shift, ids, s) for i, ids, s in x] for x in e[1:]]
            place.append((shift, shift + len(u) + 1, k))
            shift += len(u) + 1
        if len(into) == 1:
            return [(0, [])]
        found = nbest(into, n)
        cut = lambda steps: [[t for i, _, ids in steps if a <= i < b for t in ids] for a, b, _ in place]
        paths = [(s, cut(steps)) for s, steps in found]
        top_score, top = paths[0]
        return [(top_score - s, [(k, x) for (_, _, k), x, y in zip(place, p, top) if x != y]) for s, p in paths]

    def decode(self, raw: bytes) -> str:
        import array

        text = b"".join(map(self.v.bytes.__getitem__, array.array(self.v.code, raw))).decode("utf-8", "replace")
        return text[1:]


def encode(docs: DataFrame, path: str, n_best: int = 4, keep_ids: bool = True) -> DataFrame:
    """docs + the columns of SCHEMA; with keep_ids=False ids is null and only what is derived from them stays.

    losses: how much worse than the best each of the n_best segmentations is (the first is 0), in thousandths of a nat;
    edits: for each the units (words) that are segmented otherwise.  decoded: the text from the ids alone.

    Null and empty texts have no ids, one (empty) segmentation and decode to an empty text.  The word mark U+2581 in a
    text counts as a space.  Whole texts of any length.  Columns of the same names are replaced, others pass through.
    """
    from pyspark.sql.types import StructType, _parse_datatype_string

    extra = _parse_datatype_string(SCHEMA)
    docs = docs.drop(*extra.fieldNames())
    schema = StructType([*docs.schema.fields, *extra.fields])

    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        # solved units go with the task: an executor has more idle workers than tasks, and each would keep its own
        seg = Segmenter(worker_cache("pieces", path, lambda: Pieces(path)))
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.list_(pa.struct([("unit", pa.int32()), ("ids", pa.list_(pa.int32()))]))), pa.string()]
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                texts = [t or "" for t in part.column(part.schema.get_field_index("text")).to_pylist()]
                rows, wide = [], []
                for raw, score, alts in seg.encode(texts, n_best):
                    ids = np.frombuffer(raw, seg.v.code).astype("<i4")
                    wide.append(ids)
                    edits = [[{"unit": k, "ids": x} for k, x in e] for _, e in alts]
                    rows.append((len(ids), zlib.crc32(ids.tobytes()), score, len(alts), [a for a, _ in alts], edits, seg.decode(raw)))
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in wide])]).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(wide))) if keep_ids else pa.nulls(len(wide), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, listed, *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], names=[*part.schema.names, *extra.fieldNames()])
        del seg
        trim()

    return docs.mapInArrow(run, schema)
