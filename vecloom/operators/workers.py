"""What Python workers run: NumPy scoring, bounded top-k, graph walks.  Shipped by value."""

from __future__ import annotations


def matrix(column, dtype="float64"):
    """An Arrow list column without nulls as a 2-d array; all lists must have one length."""
    import numpy as np

    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), dtype)


def lengths(column):
    import pyarrow.compute as pc

    return pc.list_value_length(column).to_numpy(zero_copy_only=False)


def exact_scores(x, y, metric: str):
    """Scores of row pairs (double, one fixed order of summation, so equal vectors score equally)."""
    import numpy as np

    if metric == "l2":
        return np.sqrt(((x - y) ** 2).sum(axis=1))
    if metric == "l1":
        return np.abs(x - y).sum(axis=1)
    dot = (x * y).sum(axis=1)
    if metric == "dot":
        return dot
    n = np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1))
    return np.divide(dot, n, out=np.zeros_like(dot), where=n > 0)


def rough_keys(rows, queries, metric: str):
    """(rows, queries) keys, smaller is closer, by matrix products; and a bound of their error."""
    import numpy as np

    if metric == "l1":
        out = np.empty((len(rows), len(queries)))
        for j, q in enumerate(queries):
            out[:, j] = np.abs(rows - q).sum(axis=1)
        return out, 1e-9 * (1 + float(out.max(initial=0)))
    dot = rows @ queries.T
    if metric == "dot":
        return -dot, 1e-9 * (1 + float(np.abs(dot).max(initial=0)))
    rr, qq = (rows * rows).sum(axis=1), (queries * queries).sum(axis=1)
    if metric == "cosine":
        n = np.sqrt(rr)[:, None] * np.sqrt(qq)[None, :]
        return -np.divide(dot, n, out=np.zeros_like(dot), where=n > 0), 1e-9
    return np.sqrt(np.maximum(0, rr[:, None] + qq[None, :] - 2 * dot)), 2e-7 * (1 + float(np.sqrt(max(rr.max(initial=0), qq.max(initial=0)))))


class TopK:
    """Running k best (key, id) of each query over blocks of rows.

    bound: for each query an exact key that k rows are known to reach (they may come yet); no row beyond it is kept.
    """

    def __init__(self, qids, queries, metric: str, k: int, radius: float | None, bound=None):
        import numpy as np

        self.qids, self.queries, self.metric, self.k, self.radius = qids, queries, metric, k, radius
        self.sign = 1.0 if metric in ("l2", "l1") else -1.0
        self.kept = [(np.zeros(0), np.zeros(0, np.int64)) for _ in qids]
        self.bound = np.full(len(qids), np.inf) if bound is None else np.array(bound, np.float64)
        if radius is not None:
            self.bound = np.minimum(self.bound, self.sign * radius)

    def add(self, ids, rows) -> None:
        import numpy as np

        if not len(ids):
            return
        keys, slack = rough_keys(rows, self.queries, self.metric)
        keys = np.ascontiguousarray(keys.T)
        for j in range(len(self.qids)):
            have, have_ids = self.kept[j]
            key = keys[j]
            if len(have) >= self.k:
                cand = np.flatnonzero(key <= min(self.bound[j], have.max()) + slack)
            elif np.isfinite(self.bound[j]):
                cand = np.flatnonzero(key <= self.bound[j] + slack)
            elif len(key) > self.k:
                cand = np.flatnonzero(key <= np.partition(key, self.k - 1)[self.k - 1] + 2 * slack)
            else:
                cand = np.flatnonzero(~np.isnan(key))
            if not len(cand):
                continue
            exact = self.sign * exact_scores(rows[cand], np.broadcast_to(self.queries[j], (len(cand), self.queries.shape[1])), self.metric)
            ok = ~np.isnan(exact)
            if self.radius is not None:
                ok &= exact <= self.sign * self.radius
            a, b = np.concatenate([have, exact[ok]]), np.concatenate([have_ids, ids[cand][ok]])
            order = np.lexsort((b, a))[: self.k]
            self.kept[j] = a[order], b[order]

    def add_batch(self, ids, vecs) -> None:
        """Arrow columns, in steps that bound the table of keys; a vector of another length is an error."""
        bad = lengths(vecs) != self.queries.shape[1]
        if bad.any():
            raise ValueError(f"the vector of id {ids[int(bad.argmax())].as_py()} has another length than the query")
        step = max(256, 8_000_000 // max(1, len(self.qids)))
        for at in range(0, len(ids), step):
            self.add(ids[at : at + step].to_numpy(), matrix(vecs[at : at + step]))

    def batch(self):
        import numpy as np
        import pyarrow as pa

        qid = np.repeat(np.asarray(self.qids, np.int64), [len(a) for a, _ in self.kept])
        key = np.concatenate([a for a, _ in self.kept]) if self.kept else np.zeros(0)
        ids = np.concatenate([b for _, b in self.kept]) if self.kept else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(qid), pa.array(ids), pa.array(self.sign * key)], names=["qid", "id", "score"])


def close_pairs(ids, x, ids2, y, metric: str, threshold: float, same: bool):
    """(a, b, score) arrays of the pairs of a row of x and one of y within the threshold, a < b; same: y is x, each pair once."""
    import numpy as np

    if not len(x) or not len(y):
        return
    sign = 1.0 if metric in ("l2", "l1") else -1.0
    if metric == "cosine":  # float32 products of unit rows; their error is far below the slack
        u, v, slack = unit_rows(x).astype(np.float32), unit_rows(y).astype(np.float32), 1e-6 * (16 + x.shape[1])
    step = max(1, 8_000_000 // len(y))
    for s in range(0, len(x), step):
        if metric == "cosine":
            keys = -(u[s : s + step] @ v.T)
        else:
            keys, slack = rough_keys(x[s : s + step], y, metric)
        near, far = np.nonzero(keys <= sign * threshold + slack)
        near += s
        ok = ids[near] < ids2[far] if same else ids[near] != ids2[far]
        near, far = near[ok], far[ok]
        for at in range(0, len(near), 50_000):
            i, j = near[at : at + 50_000], far[at : at + 50_000]
            score = exact_scores(x[i], y[j], metric)
            ok = sign * score <= sign * threshold
            a, b = ids[i[ok]], ids2[j[ok]]
            yield np.minimum(a, b), np.maximum(a, b), score[ok]


def splitmix64(x: int) -> int:
    m = (1 << 64) - 1
    x = (x + 0x9E3779B97F4A7C15) & m
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & m
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & m
    return x ^ (x >> 31)


def unit_rows(x):
    """Rows scaled to length one; a zero row stays."""
    import numpy as np

    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def sq8_codes(x, offset: float, scale: float):
    """Every element as one of 256 codes, in float32 arithmetic; NaN is code 0."""
    import numpy as np

    t = (np.asarray(x, np.float32) - np.float32(offset)) / np.float32(scale) + np.float32(0.5)
    return np.where(t > 0, np.minimum(np.floor(np.where(t > 0, t, 0)), 255), 0).astype(np.uint8)


def sq8_pack(x, offset: float, scale: float) -> list[bytes]:
    """Each row as bytes: its length (u4), the norm of what the codes miss (f4), its codes, and (u4 position, f4 value) of
    every element that is no code's, as it lies outside of their range."""
    import numpy as np

    x = np.asarray(x, np.float32)
    codes = sq8_codes(x, offset, scale)
    back = offset + scale * codes.astype(np.float64)
    wide = np.abs(x - back) > 0.501 * scale
    back[wide] = x[wide]
    miss = np.sqrt(np.square(x - back).sum(axis=1)) * (1 + 1e-6) + 1e-12
    head = np.empty((len(x), 8 + x.shape[1]), np.uint8)
    head[:, :4] = np.full((len(x), 1), x.shape[1], "<u4").view(np.uint8)
    head[:, 4:8] = np.where(np.isnan(miss), np.inf, miss).astype("<f4").reshape(-1, 1).view(np.uint8)
    head[:, 8:] = codes
    out = [h.tobytes() for h in head]
    for i in np.flatnonzero(wide.any(axis=1)).tolist():
        at = np.flatnonzero(wide[i])
        tail = np.empty(len(at), [("at", "<u4"), ("x", "<f4")])
        tail["at"], tail["x"] = at, x[i, at]
        out[i] += tail.tobytes()
    return out


def sq8_unpack(column, dims: int, offset: float, scale: float):
    """(rows, norm of what each misses) of an Arrow column of sq8_pack; of bare codes nobody knows what they miss (inf)."""
    import numpy as np

    raw = column.to_pylist()
    n, data, size = len(raw), np.frombuffer(b"".join(raw), np.uint8), np.array([len(r) for r in raw], np.int64)
    start, bare = np.cumsum(size) - size, size == dims
    miss, has = np.full(n, np.inf), np.flatnonzero(~bare)
    if (size[has] < dims + 8).any():
        raise ValueError("a row of codes has another length than the query")
    if len(has):
        head = data[start[has, None] + np.arange(8)]
        if (np.ascontiguousarray(head[:, :4]).view("<u4") != dims).any():
            raise ValueError("a row of codes has another length than the query")
        miss[has] = np.ascontiguousarray(head[:, 4:]).view("<f4")[:, 0]
    first = start + np.where(bare, 0, 8)
    x = offset + scale * data[first[:, None] + np.arange(dims)].astype(np.float64)
    more = np.where(bare, 0, (size - dims - 8) // 8)
    if more.any():
        at = np.repeat(first + dims, more) + 8 * (np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more))
        tail = data[at[:, None] + np.arange(8)]
        x[np.repeat(np.arange(n), more), np.ascontiguousarray(tail[:, :4]).view("<u4")[:, 0]] = np.ascontiguousarray(tail[:, 4:]).view("<f4")[:, 0]
    return x, miss


class Graph:
    """A hierarchical navigable small-world graph over the rows of one shard, held in arrays.

    Level 0 has every node and 2 m links each, a level above it the nodes whose level reaches it and m links each; a
    node's level depends on the seed and its id alone.  A missing link is -1.  Instead of inserting row by row, a level
    takes each node's closest rows by matrix products, keeps those that are closer to the node than to any neighbour
    kept before, and links back; what no walk reaches then is linked from its closest reachable node.
    """

    def __init__(self, rows, ids, metric: str, m: int = 16, ef_construction: int = 200, seed: int = 1):
        import numpy as np

        self.ids, self.metric, self.m, self.efc, self.seed = np.asarray(ids, np.int64), metric, m, ef_construction, seed
        self.x = np.asarray(unit_rows(rows) if metric == "cosine" else rows, np.float32)
        self.nodes: list = []  # nodes of each level, ascending
        self.links: list = []  # their links
        self.entry, self.unreachable, self.repaired = -1, 0, 0

    # distances; smaller is closer

    def keys(self, q, nodes):
        """Keys of the rows `nodes` to the vectors q, one each (or one q for all)."""
        import numpy as np

        x = self.x[nodes]
        if self.metric == "l2":
            return np.square(x - q).sum(axis=-1)
        return np.abs(x - q).sum(axis=-1) if self.metric == "l1" else -(x * q).sum(axis=-1)

    def table(self, rows, cols):
        """Keys between all of rows and all of cols."""
        import numpy as np

        a, b = self.x[rows], self.x[cols]
        if self.metric == "l1":
            return np.stack([np.abs(b - r).sum(axis=1) for r in a]) if len(a) else np.zeros((0, len(b)), np.float32)
        dot = a @ b.T
        return np.square(a).sum(axis=1)[:, None] + np.square(b).sum(axis=1)[None] - 2 * dot if self.metric == "l2" else -dot

    # build

    def levels(self):
        import math

        import numpy as np

        u = [(splitmix64(self.seed ^ splitmix64(int(i) & ((1 << 64) - 1))) >> 11) / (1 << 53) for i in self.ids]
        return np.array([int(-math.log(x or 2.0**-53) / math.log(self.m)) for x in u], np.int64)

    def build(self) -> "Graph":
        import numpy as np

        top = self.levels()
        self.nodes, self.links = [], []
        for k in range(int(top.max(initial=-1)) + 1):
            at = np.flatnonzero(top >= k)
            self.nodes.append(at)
            self.links.append(self.connect(at, self.m * (2 if k == 0 else 1)))
        if len(self.ids):
            self.entry = int(self.nodes[-1][0])
            self.repaired = self.repair()
        return self

    def connect(self, at, most: int):
        """Links of the nodes `at` among themselves: (len(at), most) node numbers, -1 where there is none."""
        import numpy as np

        n = len(at)
        look = min(n - 1, max(self.efc // 4, most + most // 2))
        out = np.full((n, most), -1, np.int32)
        if look < 1:
            return out
        half = max(1, most // 2)
        step = max(1, (1 << 21) // n)
        ahead = np.full((n, half), -1, np.int64)
        for s in range(0, n, step):
            d = self.table(at[s : s + step], at)
            d[np.arange(len(d)), np.arange(s, s + len(d))] = np.inf
            near = np.argpartition(d, look - 1, axis=1)[:, :look]
            key = np.take_along_axis(d, near, 1)
            order = np.lexsort((near, key), axis=1)
            ahead[s : s + step] = self.spread(at, np.take_along_axis(near, order, 1), np.take_along_axis(key, order, 1), half)
        # links back, the closest first, as far as there is room
        src, col = np.nonzero(ahead >= 0)
        dst = ahead[src, col]
        a, b = np.concatenate([src, dst]), np.concatenate([dst, src])
        both = np.unique(np.stack([a, b]), axis=1)
        a, b = both
        own = np.zeros(len(a), bool)
        known = set(zip(src.tolist(), dst.tolist()))
        own[:] = [(x, y) in known for x, y in zip(a.tolist(), b.tolist())]
        key = self.keys(self.x[at[a]], at[b])
        order = np.lexsort((b, key, ~own, a))
        a, b = a[order], b[order]
        rank = np.arange(len(a)) - np.searchsorted(a, a)
        ok = rank < most
        out[a[ok], rank[ok]] = at[b[ok]]
        return out

    def spread(self, at, near, key, most: int):
        """Of each row's candidates (ascending keys) those closer to the row than to any chosen one, then the closest of the rest."""
        import numpy as np

        n, c = near.shape
        out = np.full((n, most), -1, np.int64)
        step = max(1, (1 << 23) // max(1, c * c * self.x.shape[1] // 8 + 1))
        for s in range(0, n, step):
            nb, k = near[s : s + step], key[s : s + step]
            x = self.x[at[nb]]
            if self.metric == "l1":
                among = np.stack([np.abs(x - x[:, [j]]).sum(axis=2) for j in range(c)], axis=2)
            else:
                dot = np.matmul(x, x.transpose(0, 2, 1))
                sq = np.square(x).sum(axis=2)
                among = sq[:, :, None] + sq[:, None, :] - 2 * dot if self.metric == "l2" else -dot
            chosen, count = np.zeros(nb.shape, bool), np.zeros(len(nb), np.int64)
            for j in range(c):
                blocked = (chosen & (among[:, j, :] <= k[:, [j]])).any(axis=1)
                take = ~blocked & (count < most)
                chosen[:, j] = take
                count += take
            place = np.argsort(~chosen, axis=1, kind="stable")[:, :most]
            got = np.take_along_axis(nb, place, 1)
            out[s : s + step, : got.shape[1]] = got
        return out

    def reached(self):
        """Which nodes a walk on level 0 can reach from the entry: a boolean for each."""
        import numpy as np

        seen = np.zeros(len(self.ids), bool)
        front = np.array([self.entry]) if self.entry >= 0 else np.zeros(0, np.int64)
        while len(front):
            seen[front] = True
            nxt = np.unique(self.links[0][front])
            front = nxt[(nxt >= 0)]
            front = front[~seen[front]]
        return seen

    def repair(self) -> int:
        """Link every node that no walk reaches from its closest reachable one, in place of its last link; returns how many there were."""
        import numpy as np

        fixed, room = 0, self.links[0].shape[1]
        for _ in range(50):
            seen = self.reached()
            lost = np.flatnonzero(~seen)
            if not len(lost):
                break
            there = np.flatnonzero(seen)
            i = int(lost[0])
            host = int(there[int(np.argmin(self.table([i], there)[0]))])
            row = self.links[0][host]
            free = np.flatnonzero(row < 0)
            if len(free):
                row[free[0]] = i
            else:  # the graph grows by a column rather than losing a link
                self.links[0] = np.concatenate([self.links[0], np.full((len(self.ids), 1), -1, np.int32)], axis=1)
                self.links[0][host, room] = i
                room += 1
            fixed += 1
        self.unreachable = int((~self.reached()).sum())
        return fixed

    # search

    def beam(self, q, start, ef: int, level: int, width: int = 4):
        """The ef closest nodes that walks on a level from start find, for all rows of q at once: (keys, nodes), ascending, -1 beyond."""
        import numpy as np

        n, at, links = len(q), self.nodes[level], self.links[level]
        whole = len(at) == len(self.ids)
        ef = min(ef, len(at))
        width = min(width, ef)
        keys, nodes, done = np.full((n, ef), np.inf, np.float32), np.full((n, ef), -1, np.int64), np.ones((n, ef), bool)
        seen = np.zeros((n, len(self.ids)), bool)
        seen[np.arange(n), start] = True
        keys[:, 0], nodes[:, 0], done[:, 0] = self.keys(q, start), start, False
        while True:
            todo = np.where(done, np.inf, keys)
            row = np.flatnonzero(np.isfinite(todo).any(axis=1))
            if not len(row):
                break
            pick = np.argpartition(todo[row], width - 1, axis=1)[:, :width] if width < ef else np.broadcast_to(np.arange(ef), (len(row), ef))
            open_ = np.isfinite(np.take_along_axis(todo[row], pick, 1))
            done[row[:, None], pick] = True
            r, c = np.nonzero(open_)
            from_ = nodes[row[r], pick[r, c]]
            nb = links[from_ if whole else np.searchsorted(at, from_)]
            i, j = np.nonzero(nb >= 0)
            who, new = r[i], nb[i, j].astype(np.int64)
            fresh = ~seen[row[who], new]
            who, new = who[fresh], new[fresh]
            if not len(new):
                continue
            pair = np.unique(who * len(self.ids) + new)  # two expanded nodes may share a neighbour
            who, new = pair // len(self.ids), pair % len(self.ids)
            seen[row[who], new] = True
            k = np.concatenate([self.keys(q[row[who[s : s + 200_000]]], new[s : s + 200_000]) for s in range(0, len(new), 200_000)])
            count = np.bincount(who, minlength=len(row))
            col = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
            more = int(count.max())
            nk, nn = np.full((len(row), more), np.inf, np.float32), np.full((len(row), more), -1, np.int64)
            nk[who, col], nn[who, col] = k, new
            k2, n2 = np.concatenate([keys[row], nk], axis=1), np.concatenate([nodes[row], nn], axis=1)
            d2 = np.concatenate([done[row], np.zeros(nk.shape, bool)], axis=1)
            best = np.argpartition(k2, ef - 1, axis=1)[:, :ef]
            keys[row], nodes[row], done[row] = np.take_along_axis(k2, best, 1), np.take_along_axis(n2, best, 1), np.take_along_axis(d2, best, 1)
            done[row] |= nodes[row] < 0
        order = np.lexsort((nodes, keys), axis=1)
        return np.take_along_axis(keys, order, 1), np.take_along_axis(nodes, order, 1)

    def descend(self, q):
        """For each row of q the node from which the walk on level 0 begins."""
        import numpy as np

        at = np.full(len(q), self.entry)
        for k in range(len(self.nodes) - 1, 0, -1):
            at = self.beam(q, at, 1, k)[1][:, 0]
        return at

    def walk(self, q, start: int, ef: int, masked) -> list[tuple[float, int]]:
        """One query on level 0; masked nodes are passed through and not returned, so the walk goes on until ef others are found."""
        import heapq

        import numpy as np

        seen = np.zeros(len(self.ids), bool)
        seen[start] = True
        key = float(self.keys(q, np.array([start]))[0])
        todo, best = [(key, start)], [] if masked[start] else [(-key, -start)]
        while todo:
            key, node = heapq.heappop(todo)
            if len(best) >= ef and key > -best[0][0]:
                break
            nb = self.links[0][node]
            new = nb[nb >= 0]
            new = new[~seen[new]]
            seen[new] = True
            if not len(new):
                continue
            for k, n in zip(self.keys(q, new).tolist(), new.tolist()):
                if len(best) < ef or k < -best[0][0]:
                    heapq.heappush(todo, (k, n))
                    if not masked[n]:
                        heapq.heappush(best, (-k, -n))
                        if len(best) > ef:
                            heapq.heappop(best)
        return sorted((-k, -n) for k, n in best)

    def search(self, queries, k: int, ef: int, masked=None, radius_key: float | None = None) -> list:
        """Node numbers of the k closest for each query, closest first.

        With a radius the list grows fourfold while it may not hold all within it.
        """
        import numpy as np

        q = np.asarray(unit_rows(queries) if self.metric == "cosine" else queries, np.float32)
        if self.entry < 0 or not len(q):
            return [np.zeros(0, np.int64)] * len(q)
        start = self.descend(q)

        def found(rows, size):
            if masked is not None:
                return [(np.array([x for x, _ in w], np.float32), np.array([n for _, n in w], np.int64)) for i in rows for w in [self.walk(q[i], int(start[i]), size, masked)]]
            keys, nodes = self.beam(q[rows], start[rows], size, 0)
            return [(a[b >= 0], b[b >= 0]) for a, b in zip(keys, nodes)]

        rows = np.arange(len(q))
        if radius_key is None:
            return [n[:k] for _, n in found(rows, max(ef, k))]
        out, size = [None] * len(q), min(ef, k)
        while len(rows):
            left = []
            for i, (key, node) in zip(rows.tolist(), found(rows, size)):
                # float32 keys rank; who lies within the radius is decided exactly by the caller
                out[i] = node[key <= radius_key + 1e-5 * (1 + abs(radius_key))][:k]
                if size < k and 4 * len(out[i]) > size and len(node) >= min(size, len(self.ids)) and size < len(self.ids):
                    left.append(i)
            rows, size = np.array(left, np.int64), min(k, 4 * size)
        return out

    # storage

    def pack(self) -> dict:
        """Bytes of every array, by name."""
        import numpy as np

        sizes = np.array([x for n, l in zip(self.nodes, self.links) for x in (len(n), l.shape[1])], np.int32)
        return {
            "ids": self.ids.astype("<i8").tobytes(), "shape": sizes.tobytes(),
            "nodes": b"".join(n.astype("<i4").tobytes() for n in self.nodes[1:]), "links": b"".join(l.astype("<i4").tobytes() for l in self.links), "entry": self.entry, "unreachable": self.unreachable,
        }

    @classmethod
    def unpack(cls, rows, r: dict, metric: str) -> "Graph":
        import numpy as np

        g = cls(rows, np.frombuffer(r["ids"], "<i8"), metric)
        shape = np.frombuffer(r["shape"], np.int32).reshape(-1, 2)
        nodes, links = np.frombuffer(r["nodes"], "<i4"), np.frombuffer(r["links"], "<i4")
        a = b = 0
        for k, (n, w) in enumerate(shape.tolist()):
            g.nodes.append(np.arange(n) if k == 0 else nodes[a : a + n].astype(np.int64))
            a += 0 if k == 0 else n
            g.links.append(links[b : b + n * w].reshape(n, w))
            b += n * w
        g.entry, g.unreachable = r["entry"], r["unreachable"]
        return g


def grouped(batches, keys: list[str]):
    """Arrow batches sorted by keys -> one table for each value of keys."""
    import numpy as np
    import pyarrow as pa

    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([held, t]) if held is not None else t
        if not t.num_rows:
            continue
        k = np.stack([t.column(c).to_numpy() for c in keys])
        at = 0
        for c in (np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1).tolist():
            yield t.slice(at, c - at)
            at = c
        held = t.slice(at)
    if held is not None and held.num_rows:
        yield held
