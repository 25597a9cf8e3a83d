"""Embedding near-dedup by cover trees and dual traversal.

Vectors are scaled to unit length in double precision and equal vectors become one class.  The top of the cover tree is
built over the whole table, level by level: every node with more than `block` rows gets children, the centres of a net
of a bounded sample of its rows at the first of the halving radii that parts them, and each row goes to the nearest
child.  The leaves are blocks, each with its centre and its covering radius.  Pairs of blocks whose balls are further
apart than the threshold are dropped; pairs whose furthest rows are within it are linked as wholes, by their summed weights, and
no row moves for them.  For the others only the rows of a block that can reach the other block's ball are sent to meet
it.  There both sides get their own cover trees, which are traversed together: a pair of nodes is dropped if even its
closest descendants are further apart than the threshold (centre distance minus both covering radii), taken whole if even
the furthest are within it, and refined otherwise.  Pairs near the threshold are decided in double precision, so the
result is that of a full comparison.  Rows that no node holds are compared one by one, in the few principal directions
first: with the lengths of what these leave out they bound each product from above, and only pairs whose bound reaches
the threshold are compared in full.

A task returns per row the number of links it found and the root of a spanning forest of them, never the pairs, so a
dense group of n vectors costs n rows.  Where vectors aren't clustered and have many dimensions all balls overlap; then
no ball prunes and the pairs grow with the square of the rows.  That is the cost of an exact answer there, paid in
narrow matrix products; blocks grow with the table up to what a task holds, so the copies of a row do not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Temporary, discard, stage
from .components import components

LEVELS = 5
#: Slack for float32 products of unit vectors.  A dot product of d terms errs by at most about d * 2**-24 * |a| |b|: 9.2e-5
#: for 1,536 dimensions in the worst case, 2.3e-6 (its square root) as rounding goes; numpy adds pairwise or in blocks,
#: which keeps the worst case below 2e-5 up to 8,192 dimensions.  A distance sqrt(2 - 2 dot) errs by at most
#: sqrt(2 * 2e-5) = 6.4e-3 where it is near zero, and by 2e-5 / distance elsewhere; bounds compare sums of three.
DOT_SLACK, DIST_SLACK = 2e-5, 2e-2


def unit_rows(vectors: DataFrame) -> DataFrame:
    """vectors(vec_id, embedding) -> vec_id, h (class key), dim, v (the elements' bytes); h, dim, v null if unusable.

    v has 4 bytes an element where the table has floats, else 8; units() makes unit vectors in double precision of it.
    """
    dtype = "<f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "<f8"

    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        for b in batches:
            h, dim, v = [], [], []
            for x in b.column(1).to_pylist():
                a = None
                if x and None not in x:
                    raw = np.array(x, dtype)
                    a = raw.astype(np.float64)
                    top = np.abs(a).max() if np.isfinite(a).all() else 0.0
                    a = None if top == 0 else a / top
                if a is None:
                    h.append(None), dim.append(None), v.append(None)
                else:
                    h.append(hashlib.md5((a + 0.0).tobytes()).digest()), dim.append(len(a)), v.append(raw.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(h, pa.binary()), pa.array(dim, pa.int32()), pa.array(v, pa.binary())], names=["vec_id", "h", "dim", "v"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "vec_id long, h binary, dim int, v binary")


def units(col, dim: int):
    """Unit vectors in double precision of the bytes that unit_rows() made, all of one dimension."""
    import numpy as np

    raw = col.to_pylist() if hasattr(col, "to_pylist") else col
    width = len(raw[0]) // dim
    a = np.frombuffer(b"".join(raw), f"<f{width}").reshape(len(raw), dim).astype(np.float64)
    a /= np.abs(a).max(axis=1, keepdims=True)
    return a / np.sqrt(np.einsum("ij,ij->i", a, a))[:, None]


def net(m, radius: float, worth: bool = False, head: int = 256):
    """Greedy cover: (positions of centres, for each row the number of its centre); the first row is a centre.

    Centres are taken from `head` rows at once and meet the others in one matrix product.  With `worth` it ends where
    new centres hold fewer than eight rows each; the rows that are left are centres of their own.
    """
    import numpy as np

    owner = np.full(len(m), -1)
    centres: list = []
    todo = np.arange(len(m))
    least = 1 - radius * radius / 2
    while len(todo):
        first = todo[:head]
        close = m[first] @ m[first].T >= least
        new, covered = [], np.zeros(len(first), bool)
        for i in range(len(first)):
            if not covered[i]:
                new.append(i)
                covered |= close[i]
        c = first[new]
        for s in range(0, len(todo), 1 << 14):
            rows = todo[s : s + (1 << 14)]
            near = m[rows] @ m[c].T >= least
            hit = near.any(axis=1)
            owner[rows[hit]] = len(centres) + near[hit].argmax(axis=1)
        owner[c] = np.arange(len(centres), len(centres) + len(c))
        centres += c.tolist()
        before, todo = len(todo), todo[owner[todo] < 0]
        if worth and before - len(todo) < 8 * len(c):
            owner[todo] = np.arange(len(centres), len(centres) + len(todo))
            centres += todo.tolist()
            break
    return np.array(centres), owner


def tree(m) -> "np.ndarray":  # noqa: F821
    """(rows, LEVELS): the position of each row's ancestor at radius 1, 1/2, 1/4, ...; a centre is its own ancestor further down.

    Rows that few others are near to are nodes of their own from there on: nothing could be pruned below them.
    """
    import numpy as np

    up = np.repeat(np.arange(len(m), dtype=np.int32)[:, None], LEVELS, axis=1)
    parts = [np.arange(len(m))]
    for k in range(LEVELS):
        below = []
        for rows in parts:
            c, owner = net(m[rows], 2.0**-k, worth=True)
            up[rows, k] = rows[c[owner]]
            if len(c) == 1:
                below.append(rows)
                continue
            size = np.bincount(owner)
            several = np.flatnonzero(size[owner] > 1)
            by = several[np.argsort(owner[several], kind="stable")]
            if len(by):
                below += [rows[x] for x in np.split(by, np.cumsum(size[size > 1])[:-1])]
        parts = below
    return up


def narrow(a, b, least: float, most: float = 1e-3):
    """Bounds for the products of the unit rows of a and b in few dimensions: (rows of a, rows of b), or None if none are tight.

    In the principal directions of both, x . y = Px . Py + Qx . Qy <= Px . Py + |Qx| |Qy|, with P the first of them and
    Q the rest.  So the product of (Px, |Qx|) and (Py, |Qy|) is never below x . y; the fewest directions are taken by
    which at most a share `most` of some pairs could still reach `least`.  The pairs only steer the number.
    """
    import numpy as np

    dim = a.shape[1]
    some = [x[:: max(1, len(x) // 512)][:512] for x in (a, b)]
    both = np.concatenate(some)
    turn = np.linalg.eigh(both.T @ both)[1][:, ::-1]

    def short(x, k):
        p = x @ turn[:, :k]
        rest = np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", p, p)))
        return np.concatenate([p, rest[:, None]], axis=1).astype(np.float32)

    full = (some[0] @ some[1].T >= least).mean()
    k = 8
    while k <= dim // 2:
        if (short(some[0], k) @ short(some[1], k).T >= least).mean() <= full + most:
            return short(a, k), short(b, k)
        k *= 2
    return None


def join_trees(a, ua, wa, b, ub, wb, least: float, same: bool):
    """Links between the rows of two trees: (weight linked per row of a, of b, label per row of a, of b).

    a, b: unit rows in double; ua, ub: tree(); wa, wb: weights.  Labels are positions in the concatenation of a and b;
    rows joined by links have equal labels.  With `same`, b is a: pairs count once and a row doesn't link to itself.
    """
    import numpy as np

    fa, fb = a.astype(np.float32), b.astype(np.float32)
    na = len(a)
    total = na if same else na + len(b)
    got_a, got_b = np.zeros(na, np.int64), np.zeros(len(b), np.int64)
    ends: list = []
    pending = 0
    reach = float(np.sqrt(max(0.0, 2 - 2 * least)))

    def levels(m, u):
        out = []
        for k in range(LEVELS):
            d = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", m, m[u[:, k]])))
            cov = np.zeros(len(m))
            np.maximum.at(cov, u[:, k], d)
            order = np.argsort(u[:, k], kind="stable")
            centre, at = np.unique(u[order, k], return_index=True)
            out.append((cov, order, dict(zip(centre.tolist(), zip(at.tolist(), [*at[1:].tolist(), len(m)]))), np.bincount(u[:, k], minlength=len(m))))
        return out

    la, lb = levels(fa, ua), (levels(fb, ub) if not same else None)
    lb = la if same else lb

    def below(level, k, node):
        _, order, where, _ = level[k]
        x, y = where[node]
        return order[x:y]

    bounds: list = []

    def dense(i, j):
        """Compare rows i of a with rows j of b one by one, by narrow() where they are many."""
        wide, short = min(len(j), 1 << 13), None
        step = max(1, (1 << 20) // max(1, wide))
        if len(i) * len(j) >= 1 << 20:
            if not bounds:
                bounds.append(narrow(a, b, least))
            short = bounds[0] and (bounds[0][0][i], bounds[0][1][j])
        for s in range(0, len(i), step):
            for t in range(0, len(j), wide):
                r, c = i[s : s + step], j[t : t + wide]
                x = None
                if short:
                    might = np.flatnonzero((short[0][s : s + step] @ short[1][t : t + wide].T).ravel() >= least - 2 * DOT_SLACK)
                    if len(might) * 32 < len(r) * len(c) and len(might) * a.shape[1] <= 1 << 23:
                        x, y = r[might // len(c)], c[might % len(c)]
                        dots = np.einsum("ij,ij->i", fa[x], fb[y])
                        at = np.flatnonzero(dots >= least - DOT_SLACK)
                        x, y, dots = x[at], y[at], dots[at]
                if x is None:
                    all_dots = fa[r] @ fb[c].T
                    at = np.flatnonzero(all_dots.ravel() >= least - DOT_SLACK)
                    x, y, dots = r[at // len(c)], c[at % len(c)], all_dots.ravel()[at]
                unsure = dots < least + DOT_SLACK
                if unsure.any():
                    keep = ~unsure
                    keep[unsure] = np.einsum("ij,ij->i", a[x[unsure]], b[y[unsure]]) >= least
                    x, y = x[keep], y[keep]
                links(x, y)

    def whole(i, j):
        """All of i is linked to all of j."""
        got_a[i] += wb[j].sum()
        if same:
            both = np.intersect1d(i, j)
            got_a[both] -= wa[both]
        else:
            got_b[j] += wa[i].sum()
        shift = 0 if same else na
        ends.append(np.stack([i, np.full(len(i), j[0] + shift)]))
        ends.append(np.stack([np.full(len(j), i[0]), j + shift]))

    def visit(k, i, j):
        """i, j: all rows below a surviving node pair; their nodes at level k come next."""
        if k == LEVELS or len(i) * len(j) <= 4096:
            return dense(i, j)
        ca, cb = np.unique(ua[i, k]), np.unique(ub[j, k])
        if len(ca) == len(i) and len(cb) == len(j):
            return dense(i, j)
        one_a, one_b = la[k][3][ca] == 1, lb[k][3][cb] == 1
        if one_a.any() and one_b.any():
            dense(ca[one_a], cb[one_b])
        if not one_a.all():
            nodes(k, ca[~one_a], cb)
        if one_a.any() and not one_b.all():
            nodes(k, ca[one_a], cb[~one_b])

    def nodes(k, ca, cb):
        """Node pairs of level k: prune, take whole or refine."""
        ra, rb = la[k][0][ca].astype(np.float32), lb[k][0][cb].astype(np.float32)
        step = max(1, (1 << 22) // max(1, len(cb)))
        for s in range(0, len(ca), step):
            d = np.sqrt(np.maximum(0, 2 - 2 * (fa[ca[s : s + step]] @ fb[cb].T)))
            sums = ra[s : s + step, None] + rb[None, :]
            x, y = np.nonzero(d - sums <= reach + DIST_SLACK)
            inside = d[x, y] + sums[x, y] <= reach - DIST_SLACK
            for p, q in zip(ca[s + x[inside]].tolist(), cb[y[inside]].tolist()):
                whole(below(la, k, p), below(lb, k, q))
            p, q = ca[s + x[~inside]], cb[y[~inside]]
            if len(ca) <= len(cb):  # all partners of one node at a time, on the side with fewer nodes
                for c, mates in by_node(p, q):
                    visit(k + 1, below(la, k, c), np.concatenate([below(lb, k, m) for m in mates]))
            else:
                for c, mates in by_node(q, p):
                    visit(k + 1, np.concatenate([below(la, k, m) for m in mates]), below(lb, k, c))

    def by_node(p, q):
        order = np.argsort(p, kind="stable")
        node, at = np.unique(p[order], return_index=True)
        return zip(node.tolist(), (m.tolist() for m in np.split(q[order], at[1:])))

    def links(x, y):
        """Count the links x[i] - y[i] and keep a spanning forest of them."""
        if same:
            off = x != y
            x, y = x[off], y[off]
        if not len(x):
            return
        nonlocal pending
        np.add.at(got_a, x, wb[y])
        if not same:
            np.add.at(got_b, y, wa[x])
        ends.append(np.stack([x, y if same else y + na]))
        pending += len(x)
        if pending > 4 * total:
            lab = spread(*np.concatenate(ends, axis=1))
            x = np.flatnonzero(lab != np.arange(total))
            ends[:] = [np.stack([x, lab[x]])]
            pending = 0

    def spread(x, y):
        """The least position reachable from each by the links x - y."""
        label = np.arange(total)
        while True:
            low = np.minimum(label[x], label[y])
            new = label.copy()
            np.minimum.at(new, x, low)
            np.minimum.at(new, y, low)
            new = new[new]
            if (new == label).all():
                return label
            label = new

    if len(a) and len(b):
        visit(0, np.arange(na), np.arange(len(b)))
    label = spread(*np.concatenate(ends, axis=1)) if ends else np.arange(total)
    return got_a, got_b, label[:na], (label[:na] if same else label[na:])


def grouped(batches, n_keys: int):
    """Arrow batches sorted by their first n_keys columns -> one list of columns (pyarrow arrays) per key."""
    import numpy as np
    import pyarrow as pa

    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
        if not t.num_rows:
            continue
        k = np.stack([t.column(i).to_numpy() for i in range(n_keys)])
        cut = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1
        at = 0
        for c in cut.tolist():
            yield t.slice(at, c - at)
            at = c
        held = t.slice(at)
    if held is not None and held.num_rows:
        yield held


def children(m, most: int):
    """The first net of the rows m, at radii 2, 1, 1/2, ..., that has two centres or more; at most `most` of them."""
    for k in range(40):
        c, _ = net(m, 2.0 ** (1 - k))
        if len(c) > 1:
            return m[c[:most]]
    return m[:1]


def _split(placed: DataFrame, big: list[tuple[int, int, int]], block: int, sample: int, most: int, fresh: int) -> tuple[DataFrame, int]:
    """(placed with the rows of the big nodes (node, rows, dim) dealt to new nodes, numbered from `fresh`; the next number).

    A node gets twice as many children as it has blocks, at most `most`: more would be more pairs to meet where balls
    overlap anyway.  At most `sample` rows of each big node come to the driver.
    """
    import numpy as np

    spark = placed.sparkSession
    share = spark.createDataFrame([(c, min(1.0, 2.0 * sample / n)) for c, n, _ in big], "node long, share double")
    mark = F.pmod(F.xxhash64("h", F.lit(9)), F.lit(1 << 30)) < F.col("share") * (1 << 30)
    rows = placed.select("node", "h", "v").join(F.broadcast(share), "node").where(mark)
    few = rows.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64("h", F.lit(9)), "h"))).where(F.col("r") <= sample).select("node", "r", "v").collect()
    held: dict[int, list] = {}
    for r in sorted(few, key=lambda r: (r.node, r.r)):
        held.setdefault(r.node, []).append(r.v)
    facts, into, at = {c: (n, d) for c, n, d in big}, {}, fresh
    for node, v in held.items():
        n, dim = facts[node]
        c = children(units(v, dim), min(most, 2 * -(-n // block)))
        if len(c) > 1:
            into[node] = at, c
            at += len(c)
    sent = spark.sparkContext.broadcast(into)  # at most `most` centres for each big node

    def deal(batches):
        import pyarrow as pa

        for b in batches:
            node, dim = b.column(b.schema.get_field_index("node")).to_numpy().copy(), b.column(b.schema.get_field_index("dim")).to_numpy()
            v = b.column(b.schema.get_field_index("v"))
            for n in np.unique(node).tolist():
                if n in sent.value:
                    first, c = sent.value[n]
                    rows = np.flatnonzero(node == n)
                    node[rows] = first + (units(v.take(pa.array(rows)), int(dim[rows[0]])) @ c.T).argmax(axis=1)
            yield b.set_column(b.schema.get_field_index("node"), "node", pa.array(node))

    return placed.mapInArrow(deal, placed.schema), at


def _balls(placed: DataFrame) -> dict:
    """{node: (dim, rows, centre, covering radius, summed weights, smallest rep)}.

    The centre is the node's mean, summed by tasks, the radius the largest distance from it.
    """

    def sums(batches):
        import numpy as np
        import pyarrow as pa

        held: dict[int, list] = {}
        for b in batches:
            node, dim = b.column(0).to_numpy(), b.column(1).to_numpy()
            for n in np.unique(node).tolist():
                rows = np.flatnonzero(node == n)
                m = units(b.column(2).take(pa.array(rows)), int(dim[rows[0]]))
                had = held.setdefault(n, [int(dim[rows[0]]), 0, 0.0])
                had[1] += len(m)
                had[2] = had[2] + m.sum(axis=0)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([x[0] for x in held.values()], pa.int32()), pa.array([x[1] for x in held.values()], pa.int64()), pa.array([x[2].tolist() for x in held.values()], pa.list_(pa.float64()))], names=["node", "dim", "n", "s"])

    import numpy as np

    parts = placed.select("node", "dim", "v").mapInArrow(sums, "node long, dim int, n long, s array<double>")
    totals: dict[int, list] = {}
    cells = parts.select("node", "dim", "n", F.posexplode("s").alias("i", "x")).groupBy("node", "dim", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    for r in cells.groupBy("node", "dim").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s")).collect():  # a row a block
        totals[r.node] = [r.dim, r.n, np.array([e.x for e in r.s]) / r.n]
    sent = placed.sparkSession.sparkContext.broadcast({k: v[2] for k, v in totals.items()})  # a centre a block

    def reach(batches):
        import pyarrow as pa

        far: dict[int, float] = {}
        for b in batches:
            node, dim = b.column(0).to_numpy(), b.column(1).to_numpy()
            for n in np.unique(node).tolist():
                rows = np.flatnonzero(node == n)
                m = units(b.column(2).take(pa.array(rows)), int(dim[rows[0]]))
                far[n] = max(far.get(n, 0.0), float(np.sqrt(np.square(m - sent.value[n]).sum(axis=1).max())))
        if far:
            yield pa.RecordBatch.from_arrays([pa.array(list(far), pa.int64()), pa.array(list(far.values()), pa.float64())], names=["node", "far"])

    reached = placed.select("node", "dim", "v").mapInArrow(reach, "node long, far double").groupBy("node").agg(F.max("far").alias("far")).collect()
    weights = {r.node: (r.w, r.rep) for r in placed.groupBy("node").agg(F.sum("n").alias("w"), F.min("rep").alias("rep")).collect()}  # a row a block
    return {r.node: (*totals[r.node], r.far + 1e-9, *weights[r.node]) for r in reached}


def blocks_of(classes: DataFrame, block: int = 8192, sample: int = 1024, most: int = 32, rounds: int = 40) -> tuple[DataFrame, dict]:
    """(classes with node, _balls() of them): the leaves of the top of the tree.

    A node that no net of its sample parts (vectors closer to each other than a double can tell) stays as it is.
    """
    dims = [r.dim for r in classes.select("dim").distinct().collect()]  # one number each
    number = F.element_at(F.create_map(*[F.lit(x) for i, d in enumerate(sorted(dims)) for x in (d, i)]), F.col("dim")) if dims else F.lit(0)
    placed, fresh, whole = stage(classes.withColumn("node", number.cast("long")), "vector-nodes"), len(dims), set()
    for _ in range(rounds):
        sizes = placed.groupBy("node", "dim").agg(F.count("*").alias("n")).where(F.col("n") > block).collect()  # a row for each big node
        big = [(r.node, r.n, r.dim) for r in sizes if r.node not in whole]
        if not big:
            break
        split, fresh_to = _split(placed, big, block, sample, most, fresh)
        split, before = stage(split, "vector-nodes"), placed
        left = {r.node for r in split.select("node").distinct().collect()}
        whole |= {n for n, _, _ in big if n in left}
        placed, fresh = split, fresh_to
        discard(before)
    return placed, _balls(placed)


def block_size(rows: int, dim: int, least: int = 8192, elements: int = 1 << 23) -> int:
    """Rows of a block: a quarter of the table, so that a row is sent to few partners, as far as a task can hold two blocks."""
    return max(min(least, max(1, elements // max(1, dim))), min(-(-rows // 4), elements // max(1, dim)))


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, block: int | None = None) -> DataFrame:
    """vectors(vec_id, embedding) -> vec_id, n_links, component_id, kept.

    Null, empty and zero vectors, those with null or non-finite components and those without vec_id link with nothing
    and are their own component.  Vectors of different lengths don't link.  Equal vectors link.  Repeated rows count
    one by one.  kept: vec_id = component_id (false for a null vec_id).  Empty table: no rows.  Other columns are ignored.
    block: rows of a block at most; block_size() of the table by default.
    """
    import numpy as np

    spark = vectors.sparkSession
    every = stage(unit_rows(vectors), "vectors")
    with Temporary() as mine:
        usable = every.where("h is not null and vec_id is not null")
        classes = usable.groupBy("h").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("dim").alias("dim"), F.first("v").alias("v"))
        classes = stage(classes, "vector-classes")
        if block is None:
            facts = classes.agg(F.count("*"), F.max("dim")).first()
            block = block_size(facts[0], facts[1] or 1)
        placed, balls = blocks_of(classes, block)
        reach = float(np.sqrt(2 - 2 * cosine))
        partners, wholes = _partners(balls, reach)
        sent = spark.sparkContext.broadcast((balls, partners, wholes))  # a centre a block, and its partners

        def send(batches):
            """The rows of each block for each partner whose ball they can reach."""
            import pyarrow as pa

            balls, partners, _ = sent.value
            for b in batches:
                node, dim = b.column(3).to_numpy(), b.column(2).to_numpy()
                for a in np.unique(node).tolist():
                    rows = np.flatnonzero(node == a)
                    sub = pa.RecordBatch.from_arrays([b.column(i).take(pa.array(rows)) for i in (0, 1, 4)], names=["rep", "n", "v"])
                    m = units(sub.column(2), int(dim[rows[0]]))
                    for c in partners[a]:
                        near = np.arange(len(m)) if c == a else np.flatnonzero(np.square(m - balls[c][2]).sum(axis=1) <= (balls[c][3] + reach + 1e-6) ** 2)
                        if len(near):
                            part = sub.take(pa.array(near))
                            k = len(near)
                            keys = [pa.array(np.full(k, x, t)) for x, t in ((min(a, c), np.int64), (max(a, c), np.int64), (int(a > c), np.int32), (int(dim[rows[0]]), np.int32))]
                            yield pa.RecordBatch.from_arrays([*keys, *part.columns], names=["b1", "b2", "side", "dim", "rep", "n", "v"])

        met = placed.select("rep", "n", "dim", "node", "v").mapInArrow(send, "b1 long, b2 long, side int, dim int, rep long, n long, v binary")

        def meet(batches):
            import pyarrow as pa

            for t in grouped(batches, 2):
                side, halves = t.column("side").to_numpy(), []
                for s in (0, 1):
                    h = t.filter(pa.array(side == s))
                    if h.num_rows:
                        m = units(h.column("v"), h.column("dim")[0].as_py())
                        halves.append((h.column("rep").to_numpy(), h.column("n").to_numpy(), m, tree(m.astype(np.float32))))
                same = t.column("b1")[0] == t.column("b2")[0]
                if len(halves) < 2 and not same:
                    continue
                (ra, wa, a, ua), (rb, wb, b, ub) = halves[0], halves[-1]
                ga, gb, xa, xb = join_trees(a, ua, wa, b, ub, wb, cosine, same)
                rep, got, label = (ra, ga, xa) if same else (np.concatenate([ra, rb]), np.concatenate([ga, gb]), np.concatenate([xa, xb]))
                hit = got > 0
                if hit.any():
                    yield pa.RecordBatch.from_arrays([pa.array(rep[hit]), pa.array(got[hit]), pa.array(rep[label[hit]])], names=["rep", "links", "root"])

        def link_wholes(batches):
            """The links of each row with blocks that lie within reach as a whole, its own included."""
            import pyarrow as pa

            balls, _, wholes = sent.value
            for b in batches:
                rep, n, node = (b.column(i).to_numpy() for i in range(3))
                for a in np.unique(node).tolist():
                    if a in wholes:
                        rows = np.flatnonzero(node == a)
                        got = sum(balls[c][4] for c in wholes[a]) - (n[rows] if a in wholes[a] else 0)
                        # every row with one row of the nearest number, and the block's first row with one of each other block
                        ends = np.full(len(rows), min(balls[c][5] for c in wholes[a]))
                        yield pa.RecordBatch.from_arrays([pa.array(rep[rows]), pa.array(got + np.zeros(len(rows), np.int64)), pa.array(ends)], names=["rep", "links", "root"])

        found = met.repartition("b1", "b2").sortWithinPartitions("b1", "b2", "side", "rep").mapInArrow(meet, "rep long, links long, root long")
        if wholes:
            between = [(balls[a][5], 0, balls[c][5]) for a in wholes for c in wholes[a] if a < c]
            found = found.unionByName(placed.select("rep", "n", "node").mapInArrow(link_wholes, "rep long, links long, root long"))
            found = found.unionByName(spark.createDataFrame(between, "rep long, links long, root long"))
        found = stage(found, "vector-links")
        comp = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")))
        links = found.groupBy("rep").agg(F.sum("links").alias("links"))
        known = (
            classes.select("h", "rep", "n").join(links, "rep", "left").join(comp, F.col("rep") == F.col("node"), "left")
            .select(F.col("h").alias("h2"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("root", "rep").alias("root"))
        )
        known = mine.keep(stage(known, "vector-known"))
    out = every.select("vec_id", "h").join(known, (F.col("h") == F.col("h2")) & F.col("vec_id").isNotNull(), "left")
    comp_id = F.coalesce("root", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), comp_id.alias("component_id"), F.coalesce(F.col("vec_id") == comp_id, F.lit(False)).alias("kept"))


def _partners(balls: dict, reach: float) -> tuple[dict[int, list[int]], dict[int, list[int]]]:
    """For each block those whose balls are within reach of its own, itself included: (to be compared, linked as wholes)."""
    import numpy as np

    out: dict[int, list[int]] = {k: [] for k in balls}
    wholes: dict[int, list[int]] = {}
    for dim in sorted({b[0] for b in balls.values()}):
        nodes = np.array(sorted(k for k, b in balls.items() if b[0] == dim))
        c, r = np.stack([balls[k][2] for k in nodes.tolist()]), np.array([balls[k][3] for k in nodes.tolist()])
        for at, k in enumerate(nodes.tolist()):
            d = np.sqrt(np.square(c - c[at]).sum(axis=1))
            far = d + r + r[at]
            whole = far <= reach - 1e-6
            out[k] = nodes[(d <= r + r[at] + reach + 1e-6) & ~whole].tolist()
            if whole.any():
                wholes[k] = nodes[whole].tolist()
    return out, wholes
