"""Exact near-duplicate pairs of embeddings by dual traversal of a cover tree.

Unit vectors with cosine >= c are exactly those within Euclidean distance t = sqrt(2 - 2c). The tree is nested: its
upper level deals all vectors to nodes around pivots taken from a bounded sample; below, each node halves its radii
level by level. A pair of tree nodes is dropped when distance - radius - radius > t, and accepted whole when
distance + radius + radius <= t, so a dense group of near copies is counted without comparing its members; other pairs
descend, and at the bottom pairs of vectors are compared in double precision. Every vector is in the tree.

Equal vectors are one point with a weight. Large nodes are split into parts, and the pairs of parts that the upper
level leaves are dealt out in tiles: a task keeps a few parts and lets a few others pass by, so no group of vectors has
to fit one task, and a tree is shipped once for several pairs. At the bottom a product of shortened vectors bounds each
cosine from above (the first coordinates as they are, the length of the rest as one more); what it admits is compared
in double precision.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, freed, materialize, n_partitions

COSINE = 0.9
#: Vectors that the pivots are taken from, vectors that a part of a node has about, and pivots at most.
SAMPLE, PART, MOST_PIVOTS = 4096, 4096, 1024
#: Tasks that tiles are dealt to at most.
MOST_TASKS = 1 << 16
#: Slack for rounding in bounds (not in the comparison itself).
SLACK = 1e-7
#: Rows of one block of a distance matrix.
ROWS = 512
#: Parts along each side of a tile at most, and tiles to aim at along each side of the whole, so that tasks are many.
TILE, TILES = 8, 64
#: Share of a vector's coordinates that the bound keeps, and slack for its single precision.
KEEP, ROUGH = 0.25, 1e-4


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (a @ b.T), 0.0))


def products(a: np.ndarray, p: np.ndarray, b: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The cosines of rows p of a and q of b, in bounded memory."""
    out = np.empty(len(p))
    for at in range(0, len(p), 1 << 12):
        cut = slice(at, at + (1 << 12))
        out[cut] = np.einsum("ij,ij->i", a[p[cut]], b[q[cut]])
    return out


def unit(vectors: np.ndarray) -> np.ndarray:
    v = np.asarray(vectors, np.float64)
    v = v / np.abs(v).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return v / np.sqrt((v * v).sum(1, keepdims=True))


class Tree:
    """A part's vectors x and nested levels over them, from the root's level down.

    levels[k]: row numbers of the centres of level k; the last level is all rows. parent[k]: for each centre of level
    k + 1 the number of its parent in level k, which lies within the level's radius (greedily chosen, halving from
    level to level; a radius that merges nothing makes no level). cover[k]: each centre's largest distance to a row
    beneath it. node[k]: for each row the number of the centre of level k above it.
    """

    def __init__(self, x: np.ndarray, t: float) -> None:
        self.x, rows = x, np.arange(len(x))
        self.levels, self.parent, self.cover, self.node = [rows], [], [np.zeros(len(x))], [rows]
        radius = t / 4
        while len(self.levels[0]) > 1 and radius < 4.0:
            low = self.levels[0]
            parent, centres = net(x[low], radius)
            radius *= 2
            if len(centres) == len(low):
                continue
            node, top = parent[self.node[0]], low[centres]
            cover = np.zeros(len(top))
            np.maximum.at(cover, node, np.sqrt(np.maximum(2.0 - 2.0 * (x * x[top[node]]).sum(1), 0.0)))
            for at, value in zip((self.levels, self.parent, self.cover, self.node), (top, parent, cover, node), strict=True):
                at.insert(0, value)

    def short(self) -> np.ndarray:
        """Single-precision vectors whose products are no less than those of x, ROUGH aside."""
        if "short_" not in self.__dict__:
            k = max(1, math.ceil(KEEP * self.x.shape[1]))
            rest = np.sqrt((self.x[:, k:] ** 2).sum(1, keepdims=True))
            self.short_ = np.hstack([self.x[:, :k], rest]).astype(np.float32)
        return self.short_

    def children(self, level: int, number: int) -> np.ndarray:
        return np.flatnonzero(self.parent[level] == number) if level < len(self.parent) else np.array([number])

    def rows(self, level: int, number: int) -> np.ndarray:
        return np.flatnonzero(self.node[level] == number)


def net(x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """(number of each row's centre, centres): in order, a row farther than radius from all centres so far is one."""
    least = 1.0 - radius * radius / 2  # as a cosine
    parent, centres = np.full(len(x), -1), []
    for at in range(0, len(x), ROWS):
        block, mine = x[at : at + ROWS], parent[at : at + ROWS]
        if centres:
            s = block @ x[centres].T
            near = s.argmax(1)
            hit = s[np.arange(len(block)), near] >= least
            mine[hit] = near[hit]
        free = np.flatnonzero(mine < 0)
        inner = block[free] @ block[free].T >= least
        for k, i in enumerate(free):
            if mine[i] < 0:
                mine[free[inner[k] & (mine[free] < 0)]] = len(centres)
                mine[i] = len(centres)
                centres.append(at + i)
    return parent, np.array(centres)


class Links:
    """Weighted link counts and a union-find over the rows of two parts (or one)."""

    def __init__(self, weights: np.ndarray) -> None:
        self.weights, self.count, self.root = weights, np.zeros(len(weights), np.int64), np.arange(len(weights))

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def union(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.root[max(a, b)] = min(a, b)

    def all_with_all(self, p: np.ndarray, q: np.ndarray) -> None:
        self.count[p] += self.weights[q].sum()
        self.count[q] += self.weights[p].sum()
        for i in (*p[1:], *q):
            self.union(p[0], i)

    def all_within(self, p: np.ndarray) -> None:
        self.count[p] += self.weights[p].sum() - self.weights[p]
        for i in p[1:]:
            self.union(p[0], i)


def dual(a: Tree, b: Tree, cosine: float, links: Links, shift: int) -> None:
    """Adds all links between rows of a and rows of b (numbered from shift); a is b: within a, each pair once.

    A block of node pairs is one product of matrices, against the cosine that the largest radii of the block still
    admit; the few pairs that pass it are bounded one by one.
    """
    t, same = math.sqrt(2 - 2 * cosine), a is b
    last_a, last_b = len(a.levels) - 1, len(b.levels) - 1
    todo = [(0, 0, np.arange(len(a.levels[0])), np.arange(len(b.levels[0])), same)]
    while todo:
        la, lb, na, nb, diagonal = todo.pop()
        bottom = la == last_a and lb == last_b
        if bottom:
            sa, sb = a.short(), b.short()[nb].T
        else:
            xb, rb = b.x[b.levels[lb][nb]], b.cover[lb][nb]
        for at in range(0, len(na), ROWS):
            ia = na[at : at + ROWS]
            if bottom:
                p, q = np.nonzero(sa[ia] @ sb >= cosine - ROUGH)
                p, q = ia[p], nb[q]
                if diagonal:
                    p, q = p[p < q], q[p < q]
                hit = products(a.x, p, b.x, q) >= cosine
                p, q = p[hit], q[hit] + shift
                np.add.at(links.count, p, links.weights[q])
                np.add.at(links.count, q, links.weights[p])
                for i, j in zip(p, q, strict=True):
                    links.union(i, j)
                continue
            s = a.x[a.levels[la][ia]] @ xb.T
            reach = t + a.cover[la][ia] + rb.max() + SLACK
            p, q = np.nonzero(s >= (1.0 - np.minimum(reach, 2.0) ** 2 / 2)[:, None])
            if diagonal:
                p, q = p[ia[p] <= nb[q]], q[ia[p] <= nb[q]]
            d = np.sqrt(np.maximum(2.0 - 2.0 * s[p, q], 0.0))
            both = a.cover[la][ia[p]] + rb[q]
            own = ia[p] == nb[q] if diagonal else np.zeros(len(p), bool)
            d[own] = 0.0
            live, whole = d - both <= t + SLACK, d + both <= t - SLACK
            single = (a.cover[la][ia[p]] == 0) & own  # a node of one point, or of none but equal ones
            for i, j, mine in zip(ia[p[whole]], nb[q[whole]], own[whole], strict=True):
                if mine:
                    links.all_within(a.rows(la, i))
                else:
                    links.all_with_all(a.rows(la, i), b.rows(lb, j) + shift)
            down = live & ~whole & ~(single & (both == 0) & (la == last_a))
            # a node goes down with all of its partners at once
            order = np.flatnonzero(down)
            for i in np.unique(p[order]):
                mine = order[p[order] == i]
                js, ka = nb[q[mine]], a.children(la, ia[i])
                if diagonal and (js == ia[i]).any():
                    todo.append((min(la + 1, last_a), min(lb + 1, last_b), ka, b.children(lb, ia[i]), True))
                    js = js[js != ia[i]]
                if len(js):
                    kb = np.concatenate([b.children(lb, j) for j in js])
                    todo.append((min(la + 1, last_a), min(lb + 1, last_b), ka, kb, False))


FOUND = "rid long, links long, root long"
TREES = "part long, tree binary"


def grow(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """Rows (part, rid, weight, vector) sorted by part: each part's tree, once, with the vectors in their own precision."""

    def tree_of(part: int, rows: list[tuple]) -> pa.RecordBatch:
        rows.sort()
        given = np.array([r[2] for r in rows], kind)
        state = vars(Tree(unit(given), math.sqrt(2 - 2 * cosine))) | {"x": given}
        state |= {"rid": np.array([r[0] for r in rows], np.int64), "weight": np.array([r[1] for r in rows], np.int64)}
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([pickle.dumps(state)], pa.binary())], ["part", "tree"])

    now, rows, kind = None, [], np.float64
    for b in batches:
        kind = np.float32 if b.schema.field(3).type.value_type == pa.float32() else np.float64
        for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if r[0] != now and rows:
                yield tree_of(now, rows)
                rows = []
            now = r[0]
            rows.append(r[1:])
    if rows:
        yield tree_of(now, rows)


def tile_tasks(batches: Iterator[pa.RecordBatch], cosine: float, near: Callable[[int, int], bool]) -> Iterator[pa.RecordBatch]:
    """Rows (tile_a, tile_b, side, part, tree) sorted so: the links between the parts of side 0, which a task keeps, and
    each of side 1 as it passes; in a tile on the diagonal each part meets those before it and itself."""

    def read(data: bytes) -> tuple[Tree, np.ndarray, np.ndarray]:
        tree, state = Tree.__new__(Tree), pickle.loads(data)
        rid, weight = state.pop("rid"), state.pop("weight")
        tree.__dict__.update(state | {"x": unit(state["x"])})
        return tree, rid, weight

    def met(one: tuple, other: tuple) -> pa.RecordBatch:
        (a, rid, weight), (b, rid_b, weight_b), shift = one, other, 0
        if a is not b:
            shift, rid, weight = len(rid), np.concatenate([rid, rid_b]), np.concatenate([weight, weight_b])
        links = Links(weight)
        dual(a, b, cosine, links, shift)
        hit = np.flatnonzero(links.count)
        roots = np.array([rid[links.find(i)] for i in hit], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(rid[hit]), pa.array(links.count[hit]), pa.array(roots)], ["rid", "links", "root"])

    now, kept = None, {}
    for batch in batches:
        for k in range(batch.num_rows):
            tile_a, tile_b, side, part = (batch.column(c)[k].as_py() for c in range(4))
            if (tile_a, tile_b) != now:
                now, kept = (tile_a, tile_b), {}
            tree = read(batch.column(4)[k].as_py())
            if side == 0:
                kept[part] = tree
            if side == 1 or tile_a == tile_b:
                for other, it in kept.items():
                    if near(other, part):
                        yield met(it, tree)


def pivots_of(points: DataFrame, parts: int, t: float) -> np.ndarray:
    """Centres of the upper level, from a bounded sample (the smallest hashes): farthest-first, one for each part."""
    got = points.select("vector").orderBy(F.xxhash64("rid"), "rid").limit(SAMPLE).collect()
    if not got:
        return np.zeros((0, 0))
    x = unit(np.array([r["vector"] for r in got], np.float64))
    out, nearest = [0], distances(x, x[[0]])[:, 0]
    while len(out) < min(parts, MOST_PIVOTS, len(x)) and nearest.max() > t:
        out.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, distances(x, x[[out[-1]]])[:, 0])
    return x[out]


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of vectors (vec_id, embedding, ...), one row per row.

    A vector that is null or zero, or that holds a null or non-finite component, links with nothing, and so does a row
    with a null vec_id (its component is null, and it is not kept). Vectors of different lengths do not link. Equal
    vectors link; rows with one vec_id count as several vectors. n_links counts linked rows; component_id is the
    smallest vec_id reachable. Pairs at exactly the limit link. Further columns are left out.
    """
    spark, e = vectors.sparkSession, F.col("embedding")
    good = F.coalesce(
        F.col("vec_id").isNotNull()
        & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
        & F.exists(e, lambda v: v != 0),
        F.lit(False),
    )
    keyed = vectors.select("vec_id", F.when(good, F.transform(e, lambda v: v + F.lit(0).cast("float"))).alias("vector"))
    points = keyed.where("vector is not null").groupBy("vector").agg(F.min("vec_id").alias("rid"), F.count(F.lit(1)).alias("weight"))
    # one vec_id can have several vectors: the point's id must be its own
    points = materialize(points.select(F.xxhash64("vector", "rid").alias("rid"), F.col("rid").alias("least"), "weight", F.size("vector").alias("dims"), "vector"))
    ids = points.select("rid", "least")
    found = None
    for dims in [r["dims"] for r in points.select("dims").distinct().collect()]:
        one = links_between(points.where(F.col("dims") == dims).select("rid", "weight", "vector"), cosine)
        found = one if found is None else found.union(one)
    if found is None:
        found = spark.createDataFrame([], FOUND)
    found = materialize(found)
    joined = components(found.select(F.col("rid").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("rid").agg(F.sum("links").alias("links"))
    labelled = ids.join(joined.withColumnRenamed("node", "rid"), "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    labelled = labelled.join(least, "component").join(counts, "rid", "left").select("rid", "component_id", "links")
    out = points.join(labelled, "rid").select("vector", "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = keyed.join(out, "vector", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def links_between(points: DataFrame, cosine: float) -> DataFrame:
    """(rid, links, root) of points (rid, weight, vector) of one length: a row for each task that finds links of rid."""
    spark, t = points.sparkSession, math.sqrt(2 - 2 * cosine)
    n = points.count()
    pivots = pivots_of(points, math.ceil(n / PART), t)
    shared = spark.sparkContext.broadcast(pivots)

    @F.arrow_udf("struct<node:int,distance:double>")
    def nearest(vector: pa.Array) -> pa.Array:
        x = unit(np.array(vector.to_pylist(), np.float64)) if len(vector) else np.zeros((0, pivots.shape[1]))
        d = distances(x, shared.value)
        node = d.argmin(1) if len(vector) else np.zeros(0, int)
        return pa.array([{"node": int(k), "distance": float(d[i, k])} for i, k in enumerate(node)], pa.struct([("node", pa.int32()), ("distance", pa.float64())]))

    dealt = points.withColumn("near", nearest("vector"))
    dealt = materialize(dealt.select("rid", "weight", "vector", F.col("near.node").alias("node"), F.col("near.distance").alias("distance")))
    nodes = dealt.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("radius")).collect()  # MOST_PIVOTS rows at most
    parts, count = {}, 0
    for r in sorted(nodes, key=lambda r: r["node"]):
        k = math.ceil(r["n"] / PART)
        parts[r["node"]] = (count, k, r["radius"])
        count += k
    gaps = distances(pivots, pivots)
    firsts = spark.createDataFrame([(a, p[0], p[1]) for a, p in parts.items()], "node int, first long, parts long")
    placed = dealt.join(F.broadcast(firsts), "node").withColumn("part", F.col("first") + F.pmod(F.xxhash64("rid"), F.col("parts")))
    placed = placed.select("part", "rid", "weight", "vector").repartition(max(n_partitions(spark), min(count, MOST_TASKS)), "part").sortWithinPartitions("part")
    trees = materialize(placed.mapInArrow(lambda it: freed(grow(it, cosine)), TREES))
    # a tile is needed if the bound leaves a pair of its upper nodes; within it, each pair of parts is tested
    node_of = np.repeat(list(parts), [p[1] for p in parts.values()])
    radius = np.array([parts[k][2] if k in parts else 0.0 for k in range(len(pivots))])
    close = spark.sparkContext.broadcast((node_of, gaps - radius[:, None] - radius[None, :] <= t + SLACK))

    def near(a: int, b: int) -> bool:
        nodes, live = close.value
        return bool(live[nodes[a], nodes[b]])

    tile = min(TILE, max(1, count // TILES))
    tiles = -(-count // tile)
    members = [np.unique(node_of[k * tile : (k + 1) * tile]) for k in range(tiles)]
    meets = spark.range(tiles).repartition(n_partitions(spark)).mapInArrow(lambda it: tiles_near(it, members, close), "tile_a long, tile_b long")
    meets = materialize(meets)
    own = trees.withColumn("tile", F.floor(F.col("part") / tile))
    first = meets.join(own.withColumnRenamed("tile", "tile_a"), "tile_a").select("tile_a", "tile_b", F.lit(0).alias("side"), "part", "tree")
    second = meets.where("tile_a < tile_b").join(own.withColumnRenamed("tile", "tile_b"), "tile_b").select("tile_a", "tile_b", F.lit(1).alias("side"), "part", "tree")
    shipped = first.union(second).repartition(max(n_partitions(spark), min(tiles * (tiles + 1) // 2, MOST_TASKS)), "tile_a", "tile_b")
    shipped = shipped.sortWithinPartitions("tile_a", "tile_b", "side", "part")
    return shipped.mapInArrow(lambda it: freed(tile_tasks(it, cosine, near)), FOUND)


def tiles_near(batches: Iterator[pa.RecordBatch], members: list[np.ndarray], close: Broadcast) -> Iterator[pa.RecordBatch]:
    """Rows (tile): pairs of it and each tile from itself on that hold a pair of close nodes."""
    live = close.value[1]
    for b in batches:
        for a in b.column(0).to_pylist():
            reach = live[members[a]].any(0)
            hit = [k for k in range(a, len(members)) if reach[members[k]].any()]
            yield pa.RecordBatch.from_arrays([pa.array([a] * len(hit), pa.int64()), pa.array(hit, pa.int64())], ["tile_a", "tile_b"])
