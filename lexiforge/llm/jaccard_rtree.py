"""Jaccard join of documents' 5-word shingle sets with a count-vector R-tree, exact.

A set is hashed into groups, and the counts of its groups are a point. The sum over groups of the smaller counts bounds
the overlap of two sets from above; in an R-tree over the points, the largest counts in a node bound it for all sets
beneath. Pairs that survive the bounds are verified on the sets.

A tree of all sets would have to be one object, so the sets are first dealt into candidate classes that no link
crosses: in a common order of shingles with the rarest first, two sets of Jaccard similarity t share l shingles among
the first n - ceil(t n) + l of each, as long as l is no more than their least overlap. Pairs of sets that share so many
are joined, and connected pairs are a class. One shared shingle would do (l = 1), but where the sketch is crowded too
many sets share one by chance, and chains of them become one class of half the corpus. The sets of a shingle that many
have are joined to the first of them instead (a star, not all pairs). The order only has to be common, so shingle counts
may come from a sketch of fixed size; it keeps passages that many documents share out of the prefixes. Classes larger
than a block are thinned by links to a few leaders; only what those leave apart is compared with the whole class, block
by block.

Equal sets are one set throughout (a 64-bit key of their hashes). Shingles are 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, drop_shuffles, freed, join_frequent, materialize, n_partitions, small_batches

#: Words of a shingle; similarity as a fraction, so that the comparison is in whole numbers.
WORDS, OVER, UNDER = 5, 75, 100
#: Groups of a count vector; entries of a tree node.
GROUPS, FANOUT = 64, 16
#: Sets of a class that one task compares, and leaders that larger classes are thinned by.
BLOCK, LEADERS = 1024, 8
#: Slots of the sketch of shingle counts at most (half a byte each when sent out), and ranges that it is summed in.
MOST_SLOTS, RANGES = 1 << 26, 64
#: Lower ends of the count classes that the order distinguishes.
CLASSES = np.array([1, 2, 3, 4, 5, 6, 8, 12, 16, 32, 64, 256, 1024, 4096, 65536])
#: Shingles that a task gathers before it hands them on, and rows of prefixes that are compared together.
FLUSH, LOT = 400_000, 100_000
#: Prefix shingles that linked sets share at least; sets of a shingle up to which pairs are counted, and those of one task.
SHARED, MOST_SETS, LOCAL = 4, 32, 4
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles, A-Z in lower case; fewer words than five are one shingle."""
    # bytes.lower() and bytes.split() know ASCII only, which is what the definition asks for
    words = (text or "").encode().lower().split()
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b"\n".join(words), seed=len(words))] if words else [], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - WORDS + 1
    x = h[:n].copy()
    for k in range(1, WORDS):
        x *= MULTIPLIER
        x ^= x >> np.uint64(32)
        x += h[k : n + k]
    for shift in (29, 32):
        x *= MULTIPLIER
        x ^= x >> np.uint64(shift)
    return np.unique(x)


def key_of(s: np.ndarray) -> int:
    """A signed 64-bit key of a set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes(), seed=len(s))).astype(np.int64))


def prefix_length(n: int) -> int:
    return n - -(-OVER * n // UNDER) + 1


def texts_of(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    for b in batches:
        for at in range(0, b.num_rows, 64):
            part = b.slice(at, 64)
            yield part, part.column(column).to_pylist()


# --- the sketch -------------------------------------------------------------------------------------------------

SETS = "doc_id long, n long, key long, range int, slots binary"


def sets_and_slots(batches: Iterator[pa.RecordBatch], slots: int) -> Iterator[pa.RecordBatch]:
    """For each document its set's size and key; for each range the slots of the task's shingles, once per set."""
    import zstandard

    pack, width, kinds = zstandard.ZstdCompressor(level=1), slots // RANGES, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    names, seen, held, count = ["doc_id", "n", "key", "range", "slots"], set(), [], 0

    def flush() -> pa.RecordBatch:
        at = np.sort(np.concatenate(held) if held else np.empty(0, np.uint32))
        ends = np.searchsorted(at, np.arange(RANGES + 1, dtype=np.int64) * width)
        blobs = [pack.compress(np.diff(at[a:b], prepend=np.uint32(k * width)).astype(np.uint32).tobytes()) for k, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True))]
        none = [None] * RANGES
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((none, none, none, range(RANGES), blobs), kinds, strict=True)], names)

    for part, texts in texts_of(batches, 1):
        sizes, keys = [], []
        for t in texts:
            s = shingles(t)
            sizes.append(len(s))
            keys.append(key_of(s) if len(s) else None)
            if len(s) and keys[-1] not in seen:
                seen.add(keys[-1])
                held.append((s >> np.uint64(64 - int(math.log2(slots)))).astype(np.uint32))
                count += len(s)
        none = [None] * len(texts)
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, kinds[1]), pa.array(keys, kinds[2]), pa.array(none, kinds[3]), pa.array(none, kinds[4])], names)
        if count > FLUSH:
            yield flush()
            held, count = [], 0
            if len(seen) > 200_000:
                seen.clear()
    if held:
        yield flush()


def sum_range(batches: Iterator[pa.RecordBatch], slots: int) -> Iterator[pa.RecordBatch]:
    """Rows (range, slots) of whole ranges, sorted: each range's counts as classes, two to a byte."""
    import zstandard

    unpack, width, now, counts = zstandard.ZstdDecompressor(), slots // RANGES, None, None

    def done() -> pa.RecordBatch:
        c = np.searchsorted(CLASSES, counts, side="right").astype(np.uint8)
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([(c[::2] | c[1::2] << 4).tobytes()], pa.binary())], ["range", "classes"])

    for b in batches:
        for r, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if r != now:
                if now is not None:
                    yield done()
                now, counts = r, np.zeros(width, np.int64)
            at = np.cumsum(np.frombuffer(unpack.decompress(blob), np.uint32), dtype=np.int64)
            counts += np.bincount(at, minlength=width)
    if now is not None:
        yield done()


def classes_of(s: np.ndarray, sketch: np.ndarray, slots: int) -> np.ndarray:
    at = (s >> np.uint64(64 - int(math.log2(slots)))).astype(np.int64)
    return (sketch[at >> 1] >> ((at & 1) << 2)) & 15


# --- candidate classes ------------------------------------------------------------------------------------------

PREFIX = "shingle long, key long, n int"
#: n of a row that is a link (key, shingle ^ key), and of one that stands for a shingle of many sets.
LINK, MANY = -1, 0


def shared_least(n: np.ndarray | int) -> np.ndarray | int:
    """Shingles that a set of n shares with each set that it links with, among the first of each: SHARED, or fewer if the
    least overlap is smaller."""
    return np.minimum(SHARED, -(-OVER * n // UNDER))


def grouped(shingle: np.ndarray, key: np.ndarray, n: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """(shingle, key, n, size, many) of rows sorted by shingle and key, each pair once; size is the number of a shingle's
    rows, many whether they exceed most or stand for more."""
    order = np.lexsort((n, key, shingle))
    shingle, key, n = shingle[order], key[order], n[order]
    once = np.ones(len(key), bool)
    once[1:] = (shingle[1:] != shingle[:-1]) | (key[1:] != key[:-1])
    shingle, key, n = shingle[once], key[once], n[once]
    first = np.flatnonzero(np.r_[True, shingle[1:] != shingle[:-1]]) if len(key) else np.empty(0, np.int64)
    size = np.diff(np.r_[first, len(key)])
    many = (size > most) | (np.minimum.reduceat(n, first) == MANY) if len(first) else np.empty(0, bool)
    return shingle, key, n, np.repeat(size, size), np.repeat(many, size)


def star(shingle: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first row of each shingle, least keys, other keys) of rows sorted by shingle and key: links to the least."""
    first = np.r_[True, shingle[1:] != shingle[:-1]][: len(key)]
    least = key[first][np.cumsum(first) - 1]
    links = np.unique(np.stack([least, key], 1)[least != key], axis=0)
    return first, links[:, 0], links[:, 1]


def prefix_rows(batches: Iterator[pa.RecordBatch], sketch: np.ndarray, slots: int) -> Iterator[pa.RecordBatch]:
    """Rows (shingle, key, n) of the task's prefixes. A shingle that more than a few sets of the task have leaves it once,
    marked, beside links between those sets, however many have it."""
    seen, held, count = set(), [], 0

    def flush() -> pa.RecordBatch:
        shingle, key, n, _, many = grouped(*(np.concatenate([h[k] for h in held]) for k in range(3)), LOCAL)
        first, a, b = star(shingle[many], key[many])
        rest = ~many
        cols = (shingle[rest], shingle[many][first], a ^ b), (key[rest], key[many][first], a), (n[rest], np.full(first.sum(), MANY), np.full(len(a), LINK))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32()), strict=True)], ["shingle", "key", "n"])

    for _, texts in texts_of(batches, 1):
        for t in texts:
            s = shingles(t)
            if not len(s) or (k := key_of(s)) in seen:
                continue
            seen.add(k)
            n = prefix_length(len(s)) + int(shared_least(len(s))) - 1
            held.append((s[np.lexsort((s, classes_of(s, sketch, slots)))[:n]].astype(np.int64), np.full(n, k, np.int64), np.full(n, len(s), np.int32)))
            count += n
        if count > FLUSH:
            yield flush()
            held, count = [], 0
            if len(seen) > 200_000:
                seen.clear()
    if held:
        yield flush()


SHARES = "a long, b long, shared long, least long"


def shares(shingle: np.ndarray, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Rows (SHARES) of whole shingles: for pairs of sets how many of the shingles they share and how many a link takes,
    where their sizes admit one; sets of a shingle that many have are linked to the least of them whatever they share."""
    shingle, key, n, size, many = grouped(shingle, key, n, MOST_SETS)
    _, a, b = star(shingle[many], key[many])
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for k in np.unique(size[~many & (size > 1)]):
        rows = np.flatnonzero(~many & (size == k)).reshape(-1, k)
        x, y = np.triu_indices(k, 1)
        left.append(rows[:, x].ravel())
        right.append(rows[:, y].ravel())
    left, right = np.concatenate(left), np.concatenate(right)
    fits = UNDER * np.minimum(n[left], n[right]).astype(np.int64) >= OVER * np.maximum(n[left], n[right]).astype(np.int64)
    left, right = left[fits], right[fits]
    pairs = np.stack([key[left], key[right]], 1)
    pairs, at, count = np.unique(pairs, axis=0, return_index=True, return_counts=True)
    least = np.minimum(shared_least(n[left[at]].astype(np.int64)), shared_least(n[right[at]].astype(np.int64)))
    cols = (a, pairs[:, 0]), (b, pairs[:, 1]), (np.full(len(a), SHARED), count), (np.ones(len(a), np.int64), least)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in cols], ["a", "b", "shared", "least"])


def shared_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (PREFIX) sorted by shingle, a shingle's rows in one partition: rows (SHARES)."""
    held, count = [], 0

    def take(last: bool) -> pa.RecordBatch:
        """Shares of all held shingles but the last one, of which more may come."""
        nonlocal held, count
        shingle, key, n = (np.concatenate([h[k] for h in held]) for k in range(3))
        cut = len(shingle) if last else int(np.searchsorted(shingle, shingle[-1]))
        rest = shingle[cut:], key[cut:], n[cut:]
        done = [shingle[:cut], key[:cut], n[:cut]]
        if len(rest[0]) > MOST_SETS:  # its sets are linked now, and the least stands for them
            done = [np.concatenate([d, r]) for d, r in zip(done, (*rest[:2], np.full(len(rest[0]), MANY, np.int32)), strict=True)]
            least = rest[1].argmin()
            rest = rest[0][least : least + 1], rest[1][least : least + 1], np.full(1, MANY, np.int32)
        held, count = [rest], len(rest[0])
        return shares(*done)

    for b in batches:
        shingle, key, n = (c.to_numpy() for c in b.columns)
        link = n == LINK
        if link.any():
            a, other = key[link], shingle[link] ^ key[link]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(other), pa.array(np.full(len(a), SHARED, np.int64)), pa.array(np.ones(len(a), np.int64))], ["a", "b", "shared", "least"])
        held.append((shingle[~link], key[~link], n[~link]))
        count += len(held[-1][0])
        if count > LOT:
            yield take(False)
    if count:
        yield take(True)


def candidates(docs: DataFrame, sketch: Broadcast, slots: int) -> DataFrame:
    """(a, b): keys of sets of docs (doc_id, text), such that links lead along these only."""
    prefixes = docs.mapInArrow(lambda it: freed(prefix_rows(it, sketch.value, slots)), PREFIX)
    prefixes = prefixes.repartition(n_partitions(docs.sparkSession), "shingle").sortWithinPartitions("shingle", "key")
    shared = prefixes.mapInArrow(lambda it: freed(shared_prefixes(it)), SHARES)
    return shared.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.max("least").alias("least")).where("shared >= least").select("a", "b")


# --- the tree ---------------------------------------------------------------------------------------------------


def count_vector(s: np.ndarray) -> np.ndarray:
    return np.bincount((s & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """UNDER * |a and b| >= OVER * |a or b|."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return UNDER * both >= OVER * (len(a) + len(b) - both)


class RTree:
    """Count vectors packed by size and then by their leading groups, FANOUT entries to a node."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray) -> None:
        order = np.lexsort((*points.T[:4], sizes))
        self.order, self.points, self.sizes = order, points[order], sizes[order]
        self.levels = []  # from the leaves' nodes up: largest counts, least and largest sizes
        top, low, high = self.points, self.sizes, self.sizes
        while len(top) > FANOUT:
            at = np.arange(0, len(top), FANOUT)
            top, low, high = np.maximum.reduceat(top, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            self.levels.append((top, low, high))

    @staticmethod
    def may_link(q: np.ndarray, n: int, top: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Overlap o of sets of n and m needs UNDER o >= OVER (n + m - o); o is at most the sum of the least counts."""
        bound = np.minimum(np.minimum(q, top).sum(1), np.minimum(n, high))
        return (UNDER + OVER) * bound >= OVER * (n + low)

    def search(self, q: np.ndarray, n: int) -> np.ndarray:
        """Entries whose bound admits a link with a set of n shingles and counts q."""
        live = None
        for top, low, high in reversed(self.levels):
            if live is None:
                live = np.arange(len(top))
            live = live[live < len(top)]  # the last node of a level may be short of children
            live = live[self.may_link(q, n, top[live], low[live], high[live])]
            live = (live[:, None] * FANOUT + np.arange(FANOUT)).ravel()
        live = np.arange(len(self.points)) if live is None else live[live < len(self.points)]
        return self.order[live[self.may_link(q, n, self.points[live], self.sizes[live], self.sizes[live])]]


def find(root: list[int], i: int) -> int:
    while root[i] != i:
        root[i] = root[root[i]]
        i = root[i]
    return i


def join_sets(build: list[np.ndarray], probe: list[np.ndarray] | None) -> list[int]:
    """Components (as roots) over build and then probe: links within build (probe None), or between the two.

    Pairs that are connected already need no verification.
    """
    every = build + (probe or [])
    root = list(range(len(every)))
    points = np.array([count_vector(s) for s in every])
    sizes = np.array([len(s) for s in every])
    tree = RTree(points[: len(build)], sizes[: len(build)])
    for i in range(len(build) if probe else 0, len(every)):
        for j in tree.search(points[i], int(sizes[i])):
            if (probe or j < i) and find(root, i) != find(root, j) and linked(every[i], every[j]):
                a, b = find(root, i), find(root, j)
                root[max(a, b)] = min(a, b)
    return [find(root, i) for i in range(len(every))]


LINKS = "a long, b long"


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (task, probe, key, shingles) sorted by task: links (a, b) that span each task's components."""

    def links_of(rows: dict[tuple[bool, int], bytes]) -> pa.RecordBatch:
        sides = [sorted(k for p, k in rows if p == side) for side in (False, True)]
        sets = [[np.frombuffer(rows[side, k], np.uint64) for k in sides[side]] for side in (False, True)]
        roots = join_sets(sets[0], sets[1] or None) if sides[0] else []
        keys = sides[0] + sides[1]
        pairs = [(keys[r], keys[i]) for i, r in enumerate(roots) if keys[r] != keys[i]]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

    task, rows = None, {}
    for b in batches:
        for t, p, k, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if t != task and rows:
                yield links_of(rows)
                rows = {}
            task = t
            rows[p, k] = s
    if rows:
        yield links_of(rows)


def compared(rows: DataFrame) -> DataFrame:
    """Links of rows (task, probe, key, shingles)."""
    rows = rows.repartition(n_partitions(rows.sparkSession), "task").sortWithinPartitions("task")
    return rows.select("task", "probe", "key", "shingles").mapInArrow(lambda it: freed(compare(it)), LINKS)


# --- the operator -----------------------------------------------------------------------------------------------


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sets, labels) of docs (doc_id, text): sets (doc_id, n, key), and labels (key, component) of keys that links
    connect with the least key of their component, from which those keys themselves may be missing."""
    small_batches(docs.sparkSession)
    spark, docs = docs.sparkSession, docs.select("doc_id", "text").where("doc_id is not null")
    slots = min(MOST_SLOTS, max(1 << 14, 1 << math.ceil(math.log2(512 * docs.count() + 1))))
    both = materialize(docs.mapInArrow(lambda it: freed(sets_and_slots(it, slots)), SETS))
    sets = both.where("slots is null").select("doc_id", "n", "key")
    blobs = both.where("slots is not null").select("range", "slots").repartition(n_partitions(spark), "range").sortWithinPartitions("range")
    sketch = np.zeros(slots // 2, np.uint8)
    width = slots // RANGES // 2
    for r in blobs.mapInArrow(lambda it: freed(sum_range(it, slots)), "range int, classes binary").toLocalIterator():
        sketch[r["range"] * width : (r["range"] + 1) * width] = np.frombuffer(r["classes"], np.uint8)
    shared = spark.sparkContext.broadcast(sketch)

    classes = materialize(components(candidates(docs, shared, slots)))
    drop_shuffles(spark)

    # one document for each set of a class; only their texts are moved
    members = classes.select(F.col("node").alias("key"), F.col("component").alias("class"))
    chosen = sets.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id")).join(members, "key")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                s = shingles(b.column(3)[row].as_py())
                if len(s) and key_of(s) == b.column(0)[row].as_py():  # a doc_id may have several texts
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(row, 1), b.column(1).slice(row, 1), pa.array([s.tobytes()], pa.binary())], ["key", "class", "shingles"])

    texts = chosen.join(docs, "doc_id").select("key", "class", "doc_id", "text")
    texts = materialize(texts.mapInArrow(lambda it: freed(sets_of(it)), "key long, class long, shingles binary"))
    drop_shuffles(spark)
    sizes = members.groupBy("class").agg(F.count(F.lit(1)).alias("members"))  # sets, however many rows hold them
    sized = texts.join(sizes, "class")
    small = sized.where(F.col("members") <= BLOCK).withColumns({"task": F.col("class"), "probe": F.lit(False)})
    # a small class is one task, whose links lead to the least key of each component already
    found = materialize(compared(small))
    drop_shuffles(spark)
    labels = found.select(F.col("b").alias("key"), F.col("a").alias("component"))
    if not sizes.where(F.col("members") > BLOCK).isEmpty():
        labels = labels.union(large_classes(materialize(sized.where(F.col("members") > BLOCK))))
    return sets, labels


def large_classes(members: DataFrame) -> DataFrame:
    """Labels (key, component) of members (class, key, shingles, members) whose classes exceed a block.

    First each member meets the class's leaders (the least hashed keys). What is then connected to the class's largest
    component needs no further comparison among itself; the others meet the whole class, block against block.
    """
    block = F.pmod(F.xxhash64("key"), F.ceil(F.col("members") / F.lit(BLOCK)).cast("long"))
    blocked = members.withColumn("block", block)
    # leaders by a threshold on the hash that leaves about LEADERS of a class, whatever its size
    share = F.pmod(F.xxhash64("key", F.lit(1)), F.lit(1 << 30)) * F.col("members") < F.lit(LEADERS * (1 << 30))
    leaders = members.where(share).select("class", F.col("key").alias("k"), F.col("shingles").alias("s"))
    blocks = blocked.select("class", "block").distinct()
    build = leaders.join(blocks, "class").select(F.xxhash64("class", "block").alias("task"), F.lit(False).alias("probe"), F.col("k").alias("key"), F.col("s").alias("shingles"))
    probe = blocked.select(F.xxhash64("class", "block").alias("task"), F.lit(True).alias("probe"), "key", "shingles")
    first = materialize(compared(build.union(probe)))
    joined = materialize(components(first))
    now = blocked.join(joined.withColumnRenamed("node", "key"), "key", "left").withColumn("part", F.coalesce("component", "key"))
    now = materialize(now.select("class", "key", "shingles", "members", "block", "part"))
    parts = now.groupBy("class", "part").agg(F.count(F.lit(1)).alias("n"))
    main = parts.groupBy("class").agg(F.max_by("part", F.struct("n", "part")).alias("main"))
    apart = now.join(main, "class").where("part <> main").select("class", "key", "shingles")
    apart_n = apart.groupBy("class").agg(F.count(F.lit(1)).alias("apart"))
    apart = apart.join(apart_n, "class").withColumn("row", F.pmod(F.xxhash64("key", F.lit(2)), F.ceil(F.col("apart") / F.lit(BLOCK)).cast("long")))
    rows = apart.select("class", "row").distinct()
    task = F.xxhash64("class", "row", "block", F.lit(3)).alias("task")
    build = apart.join(blocks, "class").select(task, F.lit(False).alias("probe"), "key", "shingles")
    probe = now.join(rows, "class").select(task, F.lit(True).alias("probe"), "key", "shingles")
    more = materialize(compared(build.union(probe)))
    if not more.isEmpty():
        joined = components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    return joined.withColumnRenamed("node", "key")


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of docs (doc_id, text, ...), one row per row.

    component_id is the smallest doc_id reachable by links, itself included. A null text, or one without words, has
    an empty set, which links with nothing, not even its like. Equal sets link. A row with a null doc_id links with
    nothing and has a null component. Repeated rows are equal sets. Further columns are left out.
    """
    sets, labels = links(docs)
    # copies first: what follows has one row per set; only the last join goes back to documents
    keys = sets.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("first"))
    keys = keys.join(labels, "key", "left")
    keys = materialize(keys.select("key", "first", F.coalesce("component", "key").alias("group")))
    least = keys.groupBy("group").agg(F.min("first").alias("least"))
    out = join_frequent(sets, materialize(join_frequent(keys, least, "group").select("key", "least")), "key")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))
    nameless = docs.where("doc_id is null").select("text").mapInArrow(count_only, "n_shingles long")
    nameless = nameless.select(F.lit(None).cast("long").alias("doc_id"), "n_shingles", F.lit(None).cast("long").alias("component_id"))
    return out.union(nameless)


def count_only(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([len(shingles(t)) for t in b.column(0).to_pylist()], pa.int64())], ["n_shingles"])
