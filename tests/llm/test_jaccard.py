"""The Jaccard join against all pairs, its tree against plain bounds, components, large classes, and the SQL."""

import re

import numpy as np
import pytest
from compare import SMALL, database, rows_of_duckdb, rows_of_spark

from lexiforge.llm import common, jaccard_rtree, queries


def plain_set(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset([tuple(words)] if 0 < len(words) < 5 else [tuple(words[k : k + 5]) for k in range(len(words) - 4)])


def plain_groups(rows):
    sets = [(i, plain_set(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if i is not None and j is not None and x and y and (i == j or 100 * len(x & y) >= 75 * len(x | y)):
                if 100 * len(x & y) >= 75 * len(x | y):
                    root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(s), least.get(find(k)) if i is not None else None) for k, (i, s) in enumerate(sets)), key=str)


def family_rows():
    r = np.random.default_rng(11)
    word = lambda n: [f"w{int(x)}" for x in r.integers(0, 400, n)]
    rows, passage = [], word(30)
    for f in range(25):
        base = word(int(r.integers(20, 120)))
        for _ in range(int(r.integers(1, 9))):
            text = list(base)
            for at in r.integers(0, len(text), int(r.integers(0, 3))):
                text[at] = f"x{int(r.integers(0, 10**6))}"
            if r.random() < 0.3:
                text += passage
            rows.append((len(rows) * 7 % 1013, " ".join(text)))
        if f % 6 == 0:
            rows += [(2000 + len(rows) + k, " ".join(base).upper()) for k in range(5)]
    return rows


def run(spark, rows):
    df = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, n_shingles int")
    return sorted((tuple(r) for r in jaccard_rtree.groups(df).collect()), key=str)


@pytest.mark.parametrize("block", [2, 1024])
def test_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_rtree, "BLOCK", block)
    monkeypatch.setattr(jaccard_rtree, "LEADERS", 1)
    rows = family_rows()
    assert run(spark, rows) == plain_groups(rows)


def test_small_lots_change_nothing(spark, monkeypatch):
    rows = family_rows()[:80]
    expected = run(spark, rows)
    monkeypatch.setattr(jaccard_rtree, "FLUSH", 50)
    monkeypatch.setattr(jaccard_rtree, "MOST_SLOTS", 1 << 10)
    assert run(spark, rows) == expected == plain_groups(rows)


def test_chains_and_the_limit(spark):
    base = [f"a{k}" for k in range(60)]
    rows = [(k, " ".join(base[k : k + 40])) for k in range(0, 20, 2)]  # each links with the next ones only
    rows += [(100, " ".join(f"b{k}" for k in range(11))), (101, " ".join(f"b{k}" for k in range(10)))]  # 6 of 7 shared
    rows += [(102, " ".join(f"c{k}" for k in range(8))), (103, " ".join(f"c{k}" for k in range(7)))]  # 3 of 4: exactly 0.75
    assert run(spark, rows) == plain_groups(rows)


def test_odd_rows(spark, weird):
    rows = [(r.doc_id, r.text) for r in weird.collect()] + [(70, "a b"), (71, "A B"), (72, "b a"), (73, "a b c d e"), (51, "other text of the same id here")]
    assert run(spark, rows) == plain_groups(rows)
    assert run(spark, []) == []
    assert run(spark, [(None, "a"), (1, None)]) == plain_groups([(None, "a"), (1, None)])


def test_tree_finds_what_bounds_admit():
    r = np.random.default_rng(2)
    points = r.poisson(2, (300, jaccard_rtree.GROUPS))
    sizes = points.sum(1)
    tree = jaccard_rtree.RTree(points, sizes)
    for q in points[:40]:
        bound = np.minimum(np.minimum(q, points).sum(1), np.minimum(q.sum(), sizes))
        expected = np.flatnonzero(175 * bound >= 75 * (q.sum() + sizes))
        assert sorted(tree.search(q, int(q.sum()))) == list(expected)


def test_prefixes_of_linked_sets_meet():
    r = np.random.default_rng(4)
    for _ in range(300):
        a = set(map(int, r.integers(0, 40, r.integers(1, 30))))
        b = (a - set(map(int, r.integers(0, 40, 2)))) | set(map(int, r.integers(0, 60, 2)))
        if 100 * len(a & b) >= 75 * len(a | b):
            pa_, pb = (set(sorted(s)[: jaccard_rtree.prefix_length(len(s))]) for s in (a, b))
            assert pa_ & pb


def test_components(spark):
    r = np.random.default_rng(6)
    edges = [(int(a), int(b)) for a, b in r.integers(-50, 400, (260, 2))] + [(1000 + k, 1001 + k) for k in range(40)] + [(5, 5)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert common.components(spark.createDataFrame([(1, 1)], "a long, b long")).collect() == []


def test_sql(spark):
    name = "op8_ngram_jaccard_join"
    assert rows_of_spark(queries.queries()[name](spark, SMALL)) == rows_of_duckdb(database(SMALL), queries.oracle_sql()[name])


def test_join_frequent(spark):
    rows = [(7, i) for i in range(300)] + [(i, i) for i in range(40)] + [(None, 1), (None, 2)]
    left = common.materialize(spark.createDataFrame(rows, "k long, v long"))
    right = common.materialize(spark.createDataFrame([(i, i * i) for i in range(0, 30)], "k long, w long"))
    got = sorted(map(str, common.join_frequent(left, right, "k", 10).select("k", "v", "w").collect()))
    assert got == sorted(map(str, left.join(right, "k", "left").select("k", "v", "w").collect()))


@pytest.mark.parametrize(("most", "local", "lot"), [(32, 4, 100_000), (2, 1, 3), (3, 2, 1)])
def test_chance_shingles_make_no_class(spark, monkeypatch, most, local, lot):
    """Where the sketch tells nothing apart, texts that share a passage with the next one are no class, and near copies stay linked."""
    r = np.random.default_rng(7)
    texts = [[f"w{x}" for x in r.integers(0, 10**6, 120)] for _ in range(150)]
    for k in range(149):
        texts[k + 1][20:28] = texts[k][60:68]
    texts += [[*t[:-3], "x", "y", "z"] for t in texts[:20]] + [[*texts[0][:-1], f"v{k}"] for k in range(6)] + [t[:2] for t in texts[:3]] + [t[:6] for t in texts[:3]]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    monkeypatch.setattr(jaccard_rtree, "MOST_SLOTS", 1 << 7)
    for name, value in (("BLOCK", 40), ("MOST_SETS", most), ("LOCAL", local), ("LOT", lot)):
        monkeypatch.setattr(jaccard_rtree, name, value)
    called, large = [], jaccard_rtree.large_classes
    monkeypatch.setattr(jaccard_rtree, "large_classes", lambda members: called.append(1) or large(members))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((tuple(x) for x in jaccard_rtree.groups(df).collect()), key=str) == plain_groups(rows)
    assert most < 32 or not called
