"""Connected components and the join with frequent keys against plain versions."""

import numpy as np
import pytest

from lexiforge.llm.common import components, join_frequent


def plain(edges):
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in list(root)}


def graphs():
    r = np.random.default_rng(1)
    yield "path", [(i, i + 1) for i in range(300)]
    yield "star around the least", [(0, i) for i in range(1, 3000)] + [(i, i + 10_000) for i in range(1, 200)]
    yield "star around the greatest", [(9999, i) for i in range(3000)]
    yield "stars in a row", [(1000 * k, 1000 * k + i) for k in range(5) for i in range(1, 400)] + [(1000 * k + 5, 1000 * k + 1007) for k in range(4)]
    yield "random", [tuple(map(int, r.integers(0, 900, 2))) for _ in range(700)]
    yield "odd", [(1, 1), (2, None), (None, 3), (4, 5), (5, 4), (4, 5), (-7, 5)]
    yield "none", []


@pytest.mark.parametrize(("name", "edges"), list(graphs()))
def test_components(spark, name, edges):
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len({r.node for r in got})
    assert {r.node: r.component for r in got} == plain(edges)


def test_join_with_frequent_keys(spark):
    left = [("hot", i) for i in range(5000)] + [(f"k{i}", i) for i in range(5000)] + [(None, 1), ("alone", 2), ("hot2", 3)] + [("hot2", i) for i in range(500)]
    right = [("hot", 1.0), *[(f"k{i}", float(i)) for i in range(0, 5000, 2)], ("unused", 9.0)]
    known = dict(right)
    got = join_frequent(spark.createDataFrame(left, "k string, i int"), spark.createDataFrame(right, "k string, v double"), "k").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(k, i, known.get(k)) for k, i in left], key=str)
