"""Near-duplicate vectors against all pairs, odd vectors, and the SQL."""

import numpy as np
import pytest
from compare import SMALL, database, rows_of_duckdb, rows_of_spark


from lexiforge.llm import embed_dedup, queries

KIND = "vec_id long, embedding array<float>, label int"


def brute(rows, cosine=0.9):
    x = [np.array(v, np.float64) if v is not None and None not in v else None for _, v in rows]
    good = [i is not None and v is not None and len(v) and np.isfinite(v).all() and np.abs(v).max() > 0 for (i, _), v in zip(rows, x, strict=True)]
    n = len(rows)
    links = [[j for j in range(n) if j != i and good[i] and good[j] and len(x[i]) == len(x[j]) and x[i] @ x[j] / np.linalg.norm(x[i]) / np.linalg.norm(x[j]) >= cosine] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        c = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((rows[i][0], len(links[i]), c, c is not None and c == rows[i][0]))
    return sorted(out, key=str)


def run(spark, rows, kind=KIND, **conf):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], kind)
    return sorted((tuple(r) for r in embed_dedup.near_duplicates(df, **conf).collect()), key=str)


@pytest.mark.parametrize("part", [4, 64, 4096])
def test_all_pairs(spark, monkeypatch, part):
    monkeypatch.setattr(embed_dedup, "PART", part)
    r = np.random.default_rng(part)
    centres = r.normal(size=(12, 8))
    rows = [(int(i) * 7 % 1009, [float(x) for x in centres[i % 12] + r.normal(size=8) * r.choice([0.01, 0.2, 0.5])]) for i in range(160)]
    rows += [(2000 + k, rows[0][1]) for k in range(30)]  # a third group of equal vectors
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    assert run(spark, rows) == brute(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, [0.0, 0.0]), (3, [1.0, nan]), (4, [inf, 1.0]), (5, [1.0, None]), (6, []), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (7, [1.0, 0.0]), (10, [-0.0, 1e-30]), (11, [0.0, 1e30])]
    assert run(spark, rows) == brute(rows)


def test_doubles_are_compared_in_double_precision(spark):
    kind = KIND.replace("float", "double")
    under, over = 0.9 - 1e-12, 0.9 + 1e-12  # single precision cannot tell them apart
    rows = [(1, [1.0, 0.0]), (2, [under, float(np.sqrt(1 - under**2))]), (3, [over, -float(np.sqrt(1 - over**2))])]
    assert run(spark, rows, kind) == [(1, 1, 1, True), (2, 0, 2, True), (3, 1, 1, False)]
    rows = [(1, [1e300, 0.0]), (2, [1e300, 1e298]), (3, [0.0, 1e-300]), (4, [1e-305, 1e-300])]
    assert run(spark, rows, kind) == [(1, 1, 1, True), (2, 1, 1, False), (3, 1, 3, True), (4, 1, 3, False)]


@pytest.mark.parametrize("tiles", [1, 2, 1000])
def test_tiles(spark, monkeypatch, tiles):
    monkeypatch.setattr(embed_dedup, "PART", 16)
    monkeypatch.setattr(embed_dedup, "TILES", tiles)
    r = np.random.default_rng(9)
    centres = r.normal(size=(40, 16))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 40] + r.normal(size=16) * r.choice([0.05, 0.25])]) for i in range(400)]
    assert run(spark, rows) == brute(rows)


def test_short_vectors_bound_the_cosine():
    r = np.random.default_rng(2)
    for d in (1, 2, 5, 64):
        x = embed_dedup.unit(r.normal(size=(200, d)))
        s = embed_dedup.Tree(x, 0.4).short()
        assert (s @ s.T + embed_dedup.ROUGH >= x @ x.T).all()


def test_one_id_on_many_rows(spark):
    rows = [(7, [1.0, float(k % 3) / 100]) for k in range(600)] + [(8, [0.0, 1.0])] * 300
    got = run(spark, rows)
    assert set(got) == {(7, 599, 7, True), (8, 299, 8, True)} and len(got) == 900


def test_no_rows(spark):
    assert run(spark, []) == []


def test_chain_and_whole_balls():
    x = embed_dedup.unit(np.array([[np.cos(a), np.sin(a)] for a in np.linspace(0, 1.5, 60)]))
    tree = embed_dedup.Tree(x, np.sqrt(0.2))
    links = embed_dedup.Links(np.ones(60, np.int64))
    embed_dedup.dual(tree, tree, 0.9, links, 0)
    assert (links.count == ((x @ x.T) >= 0.9).sum(1) - 1).all()
    assert len({links.find(i) for i in range(60)}) == 1


def test_sql(spark):
    name = "op1_embedding_near_dedup"
    assert rows_of_spark(queries.queries()[name](spark, SMALL)) == rows_of_duckdb(database(SMALL), queries.oracle_sql()[name])
