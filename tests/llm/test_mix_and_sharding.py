"""Cube-method mixing against its constraints, and the sharding table against a plain construction."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import SMALL, database, rows_of_duckdb, rows_of_spark

from lexiforge.llm import cube_mix, queries, sharding


def plain_targets(sizes):
    """Water filling by repeated capping."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        among = sum(weight[s] for s in names if s not in capped)
        over = {s for s in names if s not in capped and weight[s] * left / among > 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] if s in capped else weight[s] * left / among for s in names}
        capped |= over


def check(spark, rows, block=cube_mix.BLOCK):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    got = cube_mix.mix(docs, block=block).collect()
    assert len(got) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.size == len((r.text or "").encode().split())
        assert r.taken in {k * r.size for k in range(4)}
        sizes[r.source] += r.size
        taken[r.source] += r.taken
    target = plain_targets(sizes) if sum(sizes.values()) else {}
    for r in got:
        assert r.source_size == sizes[r.source]
        if target:
            assert r.target == pytest.approx(target[r.source])
    return sizes, taken, target, got


@pytest.mark.parametrize("block", [16, 4096])
def test_totals_meet_targets(spark, block):
    r = np.random.default_rng(3)
    rows = [(i, "w " * int(r.integers(1, 400)), f"s{min(int(r.exponential(3)), 8)}", "x") for i in range(1500)]
    sizes, taken, target, got = check(spark, rows, block)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 0.002 * target[s] + 400
    counts = Counter(x.source for x in got)
    for s in sizes:  # documents are balanced as well as words
        times = sum(x.taken / x.size for x in got if x.source == s)
        assert abs(times - counts[s] * target[s] / sizes[s]) <= 8


def test_one_text_of_twenty_thousand_words(spark):
    """A text with a fifth of its source's words: the others make good what its choice takes too much or too little."""
    r = np.random.default_rng(11)
    for k in range(3):
        rows = [(i, "w " * int(r.integers(50, 300)), f"s{i % 3}", "x") for i in range(1500)] + [(5000 + k, "w " * 20_000, f"s{k}", "x")]
        sizes, taken, target, _ = check(spark, rows)
        for s in sizes:
            assert abs(taken[s] - target[s]) <= 0.002 * target[s]


def test_targets_are_met_at_scale(spark):
    got = queries.op6_source_mix(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "source"), "doc_id")
    for r in got.groupBy("source").agg({"taken": "sum", "target": "max"}).collect():
        assert abs(r["sum(taken)"] - r["max(target)"]) <= 0.002 * r["max(target)"]


def test_toss_stays_in_reach():
    for s in range(50):
        p = cube_mix.toss([0.5, 1.0, 0.0], [1, 1, 1], [1000, 5, 5], -600.0, 300.0, str(s))
        assert p == [0.0, 1.0, 0.0]  # taking it would be 500 too many, which the others cannot give back
    assert {cube_mix.toss([0.5], [1], [10], -600.0, 600.0, str(s))[0] for s in range(50)} == {0.0, 1.0}


def test_reruns_agree(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "source")
    first, again = (sorted((r.doc_id, r.taken) for r in cube_mix.mix(d).collect()) for d in (docs, docs.repartition(5)))
    assert first == again


def test_one_small_source_is_capped(spark):
    rows = [(i, "w " * 50, "big", "x") for i in range(100)] + [(1000, "w w", "tiny", "x")]
    _, taken, target, _ = check(spark, rows)
    assert target["tiny"] == 6 and taken["tiny"] == 6


def test_odd_rows(spark, weird):
    rows = [(r.doc_id, r.text, r.source, "clash") for r in weird.collect()]
    check(spark, rows)
    check(spark, [(1, None, None, "x"), (2, "  ", None, "x"), (2, "  ", None, "x")])
    check(spark, [])


def test_flight_keeps_both_sums():
    r = np.random.default_rng(5)
    c, x = [1] * 300, [int(v) for v in r.integers(1, 60, 300)]
    p = [0.37] * 300
    q = cube_mix.flight(p, c, x, "seed")
    assert sum(q) == pytest.approx(sum(p)) and np.dot(q, x) == pytest.approx(np.dot(p, x))
    assert sum(0 < v < 1 for v in q) <= 2 and all(0 <= v <= 1 for v in q)
    means = np.mean([cube_mix.flight(p[:12], c[:12], x[:12], str(s)) for s in range(3000)], 0)
    assert means == pytest.approx([0.37] * 12, abs=0.04)  # inclusion probabilities are kept


def test_native_word_count(spark):
    df = spark.createDataFrame([("a\x0bb\x0cc\u00a0d\x1ce",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(cube_mix.n_words("t")).collect()] == [3, 0, 0]


def plain_table(names, size):
    lists = []
    for n in names:
        h = hashlib.md5(n.encode()).hexdigest()
        offset, skip = int(h[:8], 16) % size, int(h[8:16], 16) % (size - 1) + 1
        lists.append([(offset + j * skip) % size for j in range(size)])
    table, nxt = [None] * size, [0] * len(names)
    while None in table:
        for i, order in enumerate(lists):
            while nxt[i] < size and table[order[nxt[i]]] is not None:
                nxt[i] += 1
            if nxt[i] < size:
                table[order[nxt[i]]] = i
    return table


def test_table():
    names = [f"n{i}" for i in range(7)]
    assert sharding.fill_table(names) == plain_table(names, 701)
    for order in ([0, 3, 6], list(range(7))):
        counts = Counter(sharding.fill_table([names[i] for i in order]))
        assert max(counts.values()) - min(counts.values()) <= 1
    with pytest.raises(ValueError, match="distinct"):
        sharding.fill_table(["a", "a"])
    with pytest.raises(ValueError, match="prime"):
        sharding.fill_table(["a", "b"], 100)


def test_few_keys_move():
    names = [f"n{i}" for i in range(20)]
    a, b = sharding.fill_table(names, 2003), sharding.fill_table(names[:-1], 2003)
    assert sum(x != y for x, y in zip(a, b, strict=True) if x != 19) / 2003 < 0.08


def test_placement(spark, weird, tmp_path):
    out = sharding.place(weird.withColumnRenamed("score", "slot"), "doc_id", ["a", "b", "c"])
    rows = out.collect()
    table = sharding.fill_table(["a", "b", "c"])
    assert len(rows) == weird.count()
    for r in rows:
        key = "" if r.doc_id is None else str(r.doc_id)
        assert r.slot == int(hashlib.md5(key.encode()).hexdigest()[:8], 16) % len(table) and r.shard == table[r.slot]
    assert sharding.place(weird.limit(0), "doc_id", ["a"]).collect() == []
    sharding.write_shards(weird, str(tmp_path / "out"), "doc_id", ["a", "b", "c"], 2)
    assert spark.read.parquet(str(tmp_path / "out")).count() == weird.count()


@pytest.mark.parametrize("key", ["slot", "shard"])
def test_the_key_may_be_called_like_a_result(spark, key):
    rows = sharding.place(spark.createDataFrame([(i, "x") for i in range(20)], f"{key} long, other string"), key, ["a", "b", "c"]).collect()
    table = sharding.fill_table(["a", "b", "c"])
    slots = [int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) % len(table) for i in range(20)]
    assert sorted((r.slot, r.shard, r.other) for r in rows) == sorted((k, table[k], "x") for k in slots)


def test_sql(spark):
    name = "op10_sharding"
    assert rows_of_spark(queries.queries()[name](spark, SMALL)) == rows_of_duckdb(database(SMALL), queries.oracle_sql()[name])
