"""Mixing sources to target weights by balanced sampling with the cube method.

A document of a source with target T and total size S should count T / S times. The whole part of that ratio is taken
for certain; the rest is an inclusion probability, equal within the source. The flight phase moves the probabilities
of three units at a time along the null space of the source's two constraints (documents and words), until one of
them is 0 or 1: both totals stay exactly as they were. It runs in blocks of bounded size; the few units that a block
leaves undecided meet those of other blocks in the next round, until each source has one block left. What its flight
leaves is the landing problem: a dozen units, of whose choices the one nearest to the words and documents due is
taken.

A text that holds a good part of its source's words would leave the landing nothing to make good with. So units above a
hundredth of the target go first: a flight and a coin among themselves decide them, and the probability of the source's
other units is set anew to what is then due. Words are kept exactly by this, inclusion probabilities in the mean.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from pyspark.sql.window import Window

from .common import freed, materialize, n_partitions, small_batches

#: Weights of the sources by rank, repeating; no document is taken more often than CAP times.
WEIGHTS, CAP = (1, 2, 3), 3
#: Undecided units of a source that meet in one block.
BLOCK = 4096
#: Units of the landing problem of a source.
LANDING = 12
#: Units with more than this part of the source's target are decided before the others.
LARGE = 0.01
EPS = 1e-9


@F.arrow_udf(LongType())
def n_words(text: pa.Array) -> pa.Array:
    """Words of each text, 0 for null; bytes.split() splits at exactly the six ASCII white space characters."""
    return pa.array([len(t.split()) if t else 0 for t in text.cast(pa.binary()).to_pylist()], pa.int64())


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) of sizes (source, source_size), one row per source.

    Sources in code point order, null last, weigh weights[0], weights[1], ... repeating, and share the whole of all
    sizes by weight. No target exceeds cap times its source's size; the excess is shared among the others by weight.
    In the order of size / weight the sources that fill up come first, so running sums tell for each whether it does,
    and the first that does not fixes the share of one unit of weight. The windows span one row per source.
    """
    order = [F.col("source").isNull(), F.col("source").cast("binary")]
    rank = F.row_number().over(Window.partitionBy().orderBy(*order)) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", weight).withColumn("ratio", F.col("source_size") / F.col("weight"))
    every = Window.partitionBy()
    before = Window.partitionBy().orderBy("ratio", *order).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns(
        {
            "left": F.sum("source_size").over(every) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0)),
            "among": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
            "most": (cap * F.col("source_size")).cast("double"),
        }
    ).withColumn("share", F.col("left") / F.col("among"))
    s = s.withColumn("full", F.col("weight") * F.col("share") >= F.col("most"))
    first = F.min(F.when(~F.col("full"), F.struct("ratio", *[c.alias(f"o{i}") for i, c in enumerate(order)], "share")))
    s = s.withColumn("unit", first.over(every).getField("share"))
    target = F.when(F.col("full"), F.col("most")).otherwise(F.least("most", F.col("weight") * F.col("unit")))
    return s.select("source", "source_size", target.alias("target"))


def flight(p: list[float], c: list[int], x: list[int], seed: str, keep: int = 0) -> list[float]:
    """Probabilities p moved with sum(p * c) and sum(p * x) kept, until two (or keep) units at most stay undecided.

    c: documents of each unit, x: their words. Three units have one direction that changes neither sum: the cross
    product of their (c) and (x) rows; units of one size swap in pairs. Each move goes to the nearer or the farther
    end with the odds that keep every probability's mean. seed fixes the coin, so that reruns agree.
    """
    coin, p = random.Random(seed).random, list(p)
    todo = [i for i in range(len(p) - 1, -1, -1) if EPS < p[i] < 1 - EPS]
    live: list[int] = []
    while True:
        while len(live) < 3 and todo:
            live.append(todo.pop())
        if len(live) + len(todo) <= keep:
            return p
        move = None
        for a, i in enumerate(live):
            for j in live[a + 1 :]:
                if c[i] * x[j] == c[j] * x[i]:
                    move = ((i, c[j]), (j, -c[i]))
        if not move and len(live) == 3:
            i, j, k = live
            move = ((i, c[j] * x[k] - c[k] * x[j]), (j, c[k] * x[i] - c[i] * x[k]), (k, c[i] * x[j] - c[j] * x[i]))
        if not move:
            return [round(v) if v < EPS or v > 1 - EPS else v for v in p]
        up = min((1 - p[n]) / u if u > 0 else p[n] / -u for n, u in move)
        down = min(p[n] / u if u > 0 else (1 - p[n]) / -u for n, u in move)
        step = up if coin() * (up + down) < down else -down
        for n, u in move:
            v = p[n] + step * u
            p[n] = 0.0 if v < EPS else 1.0 if v > 1 - EPS else v
        live = [n for n in live if 0 < p[n] < 1]


def land(p: list[float], c: list[int], x: list[int]) -> list[float]:
    """The undecided units, LANDING at most: of all choices the one nearest to the words due, then to the documents."""
    p, left = list(p), [i for i in range(len(p)) if 0 < p[i] < 1]
    if left:
        choices = (np.arange(2 ** len(left))[:, None] >> np.arange(len(left))) & 1
        q, words, docs = (np.array([v[i] for i in left], float) for v in (p, x, c))
        miss = np.abs(choices @ words - q @ words) + 0.1 * words.mean() * np.abs(choices @ docs - q @ docs)
        for i, v in zip(left, choices[miss.argmin()], strict=True):
            p[i] = float(v)
    return p


def toss(p: list[float], c: list[int], x: list[int], low: float, high: float, seed: str) -> list[float]:
    """The undecided large units, LANDING at most, by their probabilities. What they then take beyond what was due has to
    lie between low and high, which is what the other units can make good; else the nearest choice to that counts."""
    p, left = list(p), [i for i in range(len(p)) if 0 < p[i] < 1]
    if left:
        coin = random.Random(seed).random
        tossed = np.array([coin() < p[i] for i in left], int)
        words, q = np.array([x[i] for i in left], float), np.array([p[i] for i in left])
        choices = np.vstack([tossed, (np.arange(2 ** len(left))[:, None] >> np.arange(len(left))) & 1])
        beyond = choices @ words - q @ words
        short = np.maximum(beyond - high, 0) + np.maximum(low - beyond, 0)
        for i, v in zip(left, choices[np.lexsort((np.arange(len(choices)), short))[0]], strict=True):
            p[i] = float(v)
    return p


UNIT = "doc_id long, source string, size long, docs long, p double, at long, low double, high double"


def fly(batches: Iterator[pa.RecordBatch], final: bool, large: bool) -> Iterator[pa.RecordBatch]:
    """Flight (and, if final, landing or the toss of large units) of each block of rows (UNIT, block), sorted by source
    and block."""
    names = ["doc_id", "source", "size", "docs", "p", "at", "low", "high", "block"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.float64()]

    def decided(rows: list[tuple]) -> pa.RecordBatch:
        rows.sort(key=lambda r: (r[5], r[0] is None, r[0] or 0, r[2]))
        docs, words, seed = [r[3] for r in rows], [r[2] * r[3] for r in rows], f"{rows[0][1]}:{rows[0][8]}:{len(rows)}"
        p = flight([r[4] for r in rows], docs, words, seed, LANDING * (final and not large))
        if final:
            p = toss(p, docs, words, rows[0][6], rows[0][7], f"{seed}:toss") if large else land(p, docs, words)
        columns = [p if n == "p" else [r[k] for r in rows] for k, n in enumerate(names[:8])]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names[:8])

    key, rows = None, []
    for b in batches:
        for r in zip(*(b.column(n).to_pylist() for n in names), strict=True):
            if (r[1], r[8]) != key and rows:
                yield decided(rows)
                rows = []
            key = (r[1], r[8])
            rows.append(r)
    if rows:
        yield decided(rows)


def choose(units: DataFrame, block: int = BLOCK, large: bool = False) -> DataFrame:
    """units (UNIT) with p 0 or 1 throughout, materialized round by round."""
    spark, done = units.sparkSession, None
    left = units
    while True:
        counts = left.groupBy("source").agg(F.count(F.lit(1)).alias("units"))
        most = counts.agg(F.max("units")).first()[0] or 0
        final = most <= block
        buckets = F.ceil(F.col("units") / F.lit(block)).cast("long")
        # every block has at most about block units, whatever share of the rows its source has
        dealt = left.join(counts.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        dealt = dealt.withColumn("block", F.pmod(F.col("at"), buckets)).drop("s", "units")
        dealt = dealt.repartition(n_partitions(spark), "source", "block").sortWithinPartitions("source", "block")
        moved = materialize(dealt.mapInArrow(lambda it, final=final: freed(fly(it, final, large)), UNIT))
        whole = moved.where("p = 0 or p = 1")
        done = whole if done is None else done.union(whole)
        if final:
            return done
        left = moved.where("p > 0 and p < 1")


def decide(units: DataFrame, block: int) -> DataFrame:
    """units (doc_id, source, size, docs, p, at, words, target) with p 0 or 1 throughout: large ones first, then the
    others with what is then due."""
    units = units.withColumn("large", F.col("words") > LARGE * F.col("target"))
    # of each source: the words of its other units, and what the large ones may take too little or too much
    rest = F.coalesce(F.sum(F.when(~F.col("large"), F.col("words"))), F.lit(0))
    room = units.groupBy(F.col("source").alias("name")).agg(rest.cast("double").alias("rest"), F.max("p").alias("p")).select("name", "rest", F.col("p").alias("p_s"))
    named = materialize(room.withColumns({"low": -F.col("rest") * (1 - F.col("p_s")), "high": F.col("rest") * F.col("p_s")}))
    units = materialize(units.join(named, F.col("source").eqNullSafe(F.col("name"))).select("doc_id", "source", "size", "docs", "p", "at", "low", "high", "words", "large"))
    first = materialize(choose(units.where("large").drop("words", "large"), block, large=True))
    beyond = first.groupBy("source").agg(F.sum(F.col("p") * F.col("size") * F.col("docs")).alias("took"))
    due = units.where("large").groupBy(F.col("source").alias("o")).agg(F.sum(F.col("p") * F.col("words")).alias("due"))
    again = beyond.join(due, F.col("source").eqNullSafe(F.col("o"))).select(F.col("source").alias("o"), (F.col("took") - F.col("due")).alias("beyond"))
    again = again.join(named, F.col("o").eqNullSafe(F.col("name"))).where("rest > 0")
    again = again.select("o", ((F.col("high") - F.col("beyond")) / F.col("rest")).alias("anew"))
    others = units.where("not large").join(F.broadcast(again), F.col("source").eqNullSafe(F.col("o")), "left")
    anew = F.least(F.greatest(F.coalesce("anew", "p"), F.lit(0.0)), F.lit(1.0))
    others = others.withColumn("p", F.when(anew < EPS, 0.0).when(anew > 1 - EPS, 1.0).otherwise(anew))
    return first.unionByName(choose(others.select("doc_id", "source", "size", "docs", "p", "at", "low", "high"), block))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, block: int = BLOCK) -> DataFrame:
    """docs (doc_id, text, source, ...) with size, source_size, target, taken (longs; target is a double).

    taken is size times the number of times that the mix takes the document, 0 to cap. A null text has size 0. A null
    source is a source of its own, the last. Rows with equal doc_id, source and size are one unit of the sampling and
    share its decision. Documents without words need no decision: they are taken 0 words. Empty docs give an empty
    result. Existing columns of these names are replaced, others kept.
    """
    small_batches(docs.sparkSession)
    new = ["size", "source_size", "target", "taken"]
    sized = docs.drop(*new, "times").withColumn("size", n_words("text"))
    # sizes come from whole texts: computed once, then only numbers move
    units = materialize(sized.groupBy("doc_id", F.col("source").cast("string").alias("source"), "size").agg(F.count(F.lit(1)).alias("docs")))
    sources = materialize(targets(units.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size")), weights, cap))
    per = sources.withColumnRenamed("source", "s")
    same = F.col("source").eqNullSafe(F.col("s"))
    ratio = F.col("target") / F.col("source_size")
    whole = F.floor(ratio + EPS)
    p = F.greatest(ratio - whole, F.lit(0.0))
    units = units.where("size > 0").join(per, same).withColumns(
        {"p": F.when(p < EPS, 0.0).otherwise(p), "at": F.xxhash64("doc_id", "size"), "words": F.col("size") * F.col("docs")}
    )
    chosen = decide(units, block)
    chosen = chosen.where("p = 1").select(F.col("doc_id").alias("d"), F.col("source").alias("t"), F.col("size").alias("z"), F.lit(1).alias("more"))
    out = sized.join(per, F.col("source").cast("string").eqNullSafe(F.col("s")), "left")
    out = out.join(
        chosen, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("source").cast("string").eqNullSafe(F.col("t")) & (F.col("size") == F.col("z")), "left"
    )
    times = F.when(F.col("size") > 0, whole + F.coalesce(F.col("more"), F.lit(0))).otherwise(0).cast("long")
    return out.withColumn("taken", F.col("size") * times).drop("s", "d", "t", "z", "more")
