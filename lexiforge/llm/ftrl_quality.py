"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Tokens are runs of word characters and runs of other visible characters; unigrams and bigrams are hashed into a table
of fixed size. Training is per-coordinate FTRL-proximal over a bounded sample of labelled rows, in a fixed order; the
model is a dense vector of weights, sent to every task, and a score is one sparse dot product.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freed, small_batches

#: Size of the hashed feature space (a power of 2), longest remembered vocabulary of a task.
DIMS, TASK_WORDS = 1 << 18, 100_000
#: Labelled rows that a model may be trained on, and passes over them.
MOST_ROWS, EPOCHS = 6_000, 5
#: FTRL-proximal: learning rate, smoothing, and the two penalties.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.002, 0.01
#: Length of every feature vector.
NORM = 4.0
TOKENS = re.compile(r"\w+|[^\w\s]+")
MIX = np.uint64(0x9E3779B97F4A7C15)


class Features:
    """Hashed features of texts; the hashes of words seen in a task are remembered up to a bound."""

    def __init__(self, dims: int = DIMS) -> None:
        self.dims, self.known = np.uint64(dims - 1), {}

    def __call__(self, text: str) -> tuple[np.ndarray, float]:
        """Distinct feature indices, and the value that each has."""
        words, known = TOKENS.findall(text), self.known
        if not words:
            return np.empty(0, np.int64), 0.0
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        if len(known) > TASK_WORDS:
            known.clear()
        # a word after itself is one feature whatever the word, so that stutter is recognised in unseen words
        pairs = np.where(h[:-1] == h[1:], np.uint64(7), (h[:-1] * MIX) ^ (h[1:] >> np.uint64(17)) ^ h[1:])
        mixed = np.concatenate([h, pairs * MIX])
        mixed ^= mixed >> np.uint64(29)
        index = np.unique((mixed * MIX >> np.uint64(40)) & self.dims).astype(np.int64)
        return index, NORM / np.sqrt(len(index))


def train(rows: list[tuple[np.ndarray, float, int]], dims: int = DIMS, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias from (indices, value, label) in the order given; without rows all zero, a score of one half."""
    z, n = np.zeros(dims + 1), np.zeros(dims + 1)

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        return np.where(np.abs(zi) <= L1, 0.0, w)

    for _ in range(epochs):
        for index, value, label in rows:
            i = np.append(index, dims)  # the last coordinate is the bias
            x = np.append(np.full(len(index), value), 1.0)
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - label) * x
            s = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - s * w
            n[i] += g * g
    w = weights(np.arange(dims + 1))
    return w[:-1], float(w[-1])


def fit(labelled: DataFrame, most_rows: int = MOST_ROWS, dims: int = DIMS) -> tuple[np.ndarray, float]:
    """A model of labelled (key, text, label): at most most_rows rows, those with the smallest hash of their key.

    Rows without label or key are left out; a null text is empty. Of rows with one key, one counts (that with the least
    features), however often it is repeated. Features are made on the executors; the driver gets index arrays of the
    bounded sample only.
    """

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Features(dims)
        for b in batches:
            for row in range(b.num_rows):
                index, value = make(b.column(1)[row].as_py() or "")
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(row, 1), pa.array([index.astype(np.int32).tobytes()], pa.binary()), pa.array([value]), b.column(2).slice(row, 1)],
                    ["at", "index", "value", "label"],
                )

    at = F.xxhash64(F.col("key").cast("string"))
    # keys first: only the sample's texts are read and moved
    sample = labelled.where("key is not null and label is not null").select(at.alias("at"), "text", F.col("label").cast("int").alias("label"))
    made = sample.mapInArrow(lambda it: freed(features(it)), "at long, index binary, value double, label int")
    # one row a key before anything is collected: partial sums drop repeats where they stand
    one = made.groupBy("at").agg(F.min(F.struct("index", "value", "label")).alias("x")).orderBy("at").limit(most_rows)
    rows = sorted((r["at"], *r["x"]) for r in one.collect())
    return train([(np.frombuffer(i, np.int32).astype(np.int64), v, y) for _, i, v, y in rows], dims)


def sample_keys(labels: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """(key, label): one label per key, the keys with the smallest hashes, most_rows at most."""
    one = labels.where("key is not null and label is not null").groupBy("key").agg(F.min("label").alias("label"))
    return one.orderBy(F.xxhash64(F.col("key").cast("string")), "key").limit(most_rows)


def score(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = 0.3) -> DataFrame:
    """docs (text, ...) with score double and predicted int.

    A null or empty text has the score of the bias alone. Equal texts get equal scores. Columns of these names are
    replaced, others kept.
    """
    weights, bias = docs.sparkSession.sparkContext.broadcast(model[0].astype(np.float32)), model[1]

    small_batches(docs.sparkSession)

    @F.arrow_udf("double")
    def dot(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from freed(scores(batches))

    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        make, w = Features(len(weights.value)), weights.value
        for texts in batches:
            out = []
            for t in texts:
                index, value = make(t.as_py() or "")
                out.append(float(w[index].sum(dtype=np.float64)) * value + bias)
            yield pa.array(1 / (1 + np.exp(-np.clip(np.array(out, float), -35, 35))), pa.float64())

    out = docs.drop("score", "predicted").withColumn("score", dot("text"))
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
