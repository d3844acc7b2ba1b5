"""Language identification by unigram pieces, summed over all segmentations.

Each language has probabilities for the pieces of a fixed public vocabulary (and for single letters, so that every
word can be spelled). A word's probability is the sum over all ways to cut it into pieces, by the forward algorithm; a
text's is the product over its words. Probabilities are fitted by expectation-maximisation on all words of a bounded
sample of labelled documents per language; each round's expected counts are summed on the executors.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freed, materialize, remove, small_batches

LETTERS = regex.compile(r"\p{L}+")
START = "▁"
#: Pieces up to this length are looked up for all words side by side; longer ones are rare, and added where they occur.
PIECE_CHARS = 8
#: Forward sums are scaled anew after so many letters, or (in the fit) where they fall under 1 / UP.
SCALE_CHARS, UP = 16, 1e100
#: Sample documents of a language (about), and rounds of fitting.
MOST_DOCS, ROUNDS = 1_500, 2
#: Pseudo-count of a piece that the language has not used, and log probability of a letter outside everything.
SMOOTH, UNKNOWN = 0.02, -14.0
#: Words whose scores a task remembers.
TASK_WORDS = 250_000
UND = "und"


def read_vocabulary(path: str, least: int = 1) -> list[str]:
    """Pieces of letters (with the word-start mark or without) of a sentencepiece model, in lower case."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = set()
    for i in range(model.get_piece_size()):
        p = model.id_to_piece(i).lower()
        body = p[1:] if p.startswith(START) else p
        if LETTERS.fullmatch(body) and len(body) >= least:
            found.add(p)
    return sorted(found)


def words_of(text: str) -> list[str]:
    """Runs of letters (Unicode's category L) in lower case."""
    return LETTERS.findall(text.lower())


def longest(pieces: Iterable[str]) -> int:
    return max(map(len, pieces), default=1)


class Model:
    """Piece log probabilities, one row per piece and one column per language."""

    def __init__(self, langs: list[str], pieces: list[str], logp: np.ndarray) -> None:
        self.langs, self.logp = langs, np.vstack([logp, np.full((1, len(langs)), UNKNOWN)])
        self.index = {p: i for i, p in enumerate(pieces)}
        self.longest = longest(self.index)

    def score(self, words: list[str]) -> np.ndarray:
        """Log probability of each word (rows) in each language: forward sums over all segmentations, words of one
        length side by side."""
        out, by_length = np.zeros((len(words), len(self.langs))), defaultdict(list)
        for i, w in enumerate(words):
            by_length[len(w) + 1].append((i, START + w))
        p = np.exp(self.logp)
        p = np.vstack([p, np.zeros((1, p.shape[1]))])  # the last row: no such piece
        none, unknown, get = len(p) - 1, len(p) - 2, self.index.get
        for n, items in by_length.items():
            strings = [s for _, s in items]
            # sums up to the last letters, as far back as a piece may start; at worst every letter is unknown, and
            # exp(UNKNOWN * (SCALE_CHARS + longest)) is still far from underflow
            alpha, scale = {0: np.ones((len(items), len(self.langs)))}, np.zeros((len(items), len(self.langs)))
            for j in range(1, n + 1):
                total = np.zeros_like(scale)
                for i in range(max(0, j - self.longest), j):
                    miss = unknown if j - i == 1 else none
                    ids = [get(s[i:j], miss) for s in strings]
                    if j - i <= PIECE_CHARS:
                        total += alpha[i] * p[ids]
                    elif rows := [r for r, x in enumerate(ids) if x != none]:
                        total[rows] += alpha[i][rows] * p[[ids[r] for r in rows]]
                alpha[j] = total
                alpha.pop(j - self.longest, None)
                if j % SCALE_CHARS == 0:
                    scale += np.log(total)
                    alpha = {i: x / total for i, x in alpha.items()}
            out[[i for i, _ in items]] = np.log(alpha[n]) + scale
        return out


def expected(words: dict[str, int], p: dict[str, float], floor: float) -> dict[str, float]:
    """Expected piece counts of the words under p, by forward and backward sums over all segmentations."""
    out: dict[str, float] = defaultdict(float)
    most = longest(p)

    def scaled(x: float, k: int) -> tuple[float, int]:
        return (x * UP, k + 1) if 0 < x < 1 / UP else (x, k)

    for word, n in words.items():
        s = START + word
        m = len(s)
        # sums are a[j] / UP ** ka[j] and b[i] / UP ** kb[i], so that those of long words do not vanish
        a, ka, leave = [1.0] + [0.0] * m, [0] * (m + 1), [[] for _ in range(m)]
        for j in range(1, m + 1):
            for i in range(max(0, j - most), j):
                q = p.get(s[i:j], floor if j - i == 1 else 0.0)
                if q:
                    leave[i].append((j, q))
                    a[j] += a[i] * q * UP ** (ka[j - 1] - ka[i])
            a[j], ka[j] = scaled(a[j], ka[j - 1])
        b, kb = [0.0] * m + [1.0], [0] * (m + 1)
        for i in range(m - 1, -1, -1):
            b[i], kb[i] = scaled(sum(q * b[j] * UP ** (kb[i + 1] - kb[j]) for j, q in leave[i]), kb[i + 1])
        if a[m] > 0:
            for i in range(m):
                for j, q in leave[i]:
                    out[s[i:j]] += n * (a[i] * q * b[j] / a[m] * UP ** (ka[m] - ka[i] - kb[j]))
    return out


def occurring(words: dict[str, int], known: set[str]) -> dict[str, float]:
    """Counts of all places where known pieces, and single characters, occur in words: where fitting starts from."""
    out, most = Counter(), longest(known)
    for w, n in words.items():
        s = START + w
        for i in range(len(s)):
            for j in range(i + 1, min(len(s), i + most) + 1):
                if j - i == 1 or s[i:j] in known:
                    out[s[i:j]] += n
    return out


def normalised(counts: dict[str, float], pieces: list[str]) -> dict[str, float]:
    total = sum(counts.get(x, 0.0) for x in pieces) + SMOOTH * len(pieces)
    return {x: (counts.get(x, 0.0) + SMOOTH) / total for x in pieces}


def fitted(langs: list[str], pieces: Iterable[str], start: Callable[[set[str]], dict[str, dict]], step: Callable[[dict[str, dict]], dict[str, dict]], rounds: int = ROUNDS) -> Model:
    """A model from start(pieces), the first counts by language, and step(probabilities), the expected ones of a round.
    Letters of any language join the pieces."""
    counts = start(set(pieces))
    pieces = sorted({*pieces, START, *(x for c in counts.values() for x in c if len(x) == 1)})
    p = {g: normalised(counts.get(g, {}), pieces) for g in langs}
    for _ in range(rounds):
        counts = step(p)
        p = {g: normalised(counts.get(g, {}), pieces) for g in langs}
    return Model(langs, pieces, np.array([[math.log(p[g][x]) for g in langs] for x in pieces]).reshape(len(pieces), len(langs)))


def fit_pieces(words: dict[str, dict[str, int]], pieces: list[str], rounds: int = ROUNDS) -> Model:
    """A model of each language's word counts."""
    floor = math.exp(UNKNOWN)
    return fitted(
        sorted(words), pieces, lambda known: {g: occurring(w, known) for g, w in words.items()}, lambda p: {g: expected(w, p[g], floor) for g, w in words.items()}, rounds
    )


def fit(docs: DataFrame, vocabulary: str, most_docs: int = MOST_DOCS) -> Model:
    """A model of docs (doc_id, text, lang). Rows without text or lang are left out.

    The sample is the documents of a language whose hashed doc_id falls under a share that keeps about most_docs of
    them, so that it is the same on every run and needs no sort; all of their words are fitted. Words and sums of each
    round stay on the executors; the driver holds one count per language and piece.
    """
    small_batches(docs.sparkSession)
    good = docs.where("text is not null and lang is not null")
    sizes = good.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"))
    share = F.least(F.lit(1.0), F.lit(float(most_docs)) / F.col("docs"))
    at = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 20)) / float(1 << 20)
    sample = good.join(F.broadcast(sizes), "lang").where(at < share).select("lang", "text")
    names, kinds = ["lang", "word", "n"], (pa.string(), pa.string(), pa.float64())

    def as_batch(rows: dict[tuple[str, str], float]) -> pa.RecordBatch:
        columns = ([k[0] for k in rows], [k[1] for k in rows], list(rows.values()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for i in range(b.num_rows):
                lang = b.column(0)[i].as_py()
                seen.update((lang, w) for w in words_of(b.column(1)[i].as_py()))
                if len(seen) > TASK_WORDS:
                    yield as_batch(seen)
                    seen.clear()
        yield as_batch(seen)

    kind = "lang string, word string, n double"
    counts = sample.mapInArrow(lambda it: freed(split(it)), kind).groupBy("lang", "word").agg(F.sum("n").alias("n"))
    # words are few bytes and much work, so they are dealt out evenly
    words = materialize(counts.repartition(2 * docs.sparkSession.sparkContext.defaultParallelism, "word"))

    def summed(count: Callable[[str, dict[str, int]], dict[str, float]]) -> dict[str, dict]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out: dict[tuple[str, str], float] = defaultdict(float)
            for b in batches:
                by_lang: dict[str, dict] = defaultdict(dict)
                for g, w, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    by_lang[g][w] = n
                for g, ws in by_lang.items():
                    for x, n in count(g, ws).items():
                        out[g, x] += n
            yield as_batch(out)

        got: dict[str, dict] = defaultdict(dict)
        for r in words.mapInArrow(lambda it: freed(run(it)), kind).groupBy("lang", "word").agg(F.sum("n").alias("n")).toLocalIterator():
            got[r["lang"]][r["word"]] = r["n"]
        return got

    def start(known: set[str]) -> dict[str, dict]:
        shared = docs.sparkSession.sparkContext.broadcast(known)
        return summed(lambda _, ws: occurring(ws, shared.value))

    def step(p: dict[str, dict]) -> dict[str, dict]:
        shared, floor = docs.sparkSession.sparkContext.broadcast(p), math.exp(UNKNOWN)
        return summed(lambda g, ws: expected(ws, shared.value[g], floor))

    langs = sorted(r["lang"] for r in words.select("lang").distinct().collect())
    model = fitted(langs, read_vocabulary(vocabulary), start, step)
    remove(words)
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs (text, ...) with lang_pred string and score double, from the text alone.

    score is the posterior of the predicted language under equal priors, with the log likelihood divided by the square
    root of the number of words, as words of a text are not independent. A null text, or one without letters, is und
    with score 0; so is every text if the model has no language. Ties go to the first language in code point order.
    Columns of these names are replaced, others kept.
    """
    # plain values, not the model: a broadcast is pickled by reference, and workers need not have this library
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, list(model.index), model.logp[:-1]))
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64())])

    small_batches(docs.sparkSession)

    @F.arrow_udf("struct<lang:string,score:double>")
    def guess(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from freed(guesses(batches))

    def guesses(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = Model(*shared.value)
        known: dict[str, int] = {}  # rows of table, which holds the scores of the words of this task
        table = np.zeros((TASK_WORDS, len(m.langs)))
        for texts in batches:
            out = []
            for at in range(0, len(texts), 64):
                each = [words_of(t or "") for t in texts.slice(at, 64).to_pylist()]
                new = list(set().union(*each).difference(known)) if m.langs else []
                if len(known) + len(new) > len(table):
                    known.clear()
                    new = list(set().union(*each))
                    table = np.zeros((max(TASK_WORDS, len(new)), len(m.langs)))
                if new:
                    table[len(known) : len(known) + len(new)] = m.score(new)
                    known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
                for ws in each:
                    if not ws or not m.langs:
                        out.append({"lang": UND, "score": 0.0})
                        continue
                    total = table[np.fromiter(map(known.__getitem__, ws), np.int64, len(ws))].sum(0) / math.sqrt(len(ws))
                    best = int(total.argmax())
                    out.append({"lang": m.langs[best], "score": float(1 / np.exp(total - total[best]).sum())})
            yield pa.array(out, kind)

    out = docs.drop("lang_pred", "score").withColumn("lang_guess", guess("text"))
    return out.withColumns({"lang_pred": F.col("lang_guess.lang"), "score": F.col("lang_guess.score")}).drop("lang_guess")
