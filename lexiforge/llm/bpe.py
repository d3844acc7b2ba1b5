"""Byte-level BPE over a table of distinct words.

Texts are split into pre-tokens ("words") in Spark, counted over the whole corpus, and each distinct word of the table
is encoded once. The table's head, of bounded size and bytes, goes to every task, where ids are joined back by
position; words beyond the head are encoded where they stand, once in a task. Decoding joins ids with the table of
pieces, a row for each id, and puts the pieces' bytes together; for the head's words that is one join in Spark. The
tokenizer's file is a parameter and is never trained or copied.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import freed, materialize, small_batches

#: Unicode White_Space, as the tokenizer's pattern reads \s; fixed values.
SPACE = "\\x09-\\x0d\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The public byte-level BPE pattern.
PATTERN = rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Characters that every Unicode version of the last years classes alike; a text with others is split by the
#: tokenizer's own library, whose Unicode tables may be older than Python's.
STABLE = "\\x00-\u0557\u2010-\u205e\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
#: Bounds of the table's head, not of the table: words, characters of a word, and characters of all words together.
HEAD_WORDS, HEAD_WORD_CHARS, HEAD_CHARS = 1 << 17, 48, 4_000_000
#: Distinct words and characters of texts after which a task hands its counts on, and words it remembers beyond the head.
COUNT_FLUSH, COUNT_CHARS, TASK_WORDS = 200_000, 1 << 28, 200_000
#: Rows of an Arrow batch that become Python objects at a time.
SLICE = 64


class Codec:
    """A tokenizer file as its own library reads it, with the parts that the word table needs."""

    def __init__(self, source: str) -> None:
        import regex
        from tokenizers import Tokenizer

        # tasks share the cores already
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(source)
        spec = json.loads(source)
        if spec["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} or spec["normalizer"]:
            raise ValueError("a byte-level BPE without normalizer and prefix blank is needed")
        self.split, self.rare = regex.compile(PATTERN).findall, re.compile(f"[^{STABLE}]").search
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.merge = self.merger(spec)
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None

    def find(self, text: str) -> list[str]:
        if self.rare(text):
            return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return self.split(text)

    def words(self, text: str) -> list[str]:
        """Pre-tokens in order; special tokens' strings stand alone, as the library reads them."""
        if self.cut is None or not self.cut.search(text):
            return self.find(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [*self.find(text[at : m.start()]), m[0]]
            at = m.end()
        return out + self.find(text[at:])

    def encode(self, words: list[str]) -> list[list[int]]:
        """Ids of words, each a pre-token or a special token."""
        if self.merge is None:
            return [e.ids for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]
        return [[self.special[w]] if w in self.special else self.merge(w.encode()) for w in words]

    def merger(self, spec: dict) -> Callable[[bytes], list[int]] | None:
        """A quicker merge loop over bytes, where ids follow the order of the merges, so that an id is its rank."""
        import tiktoken

        model = spec["model"]
        made = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = [model["vocab"][a + b] for a, b in made]
        ranks = {p: i for i, p in enumerate(self.pieces()) if i not in self.special.values()}
        if ids != sorted(ids) or len(ranks) != len(model["vocab"]) - len(self.special.keys() & model["vocab"].keys()) or min(ids) < 256:
            return None
        return tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def pieces(self) -> list[bytes]:
        """Bytes of each id, undoing the printable stand-ins of byte-level vocabularies."""
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown}
        byte_of |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        out = [b""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            out[i] = piece.encode() if piece in self.special else bytes(byte_of[c] for c in piece)
        return out


def texts_of(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of batches with their texts, null as empty."""
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            part = b.slice(at, SLICE)
            yield part, [t or "" for t in part.column(column).to_pylist()]


def count_words(docs: DataFrame, source: str) -> DataFrame:
    """(word, n) over all texts; each task sums its own words first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, seen = Codec(source), Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])
            seen.clear()
            return out

        chars = 0

        for _, texts in texts_of(batches):
            for t in texts:
                seen.update(codec.words(t))
                chars += len(t)
            if len(seen) > COUNT_FLUSH or chars > COUNT_CHARS:
                yield flush()
                chars = 0
        yield flush()

    return docs.select("text").mapInArrow(lambda it: freed(count(it)), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def piece_table(spark: SparkSession, source: str) -> DataFrame:
    """(id, piece): the bytes of each id of the vocabulary, whose size is fixed."""
    return spark.createDataFrame([(i, bytearray(p)) for i, p in enumerate(Codec(source).pieces())], "id int, piece binary")


def word_table(docs: DataFrame, source: str, most: int = HEAD_WORDS, chars: int = HEAD_CHARS) -> DataFrame:
    """(word, n, ids, data) of the most frequent words: each encoded once, and data its ids' pieces, joined by id.

    Counts fall into 8 classes a doubling; the head is the most frequent classes that fit the bounds together. So a
    histogram of some hundred rows finds it, not a global sort.
    """
    small_batches(docs.sparkSession)
    level = F.floor(F.log2("n") * 8).cast("int")
    counts = materialize(count_words(docs, source).withColumn("level", level)).where(F.length("word") <= HEAD_WORD_CHARS)
    least, words, length = 10**9, 0, 0
    levels = counts.groupBy("level").agg(F.count(F.lit(1)).alias("w"), F.sum(F.length("word")).alias("c")).collect()
    for r in sorted(levels, key=lambda r: -r["level"]):
        words, length = words + r["w"], length + r["c"]
        if words > most or length > chars:
            break
        least = r["level"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(source)
        for b in batches:
            ids = codec.encode(b.column(0).to_pylist()) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int32()))], ["word", "n", "ids"])

    head = counts.where(F.col("level") >= least).select("word", "n")
    head = head.mapInArrow(lambda it: freed(encode(it)), "word string, n long, ids array<int>")
    each = head.select("word", "n", "ids", F.posexplode("ids").alias("at", "id")).join(F.broadcast(piece_table(docs.sparkSession, source)), "id")
    parts = each.groupBy("word", "n", "ids").agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("parts"))
    data = F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x.getField("piece")))
    return parts.select("word", "n", "ids", data.alias("data"))


def with_ids(docs: DataFrame, source: str, fields: str, value: Callable, combine: Callable, table: DataFrame | None = None) -> DataFrame:
    """docs and fields: combine(values) makes a row's fields of the values of its words in order, and value(ids, data) is
    a word's, made once for each distinct word of its ids and its pieces' bytes; for the head's before it is sent out, so
    that workers hold the values only."""
    head = {r["word"]: value(list(r["ids"]), bytes(r["data"])) for r in (word_table(docs, source) if table is None else table).toLocalIterator()}
    shared = docs.sparkSession.sparkContext.broadcast(head)
    added = StructType.fromDDL(fields)
    names = added.fieldNames()
    docs = docs.drop(*names)
    schema = StructType([*docs.schema, *added])
    at = docs.columns.index("text")
    out = to_arrow_schema(schema)

    def join_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(source)
        pieces = codec.pieces()

        class Words(dict):
            """Values by word: the head's, and those of other words from their first place in this task on."""

            def __missing__(self, word: str) -> object:
                ids = codec.encode([word])[0]
                v = self[word] = value(ids, b"".join(map(pieces.__getitem__, ids)))
                return v

        table = shared.value
        known = Words(table)
        for part, texts in texts_of(batches, at):
            rows = []
            for t in texts:
                rows.append(combine(list(map(known.__getitem__, codec.words(t)))))
                if len(known) > len(table) + TASK_WORDS:
                    known = Words(table)
            cols = [pa.array([r[k] for r in rows], out.field(n).type) for k, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays([*[c.cast(out.field(k).type) for k, c in enumerate(part.columns)], *cols], schema=out)

    return docs.mapInArrow(lambda it: freed(join_back(it)), schema)


def encode(docs: DataFrame, source: str, table: DataFrame | None = None) -> DataFrame:
    """docs (text, ...) with ids array<int>: those of the library's encode(text, add_special_tokens=False).

    source: the tokenizer's JSON. A null or empty text has no ids; repeated rows get equal ids; docs without rows give
    none. An existing column ids is replaced, others are kept.
    """
    return with_ids(docs, source, "ids array<int>", lambda ids, _: tuple(ids), lambda values: [[*chain.from_iterable(values)]], table)


def decode(encoded: DataFrame, source: str) -> DataFrame:
    """encoded (ids, ...) with decoded string: the bytes of the ids' pieces, read as UTF-8.

    The piece table has one row per id of the vocabulary, a fixed size, and is sent to every task, where ids are joined
    with it in their order. Null ids give null; ids outside the vocabulary give nothing; bytes that are no UTF-8 become
    U+FFFD, as in the library.
    """
    small_batches(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(dict(enumerate(Codec(source).pieces())))

    @F.arrow_udf("string")
    def text_of(ids: pa.Array) -> pa.Array:
        piece = shared.value.get
        return pa.array([None if x is None else b"".join(piece(i, b"") for i in x).decode("utf-8", "replace") for x in ids.to_pylist()], pa.string())

    return encoded.drop("decoded").withColumn("decoded", text_of("ids"))


def digests(docs: DataFrame, source: str, table: DataFrame | None = None) -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256, made in one pass; nulls and repeats as in encode().

    A word's value is the decimals of its ids, and the bytes of their pieces.
    """

    def value(ids: list[int], data: bytes) -> tuple[str, bytes]:
        return ",".join(map(str, ids)), data

    def combine(values: list[tuple[str, bytes]]) -> list:
        ids, data = zip(*values, strict=True) if values else ((), ())
        ids, text = ",".join(ids), b"".join(data).decode("utf-8", "replace").encode()
        return [ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text).hexdigest()]

    return with_ids(docs, source, "n_tokens long, ids_sha256 string, decoded_sha256 string", value, combine, table)
