"""The positional inverted index: weighted fields, positions, postings, dictionary, forward index.

Tables are flat: postings (word, doc_id, ...) and dictionary (word, doc_count, idf), so that a query reads the rows and
columns of its words only. A document's postings need nothing but the document, so they are made where its row is read,
in one pass over Arrow batches and without a shuffle; a task remembers the stems of its words. Only the dictionary and
the documents' lengths are grouped sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from ..functions import html, text
from ..functions.stem import stem, stem_word
from ..session import written

#: Importance of a word's occurrence by field; fixed values.
WEIGHTS = {"title": 3.0, "header": 2.0, "body": 1.0}
#: Documents that become Python objects at a time, postings after which a task hands on, and stems that it remembers.
SLICE, FLUSH, TASK_WORDS = 64, 20_000, 500_000


def moment(df: DataFrame) -> Column:
    """Milliseconds since the epoch at which a row was fetched, where the table says so."""
    return (F.col("timestamp") if "timestamp" in df.columns else F.lit(None)).cast("long").alias("timestamp")


def fields_of_pages(pages: DataFrame, complete: bool = False) -> DataFrame:
    """(doc_id, url, fields, title, timestamp) of pages (page_id, url, html, timestamp if any): title, then headings by
    level, then body. With complete, character references count only with their semicolons."""
    whole = pages.select(
        F.col("page_id").alias("doc_id"), "url", html.title(F.col("html"), complete).alias("title"),
        html.headings(F.col("html"), complete).alias("heads"), html.body_text(F.col("html"), complete).alias("body"), moment(pages),
    )
    field = lambda kind, value: F.struct(F.lit(kind).alias("field"), value.alias("value"))
    heads = F.transform("heads", lambda h: field("header", h))
    fields = F.concat(F.array(field("title", F.col("title"))), heads, F.array(field("body", F.col("body"))))
    return whole.select("doc_id", "url", "title", fields.alias("fields"), "timestamp")


def fields_of_documents(docs: DataFrame, title: Column | None = None) -> DataFrame:
    """(doc_id, url, fields, title, timestamp) of plain documents (doc_id, text, timestamp if any), which are body only
    unless a title is given."""
    field = lambda kind, value: F.struct(F.lit(kind).alias("field"), value.alias("value"))
    parts = [field("title", title)] if title is not None else []
    shown = F.lit("") if title is None else title
    return docs.select("doc_id", F.lit("").alias("url"), F.array(*parts, field("body", F.col("text"))).alias("fields"), shown.alias("title"), moment(docs))


def occurrences(fields: DataFrame) -> DataFrame:
    """(doc_id, position, token, field): kept tokens of all fields in order, numbered through from 0.

    A document's tokens are an array of its own row; only the exploded result is as long as the text.
    """
    tagged = F.flatten(F.transform("fields", lambda f: F.transform(text.kept(f.getField("value")), lambda t: F.struct(t.alias("token"), f.getField("field").alias("field")))))
    return fields.select("doc_id", F.posexplode(tagged).alias("position", "o")).select("doc_id", "position", "o.token", "o.field")


def stems(tokens: DataFrame) -> DataFrame:
    """(token, word): each distinct token is stemmed once.

    Distinct tokens are few bytes but much work, so they are dealt out by number, which adaptive plans do not merge.
    """
    parts = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tokens.select("token").distinct().repartition(parts, "token").withColumn("word", stem(F.col("token")))


def entries(fields: list[dict], word_of: dict[str, str], shown: bool) -> dict[str, list]:
    """Of one document, by word: titled occurrences, importance, positions, and snippets (if shown)."""
    out: dict[str, list] = {}
    position = 0
    for part, f in enumerate(fields):
        weight, titled = WEIGHTS.get(f["field"], 0.0), f["field"] == "title"
        for token in text.kept_tokens(f["value"]):
            e = out.setdefault(word_of[token], [0, 0.0, [], []])
            e[0] += titled
            e[1] += weight
            e[2].append(position)
            if shown:
                e[3].append((part, token))
            position += 1
    if shown:
        lows, made = [(f["value"] or "").lower() for f in fields], {}
        for e in out.values():
            for at in set(e[3]).difference(made):
                made[at] = text.snippet(fields[at[0]]["value"], lows[at[0]], at[1])
            e[3] = text.best_three_of([s for at in e[3] if (s := made[at]) is not None])
    return out


POSTED = "frequency int, tf double, in_title boolean, importance_score double, length int, title_length int, positions array<int>"


def postings(fields: DataFrame, stemmed: bool = True, shown: bool = False) -> DataFrame:
    """(word, doc_id, frequency, tf, in_title, importance_score, length, title_length, positions) of documents (doc_id,
    fields), and snippets if shown: three at most, of all occurrences in order.

    tf is frequency over the document's kept tokens; in_title tells whether the title has the word; title_length is the
    number of kept tokens in the title, whose positions come first. Documents without tokens have no postings.
    """
    key = fields.schema["doc_id"].dataType
    schema = StructType.fromDDL(f"word string, {POSTED}" + (", snippets array<string>" if shown else ""))
    schema = StructType([schema[0], StructField("doc_id", key), *schema[1:]])
    arrow = to_arrow_schema(schema)

    class Stems(dict):
        def __missing__(self, token: str) -> str:
            word = self[token] = stem_word(token) if stemmed else token
            return word

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rows = Stems(), []
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                for doc, each in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    found = entries(each or [], known, shown)
                    length, title = sum(len(e[2]) for e in found.values()), sum(e[0] for e in found.values())
                    for word, (titled, importance, places, snips) in found.items():
                        n = len(places)
                        rows.append((word, doc, n, n / length, titled > 0, importance, length, title, places, *[snips] * shown))
                    if len(rows) > FLUSH:
                        yield batch(rows)
                        rows = []
                    if len(known) > TASK_WORDS:
                        known = Stems()
        if rows:
            yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return fields.select("doc_id", "fields").mapInArrow(made, schema)


def positions(posted: DataFrame) -> DataFrame:
    """(doc_id, position, word) of all occurrences in postings."""
    return posted.select("doc_id", F.explode("positions").alias("position"), "word")


def dictionary(posted: DataFrame) -> DataFrame:
    """(word, doc_count, idf): idf = ln(N / (1 + df)), negative where nearly all documents have the word."""
    counts = posted.groupBy("word").agg(F.count(F.lit(1)).cast("int").alias("doc_count"))
    n = posted.select("doc_id").distinct().agg(F.count(F.lit(1)).alias("n_docs"))
    return counts.join(F.broadcast(n)).select("word", "doc_count", F.log(F.col("n_docs") / (1 + F.col("doc_count"))).alias("idf"), "n_docs")


def forward(posted: DataFrame) -> DataFrame:
    """(doc_id, words): the distinct words of each document in order."""
    return posted.groupBy("doc_id").agg(F.array_sort(F.collect_set("word")).alias("words"))


def nested(posted: DataFrame, words: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """The export form: (word, doc_count, idf, postings array), each posting with its document's url, title, timestamp
    and popularity where docs are given. Very frequent words make long rows."""
    if docs is not None:
        posted = posted.join(docs.select("doc_id", "url", "title", "timestamp", "popularity"), "doc_id", "left")
    columns = ["doc_id", *[c for c in posted.columns if c not in ("word", "doc_id")]]
    lists = posted.groupBy("word").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("postings"))
    return words.select("word", "doc_count", "idf").join(lists, "word")


def snippets(fields: DataFrame, stemmed: bool = True) -> DataFrame:
    """(doc_id, word, snippets): one snippet per occurrence in the order of position, of which three at most are kept.

    A snippet depends on field text and token only, so it is made once for each distinct pair of a document.
    """
    return postings(fields, stemmed, True).select("doc_id", "word", "snippets").where(F.size("snippets") > 0)


@dataclass
class Index:
    """The tables of an index. docs has one row per document: doc_id, url, title, length, popularity, timestamp."""

    postings: DataFrame
    dictionary: DataFrame
    docs: DataFrame

    def save(self, path: str) -> None:
        """Tables sorted by key, so that Parquet's statistics skip what a query does not need."""
        self.postings.repartitionByRange("word", "doc_id").sortWithinPartitions("word", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
        self.dictionary.repartitionByRange("word").sortWithinPartitions("word").write.mode("overwrite").parquet(f"{path}/dictionary")
        self.docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.mode("overwrite").parquet(f"{path}/docs")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Index:
        return Index(*(spark.read.parquet(f"{path}/{t}") for t in ("postings", "dictionary", "docs")))


def build(fields: DataFrame, popularity: DataFrame | None = None, stemmed: bool = True, shown: bool = True) -> Index:
    """An index of fields (doc_id, url, fields, title, timestamp); popularity (doc_id, popularity) defaults to 0. Without
    shown it holds no snippets, and its search results none either.

    Postings and dictionary are tables of the shared folder, made once and read by each part of a query.
    """
    posted = written(postings(fields, stemmed, shown))
    lengths = posted.groupBy("doc_id").agg(F.max("length").alias("length"))
    docs = fields.select("doc_id", "url", "title", "timestamp").join(lengths, "doc_id")
    docs = docs.join(popularity, "doc_id", "left") if popularity is not None else docs.withColumn("popularity", F.lit(0.0))
    return Index(posted, written(dictionary(posted)), docs.withColumn("popularity", F.coalesce("popularity", F.lit(0.0))))
