"""Structured Streaming: pages indexed as they arrive, and response averages kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import index


def index_stream(pages: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Postings of streamed pages (page_id, url, html), appended batch by batch under path/postings.

    A batch has a folder of its own that a repeated run of it overwrites, so each page is indexed once. Counts and idf
    are derived from the postings when the index is read (load).
    """

    def write(batch: DataFrame, number: int) -> None:
        fields = index.fields_of_pages(batch)
        index.postings(fields, shown=True).write.mode("overwrite").parquet(f"{path}/postings/batch={number}")
        fields.select("doc_id", "url", "title", "timestamp").write.mode("overwrite").parquet(f"{path}/docs/batch={number}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def load(spark: SparkSession, path: str) -> index.Index:
    """The streamed index; of a page that came several times the latest batch counts."""
    posted, docs = (spark.read.parquet(f"{path}/{t}") for t in ("postings", "docs"))
    last = docs.groupBy("doc_id").agg(F.max("batch").alias("batch"))
    posted, docs = (x.join(last, ["doc_id", "batch"], "left_semi").drop("batch") for x in (posted, docs))
    lengths = posted.groupBy("doc_id").agg(F.max("length").alias("length"))
    return index.Index(posted, index.dictionary(posted), docs.join(lengths, "doc_id").withColumn("popularity", F.lit(0.0)))


def fold(average: int | None, ms: float) -> int:
    """The average after one more response; cut to whole milliseconds at each step."""
    return int(ms) if average is None else int(0.7 * average + 0.3 * ms)


def averages(responses: DataFrame) -> DataFrame:
    """(domain, average, successes) after each micro-batch, of streamed responses (domain, at, seq, ms)."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        average, count = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(["at", "seq"])
        for ms in rows["ms"]:
            average, count = fold(average, ms), count + 1
        state.update((average, count))
        yield pd.DataFrame({"domain": [key[0]], "average": [average], "successes": [count]})

    out = "domain string, average int, successes long"
    return responses.groupBy("domain").applyInPandasWithState(update, out, "average int, successes long", "update", GroupStateTimeout.NoTimeout)
