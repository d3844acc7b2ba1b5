"""File sources and sinks: seed lists, stop words, pages, robots files, and JSON output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import crawl


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """(seq, url, domain) of a seed file: every line that parses as a URL."""
    lines = spark.read.text(path).withColumn("seq", F.monotonically_increasing_id())
    return crawl.seeds(lines)


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """(word) of a word list: lines trimmed, in lower case, without blanks and repeats."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).where("word <> ''").distinct()


def read_robots(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of robots files, each read whole."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def append_pages(pages: DataFrame, path: str) -> None:
    """Pages added to a Parquet table, in files of bounded numbers of rows."""
    pages.write.mode("append").option("maxRecordsPerFile", 200_000).parquet(path)


def to_json(results: DataFrame) -> DataFrame:
    """(json): one object per result, with the keys of the search service's answers."""
    keys = {
        "doc_id": "docId", "url": "url", "title": "title", "snippet": "snippet", "publish_date": "publishDate", "score": "score",
        "relevance": "relevance", "popularity": "popularity",
    }
    return results.select(F.to_json(F.struct(*[F.col(c).alias(k) for c, k in keys.items() if c in results.columns])).alias("json"))
