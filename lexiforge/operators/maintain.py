"""Incremental maintenance: what to index, de-duplication, and replacing documents of an index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..session import written
from .index import dictionary


def unindexed(pages: DataFrame, needed: list[str], flag: str = "indexed") -> tuple[DataFrame, DataFrame]:
    """(rows to index, rejected): rows whose flag is false, null or absent; rejected lack one of the needed columns."""
    todo = pages.where(~F.coalesce(F.col(flag), F.lit(False))) if flag in pages.columns else pages
    whole = F.lit(True)
    for c in needed:
        whole = whole & F.col(c).isNotNull()
    return todo.where(whole), todo.where(~whole)


def deduplicate(docs: DataFrame, content: str, order: list[str]) -> DataFrame:
    """docs with content_hash, the first of each hash by order.

    The first is found by a grouped minimum, which combines before the shuffle, so that a content that a third of the
    rows share does not gather in one task.
    """
    hashed = docs.withColumn("content_hash", text.content_hash(F.col(content)))
    first = hashed.groupBy("content_hash").agg(F.min(F.struct(*order)).alias("first"))
    keys = first.select("content_hash", *[F.col(f"first.{c}").alias(c) for c in order])
    return hashed.join(keys, ["content_hash", *order], "left_semi")


def to_clean(changed: DataFrame, forward: DataFrame) -> DataFrame:
    """(doc_id) of changed documents that the index already has."""
    return changed.select("doc_id").distinct().join(forward.select("doc_id"), "doc_id", "left_semi")


def affected_words(ids: DataFrame, forward: DataFrame) -> DataFrame:
    """(word): words whose counts change when the documents go."""
    return forward.join(ids.select("doc_id"), "doc_id", "left_semi").select(F.explode("words").alias("word")).distinct()


def replace(postings: DataFrame, changed: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings, dictionary) after the postings of changed (doc_id) documents give way to new ones.

    Counts and idf are derived anew, so words that nothing uses any more fall out.
    """
    after = postings.join(changed.select("doc_id"), "doc_id", "left_anti").unionByName(new)
    return after, dictionary(after)


def upsert(table: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """table with the rows of changed in place of those with their keys; the last of repeated keys is not defined."""
    return table.join(changed.select(key), key, "left_anti").unionByName(changed, allowMissingColumns=True)


def set_field(table: DataFrame, values: DataFrame, key: str, field: str) -> DataFrame:
    """table with field from values (key, field) where they have its key, else as it was (null if it was absent)."""
    old = F.col(field) if field in table.columns else F.lit(None)
    renamed = values.select(key, F.col(field).alias("new_"))
    return table.join(renamed, key, "left").withColumn(field, F.coalesce("new_", old)).drop("new_")


def highest(table: DataFrame, key: str) -> DataFrame:
    return table.agg(F.max(key).alias(key))


def number(table: DataFrame, order: list[str], to: str = "n", within: list[str] | None = None) -> DataFrame:
    """table with consecutive numbers from 1 in the order of some columns, for each group of within (or throughout).

    Ranges of (within, order) are written with their numbers, so that every reader sees the same; a row's number is its
    place in its range and the rows of its group in ranges before. So a group of any size is spread over tasks. Equal
    rows of order get numbers of no certain order, and nulls come last.
    """
    group, ordered = within or [], [F.asc_nulls_last(c) for c in order]
    spread = written(table.repartitionByRange(*group, *ordered).withColumn("part_", F.spark_partition_id()))
    inside = F.row_number().over(Window.partitionBy("part_", *group).orderBy(*ordered))
    counts = spread.groupBy("part_", *group).agg(F.count(F.lit(1)).alias("rows_"))
    before = Window.partitionBy(*group).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("offset_", F.coalesce(F.sum("rows_").over(before), F.lit(0))).drop("rows_")
    counts = counts.withColumnsRenamed({c: f"{c}_of" for c in ["part_", *group]})
    same = F.col("part_") == F.col("part__of")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_of"))
    out = spread.withColumn(to, inside).join(counts, same)
    return out.withColumn(to, (F.col(to) + F.col("offset_")).cast("long")).drop("part_", "offset_", *[f"{c}_of" for c in ["part_", *group]])
