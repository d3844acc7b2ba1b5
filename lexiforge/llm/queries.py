"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, cube_mix, decision_list, embed_dedup, ftrl_quality, jaccard_rtree, langid, pii, sharding, url_reputation
from .common import table
from .sql import oracles

#: Tokenizer files are parameters; these are the production ones.
BPE_FILE, PIECES_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
SHARDS = [f"shard-{i:03d}" for i in range(64)]


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_json() -> str:
    with open(tokenizer(BPE_FILE), encoding="utf-8") as f:
        return f.read()


def remainder(n: int) -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among all vectors; vectors without a direction link with nothing, repeated rows are rows of their own."""
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every whole text; null texts count as empty."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(docs, tokenizer_json()).drop("text")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted features and verdict of every text, learned from labels outside the held-out fifth; null texts fail."""
    labels = table(spark, sf_dir, "labels").where(remainder(5) != 0).select("doc_id", (F.col("quality") == 0).alias("bad"))
    out = decision_list.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), labels)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def language_model(docs: DataFrame) -> langid.Model:
    return langid.fit(docs.where(F.coalesce(remainder(3) != 1, F.lit(False))), tokenizer(PIECES_FILE))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learned outside the held-out third; und for null texts and those without letters."""
    docs = table(spark, sf_dir, "documents")
    out = langid.predict(docs.select("doc_id", "text"), language_model(docs))
    return out.select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def page_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(host, bad): a page's url ends with the number of the document that it shows, and labels judges documents."""
    labels = table(spark, sf_dir, "labels").where("doc_id is not null and quality is not null")
    labels = labels.groupBy("doc_id").agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad"))
    url = F.col("url")
    number = F.regexp_extract(url_reputation.path_of(url), r"/([0-9]{1,18})(?:\.html|/)?$", 1).try_cast("long")
    pages = table(spark, sf_dir, "pages").select(url_reputation.host_of(url).alias("host"), number.alias("doc_id"))
    return pages.where("doc_id is not null").join(labels, "doc_id").select("host", "bad")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every url, by rule or by the reputation of its host; urls without scheme are allowed."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_reputation.judge(pages, page_outcomes(spark, sf_dir)).select("page_id", "host", "path", "rule", "verdict")


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document; null texts have none, a null source is the last one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return cube_mix.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def quality_model(docs: DataFrame, labels: DataFrame) -> tuple:
    """A model from labels (doc_id, quality) of documents outside the held-out fifth."""
    labels = labels.where(remainder(5) != 0).select(F.col("doc_id").alias("key"), F.col("quality").alias("label"))
    keys = ftrl_quality.sample_keys(labels)
    texts = docs.select(F.col("doc_id").alias("key"), "text")
    # the sample has at most MOST_ROWS keys, so it is sent to the texts and no text is moved
    return ftrl_quality.fit(texts.join(F.broadcast(keys), "key"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every text, learned outside the held-out fifth; empty texts have the score of the bias."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = ftrl_quality.score(docs, quality_model(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents with similar shingle sets; texts without words link with nothing."""
    return jaccard_rtree.groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def span_columns(found: DataFrame) -> DataFrame:
    spans = F.col("pii")
    count = lambda k: F.size(F.filter(spans, lambda s: s.getField("kind") == k)).cast("long")
    write = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s.getField("kind"), s.getField("start"), s.getField("end"))), ",")
    base = F.filter(spans, lambda s: s.getField("kind").isin(pii.KINDS))
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in pii.KINDS], F.sha2(write(base), 256).alias("base_sha256"), write(spans).alias("spans"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every text; null texts count as empty, repeated rows get equal spans."""
    return span_columns(pii.find(table(spark, sf_dir, "documents").select("doc_id", "text")))


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op9, which SQL can express: the operator without learned patterns."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    none = spark.createDataFrame([], "pattern string, score double, n long")
    return span_columns(pii.find(docs, none)).drop("spans")


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op3, which SQL can express."""
    counted = decision_list.features(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return counted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", decision_list.base_failed().alias("base_failed"))


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources' sizes and targets of op6, which SQL can express."""
    mixed = cube_mix.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    by = mixed.groupBy("source").agg(F.max("source_size").alias("source_size"), F.max("target").alias("target"))
    return by.withColumn("target", F.round("target", 6))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot and shard of every document; equal ids, repeated rows included, go together."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return sharding.place(docs, "doc_id", SHARDS).select("doc_id", "slot", "shard")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of corpus_pipeline.run(), all stages over the whole table."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = [
        op1_embedding_near_dedup, op2_bpe, op3_quality_rules, op4_language_id, op5_url_filter,
        op6_source_mix, op7_quality_classifier, op8_ngram_jaccard_join, op9_pii, op10_sharding, pipeline,
        quality_base, mix_targets, pii_base,
    ]
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return oracles(SHARDS)
