"""A corpus pipeline of five stages over the documents table; each stage's result is a Parquet table of its own.

A stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of
documents (doc_id, text, lang, source, n_chars).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiforge.llm import bpe, cube_mix, jaccard_rtree, langid, pii
from lexiforge.llm.common import materialize, table
from lexiforge.llm.queries import language_model, tokenizer_json

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Least posterior with which a document's language counts as recognised.
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those without letters, or of doubtful language, go."""
    judged = langid.predict(docs, language_model(docs))
    return judged.where((F.col("lang_pred") != langid.UND) & (F.col("score") >= LEAST_SCORE)).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest doc_id.

    Repeated rows (equal doc_id and text) count once. Rows with a null doc_id belong to no group and stay.
    """
    kept = jaccard_rtree.groups(docs).where("doc_id = component_id").select("doc_id").distinct()
    once = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("source", "lang", "n_chars")
    stay = docs.join(kept, "doc_id", "left_semi").withColumn("copy", F.row_number().over(once)).where("copy = 1")
    return stay.select(COLUMNS).union(docs.where("doc_id is null").select(COLUMNS))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts replaced by its kind; n_chars counts the new text."""
    return pii.mask(docs).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, or in one to three rows."""
    mixed = cube_mix.mix(docs).where("taken > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), (F.col("taken") / F.col("size")).cast("int")))).select(COLUMNS)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's token ids."""
    out = bpe.encode(docs.select("doc_id", "source", "text"), tokenizer_json())
    return out.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_copies),
    ("pii", mask_personal_data),
    ("source_mix", mix_sources),
    ("bpe", encode_tokens),
]

#: Learned and sampled stages have no SQL; tests compare the pipeline with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
