"""A corpus pipeline: language ID, near-duplicates, repeated passages, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; its result is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyweave.llm import bpe, langid, mixing, near_dedup, queries, suffix_dedup
from tallyweave.llm.shared import new_path

#: The least posterior probability of a document's language.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language; those without a letter or with no likely language go."""
    model = langid.fit_languages(docs.where(~queries.held_out()).select("text", "lang"), queries.public_file("piece_bpe_32k.model"))
    return langid.with_language(docs, model).where(f"lang_pred <> 'und' AND score >= {LEAST_SCORE}").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class."""
    return near_dedup.keep_one_of_each(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words that stand earlier."""
    return suffix_dedup.without_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the token ids and the decoded text of each row."""
    return bpe.bpe_digests(docs, queries.public_file("word_bpe_49k.json"))


STAGES = [("language_id", language), ("near_dedup", near_duplicates), ("suffix_dedup", passages), ("source_mix", mix), ("bpe", encode)]
#: Fitted models and sampling draws have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each stage's rows are written in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
