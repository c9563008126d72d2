"""A training corpus from raw documents: language ID, near copies, decontamination, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessella.llm import decontaminate, jaccard, language_id, packing, pii, tables, tokens


def _counted(docs: DataFrame) -> DataFrame:
    """With n_chars, where there is one, of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the filters know; those without text or letters go."""
    return language_id.keep_known(docs, language_id.train(docs))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies."""
    return jaccard.drop_near_copies(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that the benchmark has."""
    return _counted(decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return _counted(pii.redact(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 2,048 tokens."""
    return packing.pack(docs, tokens.tokenizer_path("byte_bpe_50k.json"), end_id=1)


STAGES = [
    ("language_id", known_language),
    ("near_copies", one_of_each_group),
    ("decontamination", without_benchmark),
    ("pii", without_personal_data),
    ("packing", packed),
]

#: The learned and iterative stages have no SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = tables.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
