"""The corpus pipeline: language ID, exact dedup, near-dedup, benchmark decontamination, tokenisation.

Each stage reads its predecessor's rows as Parquet and works on all of them. The stages before the last return the
columns of ``documents``; the last returns what the tokenizer makes of each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import byte_bpe, common, decontaminate, exact_dedup, language, simhash

#: Stages past the first can't be expressed in SQL: the classifier is trained, and fingerprints link in components.
ORACLE_SQL = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told (null and empty texts, and those without a letter) go.

    Where lang is null it becomes the predicted language. Texts are whole; a doc_id may repeat; other columns stay.
    """
    return language.with_known_language(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays; a row without doc_id stays. Rows that repeat with one text count as one."""
    return exact_dedup.drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose fingerprints link, the smallest doc_id stays; a row without doc_id stays. Null texts link too."""
    return simhash.drop_near_duplicates(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark windows in a twentieth of their words or more go; null and empty texts stay."""
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the digests of the ids and of the bytes decoded from them; null texts have none."""
    return byte_bpe.encoded(docs)


STAGES = [
    ("language ID", known_language),
    ("exact dedup", exact),
    ("near-dedup", near),
    ("decontamination", clean),
    ("byte-level BPE", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each one's rows are written and read again before the next. An empty table
    gives no rows. ``session.clear_scratch`` removes what was written on the way, once the result is.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = common.materialise(docs, "stage")
    return docs
