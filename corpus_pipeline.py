"""The corpus pipeline: language ID, near-duplicates, decontamination, secrets, packing.

Each stage reads the documents its predecessor wrote, acts on all of them and hands on
documents with the same columns; the last returns the packed pieces.

Defined results: an empty table passes through as an empty table; documents whose text is
null have no language and go in the first stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import common, decontaminate, language_id, near_dup, packing, secrets
from corpusloom.shipping import shipped

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text whose best language has a mean posterior below this is rejected; half of one and half of another is not.
LEAST_SCORE = 0.3
ORACLE_SQL = None  # a trained model decides in the first stage


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of documents, n_chars counted anew."""
    return docs.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


@shipped
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    docs = docs.select(*COLUMNS)
    found = language_id.identify(docs, language_id.learn(docs))
    return found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


@shipped
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, similarity of 0.8 or more."""
    return near_dup.keep_one(docs.select(*COLUMNS))


@shipped
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages cut out."""
    return _documents(decontaminate.remove(docs.select(*COLUMNS), common.table(spark, sf_dir, "benchmark")))


@shipped
def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets masked."""
    return _documents(secrets.redact(docs.select(*COLUMNS)))


@shipped
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences."""
    return packing.pieces(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("language_id", language),
    ("minhash_near_dup", near_duplicates),
    ("decontaminate", decontamination),
    ("secret_scan", secret_redaction),
    ("best_fit_packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
