"""The corpus pipeline: five stages, each over all that its predecessor kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes it as
Parquet into the shared checkpoint folder and hands the next stage what it reads back. All
stages but the last return the columns of ``documents``. Null ids and texts, empty and very
long texts, repeated rows, empty tables and extra columns pass through as each operator's
docstring states.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import duplicates, mixing, packing, secrets, toxicity
from claimloom.llm.text import small_batches
from claimloom.plans.lineage import checkpoint_dir, delete_folder, fresh_name

#: Scores from here on are toxic.
TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under ``TOXIC``; the network learns from all labels of the folder's ``labels``."""
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    original = spark.read.parquet(f"{sf_dir}/documents.parquet")
    name = fresh_name(docs.columns, "_toxicity")
    scored = toxicity.score_toxicity(docs, toxicity.train_from_labels(original, labels), name)
    return scored.where(F.col(name) < TOXIC).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id; a repeated id keeps one row."""
    small_batches(spark)
    return duplicates.keep_one(docs, shingle=5, percent=80)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced."""
    small_batches(spark)
    return secrets.redact_secrets(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.emit_copies(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' pieces in training sequences."""
    small_batches(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", one_of_each),
    ("secrets", without_secrets),
    ("mixing", mixed),
    ("packing", packed),
]

#: Networks, sketches and the packing have no SQL form; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result is the last stage's, read back.

    A stage's copy is deleted once the next stage's is written.
    """
    docs, home = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{k}")
        docs = spark.read.parquet(f"{home}/{k}")
        if k:
            delete_folder(spark, f"{home}/{k - 1}")
    return docs
