"""A training-corpus pipeline: five filters over ``documents``, each stage stored and reread.

Toxic documents go, of equal texts one stays, of near copies one stays, secrets are masked,
and what is left is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callgauge.llm import exact, packing, secrets, simhash, toxicity
from callgauge.session import scratch_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that the severity model rejects; fitted on the stage's input."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score = toxicity.scorer(spark, toxicity.fit(docs, labels))
    return docs.filter(~score("text")["rejected"])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, the largest doc_id stays."""
    return exact.keep(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near copies stays."""
    return simhash.keep(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secret values replaced; ``n_chars`` follows the text."""
    masked = docs.withColumn("text", secrets.masked("text"))
    return masked.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' pieces in bins of a few sequence lengths, in words."""
    return packing.pack(docs, length=packing.words("text")).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("simhash near-dedup", drop_near_copies),
    ("secret scans", mask_secrets),
    ("best-fit packing", pack),
]

# the ordinal fit, fingerprints and packing have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage reads what the one before stored."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
