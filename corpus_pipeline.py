"""A training corpus from ``documents``: good texts, one of each group of copies and near copies, without secrets, packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamstage.llm import dedup, minhash, packing, quality, secret_scan
from streamstage.llm.common import drop_folder, new_folder
from streamstage.llm.queries import VOCABULARY


def good_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest id stays."""
    return dedup.exact_dedup(docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8), the one with the smallest id stays."""
    return minhash.near_dedup(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; all documents stay."""
    text = F.col("text")
    masked = secret_scan.redact(docs.withColumn("__before", text))
    return masked.withColumn("n_chars", F.when(text.eqNullSafe(F.col("__before")), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, with their sequence and place."""
    return packing.pack(docs, VOCABULARY)


STAGES = [
    ("quality classifier", good_texts),
    ("exact dedup", one_of_copies),
    ("MinHash near-dedup", one_of_near_copies),
    ("secret scans", without_secrets),
    ("best-fit packing", packed),
]

#: A trained classifier's decisions can't be told in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again; a stage's table goes once the next one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        out = new_folder(spark, f"pipeline-{k}")
        stage(spark, docs, sf_dir).write.parquet(out)
        if before:
            drop_folder(spark, before)
        docs, before = spark.read.parquet(out), out
    return docs
