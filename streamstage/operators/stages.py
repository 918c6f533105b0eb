"""Stateless stages: column expressions only, so that a chain of them is one projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamstage.functions.scalar import blake3, canonical_form, clamp, hmac_sha256

#: The key of ``attest`` where none is given. A deployment brings its own.
DEMO_KEY = b"streamstage-demo-signing-key"


def identity(df: DataFrame) -> DataFrame:
    return df


def normalize(df: DataFrame, low: float = -50.0, high: float = 150.0) -> DataFrame:
    """Values clamped; the unit defaults to celsius."""
    return df.withColumns({"value": clamp(F.col("value"), low, high), "unit": F.coalesce(F.col("unit"), F.lit("celsius"))})


def detect(df: DataFrame) -> DataFrame:
    """An anomaly is a value above 75; its severity is high above 85."""
    v = F.col("value")
    severity = F.when(v > 85.0, "high").when(v > 75.0, "medium").otherwise("normal")
    return df.withColumns({"anomaly": v > 75.0, "severity": severity}).drop("unit")


def finalize(df: DataFrame) -> DataFrame:
    return df.withColumn("severity", F.coalesce(F.col("severity"), F.lit("unknown")))


def attest(df: DataFrame, key: bytes = DEMO_KEY) -> DataFrame:
    """Content hash and signature of the canonical form."""
    kept = [c for c in df.columns if c not in ("value", "window_full")]
    signed = df.withColumn("__form", canonical_form())
    return signed.select(*kept, blake3(F.col("__form")).alias("content_hash"), hmac_sha256(F.col("__form"), key).alias("hmac"))


def tombstone(df: DataFrame, gone: str, reason: str) -> DataFrame:
    """Rows that ``gone`` (SQL) holds for are marked, not dropped: a stage gives one event for each."""
    bad = F.coalesce(F.expr(gone), F.lit(False))
    return df.withColumns({"filtered": bad, "reason": F.when(bad, reason)})
