"""Scalar column functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CANONICAL = ("rms", "centroid", "flatness", "kurtosis")


def clamp(value: Column, low: float, high: float) -> Column:
    """IEEE clamp: NaN stays NaN (Spark's least and greatest take it for the largest number)."""
    return F.when(F.isnan(value), value).otherwise(F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def round_half_away(value: Column, digits: int) -> Column:
    return F.round(value, digits)


def canonical_form() -> Column:
    """The text of a featured event that is signed."""
    parts = [F.concat(F.lit("sensor_id="), F.col("sensor_id")), F.concat(F.lit("ts_ns="), F.col("ts_ns").cast("string"))]
    return F.concat_ws("|", *parts, *[F.format_string(f"{c}=%.9f", F.col(c)) for c in CANONICAL])


def hmac_sha256(message: Column, key: bytes) -> Column:
    """HMAC-SHA256 in hex, of built-in functions only."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in block).hex() for pad in (0x36, 0x5C))
    message = F.encode(message, "utf-8")
    first = F.unhex(F.sha2(F.concat(F.unhex(F.lit(inner)), message), 256))
    return F.sha2(F.concat(F.unhex(F.lit(outer)), first), 256)


def blake3(text: Column) -> Column:
    """BLAKE3 in hex: no built-in function has it, so texts go to Python in Arrow batches, each hashed side by side."""
    @F.pandas_udf("string")
    def hashed(texts: pd.Series) -> pd.Series:
        from streamstage.functions.blake3 import blake3_hexes

        known = texts.notna()
        out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
        out[known] = blake3_hexes([x.encode("utf-8") for x in texts[known].tolist()])
        return out

    return hashed(text)


def slug_timestamp(epoch_s: Column) -> Column:
    """YYYYMMDD_HHMMSS in UTC."""
    return F.date_format(F.timestamp_seconds(F.floor(epoch_s)), "yyyyMMdd_HHmmss")


def stage_bare_name(name: Column, prefix: str = "fn-") -> Column:
    """The name without one prefix."""
    return F.when(name.startswith(prefix), F.substring(name, len(prefix) + 1, 1 << 20)).otherwise(name)


def trim_prefix(name: Column, prefix: str = "fn-") -> Column:
    """The name without any number of prefixes."""
    return F.regexp_replace(name, f"^({prefix})+", "")


def to_kebab(name: Column) -> Column:
    return F.replace(name, F.lit("_"), F.lit("-"))


def to_snake(name: Column) -> Column:
    return F.replace(name, F.lit("-"), F.lit("_"))


def cpu_list_count(text: Column) -> Column:
    """CPUs in a list such as 0-3,5; parts that are no number or range count as none."""
    return F.aggregate(F.split(text, ","), F.lit(0).cast("long"), lambda n, p: n + _cpus(p))


def _cpus(p: Column) -> Column:
    p = F.trim(p)
    ends = F.split(p, "-")
    return F.when(p.rlike("^[0-9]+-[0-9]+$"), F.greatest(ends[1].cast("long") - ends[0].cast("long") + 1, F.lit(0).cast("long"))).when(p.rlike("^[0-9]+$"), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))


def cpu_norm(value: Column, unit: Column, cores: Column) -> Column:
    """CPU use in percent of all cores, from percent of one core or from percent of all."""
    return F.when(unit == "per_core", value / cores).otherwise(value)
