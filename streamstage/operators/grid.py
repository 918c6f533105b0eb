"""Configuration grids: runs with a fixed split of replicas (SF) against scaled ones (SL)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPLIT = ("n", "d", "f")


def averages(runs: DataFrame, mode: str) -> DataFrame:
    """Means of p50, replicas and downs over the runs of one mode, by split."""
    return runs.where(F.col("mode") == mode).groupBy(*SPLIT).agg(*[F.avg(c).alias(c) for c in ("p50", "replicas", "downs")])


def compared(runs: DataFrame) -> DataFrame:
    """Scaled runs beside the fixed ones of the same split: (n, d, f, sf_p50, sl_p50, delta_pct, savings_pct, downs)."""
    fixed = averages(runs, "SF").select(*SPLIT, F.col("p50").alias("sf_p50"))
    scaled = averages(runs, "SL").select(*SPLIT, F.col("p50").alias("sl_p50"), "replicas", "downs")
    delta, saved = (F.col("sl_p50") / F.col("sf_p50") - 1) * 100, (1 - F.col("replicas") / sum((F.col(c) for c in SPLIT), F.lit(0))) * 100
    return fixed.join(scaled, [*SPLIT]).select(*SPLIT, "sf_p50", "sl_p50", delta.alias("delta_pct"), saved.alias("savings_pct"), "downs")


def candidates(configs: DataFrame, slower_pct: float, saved_pct: float, downs: float) -> DataFrame:
    """Splits whose scaled runs are no more than ``slower_pct`` away, save ``saved_pct`` at least and scale down often enough."""
    return configs.where((F.abs("delta_pct") <= slower_pct) & (F.col("savings_pct") >= saved_pct) & (F.col("downs") >= downs))


def best(configs: DataFrame, most: int = 5) -> DataFrame:
    """The ``most`` nearest in latency; of equally near ones those that save more."""
    return configs.orderBy(F.abs("delta_pct"), F.desc("savings_pct"), *SPLIT).limit(most)
