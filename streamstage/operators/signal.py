"""Keyed-stateful signal stages as window plans; ``streaming.stateful`` has the same for streams.

State is kept per key, so a key's rows are one task's work in order. All windows of a stage share one exchange on the
key; a block's features come back to its rows by a join on key and block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streamstage.operators.keyed import recurrence

WINDOW = 256
SIGMAS = 4.0
EPSILON = 2.220446049250313e-16
# Low-pass filter taps, newest sample first.
FIR_TAPS = (
    0.00231, 0.00684, 0.01618, 0.03200, 0.05420, 0.07920, 0.10160, 0.11567,
    0.11567, 0.10160, 0.07920, 0.05420, 0.03200, 0.01618, 0.00684, 0.00231,
)


def ordered(key: str = "sensor_id", order: str = "seq"):
    return Window.partitionBy(key).orderBy(order)


def running_stats(df: DataFrame, key: str = "sensor_id", order: str = "seq") -> DataFrame:
    """mean and std of all values up to and with each row; a first row's variance is 1, std is 1e-9 at least."""
    w = ordered(key, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    std = F.greatest(F.coalesce(F.stddev_samp("value").over(w), F.lit(1.0)), F.lit(1e-9))
    return df.withColumns({"mean": F.avg("value").over(w), "std": std})


def sigma_clamp(df: DataFrame) -> DataFrame:
    """clamped_value within SIGMAS deviations of the running mean, and whether that moved it."""
    low, high = (F.col("mean") - SIGMAS * F.col("std"), F.col("mean") + SIGMAS * F.col("std"))
    inside = F.least(F.greatest(F.col("value"), low), high)
    return df.withColumn("clamped_value", inside).withColumn("clamped", F.abs(F.col("clamped_value") - F.col("value")) > EPSILON)


def fir(df: DataFrame, value: str, out: str, key: str = "sensor_id", order: str = "seq") -> DataFrame:
    """The filter's answer at each row; samples before a key's first count as 0."""
    w, total = ordered(key, order), F.lit(0.0)
    for k, tap in enumerate(FIR_TAPS):
        total = total + F.lit(tap) * (F.col(value) if k == 0 else F.lag(value, k, 0.0).over(w))
    return df.withColumn(out, total)


def denoise(df: DataFrame, key: str = "sensor_id", order: str = "seq") -> DataFrame:
    """Running statistics, outlier clamp and low-pass filter; ``raw`` is the value as it came."""
    done = fir(sigma_clamp(running_stats(df, key, order)), "clamped_value", "__y", key, order)
    return done.withColumn("raw", F.col("value")).withColumn("value", F.col("__y")).drop("__y", "mean", "std", "clamped_value")


def blocks(df: DataFrame, size: int = WINDOW, key: str = "sensor_id", order: str = "seq") -> DataFrame:
    """rn (from 1) within the key, and the block of ``size`` rows that a row is in (from 0)."""
    return df.withColumn("rn", F.row_number().over(ordered(key, order)).cast("long")).withColumn("block", F.floor((F.col("rn") - 1) / size))


def rms(value: str):
    return F.sqrt(F.avg(F.col(value) * F.col(value)))


def excess_kurtosis(value: str):
    """Of the population; 0 for a constant block."""
    return F.when(F.var_pop(value) > 1e-18, F.kurtosis(value)).otherwise(F.lit(0.0))


def magnitudes(values):
    """Magnitudes of bins 0..n/2-1 of a block's transform: Arrow batches of blocks."""
    @F.pandas_udf("array<double>")
    def spectrum(blocks: pd.Series) -> pd.Series:
        if not len(blocks):
            return pd.Series([], dtype=object)
        x = np.stack(blocks.to_numpy())
        return pd.Series(list(np.abs(np.fft.fft(x, axis=1)[:, : x.shape[1] // 2])))

    return spectrum(values)


def _total(mags: str) -> str:
    return f"(aggregate({mags}, 0D, (a, m) -> a + m) + 1e-12D)"


def centroid(mags: str):
    return F.expr(f"aggregate(transform({mags}, (m, k) -> k * m), 0D, (a, m) -> a + m) / {_total(mags)}")


def flatness(mags: str):
    n = f"size({mags})"
    return F.expr(f"exp(aggregate({mags}, 0D, (a, m) -> a + ln(m + 1e-12D)) / {n}) / ({_total(mags)} / {n} + 1e-12D)")


def block_features(df: DataFrame, size: int = WINDOW, key: str = "sensor_id", order: str = "seq", value: str = "value") -> DataFrame:
    """(key, block, rms, kurtosis, mags, centroid, flatness) of each full block."""
    full = blocks(df, size, key, order).groupBy(key, "block").agg(
        rms(value).alias("rms"), excess_kurtosis(value).alias("kurtosis"), F.transform(F.array_sort(F.collect_list(F.struct("rn", F.col(value).alias("x")))), lambda s: s["x"]).alias("__xs")
    )
    full = full.where(F.size("__xs") == size).withColumn("mags", magnitudes(F.col("__xs")))
    return full.withColumns({"centroid": centroid("mags"), "flatness": flatness("mags")}).drop("__xs")


def featurize(df: DataFrame, size: int = WINDOW, key: str = "sensor_id", order: str = "seq") -> DataFrame:
    """Each row with the features of the last full block (up to and with the row); zeros before the first one."""
    names = ["rms", "centroid", "flatness", "kurtosis"]
    marked = blocks(df, size, key, order)
    features = block_features(df, size, key, order).select(F.col(key).alias("__k"), F.col("block").alias("__b"), *names)
    last = F.floor(F.col("rn") / size) - 1
    joined = marked.join(features, (F.col(key) == F.col("__k")) & (last == F.col("__b")), "left")
    out = joined.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in names}).withColumn("window_full", F.col("rn") >= size)
    return out.drop("__k", "__b", "rn", "block", "raw", "clamped")


def ewma_int(df: DataFrame, value: str, key: str = "sensor_id", order: str = "seq", start: int = 100) -> DataFrame:
    """(key, n, ewma): whole numbers, each step (3 * before + value) / 4 rounded down."""

    def fold():
        held = [0, start]

        def step(_, v):
            held[:] = held[0] + 1, (3 * held[1] + v) // 4
            return ()

        return step, lambda: [tuple(held)]

    return recurrence(df.select(key, order, F.col(value).cast("long").alias("v")), key, order, ["v"], "n bigint, ewma bigint", fold)
