"""Signal stages for streams: the same recurrences with per-key state in the state store.

Rows of one micro-batch are taken in the order of ``seq``; across batches keys must come in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from streamstage.operators.signal import EPSILON, FIR_TAPS, SIGMAS, WINDOW

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Denoise(StatefulProcessor):
    """State: count, mean and squared differences of all values (Welford), the last clamped values."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("denoise", "n bigint, mean double, m2 double, last array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        n, mean, m2, last = self.state.get() if self.state.exists() else (0, 0.0, 0.0, [])
        last = [*last]
        df = pd.concat(list(rows)).sort_values("seq", kind="stable")
        values, flags = [], []
        for x in df["value"].tolist():
            n += 1
            delta = x - mean
            mean += delta / n
            m2 += delta * (x - mean)
            std = max((m2 / (n - 1) if n > 1 else 1.0) ** 0.5, 1e-9)
            inside = min(max(x, mean - SIGMAS * std), mean + SIGMAS * std)
            last = [inside, *last[: len(FIR_TAPS) - 1]]
            values.append(sum(t * v for t, v in zip(FIR_TAPS, last, strict=False)))
            flags.append(abs(inside - x) > EPSILON)
        self.state.update((n, mean, m2, last))
        yield pd.DataFrame({"seq": df["seq"], "sensor_id": key[0], "ts_ns": df["ts_ns"], "value": values, "raw": df["value"], "clamped": flags})

    def close(self) -> None:
        pass


def features(block: np.ndarray) -> tuple[float, float, float, float]:
    """(rms, centroid, flatness, kurtosis) of a full block."""
    d = block - block.mean()
    m2 = (d * d).mean()
    kurtosis = (d**4).mean() / (m2 * m2) - 3.0 if m2 > 1e-18 else 0.0
    mags = np.abs(np.fft.fft(block)[: len(block) // 2])
    total = mags.sum() + 1e-12
    flat = np.exp(np.log(mags + 1e-12).mean()) / (total / len(mags) + 1e-12)
    return float(np.sqrt((block * block).mean())), float((np.arange(len(mags)) * mags).sum() / total), float(flat), float(kurtosis)


class Featurize(StatefulProcessor):
    """State: rows so far, the values of the block that is filling, the last full block's features."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("featurize", "n bigint, block array<double>, last array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        n, block, last = self.state.get() if self.state.exists() else (0, [], [0.0] * 4)
        block, last = [*block], [*last]
        df = pd.concat(list(rows)).sort_values("seq", kind="stable")
        out = []
        for x in df["value"].tolist():
            n += 1
            block.append(x)
            if len(block) == WINDOW:
                last, block = [*features(np.array(block))], []
            out.append((*last, n >= WINDOW))
        self.state.update((n, block, last))
        made = pd.DataFrame(out, columns=["rms", "centroid", "flatness", "kurtosis", "window_full"], index=df.index)
        yield pd.concat([pd.DataFrame({"seq": df["seq"], "sensor_id": key[0], "ts_ns": df["ts_ns"], "value": df["value"]}), made], axis=1)

    def close(self) -> None:
        pass


def denoise(df: DataFrame) -> DataFrame:
    return df.select("seq", "sensor_id", "ts_ns", "value").groupBy("sensor_id").transformWithStateInPandas(Denoise(), "seq bigint, sensor_id string, ts_ns decimal(20,0), value double, raw double, clamped boolean", "Append", "None")


def featurize(df: DataFrame) -> DataFrame:
    schema = "seq bigint, sensor_id string, ts_ns decimal(20,0), value double, rms double, centroid double, flatness double, kurtosis double, window_full boolean"
    return df.select("seq", "sensor_id", "ts_ns", "value").groupBy("sensor_id").transformWithStateInPandas(Featurize(), schema, "Append", "None")
