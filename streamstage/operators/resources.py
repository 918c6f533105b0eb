"""What the driver's process uses, and on what machine: facts of this host, gathered here and handed on as DataFrames."""

from __future__ import annotations

import os
import platform
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def cpu_list(text: str) -> list[int]:
    """CPUs in a list such as 0-3,5; parts that are no number or range are left out."""
    out: list[int] = []
    for part in text.split(","):
        low, dash, high = part.strip().partition("-")
        if low.isdigit() and (high.isdigit() if dash else True):
            out += range(int(low), int(high if dash else low) + 1)
    return out


def available_cpus() -> int:
    return len(os.sched_getaffinity(0)) if hasattr(os, "sched_getaffinity") else os.cpu_count() or 1


def _usage(pid: int) -> tuple[float, float]:
    """(CPU seconds, MB in memory) of a process so far."""
    fields = Path(f"/proc/{pid}/stat").read_text().rpartition(")")[2].split()
    ticks = os.sysconf("SC_CLK_TCK")
    return (int(fields[11]) + int(fields[12])) / ticks, int(fields[21]) * os.sysconf("SC_PAGE_SIZE") / 1e6


def sample(spark: SparkSession, samples: int, interval_s: float, pid: int | None = None) -> DataFrame:
    """(t_s, cpu_pct, rss_mb): so many samples of a process; CPU in percent of the available CPUs. None for interval 0."""
    schema = "t_s double, cpu_pct double, rss_mb double"
    if interval_s <= 0:
        return spark.createDataFrame([], schema)
    pid, rows = pid or os.getpid(), []
    began = last = time.monotonic()
    used, _ = _usage(pid)
    for _ in range(samples):
        time.sleep(interval_s)
        now, (cpu, rss) = time.monotonic(), _usage(pid)
        rows.append((round(now - began, 3), (cpu - used) / (now - last) / available_cpus() * 100, rss))
        last, used = now, cpu
    return spark.createDataFrame(rows, schema)


def environment(spark: SparkSession) -> DataFrame:
    """One row: system, machine, CPUs, memory, Python and Spark."""
    memory = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") / 1e6
    facts = (platform.system(), platform.release(), platform.machine(), os.cpu_count() or 0, available_cpus(), memory, platform.python_version(), spark.version, spark.sparkContext.master, spark.sparkContext.defaultParallelism)
    return spark.createDataFrame([facts], "system string, release string, machine string, cpus int, available_cpus int, memory_mb double, python string, spark string, master string, parallelism int")


def peaks(samples: DataFrame) -> DataFrame:
    """One row: the largest cpu_pct and rss_mb, and how many samples there are."""
    return samples.agg(F.max("cpu_pct").alias("peak_cpu"), F.max("rss_mb").alias("peak_rss"), F.count(F.lit(1)).alias("samples"))
