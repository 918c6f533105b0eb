"""Inputs of the registered queries, derived from the ``events`` table: a Spark form and the same as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STAGES = ("normalize", "detect", "finalize")


def events(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def reading(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).selectExpr("event_id AS seq", "event_type AS sensor_id", "value", "cast(null as string) AS unit")


READING = "reading AS (SELECT event_id AS seq, event_type AS sensor_id, value, CAST(NULL AS VARCHAR) AS unit FROM events)"


def sensor_sample(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).selectExpr("event_id AS seq", "event_type AS sensor_id", "event_id * 1000000 AS ts_ns", "value")


SAMPLE = "sample AS (SELECT event_id AS seq, event_type AS sensor_id, event_id * 1000000 AS ts_ns, value FROM events)"


def _enter(s: int) -> str:
    return f"event_id * 1e-2 + 1e-3 * (1 + event_id % 5) + {s} * 2e-2"


def _exit(s: int) -> str:
    return f"{_enter(s)} + 1e-4 * (1 + (event_id * ({s} + 3)) % 17)"


def hop_log(spark, sf_dir) -> DataFrame:
    """One row per event: (seq, bench_ts, recv_ts, hops)."""
    hops = ", ".join(f"named_struct('stage', '{name}', 'enter_ts', {_enter(s)}, 'exit_ts', {_exit(s)})" for s, name in enumerate(STAGES))
    return events(spark, sf_dir).selectExpr("event_id AS seq", "event_id * 1e-2 AS bench_ts", f"{_exit(2)} + 5e-4 * (1 + event_id % 3) AS recv_ts", f"array({hops}) AS hops")


_NAMES = " ".join(f"WHEN {s} THEN '{name}'" for s, name in enumerate(STAGES))
HOPS = (
    f"hop AS (SELECT event_id AS seq, event_id * 1e-2 AS bench_ts, {_exit(2)} + 5e-4 * (1 + event_id % 3) AS recv_ts, s, CASE s {_NAMES} END AS stage, "
    "event_id * 1e-2 + 1e-3 * (1 + event_id % 5) + s * 2e-2 AS enter_ts, event_id * 1e-2 + 1e-3 * (1 + event_id % 5) + s * 2e-2 + 1e-4 * (1 + (event_id * (s + 3)) % 17) AS exit_ts "
    "FROM events, range(3) t(s))"
)
LOG = f"log AS (SELECT event_id AS seq, event_id * 1e-2 AS bench_ts, {_exit(2)} + 5e-4 * (1 + event_id % 3) AS recv_ts FROM events)"

_ACTION = "CASE event_id % 4 WHEN 0 THEN 'cold_start' WHEN 1 THEN 'spawn' WHEN 2 THEN 'spawn' ELSE 'drain' END"


def scaling_log(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).selectExpr(
        "event_id AS ord", "event_id * 5e-2 AS t_s", "event_type AS stage", f"{_ACTION} AS action", "1 + event_id % 6 AS new_count", "CASE WHEN event_id % 4 = 0 THEN value END AS cold_start_ms"
    )


SCALING = f"scaling AS (SELECT event_id AS ord, event_id * 5e-2 AS t_s, event_type AS stage, {_ACTION} AS action, 1 + event_id % 6 AS new_count, CASE WHEN event_id % 4 = 0 THEN value END AS cold_start_ms FROM events)"


def queue_trace(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).select(F.col("event_type").alias("stage"), F.col("event_id").alias("tick"), F.floor("value").cast("long").alias("qd"))


QUEUE = "trace AS (SELECT event_type AS stage, event_id AS tick, CAST(floor(value) AS BIGINT) AS qd FROM events)"


def cold_starts(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).selectExpr(
        "CASE WHEN user_id % 2 = 0 THEN 'AOT' ELSE 'JIT' END AS mode", "event_type AS stage", "value AS cold_start_ms", "event_id AS ord",
        "CASE WHEN user_id % 2 = 1 THEN value / 4 END AS compile_ms", "CASE WHEN user_id % 2 = 1 AND event_type <> 'click' THEN value / 10 END AS prepare_ms",
    )


COLD = (
    "cold AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'AOT' ELSE 'JIT' END AS mode, event_type AS stage, value AS cold_start_ms, event_id AS ord, "
    "CASE WHEN user_id % 2 = 1 THEN value / 4 END AS compile_ms, CASE WHEN user_id % 2 = 1 AND event_type <> 'click' THEN value / 10 END AS prepare_ms FROM events)"
)


def grid(spark, sf_dir) -> DataFrame:
    """Runs of a configuration grid: fixed (SF) and scaled (SL) ones with their replicas' split."""
    return events(spark, sf_dir).selectExpr(
        "CASE WHEN (event_id div 36) % 2 = 0 THEN 'SF' ELSE 'SL' END AS mode", "1 + event_id % 4 AS n", "1 + (event_id div 4) % 3 AS d", "1 + (event_id div 12) % 3 AS f",
        "value AS p50", "1 + (event_id % 10) * 5e-1 AS replicas", "event_id % 7 AS downs",
    )


GRID = (
    "grid AS (SELECT CASE WHEN (event_id // 36) % 2 = 0 THEN 'SF' ELSE 'SL' END AS mode, 1 + event_id % 4 AS n, 1 + (event_id // 4) % 3 AS d, 1 + (event_id // 12) % 3 AS f, "
    "value AS p50, 1 + (event_id % 10) * 5e-1 AS replicas, event_id % 7 AS downs FROM events)"
)


def log_lines(spark, sf_dir) -> DataFrame:
    """A structured log: workers of the event's type boot, autoscalers get ready, all others tell progress."""
    i = F.col("event_id")
    kind = F.when(F.col("event_type") == "click", "worker booted").when(F.col("event_type") == "view", "autoscaler ready").otherwise("progress")
    component = F.when(F.col("event_type") == "click", F.concat(F.lit("worker/"), F.when(i % 2 == 0, "a/b").otherwise("c"))).when(F.col("event_type") == "view", F.concat(F.lit("autoscaler/s"), (i % 9).cast("string"))).otherwise("loadgen")
    fields = F.map_from_arrays(F.array(F.lit("cold_start_ms"), F.lit("queue_up"), F.lit("sent")), F.array(F.when(i % 3 != 0, i.cast("string")).otherwise("n/a"), (i % 70).cast("string"), (i * 2).cast("string")))
    return events(spark, sf_dir).select((i * 5e-2).alias("ts"), F.lit("info").alias("level"), component.alias("component"), kind.alias("msg"), fields.alias("fields"), i.alias("seq"))


def resource_samples(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).selectExpr("event_id * 5e-2 AS t_s", "value AS cpu_pct", "cast(event_id as double) AS rss_mb")
