"""Operators over structured logs (ts, level, component, msg, fields) and rows of run tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def messages(log: DataFrame, *named: str) -> DataFrame:
    """The lines with one of the messages."""
    return log.where(F.col("msg").isin(*named))


def number(field: str) -> Column:
    """A field's number; null if it is absent or none."""
    return F.expr(f"try_cast(try_element_at(fields, '{field}') as double)")


def boots(log: DataFrame, start: float | None = None) -> DataFrame:
    """(stage, t_s, boot_ms, cold_start_ms) of workers that booted and tell how long a start took. The stage is what
    follows the component's first slash, or all of it; ``t_s`` counts from ``start``, null without."""
    told = messages(log, "worker booted")
    stage = F.when(F.col("component").contains("/"), F.expr("substring(component, instr(component, '/') + 1)")).otherwise(F.coalesce("component", F.lit("")))
    t = F.coalesce("ts", F.lit(0.0)) - F.lit(start) if start and start > 0 else F.lit(None).cast("double")
    return told.select(stage.alias("stage"), t.alias("t_s"), number("boot_ms").alias("boot_ms"), number("cold_start_ms").alias("cold_start_ms")).where("cold_start_ms IS NOT NULL")


def boots_or(found: DataFrame, instead: DataFrame) -> DataFrame:
    """``found``, or (stage, cold_start_ms) of ``instead`` in its place where the log told of none."""
    none = found.agg((F.count(F.lit(1)) == 0).alias("__none"))
    other = instead.crossJoin(F.broadcast(none)).where("__none")
    return found.unionByName(other.select("stage", F.lit(None).cast("double").alias("t_s"), F.lit(None).cast("double").alias("boot_ms"), F.col("cold_start_ms").cast("double").alias("cold_start_ms")))


def scaling_params(log: DataFrame) -> DataFrame:
    """(stage, queue_up, queue_down, min_rep, max_rep) that autoscalers told of when they were ready; defaults for what
    they left out."""
    ready = messages(log, "autoscaler ready")
    value = lambda c, default: F.coalesce(number(c), F.lit(float(default))).alias(c)
    return ready.select(F.replace("component", F.lit("autoscaler/"), F.lit("")).alias("stage"), value("queue_up", 50), value("queue_down", 0), value("min_rep", 1).cast("long"), value("max_rep", 8).cast("long"))


def successes(rows: DataFrame) -> DataFrame:
    """Rows that are no prewarming and succeeded: is_prewarm isn't 1, success is true in words."""
    return rows.where((F.expr("try_cast(is_prewarm as int)") != 1) & (F.lower("success") == "true"))


def load_progress(log: DataFrame) -> DataFrame:
    """(ts, elapsed_s, sent, send_rate_ev_s, dropped, anomalies) of a load generator's progress lines; null for what a line lacks."""
    return messages(log, "progress").select("ts", number("elapsed_s").alias("elapsed_s"), number("sent").cast("long").alias("sent"), number("send_rate").alias("send_rate_ev_s"), *[number(c).cast("long").alias(c) for c in ("dropped", "anomalies")])
