"""Writers: run summaries, structured logs, CSV exports and the text card of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_summary(summary: DataFrame, path: str, log: str | None = None, component: str = "engine") -> None:
    """One nested row as one JSON file, with where its log is and who wrote it."""
    told = summary.withColumns({"_jsonl_path": F.lit(log).cast("string"), "_component": F.lit(component)})
    told.coalesce(1).write.mode("overwrite").json(path)  # one row


def append_log(rows: DataFrame, path: str) -> None:
    """Lines {ts, level, component, msg, further fields}: ``rows`` has the first four and a map ``fields`` of strings."""
    head = F.create_map(*[x for c in ("level", "component", "msg") for x in (F.lit(c), F.col(c).cast("string"))])
    # Times are numbers, all other values strings; a field never replaces one of the four.
    rest = F.to_json(F.map_concat(F.map_filter("fields", lambda k, v: ~k.isin("ts", "level", "component", "msg")), head))
    line = F.concat(F.lit('{"ts":'), F.format_string("%.4f", F.col("ts")), F.lit(","), F.substring(rest, 2, 1 << 30))
    rows.select(line.alias("value")).write.mode("append").text(path)


#: The exports and their columns.
EXPORTS = {
    "binned_latency": ["t_s", "kind", "edge", "n", "p50", "p95"],
    "cold_starts": ["mode", "iteration", "stage", "cold_start_ms", "compile_ms", "instantiate_pre_ms", "spawn_kind"],
    "summary_stats": ["mode", "stage", "spawn_kind", "n", "mean_ms", "median_ms", "p95_ms", "p99_ms", "min_ms", "max_ms", "std_ms"],
    "cpu_mem": ["t_s", "cpu_pct", "rss_mb"],
    "loadgen": ["ts", "elapsed_s", "sent", "send_rate_ev_s", "dropped", "anomalies"],
    "grid_results": ["mode", "label", "n_normalize", "n_detect", "n_finalize", "total_fixed", "queue_up_base", "cooldown_down_s", "run", "p50", "p99", "avg_total_replicas", "avg_normalize", "avg_detect", "avg_finalize", "total_scale_down"],
}


def write_csv(rows: DataFrame, path: str, export: str | None = None, mode: str = "overwrite") -> None:
    """CSV with a header; many files for many rows. With ``export``, that export's columns in their order; an error if
    ``rows`` lack one."""
    if export is not None:
        lacking = [c for c in EXPORTS[export] if c not in rows.columns]
        if lacking:
            raise ValueError(f"{export}: no {', '.join(lacking)}")
        rows = rows.select(*EXPORTS[export])
    rows.write.mode(mode).option("header", True).csv(path)


def cold_start_rows(starts: DataFrame, order: list[str]) -> DataFrame:
    """The export cold_starts: each run's (mode, iteration) first start of a stage is marked first, others warm."""
    from streamstage.operators.analysis import first_and_rest

    return first_and_rest(starts, ["mode", "iteration", "stage"], order).select(*EXPORTS["cold_starts"])


def summary_stats(cold_starts: DataFrame) -> DataFrame:
    """The export summary_stats of rows of the export cold_starts."""
    from streamstage.operators.analysis import group_stats

    stats = group_stats(cold_starts, ["mode", "stage", "spawn_kind"], "cold_start_ms")
    return stats.select("mode", "stage", "spawn_kind", "n", *[F.col(c).alias(f"{c}_ms") for c in ("mean", "median", "p95", "p99", "min", "max", "std")])


def cpu_mem(cpu: DataFrame, rss: DataFrame) -> DataFrame:
    """The export cpu_mem of two series (t_s, cpu_pct) and (t_s, rss_mb), zipped by position; the time is that of the
    first, or of the second where the first is shorter."""
    from streamstage.operators.ranking import positions

    left = positions(cpu, ["t_s", "cpu_pct"]).select("rn", "t_s", "cpu_pct")
    right = positions(rss, ["t_s", "rss_mb"]).select("rn", F.col("t_s").alias("__t"), "rss_mb")
    return left.join(right, "rn", "full_outer").select(F.coalesce("t_s", "__t").alias("t_s"), "cpu_pct", "rss_mb")


def run_card(log: DataFrame, resources: DataFrame) -> DataFrame:
    """(line): a run's headline figures as text; ``resources`` has cpu_pct and rss_mb samples."""
    from streamstage.operators.resources import peaks
    from streamstage.operators.telemetry import quantile_block, received, throughput

    e2e = quantile_block(received(log), "e2e_ms").select("count", "p50", "p99", F.col("max").alias("worst"))
    one = throughput(log).crossJoin(F.broadcast(e2e)).crossJoin(F.broadcast(peaks(resources)))
    lines = [
        F.format_string("events      %d in %.3f s", "received", "duration_s"), F.format_string("sustained   %.1f events/s", "sustained_eps"),
        F.format_string("latency ms  p50 %.3f  p99 %.3f  max %.3f", "p50", "p99", "worst"), F.format_string("peaks       cpu %.1f %%  memory %.1f MB", "peak_cpu", "peak_rss"),
    ]
    return one.select(F.explode(F.array(*lines)).alias("line"))
