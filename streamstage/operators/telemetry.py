"""Run telemetry over an event log: (seq, bench_ts, recv_ts, hops array<struct<stage, enter_ts, exit_ts>>)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamstage.functions.codec import valid_hops
from streamstage.operators.ranking import every_kth, nearest_rank, positions

POINTS = {"p50": 0.5, "p95": 0.95, "p99": 0.99, "p999": 0.999}
BINS = 50


def without_end_marks(df: DataFrame, marker: str = "eos") -> DataFrame:
    """Events only: rows of which the marker is set end the stream and aren't data."""
    return df.where(~F.coalesce(F.col(marker), F.lit(False)))


def received(log: DataFrame) -> DataFrame:
    """Events that were received after they were sent, with e2e_ms."""
    return log.where("recv_ts > bench_ts").withColumn("e2e_ms", (F.col("recv_ts") - F.col("bench_ts")) * 1000)


def hop_rows(log: DataFrame) -> DataFrame:
    """A row per valid hop: the log's columns, place, stage, enter_ts, exit_ts, residence_ms."""
    rows = log.withColumn("hops", valid_hops("hops")).select("*", F.posexplode("hops").alias("place", "__h")).drop("hops")
    return rows.select("*", "__h.*").drop("__h").withColumn("residence_ms", (F.col("exit_ts") - F.col("enter_ts")) * 1000)


def gap_rows(log: DataFrame) -> DataFrame:
    """A row per pair of hops in a row that doesn't run backwards: from_stage, to_stage, gap_ms. Within the array; no shuffle."""
    pair = "named_struct('from_stage', a.stage, 'to_stage', b.stage, 'from_exit', a.exit_ts, 'to_enter', b.enter_ts)"
    pairs = log.withColumn("__h", valid_hops("hops")).select("*", F.expr(f"inline(element_at(transform(array(__h), h -> zip_with(slice(h, 1, greatest(size(h) - 1, 0)), slice(h, 2, greatest(size(h) - 1, 0)), (a, b) -> {pair})), 1))"))
    rows = pairs.drop("__h", "hops").withColumn("gap_ms", (F.col("to_enter") - F.col("from_exit")) * 1000)
    return rows.where("to_enter >= from_exit").drop("from_exit", "to_enter")


def ingress_rows(log: DataFrame) -> DataFrame:
    """ingress_ms: from sending to the first hop; negative ones are left out."""
    rows = log.withColumn("ingress_ms", (F.get("hops", 0)["enter_ts"] - F.col("bench_ts")) * 1000)
    return rows.where("ingress_ms >= 0")


def quantile_block(df: DataFrame, value: str, group: list[str] | None = None, points: dict[str, float] | None = None, digits: int | None = 5, mean: str = "mean", more: dict[str, Column] | None = None) -> DataFrame:
    """count, quantiles, max and mean of ``value`` per group."""
    group = group or []
    rounded = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    sums = df.groupBy(*group).agg(F.count(value).alias("count"), rounded(F.max(value)).alias("max"), rounded(F.avg(value)).alias(mean), *[v.alias(k) for k, v in (more or {}).items()])
    ranks = nearest_rank(df, value, points or POINTS, group, digits)
    return sums.join(ranks, group) if group else sums.crossJoin(F.broadcast(ranks))


def histogram(df: DataFrame, value: str, bins: int = BINS) -> DataFrame:
    """(bin, center, count): ``bins`` equal bins up to min(max(3 * p99, 1), max); larger values are left out."""
    edges = nearest_rank(df, value, {"p99": 0.99}).crossJoin(F.broadcast(df.agg(F.max(value).alias("top"))))
    edges = edges.select((F.least(F.greatest(F.col("p99") * 3, F.lit(1.0)), F.col("top")) / bins).alias("bw"))
    placed = df.crossJoin(F.broadcast(edges)).withColumn("bin", F.floor(F.col(value) / F.col("bw")))
    counts = placed.where((F.col("bin") >= 0) & (F.col("bin") < bins)).groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    grid = df.sparkSession.range(bins).select(F.col("id").alias("bin")).crossJoin(F.broadcast(edges))
    return grid.join(counts, "bin", "left").select("bin", ((F.col("bin") + 0.5) * F.col("bw")).alias("center"), F.coalesce("count", F.lit(0)).alias("count"))


def cdf(df: DataFrame, value: str, order: list[str], steps: int = 200) -> DataFrame:
    """(i, x, y): every max(n / steps, 1)-th value and the percentage of values up to it."""
    ranked = positions(df, order)
    step = F.greatest(F.floor(F.col("n") / steps), F.lit(1))
    return ranked.where((F.col("rn") - 1) % step == 0).select((F.col("rn") - 1).alias("i"), F.col(value).alias("x"), F.round(F.col("rn") / F.col("n") * 100, 2).alias("y"))


def per_second(log: DataFrame) -> DataFrame:
    """(second, count) of receptions, seconds since that of the first."""
    counts = log.groupBy(F.floor("recv_ts").alias("__s")).agg(F.count(F.lit(1)).alias("count"))
    return counts.crossJoin(F.broadcast(log.agg(F.floor(F.min("recv_ts")).alias("__t0")))).select((F.col("__s") - F.col("__t0")).alias("second"), "count")


def throughput(log: DataFrame) -> DataFrame:
    """One row: received, duration_s, sustained_eps, trim_s, warm_eps. Warm-up is the first min(5 s, a tenth); warm counts
    the whole seconds from where it ends, over the time that is left (1 ms at least)."""
    ends = log.agg(F.min("recv_ts").alias("t0"), F.max("recv_ts").alias("t1"))
    ends = ends.withColumn("duration_s", F.col("t1") - F.col("t0")).withColumn("trim_s", F.least(F.lit(5.0), F.col("duration_s") * 0.1))
    warm = F.floor("recv_ts") >= F.floor(F.col("t0") + F.col("trim_s"))
    sums = log.crossJoin(F.broadcast(ends)).groupBy("duration_s", "trim_s").agg(F.count(F.lit(1)).alias("received"), F.sum(warm.cast("long")).alias("warm"))
    sustained = F.when(F.col("duration_s") > 0, F.col("received") / F.col("duration_s")).otherwise(F.lit(0.0))
    return sums.select("received", "duration_s", sustained.alias("sustained_eps"), "trim_s", (F.col("warm") / F.greatest(F.col("duration_s") - F.col("trim_s"), F.lit(0.001))).alias("warm_eps"))


def stage_rates(log: DataFrame) -> DataFrame:
    """(stage, eps): valid hops a second over the run's duration; 0 for a run without any."""
    span = log.agg((F.max("recv_ts") - F.min("recv_ts")).alias("__d"))
    counts = hop_rows(log).groupBy("stage").agg(F.count(F.lit(1)).alias("__n"))
    return counts.crossJoin(F.broadcast(span)).select("stage", F.when(F.col("__d") > 0, F.col("__n") / F.col("__d")).otherwise(F.lit(0.0)).alias("eps"))


def counters(log: DataFrame) -> DataFrame:
    """(stage, count) of valid hops, and of all events as stage ``total``."""
    stages = hop_rows(log).groupBy("stage").agg(F.count(F.lit(1)).alias("count"))
    return stages.unionByName(log.agg(F.lit("total").alias("stage"), F.count(F.lit(1)).alias("count")))


def whole_us(ms: Column) -> Column:
    """Milliseconds as whole microseconds."""
    return F.round(ms * 1000).cast("long")


def worker_timing(total: DataFrame, serde: DataFrame, guest: DataFrame) -> DataFrame:
    """A row per stage of any of the three (stage, us): ``n`` (the most samples that one has), p50, p95, p99, max and mean
    of each and p999 of total and guest (0 without samples), what total's p50, p99 and mean have over guest's (0 at
    least), and the share of serde in total at p50, to three places."""
    blocks, names = [], {"total": POINTS, "serde": {k: p for k, p in POINTS.items() if k != "p999"}, "guest": POINTS}
    for (name, points), df in zip(names.items(), (total, serde, guest), strict=True):
        block = quantile_block(df, "us", ["stage"], points, None)
        blocks.append(block.select("stage", *[F.col(c).alias(f"{name}_{c}") for c in block.columns if c != "stage"]))
    joined = blocks[0].join(blocks[1], "stage", "full_outer").join(blocks[2], "stage", "full_outer")
    value = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    over = lambda c: F.greatest(value(f"total_{c}") - value(f"guest_{c}"), F.lit(0.0)).alias(f"overhead_{c}")
    n = F.greatest(*[F.coalesce(F.col(f"{x}_count"), F.lit(0)) for x in names]).alias("n")
    share = F.when(value("total_p50") > 0, F.round(value("serde_p50") / value("total_p50"), 3)).otherwise(F.lit(0.0))
    shown = [value(f"{x}_{c}").alias(f"{x}_{c}") for x, points in names.items() for c in (*points, "max", "mean")]
    return joined.select("stage", n, *shown, *[over(c) for c in ("p50", "p99", "mean")], share.alias("serde_fraction"))


def timing_samples(rows: DataFrame, most: int = 50_000) -> DataFrame:
    """(stage, us): each stage's values in order, every k-th of them; k is the least that leaves ``most`` or fewer."""
    ranked = positions(rows.select("stage", "us"), ["us"], ["stage"])
    step = F.when(F.col("n") <= most, F.lit(1)).otherwise(F.ceil(F.col("n") / most))
    return ranked.where((F.col("rn") - 1) % step == 0).select("stage", "us")


def event_rows(log: DataFrame, most: int) -> DataFrame:
    """(seq, row): a sample of events as JSON arrays [recv, e2e, [[stage, enter, exit], ...]]."""
    kept = every_kth(received(log), ["recv_ts", "seq"], most)
    hops = F.expr("array_join(transform(hops, h -> concat('[\"', h.stage, '\",', format_string('%.6f', h.enter_ts), ',', format_string('%.6f', h.exit_ts), ']')), ',')")
    row = F.concat(F.lit("["), F.format_string("%.6f", "recv_ts"), F.lit(","), F.format_string("%.4f", "e2e_ms"), F.lit(",["), hops, F.lit("]]"))
    return kept.select("seq", row.alias("row"))


def run_summary(log: DataFrame) -> DataFrame:
    """One nested row for a run: counters, throughput, latency, inter-stage, ingress and per-stage blocks."""
    stat = lambda df, value, group=None: quantile_block(df, value, group)
    listed = lambda df, name: df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias(name))  # noqa: E731  one entry per stage or edge
    e2e = stat(received(log), "e2e_ms")
    parts = [
        throughput(log).select(F.struct("*").alias("throughput")),
        e2e.select(F.struct(*e2e.columns).alias("latency_ms")),
        listed(stage_rates(log), "stage_rates"),
        listed(counters(log), "counters"),
        listed(stat(hop_rows(log), "residence_ms", ["stage"]), "per_stage"),
        listed(stat(gap_rows(log), "gap_ms", ["from_stage", "to_stage"]), "inter_stage"),
        stat(ingress_rows(log), "ingress_ms").select(F.struct("*").alias("ingress_wait")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))  # one row each
    return out


def scaling_block(events: DataFrame, group: str = "stage") -> DataFrame:
    """Per stage: scale ups, downs and cold starts, and the cold-start times in time order."""
    has = lambda *kinds: F.sum(F.col("action").isin(*kinds).cast("long"))
    times = F.transform(F.array_sort(F.collect_list(F.when(F.col("cold_start_ms").isNotNull(), F.struct("t_s", "cold_start_ms")))), lambda s: s["cold_start_ms"])
    return events.groupBy(group).agg(has("spawn", "cold_start").alias("ups"), has("drain").alias("downs"), has("cold_start").alias("colds"), F.max("new_count").alias("peak"), times.alias("cold_start_ms"))


def forward_fill(events: DataFrame, samples: DataFrame, key: str = "stage") -> DataFrame:
    """``events`` (key, t_s) with the value of the first sample (key, t_s, value) at or after each: the last one so far,
    going back in time."""
    both = events.select(key, "t_s", F.lit(None).cast("double").alias("value"), F.lit(0).alias("__s")).unionByName(samples.select(key, "t_s", "value", F.lit(1).alias("__s")))
    w = Window.partitionBy(key).orderBy(F.desc("t_s"), F.desc("__s")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("value", F.last(F.when(F.col("__s") == 1, F.col("value")), ignorenulls=True).over(w)).where("__s = 0").drop("__s")
