"""Offline analysis: binning, resampling, as-of matches, step functions, distributions and configuration grids."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamstage.operators.keyed import recurrence
from streamstage.operators.ranking import linear_quantiles, matched, positions, running_sum
from streamstage.operators.telemetry import gap_rows, hop_rows


def flatten_hops(log: DataFrame) -> DataFrame:
    """Long form (seq, recv_ts, kind, edge, latency_ms): time within stages and between them."""
    intra = hop_rows(log).select("seq", "recv_ts", F.lit("intra").alias("kind"), F.col("stage").alias("edge"), F.col("residence_ms").alias("latency_ms"))
    inter = gap_rows(log).select("seq", "recv_ts", F.lit("inter").alias("kind"), F.concat("from_stage", F.lit("->"), "to_stage").alias("edge"), F.col("gap_ms").alias("latency_ms"))
    return intra.unionByName(inter)


def bin_center(t: Column, width: float) -> Column:
    return F.floor(t / width) * width + width / 2


def bin_latency(rows: DataFrame, width: float) -> DataFrame:
    """(t_s, kind, edge, n, p50, p95): quantiles by linear interpolation per time bin; a bin's distinct values are held
    together, so bins are to be narrow."""
    return rows.groupBy(bin_center(F.col("recv_ts"), width).alias("t_s"), "kind", "edge").agg(
        F.count(F.lit(1)).alias("n"), F.percentile("latency_ms", 0.5).alias("p50"), F.percentile("latency_ms", 0.95).alias("p95")
    )


def whole_seconds(df: DataFrame, t: str) -> DataFrame:
    """One row ``__n``: the largest ``t`` of all rows, rounded (half to even), 1 at least."""
    return df.agg(F.greatest(F.bround(F.max(t), 0).cast("long"), F.lit(1).cast("long")).alias("__n"))


def per_second_quantiles(df: DataFrame, t: str, value: str) -> DataFrame:
    """(second, p50, p99, p999) for each second up to the largest ``t``, rounded (half to even), 1 at least; null where
    nothing falls, later values in the last. A second's distinct values are held together."""
    count = whole_seconds(df, t)
    df, last = df.crossJoin(F.broadcast(count)), F.col("__n") - 1
    grid = count.select(F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("second"))
    placed = df.groupBy(F.least(F.floor(F.col(t)), last).alias("second")).agg(
        *[F.percentile(value, p).alias(n) for n, p in (("p50", 0.5), ("p99", 0.99), ("p999", 0.999))]
    )
    return grid.join(placed, "second", "left")


def spikes_and_kth(df: DataFrame, t: str, value: str, order: list[str], k: int) -> DataFrame:
    """Each second's largest row and every k-th row, each once."""
    ranked = positions(df, order)
    top = ranked.groupBy(F.floor(F.col(t)).alias("__s")).agg(F.max_by("rn", F.struct(F.col(value), -F.col("rn"))).alias("rn"))
    kept = top.select("rn").union(ranked.where((F.col("rn") - 1) % k == 0).select("rn")).distinct()
    return ranked.join(kept, "rn", "left_semi")


def first_and_rest(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``df`` with spawn_kind: first for each group's first row, warm for the others."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("spawn_kind", F.when(F.row_number().over(w) == 1, "first").otherwise("warm"))


def group_stats(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """n, mean, median, p95, p99, min, max and sample deviation."""
    sums = df.groupBy(*group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.stddev_samp(value).alias("std"))
    ranks = linear_quantiles(df, value, {"median": 0.5, "p95": 0.95, "p99": 0.99}, group)
    return matched(sums, ranks, group, "left").select(*group, "n", "mean", "median", "p95", "p99", "min", "max", "std")


def pivot_ratio(df: DataFrame, row: str, column: str, value: str, columns: tuple[str, str]) -> DataFrame:
    """Medians of ``value`` by row, one column for each of two kinds, and the second over the first."""
    medians = linear_quantiles(df.where(F.col(column).isin(*columns)), value, {"__m": 0.5}, [row, column])
    wide = medians.groupBy(row).pivot(column, list(columns)).agg(F.first("__m"))
    return wide.select(row, *columns, F.try_divide(columns[1], columns[0]).alias("ratio"))


def decomposition(df: DataFrame, mode: str, stage: str, total: str, compiling: str, preparing: str, compiled: str = "JIT") -> DataFrame:
    """(mode, stage, median, compile, prepare, baseline, residual): what the medians of starts are made of.

    In mode ``compiled``, the medians of compiling and preparing are parts of their own, and what is left (0 at least)
    is baseline and residual; in others the whole start is. The baseline is the least rest of the mode's stages, up to
    the stage's own rest; the residual is what the rest has over it.
    """
    first, *more = [linear_quantiles(df, c, {c: 0.5}, [mode, stage]) for c in (total, compiling, preparing)]
    for other in more:
        first = first.join(other, [mode, stage], "left")
    part = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    rest = F.when(F.col(mode) == compiled, F.greatest(F.col(total) - part(compiling) - part(preparing), F.lit(0.0))).otherwise(F.col(total))
    base = F.min("__rest").over(Window.partitionBy(mode))
    out = first.withColumn("__rest", rest).withColumn("__base", base)
    return out.select(
        mode, stage, F.col(total).alias("median"), part(compiling).alias("compile"), part(preparing).alias("prepare"),
        F.least("__rest", "__base").alias("baseline"), F.greatest(F.col("__rest") - F.col("__base"), F.lit(0.0)).alias("residual"),
    )


def preferred_order(name: Column, preferred: list[str]) -> tuple[Column, Column]:
    """Sort keys: preferred names in their order, then the others by name."""
    at = F.array_position(F.lit(preferred), name)
    return F.when(at > 0, at).otherwise(len(preferred) + 1), name


def ecdf(df: DataFrame, value: str, order: list[str], group: list[str] | None = None) -> DataFrame:
    """``df`` with y = rank / n, and y_lin from 0 to 100."""
    ranked = positions(df, order, group)
    return ranked.withColumns({"y": F.col("rn") / F.col("n"), "y_lin": F.when(F.col("n") > 1, (F.col("rn") - 1) / (F.col("n") - 1) * 100).otherwise(F.lit(0.0))}).drop("rn", "n")


def cdf_on_grid(df: DataFrame, run: str, value: str, grid: DataFrame) -> DataFrame:
    """(run, x, y): each run's distribution function (x sorted, y = rank / n) at the grid's points ``x``, between its
    points by linear interpolation, 0 before the first and 1 after the last.

    Each point finds the grid's gap that it lies in by bisection (the grid travels to all tasks, so it is to be of modest
    size); of each gap only the first and last point are needed, so that no task holds a run.
    """
    points = positions(df.select(run, F.col(value).cast("double").alias("x")), ["x"], [run]).groupBy(run, "x").agg((F.max("rn") / F.max("n")).alias("hi"), (F.min("rn") / F.max("n")).alias("lo"))
    listed = grid.agg(F.sort_array(F.collect_set(F.col("x").cast("double"))).alias("__g"))
    # How many of the grid's points lie below x: each halving keeps g[low - 1] < x <= g[high].
    below = F.expr("aggregate(sequence(0, cast(ceil(log2(size(__g) + 1)) as int)), named_struct('low', 0, 'high', size(__g)), (a, i) -> if(a.low >= a.high, a, if(__g[(a.low + a.high) div 2] < x, named_struct('low', cast((a.low + a.high) div 2 + 1 as int), 'high', a.high), named_struct('low', a.low, 'high', cast((a.low + a.high) div 2 as int)))), a -> a.low)")
    placed = points.crossJoin(F.broadcast(listed)).withColumn("gap", below)
    ends = placed.groupBy(run, "gap").agg(F.min(F.struct("x", "lo", "hi")).alias("first"), F.max(F.struct("x", "lo", "hi")).alias("last"))
    asked = points.select(run).distinct().crossJoin(F.broadcast(listed.select(F.posexplode("__g").alias("gap", "at"))))
    both = asked.join(ends, [run, "gap"], "left")
    # A grid point's own gap ends at it, so that its last point lies at or below it; the next gaps lie above.
    order = Window.partitionBy(run).orderBy("gap")
    low = F.last("last", True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.last("first", True).over(Window.partitionBy(run).orderBy(F.desc("gap")).rowsBetween(Window.unboundedPreceding, -1))
    last = ends.groupBy(run).agg(F.max(F.struct("gap", "first")).alias("__top"))  # points above the whole grid have a gap of their own
    found = both.withColumns({"low": low, "high": after}).join(last, run)
    found = found.withColumn("high", F.coalesce("high", F.when(F.col("__top.gap") > F.col("gap"), F.col("__top.first"))))
    x, x0, y0, x1, y1 = F.col("at"), F.col("low.x"), F.col("low.hi"), F.col("high.x"), F.col("high.lo")
    y = F.when(x0.isNull(), 0.0).when(x1.isNull(), F.when(x > x0, 1.0).otherwise(y0)).when(x == x0, y0).otherwise(y0 + (y1 - y0) * (x - x0) / (x1 - x0))
    return found.select(run, x.alias("x"), y.alias("y"))


def log_grid(df: DataFrame, value: str, points: int = 1000, least: float = 0.01) -> DataFrame:
    """(x): ``points`` values from the least (``least`` at least) to the largest of ``value``, evenly on a logarithmic
    scale, both ends included."""
    ends = df.agg(F.greatest(F.min(value), F.lit(least)).alias("lo"), F.max(value).alias("hi"))
    i, lo, hi = F.col("id"), F.log10("lo"), F.log10("hi")
    x = F.when(i == 0, F.col("lo")).when(i == points - 1, F.col("hi")).otherwise(F.pow(F.lit(10.0), lo + i * ((hi - lo) / (points - 1))))
    return df.sparkSession.range(points).crossJoin(F.broadcast(ends)).select(x.alias("x"))


def ensemble(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Pointwise median, p10 and p90 over runs (a value of each run is held together at a point)."""
    return rows.groupBy(x).agg(F.percentile(y, 0.5).alias("median"), F.percentile(y, 0.1).alias("p10"), F.percentile(y, 0.9).alias("p90"))


def quantile_from_cdf(points: DataFrame, group: list[str], q: float) -> DataFrame:
    """(group, x): where a distribution function (x, y) reaches ``q``, between its points by linear interpolation."""
    w = Window.partitionBy(*group).orderBy("y", "x")
    steps = points.withColumns({"x0": F.lag("x").over(w), "y0": F.lag("y").over(w)}).where(F.col("y") >= q)
    first = steps.groupBy(*group).agg(F.min_by(F.struct("x", "y", "x0", "y0"), F.struct("y", "x")).alias("s"))
    between = F.col("s.x0") + (F.lit(q) - F.col("s.y0")) / (F.col("s.y") - F.col("s.y0")) * (F.col("s.x") - F.col("s.x0"))
    return first.select(*group, F.when(F.col("s.x0").isNull() | (F.col("s.y") == F.col("s.y0")), F.col("s.x")).otherwise(between).alias("x"))


def step_series(events: DataFrame, key: str = "stage") -> DataFrame:
    """(key, t_s, until, c): the count after each event holds until the next; from (0, 0) to the largest time of all
    events. Compiling alone changes no count."""
    real = events.where("action <> 'init_jit'").select(key, "t_s", F.col("new_count").cast("long").alias("c"), "ord")
    zero = real.select(key).distinct().select(key, F.lit(0.0).alias("t_s"), F.lit(0).cast("long").alias("c"), F.lit(-1).cast("long").alias("ord"))
    w = Window.partitionBy(key).orderBy("t_s", "ord")
    steps = real.unionByName(zero).crossJoin(F.broadcast(events.agg(F.max("t_s").alias("__end"))))
    return steps.withColumn("until", F.coalesce(F.lead("t_s").over(w), "__end")).drop("ord", "__end")


def even_grid(df: DataFrame, t: str, points: int) -> DataFrame:
    """(t_s): ``points`` times from 0 to the largest ``t``, evenly, both ends included."""
    hi, i = F.col("hi"), F.col("id")
    return df.sparkSession.range(points).crossJoin(df.agg(F.max(t).alias("hi"))).select(F.when(i == points - 1, hi).otherwise(i * (hi / (points - 1))).alias("t_s"))


def step_resample(steps: DataFrame, grid: DataFrame, key: str = "stage") -> DataFrame:
    """(key, t_s, c) at the grid's times: the last count at or before each."""
    asked = steps.select(key).distinct().crossJoin(F.broadcast(grid.select("t_s"))).select(key, "t_s", F.lit(None).cast("long").alias("c"), F.lit(1).alias("q"))
    known = steps.groupBy(key, "t_s").agg(F.max_by("c", "ord").alias("c")).withColumn("q", F.lit(0)) if "ord" in steps.columns else steps.select(key, "t_s", "c", F.lit(0).alias("q"))
    w = Window.partitionBy(key).orderBy("t_s", "q").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return known.select(key, "t_s", "c", "q").unionByName(asked).withColumn("c", F.last("c", True).over(w)).where("q = 1").drop("q")


def replica_seconds(steps: DataFrame, key: str = "stage") -> DataFrame:
    """(key, replica_s, duration, avg_replicas): the step function's integral, from 0 to where its last step ends."""
    area = F.sum(F.col("c") * F.greatest(F.col("until") - F.col("t_s"), F.lit(0.0)))
    return steps.groupBy(key).agg(area.alias("replica_s"), F.max("until").alias("duration")).withColumn("avg_replicas", F.try_divide("replica_s", "duration"))


def savings(used: DataFrame, baseline: DataFrame, key: str = "stage") -> DataFrame:
    """(key, baseline_s, replica_s, saved_s, saved_pct)."""
    joined = used.select(key, "replica_s").join(baseline.select(key, F.col("replica_s").alias("baseline_s")), key)
    return joined.withColumn("saved_s", F.col("baseline_s") - F.col("replica_s")).withColumn("saved_pct", F.try_divide(F.col("saved_s") * 100, F.col("baseline_s")))


def nearest_match(runs: DataFrame, logs: DataFrame, within: float, key: str, t: str = "t_s") -> DataFrame:
    """Each run (key, t_s) with the log (log_id, t_s) nearest in time, less than ``within`` away; of equally near ones the
    earlier, then the smaller id.

    Times are dealt into buckets of that width; each bucket knows the last log of the bucket before and the first of the
    next, so that one sorted pass each way finds a run's neighbours, however crowded a bucket is.
    """
    bucket = F.floor(F.col(t) / within)
    log = F.struct(F.col(t).alias("t"), F.col("log_id").alias("id"))
    ends = logs.groupBy(bucket.alias("__b")).agg(F.min(log).alias("first"), F.max(F.struct(F.col(t).alias("t"), (-F.col("log_id")).alias("id"))).alias("last"))
    # The last log is that of the largest time, and of these the one with the smallest id.
    ends = ends.select("__b", "first", F.struct(F.col("last.t").alias("t"), (-F.col("last.id")).alias("id")).alias("last"))
    kept = ["__b", F.col(t).alias("__t")]
    given = logs.withColumn("__b", bucket).select(*kept, F.lit(None).cast(runs.schema[key].dataType).alias(key), log.alias("log"), F.lit(0).alias("__k"))
    around = ends.select((F.col("__b") + 1).alias("__b"), F.col("last").alias("log")).unionByName(ends.select((F.col("__b") - 1).alias("__b"), F.col("first").alias("log")))
    around = around.select("__b", F.col("log.t").alias("__t"), F.lit(None).cast(runs.schema[key].dataType).alias(key), "log", F.lit(0).alias("__k"))
    asked = runs.withColumn("__b", bucket).select(*kept, key, F.lit(None).cast(given.schema["log"].dataType).alias("log"), F.lit(1).alias("__k"))
    both = given.unionByName(around).unionByName(asked)
    w = Window.partitionBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Of logs with equal times, the smallest id comes last on the way up, and on the way down.
    up = F.last("log", True).over(Window.partitionBy("__b").orderBy("__t", "__k", F.desc("log.id")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    down = F.last("log", True).over(Window.partitionBy("__b").orderBy(F.desc("__t"), "__k", F.desc("log.id")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = both.withColumns({"__up": up, "__down": down}).where("__k = 1")
    away = lambda c: F.abs(F.col(f"{c}.t") - F.col("__t"))
    later = F.coalesce(away("__down") < away("__up"), F.col("__up").isNull())
    nearest = found.withColumn("m", F.when(later, F.col("__down")).otherwise(F.col("__up"))).withColumn("away", away("m")).where(F.col("away") < within)
    return nearest.select(key, F.col("__t").alias("run_t"), F.col("m.id").alias("log_id"), "away")


def rates(df: DataFrame, t: str, total: str, key: str) -> DataFrame:
    """(key, mid, rate): differences of a running total over time; null where time stands still."""
    w = Window.partitionBy(key).orderBy(t)
    dt = F.col(t) - F.lag(t).over(w)
    out = df.select(key, ((F.col(t) + F.lag(t).over(w)) / 2).alias("mid"), F.when(dt > 0, (F.col(total) - F.lag(total).over(w)) / dt).alias("rate"))
    return out.where("mid IS NOT NULL")


def per_second_from_total(df: DataFrame, t: str, total: str, key: str) -> DataFrame:
    """(key, second, value): a running total between whole seconds, by linear interpolation. Before a key's first point
    the total is the first one's, after its last the last one's; seconds go up to the largest ``t`` of all keys, rounded.

    Each interval between two points knows the whole seconds in it; no grid is joined.
    """
    w = Window.partitionBy(key).orderBy("t", "v")
    points = df.select(key, F.col(t).cast("double").alias("t"), F.col(total).cast("double").alias("v")).crossJoin(F.broadcast(whole_seconds(df, t)))
    pairs = points.withColumns({"t1": F.lead("t").over(w), "v1": F.lead("v").over(w), "first": F.row_number().over(w) == 1})
    seconds = lambda low, high: f"if({low} <= {high}, sequence({low}, {high}), cast(array() as array<bigint>))"
    before = pairs.where("first").select(key, F.explode(F.expr(seconds("0L", "least(floor(t), __n)"))).alias("second"), "v")
    after = pairs.where("t1 IS NULL").select(key, F.explode(F.expr(seconds("greatest(floor(t) + 1, 0L)", "__n"))).alias("second"), "v")
    inside = pairs.where("t1 > t").select(key, F.explode(F.expr(seconds("greatest(floor(t) + 1, 0L)", "least(floor(t1), __n)"))).alias("second"), "t", "v", "t1", "v1")
    inside = inside.select(key, "second", (F.col("v") + (F.col("second") - F.col("t")) / (F.col("t1") - F.col("t")) * (F.col("v1") - F.col("v"))).alias("v"))
    at = before.unionByName(inside).unionByName(after)
    step = F.lead("v").over(Window.partitionBy(key).orderBy("second")) - F.col("v")
    return at.select(key, "second", step.alias("value")).where("value IS NOT NULL")


def downsample(df: DataFrame, key: str, t: str, value: str, width: float) -> DataFrame:
    """(key, t, v, n): buckets that begin at their first point and end before the first point ``width`` later; means."""

    def fold():
        held: list = []

        def end():
            return [(held[1] / held[3], held[2] / held[3], held[3])] if held else []

        def step(at, v):
            done = end() if held and at >= held[0] + width else []
            if done or not held:
                held[:] = [at, 0.0, 0.0, 0]
            held[1], held[2], held[3] = held[1] + at, held[2] + v, held[3] + 1
            return done

        return step, end

    points = df.select(key, F.col(t).cast("double").alias("t"), F.col(value).cast("double").alias("v"))
    return recurrence(points, key, "t", ["v"], "t double, v double, n bigint", fold)


def latest_sum(df: DataFrame, key: str, t: str, value: str) -> DataFrame:
    """``df`` with the sum over keys of each key's latest value, after each row in the order of ``t`` (no two alike): the
    running sum of each key's differences."""
    own = Window.partitionBy(key).orderBy(t)
    return running_sum(df.withColumn("__d", F.col(value) - F.lag(value, 1, 0).over(own)), [t], "__d", "total").drop("__d")


def running_count(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    return df.withColumn("running", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long"))


def sweep_rows(stages: DataFrame, edges: DataFrame, ingress: DataFrame, runs: DataFrame, run: str = "offered") -> DataFrame:
    """``runs`` with what a run's latency is made of, at p50 and at p99: compute (the sum over its stages), transport
    (over its edges) and ingress wait; 0 where a run has none. Each of the three has (run, p50, p99)."""
    out = runs
    for name, parts in (("compute", stages), ("transport", edges), ("ingress", ingress)):
        sums = parts.groupBy(run).agg(*[F.sum(p).alias(f"{name}_{p}") for p in ("p50", "p99")])
        out = out.join(sums, run, "left")
    return out.fillna(0.0, [f"{name}_{p}" for name in ("compute", "transport", "ingress") for p in ("p50", "p99")])


def knee(runs: DataFrame, offered: str = "offered", sustained: str = "sustained", share: float = 0.9) -> DataFrame:
    """One row: the least offered rate of which less than ``share`` is sustained; null if that is the first or there is none."""
    out = runs.agg(F.min(offered).alias("__low"), F.min(F.when(F.col(sustained) < F.lit(share) * F.col(offered), F.col(offered))).alias("knee"))
    return out.select(F.when(F.col("knee") > F.col("__low"), F.col("knee")).alias("knee"))


def weighted_mean(df: DataFrame, group: list[str], value: str, weight: str) -> DataFrame:
    """(group, n, mean, std): rows of which value and weight are above 0; mean by weight, sample deviation."""
    good = df.where((F.col(value) > 0) & (F.col(weight) > 0))
    return good.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), (F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("mean"), F.stddev_samp(value).alias("std"))


def boxplot(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, q1, median, q3, low, high, fliers): whiskers end at the last values within 1.5 quartile ranges."""
    q = linear_quantiles(df, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, group)
    v, reach = F.col(value), (F.col("q3") - F.col("q1")) * 1.5
    inside = (v >= F.col("q1") - reach) & (v <= F.col("q3") + reach)
    return df.join(q, group).groupBy(*group, "q1", "median", "q3").agg(F.min(F.when(inside, v)).alias("low"), F.max(F.when(inside, v)).alias("high"), F.sum((~inside).cast("long")).alias("fliers"))


def bootstrap_medians(df: DataFrame, group: list[str], value: str, draws: int = 100, seed: int = 1) -> DataFrame:
    """(group, low, high): 2.5 and 97.5 percentiles of medians over Poisson resamples (a row counts Poisson(1) times)."""
    turns = df.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    u = (F.pmod(F.xxhash64("draw", F.lit(seed), *df.columns), F.lit(1 << 40)) / float(1 << 40))
    times = sum(((u > c).cast("int") for c in (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015)), F.lit(0))
    medians = linear_quantiles(turns.withColumn("__n", times).where("__n > 0"), value, {"m": 0.5}, [*group, "draw"], "__n")
    return medians.groupBy(*group).agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))


def gap_split(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, split): geometric mean of the neighbours with the largest ratio among the sorted values (the first of
    equal ratios); for the ratio, the lower one counts as 1e-9 at least. 1 for fewer than two values."""
    w = Window.partitionBy(group).orderBy("v")
    counts = df.where(F.col(value).isNotNull()).groupBy(group, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("__n"))
    pairs = counts.withColumn("u", F.lag("v").over(w)).select(group, F.explode(F.array(F.struct("u", "v"), F.struct(F.when(F.col("__n") > 1, F.col("v")).alias("u"), "v"))).alias("s"))
    ratio = F.when(F.col("s.u").isNotNull(), F.col("s.v") / F.greatest(F.col("s.u"), F.lit(1e-9)))
    top = pairs.groupBy(group).agg(F.max_by("s", F.when(ratio.isNotNull(), F.struct(ratio, -F.col("s.v")))).alias("s"))
    return top.select(group, F.coalesce(F.sqrt(F.col("s.u") * F.col("s.v")), F.lit(1.0)).alias("split"))


def annotation(children: str, key: str) -> Column:
    """(name, value) of children whose first annotation named ``key`` is a number above 0."""
    return F.expr(f"filter(transform({children}, c -> struct(c.name as name, try_cast(try_element_at(filter(c.annotations, a -> a.key = '{key}'), 1).value as double) as value)), x -> x.value > 0)")


def chunk_quantiles(df: DataFrame, order: list[str], value: str, polls: DataFrame) -> DataFrame:
    """(chunk, n, p50, p99): as many chunks of equal size as ``polls`` has rows, of rows in a row, one row at least; what
    is left over after the last chunk belongs to none. A chunk's distinct values are held together."""
    ranked = positions(df, order).crossJoin(F.broadcast(polls.agg(F.count(F.lit(1)).alias("__polls"))))
    size = F.greatest(F.floor(F.col("n") / F.col("__polls")), F.lit(1))
    chunk = F.floor((F.col("rn") - 1) / size)
    placed = ranked.withColumn("chunk", chunk).where("chunk < __polls")
    return placed.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.percentile(value, 0.5).alias("p50"), F.percentile(value, 0.99).alias("p99"))


def zip_positions(a: DataFrame, b: DataFrame, order_a: list[str], order_b: list[str], names: tuple[str, str]) -> DataFrame:
    """(rn, a's value, b's value) by position; blanks where one is shorter."""
    left = positions(a, order_a).select("rn", F.col(names[0]))
    right = positions(b, order_b).select("rn", F.col(names[1]))
    return left.join(right, "rn", "full_outer")


def grid_splits(spark, total: int, low: int, high: int) -> DataFrame:
    """All (n, d, f) from low to high with the given sum."""
    n = spark.range(low, high + 1)
    return n.select(F.col("id").alias("n")).crossJoin(n.select(F.col("id").alias("d"))).withColumn("f", total - F.col("n") - F.col("d")).where(F.col("f").between(low, high))


def equal_bins(df: DataFrame, value: str, bins: int) -> DataFrame:
    """(bin, low, high, count): equal bins from least to largest, the last one closed."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1)))
    counts = df.crossJoin(F.broadcast(ends)).groupBy(place.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = df.sparkSession.range(bins).select(F.col("id").alias("bin")).crossJoin(F.broadcast(ends))
    return grid.join(counts, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), F.coalesce("count", F.lit(0)).alias("count"))


def density(df: DataFrame, group: str, value: str, grid: DataFrame, bandwidth: float, bins: int = 512) -> DataFrame:
    """(group, x, density): a Gaussian kernel density at the grid's points ``x``, of values taken together in ``bins``
    equal bins at their means (exact where a bin holds one value), so that the work at a point is bounded."""
    ends = df.agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    place = F.least(F.floor((F.col(value) - F.col("__lo")) * bins / F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0))), F.lit(bins - 1))
    binned = df.crossJoin(F.broadcast(ends)).groupBy(group, F.coalesce(place, F.lit(0)).alias("__b")).agg(F.avg(value).alias("__m"), F.count(value).alias("__n"))
    total = F.sum("__n").over(Window.partitionBy(group))
    u = (F.col("x") - F.col("__m")) / bandwidth
    at = binned.withColumn("__total", total).crossJoin(F.broadcast(grid.select("x")))
    return at.groupBy(group, "x").agg((F.sum(F.col("__n") / F.col("__total") * F.exp(-u * u / 2)) / (bandwidth * (2 * math.pi) ** 0.5)).alias("density"))


def jitter(df: DataFrame, key: list[str], width: float, seed: int = 1) -> DataFrame:
    """``df`` with ``offset`` within half of ``width`` on each side, by the key and the seed alone."""
    return df.withColumn("offset", (F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 40)) / float(1 << 40) - 0.5) * width)
