"""Queries of offline analysis, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from streamstage.operators import analysis as ana
from streamstage.operators import grid, logs
from streamstage.operators.ranking import linear_quantiles
from streamstage.plans import fixtures as X
from streamstage.plans.dataflow import query
from streamstage.plans.measures import _GAP

_FLAT = f"flat AS (SELECT seq, recv_ts, 'intra' AS kind, stage AS edge, (exit_ts - enter_ts) * 1000 AS latency_ms FROM hop UNION ALL SELECT seq, recv_ts, 'inter', from_stage || '->' || to_stage, gap_ms FROM ({_GAP}))"


def _rounded(df, *names: str):
    return df.withColumns({c: F.round(c, 6) for c in names})


def _rows(spark, sf_dir):
    """Events as (ord, t_s, stage, value)."""
    return X.events(spark, sf_dir).selectExpr("event_id AS ord", "event_id * 5e-2 AS t_s", "event_type AS stage", "value")


ROWS = "rows_ AS (SELECT event_id AS ord, event_id * 5e-2 AS t_s, event_type AS stage, value FROM events)"


@query(f"WITH {X.HOPS}, {_FLAT} SELECT seq, kind, edge, round(latency_ms, 5) AS latency_ms FROM flat")
def ana_flatten_hops(spark, sf_dir):
    return ana.flatten_hops(X.hop_log(spark, sf_dir)).select("seq", "kind", "edge", F.round("latency_ms", 5).alias("latency_ms"))


@query(f"WITH {X.HOPS}, {_FLAT} SELECT floor(recv_ts / 2e0) * 2e0 + 1e0 AS t_s, kind, edge, count(*) AS n, round(quantile_cont(latency_ms, 0.5), 5) AS p50, round(quantile_cont(latency_ms, 0.95), 5) AS p95 FROM flat GROUP BY 1, 2, 3")
def ana_bin_latency(spark, sf_dir):
    out = ana.bin_latency(ana.flatten_hops(X.hop_log(spark, sf_dir)), 2.0)
    return out.withColumns({"p50": F.round("p50", 5), "p95": F.round("p95", 5)})


@query(
    f"WITH {ROWS}, d AS (SELECT greatest(CAST(round_even(max(t_s), 0) AS BIGINT), 1) AS n FROM rows_), b AS (SELECT least(CAST(floor(t_s) AS BIGINT), n - 1) AS second, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.99) AS p99, quantile_cont(value, 0.999) AS p999 FROM rows_, d GROUP BY 1), "
    "g AS (SELECT unnest(range(n)) AS second FROM d) SELECT second, round(p50, 6) AS p50, round(p99, 6) AS p99, round(p999, 6) AS p999 FROM g LEFT JOIN b USING (second)"
)
def ana_latency_timeseries(spark, sf_dir):
    return _rounded(ana.per_second_quantiles(_rows(spark, sf_dir), "t_s", "value"), "p50", "p99", "p999")


@query(f"WITH {ROWS}, r AS (SELECT *, row_number() OVER (ORDER BY ord) AS rn FROM rows_), m AS (SELECT rn FROM (SELECT rn, row_number() OVER (PARTITION BY floor(t_s) ORDER BY value DESC, rn) AS k FROM r) WHERE k = 1) SELECT ord, value FROM r WHERE (rn - 1) % 50 = 0 OR rn IN (SELECT rn FROM m)")
def ana_spike_subsample(spark, sf_dir):
    return ana.spikes_and_kth(_rows(spark, sf_dir), "t_s", "value", ["ord"], 50).select("ord", "value")


@query(f"WITH {X.COLD} SELECT ord, mode, stage, CASE WHEN k = 1 THEN cold_start_ms END AS cold_start_ms, CASE WHEN k > 1 THEN cold_start_ms END AS warm_ms FROM (SELECT *, row_number() OVER (PARTITION BY mode, stage ORDER BY ord) AS k FROM cold)")
def set_union_missing_cols(spark, sf_dir):
    marked = ana.first_and_rest(X.cold_starts(spark, sf_dir), ["mode", "stage"], ["ord"])
    first = marked.where("spawn_kind = 'first'").select("ord", "mode", "stage", "cold_start_ms")
    rest = marked.where("spawn_kind = 'warm'").select("ord", "mode", "stage", F.col("cold_start_ms").alias("warm_ms"))
    return first.unionByName(rest, allowMissingColumns=True)


@query(f"WITH {X.COLD} SELECT ord, mode, stage, CASE WHEN row_number() OVER (PARTITION BY mode, stage ORDER BY ord) = 1 THEN 'first' ELSE 'warm' END AS spawn_kind FROM cold")
def win_first_vs_rest(spark, sf_dir):
    return ana.first_and_rest(X.cold_starts(spark, sf_dir), ["mode", "stage"], ["ord"]).select("ord", "mode", "stage", "spawn_kind")


@query(f"WITH {X.COLD} SELECT mode, stage, count(*) AS n, round(avg(cold_start_ms), 6) AS mean, round(quantile_cont(cold_start_ms, 0.5), 6) AS median, round(quantile_cont(cold_start_ms, 0.95), 6) AS p95, round(quantile_cont(cold_start_ms, 0.99), 6) AS p99, min(cold_start_ms) AS min, max(cold_start_ms) AS max, round(stddev_samp(cold_start_ms), 6) AS std FROM cold GROUP BY 1, 2")
def agg_group_stats(spark, sf_dir):
    return _rounded(ana.group_stats(X.cold_starts(spark, sf_dir), ["mode", "stage"], "cold_start_ms"), "mean", "median", "p95", "p99", "std")


_MED = "quantile_cont(cold_start_ms, 0.5) FILTER (mode = '{m}')"


@query(f"WITH {X.COLD} SELECT stage, round({_MED.format(m='AOT')}, 6) AS \"AOT\", round({_MED.format(m='JIT')}, 6) AS \"JIT\", round({_MED.format(m='JIT')} / {_MED.format(m='AOT')}, 6) AS ratio FROM cold GROUP BY stage")
def pivot_ratio(spark, sf_dir):
    return _rounded(ana.pivot_ratio(X.cold_starts(spark, sf_dir), "stage", "mode", "cold_start_ms", ("AOT", "JIT")), "AOT", "JIT", "ratio")


@query(
    f"WITH {X.COLD}, m AS (SELECT mode, stage, quantile_cont(cold_start_ms, 0.5) AS median, coalesce(quantile_cont(compile_ms, 0.5), 0e0) AS comp, coalesce(quantile_cont(prepare_ms, 0.5), 0e0) AS prep FROM cold GROUP BY 1, 2), "
    "r AS (SELECT *, CASE mode WHEN 'JIT' THEN greatest(median - comp - prep, 0e0) ELSE median END AS rest FROM m), b AS (SELECT *, min(rest) OVER (PARTITION BY mode) AS base FROM r) "
    "SELECT mode, stage, round(median, 6) AS median, round(comp, 6) AS compile, round(prep, 6) AS prepare, round(least(rest, base), 6) AS baseline, round(greatest(rest - base, 0e0), 6) AS residual FROM b"
)
def ana_decomposition(spark, sf_dir):
    out = ana.decomposition(X.cold_starts(spark, sf_dir), "mode", "stage", "cold_start_ms", "compile_ms", "prepare_ms")
    return _rounded(out, "median", "compile", "prepare", "baseline", "residual")


@query("SELECT stage, row_number() OVER (ORDER BY CASE stage WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END, stage) AS place FROM (SELECT DISTINCT event_type AS stage FROM events)")
def sort_custom_order(spark, sf_dir):
    from pyspark.sql import Window

    names = X.events(spark, sf_dir).select(F.col("event_type").alias("stage")).distinct()
    return names.select("stage", F.row_number().over(Window.orderBy(*ana.preferred_order(F.col("stage"), ["view", "click"]))).cast("long").alias("place"))


_RANKED = "r AS (SELECT ord, value, row_number() OVER (ORDER BY value, ord) AS rn, count(*) OVER () AS n FROM rows_)"


@query(f"WITH {ROWS}, {_RANKED} SELECT ord, value, round(CAST(rn AS DOUBLE) / n, 6) AS y FROM r")
def win_ecdf(spark, sf_dir):
    return ana.ecdf(_rows(spark, sf_dir), "value", ["value", "ord"]).select("ord", "value", F.round("y", 6).alias("y"))


@query(f"WITH {ROWS}, {_RANKED} SELECT ord, value, round(CAST(rn - 1 AS DOUBLE) / (n - 1) * 100, 6) AS y FROM r")
def win_ecdf_linspace(spark, sf_dir):
    return ana.ecdf(_rows(spark, sf_dir), "value", ["value", "ord"]).select("ord", "value", F.round("y_lin", 6).alias("y"))


@query(
    f"WITH {ROWS}, p AS (SELECT stage, value AS x, max(rn) / max(n) AS hi, min(rn) / max(n) AS lo FROM (SELECT stage, value, CAST(row_number() OVER (PARTITION BY stage ORDER BY value) AS DOUBLE) AS rn, CAST(count(*) OVER (PARTITION BY stage) AS DOUBLE) AS n FROM rows_) GROUP BY 1, 2), "
    "e AS (SELECT greatest(min(value), 1e-2) AS a, max(value) AS b FROM rows_), "
    "g AS (SELECT stage, CASE range WHEN 0 THEN a WHEN 999 THEN b ELSE power(1e1, log10(a) + range * ((log10(b) - log10(a)) / 999)) END AS x FROM range(1000), e, (SELECT DISTINCT stage FROM rows_)), "
    "a AS (SELECT g.stage, g.x, p.x AS x0, p.hi AS y0 FROM g ASOF LEFT JOIN p ON g.stage = p.stage AND g.x >= p.x), b AS (SELECT a.*, p.x AS x1, p.lo AS y1 FROM a ASOF LEFT JOIN p ON a.stage = p.stage AND a.x <= p.x), "
    "v AS (SELECT stage, x, CASE WHEN x0 IS NULL THEN 0e0 WHEN x1 IS NULL THEN CASE WHEN x > x0 THEN 1e0 ELSE y0 END WHEN x = x0 THEN y0 ELSE y0 + (y1 - y0) * (x - x0) / (x1 - x0) END AS y FROM b) "
    "SELECT round(x, 6) AS x, round(quantile_cont(y, 0.5), 6) AS median, round(quantile_cont(y, 0.1), 6) AS p10, round(quantile_cont(y, 0.9), 6) AS p90 FROM v GROUP BY v.x"
)
def ana_cdf_ensemble(spark, sf_dir):
    on_grid = ana.cdf_on_grid(_rows(spark, sf_dir), "stage", "value", ana.log_grid(_rows(spark, sf_dir), "value"))
    return _rounded(ana.ensemble(on_grid, "x", "y"), "x", "median", "p10", "p90")


@query(
    f"WITH {ROWS}, p AS (SELECT stage, value AS x, CAST(row_number() OVER (PARTITION BY stage ORDER BY value, ord) AS DOUBLE) / count(*) OVER (PARTITION BY stage) AS y FROM rows_), "
    "l AS (SELECT *, lag(x) OVER w AS x0, lag(y) OVER w AS y0 FROM p WINDOW w AS (PARTITION BY stage ORDER BY y, x)), f AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY y, x) AS k FROM l WHERE y >= 9e-1) "
    "SELECT stage, round(CASE WHEN x0 IS NULL OR y = y0 THEN x ELSE x0 + (9e-1 - y0) / (y - y0) * (x - x0) END, 6) AS x FROM f WHERE k = 1"
)
def ana_quantile_from_cdf(spark, sf_dir):
    points = ana.ecdf(_rows(spark, sf_dir), "value", ["value", "ord"], ["stage"]).select("stage", F.col("value").alias("x"), "y")
    return _rounded(ana.quantile_from_cdf(points, ["stage"], 0.9), "x")


_STEPS = "d AS (SELECT max(t_s) AS hi FROM scaling), steps AS (SELECT stage, t_s, c, coalesce(lead(t_s) OVER (PARTITION BY stage ORDER BY t_s, ord), hi) AS until FROM (SELECT stage, t_s, new_count AS c, ord FROM scaling UNION ALL SELECT DISTINCT stage, 0e0, 0, -1 FROM scaling), d)"
_AREA = "area AS (SELECT stage, hi, sum(c * greatest(until - t_s, 0e0)) AS replica_s FROM steps, d GROUP BY ALL)"


@query(f"WITH {X.SCALING}, {_STEPS} SELECT stage, round(t_s, 6) AS t_s, round(until, 6) AS until, c FROM steps")
def ana_step_series(spark, sf_dir):
    return _rounded(ana.step_series(X.scaling_log(spark, sf_dir)), "t_s", "until")


_RESAMPLED = (
    f"{X.SCALING}, e AS (SELECT max(t_s) AS hi FROM scaling), g AS (SELECT stage, CASE range WHEN 599 THEN hi ELSE range * (hi / 599) END AS t_s FROM range(600), e, (SELECT DISTINCT stage FROM scaling)), "
    "at_ AS (SELECT g.stage, g.t_s, coalesce(s.new_count, 0) AS c FROM g ASOF LEFT JOIN scaling s ON g.stage = s.stage AND g.t_s >= s.t_s)"
)


def _resampled(spark, sf_dir):
    """Counts on 600 points from 0 to the table's largest time; 0 before a stage's first event."""
    steps = X.scaling_log(spark, sf_dir).select("stage", "t_s", F.col("new_count").alias("c"), "ord")
    return ana.step_resample(steps, ana.even_grid(steps, "t_s", 600)).withColumn("c", F.coalesce("c", F.lit(0)))


@query(f"WITH {_RESAMPLED} SELECT stage, round(t_s, 6) AS t_s, c FROM at_")
def asof_step_resample(spark, sf_dir):
    return _resampled(spark, sf_dir).select("stage", F.round("t_s", 6).alias("t_s"), "c")


@query(f"WITH {_RESAMPLED} SELECT round(t_s, 6) AS t_s, round(quantile_cont(c, 0.5), 6) AS median, round(quantile_cont(c, 0.1), 6) AS p10, round(quantile_cont(c, 0.9), 6) AS p90 FROM at_ GROUP BY at_.t_s")
def ana_step_ensemble(spark, sf_dir):
    """Pointwise over runs, which the stages stand for."""
    return _rounded(ana.ensemble(_resampled(spark, sf_dir), "t_s", "c"), "t_s", "median", "p10", "p90")


def _used(spark, sf_dir):
    return ana.replica_seconds(ana.step_series(X.scaling_log(spark, sf_dir)))


@query(f"WITH {X.SCALING}, {_STEPS}, {_AREA} SELECT stage, round(replica_s, 6) AS replica_s, round(replica_s / hi, 6) AS avg_replicas FROM area")
def ana_replica_seconds(spark, sf_dir):
    return _rounded(_used(spark, sf_dir), "replica_s", "avg_replicas").select("stage", "replica_s", "avg_replicas")


@query(f"WITH {X.SCALING}, {_STEPS}, {_AREA}, m AS (SELECT stage, max(new_count) AS top FROM scaling GROUP BY stage) SELECT stage, round(top * hi, 6) AS baseline_s, round(replica_s, 6) AS replica_s, round(top * hi - replica_s, 6) AS saved_s, round((top * hi - replica_s) * 100 / (top * hi), 6) AS saved_pct FROM area JOIN m USING (stage)")
def ana_savings(spark, sf_dir):
    """Against as many replicas as a stage ever has, over the whole time."""
    used, log = _used(spark, sf_dir), X.scaling_log(spark, sf_dir)
    fixed = log.groupBy("stage").agg(F.max("new_count").alias("top")).join(used, "stage").select("stage", (F.col("top") * F.col("duration")).alias("replica_s"))
    return _rounded(ana.savings(used, fixed), "baseline_s", "replica_s", "saved_s", "saved_pct").select("stage", "baseline_s", "replica_s", "saved_s", "saved_pct")


_AVG = f"WITH {X.GRID}, g AS (SELECT mode, n, d, f, avg(p50) AS p50, avg(replicas) AS replicas, avg(downs) AS downs FROM grid GROUP BY ALL), "
_JOINED = _AVG + "j AS (SELECT n, d, f, a.p50 AS sf_p50, b.p50 AS sl_p50, (b.p50 / a.p50 - 1) * 100 AS delta_pct, (1 - b.replicas / (n + d + f)) * 100 AS savings_pct, b.downs AS downs FROM (SELECT * FROM g WHERE mode = 'SF') a JOIN (SELECT * FROM g WHERE mode = 'SL') b USING (n, d, f)) "
_GRID_OUT = "n, d, f, round(sf_p50, 6) AS sf_p50, round(sl_p50, 6) AS sl_p50, round(delta_pct, 4) AS delta_pct, round(savings_pct, 4) AS savings_pct, round(downs, 6) AS downs"


def _configs(spark, sf_dir):
    return grid.compared(X.grid(spark, sf_dir))


def _shown(df):
    return df.withColumns({c: F.round(c, 6) for c in ("sf_p50", "sl_p50", "downs")} | {c: F.round(c, 4) for c in ("delta_pct", "savings_pct")})


def _candidates(df):
    return grid.candidates(df, 60, -50, 2.5)


@query(_JOINED + f"SELECT {_GRID_OUT} FROM j")
def join_grid_configs(spark, sf_dir):
    return _shown(_configs(spark, sf_dir))


@query(_JOINED + f"SELECT {_GRID_OUT} FROM j WHERE abs(delta_pct) <= 60 AND savings_pct >= -50 AND downs >= 2.5")
def grid_candidates(spark, sf_dir):
    return _shown(_candidates(_configs(spark, sf_dir)))


@query(_JOINED + f"SELECT {_GRID_OUT} FROM j WHERE abs(delta_pct) <= 60 AND savings_pct >= -50 AND downs >= 2.5 ORDER BY abs(j.delta_pct), -j.savings_pct, n, d, f LIMIT 5")
def topk_candidates(spark, sf_dir):
    return _shown(grid.best(_candidates(_configs(spark, sf_dir))))


@query(
    f"WITH {ROWS}, c AS (SELECT r.ord, r.t_s, l.ord AS log_id, l.t_s AS lt, row_number() OVER (PARTITION BY r.ord ORDER BY abs(l.t_s - r.t_s), l.t_s, l.ord) AS k FROM (SELECT * FROM rows_ WHERE stage = 'view') r JOIN (SELECT * FROM rows_ WHERE stage <> 'view') l ON l.t_s >= r.t_s - 1 AND l.t_s <= r.t_s + 1 AND abs(l.t_s - r.t_s) < 1) "
    "SELECT ord, log_id, round(abs(lt - t_s), 6) AS away FROM c WHERE k = 1"
)
def asof_nearest(spark, sf_dir):
    """Each view with the nearest event of another type, so that every row has a part."""
    rows = _rows(spark, sf_dir)
    found = ana.nearest_match(rows.where("stage = 'view'").select("ord", "t_s"), rows.where("stage <> 'view'").select(F.col("ord").alias("log_id"), "t_s"), 1.0, "ord")
    return found.select("ord", "log_id", F.round("away", 6).alias("away"))


@query(f"WITH {ROWS} SELECT stage, round(mid, 6) AS mid, round(rate, 4) AS rate FROM (SELECT stage, (t_s + lag(t_s) OVER w) / 2 AS mid, CASE WHEN t_s - lag(t_s) OVER w > 0 THEN (ord - lag(ord) OVER w) / (t_s - lag(t_s) OVER w) END AS rate FROM rows_ WINDOW w AS (PARTITION BY stage ORDER BY t_s)) WHERE mid IS NOT NULL")
def win_rate_lag(spark, sf_dir):
    out = ana.rates(_rows(spark, sf_dir), "t_s", "ord", "stage")
    return out.withColumns({"mid": F.round("mid", 6), "rate": F.round("rate", 4)})


@query(
    f"WITH {ROWS}, p AS (SELECT stage, t_s AS t, CAST(ord AS DOUBLE) AS v FROM rows_), n AS (SELECT greatest(CAST(round_even(max(t), 0) AS BIGINT), 1) AS n FROM p), "
    "e AS (SELECT stage, min(t) AS t_a, arg_min(v, t) AS v_a, max(t) AS t_b, arg_max(v, t) AS v_b FROM p GROUP BY stage), g AS (SELECT e.*, unnest(range(n + 1)) AS s FROM e, n), "
    "lo AS (SELECT g.*, p.t AS t0, p.v AS v0 FROM g ASOF LEFT JOIN p ON g.stage = p.stage AND g.s > p.t), hi AS (SELECT lo.*, p.t AS t1, p.v AS v1 FROM lo ASOF LEFT JOIN p ON lo.stage = p.stage AND lo.s <= p.t), "
    "at_ AS (SELECT stage, s, CASE WHEN s <= t_a THEN v_a WHEN s >= t_b THEN v_b ELSE v0 + (s - t0) / (t1 - t0) * (v1 - v0) END AS v FROM hi) "
    "SELECT stage, s AS second, round(value, 6) AS value FROM (SELECT stage, s, lead(v) OVER (PARTITION BY stage ORDER BY s) - v AS value FROM at_) WHERE value IS NOT NULL"
)
def ana_interp_per_second(spark, sf_dir):
    return _rounded(ana.per_second_from_total(_rows(spark, sf_dir), "t_s", "ord", "stage"), "value")


@query(
    f"WITH RECURSIVE {ROWS}, p AS MATERIALIZED (SELECT stage, t_s, value, row_number() OVER (PARTITION BY stage ORDER BY t_s) AS i FROM rows_), "
    "f AS (SELECT stage, i, t_s AS a FROM p WHERE i = 1 UNION ALL SELECT p.stage, p.i, CASE WHEN p.t_s >= f.a + 1 THEN p.t_s ELSE f.a END FROM f JOIN p ON p.stage = f.stage AND p.i = f.i + 1) "
    "SELECT stage, round(avg(t_s), 6) AS t, round(avg(value), 6) AS v, count(*) AS n FROM f JOIN p USING (stage, i) GROUP BY stage, a"
)
def ana_downsample_adaptive(spark, sf_dir):
    return _rounded(ana.downsample(_rows(spark, sf_dir), "stage", "t_s", "value", 1.0), "t", "v")


@query(f"WITH {ROWS}, d AS (SELECT ord, floor(value) - coalesce(lag(floor(value)) OVER (PARTITION BY stage ORDER BY ord), 0) AS d FROM rows_) SELECT ord, CAST(sum(d) OVER (ORDER BY ord) AS BIGINT) AS total FROM d")
def win_latest_sum(spark, sf_dir):
    rows = _rows(spark, sf_dir).withColumn("whole", F.floor("value"))
    return ana.latest_sum(rows, "stage", "ord", "whole").select("ord", F.col("total").cast("long").alias("total"))


@query(f"WITH {ROWS} SELECT ord, stage, row_number() OVER (PARTITION BY stage ORDER BY ord) AS running FROM rows_")
def win_running_count(spark, sf_dir):
    return ana.running_count(_rows(spark, sf_dir), "stage", ["ord"]).select("ord", "stage", "running")


_Q = "quantile_cont({v}, 0.5) AS p50, quantile_cont({v}, 0.99) AS p99"
_SWEEP = (
    f"o AS (SELECT 1000 * (1 + event_id % 8) AS offered, event_type AS stage, value FROM events), s AS (SELECT offered, stage, {_Q.format(v='value')} FROM o GROUP BY 1, 2), e AS (SELECT offered, stage, {_Q.format(v='value / 3')} FROM o GROUP BY 1, 2), "
    f"i AS (SELECT offered, {_Q.format(v='value / 5')} FROM o GROUP BY 1), r AS (SELECT offered, round(offered * avg(CASE WHEN value < 140 - offered / 100 THEN 1e0 ELSE 0e0 END), 6) AS sustained FROM o GROUP BY 1)"
)


def _sweep(spark, sf_dir):
    """Quantiles by stage, by edge and of the ingress wait for each offered rate, and what of it is sustained."""
    rows = X.events(spark, sf_dir).select((1000 * (1 + F.col("event_id") % 8)).alias("offered"), F.col("event_type").alias("stage"), "value")
    quantiles = lambda by, share: linear_quantiles(rows.withColumn("value", F.col("value") / share), "value", {"p50": 0.5, "p99": 0.99}, ["offered", *by])
    runs = rows.groupBy("offered").agg(F.round(F.col("offered") * F.avg(F.when(F.col("value") < 140 - F.col("offered") / 100, 1.0).otherwise(0.0)), 6).alias("sustained"))
    return quantiles(["stage"], 1), quantiles(["stage"], 3), quantiles([], 5), runs


_SUMS = ", ".join(f"round((SELECT sum({p}) FROM {t} WHERE {t}.offered = r.offered), 6) AS {name}_{p}" for name, t in (("compute", "s"), ("transport", "e"), ("ingress", "i")) for p in ("p50", "p99"))


@query(f"WITH {_SWEEP} SELECT offered, sustained, {_SUMS} FROM r")
def ana_sweep_rows(spark, sf_dir):
    out = ana.sweep_rows(*_sweep(spark, sf_dir))
    return _rounded(out, *[c for c in out.columns if c not in ("offered", "sustained")])


@query(f"WITH {_SWEEP}, k AS (SELECT min(offered) AS low, min(offered) FILTER (sustained < 9e-1 * offered) AS knee FROM r) SELECT CASE WHEN knee > low THEN knee END AS knee FROM k")
def ana_knee(spark, sf_dir):
    return ana.knee(_sweep(spark, sf_dir)[3])


@query("SELECT event_type AS stage, count(*) AS n, round(sum(value * (event_id % 9)) / sum(event_id % 9), 6) AS mean, round(stddev_samp(value), 6) AS std FROM events WHERE value > 0 AND event_id % 9 > 0 GROUP BY 1")
def agg_weighted_mean(spark, sf_dir):
    rows = X.events(spark, sf_dir).select(F.col("event_type").alias("stage"), "value", (F.col("event_id") % 9).alias("w"))
    return _rounded(ana.weighted_mean(rows, ["stage"], "value", "w"), "mean", "std")


@query(
    f"WITH {ROWS}, q AS (SELECT stage, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM rows_ GROUP BY stage), m AS (SELECT *, value >= q1 - (q3 - q1) * 15e-1 AND value <= q3 + (q3 - q1) * 15e-1 AS inside FROM rows_ JOIN q USING (stage)) "
    "SELECT stage, round(max(q1), 6) AS q1, round(max(median), 6) AS median, round(max(q3), 6) AS q3, min(value) FILTER (inside) AS low, max(value) FILTER (inside) AS high, count(*) FILTER (NOT inside) AS fliers FROM m GROUP BY stage"
)
def agg_boxplot(spark, sf_dir):
    return _rounded(ana.boxplot(_rows(spark, sf_dir), ["stage"], "value"), "q1", "median", "q3")


@query(
    f"WITH {ROWS}, p AS (SELECT stage, value AS v, lag(value) OVER (PARTITION BY stage ORDER BY value) AS u FROM rows_), t AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY v / greatest(u, 1e-9) DESC, v) AS k FROM p WHERE u IS NOT NULL) SELECT stage, round(sqrt(u * v), 6) AS split FROM t WHERE k = 1"
)
def ana_gap_split(spark, sf_dir):
    return _rounded(ana.gap_split(_rows(spark, sf_dir), "stage", "value"), "split")


@query("SELECT event_id AS seq, 'a' AS name, CAST(event_id AS DOUBLE) AS value FROM events WHERE event_id % 3 <> 0 AND event_id > 0")
def nested_first_match(spark, sf_dir):
    """Two children: a's first match is the event's number, or no number for every third; b has none above 0."""
    note = "named_struct('key', '{k}', 'value', {v})"
    a = f"named_struct('name', 'a', 'annotations', array({note.format(k='other', v=chr(39) + '9' + chr(39))}, {note.format(k='initTime', v='if(event_id % 3 = 0, ' + chr(39) + 'x' + chr(39) + ', cast(event_id as string))')}, {note.format(k='initTime', v=chr(39) + '7' + chr(39))}))"
    b = f"named_struct('name', 'b', 'annotations', array({note.format(k='initTime', v=chr(39) + '-1' + chr(39))}))"
    rows = X.events(spark, sf_dir).select("event_id", F.expr(f"array({a}, {b})").alias("children"))
    return rows.select(F.col("event_id").alias("seq"), F.explode(ana.annotation("children", "initTime")).alias("m")).select("seq", "m.name", "m.value")


@query(
    "WITH r AS (SELECT value, row_number() OVER (ORDER BY event_id) AS rn, count(*) OVER () AS n FROM events), q AS (SELECT count(*) AS polls FROM events WHERE event_type = 'click') "
    "SELECT (rn - 1) // greatest(n // polls, 1) AS chunk, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.99), 6) AS p99 FROM r, q WHERE (rn - 1) // greatest(n // polls, 1) < polls GROUP BY 1"
)
def ana_chunk_percentiles(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return _rounded(ana.chunk_quantiles(rows.select("ord", "value"), ["ord"], "value", rows.where("stage = 'click'")), "p50", "p99")


@query("SELECT CASE WHEN event_id % 2 = 0 THEN 'a/b' ELSE 'c' END AS stage, round(event_id * 5e-2 - 1e1, 6) AS t_s, CAST(event_id AS DOUBLE) AS cold_start_ms FROM events WHERE event_type = 'click' AND event_id % 3 <> 0")
def log_cold_starts(spark, sf_dir):
    """Starts that a log tells of; every third boot message of the fixture has no number, and is left out."""
    return _rounded(logs.boots(X.log_lines(spark, sf_dir), 10.0), "t_s").select("stage", "t_s", "cold_start_ms")


@query("SELECT 's' || event_id % 9 AS stage, CAST(event_id % 70 AS DOUBLE) AS queue_up, 0e0 AS queue_down, CAST(1 AS BIGINT) AS min_rep, CAST(8 AS BIGINT) AS max_rep FROM events WHERE event_type = 'view'")
def log_scaling_params(spark, sf_dir):
    return logs.scaling_params(X.log_lines(spark, sf_dir))


@query("SELECT round(event_id * 5e-2, 6) AS ts, event_id * 2 AS sent FROM events WHERE event_type NOT IN ('click', 'view')")
def log_load_progress(spark, sf_dir):
    return logs.load_progress(X.log_lines(spark, sf_dir)).select(F.round("ts", 6).alias("ts"), "sent")


@query("WITH a AS (SELECT row_number() OVER (ORDER BY event_id) AS rn, value AS cpu FROM events WHERE event_type = 'view'), b AS (SELECT row_number() OVER (ORDER BY event_id) AS rn, CAST(event_id AS DOUBLE) AS rss FROM events WHERE event_type <> 'view') SELECT rn, cpu, rss FROM a FULL JOIN b USING (rn)")
def join_full_outer_positional(spark, sf_dir):
    """Every row is on a side: views, and all others."""
    e = X.events(spark, sf_dir)
    a = e.where("event_type = 'view'").select("event_id", F.col("value").alias("cpu"))
    b = e.where("event_type <> 'view'").select("event_id", F.col("event_id").cast("double").alias("rss"))
    return ana.zip_positions(a, b, ["event_id"], ["event_id"], ("cpu", "rss"))


@query("SELECT a.range AS n, b.range AS d, 16 - a.range - b.range AS f, u.range * 50 AS queue_up FROM range(2, 9) a, range(2, 9) b, range(1, 4) u WHERE 16 - a.range - b.range BETWEEN 2 AND 8")
def cross_grid_enum(spark, sf_dir):
    knobs = spark.range(1, 4).select((F.col("id") * 50).alias("queue_up"))
    return ana.grid_splits(spark, 16, 2, 8).crossJoin(F.broadcast(knobs))


@query(f"WITH {X.COLD}, r AS (SELECT *, row_number() OVER (PARTITION BY mode, stage ORDER BY ord) = 1 AS first FROM cold) SELECT mode, round(quantile_cont(cold_start_ms, 0.5) FILTER (first) / quantile_cont(cold_start_ms, 0.5) FILTER (NOT first), 6) AS ratio FROM r GROUP BY mode")
def agg_median_ratio(spark, sf_dir):
    marked = ana.first_and_rest(X.cold_starts(spark, sf_dir), ["mode", "stage"], ["ord"])
    return _rounded(ana.pivot_ratio(marked, "mode", "spawn_kind", "cold_start_ms", ("warm", "first")), "ratio").select("mode", "ratio")


@query("WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events) SELECT range AS bin, round(lo + range * ((hi - lo) / 50), 6) AS low, round(lo + (range + 1) * ((hi - lo) / 50), 6) AS high, count(value) AS count FROM range(50) CROSS JOIN e LEFT JOIN events ON least(CAST(floor((value - lo) / ((hi - lo) / 50)) AS BIGINT), 49) = range GROUP BY range, lo, hi")
def ana_hist_equal_width(spark, sf_dir):
    return _rounded(ana.equal_bins(X.events(spark, sf_dir).select("value"), "value", 50), "low", "high")


@query(
    f"WITH {ROWS}, e AS (SELECT min(value) AS lo, max(value) AS hi FROM rows_), b AS (SELECT stage, least(CAST(floor((value - lo) * 512 / (hi - lo)) AS BIGINT), 511) AS b, avg(value) AS m, count(*) AS n FROM rows_, e GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY stage) AS total FROM b) "
    "SELECT stage, CAST(range AS DOUBLE) * 2 AS x, round(sum(n / total * exp(-power((range * 2 - m) / 5e0, 2) / 2)) / (5e0 * sqrt(2 * pi())), 9) AS density FROM t, range(100) GROUP BY 1, 2"
)
def ana_density(spark, sf_dir):
    grid_points = spark.range(100).select((F.col("id").cast("double") * 2).alias("x"))
    out = ana.density(_rows(spark, sf_dir), "stage", "value", grid_points, 5.0)
    return out.withColumn("density", F.round("density", 9))
