"""Queries over run telemetry, flow control and scaling, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from streamstage.operators import flow, ranking, resources
from streamstage.operators import telemetry as tel
from streamstage.plans import fixtures as X
from streamstage.plans.dataflow import query
from streamstage.sources import sinks

_P = {"p50": 0.5, "p95": 0.95, "p99": 0.99, "p999": 0.999}


def _picks(value: str, points: dict[str, float], digits: int) -> str:
    return ", ".join(f"round(max(CASE WHEN rn = least(CAST(floor(n * {p:e}) AS BIGINT), n - 1) + 1 THEN {value} END), {digits}) AS {name}" for name, p in points.items())


def block_sql(ctes: str, rows: str, value: str, group: str = "", points: dict[str, float] | None = None, digits: int = 5, more: str = "") -> str:
    """count, quantiles, max and mean of ``value`` of ``rows`` per ``group`` in DuckDB's SQL."""
    over = f"PARTITION BY {group} ORDER BY {value}" if group else f"ORDER BY {value}"
    part = f"PARTITION BY {group}" if group else ""
    head = f"{group}, " if group else ""
    return (
        f"WITH {ctes}, src AS ({rows}), rk AS (SELECT *, row_number() OVER ({over}) AS rn, count(*) OVER ({part}) AS n FROM src) "
        f"SELECT {head}count(*) AS count, {_picks(value, points or _P, digits)}, round(max({value}), {digits}) AS max, round(avg({value}), {digits}) AS mean{more} FROM rk" + (f" GROUP BY {group}" if group else "")
    )


_E2E = "SELECT seq, recv_ts, bench_ts, (recv_ts - bench_ts) * 1000 AS e2e_ms FROM log WHERE recv_ts > bench_ts"
_RES = "SELECT seq, stage, (exit_ts - enter_ts) * 1000 AS residence_ms FROM hop"
_GAP = "SELECT seq, recv_ts, f AS from_stage, t AS to_stage, (b - a) * 1000 AS gap_ms FROM (SELECT seq, recv_ts, stage AS f, exit_ts AS a, lead(stage) OVER w AS t, lead(enter_ts) OVER w AS b FROM hop WINDOW w AS (PARTITION BY seq ORDER BY s)) WHERE b >= a"
_IN = "SELECT seq, (enter_ts - bench_ts) * 1000 AS ingress_ms FROM hop WHERE s = 0 AND enter_ts >= bench_ts"


@query(f"WITH {X.LOG} SELECT seq, round(e2e_ms, 5) AS e2e_ms FROM ({_E2E})")
def tel_e2e(spark, sf_dir):
    return tel.received(X.hop_log(spark, sf_dir)).select("seq", F.round("e2e_ms", 5).alias("e2e_ms"))


@query(block_sql(X.HOPS, _RES, "residence_ms", "stage"))
def tel_per_stage_latency(spark, sf_dir):
    return tel.quantile_block(tel.hop_rows(X.hop_log(spark, sf_dir)), "residence_ms", ["stage"])


@query(block_sql(X.HOPS, _GAP, "gap_ms", "from_stage, to_stage", digits=6))
def tel_inter_stage(spark, sf_dir):
    return tel.quantile_block(tel.gap_rows(X.hop_log(spark, sf_dir)), "gap_ms", ["from_stage", "to_stage"], digits=6)


@query(block_sql(X.HOPS, _IN, "ingress_ms", digits=6))
def tel_ingress_wait(spark, sf_dir):
    return tel.quantile_block(tel.ingress_rows(X.hop_log(spark, sf_dir)), "ingress_ms", digits=6)


@query(f"WITH rk AS (SELECT event_type AS stage, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT stage, {_picks('value', {'p10': 0.1, 'p50': 0.5, 'p90': 0.9, 'p99': 0.99}, 6)} FROM rk GROUP BY stage")
def tel_quantiles_nearest_rank(spark, sf_dir):
    rows = X.events(spark, sf_dir).select(F.col("event_type").alias("stage"), "value")
    return ranking.nearest_rank(rows, "value", {"p10": 0.1, "p50": 0.5, "p90": 0.9, "p99": 0.99}, ["stage"], 6)


@query(
    "WITH rk AS (SELECT value, row_number() OVER (ORDER BY value) AS rn, count(*) OVER () AS n FROM events), e AS (SELECT least(greatest(max(CASE WHEN rn = least(CAST(floor(n * 99e-2) AS BIGINT), n - 1) + 1 THEN value END) * 3, 1e0), max(value)) / 50 AS bw FROM rk) "
    "SELECT i AS bin, round((i + 5e-1) * bw, 6) AS center, count(value) AS count FROM range(50) t(i) CROSS JOIN e LEFT JOIN events ON CAST(floor(value / bw) AS BIGINT) = i GROUP BY i, bw"
)
def tel_histogram50(spark, sf_dir):
    return tel.histogram(X.events(spark, sf_dir).select("value"), "value").withColumn("center", F.round("center", 6))


@query("WITH rk AS (SELECT value, row_number() OVER (ORDER BY value, event_id) AS rn, count(*) OVER () AS n FROM events) SELECT rn - 1 AS i, value AS x, round(CAST(rn AS DOUBLE) / n * 100, 2) AS y FROM rk WHERE (rn - 1) % greatest(n // 200, 1) = 0")
def tel_cdf200(spark, sf_dir):
    return tel.cdf(X.events(spark, sf_dir).select("value", "event_id"), "value", ["value", "event_id"])


@query(f"WITH {X.LOG} SELECT CAST(floor(recv_ts) - (SELECT floor(min(recv_ts)) FROM log) AS BIGINT) AS second, count(*) AS count FROM log GROUP BY 1")
def tel_recv_per_second(spark, sf_dir):
    return tel.per_second(X.hop_log(spark, sf_dir))


_SPAN = "span AS (SELECT min(recv_ts) AS t0, max(recv_ts) - min(recv_ts) AS d, least(5e0, (max(recv_ts) - min(recv_ts)) * 1e-1) AS trim_ FROM log)"
_RATES = f"rates AS (SELECT count(*) AS received, max(d) AS duration_s, CASE WHEN max(d) > 0 THEN count(*) / max(d) ELSE 0e0 END AS sustained_eps, max(trim_) AS trim_s, count(*) FILTER (floor(recv_ts) >= floor(t0 + trim_)) / greatest(max(d) - max(trim_), 1e-3) AS warm_eps FROM log, span)"


@query(f"WITH {X.LOG}, {_SPAN}, {_RATES} SELECT received, round(duration_s, 6) AS duration_s, round(sustained_eps, 6) AS sustained_eps, round(trim_s, 6) AS trim_s, round(warm_eps, 6) AS warm_eps FROM rates")
def tel_throughput(spark, sf_dir):
    out = tel.throughput(X.hop_log(spark, sf_dir))
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c != "received"})


@query(f"WITH {X.HOPS}, {X.LOG}, {_SPAN} SELECT stage, round(count(*) / max(d), 6) AS eps FROM hop, span GROUP BY stage")
def tel_stage_rates(spark, sf_dir):
    return tel.stage_rates(X.hop_log(spark, sf_dir)).select("stage", F.round("eps", 6).alias("eps"))


@query(f"WITH {X.HOPS} SELECT stage, count(*) AS count FROM hop GROUP BY stage UNION ALL SELECT 'total', count(*) FROM events")
def tel_counters(spark, sf_dir):
    return tel.counters(X.hop_log(spark, sf_dir))


def _timing(name: str, us: str, when: str, points: tuple[str, ...]) -> str:
    picks = ", ".join(f"max(CASE WHEN rn = least(CAST(floor(n * {_P[p]:e}) AS BIGINT), n - 1) + 1 THEN us END) AS {p}" for p in points)
    return f"{name} AS (SELECT stage, count(*) AS n, {picks}, max(us) AS max, avg(us) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY us) AS rn, count(*) OVER (PARTITION BY stage) AS n FROM (SELECT event_type AS stage, {us} AS us FROM events WHERE {when})) GROUP BY stage)"


_SHOWN = [(x, c) for x in ("total", "serde", "guest") for c in (*_P, "max", "mean") if (x, c) != ("serde", "p999")]
_TIMING = ", ".join(_timing(name, us, when, tuple(p for p in _P if (name, p) != ("serde", "p999"))) for name, us, when in (("total", "CAST(floor(value * 10) AS BIGINT)", "event_type <> 'view'"), ("serde", "CAST(floor(value) AS BIGINT)", "event_type <> 'click'"), ("guest", "CAST(round(value / 400 * 1000) AS BIGINT)", "true")))


@query(
    f"WITH {_TIMING}, j AS (SELECT stage, greatest(coalesce(total.n, 0), coalesce(serde.n, 0), coalesce(guest.n, 0)) AS n, {', '.join(f'CAST(coalesce({x}.{c}, 0) AS DOUBLE) AS {x}_{c}' for x, c in _SHOWN)} FROM total FULL JOIN serde USING (stage) FULL JOIN guest USING (stage)) "
    f"SELECT stage, n, {', '.join(f'round({x}_{c}, 6) AS {x}_{c}' for x, c in _SHOWN)}, {', '.join(f'round(greatest(total_{c} - guest_{c}, 0e0), 6) AS overhead_{c}' for c in ('p50', 'p99', 'mean'))}, CASE WHEN total_p50 > 0 THEN round(serde_p50 / total_p50, 3) ELSE 0e0 END AS serde_fraction FROM j"
)
def tel_worker_timing(spark, sf_dir):
    """Stages without samples of one kind have 0 there: views of the whole iteration, clicks of encoding."""
    e = X.events(spark, sf_dir).select(F.col("event_type").alias("stage"), "value")
    whole = lambda df, k: df.select("stage", F.floor(F.col("value") * k).cast("long").alias("us"))
    out = tel.worker_timing(whole(e.where("stage <> 'view'"), 10), whole(e.where("stage <> 'click'"), 1), e.select("stage", tel.whole_us(F.col("value") / 400).alias("us")))
    return out.select("stage", "n", *[F.round(c, 6).alias(c) for c in out.columns[2:]])


@query("WITH rk AS (SELECT event_type AS stage, CAST(floor(value * 10) AS BIGINT) AS us, row_number() OVER (PARTITION BY event_type ORDER BY floor(value * 10)) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT stage, us FROM rk WHERE (rn - 1) % CASE WHEN n <= 100 THEN 1 ELSE (n + 99) // 100 END = 0")
def tel_timing_samples(spark, sf_dir):
    return tel.timing_samples(X.events(spark, sf_dir).select(F.col("event_type").alias("stage"), F.floor(F.col("value") * 10).cast("long").alias("us")), 100)


@query("WITH rk AS (SELECT event_id AS seq, value, row_number() OVER (ORDER BY event_id) AS rn, count(*) OVER () AS n FROM events) SELECT seq, value FROM rk WHERE (rn - 1) % CAST(greatest(ceil(n / 300e0), 1) AS BIGINT) = 0")
def sample_every_kth(spark, sf_dir):
    rows = X.events(spark, sf_dir).select(F.col("event_id").alias("seq"), "value")
    return ranking.every_kth(rows, ["seq"], 300).select("seq", "value")


@query("SELECT event_id AS seq, value FROM events ORDER BY event_id DESC LIMIT 2000")
def sample_last_n(spark, sf_dir):
    return ranking.last_n(X.events(spark, sf_dir).select(F.col("event_id").alias("seq"), "value"), "seq", 2000)


@query(f"WITH {X.SCALING} SELECT stage, count(*) FILTER (action IN ('spawn', 'cold_start')) AS ups, count(*) FILTER (action = 'drain') AS downs, count(*) FILTER (action = 'cold_start') AS colds, max(new_count) AS peak, round(arg_min(cold_start_ms, t_s) FILTER (cold_start_ms IS NOT NULL), 6) AS first_cold_ms, count(cold_start_ms) AS timed, round(sum(cold_start_ms * place), 4) AS in_order FROM (SELECT *, count(cold_start_ms) OVER (PARTITION BY stage ORDER BY t_s) AS place FROM scaling) GROUP BY stage")
def tel_scaling_block(spark, sf_dir):
    out = tel.scaling_block(X.scaling_log(spark, sf_dir))
    return out.select("stage", "ups", "downs", "colds", "peak", F.round(F.try_element_at("cold_start_ms", F.lit(1)), 6).alias("first_cold_ms"), F.size("cold_start_ms").cast("long").alias("timed"), F.expr("round(aggregate(transform(cold_start_ms, (x, i) -> x * (i + 1)), 0D, (a, x) -> a + x), 4)").alias("in_order"))


@query(f"WITH {X.QUEUE} SELECT stage, round(tick * 1e-3, 3) AS t_s, qd AS depth FROM trace")
def tel_queue_depth(spark, sf_dir):
    return flow.queue_series(X.queue_trace(spark, sf_dir))


@query("SELECT max(value) AS peak_cpu, CAST(max(event_id) AS DOUBLE) AS peak_rss, count(*) AS samples FROM events")
def tel_peak_resources(spark, sf_dir):
    return resources.peaks(X.resource_samples(spark, sf_dir))


@query(
    f"WITH {X.LOG}, {_SPAN}, {_RATES}, rk AS (SELECT (recv_ts - bench_ts) * 1000 AS e, row_number() OVER (ORDER BY recv_ts - bench_ts) AS rn, count(*) OVER () AS n FROM log WHERE recv_ts > bench_ts), "
    "q AS (SELECT round(max(CASE WHEN rn = least(CAST(floor(n * 5e-1) AS BIGINT), n - 1) + 1 THEN e END), 5) AS p50, round(max(CASE WHEN rn = least(CAST(floor(n * 99e-2) AS BIGINT), n - 1) + 1 THEN e END), 5) AS p99, round(max(e), 5) AS worst FROM rk), k AS (SELECT max(value) AS cpu, CAST(max(event_id) AS DOUBLE) AS rss FROM events) "
    "SELECT unnest([printf('events      %d in %.3f s', received, duration_s), printf('sustained   %.1f events/s', sustained_eps), printf('latency ms  p50 %.3f  p99 %.3f  max %.3f', p50, p99, worst), printf('peaks       cpu %.1f %%  memory %.1f MB', cpu, rss)]) AS line FROM rates, q, k"
)
def tel_run_card(spark, sf_dir):
    return sinks.run_card(X.hop_log(spark, sf_dir), X.resource_samples(spark, sf_dir))


@query(f"WITH {X.SCALING} SELECT e.ord, e.stage, s.value FROM (SELECT * FROM scaling WHERE action = 'cold_start') e ASOF LEFT JOIN (SELECT stage, t_s, ord * 1e0 AS value FROM scaling WHERE action = 'spawn') s ON e.stage = s.stage AND e.t_s <= s.t_s")
def asof_forward_fill(spark, sf_dir):
    log = X.scaling_log(spark, sf_dir)
    samples = log.where("action = 'spawn'").select("stage", "t_s", F.col("ord").cast("double").alias("value"))
    filled = tel.forward_fill(log.where("action = 'cold_start'").select("stage", "t_s"), samples)
    return filled.select(F.round(F.col("t_s") / 5e-2).cast("long").alias("ord"), "stage", "value")


@query(block_sql(X.LOG, _E2E, "e2e_ms", points={"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p999": 0.999}, more=", round(min(e2e_ms), 5) AS min"))
def tel_e2e_summary(spark, sf_dir):
    points = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p999": 0.999}
    return tel.quantile_block(tel.received(X.hop_log(spark, sf_dir)), "e2e_ms", points=points, more={"min": F.round(F.min("e2e_ms"), 5)})


@query(
    f"WITH {X.HOPS}, {X.LOG}, r AS (SELECT seq, recv_ts, (recv_ts - bench_ts) * 1000 AS e, row_number() OVER (ORDER BY recv_ts, seq) AS rn, count(*) OVER () AS n FROM log WHERE recv_ts > bench_ts), "
    "k AS (SELECT * FROM r WHERE (rn - 1) % CAST(greatest(ceil(n / 500e0), 1) AS BIGINT) = 0), h AS (SELECT seq, string_agg(printf('[\"%s\",%.6f,%.6f]', stage, enter_ts, exit_ts), ',' ORDER BY s) AS hops FROM hop GROUP BY seq) "
    "SELECT seq, printf('[%.6f,%.4f,[%s]]', recv_ts, e, hops) AS row FROM k JOIN h USING (seq)"
)
def tel_event_rows(spark, sf_dir):
    return tel.event_rows(X.hop_log(spark, sf_dir), 500)


def _one(rows: str, value: str, p: str, where: str = "true") -> str:
    """SQL for one nearest-rank quantile as a scalar."""
    return f"(SELECT round(max(CASE WHEN rn = least(CAST(floor(n * {_P[p]:e}) AS BIGINT), n - 1) + 1 THEN {value} END), 5) FROM (SELECT *, row_number() OVER (ORDER BY {value}) AS rn, count(*) OVER () AS n FROM ({rows}) WHERE {where}))"


@query(
    f"WITH {X.HOPS}, {X.LOG}, {_SPAN}, {_RATES} SELECT received, round(warm_eps, 6) AS warm_eps, {_one(_E2E, 'e2e_ms', 'p50')} AS e2e_p50, {_one(_E2E, 'e2e_ms', 'p999')} AS e2e_p999, {_one(_RES, 'residence_ms', 'p99', chr(39) + 'detect' + chr(39) + ' = stage')} AS detect_p99, "
    f"{_one(_GAP, 'gap_ms', 'p95', chr(39) + 'detect' + chr(39) + ' = from_stage')} AS gap_p95, {_one(_IN, 'ingress_ms', 'p99')} AS ingress_p99, (SELECT count(*) FROM hop WHERE stage = 'finalize') AS finalized, round((SELECT count(*) FROM hop WHERE stage = 'finalize') / duration_s, 6) AS finalize_eps, CAST(3 AS BIGINT) AS stages, CAST(2 AS BIGINT) AS edges, CAST(4 AS BIGINT) AS counted FROM rates"
)
def tel_run_summary(spark, sf_dir):
    """Figures from all blocks of a run's summary."""
    named = lambda block, field, name, value: F.expr(f"element_at(filter({block}, x -> x.{field} = '{name}'), 1).{value}")
    return tel.run_summary(X.hop_log(spark, sf_dir)).select(
        "throughput.received", F.round("throughput.warm_eps", 6).alias("warm_eps"), F.col("latency_ms.p50").alias("e2e_p50"), F.col("latency_ms.p999").alias("e2e_p999"), named("per_stage", "stage", "detect", "p99").alias("detect_p99"),
        named("inter_stage", "from_stage", "detect", "p95").alias("gap_p95"), F.col("ingress_wait.p99").alias("ingress_p99"), named("counters", "stage", "finalize", "count").alias("finalized"), F.round(named("stage_rates", "stage", "finalize", "eps"), 6).alias("finalize_eps"),
        *[F.size(c).cast("long").alias(n) for c, n in (("per_stage", "stages"), ("inter_stage", "edges"), ("counters", "counted"))],
    )


# Flow control.

_TURNS = "trace AS (SELECT event_type AS stage, event_id AS tick, CAST(floor(value) AS BIGINT) AS qd FROM events), t AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY tick) AS i FROM trace)"


@query(
    f"WITH RECURSIVE {_TURNS}, x AS MATERIALIZED (SELECT stage, i, qd % 7 AS arrivals, tick % 5 AS credits, CASE WHEN tick % 11 = 0 THEN 3 ELSE 0 END AS lost FROM t), "
    "f AS (SELECT DISTINCT stage, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS sent, CAST(0 AS BIGINT) AS q, CAST(0 AS BIGINT) AS w, CAST(0 AS BIGINT) AS c, CAST(0 AS BIGINT) AS gone, CAST(0 AS BIGINT) AS top FROM t UNION ALL "
    "SELECT stage, i, sent + b, q - b, w, c - b, gone, top FROM (SELECT *, least(q, c, 4) AS b FROM (SELECT stage, i, sent, q + taken AS q, w - taken AS w, c, gone, greatest(top, q + taken) AS top FROM (SELECT *, least(w, greatest(200 - q, 0)) AS taken FROM ("
    "SELECT stage, i, sent, q, w + arrivals AS w, c + credits - least(c + credits, lost) AS c, gone + least(c + credits, lost) AS gone, top FROM (SELECT x.*, sent + least(q, c, 4) AS sent, q - least(q, c, 4) AS q, w, c - least(q, c, 4) AS c, gone, top FROM f JOIN x ON x.stage = f.stage AND x.i = f.i + 1)))))) "
    "SELECT stage, arg_max(sent, i) AS dispatched, arg_max(q, i) AS queued, arg_max(w, i) AS waiting, arg_max(c, i) AS idle_credits, arg_max(gone, i) AS purged, arg_max(top, i) AS most_queued FROM f GROUP BY stage"
)
def flow_dispatch_fold(spark, sf_dir):
    trace = X.queue_trace(spark, sf_dir).select("stage", "tick", (F.col("qd") % 7).alias("arrivals"), (F.col("tick") % 5).alias("credits"), F.when(F.col("tick") % 11 == 0, 3).otherwise(0).alias("lost"))
    return flow.dispatch(trace, buffer=200, batch=4)


@query("SELECT event_id AS seq, CASE event_id % 4 WHEN 0 THEN 16 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS grant, greatest((1 + event_id % 32) // 2, 1) AS refill FROM events")
def flow_credit_grants(spark, sf_dir):
    i = F.col("event_id") % 4
    message = F.when(i == 0, '{"_ctrl": "hello", "n_credits": 16}').when(i == 1, "").when(i == 2, '{"_ctrl": "refill"}').otherwise(F.replace(F.col("props"), F.lit('"k"'), F.lit('"n_credits"')))
    return X.events(spark, sf_dir).select(F.col("event_id").alias("seq"), flow.credit_grant(message).alias("grant"), flow.refill_threshold(1 + F.col("event_id") % 32).alias("refill"))


@query("SELECT event_id AS seq, round(1e6 / (1.1e2 / (1 + event_id % 32) + (1 + event_id % 40)), 6) AS eps FROM events")
def flow_capacity_model(spark, sf_dir):
    i = F.col("event_id")
    return X.events(spark, sf_dir).select(i.alias("seq"), F.round(flow.capacity_eps(F.lit(110.0), 1 + i % 32, 1 + i % 40), 6).alias("eps"))


_VOTED = "CASE WHEN n > 5 THEN 1 WHEN n = 0 AND qd > 0 THEN 2 WHEN up >= 3 AND since + 1 >= 3 AND n < 5 THEN 4 WHEN down >= 4 AND n > 0 THEN 5 ELSE 0 END"


@query(
    f"WITH RECURSIVE {_TURNS}, f AS (SELECT DISTINCT stage, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS up, CAST(0 AS BIGINT) AS down, CAST(0 AS BIGINT) AS since, CAST(0 AS BIGINT) AS ups, CAST(0 AS BIGINT) AS downs, CAST(0 AS BIGINT) AS colds, CAST(0 AS BIGINT) AS breaches FROM t UNION ALL "
    "SELECT stage, i, CASE r WHEN 2 THEN n + 1 WHEN 4 THEN n + 1 WHEN 5 THEN n - 1 ELSE n END, CASE WHEN r IN (2, 4) THEN 0 ELSE up END, CASE r WHEN 5 THEN 0 ELSE down END, CASE WHEN r IN (2, 4) THEN 0 ELSE since + 1 END, "
    "CASE WHEN r IN (2, 4) THEN ups + 1 ELSE ups END, CASE r WHEN 5 THEN downs + 1 ELSE downs END, CASE r WHEN 2 THEN colds + 1 ELSE colds END, CASE WHEN r IN (0, 5) AND qd > 50 AND n >= 5 AND up IN (0, 2) THEN breaches + 1 ELSE breaches END "
    f"FROM (SELECT *, {_VOTED} AS r FROM (SELECT t.stage, t.i, t.qd, n, CASE WHEN qd > 50 THEN up + 1 WHEN qd <= 15 THEN 0 ELSE greatest(up - 1, 0) END AS up, CASE WHEN qd > 50 THEN 0 WHEN qd <= 15 THEN down + 1 ELSE greatest(down - 1, 0) END AS down, since, ups, downs, colds, breaches FROM f JOIN t ON t.stage = f.stage AND t.i = f.i + 1))) "
    "SELECT stage, arg_max(n, i) AS replicas, arg_max(ups, i) AS ups, arg_max(downs, i) AS downs, arg_max(colds, i) AS cold_starts, arg_max(breaches, i) AS breaches FROM f GROUP BY stage"
)
def flow_autoscaler_votes(spark, sf_dir):
    return flow.autoscale(X.queue_trace(spark, sf_dir), queue_up=50, queue_down=15, up_ticks=3, down_ticks=4, least=0, most=5)
