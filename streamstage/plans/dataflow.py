"""Queries over sources, stages, codecs and keyed state, with their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from streamstage.functions import codec, scalar
from streamstage.operators import logs, signal, stages
from streamstage.operators.telemetry import hop_rows, received, without_end_marks
from streamstage.plans import fixtures as X
from streamstage.plans.engine import compile_pipeline, run_batch
from streamstage.sources import files, sinks
from streamstage.sources.generator import sensor_readings
from streamstage.sources.profiles import Profile, profile_rates, round_robin, token_bucket
from streamstage.spec import Node, PipelineSpec, Scaling, Stage
from streamstage.storage import checkpoint_dir
from streamstage.types import Record

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


#: Added before rounding where sums of decimals often end half-way between two rounded values, so that both engines,
#: which add in another order, round alike.
NUDGE = "3.3717e-8"


def near(name: str):
    return F.round(F.col(name) + float(NUDGE), 6).alias(name)


READING_T = Record.of("reading", {"sensor_id": "string", "value": "f64", "unit": "string?"})
ENRICHED_T = Record.of("enriched", {"sensor_id": "string", "value": "f64", "anomaly": "bool?", "severity": "string?"})
SAMPLE_T = Record.of("sensor-sample", {"sensor_id": "string", "ts_ns": "u64", "value": "f64"})
FILTERED_T = Record.of("filtered", {"sensor_id": "string", "ts_ns": "u64", "value": "f64", "raw": "f64", "clamped": "bool"})
_FEATURES = dict.fromkeys(["rms", "centroid", "flatness", "kurtosis"], "f64")
FEATURED_T = Record.of("featured", {"sensor_id": "string", "ts_ns": "u64", "value": "f64"} | _FEATURES | {"window_full": "bool"})
SIGNED_T = Record.of("signed", {"sensor_id": "string", "ts_ns": "u64"} | _FEATURES | {"content_hash": "string", "hmac": "string"})


def _spec(records: list[Record], line: list[tuple[str, str, str]]) -> PipelineSpec:
    made = tuple(Stage(n, i, o, n, None, Scaling(), "local", {}) for n, i, o in line)
    edges = tuple((a.name, b.name) for a, b in zip(made, made[1:], strict=False))
    return PipelineSpec("streamstage:queries@0.1.0", (Node("local"),), "local", made, edges, "memory", "memory", 9000, "localhost", {r.name: r for r in records}, None, 0, 1)


THREE = _spec([READING_T, ENRICHED_T], [("normalize", "reading", "reading"), ("detect", "reading", "enriched"), ("finalize", "enriched", "enriched")])
COMPLEX = _spec([SAMPLE_T, FILTERED_T, FEATURED_T, SIGNED_T], [("denoise", "sensor-sample", "filtered"), ("featurize", "filtered", "featured"), ("attest", "featured", "signed")])


# Sources.


@query()
def src_sensor_gen(spark, sf_dir):
    return sensor_readings(spark, 10_000, 100, seed=7)


@query("SELECT range AS seq, range % 7 AS sensor FROM range(10000)")
def src_round_robin(spark, sf_dir):
    return round_robin(spark, 10_000, 7)


@query("SELECT range AS t, CASE WHEN range >= 30 THEN 1000 ELSE CAST(floor(1e2 + 9e2 * range / 3e1) AS BIGINT) END AS rate FROM range(120)")
def src_profile_ramp(spark, sf_dir):
    return profile_rates(spark, Profile("ramp", rate=1000, ramp_start=100, ramp_time=30), 120)


@query("SELECT range AS t, CAST(CASE WHEN range % 10 < 2 THEN 1000 ELSE 100 END AS BIGINT) AS rate FROM range(120)")
def src_profile_burst(spark, sf_dir):
    return profile_rates(spark, Profile("burst", rate=1000, burst_base_rate=100, burst_interval=10, burst_duration=2), 120)


@query("SELECT range AS t, CAST(floor(2e2 + 8e2 * ((sin(2e0 * pi() * range / 6e1) + 1e0) / 2e0)) AS BIGINT) AS rate FROM range(120)")
def src_profile_wave(spark, sf_dir):
    return profile_rates(spark, Profile("wave", rate=1000, wave_min=200, wave_period=60), 120)


@query("SELECT range AS t, CAST(500 AS BIGINT) AS rate FROM range(120)")
def src_profile_steady(spark, sf_dir):
    return profile_rates(spark, Profile("steady", rate=500), 120)


@query(
    "WITH RECURSIVE r AS MATERIALIZED (SELECT range AS tick, CAST(floor(2e2 + 8e2 * ((sin(2e0 * pi() * range / 6e1) + 1e0) / 2e0)) AS DOUBLE) AS target FROM range(120)), "
    "f AS (SELECT CAST(-1 AS BIGINT) AS tick, 0e0 AS tokens, CAST(0 AS BIGINT) AS out UNION ALL SELECT r.tick, h - floor(h), CAST(floor(h) AS BIGINT) FROM (SELECT r.tick, least(f.tokens + target * 25e-2, target) AS h FROM f JOIN r ON r.tick = f.tick + 1) r) "
    "SELECT 'wave' AS run, tick, least(out, 150) AS emitted, out - least(out, 150) AS dropped FROM f WHERE tick >= 0"
)
def src_token_bucket(spark, sf_dir):
    rates = profile_rates(spark, Profile("wave", rate=1000, wave_min=200, wave_period=60), 120)
    return token_bucket(rates.select(F.lit("wave").alias("run"), F.col("t").alias("tick"), F.col("rate").cast("double").alias("target"), F.lit(0.25).alias("dt"), F.lit(150).alias("room")))


@query("SELECT printf('sensor-%04d', range % 16) AS sensor_id, count(*) AS n FROM range(5000) GROUP BY 1")
def src_bounded(spark, sf_dir):
    return sensor_readings(spark, 5000, 16).groupBy("sensor_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "SELECT range AS seq, printf('sensor-%04d', range % 16) AS sensor_id, ['temperature', 'vibration', 'pressure', 'humidity', 'current'][range % 16 % 5 + 1] AS sensor_type, ['zone-A', 'zone-B', 'zone-C', 'zone-D'][range % 16 % 4 + 1] AS location, "
    "['°C', 'mm/s', 'kPa', '%', 'A'][range % 16 % 5 + 1] AS unit, round(range / 5e2, 6) AS at FROM range(5000)"
)
def src_sensor_columns(spark, sf_dir):
    """All of a reading that isn't drawn."""
    return sensor_readings(spark, 5000, 16).select(F.col("bench_seq").alias("seq"), "sensor_id", "sensor_type", "location", "unit", F.round("bench_ts", 6).alias("at"))


@query("SELECT event_id AS seq, value FROM events WHERE event_id % 100 <> 99")
def src_eos_filter(spark, sf_dir):
    marked = X.events(spark, sf_dir).select(F.col("event_id").alias("seq"), "value", F.when(F.col("event_id") % 100 == 99, True).alias("eos"))
    return without_end_marks(marked).select("seq", "value")


@query("SELECT event_id AS seq, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 10 <> 0")
def scan_jsonl_tolerant(spark, sf_dir):
    lines = X.events(spark, sf_dir).select(F.col("event_id").alias("seq"), F.when(F.col("event_id") % 20 == 0, "").when(F.col("event_id") % 10 == 0, F.concat(F.lit("{bad"), "props")).otherwise(F.col("props")).alias("payload"))
    return codec.decode(lines, Record.of("line", {"k": "s64"}), keep=("seq",))


_PATHS = [("/runs/aot_60k_rate_iter3_cw16.json", "AOT", 60000, 3, 16), ("/runs/complex_cw8/jit_500eps_run_12.json", "JIT", 500, 12, 8), ("/runs/aot_iter1.json", "AOT", None, 1, None)]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{m}', CAST({r or -1} AS BIGINT), CAST({i} AS BIGINT), CAST({w or -1} AS BIGINT))" for p, m, r, i, w in _PATHS) + ") t(path, mode, rate, iteration, \"window\")")
def scan_filename_columns(spark, sf_dir):
    found = files.filename_columns(F.col("path"))
    return spark.createDataFrame([(p,) for p, *_ in _PATHS], "path string").select("path", found["mode"].alias("mode"), *[F.coalesce(found[c], F.lit(-1)).alias(c) for c in ("rate", "iteration", "window")])


def _folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("SELECT round(event_id * 5e-2, 4) AS ts, 'info' AS level, CASE event_type WHEN 'click' THEN CASE WHEN event_id % 2 = 0 THEN 'worker/a/b' ELSE 'worker/c' END WHEN 'view' THEN 'autoscaler/s' || event_id % 9 ELSE 'loadgen' END AS component, CASE event_type WHEN 'click' THEN 'worker booted' WHEN 'view' THEN 'autoscaler ready' ELSE 'progress' END AS msg, CAST(event_id * 2 AS VARCHAR) AS sent FROM events")
def scan_log(spark, sf_dir):
    """Log lines written, and read back."""
    path = _folder(spark, "log")
    sinks.append_log(X.log_lines(spark, sf_dir), path)
    return files.read_log(spark, path).select(F.round("ts", 4).alias("ts"), "level", "component", "msg", F.col("fields")["sent"].alias("sent"))


@query("SELECT event_id AS seq, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 10 <> 0")
def scan_jsonl(spark, sf_dir):
    """Files with blank and broken lines."""
    e, path = X.events(spark, sf_dir), _folder(spark, "jsonl")
    line = F.concat(F.lit('{"seq": '), F.col("event_id").cast("string"), F.lit(", "), F.expr("substring(props, 2)"))
    e.select(F.when(F.col("event_id") % 20 == 0, "").when(F.col("event_id") % 10 == 0, F.concat(F.lit("{bad"), "props")).otherwise(line).alias("value")).write.text(path)
    return files.read_jsonl(spark, path, "seq bigint, k bigint")


@query("SELECT event_id AS seq, CASE event_type WHEN 'click' THEN 'AOT' WHEN 'view' THEN 'JIT' ELSE event_type END AS mode, value FROM events")
def scan_csv(spark, sf_dir):
    """A table written as CSV and read back with other names for two modes."""
    path = _folder(spark, "csv")
    sinks.write_csv(X.events(spark, sf_dir).select(F.col("event_id").alias("seq"), F.col("event_type").alias("mode"), "value"), path)
    return files.read_csv(spark, path, "seq bigint, mode string, value double", {"mode": {"click": "AOT", "view": "JIT"}})


@query("SELECT event_id AS seq, CASE WHEN event_id % 3 = 0 THEN event_id WHEN event_id % 3 = 1 THEN 60000 ELSE -1 END AS rate FROM events")
def scan_resolved(spark, sf_dir):
    """A rate by the first of a flag, the file's name and a setting that tells it."""
    i = F.col("event_id")
    told = X.events(spark, sf_dir).select(i.alias("seq"), F.when(i % 3 == 0, i).alias("flag"), F.when(i % 3 == 1, "/runs/aot_60k_rate.json").otherwise("/runs/aot.json").alias("path"))
    return told.select("seq", files.resolved(F.col("flag"), files.filename_columns(F.col("path"))["rate"], F.lit(-1).cast("long")).alias("rate"))


# Codec and stages.


@query("SELECT event_id AS seq, CASE WHEN event_id % 4 = 1 THEN 0 ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k, CASE WHEN event_id % 4 = 1 THEN 'text' ELSE '' END AS s, CASE WHEN event_id % 4 = 2 THEN 0e0 END AS opt FROM events WHERE event_id % 4 <> 3")
def codec_decode_defaults(spark, sf_dir):
    e, i = X.events(spark, sf_dir), F.col("event_id") % 4
    body = F.when(i == 1, '{"k": 2.5, "s": "text"}').when(i == 2, F.concat(F.lit('{"opt": "x", "s": 5, '), F.expr("substring(props, 2)"))).when(i == 3, "{broken").otherwise(F.col("props"))
    return codec.decode(e.select(F.col("event_id").alias("seq"), body.alias("payload")), Record.of("probe", {"k": "s64", "s": "string", "opt": "f64?"}), keep=("seq",))


@query(f"WITH {X.READING} SELECT seq, '{{\"sensor_id\":\"' || sensor_id || '\"' || CASE WHEN seq % 3 = 0 THEN '' ELSE ',\"value\":' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || '.0' END || CASE WHEN seq % 2 = 0 THEN ',\"unit\":\"mm/s\"' ELSE '' END || '}}' AS payload FROM reading")
def codec_encode_omit_null(spark, sf_dir):
    """Units of odd events are absent, values of every third aren't numbers; both are left out."""
    odd = X.reading(spark, sf_dir).withColumns({"value": F.when(F.col("seq") % 3 == 0, float("nan")).otherwise(F.floor("value").cast("double")), "unit": F.when(F.col("seq") % 2 == 0, "mm/s")})
    return odd.select("seq", codec.encode(READING_T))


@query(f"WITH {X.READING} SELECT seq, sensor_id, value FROM reading")
def stage_wire_projection(spark, sf_dir):
    return codec.wire(stages.detect(X.reading(spark, sf_dir)), READING_T, ENRICHED_T, ("seq",))


@query(f"WITH {X.HOPS} SELECT seq, 4 AS hops, 'archive' AS stage, round(recv_ts, 6) AS enter_ts, round(recv_ts + 1e-3, 6) AS exit_ts FROM hop WHERE s = 2")
def bench_hop_append(spark, sf_dir):
    log = X.hop_log(spark, sf_dir).withColumn("hops", codec.append_hop("hops", "archive", F.col("recv_ts"), F.col("recv_ts") + 1e-3))
    last = F.element_at("hops", -1)
    return log.select("seq", F.size("hops").alias("hops"), last["stage"].alias("stage"), F.round(last["enter_ts"], 6).alias("enter_ts"), F.round(last["exit_ts"], 6).alias("exit_ts"))


@query(f"WITH {X.READING} SELECT seq, sensor_id, value FROM reading")
def stage_identity(spark, sf_dir):
    return stages.identity(X.reading(spark, sf_dir)).select("seq", "sensor_id", "value")


_CLAMPED = "least(greatest(value, -50e0), 150e0)"
_SEVERITY = "CASE WHEN {v} > 85e0 THEN 'high' WHEN {v} > 75e0 THEN 'medium' ELSE 'normal' END"


@query(f"WITH {X.READING} SELECT seq, sensor_id, {_CLAMPED} AS value, coalesce(unit, 'celsius') AS unit FROM reading")
def stage_normalize(spark, sf_dir):
    return stages.normalize(X.reading(spark, sf_dir))


@query(f"WITH {X.READING} SELECT seq, sensor_id, value, value > 75e0 AS anomaly, {_SEVERITY.format(v='value')} AS severity FROM reading")
def stage_detect(spark, sf_dir):
    return stages.detect(X.reading(spark, sf_dir))


@query(f"WITH {X.READING} SELECT seq, sensor_id, CASE WHEN seq % 3 = 0 THEN 'unknown' ELSE 'high' END AS severity FROM reading")
def stage_finalize(spark, sf_dir):
    return stages.finalize(X.reading(spark, sf_dir).select("seq", "sensor_id", F.when(F.col("seq") % 3 != 0, "high").alias("severity")))


@query(f"WITH {X.READING} SELECT seq, sensor_id, {_CLAMPED} AS value, {_CLAMPED} > 75e0 AS anomaly, {_SEVERITY.format(v=_CLAMPED)} AS severity FROM reading")
def pipeline_three_stage(spark, sf_dir):
    return compile_pipeline(THREE, X.reading(spark, sf_dir))


@query(f"WITH {X.READING} SELECT seq, sensor_id, value AS value, value > 75e0 AS anomaly, {_SEVERITY.format(v='value')} AS severity FROM (SELECT seq, CASE WHEN seq % 5 = 1 THEN '' ELSE sensor_id END AS sensor_id, CASE WHEN seq % 5 = 2 THEN 0e0 ELSE least(CAST(floor(value) AS DOUBLE), 150e0) END AS value FROM reading WHERE seq % 5 <> 0)")
def pipeline_payloads(spark, sf_dir):
    """Raw JSON events through the stages: every fifth is broken, others lack the sensor or have text for the value."""
    i = F.col("event_id") % 5
    body = F.when(i == 0, "{bad").when(i == 1, F.format_string('{"value": %.1f}', F.floor("value").cast("double"))).when(i == 2, F.format_string('{"sensor_id": "%s", "value": "x"}', "event_type"))
    raw = X.events(spark, sf_dir).select(F.col("event_id").alias("seq"), F.coalesce(body, F.format_string('{"sensor_id": "%s", "value": %.1f, "unit": "C"}', "event_type", F.floor("value").cast("double"))).alias("payload"))
    return run_batch(THREE, raw)


@query(f"WITH {X.READING} SELECT seq, sensor_id, {_CLAMPED} AS value, CAST(NULL AS BOOLEAN) AS anomaly, 'unknown' AS severity FROM reading")
def pipeline_three_stage_wire(spark, sf_dir):
    return compile_pipeline(THREE, X.reading(spark, sf_dir), "wire")


def _featured(spark, sf_dir):
    """Featured events with whole-number features, so that both engines print them alike."""
    return X.sensor_sample(spark, sf_dir).select("seq", "sensor_id", "ts_ns", "value", *[F.floor(F.col("value") * k).cast("double").alias(c) for k, c in ((1, "rms"), (2, "centroid"), (3, "flatness"), (4, "kurtosis"))], F.lit(True).alias("window_full"))


_FORM = "'sensor_id=' || sensor_id || '|ts_ns=' || ts_ns || " + " || ".join(f"'|{c}=' || CAST(CAST(floor(value * {k}) AS BIGINT) AS VARCHAR) || '.000000000'" for k, c in ((1, "rms"), (2, "centroid"), (3, "flatness"), (4, "kurtosis")))


@query(f"WITH {X.SAMPLE} SELECT seq, {_FORM} AS form FROM sample")
def fn_canonicalize(spark, sf_dir):
    return _featured(spark, sf_dir).select("seq", scalar.canonical_form().alias("form"))


_PADS = [bytes(b ^ pad for b in stages.DEMO_KEY.ljust(64, b"\0")).hex() for pad in (0x36, 0x5C)]


@query(f"WITH {X.SAMPLE}, form AS (SELECT seq, {_FORM} AS f FROM sample) SELECT seq, sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || encode(f)))) AS hmac FROM form")
def fn_hmac_sha256(spark, sf_dir):
    return _featured(spark, sf_dir).select("seq", scalar.hmac_sha256(scalar.canonical_form(), stages.DEMO_KEY).alias("hmac"))


@query()
def fn_blake3(spark, sf_dir):
    return X.reading(spark, sf_dir).select("sensor_id").distinct().select("sensor_id", scalar.blake3(F.col("sensor_id")).alias("hash"))


@query()
def stage_attest(spark, sf_dir):
    return stages.attest(_featured(spark, sf_dir))


@query(f"WITH {X.READING} SELECT seq, round(value, 4) AS value FROM reading")
def fn_round4(spark, sf_dir):
    return X.reading(spark, sf_dir).select("seq", scalar.round_half_away(F.col("value"), 4).alias("value"))


@query(f"WITH {X.READING} SELECT seq, value, value > 150e0 AS filtered, CASE WHEN value > 150e0 THEN 'out of range' END AS reason FROM reading")
def stage_tombstone(spark, sf_dir):
    return stages.tombstone(X.reading(spark, sf_dir).select("seq", "value"), "value > 150D", "out of range")


# Filters.


@query("SELECT event_id AS seq FROM events WHERE event_id % 5 = 0")
def filter_malformed(spark, sf_dir):
    lines = X.events(spark, sf_dir).select(F.col("event_id").alias("seq"), F.when(F.col("event_id") % 5 == 0, "{bad").otherwise(F.col("props")).alias("payload"))
    return codec.malformed(lines).select("seq")


@query(f"WITH {X.LOG}, s AS (SELECT seq, bench_ts, CASE WHEN seq % 9 = 0 THEN bench_ts - 1 ELSE recv_ts END AS recv_ts FROM log) SELECT seq, round((recv_ts - bench_ts) * 1000, 5) AS e2e_ms FROM s WHERE recv_ts > bench_ts")
def filter_clock_skew(spark, sf_dir):
    skewed = X.hop_log(spark, sf_dir).withColumn("recv_ts", F.when(F.col("seq") % 9 == 0, F.col("bench_ts") - 1).otherwise(F.col("recv_ts")))
    return received(skewed).select("seq", F.round("e2e_ms", 5).alias("e2e_ms"))


@query(f"WITH {X.HOPS} SELECT seq, stage FROM hop WHERE NOT (seq % 4 = 0 AND s = 1)")
def hop_valid_filter(spark, sf_dir):
    broken = F.expr("transform(hops, (h, i) -> if(seq % 4 = 0 and i = 1, named_struct('stage', h.stage, 'enter_ts', h.enter_ts, 'exit_ts', h.enter_ts - 1), h))")
    return hop_rows(X.hop_log(spark, sf_dir).withColumn("hops", broken)).select("seq", "stage")


@query("SELECT event_id AS seq, CASE event_type WHEN 'click' THEN 'worker booted' ELSE 'autoscaler ready' END AS msg FROM events WHERE event_type IN ('click', 'view')")
def log_msg_filter(spark, sf_dir):
    return logs.messages(X.log_lines(spark, sf_dir), "worker booted", "autoscaler ready").select("seq", "msg")


@query("SELECT event_id AS seq, value FROM events WHERE user_id % 2 <> 1 AND event_id % 3 = 0")
def filter_success_rows(spark, sf_dir):
    """Every second user's rows are prewarming in the fixture, every third event succeeds."""
    told = X.events(spark, sf_dir).withColumns({"is_prewarm": (F.col("user_id") % 2).cast("string"), "success": F.when(F.col("event_id") % 3 == 0, "true").otherwise("no")})
    return logs.successes(told).select(F.col("event_id").alias("seq"), "value")


# Keyed state.

_W = "OVER (PARTITION BY sensor_id ORDER BY seq ROWS UNBOUNDED PRECEDING)"
_STATS = f"stats AS (SELECT *, avg(value) {_W} AS mean, greatest(coalesce(stddev_samp(value) {_W}, 1e0), 1e-9) AS std FROM sample)"
_CLAMP = f"{_STATS}, clamp AS (SELECT *, least(greatest(value, mean - 4 * std), mean + 4 * std) AS c FROM stats)"


def _fir(v: str) -> str:
    return " + ".join(f"CAST({t!r} AS DOUBLE) * " + (v if k == 0 else f"coalesce(lag({v}, {k}) OVER w, 0e0)") for k, t in enumerate(signal.FIR_TAPS))


@query(f"WITH {X.SAMPLE}, {_STATS} SELECT seq, sensor_id, round(mean + {NUDGE}, 6) AS mean, round(std + {NUDGE}, 6) AS std FROM stats")
def win_running_stats(spark, sf_dir):
    return signal.running_stats(X.sensor_sample(spark, sf_dir)).select("seq", "sensor_id", near("mean"), near("std"))


@query(f"WITH {X.SAMPLE}, {_CLAMP} SELECT seq, sensor_id, round(c + {NUDGE}, 6) AS clamped_value, abs(c - value) > 2.220446049250313e-16 AS clamped FROM clamp")
def win_sigma_clamp(spark, sf_dir):
    return signal.sigma_clamp(signal.running_stats(X.sensor_sample(spark, sf_dir))).select("seq", "sensor_id", near("clamped_value"), "clamped")


@query(f"WITH {X.SAMPLE} SELECT seq, sensor_id, round({_fir('value')} + {NUDGE}, 6) AS y FROM sample WINDOW w AS (PARTITION BY sensor_id ORDER BY seq)")
def win_fir16(spark, sf_dir):
    return signal.fir(X.sensor_sample(spark, sf_dir), "value", "y").select("seq", "sensor_id", near("y"))


_DENOISE = f"{_CLAMP}, den AS (SELECT seq, sensor_id, ts_ns, {_fir('c')} AS value, value AS raw, abs(c - value) > 2.220446049250313e-16 AS clamped FROM clamp WINDOW w AS (PARTITION BY sensor_id ORDER BY seq))"


@query(f"WITH {X.SAMPLE}, {_DENOISE} SELECT seq, sensor_id, ts_ns, round(value + {NUDGE}, 6) AS value, raw, clamped FROM den")
def stage_denoise(spark, sf_dir):
    return signal.denoise(X.sensor_sample(spark, sf_dir)).select("seq", "sensor_id", "ts_ns", near("value"), "raw", "clamped")


_NUM = "num AS (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY seq) AS rn FROM {src})"
_BLOCK = "blk AS (SELECT sensor_id, (rn - 1) // 256 AS block, sqrt(avg(value * value)) AS rms, CASE WHEN var_pop(value) > 1e-18 THEN kurtosis_pop(value) ELSE 0e0 END AS kurtosis FROM num GROUP BY 1, 2 HAVING count(*) = 256)"


def _numbered(src: str) -> str:
    return _NUM.format(src=src)


@query(f"WITH {X.SAMPLE}, {_numbered('sample')}, {_BLOCK} SELECT n.seq, n.sensor_id, round(coalesce(b.rms, 0e0), 6) AS rms, n.rn >= 256 AS window_full FROM num n LEFT JOIN blk b ON n.sensor_id = b.sensor_id AND n.rn // 256 - 1 = b.block")
def win_count_tumbling(spark, sf_dir):
    return signal.featurize(X.sensor_sample(spark, sf_dir)).select("seq", "sensor_id", F.round("rms", 6).alias("rms"), "window_full")


@query("SELECT event_type AS sensor_id, round(sqrt(avg(value * value)), 6) AS rms FROM events GROUP BY 1")
def agg_rms(spark, sf_dir):
    return X.sensor_sample(spark, sf_dir).groupBy("sensor_id").agg(F.round(signal.rms("value"), 6).alias("rms"))


@query("SELECT event_type AS sensor_id, round(CASE WHEN var_pop(value) > 1e-18 THEN kurtosis_pop(value) ELSE 0e0 END, 6) AS kurtosis FROM events GROUP BY 1")
def agg_kurtosis(spark, sf_dir):
    return X.sensor_sample(spark, sf_dir).groupBy("sensor_id").agg(F.round(signal.excess_kurtosis("value"), 6).alias("kurtosis"))


def _dft(src: str) -> str:
    return (
        f"{_numbered(src)}, {_BLOCK}, full_rows AS (SELECT n.sensor_id, b.block, (n.rn - 1) % 256 AS i, n.value AS x FROM num n JOIN blk b ON n.sensor_id = b.sensor_id AND (n.rn - 1) // 256 = b.block), "
        "mag AS (SELECT sensor_id, block, k, sqrt(power(sum(x * cos(2 * pi() * k * i / 256)), 2) + power(sum(x * sin(2 * pi() * k * i / 256)), 2)) AS m FROM full_rows, range(128) t(k) GROUP BY 1, 2, 3), "
        "spec AS (SELECT sensor_id, block, sum(k * m) / (sum(m) + 1e-12) AS centroid, exp(avg(ln(m + 1e-12))) / ((sum(m) + 1e-12) / 128 + 1e-12) AS flatness FROM mag GROUP BY 1, 2)"
    )


def _features(spark, sf_dir):
    return signal.block_features(X.sensor_sample(spark, sf_dir))


@query(f"WITH {X.SAMPLE}, {_dft('sample')} SELECT sensor_id, block, k, round(m, 4) AS magnitude FROM mag")
def agg_dft_mags(spark, sf_dir):
    return _features(spark, sf_dir).select("sensor_id", "block", F.posexplode("mags").alias("k", "m")).select("sensor_id", "block", F.col("k").cast("long").alias("k"), F.round("m", 4).alias("magnitude"))


@query(f"WITH {X.SAMPLE}, {_dft('sample')} SELECT sensor_id, block, round(centroid, 3) AS centroid FROM spec")
def agg_spectral_centroid(spark, sf_dir):
    return _features(spark, sf_dir).select("sensor_id", "block", F.round("centroid", 3).alias("centroid"))


@query(f"WITH {X.SAMPLE}, {_dft('sample')} SELECT sensor_id, block, round(flatness, 4) AS flatness FROM spec")
def agg_spectral_flatness(spark, sf_dir):
    return _features(spark, sf_dir).select("sensor_id", "block", F.round("flatness", 4).alias("flatness"))


@query(
    f"WITH {X.SAMPLE}, {_dft('sample')} SELECT n.seq, n.sensor_id, n.ts_ns, n.value, round(coalesce(b.rms, 0e0), 6) AS rms, round(coalesce(s.centroid, 0e0), 3) AS centroid, round(coalesce(s.flatness, 0e0), 4) AS flatness, "
    "round(coalesce(b.kurtosis, 0e0), 6) AS kurtosis, n.rn >= 256 AS window_full FROM num n LEFT JOIN blk b ON n.sensor_id = b.sensor_id AND n.rn // 256 - 1 = b.block LEFT JOIN spec s ON b.sensor_id = s.sensor_id AND b.block = s.block"
)
def stage_featurize(spark, sf_dir):
    return signal.featurize(X.sensor_sample(spark, sf_dir)).select("seq", "sensor_id", "ts_ns", "value", F.round("rms", 6).alias("rms"), F.round("centroid", 3).alias("centroid"), F.round("flatness", 4).alias("flatness"), F.round("kurtosis", 6).alias("kurtosis"), "window_full")


def _complex_input(spark, sf_dir):
    return X.sensor_sample(spark, sf_dir).withColumn("ts_ns", F.col("ts_ns").cast("decimal(20,0)"))


@query()
def pipeline_complex(spark, sf_dir):
    return compile_pipeline(COMPLEX, _complex_input(spark, sf_dir))


@query(
    f"WITH {X.SAMPLE}, {_DENOISE}, {_dft('den')} SELECT n.seq, n.sensor_id, CAST(n.ts_ns AS BIGINT) AS ts_ns, round(coalesce(b.rms, 0e0), 5) AS rms, round(coalesce(s.centroid, 0e0), 3) AS centroid, round(coalesce(s.flatness, 0e0), 4) AS flatness, "
    "round(coalesce(b.kurtosis, 0e0), 5) AS kurtosis, 64 AS hash_chars, 64 AS hmac_chars FROM num n LEFT JOIN blk b ON n.sensor_id = b.sensor_id AND n.rn // 256 - 1 = b.block LEFT JOIN spec s ON b.sensor_id = s.sensor_id AND b.block = s.block"
)
def pipeline_complex_features(spark, sf_dir):
    """What SQL can tell of pipeline_complex: all but the hashes."""
    done = compile_pipeline(COMPLEX, _complex_input(spark, sf_dir))
    return done.select("seq", "sensor_id", F.col("ts_ns").cast("long").alias("ts_ns"), F.round("rms", 5).alias("rms"), F.round("centroid", 3).alias("centroid"), F.round("flatness", 4).alias("flatness"), F.round("kurtosis", 5).alias("kurtosis"), F.length("content_hash").alias("hash_chars"), F.length("hmac").alias("hmac_chars"))


@query(f"WITH {X.SAMPLE} SELECT seq, sensor_id, CAST(ts_ns AS BIGINT) AS ts_ns, 0e0 AS rms, 0e0 AS centroid, 0e0 AS flatness, 0e0 AS kurtosis FROM sample")
def pipeline_complex_wire(spark, sf_dir):
    """Features and signatures don't survive the wire; what is left of an event has zeros."""
    done = compile_pipeline(COMPLEX, _complex_input(spark, sf_dir), "wire")
    return done.select("seq", "sensor_id", F.col("ts_ns").cast("long").alias("ts_ns"), "rms", "centroid", "flatness", "kurtosis")


@query(
    f"WITH RECURSIVE {X.SAMPLE}, t AS MATERIALIZED (SELECT sensor_id, CAST(value AS BIGINT) AS v, row_number() OVER (PARTITION BY sensor_id ORDER BY seq) AS i FROM (SELECT sensor_id, seq, trunc(value) AS value FROM sample)), "
    "f AS (SELECT DISTINCT sensor_id, CAST(0 AS BIGINT) AS i, CAST(100 AS BIGINT) AS e FROM t UNION ALL SELECT t.sensor_id, t.i, CAST(floor((3 * e + v) / 4e0) AS BIGINT) FROM f JOIN t ON t.sensor_id = f.sensor_id AND t.i = f.i + 1) "
    "SELECT sensor_id, max(i) AS n, arg_max(e, i) AS ewma FROM f GROUP BY sensor_id"
)
def win_ewma_int(spark, sf_dir):
    return signal.ewma_int(X.sensor_sample(spark, sf_dir), "value")


# Scalar functions.


@query("SELECT event_id AS seq, round(value * (CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END), 2) AS v FROM events")
def fn_round_half_away(spark, sf_dir):
    return X.events(spark, sf_dir).select(F.col("event_id").alias("seq"), scalar.round_half_away(F.col("value") * F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1), 2).alias("v"))


@query("SELECT event_id AS seq, strftime(make_timestamp((1700000000 + event_id * 61) * 1000000), '%Y%m%d_%H%M%S') AS slug FROM events")
def fn_slug_timestamp(spark, sf_dir):
    return X.events(spark, sf_dir).select(F.col("event_id").alias("seq"), scalar.slug_timestamp(F.lit(1_700_000_000) + F.col("event_id") * 61).alias("slug"))


@query("SELECT event_id AS seq, CASE WHEN event_id % 2 = 0 THEN 'fn-' ELSE '' END || event_type AS bare, event_type AS trimmed FROM events")
def fn_stage_bare_name(spark, sf_dir):
    name = F.concat(F.when(F.col("event_id") % 2 == 0, "fn-fn-").otherwise("fn-"), "event_type")
    return X.events(spark, sf_dir).select(F.col("event_id").alias("seq"), scalar.stage_bare_name(name).alias("bare"), scalar.trim_prefix(name).alias("trimmed"))


@query("SELECT event_id AS seq, replace('a_b_' || event_type, '_', '-') AS kebab, replace('a-b-' || event_type, '-', '_') AS snake FROM events")
def fn_kebab_snake(spark, sf_dir):
    return X.events(spark, sf_dir).select(F.col("event_id").alias("seq"), scalar.to_kebab(F.concat(F.lit("a_b_"), "event_type")).alias("kebab"), scalar.to_snake(F.concat(F.lit("a-b-"), "event_type")).alias("snake"))


@query("SELECT event_id AS seq, event_id % 8 + 1 + 1 AS cpus FROM events")
def fn_cpu_list_count(spark, sf_dir):
    text = F.concat(F.lit("0-"), (F.col("event_id") % 8).cast("string"), F.lit(", 12,x"))
    return X.events(spark, sf_dir).select(F.col("event_id").alias("seq"), scalar.cpu_list_count(text).alias("cpus"))


@query("SELECT event_id AS seq, round(CASE WHEN event_id % 2 = 0 THEN value / 8 ELSE value END, 6) AS cpu FROM events")
def fn_cpu_norm(spark, sf_dir):
    unit = F.when(F.col("event_id") % 2 == 0, "per_core").otherwise("total")
    return X.events(spark, sf_dir).select(F.col("event_id").alias("seq"), F.round(scalar.cpu_norm(F.col("value"), unit, F.lit(8.0)), 6).alias("cpu"))
