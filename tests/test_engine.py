"""Pipeline files, codec, stages and streams."""

import hashlib
import hmac
import json
import math

import pytest
from pyspark.sql import functions as F

from streamstage import cli, types
from streamstage.functions import codec, scalar
from streamstage.functions.blake3 import blake3_hex
from streamstage.operators import flow, signal, stages
from streamstage.operators.analysis import downsample
from streamstage.operators.ranking import nearest_rank, positions
from streamstage.plans import dataflow
from streamstage.plans.engine import compile_pipeline, run_batch
from streamstage.sources import files
from streamstage.sources.generator import SensorSource, end_mark, sensor_readings
from streamstage.sources.profiles import Profile, token_bucket
from streamstage.spec import SpecError, endpoints, load, tee_address

GOOD = """
types:
  reading: {sensor_id: string, value: f64, unit: 'string?'}
  enriched: {sensor_id: string, value: f64, anomaly: 'bool?', severity: 'string?'}
source: {kind: loadgen, count: 50, sensors: 5}
stages:
  - {name: normalize, in: reading, out: reading, src: 'streamstage.operators.stages:normalize', scaling: {max: 5, p99_ms: 10}}
  - {name: detect, in: reading, out: enriched, src: 'streamstage.operators.stages:detect'}
  - {name: finalize, in: enriched, out: enriched, src: 'streamstage.operators.stages:finalize', deps: {hex: '0.4'}}
edges: [normalize -> detect, detect -> finalize]
deploy: {ingress: 'tcp://localhost:9100'}
"""


def spec_of(tmp_path, text):
    (tmp_path / "pipeline.yaml").write_text(text)
    return load(tmp_path / "pipeline.yaml")


def test_good_file(tmp_path):
    spec = spec_of(tmp_path, GOOD)
    assert [s.name for s in spec.ordered()] == ["normalize", "detect", "finalize"]
    assert spec.stages[0].scaling.max_replicas == 5 and spec.stages[1].scaling.queue_up == 50
    assert spec.warnings == ("stage normalize: p99_ms has no effect",)
    assert endpoints(spec)["detect"] == {"push": 9003, "pull": 9004, "ctrl": 9005}
    assert tee_address("tcp://localhost:9999") == "tcp://localhost:10000" and tee_address("ipc:///tmp/x") == "ipc:///tmp/x-pub"


@pytest.mark.parametrize(
    ("old", "new", "says"),
    [
        ("edges: [normalize -> detect, detect -> finalize]", "edges: [normalize]", "bad edge"),
        ("normalize -> detect, detect", "normalize -> nowhere, detect", "target"),
        ("detect -> finalize]", "finalize -> normalize]", "mismatch"),
        ("out: enriched, src: 'streamstage.operators.stages:detect'", "out: other, src: 'streamstage.operators.stages:detect'", "mismatch"),
        ("src: 'streamstage.operators.stages:detect'", "src: ./none.rs", "not found"),
        ("src: 'streamstage.operators.stages:detect'", "src: 'a:b', wasm: x", "both"),
        (", src: 'streamstage.operators.stages:detect'", "", "neither"),
        ("out: reading, src", "out: reading, placement: moon, src", "placement"),
        ("ingress: 'tcp://localhost:9100'", "port_base: 1", "ingress"),
        ("{ingress:", "{this_host: moon, ingress:", "this_host"),
        ("deps: {hex: '0.4'}", "deps: {hex: [1]}", "dependency"),
        ("value: f64, unit", "value: float128, unit", "unknown type"),
        ("normalize -> detect, detect -> finalize", "normalize -> detect, normalize -> detect, detect -> finalize", "linear"),
    ],
)
def test_bad_files(tmp_path, old, new, says):
    assert old in GOOD
    with pytest.raises(ValueError, match=says):
        spec_of(tmp_path, GOOD.replace(old, new)).ordered()


def test_structure_is_checked():
    out = types.Record.of("a", {"x": "f64?", "y": "string"})
    assert types.missing_fields(out, types.Record.of("b", {"x": "f64", "y": "u64", "z": "bool", "w": "bool?"})) == ["x may be absent but is required", "y is string, not u64", "z is required but absent"]


def test_old_file(tmp_path):
    spec = spec_of(tmp_path, "pipeline: [{name: a, wasm: a.wasm, slo: {max_replicas: 3, min_replicas: 1}}]\ndispatchers: [{name: a, push_port: 5, pull_port: 6, ctrl_port: 4}]\nsinks: [{name: s, push_port: 7}]")
    assert (spec.ingress, spec.collector, spec.port_base, spec.stages[0].scaling.max_replicas) == ("tcp://localhost:5", "tcp://localhost:7", 4, 3)
    with pytest.raises(SpecError, match="missing `wasm`"):
        spec_of(tmp_path, "pipeline: [{name: a, slo: {}}]\ndispatchers: []")


def test_decode_rules(spark):
    record = types.Record.of("r", {"f": "f64", "u": "u64", "w": "u32", "i": "s32", "s": "string", "b": "bool", "o": "string?"})
    texts = ['{"f": 2, "u": 18446744073709551615, "w": 4294967297, "i": 2147483648, "s": "x", "b": true, "o": 5}', '{"f": "x", "u": -3, "w": 3.5, "i": null, "s": 5}', '{"u": 2.0, "i": 7.0}', "5", "[1]", '{"o": null}', "{bad", "", None]
    rows = codec.decode(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, payload string"), record, keep=()).collect()
    assert [tuple(r) for r in rows] == [(2.0, 18446744073709551615, 1, -2147483648, "x", True, "")] + [(0.0, 0, 0, 0, "", False, None)] * 5


def test_encode_leaves_out(spark):
    record = types.Record.of("r", {"v": "f64?", "s": "string?"})
    rows = spark.createDataFrame([(float("nan"), "a"), (1.5, None)], "v double, s string").select(codec.encode(record)).collect()
    assert [json.loads(r[0]) for r in rows] == [{"s": "a"}, {"v": 1.5}]


def test_edge_rows(spark):
    df = spark.createDataFrame([("a", v, u) for v, u in ((-60.0, None), (200.0, "%"), (float("nan"), "x"))], "sensor_id string, value double, unit string")
    rows = stages.normalize(df).collect()
    assert [(r.value, r.unit) for r in rows[:2]] == [(-50.0, "celsius"), (150.0, "%")] and math.isnan(rows[2].value)
    rows = stages.detect(spark.createDataFrame([("a", v, "c") for v in (75.0, 75.1, 85.0, 85.1)], df.schema)).collect()
    assert [(r.anomaly, r.severity) for r in rows] == [(False, "normal"), (True, "medium"), (True, "medium"), (True, "high")]


def test_wire_mode(spark):
    payloads = spark.createDataFrame([(1, '{"sensor_id": "s", "value": 90}')], "seq long, payload string")
    wire, contract = (run_batch(dataflow.THREE, payloads, m).first().asDict() for m in ("wire", "contract"))
    assert wire == {"seq": 1, "sensor_id": "s", "value": 90.0, "anomaly": None, "severity": "unknown"}
    assert contract == {"seq": 1, "sensor_id": "s", "value": 90.0, "anomaly": True, "severity": "high"}


def test_stages_run_in_one_pass(spark):
    plan = compile_pipeline(dataflow.THREE, spark.range(3).selectExpr("id AS seq", "'a' AS sensor_id", "1D * id AS value", "cast(null as string) AS unit"))._jdf.queryExecution().executedPlan().toString()
    assert "*(2)" not in plan and "Exchange" not in plan and "Python" not in plan and all("*(1)" in x for x in plan.strip().splitlines())


def test_denoise_has_one_exchange(spark):
    plan = signal.denoise(spark.range(9).selectExpr("id AS seq", "string(id % 3) AS sensor_id", "id AS ts_ns", "1D * id AS value"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def model(values):
    """Denoise and featurize, event by event."""
    import numpy as np

    from streamstage.streaming.stateful import features

    n, mean, m2, last, block, feats, out = 0, 0.0, 0.0, [0.0] * 16, [], (0.0,) * 4, []
    for x in values:
        n += 1
        d = x - mean
        mean += d / n
        m2 += d * (x - mean)
        std = max(math.sqrt(m2 / (n - 1)) if n > 1 else 1.0, 1e-9)
        c = min(max(x, mean - 4 * std), mean + 4 * std)
        last = [c, *last[:15]]
        y = sum(t * v for t, v in zip(signal.FIR_TAPS, last, strict=True))
        block.append(y)
        if len(block) == 256:
            feats, block = features(np.array(block)), []
        out.append((y, c != x, *feats, n >= 256))
    return out


def test_batch_stream_and_model_agree(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [(i, f"s{i % 2}", i * 1000, float(v)) for i, v in enumerate(rng.normal(50, 5, 1200) + 200 * (rng.random(1200) < 0.01))]
    df = spark.createDataFrame(rows, "seq long, sensor_id string, ts_ns long, value double").withColumn("ts_ns", F.col("ts_ns").cast("decimal(20,0)"))
    for i, (a, b) in enumerate(((0, 500), (500, 1200))):
        df.where((F.col("seq") >= a) & (F.col("seq") < b)).coalesce(1).write.parquet(str(tmp_path / "in" / f"part{i}"))
    told = {}
    for key in ("s0", "s1"):
        own = [r for r in rows if r[1] == key]
        told |= {r[0]: m for r, m in zip(own, model([r[3] for r in own]), strict=True)}
    batch = signal.featurize(signal.denoise(df)).collect()
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    from streamstage.streaming.stateful import denoise, featurize

    names = ["value", "rms", "centroid", "flatness", "kurtosis", "window_full"]
    q = featurize(denoise(stream)).writeStream.format("memory").queryName("features").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    for got in (batch, spark.table("features").collect()):
        assert len(got) == 1200
        for r in got:
            y, _, rms, centroid, flatness, kurtosis, full = told[r.seq]
            assert [r[n] for n in names[:-1]] == pytest.approx([y, rms, centroid, flatness, kurtosis], rel=1e-4, abs=1e-6) and r.window_full == full


def test_run_stream_and_tee(spark, tmp_path):
    from streamstage.streaming.runner import collect_and_tee, run_stream

    spark.range(40).selectExpr("id AS seq", "'a' AS sensor_id", "1D * id * 3 AS value", "cast(null as string) AS unit").write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("seq long, sensor_id string, value double, unit string").parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second start finds nothing new
        run_stream(dataflow.THREE, stream(), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("seq", "severity").collect()}
    assert got == {tuple(r) for r in compile_pipeline(dataflow.THREE, spark.read.parquet(str(tmp_path / "in"))).select("seq", "severity").collect()} and len(got) == 40
    seen = []

    def broken(df):
        raise RuntimeError("slow copy")

    collect_and_tee(compile_pipeline(dataflow.THREE, stream()), str(tmp_path / "log"), [broken, lambda df: seen.append(df.count())], str(tmp_path / "cp2")).awaitTermination(60)
    assert seen == [40] and spark.read.parquet(str(tmp_path / "log")).count() == 40


def test_golden_values(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 11)], "v double")
    assert tuple(nearest_rank(df, "v", {"a": 0.5, "b": 0.9, "c": 0.95, "d": 0.99}).first()) == (6.0, 10.0, 10.0, 10.0)
    assert df.select(signal.excess_kurtosis("v")).first()[0] == pytest.approx(-1.2242424242424241)
    assert sum(signal.FIR_TAPS) == pytest.approx(0.816)
    # Published test vectors: bytes i % 251.
    for n, told in ((0, "af1349b9f5f9a1a6"), (1, "2d3adedff11b61f1"), (1024, "42214739f095a406"), (1025, "d00278ae47eb27b3"), (2048, "e776b6028c7cd22a"), (2049, "5f4d72f40d7a5f82"), (3072, "b98cb0ff3623be03"), (4096, "015094013f57a527"), (5120, "9cadc15fed8b5d85"), (6144, "3e2e5b74e048f3ad"), (7168, "61da957ec2499a95"), (8192, "aae792484c8efe4f")):
        assert blake3_hex(bytes(i % 251 for i in range(n))).startswith(told)
    rates = {t: Profile(**p).target(F.lit(t)) for t, p in ((15, {"kind": "ramp", "rate": 1000, "ramp_start": 100, "ramp_time": 30}), (1, {"kind": "burst", "rate": 900, "burst_base_rate": 7}), (5, {"kind": "burst", "rate": 900, "burst_base_rate": 7}), (0, {"kind": "wave", "rate": 1000}))}
    assert spark.range(1).select(*[c.alias(str(t)) for t, c in rates.items()]).first().asDict() == {"15": 550, "1": 900, "5": 7, "0": 600}


def test_hmac(spark):
    for key in (b"k", b"x" * 100):
        got = spark.createDataFrame([("héllo",)], "t string").select(scalar.hmac_sha256(F.col("t"), key)).first()[0]
        assert got == hmac.new(key, "héllo".encode(), hashlib.sha256).hexdigest()


def test_positions_with_ties_and_groups(spark):
    rows = [(i % 3, float(i % 7), i) for i in range(500)]
    got = positions(spark.createDataFrame(rows, "g int, v double, i int"), ["v", "i"], ["g"]).collect()
    for g in range(3):
        own = sorted((v, i) for a, v, i in rows if a == g)
        assert {(r.v, r.i): (r.rn, r.n) for r in got if r.g == g} == {x: (k + 1, len(own)) for k, x in enumerate(own)}


def test_autoscaler_against_a_loop(spark):
    import random

    random.seed(5)
    for case in range(3):
        depths = [random.choice([0, 0, 10, 30, 60, 80]) for _ in range(300)]
        p = dict(queue_up=50, queue_down=15, up_ticks=2, down_ticks=3, least=case % 2, most=3, settle=3)
        n, up, down, since, ups, downs, colds = p["least"], 0, 0, 0, 0, 0, 0
        for qd in depths:
            since += 1
            up, down = (up + 1, 0) if qd > 50 else (0, down + 1) if qd <= 15 else (max(up - 1, 0), max(down - 1, 0))
            if n == 0 and qd > 0:
                n, since, up, ups, colds = n + 1, 0, 0, ups + 1, colds + 1
            elif n < p["least"]:
                n, since, ups = n + 1, 0, ups + 1
            elif up >= 2 and since >= 3 and n < 3:
                n, since, up, ups = n + 1, 0, 0, ups + 1
            elif down >= 3 and n > p["least"]:
                n, down, downs = n - 1, 0, downs + 1
        got = flow.autoscale(spark.createDataFrame([("s", i, q) for i, q in enumerate(depths)], "stage string, tick long, qd long"), **p).first()
        assert (got.replicas, got.ups, got.downs, got.cold_starts) == (n, ups, downs, colds)


def test_dispatch_keeps_all(spark):
    trace = spark.createDataFrame([("s", i, i % 5, i % 3, 0) for i in range(100)], "stage string, tick long, arrivals long, credits long, lost long")
    got = flow.dispatch(trace, buffer=20).first()
    assert got.dispatched + got.queued + got.waiting == sum(i % 5 for i in range(100)) and got.most_queued == 20 and got.waiting > 0


def test_dispatch_in_batches_and_with_lost_workers(spark):
    run = lambda rows, **how: flow.dispatch(spark.createDataFrame([("s", i, *r) for i, r in enumerate(rows)], "stage string, tick long, arrivals long, credits long, lost long"), **how).first()
    # A turn sends a batch before and one after it polls.
    assert run([(1000, 1000, 0)]).dispatched == 256 and run([(1000, 1000, 0), (0, 0, 0)]).dispatched == 768
    # A lost worker's credits go, its events stay.
    got = run([(10, 4, 0), (0, 8, 6), (0, 0, 0)])
    assert (got.dispatched, got.queued, got.purged, got.idle_credits) == (6, 4, 6, 0)
    assert run([(0, 3, 9), (5, 0, 0)]).dispatched == 0
    # With a full buffer nothing is polled; what waits comes later, nothing is refused.
    got = run([(50, 0, 0), (0, 30, 0), (0, 30, 0), (0, 30, 0)], buffer=20)
    assert (got.dispatched, got.waiting, got.most_queued) == (50, 0, 20)


def test_downsample_against_a_loop(spark):
    points = [(0.0, 1.0), (0.4, 2.0), (1.0, 3.0), (1.9, 4.0), (2.1, 5.0), (9.0, 6.0)]
    got = downsample(spark.createDataFrame([("k", t, v) for t, v in points], "k string, t double, v double"), "k", "t", "v", 1.0).orderBy("t").collect()
    assert [(round(r.t, 6), round(r.v, 6), r.n) for r in got] == [(0.2, 1.5, 2), (1.45, 3.5, 2), (2.1, 5.0, 1), (9.0, 6.0, 1)]


def test_token_bucket(spark):
    ticks = spark.createDataFrame([("r", i, t, 0.25) for i, t in enumerate([10.0, 10.0, 0.0, 1.0])], "run string, tick long, target double, dt double")
    assert [(r.emitted, r.dropped) for r in token_bucket(ticks).orderBy("tick").collect()] == [(2, 0), (3, 0), (0, 0), (0, 0)]
    full = token_bucket(ticks.withColumn("room", F.lit(2))).orderBy("tick").collect()
    assert [(r.emitted, r.dropped) for r in full] == [(2, 0), (2, 1), (0, 0), (0, 0)]


def test_sensors(spark):
    a, b = (sensor_readings(spark, 3000, 7, seed=4, partitions=p).orderBy("bench_seq").collect() for p in (1, 5))
    assert a == b and len(a) == 3000 and {r.sensor_type for r in a[:5]} == {"temperature", "vibration", "pressure", "humidity", "current"}
    assert 0 < sum(r.is_anomaly for r in a) < 30 and a[8].sensor_id == "sensor-0001" and a[8].location == "zone-B"
    spark.dataSource.register(SensorSource)
    stream = spark.readStream.format("sensors").option("count", 50).option("sensors", 7).option("seed", 4).option("rowsPerBatch", 20).load()
    q = stream.writeStream.format("memory").queryName("sensors").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.value for r in spark.table("sensors").collect()) == sorted(r.value for r in sensor_readings(spark, 50, 7, seed=4).collect())
    assert json.loads(end_mark(5, 5, 1.0))["eos"] is True


def test_sensor_streams_go_on_where_they_stopped(spark, tmp_path):
    from streamstage.sources import generator

    def run(count):
        stream = generator.sensor_stream(spark, {"count": count, "sensors": 7, "seed": 4, "rowsPerBatch": 200, "partitions": 3})
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
        q.stop()

    run(500)
    run(1300)
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted(tuple(r) for r in sensor_readings(spark, 1300, 7, seed=4).collect())
    whole = generator.Sensor(1, 9).readings(3000)
    parts = generator.Sensor(1, 9)
    made = [parts.readings(n) for n in (1, 999, 0, 2000)]
    import numpy as np

    assert np.allclose(np.concatenate([v for v, _ in made]), whole[0], atol=2e-4) and (np.concatenate([o for _, o in made]) == whole[1]).all()


def test_file_readers(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"ts": 1.5, "level": "info", "component": "worker/a", "msg": "worker booted", "cold_start_ms": "3"}\n\n{broken\n')
    row = files.read_log(spark, str(tmp_path / "log.jsonl")).collect()
    assert len(row) == 1 and row[0].fields == {"cold_start_ms": "3"} and row[0].ts == 1.5
    assert files.read_jsonl(spark, str(tmp_path / "log.jsonl"), "msg string").count() == 1
    (tmp_path / "run.json").write_text('{"counters": 1, "throughput": 2, "latency_ms": 3, "events": {"rows": [[1.0, 2.0]]}}')
    assert files.read_summary(spark, str(tmp_path / "run.json")).first().rows == "[[1.0,2.0]]"
    (tmp_path / "bad.json").write_text('{"counters": 1}')
    with pytest.raises(ValueError, match="throughput"):
        files.read_summary(spark, str(tmp_path / "bad.json"))
    (tmp_path / "c.csv").write_text("mode,v\nold,1\n")
    assert files.read_csv(spark, str(tmp_path / "c.csv"), "mode string, v int", {"mode": {"old": "new"}}).first().mode == "new"
    assert {r.file.rpartition("/")[2] for r in files.latest_files(spark, str(tmp_path)).collect()} <= {"c.csv", "bad.json", "run.json", "log.jsonl"}
    assert files.source_flags({"wave_min": 3, "profile": "wave"}) == ["--wave-min", "3", "--profile", "wave"]
    with pytest.raises(ValueError, match="unknown source kind"):
        files.open_source(spark, "none", {})
    with pytest.raises(Exception, match="no source tells"):
        spark.range(1).select(files.resolved(F.lit(None).cast("string"))).collect()


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "p.yaml").write_text(GOOD)
    assert cli.main(["validate", "--config", str(tmp_path / "p.yaml")]) == 0 and "normalize -> detect -> finalize" in capsys.readouterr().out
    assert cli.main(["run", "--config", str(tmp_path / "p.yaml"), "--log-dir", str(tmp_path / "logs")]) == 0
    assert spark.read.parquet(str(tmp_path / "logs/events")).count() == 50
    assert cli.main(["build", "--config", str(tmp_path / "p.yaml")]) == 0
    assert cli.main(["clean", "--log-dir", str(tmp_path / "logs")]) == 0 and not (tmp_path / "logs").exists()
    (tmp_path / "p.yaml").write_text("stages: []")
    assert cli.main(["validate", "--config", str(tmp_path / "p.yaml")]) == 1


@pytest.mark.parametrize("kind", ["text", "text-stream", "parquet", "parquet payload", "json", "csv", "sensor-stream", "rate", "rate-micro-batch", "socket"])
def test_sources_from_the_command_line(spark, tmp_path, kind):
    """Each source's events reach the stages as what they say, not as defaults."""
    import socket
    import threading

    rows = [{"sensor_id": f"s{i}", "value": 60.0 + 10 * i} for i in range(4)]
    lines = "".join(json.dumps(r) + "\n" for r in rows) + "{broken\n"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(lines if kind != "json" else lines.replace("{broken\n", ""))
    (tmp_path / "in.csv").write_text("sensor_id,value\n" + "".join(f"{r['sensor_id']},{r['value']}\n" for r in rows))
    spark.createDataFrame([(r["sensor_id"], r["value"]) for r in rows], "sensor_id string, value double").write.parquet(str(tmp_path / "typed"))
    spark.createDataFrame([(x,) for x in lines.splitlines()], "payload string").write.parquet(str(tmp_path / "raw"))
    columns = "columns: {sensor_id: \"concat('s', seq % 4)\", value: '60 + 10 * (seq % 4)'}"
    server = socket.create_server(("localhost", 0))
    source = {
        "text": f"kind: text, path: '{tmp_path}/in'", "text-stream": f"kind: text-stream, path: '{tmp_path}/in'", "parquet": f"kind: parquet, path: '{tmp_path}/typed'", "parquet payload": f"kind: parquet, path: '{tmp_path}/raw'",
        "json": f"kind: json, path: '{tmp_path}/in', schema: 'sensor_id string, value double'", "csv": f"kind: csv, path: '{tmp_path}/in.csv', schema: 'sensor_id string, value double'",
        "sensor-stream": "kind: sensor-stream, count: 40, sensors: 4", "rate": f"kind: rate, rate: 50, {columns}", "rate-micro-batch": f"kind: rate-micro-batch, rate: 8, {columns}", "socket": f"kind: socket, host: localhost, port: {server.getsockname()[1]}",
    }[kind]

    def serve():
        try:
            while True:
                c, _ = server.accept()
                c.sendall(lines.encode())
        except OSError:
            pass

    threading.Thread(target=serve, daemon=True).start()
    (tmp_path / "p.yaml").write_text(GOOD.replace("source: {kind: loadgen, count: 50, sensors: 5}", f"source: {{{source}}}"))
    assert cli.main(["run", "--config", str(tmp_path / "p.yaml"), "--log-dir", str(tmp_path / "logs"), "--seconds", "8"]) == 0
    server.close()
    got = {(r.sensor_id, r.value, r.severity) for r in spark.read.parquet(str(tmp_path / "logs/events")).collect()}
    if kind == "sensor-stream":
        assert {r[0] for r in got} == {f"sensor-{i:04d}" for i in range(4)} and any(r[1] for r in got)
    else:
        assert got == {("s0", 60.0, "normal"), ("s1", 70.0, "normal"), ("s2", 80.0, "medium"), ("s3", 90.0, "high")}


def test_sources_without_a_required_column(spark, tmp_path, capsys):
    spark.range(3).write.parquet(str(tmp_path / "in"))
    (tmp_path / "p.yaml").write_text(GOOD.replace("kind: loadgen, count: 50, sensors: 5", f"kind: parquet, path: '{tmp_path}/in'"))
    assert cli.main(["run", "--config", str(tmp_path / "p.yaml"), "--log-dir", str(tmp_path / "logs")]) == 1
    assert "no sensor_id, value" in capsys.readouterr().err


def test_kafka_is_read_as_payload(monkeypatch):
    """Without a broker: the options that the reader gets, and which column the messages come in."""
    seen = {}

    class Reader:
        def format(self, kind):
            seen["format"] = kind
            return self

        def option(self, k, v):
            seen[k] = v
            return self

        def load(self):
            return self

        def selectExpr(self, *what):
            seen.setdefault("what", what)
            return self

    files.open_source(type("S", (), {"readStream": Reader()})(), "kafka", {"servers": "b:9092", "topic": "t"})
    assert seen["format"] == "kafka" and seen["subscribe"] == "t" and seen["what"] == ("cast(value as string) as payload",)


def test_queue_params_of_loose_files(tmp_path):
    from streamstage.spec import queue_params

    (tmp_path / "p.yaml").write_text("anything: [1]\nstages:\n  - name: a\n    scaling: {queue_up: 9, max: 3}\n  - name: b\n  - name: c\n    scaling: {min: 2}\nother:\n  x: 1\n")
    assert queue_params(tmp_path / "p.yaml") == {"a": {"queue_up": 9.0, "queue_down": 0.0, "min_rep": 1, "max_rep": 3}, "c": {"queue_up": 50.0, "queue_down": 0.0, "min_rep": 2, "max_rep": 8}}
    (tmp_path / "p.yaml").write_text("a: [")
    with pytest.raises(SpecError):
        queue_params(tmp_path / "p.yaml")


def test_throughput_leaves_out_the_start_only(spark):
    from streamstage.operators import telemetry as tel

    # 100 s, one event a second, and 50 more in the last second.
    times = [float(t) for t in range(101)] + [100.0] * 50
    log = spark.createDataFrame([(i, t, [("a", t, t)]) for i, t in enumerate(times)], "seq long, recv_ts double, hops array<struct<stage:string,enter_ts:double,exit_ts:double>>")
    got = tel.throughput(log).first()
    assert (got.received, got.duration_s, got.sustained_eps, got.trim_s, round(got.warm_eps, 9)) == (151, 100.0, 1.51, 5.0, round((96 + 50) / 95, 9))
    assert tel.stage_rates(log).first() == ("a", 1.51)
    one = tel.throughput(log.where("seq = 0")).first()
    assert (one.sustained_eps, one.warm_eps) == (0.0, 1000.0)


def test_forward_fill_of_one_large_key(spark):
    import time

    from streamstage.operators import telemetry as tel

    rows = spark.range(600_000).selectExpr("'k' AS stage", "id * 1D AS t_s", "id * 2D AS value")
    began = time.time()
    got = tel.forward_fill(rows.where("t_s % 3 <> 0").select("stage", "t_s"), rows.where("t_s % 3 = 0")).agg(F.sum("value"), F.count("value"), F.count(F.lit(1))).first()
    told = [2 * (-(-t // 3) * 3) for t in range(600_000) if t % 3 and -(-t // 3) * 3 < 600_000]
    assert got[0] == sum(told) and got[1] == len(told) and got[2] == 400_000 and time.time() - began < 60


def test_totals_between_seconds_are_held_at_both_ends(spark):
    from streamstage.operators.analysis import per_second_from_total

    points = [("a", 1.5, 10), ("a", 3.0, 40), ("a", 3.0, 50), ("a", 4.25, 60), ("b", 0.0, 5)]

    def at(key, t):
        own = [(x, v) for k, x, v in points if k == key]
        if t <= own[0][0]:
            return own[0][1]
        if t >= own[-1][0]:
            return own[-1][1]
        i = next(i for i, (x, _) in enumerate(own) if x >= t)
        (x0, v0), (x1, v1) = own[i - 1], own[i]
        return v0 + (t - x0) / (x1 - x0) * (v1 - v0)

    got = {(r.stage, r.second): r.value for r in per_second_from_total(spark.createDataFrame(points, "stage string, t double, n long"), "t", "n", "stage").collect()}
    assert got.keys() == {(k, s) for k in "ab" for s in range(4)}
    assert all(abs(v - (at(k, s + 1) - at(k, s))) < 1e-9 for (k, s), v in got.items())


def test_gap_split_keeps_zeros(spark):
    from streamstage.operators.analysis import gap_split

    rows = [("a", 0.0), ("a", 2.0), ("a", 8.0), ("b", 3.0), ("c", 4.0), ("c", 4.0), ("d", 1.0), ("d", 3.0), ("d", 9.0), ("d", 9.5)]
    got = {r.k: r.split for r in gap_split(spark.createDataFrame(rows, "k string, v double"), "k", "v").collect()}
    assert got == {"a": 0.0, "b": 1.0, "c": 4.0, "d": pytest.approx(3**0.5)}


def test_chunks_follow_the_polls(spark):
    from streamstage.operators.analysis import chunk_quantiles

    rows = spark.range(23).selectExpr("id", "id * 1D AS v")
    got = chunk_quantiles(rows, ["id"], "v", spark.range(5)).orderBy("chunk").collect()
    assert [(r.chunk, r.n, r.p50) for r in got] == [(k, 4, 4 * k + 1.5) for k in range(5)]
    assert chunk_quantiles(rows, ["id"], "v", spark.range(40)).count() == 23


def test_logs(spark):
    from streamstage.operators import logs

    rows = [(5.0, "worker/a/b", "worker booted", {"cold_start_ms": "3", "boot_ms": "x"}), (6.0, "w", "worker booted", {"cold_start_ms": "4.5"}), (7.0, "worker/c", "worker booted", {}), (8.0, "worker/c", "progress", {"cold_start_ms": "9", "sent": "7"})]
    log = spark.createDataFrame(rows, "ts double, component string, msg string, fields map<string,string>")
    found = logs.boots(log, 4.0)
    assert sorted(map(tuple, found.collect())) == [("a/b", 1.0, None, 3.0), ("w", 2.0, None, 4.5)]
    instead = spark.createDataFrame([("z", 1)], "stage string, cold_start_ms int")
    assert logs.boots_or(found, instead).count() == 2 and logs.boots_or(found.where("false"), instead).first().stage == "z"
    assert logs.boots(log).first().t_s is None and logs.load_progress(log).first().sent == 7
    told = spark.createDataFrame([("1", "true"), ("0", "true"), ("0", "True"), ("0", "no"), ("x", "true"), ("0", None)], "is_prewarm string, success string")
    assert logs.successes(told).count() == 2


def test_exports(spark, tmp_path):
    from streamstage.sources import sinks

    starts = spark.createDataFrame([("AOT", 1, "a", 3.0, None, None, 1), ("AOT", 1, "a", 1.0, None, None, 2), ("JIT", 1, "a", 9.0, 2.0, 1.0, 1)], "mode string, iteration int, stage string, cold_start_ms double, compile_ms double, instantiate_pre_ms double, at int")
    rows = sinks.cold_start_rows(starts, ["at"])
    assert sorted(r.spawn_kind for r in rows.collect()) == ["first", "first", "warm"]
    sinks.write_csv(rows, str(tmp_path / "cold"), "cold_starts")
    assert spark.read.option("header", True).csv(str(tmp_path / "cold")).columns == sinks.EXPORTS["cold_starts"]
    stats = sinks.summary_stats(rows)
    assert stats.columns == sinks.EXPORTS["summary_stats"] and stats.count() == 3
    used = sinks.cpu_mem(spark.createDataFrame([(0.0, 5.0)], "t_s double, cpu_pct double"), spark.createDataFrame([(0.1, 7.0), (1.1, 8.0)], "t_s double, rss_mb double"))
    assert sorted(map(tuple, used.collect())) == [(0.0, 5.0, 7.0), (1.1, None, 8.0)]
    for name in ("binned_latency", "loadgen", "grid_results"):
        df = spark.createDataFrame([tuple(str(i) for i in range(len(sinks.EXPORTS[name])))], [*sinks.EXPORTS[name][::-1]])
        sinks.write_csv(df, str(tmp_path / name), name)
        assert spark.read.option("header", True).csv(str(tmp_path / name)).columns == sinks.EXPORTS[name]
    with pytest.raises(ValueError, match="grid_results: no mode"):
        sinks.write_csv(used, str(tmp_path / "bad"), "grid_results")


def test_sinks_and_resources(spark, tmp_path):
    from streamstage.operators import resources, telemetry
    from streamstage.plans import fixtures
    from streamstage.sources import sinks

    log = fixtures.hop_log(spark, "/root/testdata/sf0.001")
    sinks.write_summary(telemetry.run_summary(log), str(tmp_path / "run"), "log.jsonl")
    row = spark.read.json(str(tmp_path / "run")).first()
    assert row["_jsonl_path"] == "log.jsonl" and row["latency_ms"]["count"] == 1000 and len(row["per_stage"]) == 3
    lines = spark.createDataFrame([(1.5, "info", "worker/a", "worker booted", {"ms": "3", "msg": "no"})], "ts double, level string, component string, msg string, fields map<string,string>")
    for _ in range(2):
        sinks.append_log(lines, str(tmp_path / "log"))
    back = files.read_log(spark, str(tmp_path / "log")).collect()
    assert len(back) == 2 and back[0].asDict() == {"ts": 1.5, "level": "info", "component": "worker/a", "msg": "worker booted", "fields": {"ms": "3"}}
    sinks.write_csv(lines.select("ts", "msg"), str(tmp_path / "csv"))
    assert files.read_csv(spark, str(tmp_path / "csv"), "ts double, msg string").first().msg == "worker booted"
    used = resources.sample(spark, 2, 0.05)
    assert used.count() == 2 and all(r.rss_mb > 1 for r in used.collect()) and resources.sample(spark, 2, 0).count() == 0
    assert [x.line.split()[0] for x in sinks.run_card(log, used).collect()] == ["events", "sustained", "latency", "peaks"]
    assert resources.environment(spark).first().spark == spark.version
    assert resources.cpu_list("0-3, 5,x,7-") == [0, 1, 2, 3, 5]
