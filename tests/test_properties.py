"""Properties that hold for any input."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from streamstage.functions.blake3 import blake3_hex, blake3_hexes
from streamstage.operators import analysis as ana
from streamstage.operators import signal, stages
from streamstage.operators import telemetry as tel
from streamstage.operators.ranking import linear_quantiles, nearest_rank, running_sum
from streamstage.plans import fixtures as X

SF = "/root/testdata/sf0.001"
FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@FEW
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=60))
def test_quantiles_are_values_in_order(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [*nearest_rank(df, "v", {"a": 0.1, "b": 0.5, "c": 0.9, "d": 0.999}).first()]
    ranked = sorted(values)
    assert got == [ranked[min(int(len(values) * p), len(values) - 1)] for p in (0.1, 0.5, 0.9, 0.999)]


@FEW
@given(st.lists(st.floats(0.001, 1e4), min_size=1, max_size=60))
def test_histograms_hold_no_more_than_there_is(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert tel.histogram(df, "v").agg(F.sum("count")).first()[0] <= len(values)
    assert ana.equal_bins(df, "v", 7).agg(F.sum("count")).first()[0] == len(values)


def test_ingress_is_part_of_the_whole(spark):
    log = X.hop_log(spark, SF)
    both = tel.ingress_rows(tel.received(log)).where("ingress_ms > e2e_ms")
    assert both.count() == 0


def test_replica_seconds_add_up(spark):
    steps = ana.step_series(X.scaling_log(spark, SF))
    whole = {r.stage: r.replica_s for r in ana.replica_seconds(steps).collect()}
    cut = lambda low, high: steps.withColumns({"t_s": F.greatest("t_s", F.lit(low)), "until": F.least("until", F.lit(high))})
    halves = [{r.stage: r.replica_s for r in ana.replica_seconds(cut(a, b)).collect()} for a, b in ((0.0, 30.0), (30.0, 60.0))]
    assert all(abs(whole[s] - halves[0][s] - halves[1][s]) < 1e-6 for s in whole)


@FEW
@given(st.lists(st.tuples(st.integers(0, 2), st.floats(-1e6, 1e6), st.integers(1, 4)), min_size=1, max_size=60))
def test_linear_quantiles_are_those_of_numpy(spark, rows):
    import numpy as np

    df = spark.createDataFrame(rows, "g int, v double, w int").repartition(3)
    points = {"a": 0.0, "b": 0.5, "c": 0.95, "d": 1.0}
    for weight in (None, "w"):
        got = {r.g: [r[k] for k in points] for r in linear_quantiles(df, "v", points, ["g"], weight).collect()}
        for g in {r[0] for r in rows}:
            own = [v for a, v, w in rows if a == g for _ in range(w if weight else 1)]
            assert np.allclose(got[g], np.quantile(own, list(points.values())), rtol=1e-9, atol=1e-9)


@FEW
@given(st.lists(st.tuples(st.sampled_from("ab"), st.floats(0, 20) | st.integers(0, 20).map(float)), min_size=1, max_size=50), st.sets(st.integers(-3, 23), min_size=1, max_size=17))
def test_cdf_on_a_grid_against_a_search(spark, rows, points):
    df, grid = spark.createDataFrame(rows, "run string, v double"), spark.createDataFrame([(float(x),) for x in points], "x double")
    got = {(r.run, r.x): r.y for r in ana.cdf_on_grid(df, "run", "v", grid).collect()}
    assert len(got) == len({r for r, _ in rows}) * len(points)
    for (run, x), y in got.items():
        v = sorted(b for a, b in rows if a == run)
        n, below, above = len(v), [i for i, u in enumerate(v) if u <= x], [i for i, u in enumerate(v) if u > x]
        if not below:
            told = 0.0
        elif v[below[-1]] == x:
            told = (below[-1] + 1) / n
        elif not above:
            told = 1.0
        else:
            (x0, y0), (x1, y1) = (v[below[-1]], (below[-1] + 1) / n), (v[above[0]], (above[0] + 1) / n)
            told = y0 + (y1 - y0) * (x - x0) / (x1 - x0)
        assert abs(y - told) < 1e-9


@FEW
@given(st.lists(st.tuples(st.sampled_from([0.0, 1.0, 2.5]), st.integers(-5, 5)), min_size=1, max_size=80))
def test_running_sums(spark, rows):
    numbered = [(t, i, d) for i, (t, d) in enumerate(rows)]
    got = running_sum(spark.createDataFrame(numbered, "t double, i int, d int").repartition(4), ["t", "i"], "d", "sum").collect()
    total, told = 0, {}
    for _, i, d in sorted(numbered):
        total += d
        told[i] = total
    assert {r.i: r["sum"] for r in got} == told


@FEW
@given(st.lists(st.integers(0, 60), max_size=25), st.lists(st.integers(0, 60), max_size=25))
def test_nearest_match_against_a_search(spark, runs, logs):
    a = [(i, t / 7) for i, t in enumerate(runs)]
    b = [(100 + i, t / 7) for i, t in enumerate(logs)]
    found = ana.nearest_match(spark.createDataFrame(a, "k long, t_s double"), spark.createDataFrame(b, "log_id long, t_s double"), 1.0, "k").collect()
    told = {}
    for k, t in a:
        near = [(abs(u - t), u, i) for i, u in b if abs(u - t) < 1.0]
        if near:
            told[k] = min(near)[2]
    got = {r.k: r.log_id for r in found}
    assert got.keys() == told.keys() and all(abs(dict(b)[got[k]] - dict(a)[k]) <= abs(dict(b)[told[k]] - dict(a)[k]) + 1e-12 for k in told)


def test_stages_keep_every_event(spark):
    reading, sample = X.reading(spark, SF), X.sensor_sample(spark, SF)
    for df in (stages.normalize(reading), stages.detect(reading), stages.tombstone(reading, "value > 10", "r"), signal.denoise(sample), signal.featurize(sample)):
        assert df.count() == 1000


def test_running_totals_end_at_the_sum(spark):
    rows = X.events(spark, SF).selectExpr("event_id AS ord", "event_type AS stage", "floor(value) AS v")
    last = ana.latest_sum(rows, "stage", "ord", "v").orderBy(F.desc("ord")).first().total
    assert last == sum(r.v for r in rows.groupBy("stage").agg(F.max_by("v", "ord").alias("v")).collect())


def test_bootstrap_surrounds_the_median(spark):
    rows = X.events(spark, SF).select(F.col("event_type").alias("stage"), "event_id", "value")
    found = ana.bootstrap_medians(rows, ["stage"], "value", 40).join(rows.groupBy("stage").agg(F.percentile("value", 0.5).alias("m")), "stage").collect()
    assert found and all(r.low <= r.m <= r.high for r in found)


@given(st.lists(st.binary(max_size=5000), min_size=1, max_size=8))
@settings(max_examples=20, deadline=None)
def test_blake3_side_by_side_is_as_alone(messages):
    assert blake3_hexes(messages) == [blake3_hex(m) for m in messages]


@given(st.binary(max_size=3000))
@settings(max_examples=20, deadline=None)
def test_blake3_tells_inputs_apart(data):
    assert len(blake3_hex(data)) == 64 and blake3_hex(data) != blake3_hex(data + b"\0")


def test_resampling_reaches_the_tables_end(spark):
    from streamstage.plans import registry

    sf = "/root/testdata/sf0.1"
    last = spark.read.parquet(f"{sf}/events.parquet").agg({"event_id": "max"}).first()[0] * 5e-2
    at = registry.QUERIES["asof_step_resample"](spark, sf).toPandas()
    assert last > 600 and (at.groupby("stage").t_s.max() == round(last, 6)).all() and (at.groupby("stage").t_s.nunique() == 600).all()


def test_durations_are_the_tables(spark):
    from streamstage.plans import registry

    sf = "/root/testdata/sf0.1"
    last = spark.read.parquet(f"{sf}/events.parquet").agg({"event_id": "max"}).first()[0] * 5e-2
    made = {n: registry.QUERIES[f"ana_{n}"](spark, sf).toPandas() for n in ("latency_timeseries", "step_series", "replica_seconds", "savings")}
    assert len(made["latency_timeseries"]) == round(last) and made["latency_timeseries"].p50.notna().all()
    assert (made["step_series"].until >= made["step_series"].t_s).all() and made["step_series"].until.max() == round(last, 6)
    assert made["replica_seconds"].avg_replicas.between(1, 6).all() and made["savings"].saved_pct.between(0, 100).all()


def test_nearest_match_leaves_no_row_out(spark):
    from streamstage.plans import registry

    rows = [(r.event_id, r.event_type) for r in spark.read.parquet(f"{SF}/events.parquet").select("event_id", "event_type").collect()]
    others = [i for i, kind in rows if kind != "view"]
    got = {r.ord: r for r in registry.QUERIES["asof_nearest"](spark, SF).collect()}
    for i, kind in rows:
        least = min(abs(j - i) for j in others)
        assert (i in got) == (kind == "view" and least < 20) and (i not in got or abs(got[i].log_id - i) == least)


def test_positional_join_holds_every_row(spark):
    from streamstage.plans import registry

    got = registry.QUERIES["join_full_outer_positional"](spark, SF).toPandas()
    assert got.cpu.notna().sum() + got.rss.notna().sum() == spark.read.parquet(f"{SF}/events.parquet").count()
