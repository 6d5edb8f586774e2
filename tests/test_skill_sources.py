"""Skill scores, risk tables, readers, writers and streams, by hand-computed values."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.functions import maths, risk, spectral
from tidegrid.operators import features, metrics, report, scale
from tidegrid.sources import sinks, tables
from tidegrid.sources.config import RunConfig
from tidegrid.streaming import series as streams

PAIRS = [(0.9, 1), (0.5, 0), (0.4, 1), (0.1, 0)]


def scored(spark, pairs):
    return spark.createDataFrame([(float(p), int(y)) for p, y in pairs], "p double, y int")


def test_confusion(spark):
    r = metrics.skill(metrics.confusion(scored(spark, PAIRS))).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (1, 1, 1, 1)
    assert np.allclose([r.f1, r.csi, r.far, r.brier], [0.5, 1 / 3, 0.5, 0.1575], atol=1e-6)
    none = metrics.skill(metrics.confusion(scored(spark, [(0.1, 0)])), floor_one=True).first()
    assert (none.f1, none.csi, none.precision) == (0, 0, 0)


def test_areas(spark):
    assert metrics.auroc(scored(spark, PAIRS)).first()[0] == 0.75
    assert np.isclose(metrics.average_precision(scored(spark, PAIRS)).first()[0], 0.833333, atol=1e-6)
    assert metrics.auroc(scored(spark, [(0.3, 1), (0.2, 1)])).first()[0] == 0.5
    assert metrics.average_precision(scored(spark, [(0.3, 0), (0.2, 0)])).first()[0] == 0.0
    rng = np.random.default_rng(0)
    y, p = rng.integers(0, 2, 200), np.round(rng.random(200), 1)
    pos, neg = p[y == 1], p[y == 0]
    want = ((pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean())
    assert np.isclose(metrics.auroc(scored(spark, zip(p, y))).first()[0], want)


def test_calibration(spark):
    assert np.isclose(metrics.expected_calibration_error(scored(spark, [(0.05, 0), (0.95, 1), (1.0, 1)])).first()[0], 0.033333, atol=1e-6)
    counts = [r.n for r in metrics.histogram(scored(spark, [(0.0, 0), (1.0, 1), (0.999, 1)])).orderBy("bin").collect()]
    assert counts[0] == 1 and counts[19] == 2 and len(counts) == 20


def test_losses(spark):
    df = scored(spark, [(1.0, 1), (1.0, 0), (0.0, 1)])
    assert np.isclose(metrics.focal_tversky(df).first()["loss"], 0.594604, atol=1e-6)
    one = spark.range(1).select(metrics.log_loss(F.lit(0.5), F.lit(1.0)).alias("a"), metrics.focal_loss(F.lit(0.5), F.lit(1)).alias("b")).first()
    assert np.isclose(one.a, 5 * np.log(2)) and np.isclose(one.b, 0.25 * 0.25 * np.log(2))


def test_spread_of_samples(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.4)], "node_id long, p double")
    r = metrics.mean_and_spread(df, ["node_id"]).first()
    assert np.allclose([r["mean"], r["std"], r["std_pop"]], [0.3, 0.141421, 0.1], atol=1e-6)


def test_risk_bands(spark):
    df = spark.createDataFrame([(x,) for x in (0.2999, 0.30, 0.50, 0.70, 1.0, None)], "p double")
    got = [r.b.label if r.b else None for r in df.select(risk.risk_band(F.col("p")).alias("b")).collect()]
    assert got == ["Low Risk", "Moderate Risk", "High Risk", "Very High Risk", "Very High Risk", None]
    level = [r.l for r in df.na.drop().select(risk.risk_level(F.col("p")).alias("l")).collect()]
    assert level == [0, 1, 1, 2, 4]


def test_top_nodes_break_ties_by_id(spark):
    df = spark.createDataFrame([(k, 0.5 if k % 2 else 0.9) for k in range(50)], "node_id long, p_mean double")
    got = report.top_nodes(df, 27).orderBy("rank").collect()
    assert [r.node_id for r in got] == [*range(0, 50, 2), 1, 3]
    assert [r["rank"] for r in got] == list(range(1, 28))


def test_indices(spark):
    one = spark.range(1)
    assert one.select(spectral.normalised_difference(F.lit(5e-10), F.lit(5e-10))).first()[0] is None
    assert np.isclose(one.select(spectral.imperviousness(F.lit(0.2), F.lit(0.5))).first()[0], 0.45)
    assert one.select(spectral.imperviousness(F.lit(float("nan")), F.lit(0.5))).first()[0] == 0.0


def test_scaling(spark):
    df = spark.createDataFrame([(1.0, 5.0, 1.0), (2.0, 5.0, None), (3.0, 5.0, 3.0), (None, 5.0, 10.0)], "a double, b double, c double")
    assert sorted(r.b_mm for r in scale.min_max(df, ["b"]).collect()) == [0, 0, 0, 0]
    assert np.allclose([r.a_z for r in scale.z_score(df.na.drop(subset=["a"]), ["a"]).orderBy("a").collect()], [-1.224745, 0, 1.224745], atol=1e-6)
    assert sorted(r.c for r in scale.median_impute(df, ["c"]).collect()) == [1, 3, 3, 10]
    assert [r.a for r in scale.median_impute(spark.createDataFrame([(None,)], "a double"), ["a"]).collect()] == [0.0]


def test_scenario_window(spark):
    nodes = spark.createDataFrame([(1, 0.5, 0.5)], "node_id long, lat01 double, lon01 double")
    sc = spark.createDataFrame([("x", 10.0, 2.0, 24.0, "uniform")], "name string, intensity double, duration double, antecedent double, pattern string")
    r = features.scenario_rain(nodes, sc, 5.0).first()
    assert r.short == [0, 0, 0, 0, 2, 2] and r.long == [0.2] * 11 + [2.0]


# --- readers and writers ------------------------------------------------------------------------------------


def test_archive_csv(spark, tmp_path):
    head = "ID,GlideNumber,Country,OtherCountry,Long,Lat,Area,Began,Ended,Validation,Dead,Displaced,MainCause,Severity\n"
    body = "7,0,INDIA,,80.1,13.0,1.5,2015-11-01,2015-12-05,News,1,2,Pluie \xe9,2\n8,0,,,80.1,13.0,1.5,not a date,2015-12-05,News,1,2,Rain,1\n9,0,india,,80.1,13.0,oops,2016-01-01,2015-12-05,News,1,2,Rain,1\n10,0,India,,99.0,13.0,1.0,1999-01-01,2015-12-05,News,1,2,Rain,1\n11,0,India\n12,0,India,,99.0,13.0,1.0,1999-01-01,2015-12-05,News,1,2,Rain,1,more\n"
    (tmp_path / "a.csv").write_bytes((head + body).encode("latin-1"))
    df = tables.flood_archive(spark, str(tmp_path / "a.csv"))
    assert {r.ID for r in df.collect()} == {"7", "8", "9", "10"} and df.select("ID").count() == df.count()
    kept = tables.since(tables.of_country(df, "India"), 2000)
    assert {(r.ID, r.MainCause, r.Area) for r in kept.collect()} == {("7", "Pluie é", 1.5), ("9", "Rain", None)}
    merged = tables.merge_events(tables.known_events(spark), kept).collect()
    own = len(tables.KNOWN_EVENTS)
    assert len(merged) == own + 2 and {r.name for r in merged[own:]} == {"DFO-7", "DFO-9"} and merged[-1].peak_mm_day is None
    (tmp_path / "k.csv").write_text("name,began,ended,severity,lat,lon,peak_mm_day\nmine,2020-01-01,2020-01-02,1,13.0,80.2,9.5\n")
    assert [(r.name, r.peak_mm_day) for r in tables.known_events(spark, str(tmp_path / "k.csv")).collect()] == [("mine", 9.5)]
    (tmp_path / "s.csv").write_text("name,intensity,duration,antecedent,pattern\nmine,4,5,6,uniform\n")
    assert [tuple(r) for r in tables.scenarios(spark, str(tmp_path / "s.csv")).collect()] == [("mine", 4.0, 5.0, 6.0, "uniform")]
    assert tables.of_country(spark.range(3), "x").count() == 3


def test_rain_csv(spark, tmp_path):
    (tmp_path / "r.csv").write_text("timestamp,lat,lon,rainfall_mm_hr\n2015-11-01 00:00:00,13,80,1.5\n2015-11-03 00:00:00,13,80,2\n2015-11-09 00:00:00,13,80,3\n")
    got = tables.rain_grid(spark, str(tmp_path / "r.csv"), "2015-11-01 00:00:00", "2015-11-03 00:00:00")
    assert got.count() == 2 and got.schema["timestamp"].dataType.simpleString() == "timestamp_ntz"


def test_node_defaults(spark):
    r = tables.node_records(spark.createDataFrame([(4, None)], "node_id long, x double")).first()
    assert (r.osmid, r.lon, r.lat) == (4, 0.0, 0.0)


def test_versioned_cache(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for version in ("1", "1", "2"):
        assert sinks.cached(spark, str(tmp_path / "c"), version, make).count() == 3
    assert len(made) == 2


def test_models_that_fail_are_gaps(spark):
    df = spark.createDataFrame([(0.9, 1), (0.2, 0), (0.6, 0)], "p double, y int")

    def broken():
        raise ValueError("no weights")

    got = {r.model: r for r in metrics.compare_models(spark, {"a": lambda: df, "b": broken, "c": lambda: df.select("missing")}).collect()}
    assert (got["a"].tp, got["a"].fp, got["a"].auroc, got["a"].error) == (1, 1, 1.0, None)
    assert got["b"].tp is None and got["b"].error == "ValueError: no weights" and got["c"].f1 is None and "missing" in got["c"].error


def test_a_half_written_version_is_not_read(spark, tmp_path):
    """A folder whose writer died, and a manifest whose writer died before it had a name in it."""
    at = tmp_path / "c" / "version=1"
    spark.range(9).write.parquet(str(at / "table-dead"))
    assert sinks.cached(spark, str(tmp_path / "c"), "1", lambda: spark.range(3)).count() == 3
    (tmp_path / "d" / "version=1").mkdir(parents=True)
    (tmp_path / "d" / "version=1" / "CURRENT").write_text("table-x")
    assert sinks.cached(spark, str(tmp_path / "d"), "1", lambda: spark.range(4)).count() == 4
    assert sinks.cached(spark, str(tmp_path / "d"), "1", lambda: spark.range(5)).count() == 4


def test_of_two_makers_the_first_counts(spark, tmp_path):
    path = str(tmp_path / "c")

    def slow():
        assert sinks.cached(spark, path, "1", lambda: spark.range(7)).count() == 7  # another is done meanwhile
        return spark.range(3)

    assert sinks.cached(spark, path, "1", slow).count() == 7
    assert len(list((tmp_path / "c" / "version=1").glob("table-*"))) == 1


def test_metric_state_by_batch(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(float(round(p, 2)), int(rng.random() < p), k % 3, "ab"[k % 2]) for k, p in enumerate(rng.random(600))]
    df = spark.createDataFrame(rows, "p double, y int, batch int, lead string")
    for by in ((), ("lead",)):
        state = metrics.MetricState(spark, str(tmp_path / f"s{len(by)}"), by)
        for b in (0, 1, 2, 1):  # a batch that is run again replaces itself
            state.update(df.filter(f"batch = {b}"), b)
        got = {tuple(r[c] for c in by): r for r in state.compute().collect()}
        whole = metrics.skill(metrics.confusion(df, by))
        for want in (whole, metrics.auroc(df, by), metrics.average_precision(df, by)):
            for r in want.collect():
                assert all(np.isclose(got[tuple(r[c] for c in by)][c], r[c]) for c in want.columns if c not in by)
        state.reset()
        assert not (tmp_path / f"s{len(by)}").exists()


def test_geojson_and_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, 80.2, 13.0, 0.5)], "node_id long, lon double, lat double, p double")
    f = json.loads(sinks.features(df).first()[0])
    assert f == {"type": "Feature", "geometry": {"type": "Point", "coordinates": [80.2, 13.0]}, "properties": {"node_id": 1, "p": 0.5}}
    (tmp_path / "g.json").write_text(json.dumps({"type": "FeatureCollection", "features": [f]}))
    r = tables.geojson_points(spark, str(tmp_path / "g.json"), "node_id: bigint, p: double").first()
    assert (r.lon, r.lat, r.node_id, r.p) == (80.2, 13.0, 1, 0.5)
    sinks.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first()["p"] == "0.5"
    sinks.write_geojson_lines(df, str(tmp_path / "l"))
    sinks.write_json(df, str(tmp_path / "j"))
    sinks.write_events(df.withColumn("event", F.lit("a")), str(tmp_path / "e"), "event")
    assert spark.read.parquet(str(tmp_path / "e")).first()["event"] == "a"


def test_weights_round_trip(spark, tmp_path):
    from tidegrid.operators import gnn

    shapes = {"s1": (3, 4), "gs_b": (5,)}
    w = gnn.weights(shapes)
    sinks.write_weights(spark, w, str(tmp_path / "w"))
    got = sinks.read_weights(spark, str(tmp_path / "w"), shapes)
    assert all(np.array_equal(w[k], got[k]) for k in shapes)


def test_config():
    c = RunConfig()
    assert RunConfig.from_json(c.to_json()) == c
    for bad in ({"box": (81.0, 12.0, 80.0, 13.0)}, {"input_dim": 30}, {"split": (0.9, 0.2)}, {"rain_range": (5.0, 1.0)}):
        with pytest.raises(ValueError):
            RunConfig(**bad)
    with pytest.raises(ValueError):
        tables.in_box(None, 81, 12, 80, 13)


def test_splits_share_nothing(spark):
    df = spark.range(100).withColumn("s", F.when(F.col("id") < 85, "train").otherwise("test"))
    assert df.filter("s = 'train'").select("id").intersect(df.filter("s = 'test'").select("id")).isEmpty()


def test_config_files(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    assert RunConfig.load() == RunConfig() == RunConfig.load("nowhere.yaml")
    (tmp_path / "config.json").write_text('{"half_life": 3.0, "leads": [1, 2]}')
    assert RunConfig.load() == RunConfig(half_life=3.0, leads=(1, 2))
    (tmp_path / "config").mkdir()
    (tmp_path / "config" / "config.yaml").write_text("half_life: 2.0\nbox: [1.0, 2.0, 3.0, 4.0]\n")
    pytest.importorskip("yaml")
    assert RunConfig.load() == RunConfig(half_life=2.0, box=(1.0, 2.0, 3.0, 4.0))
    (tmp_path / "bad.yaml").write_text("no_such: 1\n")
    with pytest.raises(TypeError):
        RunConfig.load("bad.yaml")


def test_graph_is_read_with_its_features(spark, tmp_path):
    spark.createDataFrame([(0, 0, 80.2, 13.0, 0.0, 0.0), (1, 1, 80.2, 13.1, 0.0, 0.0)], tables.NODES).write.parquet(f"{tmp_path}/g/nodes")
    spark.createDataFrame([(0, 1, 0, 10.0, 1.0, 0.4), (1, 0, 0, 20.0, 0.0, 0.0)], tables.EDGES).write.parquet(f"{tmp_path}/g/edges")
    for _ in range(2):  # made, then read
        nodes, edges, found = tables.read_graph(spark, f"{tmp_path}/g")
        assert (nodes.count(), edges.count()) == (2, 2)
        assert {(r.u, r.v, r.elev_diff_norm, r.length_norm) for r in found.collect()} == {(0, 1, -1.0, 0.5), (1, 0, 1.0, 1.0)}


def test_small_helpers(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0, -3.0), (2, 5.0, 0.5)], "node_id long, a double, b double")
    assert {tuple(r) for r in tables.long_features(df, ["node_id"], ["a", "b"]).collect()} == {(1, "a", 2.0), (1, "b", -3.0), (2, "a", 5.0), (2, "b", 0.5)}
    assert [r.x for r in df.select(maths.relu(F.col("b")).alias("x")).collect()] == [0.0, 0.5]
    assert spark.range(1).select(tables.parse_box(F.lit("1, 2.5,3,4")).alias("x")).first().x == [1.0, 2.5, 3.0, 4.0]
    assert tables.problems(df, {"node_id": "bigint", "a": "string", "z": "int"}, ["node_id"]) == ["z: missing", "a: double, not string"]
    assert tables.problems(df.limit(0), {"a": "double"}) == ["no rows"]
    assert tables.problems(df.selectExpr("nullif(node_id, 1) k"), {}, ["k"]) == ["k: 1 nulls"]
    (tmp_path / "h.csv").write_text("epoch,train_loss,val_loss,val_f1\n1,0.5,0.6,0.04\n2,0.4,0.5,0.3\n")
    told = tables.history(spark, str(tmp_path / "h.csv"))
    assert report.usable(told) and not report.usable(told.filter("epoch = 1")) and not report.usable(told.limit(0))
    (tmp_path / "p.csv").write_text("lead_hours,prob,label\n3,0.25,1\n")
    assert [tuple(r) for r in tables.scored_pairs(spark, str(tmp_path / "p.csv")).collect()] == [(3, 0.25, 1)]
    df.write.parquet(str(tmp_path / "c" / "version=1"))
    sinks.purge(str(tmp_path / "c"))
    sinks.purge(str(tmp_path / "c"))
    assert not (tmp_path / "c").exists()
    assert isinstance(spark.range(1).select(risk.as_uncertainty(F.lit(0.123456)).alias("x")).first().x, str)


def test_no_positives_gives_zeros(spark):
    rows = spark.createDataFrame([(0.9, 0), (0.2, 0)], "p double, y int")
    r = metrics.skill(metrics.confusion(rows), floor_one=True).first()
    assert (r.precision, r.recall, r.csi, r.f1, r.far) == (0.0, 0.0, 0.0, 0.0, 1.0)


def test_readiness_gates(spark):
    row = lambda f1, csi=0.6: spark.createDataFrame([(f1, 0.9, csi, 0.7, 0.5, 0.15)], "f1 double, auroc double, csi double, pod double, far double, ece double")
    got = lambda *x: {r.metric: r.status for r in metrics.readiness(*x).collect()}
    want = {"f1": "PASS", "auroc": "PASS", "csi": "PASS", "pod": "PASS", "far": "WARN", "ece": "WARN"}
    assert got(row(0.8), row(0.55), row(0.79), row(0.6)) == want | {"f1_drop": "WARN", "over_baselines": "PASS", "event_drop": "WARN"}
    assert got(row(0.8), row(0.79), row(0.81, 0.5), row(0.7)) == want | {"f1_drop": "PASS", "over_baselines": "PASS", "event_drop": "PASS"}
    assert got(row(0.8), row(0.2), row(0.81, 0.7), row(0.2)) == want | {"f1_drop": "FAIL", "over_baselines": "FAIL", "event_drop": "FAIL"}
    assert got(row(0.8), row(0.79), row(0.1).limit(0), row(0.1).limit(0)) == want | {"f1_drop": "PASS"}


# --- streams ------------------------------------------------------------------------------------------------


@pytest.fixture
def stream(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", 1, 1.0), ("2024-01-01 04:10:00", 1, 0.2), ("2024-01-01 08:10:00", 1, 0.9), ("2024-01-01 01:10:00", 2, 4.0)]
    df = spark.createDataFrame(rows, "ts string, node_id long, rain double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))


def test_sliding_sum_stream(spark, stream, tmp_path):
    streams.run_once(streams.sliding_sum(stream), "sliding", str(tmp_path / "c1"), "complete")
    got = {(r.node_id, str(r.end)[11:13]): r.cum for r in spark.table("sliding").collect()}
    assert np.isclose(got[1, "06"], 1.2) and np.isclose(got[1, "09"], 1.1) and got[2, "02"] == 4.0


def test_decaying_state_stream(spark, stream, tmp_path):
    streams.run_once(streams.decaying_state(stream), "decaying", str(tmp_path / "c2"))
    got = [r.state for r in spark.table("decaying").filter("node_id = 1").orderBy("ts").collect()]
    assert np.allclose(got, [1.0, 0.5, 0.9])


def test_model_table_makes_its_test_steps_once(spark, sf, monkeypatch):
    from tidegrid.operators import graph
    from tidegrid.plans import skill_queries

    made = []
    kept = lambda df, name: (made.append((name, found := graph.written(df, name))), found)[1]
    monkeypatch.setattr(skill_queries, "written", kept)
    rows = {r.model: r for r in skill_queries.model_table(spark, sf).collect()}
    test = [df for name, df in made if name == "test"]
    assert len(test) == 1 and all(rows[m].error is None for m in ("random_forest", "recurrent", "older_network", "persistence")) and rows["unavailable"].error
    assert sum(rows["persistence"][c] for c in ("tp", "fp", "fn", "tn")) == test[0].count()
