"""Windows over dense series, by hand-computed values and a step-by-step loop."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.operators import graph, series


def make(spark, values, node=0):
    return spark.createDataFrame([(node, t, float(v)) for t, v in enumerate(values)], "node_id long, t int, rain double")


def column(df, name):
    return [r[name] for r in df.orderBy("node_id", "t").collect()]


def test_trailing_sum(spark):
    got = column(series.trailing_sum(make(spark, range(1, 9))), "cum")
    assert got == [None] * 6 + [21.0, 27.0]


def test_trailing_mean(spark):
    assert column(series.trailing_mean(make(spark, range(5)), 2), "ant") == [0, 0, 0.5, 1.5, 2.5]


def test_long_lags(spark):
    df = series.lags(make(spark, range(25)), series.LONG_LAGS, "x")
    assert column(df, "x")[24] == [0, 2, 4, 6, 8, 10, 12, 14, 16, 18, 20, 23]
    assert column(series.lags(make(spark, range(25)), series.STRIDED_LAGS, "x"), "x")[24] == list(range(0, 23, 2))
    assert column(series.lags(make(spark, range(4)), series.SHORT_LAGS, "x"), "x")[2] == [0, 0, 0, 0, 0, 1]


def test_decay(spark):
    got = column(series.decaying_max(make(spark, [1, 0, 0, 0, 0, 0]), "rain"), "state")
    assert np.allclose(got, [1, 0.840896, 0.707107, 0.594604, 0.5, 0.420448], atol=1e-6)


def test_decay_of_a_long_series(spark):
    rng = np.random.default_rng(1)
    v = rng.random(9000) * (rng.random(9000) < 0.01)
    want, a = [], 0.0
    for x in v:
        a = max(a * 0.5 ** (1 / 4), x)
        want.append(a)
    assert np.allclose(column(series.decaying_max(make(spark, v), "rain"), "state"), want, atol=1e-9)


def test_coherence(spark):
    df = make(spark, [1, 1, 1, 0, 1, 1]).withColumn("y", F.col("rain").cast("int"))
    assert column(series.coherent(df, "y"), "label") == [0, 0, 1, 0, 0, 1]


def test_leads_are_clamped(spark):
    df = series.leads(make(spark, range(10)), "rain", (1, 3))
    assert column(df, "y_1") == [1, 2, 3, 4, 5, 6, 7, 8, 9, 9]
    assert column(df, "y_3") == [3, 4, 5, 6, 7, 8, 9, 9, 9, 9]


def test_valid_steps(spark):
    assert series.valid_steps(make(spark, range(840))).count() == 804


@pytest.mark.parametrize("n,train,val,added,want", [(804, 0.85, 0.075, False, (683, 60, 61)), (10, 0.7, 0.1, True, (7, 1, 2))])
def test_split(spark, n, train, val, added, want):
    df = spark.range(n).withColumn("s", series.chronological_split(F.col("id"), F.lit(n), train, val, added))
    got = {r["s"]: r["count"] for r in df.groupBy("s").count().collect()}
    assert (got["train"], got["val"], got["test"]) == want
    last = df.groupBy("s").agg(F.min("id").alias("a"), F.max("id").alias("b")).collect()
    ends = {r["s"]: (r["a"], r["b"]) for r in last}
    assert ends["train"][1] < ends["val"][0] and ends["val"][1] < ends["test"][0]


@pytest.mark.parametrize(("sigma", "n"), [(1.5, 40), (3.0, 40), (1.5, 5), (3.0, 1), (3.0, 2), (3.0, 11), (3.0, 13)])
def test_smoothing_reflects(spark, sigma, n):
    v = np.random.default_rng(2).random(n)
    kernel = series.smooth_kernel(sigma)
    fold = lambda p: v[p % (2 * n)] if p % (2 * n) < n else v[2 * n - 1 - p % (2 * n)]
    want = [sum(w * fold(t + k) for k, w in kernel) for t in range(n)]
    assert np.allclose(column(series.gaussian_smooth(make(spark, v), sigma), "smooth"), want)


def test_dense_spine_has_every_hour(spark):
    rows = [(1, "2024-01-01 00:30:00", 2.0), (1, "2024-01-01 00:40:00", 1.0), (2, "2024-01-01 03:00:00", 4.0)]
    raw = spark.createDataFrame(rows, "user_id long, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = series.dense(series.hourly(raw, "user_id", "ts", "value"))
    assert column(got, "rain") == [3, 0, 0, 0, 0, 0, 0, 4]
    assert got.schema["ts"].dataType.simpleString() == "timestamp_ntz"


def test_dense_rows_are_not_shuffled(spark):
    """Hours are dealt by node before they are spread out; windows and lookups by node take them as they lie."""
    hours = spark.range(60).selectExpr("id % 7 AS node_id", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, id) AS ts", "1.0D AS rain")
    with_wide = series.coherent(series.decaying_max(series.trailing_sum(series.dense(hours), 24), "cum").withColumn("wet", F.lit(1)), "wet")
    plan = with_wide._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate") == 1 and "hashpartitioning" not in plan[: plan.index("Generate")]


def test_dense_of_odd_rows(spark):
    """Nodes without an hour have all of them, dry; so does a missing node; a repeated hour stays repeated."""
    rows = [(1, "2024-01-01 01:00:00", 2.0), (1, "2024-01-01 01:00:00", 3.0), (2, None, 7.0), (3, "2024-01-01 03:00:00", None), (3, None, 8.0), (None, "2024-01-01 00:00:00", 9.0)]
    hours = spark.createDataFrame(rows, "node_id long, ts string, rain double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = sorted((r.node_id or 0, r.t, r.rain) for r in series.dense(hours).collect())
    assert got == [(0, t, 0.0) for t in range(4)] + [(1, 0, 0.0), (1, 1, 2.0), (1, 1, 3.0), (1, 2, 0.0), (1, 3, 0.0)] + [(v, t, 0.0) for v in (2, 3) for t in range(4)]
    assert series.dense(hours.limit(0)).count() == 0


def test_normaliser_is_one_at_least(spark):
    assert series.positive_percentile(make(spark, [0, 0.1])).first()[0] == 1.0
    assert series.positive_percentile(make(spark, [0, 0])).first()[0] == 1.0
    v = np.random.default_rng(3).random(101) * 50
    assert np.isclose(series.positive_percentile(make(spark, v)).first()[0], np.percentile(v[v > 0], 95))


def test_propagation_goes_on_where_all_is_dry(spark, monkeypatch):
    """One trigger on a chain of nodes: it arrives everywhere, and rounds are as many as its hops."""
    rounds, written = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: rounds.append(name) or written(df, name))
    df = spark.createDataFrame([(v, t, 1.0 if (v, t) == (0, 0) else 0.0) for v in range(25) for t in range(40)], "node_id long, t int, rain double")
    edges = spark.createDataFrame([(v, v + 1) for v in range(24)] + [(3, 99)], "u long, v long")
    got = {(r.node_id, r.t): r.p for r in graph.propagate(df, edges, "rain").collect()}
    assert rounds.count("front") == 25
    assert all(np.isclose(x, 0.9**v * 0.5 ** ((t - v) / 4) if t >= v else 0.0, atol=1e-6) for (v, t), x in got.items())


def test_propagation_by_hand(spark):
    df = make(spark, [1, 0, 0], 0).unionByName(make(spark, [0, 0, 0], 1))
    edges = spark.createDataFrame([(0, 1)], "u long, v long")
    got = {(r.node_id, r.t): r.p for r in graph.propagate(df, edges, "rain").collect()}
    assert got[1, 0] == 0 and np.isclose(got[1, 1], 0.9) and np.isclose(got[1, 2], 0.756807, atol=1e-6)


@pytest.mark.parametrize("both", [False, True])
def test_propagation_equals_a_loop(spark, both):
    rng = np.random.default_rng(4)
    n, hours = 12, 60
    trig = rng.random((hours, n)) * (rng.random((hours, n)) < 0.08) + 0.02 * rng.random((hours, n))
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, n, (20, 2)) if a != b}
    pairs |= {(b, a) for a, b in pairs} if both else set()
    p = np.zeros((hours, n))
    for t in range(hours):
        before = p[t - 1] if t else np.zeros(n)
        p[t] = np.maximum(before * 0.5**0.25, trig[t])
        for u, v in pairs:
            p[t, v] = max(p[t, v], 0.9 * before[u])
    df = spark.createDataFrame([(v, t, float(trig[t, v])) for t in range(hours) for v in range(n)], "node_id long, t int, rain double")
    edges = spark.createDataFrame(sorted(pairs), "u long, v long")
    found = graph.propagate(df, edges, "rain").collect()
    assert len(found) == hours * n and all(np.isclose(r.p, p[r.t, r.node_id], atol=1e-6) for r in found)


def test_early_stopping(spark):
    scores = [0.1, 0.3, 0.2, 0.3, 0.25, 0.4, 0.1, 0.1, 0.1]
    df = spark.createDataFrame(list(enumerate(scores)), "epoch int, score double")
    got = series.early_stopping(df, "score", 3).orderBy("epoch").collect()
    assert [r.since for r in got] == [0, 0, 1, 2, 3, 0, 1, 2, 3]
    assert [r.stopped for r in got] == [False] * 4 + [True] * 5


def test_columns_of_any_name_pass_through(spark):
    df = make(spark, range(200)).withColumns({c: F.lit("x") for c in ("_top", "_block", "_rest", "_end", "_n", "_at", "_by", "_last")})
    own = series.gaussian_smooth(series.valid_steps(series.antecedent(df, 30)), 1.5)
    assert {*df.columns, "ant", "smooth"} == set(own.columns) and own.filter("_top = 'x' AND _at = 'x' AND _n = 'x'").count() == 200 - 36
    assert series.permuted(df, ["t"]).filter("_by = 'x'").count() == 200 and series.sampled(df, ["t"], 7).filter("_by = 'x'").count() == 7


@pytest.mark.parametrize("hours", [6, 12, 24, 50, 120])
def test_long_windows_forget(spark, hours):
    """Large values and NaN go with their hour: no later window holds a trace of them."""
    v = np.full(300, 0.1)
    v[3], v[20], v[40] = 1e16, np.nan, 1e16
    got = {r.t: r.ant for r in series.trailing_mean(make(spark, v), hours).collect()}
    for t in range(300):
        want = v[t - hours : t].mean() if t >= hours else 0.0
        assert np.isclose(got[t], want, equal_nan=True), t
