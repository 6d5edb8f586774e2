"""Queries on hourly series (table events)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.operators import features, graph, scale, series
from tidegrid.plans.common import GRID, RAIN, grid_edges, grid_nodes, rain, settled, table
from tidegrid.sources import tables

#: Triggers have nine digits; halved again and again they lie on rounding borders of six, which this moves them off.
OFF_GRID = 3.7182e-10
W = "OVER (PARTITION BY node_id ORDER BY t ROWS BETWEEN {0} PRECEDING AND 1 PRECEDING)"
L = "OVER (PARTITION BY node_id ORDER BY t)"


def spine_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rain(spark, sf_dir)


def cum_rain_6h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.trailing_sum(rain(spark, sf_dir)).filter("t >= 6").select("node_id", "t", F.round("cum", 4).alias("cum"))


def rolling_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = series.trailing_sum(rain(spark, sf_dir)).withColumn("label", (F.coalesce(F.round("cum", 4), F.lit(0.0)) > 500).cast("int"))
    return own.groupBy("node_id").agg(F.sum("label").alias("n_labels"), F.count("*").alias("n_hours"))


def antecedent_120h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.antecedent(rain(spark, sf_dir)).select("node_id", "t", F.round("ant", 6).alias("ant"))


def rain_norm_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.positive_percentile(rain(spark, sf_dir)).select(F.round("rain_norm", 6).alias("rain_norm"))


def _columns(df: DataFrame, col: str, n: int) -> DataFrame:
    return df.select("node_id", "t", *[F.round(F.get(col, F.lit(k)), 6).alias(f"x{k}") for k in range(n)])


def short_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _columns(series.lags(rain(spark, sf_dir), series.SHORT_LAGS, "x"), "x", 6)


def long_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _columns(series.lags(rain(spark, sf_dir), series.LONG_LAGS, "x").filter("t >= 24"), "x", 12)


def strided_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lags of 24 to 2 hours by the largest rain of the last 24 hours over all nodes, at least 1."""
    own = rain(spark, sf_dir)
    from pyspark.sql import Window

    tops = own.groupBy("t").agg(F.max("rain").alias("top"))  # one row an hour
    tops = tops.withColumn("top", F.greatest(F.max("top").over(Window.orderBy("t").rowsBetween(-24, -1)), F.lit(1.0)))
    lagged = series.lags(own, series.STRIDED_LAGS, "x").filter("t >= 24").join(F.broadcast(tops), "t")
    return _columns(lagged.withColumn("x", F.transform("x", lambda v: v / F.col("top"))), "x", 12)


def window_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = series.trailing_mean(series.trailing_mean(rain(spark, sf_dir), 6, "m6"), 24, "m24")
    return own.filter("t >= 24").select("node_id", "t", F.round("m6", 6).alias("m6"), F.round("m24", 6).alias("m24"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rain(spark, sf_dir).withColumn("y", (F.col("rain") > 300).cast("int"))


def lead_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.valid_steps(series.leads(_labelled(spark, sf_dir), "y")).select("node_id", "t", "y_1", "y_3", "y_6", "y_12")


def decay_running_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.decaying_max(rain(spark, sf_dir), "rain", 4.0).select("node_id", "t", settled(F.col("state")).alias("state"))


def _thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold of each user from the customer of that key: relative balance as height; 100 to 1,000."""
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node_id"), F.col("c_acctbal").alias("b"))
    own = scale.min_max(own, ["b"])
    return own.select("node_id", features.flood_threshold(F.col("b_mm"), F.lit(0.5), F.lit(0.3), F.lit(0.2), F.lit(0.4), 100.0, 1000.0).alias("thr"))


THRESHOLDS = """
    cb AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer),
    thr AS (SELECT c_custkey AS node_id, least(greatest(exp(ln(100.0::DOUBLE) + (c_acctbal - lo) / (hi - lo) * ln(10.0::DOUBLE))
            * (1 - 0.25::DOUBLE * 0.5 - 0.18::DOUBLE * 0.3 + 0.10::DOUBLE * 0.2 + 0.15::DOUBLE * 0.4), 80.0::DOUBLE), 1000.0::DOUBLE) AS thr FROM customer, cb)"""


def _triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = series.antecedent(series.trailing_sum(rain(spark, sf_dir)))
    own = own.join(_thresholds(spark, sf_dir), "node_id", "left").withColumn("thr", F.coalesce("thr", F.lit(500.0)))
    p = series.trigger_probability(F.col("cum"), F.col("thr"), F.col("ant"), 50.0)
    return own.select("node_id", "t", F.when(F.col("t") >= 6, F.round(p, 9)).otherwise(0.0).alias("trig"))


TRIGGERS = f"""{RAIN}, {THRESHOLDS},
    w AS (SELECT node_id, t, sum(rain) {W.format(6)} AS cum, CASE WHEN t >= 120 THEN avg(rain) {W.format(120)} ELSE 0 END AS a FROM rain),
    top AS (SELECT greatest(max(a), 1.0::DOUBLE) AS top FROM w),
    trig AS (SELECT w.node_id, t, CASE WHEN t >= 6 THEN round(1 / (1 + exp(-(cum - coalesce(thr, 500.0::DOUBLE) * (1 - 0.30::DOUBLE * a / top)) / 50.0::DOUBLE)), 9) ELSE 0.0::DOUBLE END AS trig
             FROM w CROSS JOIN top LEFT JOIN thr ON thr.node_id = w.node_id)"""


def flood_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = series.decaying_max(_triggers(spark, sf_dir), "trig", 4.0, "p").withColumn("p", F.round(F.col("p") + OFF_GRID, 6)).withColumn("wet", (F.col("p") >= 0.5).cast("int"))
    return series.coherent(own, "wet").select("node_id", "t", "p", "wet", "label")


def flood_labels_propagated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As above, with the states of neighbours on a grid over the users (drainage edges alone): every hour and state."""
    own = _triggers(spark, sf_dir)
    edges = grid_edges(spark, sf_dir).filter("edge_type > 0.5").select("u", "v")
    found = graph.propagate(own, edges, "trig").withColumn("p", F.round(F.col("p") + OFF_GRID, 6))
    return series.coherent(found.withColumn("wet", (F.col("p") >= 0.5).cast("int")), "wet").select("node_id", "t", "p", "wet", "label")


def encoded_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users' series as one event: sums, wetness, states and labels by one function, thresholds by node."""
    own = rain(spark, sf_dir)
    thresholds = own.select("node_id").distinct().withColumn("threshold", 300.0 + F.col("node_id") % 5 * 50)
    found = series.encode_event(own, thresholds, scale=50.0)
    return found.select("node_id", "t", F.round("cum", 4).alias("cum"), F.round("ant", 6).alias("ant"), "p", "label")


def lagged_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of six hours with the label three hours on."""
    own = series.sequences(rain(spark, sf_dir).withColumn("y", (F.col("rain") > 300).cast("int")), "y")
    return own.select("node_id", "t", *[F.get("x", F.lit(k)).alias(f"x{k}") for k in range(6)], "y")


def permuted_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All users in an order of chance, and whether each is among a sample of ten."""
    users = rain(spark, sf_dir).select("node_id").distinct()
    picked = series.sampled(users, ["node_id"], 10, 7).withColumn("picked", F.lit(1))
    found = series.permuted(users, ["node_id"], 7).join(picked, "node_id", "left")
    return found.select("node_id", F.col("place").cast("long").alias("place"), F.coalesce("picked", F.lit(0)).alias("picked"))


def chrono_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = series.valid_steps(_labelled(spark, sf_dir)).withColumn("step", F.col("t") - 24)
    n = own.agg((F.max("step") + 1).alias("n"))
    part = series.chronological_split(F.col("step"), F.col("n"))
    return own.join(F.broadcast(n)).groupBy(part.alias("split")).agg(F.count_distinct("t").alias("steps"), F.round(F.avg("y"), 6).alias("rate"))


def chrono_split_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = rain(spark, sf_dir).select("t").distinct()
    n = own.agg((F.max("t") + 1).alias("n"))
    part = series.chronological_split(F.col("t"), F.col("n"), 0.7, 0.15, ends_added=True)
    return own.join(F.broadcast(n)).groupBy(part.alias("split")).agg(F.count("*").alias("steps"))


def gauss_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.gaussian_smooth(rain(spark, sf_dir), 1.5).select("node_id", "t", F.round("smooth", 4).alias("smooth"))


def gauss_smooth_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.gaussian_smooth(rain(spark, sf_dir), 3.0).select("node_id", "t", F.round("smooth", 4).alias("smooth"))


def gauss_smooth_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's first 1 to 30 hours, most of them fewer than the kernel's radius."""
    own = rain(spark, sf_dir).filter(F.col("t") <= F.col("node_id") % 30)
    return series.gaussian_smooth(own, 3.0).select("node_id", "t", F.round("smooth", 4).alias("smooth"))


def _gauss_sql(sigma: float, rows: str = "SELECT * FROM rain") -> str:
    kernel = ", ".join(f"({k}, {w!r}::DOUBLE)" for k, w in series.smooth_kernel(sigma))
    return f"""WITH {RAIN}, own AS ({rows}), k(o, w) AS (VALUES {kernel}), n AS (SELECT node_id, max(t) + 1 AS n FROM own GROUP BY node_id),
        m AS (SELECT own.node_id, t, w, n, ((t + o) % (2 * n) + 2 * n) % (2 * n) AS q FROM own JOIN n ON n.node_id = own.node_id, k),
        a AS (SELECT node_id, t, w, CASE WHEN q < n THEN q ELSE 2 * n - 1 - q END AS at FROM m)
        SELECT a.node_id, a.t, round(sum(a.w * own.rain), 4) AS smooth FROM a JOIN own ON own.node_id = a.node_id AND own.t = a.at GROUP BY ALL"""


def time_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = series.shift_by_node(rain(spark, sf_dir), (F.col("node_id") % 4 - 1) * 3, 0.8)
    return own.select("node_id", "t", F.round("shifted", 6).alias("shifted"))


def diurnal_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rain(spark, sf_dir).select("node_id", "t", settled(F.col("rain") * series.diurnal(F.col("t"))).alias("rain"))


def early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days as epochs, their mean rain as the score."""
    days = rain(spark, sf_dir).groupBy(F.floor(F.col("t") / 24).cast("int").alias("epoch")).agg(F.round(F.avg("rain"), 6).alias("score"))
    return series.early_stopping(days, "score", 5)


def snapshot_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums over the three parts of the whole input vector (16 static, 6 short, 12 long) of each valid step."""
    own = rain(spark, sf_dir)
    snap = series.valid_steps(series.snapshot(own, series.positive_percentile(own)))
    static = F.array(*[(F.col("node_id") * k % 16) / 16 for k in range(1, 17)])
    own = snap.select("node_id", "t", F.concat(static, "short", "long").alias("x"))
    total = lambda a, b: F.round(sum((F.get("x", F.lit(k)) for k in range(a, b)), F.lit(0.0)), 6)
    return own.select("node_id", "t", F.size("x").alias("width"), total(0, 16).alias("static"), total(16, 22).alias("short"), total(22, 34).alias("long"))


def storm_rain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic rain of the second event on the grid, by hour."""
    nodes = grid_nodes(spark, sf_dir).select("node_id", "lat", "lon")
    own = features.synthetic_rain(nodes, tables.storms(spark, "second"), 480, 0.5)
    return own.groupBy("t").agg(F.round(F.avg("rain"), 6).alias("mean_rain"), F.round(F.max("rain"), 6).alias("max_rain"))


def _storm_sql() -> str:
    k3, k15 = (", ".join(f"({k}, {w!r}::DOUBLE)" for k, w in series.smooth_kernel(s)) for s in (3.0, 1.5))
    storms = ", ".join(f"({a}, {b}, {p}::DOUBLE, {k}::DOUBLE)" for a, b, p, _, k in tables.STORMS_SECOND)
    return f"""WITH {GRID}, st(a, b, peak, skew) AS (VALUES {storms}), k3(o, w) AS (VALUES {k3}), k15(o, w) AS (VALUES {k15}),
        i AS (SELECT a, b - a AS n, t, peak * exp(-0.5::DOUBLE * pow((t - (b - a) * (0.5::DOUBLE + skew * 0.2::DOUBLE)) / ((b - a) / 4.0::DOUBLE), 2)) AS x FROM (SELECT *, unnest(range(0, b - a)) AS t FROM st)),
        j AS (SELECT a, n, t, w, CASE WHEN t + o < 0 THEN -(t + o) - 1 WHEN t + o >= n THEN 2 * n - 1 - (t + o) ELSE t + o END AS s FROM i, k3),
        sm AS (SELECT j.a + j.t AS t, sum(j.w * i.x) AS x FROM j JOIN i ON i.a = j.a AND i.t = j.s GROUP BY 1),
        sp AS (SELECT r.t - 24 AS t, coalesce(sm.x, 0) AS x FROM range(0, 528) AS r(t) LEFT JOIN sm ON sm.t = r.t - 24),
        q AS (SELECT t, w, CASE WHEN t + 24 + o < 0 THEN -(t + 24 + o) - 1 WHEN t + 24 + o >= 528 THEN 2 * 528 - 1 - (t + 24 + o) ELSE t + 24 + o END - 24 AS s FROM sp, k15),
        pulse AS (SELECT q.t, sum(q.w * sp.x) AS pulse FROM q JOIN sp ON sp.t = q.s GROUP BY 1),
        ns AS (SELECT min(lat) AS a, max(lat) AS b, avg(lat) AS c, min(lon) AS d, max(lon) AS e, avg(lon) AS f FROM nodes),
        nw AS (SELECT node_id, 1 + 0.30::DOUBLE * (1 - (lat - a) / (b - a)) + 0.10::DOUBLE * (1 - (lon - d) / (e - d)) AS w,
               CASE WHEN lon < f THEN CASE WHEN lat < ns.c THEN 10 ELSE 6 END ELSE CASE WHEN lat < ns.c THEN -4 ELSE 0 END END AS lag FROM nodes, ns),
        rr AS (SELECT CAST(h AS INTEGER) AS t, least(greatest((0.5::DOUBLE + coalesce(pulse, 0) * w) * (1 + 0.15::DOUBLE * sin(2 * pi() * (h % 24 - 18) / 24)), 0), 80.0::DOUBLE) AS rain
               FROM (SELECT *, unnest(range(0, 480)) AS h FROM nw) LEFT JOIN pulse ON pulse.t = h - lag)
        SELECT t, round(avg(rain), 6) AS mean_rain, round(max(rain), 6) AS max_rain FROM rr GROUP BY t"""


QUERIES = {
    f.__name__: f
    for f in (
        spine_fill, cum_rain_6h, rolling_label, antecedent_120h, rain_norm_p95, short_lags, long_lags, strided_lags, window_means, lead_targets, decay_running_max,
        flood_labels, flood_labels_propagated, encoded_event, lagged_sequences, permuted_steps, chrono_split, chrono_split_added, gauss_smooth, gauss_smooth_wide, gauss_smooth_short, time_shift, diurnal_cycle, early_stop, snapshot_windows, storm_rain,
    )
}

_lag = lambda k: f"lag(rain, {k}, 0.0::DOUBLE) {L}"

ORACLES = {
    "spine_fill": f"WITH {RAIN} SELECT node_id, t, ts, CAST(rain AS DOUBLE) AS rain FROM rain",
    "cum_rain_6h": f"WITH {RAIN} SELECT node_id, t, round(cum, 4) AS cum FROM (SELECT node_id, t, sum(rain) {W.format(6)} AS cum FROM rain) WHERE t >= 6",
    "rolling_label": f"""WITH {RAIN} SELECT node_id, CAST(sum(CASE WHEN t >= 6 AND round(cum, 4) > 500 THEN 1 ELSE 0 END) AS BIGINT) AS n_labels, count(*) AS n_hours
        FROM (SELECT node_id, t, sum(rain) {W.format(6)} AS cum FROM rain) GROUP BY node_id""",
    "antecedent_120h": f"""WITH {RAIN}, a AS (SELECT node_id, t, CASE WHEN t >= 120 THEN avg(rain) {W.format(120)} ELSE 0 END AS a FROM rain)
        SELECT node_id, t, round(a / (SELECT greatest(max(a), 1.0::DOUBLE) FROM a), 6) AS ant FROM a""",
    "rain_norm_p95": f"WITH {RAIN} SELECT round(greatest(quantile_cont(rain, 0.95), 1.0::DOUBLE), 6) AS rain_norm FROM rain WHERE rain > 0",
    "short_lags": f"WITH {RAIN} SELECT node_id, t, {', '.join(f'round({_lag(k)}, 6) AS x{i}' for i, k in enumerate(series.SHORT_LAGS))} FROM rain",
    "long_lags": f"WITH {RAIN} SELECT * FROM (SELECT node_id, t, {', '.join(f'round({_lag(k)}, 6) AS x{i}' for i, k in enumerate(series.LONG_LAGS))} FROM rain) WHERE t >= 24",
    "strided_lags": f"""WITH {RAIN}, m AS (SELECT t, greatest(max(top) OVER (ORDER BY t ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING), 1.0::DOUBLE) AS top FROM (SELECT t, max(rain) AS top FROM rain GROUP BY t)),
        l AS (SELECT node_id, t, {', '.join(f'{_lag(k)} AS y{i}' for i, k in enumerate(series.STRIDED_LAGS))} FROM rain)
        SELECT node_id, l.t, {', '.join(f'round(y{i} / top, 6) AS x{i}' for i in range(12))} FROM l JOIN m ON m.t = l.t WHERE l.t >= 24""",
    "window_means": f"WITH {RAIN} SELECT * FROM (SELECT node_id, t, round(avg(rain) {W.format(6)}, 6) AS m6, round(avg(rain) {W.format(24)}, 6) AS m24 FROM rain) WHERE t >= 24",
    "lead_targets": f"""WITH {RAIN}, y AS (SELECT node_id, t, CASE WHEN rain > 300 THEN 1 ELSE 0 END AS y FROM rain)
        SELECT node_id, t, y_1, y_3, y_6, y_12 FROM (SELECT node_id, t, {', '.join(f'lead(y, {h}) {L} AS y_{h}' for h in series.LEADS)}, max(t) OVER () AS last FROM y) WHERE t >= 24 AND t < last + 1 - 12""",
    "decay_running_max": f"""WITH {RAIN} SELECT a.node_id, a.t, round(max(b.rain * pow(0.5::DOUBLE, (a.t - b.t) / 4.0::DOUBLE)) + 1e-9, 6) AS state
        FROM rain a JOIN rain b ON b.node_id = a.node_id AND b.t <= a.t AND b.t > a.t - 200 GROUP BY ALL""",
    "flood_labels": f"""WITH {TRIGGERS}, p AS (SELECT a.node_id, a.t, round(max(b.trig * pow(0.5::DOUBLE, (a.t - b.t) / 4.0::DOUBLE)) + {OFF_GRID!r}, 6) AS p
            FROM trig a JOIN trig b ON b.node_id = a.node_id AND b.t <= a.t AND b.t > a.t - 200 GROUP BY ALL),
        y AS (SELECT *, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS wet FROM p)
        SELECT node_id, t, p, wet, CASE WHEN t >= 2 THEN wet * lag(wet) {L} ELSE 0 END AS label FROM y""",
    "flood_labels_propagated": f"""WITH RECURSIVE {TRIGGERS}, {GRID},
        links AS (SELECT u, v, 0.9::DOUBLE AS f FROM edges WHERE edge_type > 0.5 UNION ALL SELECT DISTINCT node_id, node_id, pow(0.5::DOUBLE, 0.25::DOUBLE) FROM rain),
        r(node_id, t, p) AS (SELECT node_id, t, trig FROM trig WHERE t = 0
            UNION ALL SELECT links.v, r.t + 1, greatest(max(r.p * links.f), any_value(trig.trig)) FROM r JOIN links ON links.u = r.node_id JOIN trig ON trig.node_id = links.v AND trig.t = r.t + 1 GROUP BY links.v, r.t),
        z AS (SELECT *, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS wet FROM (SELECT node_id, t, round(p + {OFF_GRID!r}, 6) AS p FROM r))
        SELECT node_id, t, p, wet, CASE WHEN t >= 2 THEN wet * lag(wet) {L} ELSE 0 END AS label FROM z""",
    "encoded_event": f"""WITH {RAIN}, w AS (SELECT node_id, t, CASE WHEN t >= 6 THEN sum(rain) {W.format(6)} END AS cum, CASE WHEN t >= 120 THEN avg(rain) {W.format(120)} ELSE 0 END AS a FROM rain),
        top AS (SELECT greatest(max(a), 1.0::DOUBLE) AS top FROM w), x AS (SELECT node_id, t, cum, a / top AS ant FROM w, top),
        trig AS (SELECT *, CASE WHEN cum IS NULL THEN 0.0::DOUBLE ELSE round(1 / (1 + exp(-(cum - (300.0::DOUBLE + node_id % 5 * 50) * (1 - 0.30::DOUBLE * ant)) / 50.0::DOUBLE)), 9) END AS trig FROM x),
        st AS (SELECT *, max(CASE WHEN trig > 0 THEN log2(trig) + t / 4.0::DOUBLE END) OVER (PARTITION BY node_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS l FROM trig),
        p AS (SELECT node_id, t, cum, ant, round(CASE WHEN l IS NULL THEN 0 ELSE pow(2.0::DOUBLE, l - t / 4.0::DOUBLE) END, 6) AS p FROM st), y AS (SELECT *, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS wet FROM p)
        SELECT node_id, t, round(cum, 4) AS cum, round(ant, 6) AS ant, p, CASE WHEN t >= 2 THEN wet * lag(wet) {L} ELSE 0 END AS label FROM y""",
    "lagged_sequences": f"""WITH {RAIN}, x AS (SELECT node_id, t, {', '.join(f"lag(rain, {6 - k}) {L} AS x{k}" for k in range(6))}, CASE WHEN lead(rain, 2) {L} > 300 THEN 1 ELSE 0 END AS y FROM rain)
        SELECT x.* FROM x, b WHERE t >= 6 AND t < last + 1 - 3""",
    "permuted_steps": """WITH u AS (SELECT DISTINCT user_id AS node_id, md5('7-' || user_id) AS k FROM events), o AS (SELECT node_id, row_number() OVER (ORDER BY k, node_id) - 1 AS place FROM u)
        SELECT node_id, place, CASE WHEN place < 10 THEN 1 ELSE 0 END AS picked FROM o""",
    "chrono_split": f"""WITH {RAIN}, v AS (SELECT t - 24 AS step, CASE WHEN rain > 300 THEN 1 ELSE 0 END AS y, last + 1 - 36 AS n FROM rain, b WHERE t >= 24 AND t < last + 1 - 12)
        SELECT CASE WHEN step < floor(n * 0.85::DOUBLE) THEN 'train' WHEN step < floor(n * (0.85::DOUBLE + 0.075::DOUBLE)) THEN 'val' ELSE 'test' END AS split, count(DISTINCT step) AS steps, round(avg(y), 6) AS rate FROM v GROUP BY 1""",
    "chrono_split_added": f"""WITH {RAIN}, v AS (SELECT DISTINCT t, last + 1 AS n FROM rain, b)
        SELECT CASE WHEN t < floor(n * 0.7::DOUBLE) THEN 'train' WHEN t < floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split, count(*) AS steps FROM v GROUP BY 1""",
    "gauss_smooth": _gauss_sql(1.5),
    "gauss_smooth_wide": _gauss_sql(3.0),
    "gauss_smooth_short": _gauss_sql(3.0, "SELECT * FROM rain WHERE t <= node_id % 30"),
    "time_shift": f"""WITH {RAIN} SELECT a.node_id, a.t, round(coalesce(b.rain, 0.8::DOUBLE), 6) AS shifted FROM rain a LEFT JOIN rain b ON b.node_id = a.node_id AND b.t = a.t - (a.node_id % 4 - 1) * 3""",
    "diurnal_cycle": f"WITH {RAIN} SELECT node_id, t, round(rain * (1 + 0.15::DOUBLE * sin(2 * pi() * (t % 24 - 18) / 24)) + 1e-9, 6) AS rain FROM rain",
    "early_stop": f"""WITH {RAIN}, d AS (SELECT CAST(t // 24 AS INTEGER) AS epoch, round(avg(rain), 6) AS score FROM rain GROUP BY 1),
        e AS (SELECT epoch, score, max(score) OVER (ORDER BY epoch) AS best FROM d),
        f AS (SELECT *, epoch - (SELECT min(epoch) FROM e AS o WHERE o.best = e.best) AS since FROM e)
        SELECT epoch, score, best, since, bool_or(since >= 5) OVER (ORDER BY epoch) AS stopped FROM f""",
    "snapshot_windows": f"""WITH {RAIN}, n AS (SELECT greatest(quantile_cont(rain, 0.95), 1.0::DOUBLE) AS n FROM rain WHERE rain > 0),
        l AS (SELECT node_id, t, {' + '.join(_lag(k) for k in series.SHORT_LAGS)} AS a, {' + '.join(_lag(k) for k in series.LONG_LAGS)} AS b FROM rain)
        SELECT node_id, t, 34 AS width, round(list_sum([(node_id * k % 16) / 16::DOUBLE FOR k IN range(1, 17)]), 6) AS static, round(a / n, 6) AS short, round(b / n, 6) AS long FROM l, n, b AS z WHERE t >= 24 AND t < z.last + 1 - 12""",
    "storm_rain": _storm_sql(),
}
