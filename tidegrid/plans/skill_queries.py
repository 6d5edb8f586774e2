"""Queries on forecast skill and on risk tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions.risk import risk_band, risk_level
from tidegrid.operators import gnn, metrics, report, series
from tidegrid.operators.graph import written
from tidegrid.plans.common import GRID, RAIN, SCORED, STATES, grid_nodes, rain, risk, scored, settled, states


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[settled(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.skill(metrics.confusion(scored(spark, sf_dir), ["lead"])))


def confusion_floor_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.skill(metrics.confusion(scored(spark, sf_dir)), floor_one=True))


def auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.auroc(scored(spark, sf_dir), ["lead"]))


def avg_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.average_precision(scored(spark, sf_dir), ["lead"]))


def ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.expected_calibration_error(scored(spark, sf_dir)))


def reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.reliability(scored(spark, sf_dir)))


def histogram20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.histogram(scored(spark, sf_dir))


LEAD_WEIGHTS = {1: 2.0, 3: 1.5, 6: 1.0, 12: 0.75}


def tversky(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.focal_tversky(scored(spark, sf_dir), ["lead"]))


def tversky_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.weighted_mean(metrics.focal_tversky(scored(spark, sf_dir), ["lead"]), LEAD_WEIGHTS))


def weighted_bce(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = scored(spark, sf_dir).withColumn("l", metrics.log_loss(F.col("p"), F.col("y").cast("double")))
    return _rounded(metrics.weighted_mean(own.groupBy("lead").agg(F.avg("l").alias("loss")), LEAD_WEIGHTS))


def focal(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = scored(spark, sf_dir).withColumn("l", metrics.focal_loss(F.col("p"), F.col("y").cast("double")))
    return _rounded(own.agg(F.avg("l").alias("mean_loss"), F.sum("l").alias("sum_loss")))


def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = scored(spark, sf_dir)
    m = metrics.skill(metrics.confusion(own)).join(metrics.auroc(own)).join(metrics.expected_calibration_error(own)).withColumn("pod", F.col("recall"))
    return _rounded(metrics.gates(m, metrics.LIMITS))


def readiness_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All gates: the first lead, the drop to the last one, baselines (other scores of the same labels), another event (the third lead)."""
    own = scored(spark, sf_dir)
    at = lambda lead: own.filter(F.col("lead") == lead)
    first = at(1)
    row = metrics.skill(metrics.confusion(first)).join(metrics.auroc(first)).join(metrics.expected_calibration_error(first)).withColumn("pod", F.col("recall"))
    kinds = F.explode(F.array(F.struct(F.lit("reverse").alias("model"), (1 - F.col("p")).alias("q")), F.struct(F.lit("flat").alias("model"), F.lit(0.5).alias("q")))).alias("m")
    rivals = first.select("y", kinds).select("m.model", F.round("m.q", 6).alias("p"), "y")
    return _rounded(metrics.readiness(row, metrics.skill(metrics.confusion(at(12))), metrics.skill(metrics.confusion(rivals, ["model"])), metrics.skill(metrics.confusion(at(6)))))


def best_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each lead as a model: the best F1 and CSI."""
    own = metrics.skill(metrics.confusion(scored(spark, sf_dir), ["lead"]))
    return _rounded(own.agg(F.max("f1").alias("best_f1"), F.max("csi").alias("best_csi"), F.max_by("lead", F.struct("f1", "lead")).alias("lead")))


def node_mean_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(risk(spark, sf_dir))


def lead_mean_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and maximum over the hours of each lead's states, by node."""
    own = series.leads(states(spark, sf_dir), "p", prefix="p_")
    found = report.lead_summary(own, series.LEADS)
    return found.select("node_id", "lead", *[settled(F.col(c)).alias(c) for c in ("p_mean", "p_max")])


def peak_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(report.peak_step(states(spark, sf_dir), 20))


def merged_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States as overlapping batches of a day each."""
    own = states(spark, sf_dir).groupBy("node_id", F.floor(F.col("t") / 24).alias("batch")).agg(F.round(F.avg("p"), 9).alias("p"))
    return _rounded(report.merge_batches(own))


def risk_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = risk(spark, sf_dir).withColumn("p_mean", settled(F.col("p_mean")))
    return own.select("node_id", risk_band(F.col("p_mean"))["label"].alias("label"), risk_band(F.col("p_mean"))["colour"].alias("colour"), risk_level(F.col("p_mean")).alias("level"))


def risk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = risk(spark, sf_dir).withColumn("p_mean", settled(F.col("p_mean")))
    return report.band_counts(own, (0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8))


def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = risk(spark, sf_dir).withColumn("p_mean", settled(F.col("p_mean")))
    return report.category_counts(own, risk_level(F.col("p_mean")), 5)


def prediction_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(report.summary(risk(spark, sf_dir)))


def top20_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.top_nodes(_rounded(risk(spark, sf_dir)), 20)


def high_risk_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the highest state of each node."""
    return report.high_risk(_rounded(risk(spark, sf_dir)), 0.7, 10, "p_max")


def alert_kpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(report.alert_row(_rounded(risk(spark, sf_dir)), 0.1))


def display_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = grid_nodes(spark, sf_dir).withColumn("p_mean", (F.col("node_id") * 7 % 101) / 101)
    return report.display(own)


def scenario_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean states with half as much rain again, against those of the rain as it was."""
    mean = lambda factor: _rounded(report.node_summary(states(spark, sf_dir, factor))).select("node_id", F.col("p_mean").alias("p"))
    return _rounded(report.paired_change(mean(1.5), mean(1.0)))


def rate_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of positives overall and by part."""
    own = scored(spark, sf_dir).withColumn("split", F.when(F.col("doc_id") % 10 < 8, "train").otherwise("test"))
    by = own.groupBy("split").agg(F.avg(F.col("y").cast("double")).alias("rate"), F.count("*").alias("n"))
    return _rounded(by.unionByName(own.agg(F.avg(F.col("y").cast("double")).alias("rate"), F.count("*").alias("n")).withColumn("split", F.lit("all"))))


def metric_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches' score counts, merged: they give the whole's confusion, skill, AUROC and average precision."""
    parts = metrics.score_counts(scored(spark, sf_dir).withColumn("batch", F.col("doc_id") % 16), ["batch"])
    return _rounded(metrics.metrics_of_counts(metrics.merged_counts(parts)))


def flood_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(report.flood_report(_rounded(risk(spark, sf_dir)), 0.1))


def spread_peak_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deviation over users of each hour's states, over twelve hours."""
    steps = states(spark, sf_dir).groupBy("t").agg(F.round(F.stddev_samp("p"), 9).alias("std"))
    return _rounded(report.spread_over(steps, 100, 12))


def _baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model, p, y: rain over 300 in the next hour, by the last hour's rain and by the mean of six and of 24 hours."""
    own = series.leads(rain(spark, sf_dir).withColumn("y", (F.col("rain") > 300).cast("int")), "y", (1,))
    own = series.valid_steps(series.trailing_mean(series.trailing_mean(own, 6, "m6"), 24, "m24"))
    p = lambda c, top: F.round(F.least(F.col(c) / top, F.lit(1.0)), 6).alias("p")
    kinds = (("persistence", p("rain", 500.0)), ("mean_6h", p("m6", 200.0)), ("mean_24h", p("m24", 100.0)))
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), c) for m, c in kinds])).alias("m")
    return own.select(F.col("y_1").alias("y"), rows).select("m.model", "m.p", "y")


def baseline_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of skill for each baseline."""
    own = _baselines(spark, sf_dir)
    return _rounded(metrics.skill(metrics.confusion(own, ["model"])).join(metrics.auroc(own, ["model"]), "model"))


def _forest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p and y of the test steps by a balanced random forest on window means."""
    own = series.leads(rain(spark, sf_dir).withColumn("y", (F.col("rain") > 300).cast("int")), "y", (1,))
    own = series.valid_steps(series.trailing_mean(series.trailing_mean(own, 6, "m6"), 24, "m24"))
    own = written(own.select("t", "rain", "m6", "m24", "y_1"), "steps")  # windows are made once for all that reads them
    n = own.agg(F.max("t").alias("last")).first()["last"] or 0
    cut = int(24 + (n - 24) * 0.85)
    found = gnn.random_forest(own.filter(F.col("t") < cut), own.filter(F.col("t") >= cut), ["rain", "m6", "m24"], "y_1", trees=20, depth=6)
    return found.select("p", F.col("y_1").alias("y"))


def forest_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skill of a balanced random forest on window means (no SQL: the trees are MLlib's own)."""
    return metrics.metrics_of_counts(written(metrics.score_counts(_forest_scores(spark, sf_dir)), "scores"))


def model_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forest, the recurrent baseline and the older network (fixed weights), persistence, and one that can't be made, at the first
    lead on the test steps: metrics of each, a gap for the last (no SQL: the models)."""
    from tidegrid.plans.graph_queries import network_inputs

    snap, edges = network_inputs(spark, sf_dir)
    labels = series.leads(rain(spark, sf_dir).withColumn("y", (F.col("rain") > 300).cast("int")), "y", (1,))
    cut = F.lit(int(24 + ((labels.agg(F.max("t")).first()[0] or 0) - 24) * 0.85))
    test = written(labels.filter(F.col("t") >= cut).select("node_id", "t", "y_1", "rain"), "test")  # read by three models
    late = snap.filter(F.col("t") >= cut)
    judged = lambda p: p.select("node_id", F.col("t").cast("int").alias("t"), "p").join(test, ["node_id", "t"]).select("p", F.col("y_1").alias("y"))
    models = {
        "random_forest": lambda: _forest_scores(spark, sf_dir),
        "recurrent": lambda: judged(gnn.gru_baseline(late, gnn.weights(gnn.GRU_SHAPES))),
        "older_network": lambda: judged(gnn.older_forward(late, edges, gnn.older_weights())),
        "persistence": lambda: test.select(F.least(F.col("rain") / 500, F.lit(1.0)).alias("p"), F.col("y_1").alias("y")),
        "unavailable": lambda: judged(gnn.older_forward(late, edges, {})),
    }
    return metrics.compare_models(spark, models)


QUERIES = {
    f.__name__: f
    for f in (
        confusion, confusion_floor_one, auroc, avg_precision, ece, reliability, histogram20, tversky, tversky_weighted, weighted_bce, focal, readiness, readiness_full, best_baseline, node_mean_max, peak_step,
        merged_batches, risk_bands, risk_counts, category_counts, prediction_summary, top20_nodes, high_risk_top10, alert_kpi, display_table, scenario_change, rate_by_split, metric_state, flood_report, spread_peak_window, baseline_table, forest_baseline, model_table, lead_mean_max,
    )
}

_CM = """c AS (SELECT {by} count(*) FILTER (WHERE p >= 0.5 AND y = 1) AS tp, count(*) FILTER (WHERE p >= 0.5 AND y <> 1) AS fp, count(*) FILTER (WHERE p < 0.5 AND y = 1) AS fn,
    count(*) FILTER (WHERE p < 0.5 AND y <> 1) AS tn, avg(pow(p - y, 2)) AS brier FROM scored {group})"""
_CM_LEAD, _CM_ALL = _CM.format(by="lead,", group="GROUP BY lead"), _CM.format(by="", group="")
_SK = "sk AS (SELECT *, tp / (tp + fp + 1e-8) AS precision, tp / (tp + fn + 1e-8) AS recall, fp / (tp + fp + 1e-8) AS far, tp / (tp + fp + fn + 1e-8) AS csi FROM c), f AS (SELECT *, 2 * precision * recall / (precision + recall + 1e-8) AS f1 FROM sk)"
_R = lambda *cols: ", ".join(f"round({c} + 1e-9, 6) AS {c}" for c in cols)
_AUC = "SELECT {by} CASE WHEN np > 0 AND np < n THEN (sum(CASE WHEN y = 1 THEN r END) - np * (np + 1) / 2) / (np * (n - np)) ELSE 0.5 END AS auroc FROM (SELECT *, rank() OVER ({part} ORDER BY p) + (count(*) OVER ({part2} p) - 1) / 2.0::DOUBLE AS r, sum(y) OVER ({part})::DOUBLE AS np, count(*) OVER ({part})::DOUBLE AS n FROM scored) GROUP BY ALL"
_ECE = "SELECT sum(n::DOUBLE / total * abs(mp - r)) AS ece FROM (SELECT floor(p * 10) AS b, count(*) AS n, avg(p) AS mp, avg(y) AS r FROM scored WHERE p < 1 GROUP BY 1), (SELECT count(*) AS total FROM scored)"
_TV = "tv AS (SELECT lead, sum(p * y) AS tp, sum(p * (1 - y)) AS fp, sum((1 - p) * y) AS fn FROM scored GROUP BY lead), tl AS (SELECT *, pow(1 - tp / (tp + 0.3::DOUBLE * fp + 0.7::DOUBLE * fn), 0.75) AS loss FROM tv)"
_LW = "CASE lead WHEN 1 THEN 2.0::DOUBLE WHEN 3 THEN 1.5 WHEN 6 THEN 1.0 ELSE 0.75 END"
_Q = "least(greatest(p, 1e-7), 1 - 1e-7)"
_RISK = f"WITH {STATES}, k AS (SELECT node_id, round(p_mean + 1e-9, 6) AS p_mean, round(p_max + 1e-9, 6) AS p_max FROM risk)"
_BAND = "CASE WHEN p_mean < 0.3 THEN {0} WHEN p_mean < 0.5 THEN {1} WHEN p_mean < 0.7 THEN {2} ELSE {3} END"
_LABEL = _BAND.format("'Low Risk'", "'Moderate Risk'", "'High Risk'", "'Very High Risk'")
_LEVEL = "CASE WHEN p_mean < 0.3 THEN 0 WHEN p_mean < 0.6 THEN 1 WHEN p_mean < 0.8 THEN 2 WHEN p_mean < 0.9 THEN 3 ELSE 4 END"

_MEAN = "WITH {states} SELECT node_id, round(p_mean + 1e-9, 6) AS p_mean FROM risk"
_COUNTS = "SELECT count(*) FILTER (WHERE p >= 0.5 AND y = 1) AS tp, count(*) FILTER (WHERE p >= 0.5 AND y <> 1) AS fp, count(*) FILTER (WHERE p < 0.5 AND y = 1) AS fn FROM {src}"
_SKILL = "SELECT *, 2 * precision * recall / (precision + recall + 1e-8) AS f1 FROM (SELECT tp / (tp + fp + 1e-8) AS precision, tp / (tp + fn + 1e-8) AS recall, fp / (tp + fp + 1e-8) AS far, tp / (tp + fp + fn + 1e-8) AS csi FROM {c})"

ORACLES = {
    "confusion": f"WITH {SCORED}, {_CM_LEAD}, {_SK} SELECT lead, tp, fp, fn, tn, {_R('brier', 'precision', 'recall', 'far', 'csi', 'f1')} FROM f",
    "confusion_floor_one": f"""WITH {SCORED}, {_CM_ALL}, sk AS (SELECT *, tp / greatest(tp + fp, 1)::DOUBLE AS precision, tp / greatest(tp + fn, 1)::DOUBLE AS recall, fp / greatest(tp + fp, 1)::DOUBLE AS far, tp / greatest(tp + fp + fn, 1)::DOUBLE AS csi FROM c),
        f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM sk) SELECT tp, fp, fn, tn, {_R('brier', 'precision', 'recall', 'far', 'csi', 'f1')} FROM f""",
    "auroc": f"WITH {SCORED}, a AS ({_AUC.format(by='lead,', part='PARTITION BY lead', part2='PARTITION BY lead,').replace('GROUP BY ALL', 'GROUP BY lead, np, n')}) SELECT lead, {_R('auroc')} FROM a",
    "avg_precision": f"""WITH {SCORED}, g AS (SELECT lead, p, sum(y)::DOUBLE AS pos, count(*)::DOUBLE AS n FROM scored GROUP BY lead, p),
        w AS (SELECT *, sum(pos) OVER (PARTITION BY lead ORDER BY p DESC) AS cp, sum(n) OVER (PARTITION BY lead ORDER BY p DESC) AS cn FROM g)
        SELECT lead, round(CASE WHEN sum(pos) > 0 AND sum(pos) < sum(n) THEN sum(pos * cp / cn) / sum(pos) ELSE sum(pos) / sum(n) END + 1e-9, 6) AS ap FROM w GROUP BY lead""",
    "ece": f"WITH {SCORED}, e AS ({_ECE}) SELECT {_R('ece')} FROM e",
    "reliability": f"WITH {SCORED} SELECT CAST(floor(p * 10) AS INTEGER) AS bin, count(*) AS n, round(avg(p) + 1e-9, 6) AS mean_p, round(avg(y) + 1e-9, 6) AS rate FROM scored WHERE p < 1 GROUP BY 1 HAVING count(*) > 5",
    "histogram20": f"WITH {SCORED}, h AS (SELECT CAST(least(floor(p * 20), 19) AS INTEGER) AS bin, count(*) AS n FROM scored GROUP BY 1) SELECT CAST(r.b AS INTEGER) AS bin, coalesce(n, 0) AS n FROM range(20) AS r(b) LEFT JOIN h ON h.bin = r.b",
    "tversky": f"WITH {SCORED}, {_TV} SELECT lead, {_R('tp', 'fp', 'fn', 'loss')} FROM tl",
    "tversky_weighted": f"WITH {SCORED}, {_TV} SELECT round(sum(loss * {_LW}) / sum({_LW}) + 1e-9, 6) AS loss FROM tl",
    "weighted_bce": f"WITH {SCORED}, b AS (SELECT lead, avg(-(5 * y * ln({_Q}) + (1 - y) * ln(1 - {_Q}))) AS loss FROM scored GROUP BY lead) SELECT round(sum(loss * {_LW}) / sum({_LW}) + 1e-9, 6) AS loss FROM b",
    "focal": f"""WITH {SCORED}, z AS (SELECT CASE WHEN y = 1 THEN -0.25::DOUBLE * pow(1 - {_Q}, 2) * ln({_Q}) ELSE -0.75::DOUBLE * pow({_Q}, 2) * ln(1 - {_Q}) END AS l FROM scored)
        SELECT round(avg(l) + 1e-9, 6) AS mean_loss, round(sum(l) + 1e-9, 6) AS sum_loss FROM z""",
    "readiness": f"""WITH {SCORED}, {_CM_ALL}, {_SK}, a AS ({_AUC.format(by='', part='', part2='PARTITION BY').replace('GROUP BY ALL', 'GROUP BY np, n')}), e AS ({_ECE}),
        v AS (SELECT unnest(['f1', 'auroc', 'csi', 'pod', 'far', 'ece']) AS metric, unnest([f1, auroc, csi, recall, far, ece]) AS value, unnest([0.75, 0.85, 0.55, 0.60, 0.40, 0.10]) AS ok, unnest([0.75, 0.80, 0.55, 0.60, 1.0, 0.20]) AS warn, unnest([1, 1, 1, 1, -1, -1]) AS up FROM f, a, e)
        SELECT metric, round(value + 1e-9, 6) AS value, CASE WHEN value * up >= ok * up THEN 'PASS' WHEN value * up >= warn * up THEN 'WARN' ELSE 'FAIL' END AS status FROM v""",
    "best_baseline": f"WITH {SCORED}, {_CM_LEAD}, {_SK} SELECT round(max(f1) + 1e-9, 6) AS best_f1, round(max(csi) + 1e-9, 6) AS best_csi, (SELECT lead FROM f ORDER BY f1 DESC, lead DESC LIMIT 1) AS lead FROM f",
    "node_mean_max": f"WITH {STATES} SELECT node_id, {_R('p_mean', 'p_max')} FROM risk",
    "lead_mean_max": f"""WITH {STATES}, n AS (SELECT max(t) AS last FROM p), ld AS (SELECT unnest([1, 3, 6, 12])::INTEGER AS lead), x AS (SELECT a.node_id, lead, b.p FROM p a CROSS JOIN ld CROSS JOIN n JOIN p b ON b.node_id = a.node_id AND b.t = least(a.t + lead, last))
        SELECT node_id, lead, round(avg(p) + 1e-9, 6) AS p_mean, round(max(p) + 1e-9, 6) AS p_max FROM x GROUP BY ALL""",
    "peak_step": f"WITH {STATES}, m AS (SELECT t, avg(p) AS mean_p FROM p GROUP BY t ORDER BY t LIMIT 20) SELECT t, {_R('mean_p')} FROM m ORDER BY m.mean_p DESC, t LIMIT 1",
    "merged_batches": f"WITH {STATES}, a AS (SELECT node_id, t // 24 AS batch, round(avg(p), 9) AS p FROM p GROUP BY ALL) SELECT node_id, round(avg(p) + 1e-9, 6) AS p FROM a GROUP BY 1",
    "risk_bands": f"{_RISK} SELECT node_id, {_LABEL} AS label, {_BAND.format(chr(39) + '#2ECC71' + chr(39), chr(39) + '#F1C40F' + chr(39), chr(39) + '#E67E22' + chr(39), chr(39) + '#E74C3C' + chr(39))} AS colour, {_LEVEL} AS level FROM k",
    "risk_counts": f"{_RISK} SELECT count(*) FILTER (WHERE p_mean < 0.2) AS under, {', '.join(f'count(*) FILTER (WHERE p_mean >= 0.{d}) AS over_{d}0' for d in range(2, 9))} FROM k",
    "category_counts": f"{_RISK}, c AS (SELECT {_LEVEL} AS level, count(*) AS n FROM k GROUP BY 1) SELECT CAST(r.l AS INTEGER) AS level, coalesce(n, 0) AS n FROM range(5) AS r(l) LEFT JOIN c ON c.level = r.l",
    "prediction_summary": f"WITH {STATES} SELECT count(*) AS n, round(avg(p_mean) + 1e-9, 6) AS mean, round(stddev_pop(p_mean) + 1e-9, 6) AS std, round(min(p_mean) + 1e-9, 6) AS min, round(max(p_mean) + 1e-9, 6) AS max FROM risk",
    "top20_nodes": f"{_RISK} SELECT node_id, p_mean, p_max, CAST(row_number() OVER (ORDER BY p_mean DESC, node_id) AS INTEGER) AS rank, {_LABEL} AS risk FROM k ORDER BY rank LIMIT 20",
    "high_risk_top10": f"{_RISK} SELECT * FROM k WHERE p_max > 0.7 ORDER BY p_max DESC, node_id LIMIT 10",
    "alert_kpi": f"""{_RISK}, z AS (SELECT count(*) FILTER (WHERE p_mean >= 0.1) AS at_risk, count(*) AS n, avg(p_mean) AS mean_p, max(p_mean) AS max_p FROM k)
        SELECT at_risk, n, {_R('mean_p', 'max_p')}, round(at_risk / n + 1e-9, 6) AS share, CASE WHEN at_risk / n >= 0.5 THEN 'critical' WHEN at_risk / n >= 0.15 THEN 'warning' ELSE 'normal' END AS alert FROM z""",
    "display_table": f"""WITH {GRID}, d AS (SELECT node_id, lat, lon, (node_id * 7 % 101) / 101 AS p_mean FROM nodes) SELECT node_id, printf('%.5f', lat) AS lat, printf('%.5f', lon) AS lon, printf('%.1f%%', p_mean * 100) AS p, {_LABEL} AS risk FROM d""",
    "scenario_change": f"""WITH a AS ({_MEAN.format(states=STATES.replace("sum(rain) OVER", "1.5::DOUBLE * sum(rain) OVER"))}), b AS ({_MEAN.format(states=STATES)})
        SELECT node_id, a.p_mean AS p_scenario, b.p_mean AS p_history, round(a.p_mean - b.p_mean + 1e-9, 6) AS change FROM a JOIN b USING (node_id)""",
    "readiness_full": f"""WITH {SCORED}, one AS (SELECT p, y FROM scored WHERE lead = 1),
        {', '.join(f"c{k} AS ({_COUNTS.format(src=src)}), s{k} AS ({_SKILL.format(c=f'c{k}')})" for k, src in (("a", "one"), ("b", "(SELECT p, y FROM scored WHERE lead = 12)"), ("c", "(SELECT p, y FROM scored WHERE lead = 6)"), ("d", "(SELECT round(1 - p, 6) AS p, y FROM one)"), ("e", "(SELECT 0.5::DOUBLE AS p, y FROM one)")))},
        top AS (SELECT max(f1) AS f1, max(csi) AS csi FROM (SELECT f1, csi FROM sd UNION ALL SELECT f1, csi FROM se)),
        a AS ({_AUC.format(by='', part='', part2='PARTITION BY').replace('GROUP BY ALL', 'GROUP BY np, n').replace('FROM scored', 'FROM one')}), e AS ({_ECE.replace('FROM scored', 'FROM one')}),
        v AS (SELECT unnest(['f1', 'auroc', 'csi', 'pod', 'far', 'ece']) AS metric, unnest([f1, auroc, csi, recall, far, ece]) AS value, unnest([0.75, 0.85, 0.55, 0.60, 0.40, 0.10]) AS ok, unnest([0.75, 0.80, 0.55, 0.60, 1.0, 0.20]) AS warn, unnest([1, 1, 1, 1, -1, -1]) AS up FROM sa, a, e),
        z AS (SELECT metric, value, CASE WHEN value * up >= ok * up THEN 'PASS' WHEN value * up >= warn * up THEN 'WARN' ELSE 'FAIL' END AS status FROM v
            UNION ALL SELECT 'f1_drop', sa.f1 - sb.f1, CASE WHEN sa.f1 - sb.f1 < 0.20 THEN 'PASS' WHEN sa.f1 - sb.f1 < 0.30 THEN 'WARN' ELSE 'FAIL' END FROM sa, sb
            UNION ALL SELECT 'over_baselines', sa.f1 - top.f1, CASE WHEN sa.f1 > top.f1 OR sa.csi > top.csi THEN 'PASS' ELSE 'FAIL' END FROM sa, top
            UNION ALL SELECT 'event_drop', sa.f1 - sc.f1, CASE WHEN sa.f1 - sc.f1 <= 0.15 THEN 'PASS' WHEN sa.f1 - sc.f1 <= 0.25 THEN 'WARN' ELSE 'FAIL' END FROM sa, sc)
        SELECT metric, round(value + 1e-9, 6) AS value, status FROM z""",
    "rate_by_split": f"""WITH {SCORED}, s AS (SELECT CASE WHEN doc_id % 10 < 8 THEN 'train' ELSE 'test' END AS split, y FROM scored) SELECT split, round(avg(y) + 1e-9, 6) AS rate, count(*) AS n FROM s GROUP BY 1
        UNION ALL SELECT 'all', round(avg(y) + 1e-9, 6), count(*) FROM s""",
    "metric_state": f"""WITH {SCORED}, {_CM_ALL}, {_SK}, a AS ({_AUC.format(by='', part='', part2='PARTITION BY').replace('GROUP BY ALL', 'GROUP BY np, n')}),
        s AS (SELECT p, sum(y) AS pos, count(*) AS n FROM scored GROUP BY p), w AS (SELECT pos, sum(pos) OVER o AS cp, sum(n) OVER o AS cn, sum(pos) OVER () AS np FROM s WINDOW o AS (ORDER BY p DESC)),
        ap AS (SELECT sum(pos::DOUBLE * cp / cn) / any_value(np) AS ap FROM w)
        SELECT tp, fp, fn, tn, {_R('brier', 'precision', 'recall', 'far', 'csi', 'f1', 'auroc', 'ap')} FROM f, a, ap""",
    "flood_report": f"""{_RISK} SELECT count(*) AS total, count(*) FILTER (WHERE p_mean >= 0.1) AS flooded, count(*) FILTER (WHERE p_mean < 0.1) AS not_flooded, count(*) FILTER (WHERE p_mean >= 0.8) AS high_risk,
        count(*) FILTER (WHERE p_mean >= 0.5 AND p_mean < 0.8) AS medium_risk, count(*) FILTER (WHERE p_mean >= 0.3 AND p_mean < 0.5) AS low_risk, count(*) FILTER (WHERE p_mean < 0.3) AS no_risk,
        round(avg(p_mean) + 1e-9, 6) AS mean, round(max(p_mean) + 1e-9, 6) AS max FROM k""",
    "spread_peak_window": f"WITH {STATES}, sd AS (SELECT t, round(stddev_samp(p), 9) AS std FROM p GROUP BY t) SELECT round(avg(std) + 1e-9, 6) AS mean_spread, round(max(std) + 1e-9, 6) AS max_spread FROM sd WHERE t BETWEEN 100 AND 111",
    "baseline_table": f"""WITH {RAIN}, w AS (SELECT node_id, t, rain, CASE WHEN lead(rain) OVER (PARTITION BY node_id ORDER BY t) > 300 THEN 1 ELSE 0 END AS y,
            avg(rain) OVER (PARTITION BY node_id ORDER BY t ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS m6, avg(rain) OVER (PARTITION BY node_id ORDER BY t ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS m24 FROM rain),
        v AS (SELECT w.* FROM w, b WHERE t >= 24 AND t < last + 1 - 12),
        scored AS (SELECT 'persistence' AS model, round(least(rain / 500, 1), 6) AS p, y FROM v UNION ALL SELECT 'mean_6h', round(least(m6 / 200, 1), 6), y FROM v UNION ALL SELECT 'mean_24h', round(least(m24 / 100, 1), 6), y FROM v),
        {_CM.format(by="model,", group="GROUP BY model")}, {_SK}, a AS ({_AUC.format(by='model,', part='PARTITION BY model', part2='PARTITION BY model,').replace('GROUP BY ALL', 'GROUP BY model, np, n')})
        SELECT f.model, tp, fp, fn, tn, {_R('brier', 'precision', 'recall', 'far', 'csi', 'f1', 'auroc')} FROM f JOIN a ON a.model = f.model""",
}
