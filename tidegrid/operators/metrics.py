"""Skill of probabilistic forecasts; rows are (group columns, p, y)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EPS = 1e-8


def confusion(scored: DataFrame, by: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
    hit, pos = F.col("p") >= threshold, F.col("y") == 1
    return scored.groupBy(*by).agg(
        F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"), F.count_if(~hit & ~pos).alias("tn"), F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier")
    )


def skill(counts: DataFrame, floor_one: bool = False) -> DataFrame:
    """Precision, recall, F1, false-alarm ratio and critical success index.

    Denominators get a small number added, or, with ``floor_one``, are at least 1.
    """
    ratio = (lambda a, b: a / F.greatest(b.cast("double"), F.lit(1.0))) if floor_one else (lambda a, b: a / (b + F.lit(EPS)))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    own = counts.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "far": ratio(fp, tp + fp), "csi": ratio(tp, tp + fp + fn)})
    p, r = F.col("precision"), F.col("recall")
    f1 = F.when(p + r > 0, 2 * p * r / F.nullif(p + r, F.lit(0.0))).otherwise(0.0) if floor_one else 2 * p * r / (p + r + F.lit(EPS))
    return own.withColumn("f1", f1)


#: Parts of 0..1 that running sums over scores are dealt to.
PARTS = 1024


def score_counts(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, p, pos (rows with label 1) and n of each distinct score: what all metrics can be had from, and what adds up."""
    return scored.groupBy(*by, "p").agg(F.sum((F.col("y") == 1).cast("long")).alias("pos"), F.count("*").alias("n"))


def merged_counts(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Score counts of several batches as one."""
    return counts.groupBy(*by, "p").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))


def metrics_of_counts(counts: DataFrame, by: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
    """Confusion, Brier score, skill, ``auroc`` and ``ap`` from score counts, one row for each p: the same as from the rows themselves."""
    hit, pos, neg = F.col("p") >= threshold, F.col("pos"), F.col("n") - F.col("pos")
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    brier = (F.sum(pos * F.pow(F.col("p") - 1, 2) + neg * F.pow(F.col("p"), 2)) / F.sum("n")).alias("brier")
    table = counts.groupBy(*by).agg(total(F.when(hit, pos), "tp"), total(F.when(hit, neg), "fp"), total(F.when(~hit, pos), "fn"), total(F.when(~hit, neg), "tn"), brier)
    own, keys = skill(table), list(by)
    for area in (auroc(counts, by), average_precision(counts, by)):
        own = own.join(area, keys) if keys else own.join(F.broadcast(area))
    return own


class MetricState:
    """Score counts by batch in a shared folder: a batch that is run again replaces itself, and batches add up to the whole's metrics."""

    def __init__(self, spark: SparkSession, path: str, by: Sequence[str] = ()):
        self.spark, self.path, self.by = spark, path.rstrip("/"), tuple(by)

    def update(self, scored: DataFrame, batch: int) -> None:
        score_counts(scored, self.by).write.mode("overwrite").parquet(f"{self.path}/batch={int(batch)}")

    def counts(self) -> DataFrame:
        return merged_counts(self.spark.read.parquet(self.path), self.by)

    def compute(self) -> DataFrame:
        return metrics_of_counts(self.counts(), self.by)

    def reset(self) -> None:
        from tidegrid.sources.sinks import purge

        purge(self.path)


def compare_models(spark: SparkSession, models: dict[str, Callable[[], DataFrame]], threshold: float = 0.5) -> DataFrame:
    """model, the metrics of its rows (p, y), and ``error``: a model whose rows can't be made has nulls and why, the others stand.

    Each model's rows go through score counts, so they are made once for all its metrics.
    """
    from tidegrid.operators.graph import written

    out = None
    for name, make in models.items():
        try:
            row = metrics_of_counts(written(score_counts(make()), "scores"), (), threshold).withColumn("error", F.lit(None).cast("string"))
        except Exception as e:  # whatever a model's library raises
            row = spark.range(1).select(F.lit(f"{type(e).__name__}: {str(e).splitlines()[0][:200] if str(e) else ''}").alias("error"))
        row = row.withColumn("model", F.lit(name))
        out = row if out is None else out.unionByName(row, allowMissingColumns=True)
    return out


def _by_score(scored: DataFrame, by: Sequence[str], rising: bool) -> DataFrame:
    """pos and n of each distinct score, with the counts up to it (``cum_pos``, ``cum_n``), in rising or falling order; of rows, or of
    score counts, which have a row for each score already.

    Scores are dealt to parts of their range; a running sum over the parts' totals, a small table, gives what lies
    before each part, and a window within the part the rest, so that no task holds all scores.
    """
    part = F.least(F.greatest(F.floor(F.col("p") * PARTS), F.lit(0)), F.lit(PARTS)).cast("int")
    own = (scored if "y" not in scored.columns else score_counts(scored, by)).withColumn("_part", part)
    order = (lambda c: F.asc(c)) if rising else (lambda c: F.desc(c))
    before = Window.partitionBy(*by).orderBy(order("_part")).rowsBetween(Window.unboundedPreceding, -1)
    totals = own.groupBy(*by, "_part").agg(F.sum("pos").alias("_sp"), F.sum("n").alias("_sn"))
    totals = totals.select(*by, "_part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_b{c}") for c in ("_sp", "_sn")])
    within = Window.partitionBy(*by, "_part").orderBy(order("p")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = own.withColumns({"_wp": F.sum("pos").over(within), "_wn": F.sum("n").over(within)}).join(totals, [*by, "_part"])
    return own.select(*by, "p", "pos", "n", (F.col("_wp") + F.col("_b_sp")).alias("cum_pos"), (F.col("_wn") + F.col("_b_sn")).alias("cum_n"))


def auroc(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve by mid-ranks of the distinct scores; 0.5 if there is one class."""
    rank = F.col("cum_n") - (F.col("n") - 1) / 2
    sums = _by_score(scored, by, True).withColumn("_r", rank * F.col("pos")).groupBy(*by).agg(F.sum("_r").alias("_rs"), F.sum("pos").alias("_p"), F.sum("n").alias("_n"))
    p, q = F.col("_p").cast("double"), (F.col("_n") - F.col("_p")).cast("double")
    return sums.select(*by, F.when((p > 0) & (q > 0), (F.col("_rs") - p * (p + 1) / 2) / F.nullif(p * q, F.lit(0.0))).otherwise(0.5).alias("auroc"))


def average_precision(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sum of precision times the step in recall over the distinct scores; the mean label if there is one class."""
    term = F.col("pos").cast("double") * F.col("cum_pos").cast("double") / F.col("cum_n").cast("double")
    sums = _by_score(scored, by, False).groupBy(*by).agg(F.sum(term).alias("_s"), F.sum("pos").cast("double").alias("_p"), F.sum("n").cast("double").alias("_n"))
    both = (F.col("_p") > 0) & (F.col("_p") < F.col("_n"))
    return sums.select(*by, F.when(both, F.col("_s") / F.nullif(F.col("_p"), F.lit(0.0))).otherwise(F.col("_p") / F.col("_n")).alias("ap"))


def bins(scored: DataFrame, n: int = 10, closed: bool = False) -> DataFrame:
    """``bin`` of each row; p = 1 falls out (null), or with ``closed`` goes to the last bin."""
    k = F.floor(F.col("p") * n).cast("int")
    return scored.withColumn("bin", F.least(k, F.lit(n - 1)) if closed else F.when((F.col("p") >= 0) & (F.col("p") < 1), k))


def reliability(scored: DataFrame, n: int = 10, over: int = 5) -> DataFrame:
    """Mean score and observed rate of the bins with more than ``over`` rows."""
    own = bins(scored, n).filter("bin is not null").groupBy("bin").agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg(F.col("y").cast("double")).alias("rate"))
    return own.filter(F.col("n") > over)


def expected_calibration_error(scored: DataFrame, n: int = 10) -> DataFrame:
    """Mean gap of score and rate over the bins, by their share of all rows (those with p = 1 count in the divisor alone)."""
    total = scored.agg(F.count("*").alias("_total"))
    own = bins(scored, n).filter("bin is not null").groupBy("bin").agg(F.count("*").alias("n"), F.avg("p").alias("mp"), F.avg(F.col("y").cast("double")).alias("r"))
    return own.join(F.broadcast(total)).agg(F.coalesce(F.sum(F.col("n") / F.col("_total") * F.abs(F.col("mp") - F.col("r"))), F.lit(0.0)).alias("ece"))


def histogram(scored: DataFrame, n: int = 20) -> DataFrame:
    """Counts in n bins over 0 to 1, the last one closed; bins without rows are there with 0."""
    counts = bins(scored, n, closed=True).groupBy("bin").agg(F.count("*").alias("n"))
    spine = scored.sparkSession.range(n).select(F.col("id").cast("int").alias("bin"))
    return spine.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def focal_tversky(scored: DataFrame, by: Sequence[str] = (), alpha: float = 0.3, beta: float = 0.7, gamma: float = 0.75, smooth: float = 0.0) -> DataFrame:
    """(1 - index) ^ gamma of soft counts."""
    p, y = F.col("p"), F.col("y").cast("double")
    own = scored.groupBy(*by).agg(F.sum(p * y).alias("tp"), F.sum(p * (1 - y)).alias("fp"), F.sum((1 - p) * y).alias("fn"))
    index = (F.col("tp") + smooth) / F.nullif(F.col("tp") + alpha * F.col("fp") + beta * F.col("fn") + smooth, F.lit(0.0))
    return own.withColumn("loss", F.pow(1 - F.coalesce(index, F.lit(0.0)), F.lit(gamma)))


def weighted_mean(losses: DataFrame, weights: dict[int, float], by: str = "lead") -> DataFrame:
    """One row: the mean of ``loss`` by the weight of each lead."""
    w = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col(by)), F.lit(0.0))
    return losses.agg((F.sum(F.col("loss") * w) / F.nullif(F.sum(w), F.lit(0.0))).alias("loss"))


def log_loss(p: Column, y: Column, pos_weight: float = 5.0, eps: float = 1e-7) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return -(F.lit(pos_weight) * y * F.ln(q) + (1 - y) * F.ln(1 - q))


def focal_loss(p: Column, y: Column, alpha: float = 0.25, gamma: float = 2.0, eps: float = 1e-7) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    pt = F.when(y == 1, q).otherwise(1 - q)
    a = F.when(y == 1, F.lit(alpha)).otherwise(1 - alpha)
    return -a * F.pow(1 - pt, F.lit(gamma)) * F.ln(pt)


def mean_and_spread(samples: DataFrame, by: Sequence[str], value: str = "p") -> DataFrame:
    """Mean of repeated forwards, and deviation over n - 1 (``std``) and over n (``std_pop``)."""
    return samples.groupBy(*by).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.stddev_pop(value).alias("std_pop"))


def gates(metrics: DataFrame, limits: dict[str, tuple[float, float, bool]]) -> DataFrame:
    """metric, value, status: limits give (pass, warn, larger is better) for each metric."""
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(a).alias("_ok"), F.lit(b).alias("_warn"), F.lit(up).alias("_up")) for m, (a, b, up) in limits.items()])
    own = metrics.select(F.explode(rows).alias("g")).select("g.*")
    reached = lambda c: F.when(F.col("_up"), F.col("value") >= F.col(c)).otherwise(F.col("value") <= F.col(c))
    return own.select("metric", "value", F.when(reached("_ok"), "PASS").when(reached("_warn"), "WARN").otherwise("FAIL").alias("status"))


#: Of each metric of the first lead what passes, what warns, and whether more is better.
LIMITS = {"f1": (0.75, 0.75, True), "auroc": (0.85, 0.80, True), "csi": (0.55, 0.55, True), "pod": (0.60, 0.60, True), "far": (0.40, 1.0, False), "ece": (0.10, 0.20, False)}


def readiness(first: DataFrame, last: DataFrame, baselines: DataFrame, other: DataFrame) -> DataFrame:
    """metric, value, status: the first lead's limits, and three comparisons. All but ``baselines`` are one row.

    f1_drop to the last lead: under 0.20 passes, under 0.30 warns. over_baselines: a better F1 than every baseline's
    passes, else a better CSI does; the value is the margin in F1. event_drop to another event's F1: up to 0.15 passes, up to 0.25
    warns. Without baselines or another event their rows are not there.
    """
    top = baselines.agg(F.max("f1").alias("_f1"), F.max("csi").alias("_csi"))
    own = first.select("f1", "csi").join(F.broadcast(last.select(F.col("f1").alias("_last")))).join(F.broadcast(top)).join(F.broadcast(other.select(F.col("f1").alias("_other"))), how="left")
    c = F.col
    drop, event = c("f1") - c("_last"), c("f1") - c("_other")
    grade = lambda ok, warn: F.when(ok, "PASS").when(warn, "WARN").otherwise("FAIL")
    better = (c("f1") > c("_f1")) | (c("csi") > c("_csi"))
    rows = F.array(
        F.struct(F.lit("f1_drop").alias("metric"), drop.alias("value"), grade(drop < 0.20, drop < 0.30).alias("status")),
        F.struct(F.lit("over_baselines").alias("metric"), (c("f1") - c("_f1")).alias("value"), grade(better, F.lit(False)).alias("status")),
        F.struct(F.lit("event_drop").alias("metric"), event.alias("value"), grade(event <= 0.15, event <= 0.25).alias("status")),
    )
    more = own.select(F.explode(rows).alias("g")).select("g.*").filter("value is not null")
    return gates(first, LIMITS).unionByName(more)
