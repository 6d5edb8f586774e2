"""Dense hourly series and their windows.

A series is a long table (node_id, t, ts, rain): one row for each node and hour, so that row frames are time
frames. Every window is partitioned by node, so all of them share one shuffle; no time loop.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidegrid.functions.maths import sigmoid
from tidegrid.functions.names import free_names

SHORT_LAGS = tuple(range(6, 0, -1))
#: Twelve points over 24 hours, spaced as whole hours: the last one is an hour back.
LONG_LAGS = (24, 22, 20, 18, 16, 14, 12, 10, 8, 6, 4, 1)
STRIDED_LAGS = tuple(range(24, 0, -2))
LEADS = (1, 3, 6, 12)
#: Hours of the sums that longer trailing windows are made of.
BLOCK = 12


def by_node() -> WindowSpec:
    return Window.partitionBy("node_id").orderBy("t")


def to_hour(c: Column) -> Column:
    """The hour of a timestamp without zone, of that type (truncation alone would give it a zone)."""
    return F.date_trunc("hour", c).cast("timestamp_ntz")


def hourly(rows: DataFrame, node: str, ts: str, value: str) -> DataFrame:
    """node_id, ts (hour) and the hour's sum; partial sums before the shuffle."""
    return rows.groupBy(F.col(node).alias("node_id"), to_hour(F.col(ts)).alias("ts")).agg(F.round(F.sum(value), 6).alias("rain"))


#: Rows of a dense series that a task gets on average, at most.
DENSE_ROWS = 1_000_000


def dense(hours: DataFrame) -> DataFrame:
    """Every node and hour from the first to the last of all: missing hours have no rain. ``t`` counts from 0.

    Each hour with a row stands for the hours after it up to the node's next one, the first also for those before it: hours are
    dealt by node before they are spread out, and no dense row is shuffled, neither here nor for windows by node. There are as
    many parts as the dense rows need.
    """
    first, last, after, more, until, at = free_names(hours, "_from", "_to", "_after", "_more", "_until", "_at")
    span = hours.agg(F.min("ts").alias(first), F.max("ts").alias(last))
    nodes, steps = hours.agg(F.approx_count_distinct("node_id"), F.timestamp_diff("HOUR", F.min("ts"), F.max("ts")) + 1).first()
    parts = max(int(hours.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(nodes * (steps or 0) / DENSE_ROWS))
    w, hour = Window.partitionBy("node_id").orderBy("ts"), F.expr("interval 1 hour")
    own = hours.select("node_id", "ts", "rain").repartition(parts, "node_id")
    own = own.withColumns({after: F.lead("ts").over(w), more: F.lead(F.lit(True)).over(w), until: F.lag("ts").over(w)}).join(F.broadcast(span))  # one row
    # Rows without an hour come first; they count only where a node has no other.
    begin = F.when(F.col(until).isNull(), F.col(first)).otherwise(F.col("ts"))
    end = F.greatest(F.coalesce(F.col(after) - hour, F.when(F.col("ts").isNotNull() | F.col(more).isNull(), F.col(last))), F.col("ts"))
    own = own.filter(F.col("ts").isNotNull() | F.col(more).isNull()).select("node_id", "ts", "rain", first, F.explode(F.sequence(begin, end, hour)).alias(at))
    rain = F.when(F.col("node_id").isNotNull() & (F.col(at) == F.col("ts")), F.col("rain"))
    return own.select("node_id", F.timestamp_diff("HOUR", F.col(first), F.col(at)).cast("int").alias("t"), F.col(at).alias("ts"), F.coalesce(rain, F.lit(0.0)).alias("rain"))


def reindex(rows: DataFrame, spine: DataFrame, on: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Left join on a spine, missing values 0."""
    return spine.join(rows, list(on), "left").withColumns({v: F.coalesce(v, F.lit(0.0)) for v in values})


def trailing_sum(series: DataFrame, hours: int = 6, out: str = "cum") -> DataFrame:
    """Sum over [t - hours, t), null before the first full window."""
    return _sum_before(series, hours, out).withColumn(out, F.when(F.col("t") >= hours, F.col(out)))


def _sum_before(series: DataFrame, hours: int, out: str) -> DataFrame:
    """Sum over [t - hours, t) from the first full window on; only the values of the window go into it.

    A short frame is summed for each row; a long one is made of sums of BLOCK hours at lags of as many and of a rest.
    """
    w = by_node()
    frame = lambda n: F.sum("rain").over(w.rowsBetween(-n, -1))
    whole, rest = divmod(hours, BLOCK)
    if hours <= BLOCK:
        return series.withColumn(out, frame(hours))
    block, short = free_names(series, "_block", "_rest")
    own = series.withColumn(block, frame(BLOCK))
    parts = [F.col(block), *[F.lag(block, BLOCK * k).over(w) for k in range(1, whole)]]
    if rest:
        own = own.withColumn(short, frame(rest))
        parts.append(F.lag(short, BLOCK * whole).over(w))
    return own.withColumn(out, sum(parts[1:], parts[0])).drop(block, short)


def trailing_mean(series: DataFrame, hours: int = 120, out: str = "ant") -> DataFrame:
    """Mean over [t - hours, t), 0 before the first full window."""
    return _sum_before(series, hours, out).withColumn(out, F.when(F.col("t") >= hours, F.col(out) / hours).otherwise(0.0))


def antecedent(series: DataFrame, hours: int = 120) -> DataFrame:
    """The trailing mean as a share of its largest value over all nodes (at least 1)."""
    own = trailing_mean(series, hours)
    (most,) = free_names(own, "_top")
    top = own.agg(F.greatest(F.max("ant"), F.lit(1.0)).alias(most))
    return own.join(F.broadcast(top)).withColumn("ant", F.col("ant") / F.col(most)).drop(most)


def positive_percentile(series: DataFrame, q: float = 0.95) -> DataFrame:
    """One row: the exact percentile of positive rain, with linear interpolation, at least 1."""
    from tidegrid.operators.graph import written
    from tidegrid.operators.order import quantiles

    found = quantiles(written(series.filter("rain > 0").select("rain"), "rain"), "rain", [q])[0]
    return series.sparkSession.range(1).select(F.lit(max(found or 1.0, 1.0)).alias("rain_norm"))


def lags(series: DataFrame, offsets: Sequence[int], out: str, value: str = "rain") -> DataFrame:
    """An array of earlier values, oldest first, 0 before the start."""
    w = by_node()
    return series.withColumn(out, F.array(*[F.lag(value, k, 0.0).over(w) for k in offsets]))


def leads(series: DataFrame, value: str, hours: Sequence[int] = LEADS, prefix: str = "y_") -> DataFrame:
    """Later values; past the end, the last one."""
    w = by_node()
    last = F.last(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return series.withColumns({f"{prefix}{h}": F.coalesce(F.lead(value, h).over(w), last) for h in hours})


def valid_steps(series: DataFrame, lookback: int = 24, lead: int = 12) -> DataFrame:
    """lookback <= t < T - lead, T the number of steps."""
    (until,) = free_names(series, "_end")
    end = series.agg((F.max("t") + 1 - lead).alias(until))
    return series.join(F.broadcast(end)).filter((F.col("t") >= lookback) & (F.col("t") < F.col(until))).drop(until)


def decay_rate(half_life: float) -> float:
    return 0.5 ** (1.0 / max(half_life, 1.0))


def decaying_max(series: DataFrame, value: str, half_life: float = 4.0, out: str = "state") -> DataFrame:
    """a[t] = max(d a[t-1], value[t]) in closed form, as one running maximum.

    log2(value) + t / half_life is what the maximum is taken of, so that no power of d under- or overflows
    however long the series is; values of 0 or less count as 0.
    """
    rate = 1.0 / max(half_life, 1.0)
    w = by_node().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lifted = F.when(F.col(value) > 0, F.log2(value) + F.col("t") * F.lit(rate))
    return series.withColumn(out, F.coalesce(F.pow(F.lit(2.0), F.max(lifted).over(w) - F.col("t") * F.lit(rate)), F.lit(0.0)))


def coherent(series: DataFrame, label: str, out: str = "label") -> DataFrame:
    """A label counts if the hour before has it too; the first two hours never do."""
    before = F.lag(label, 1).over(by_node())
    return series.withColumn(out, F.when(F.col("t") >= 2, F.col(label) * before).otherwise(0))


def smooth_kernel(sigma: float, truncate: float = 4.0) -> list[tuple[int, float]]:
    """Offsets and weights of a Gaussian kernel, which sum to 1."""
    from math import exp

    r = int(truncate * sigma + 0.5)
    w = [exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    return [(k - r, x / sum(w)) for k, x in enumerate(w)]


def gaussian_smooth(series: DataFrame, sigma: float, value: str = "rain", out: str = "smooth") -> DataFrame:
    """Convolution along time with reflected ends (d c b a | a b c d | d c b a), again and again if a series is shorter than the radius.

    A weighted sum of lags and leads. Positions beyond both ends show the row that they fold to, with a period of twice the
    length: each row is put to all places where it is seen (t and -1 - t, by periods), so that every row has its whole
    neighbourhood; a node's length is one aggregate.
    """
    kernel = smooth_kernel(sigma)
    r = max(k for k, _ in kernel)
    n, at = free_names(series, "_n", "_at")
    own = series.join(series.groupBy("node_id").agg((F.max("t") + 1).alias(n)), "node_id")
    most = F.ceil((F.col(n) + r) / (2 * F.col(n))).cast("int")
    places = F.flatten(F.transform(F.sequence(-most, most), lambda m: F.array(F.col("t") + 2 * m * F.col(n), 2 * m * F.col(n) - 1 - F.col("t"))))
    wide = own.withColumn(at, F.explode(F.filter(places, lambda p: (p >= -r) & (p < F.col(n) + r))))
    w = Window.partitionBy("node_id").orderBy(at)
    near = lambda k: F.lag(value, -k).over(w) if k < 0 else F.lead(value, k).over(w) if k else F.col(value)
    total = sum((F.lit(weight) * near(k) for k, weight in kernel[1:]), F.lit(kernel[0][1]) * near(kernel[0][0]))
    return wide.withColumn(out, total).filter(F.col(at) == F.col("t")).drop(at, n)


def shift_by_node(series: DataFrame, shift: Column, background: float = 0.0, out: str = "shifted") -> DataFrame:
    """Each node's series moved by a number of hours of its own; hours that are not covered get the background."""
    moved = series.select("node_id", (F.col("t") + shift).cast("int").alias("t"), F.col("rain").alias(out))
    return series.join(moved, ["node_id", "t"], "left").withColumn(out, F.coalesce(out, F.lit(background)))


def diurnal(t: Column, amplitude: float = 0.15, peak: int = 18) -> Column:
    """1 + a sin(2 pi (h - peak) / 24), h the hours since the start modulo 24."""
    return 1 + F.lit(amplitude) * F.sin(2 * F.pi() * (t % 24 - peak) / 24)


def chronological_split(step: Column, n: Column, train: float = 0.85, val: float = 0.075, ends_added: bool = False) -> Column:
    """train, val or test by position. The parts end at int(n train) and int(n (train + val)), or, with
    ``ends_added``, at int(n train) and that plus int(n val)."""
    a = F.floor(n * F.lit(train))
    b = a + F.floor(n * F.lit(val)) if ends_added else F.floor(n * F.lit(train + val))
    return F.when(step < a, "train").when(step < b, "val").otherwise("test")


def early_stopping(history: DataFrame, score: str, patience: int, order: str = "epoch") -> DataFrame:
    """Best score so far, epochs since it, and whether training would have stopped by then. One training's history is short."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    best = F.max(score).over(w)
    own = history.withColumn("best", best)
    new = F.max(F.when(F.col(score) == F.col("best"), F.when(F.coalesce(F.lag("best").over(Window.orderBy(order)) < F.col("best"), F.lit(True)), F.col(order)))).over(w)
    return own.withColumn("since", F.col(order) - new).withColumn("stopped", F.max(F.col("since") >= patience).over(w))


def trigger_probability(cum: Column, threshold: Column, ant: Column, scale: float = 5.0, wetness: float = 0.30) -> Column:
    """Logistic in the rain over the threshold, which wet ground lowers."""
    return sigmoid((cum - threshold * (1 - F.lit(wetness) * ant)) / scale)


def snapshot(series: DataFrame, norm: DataFrame) -> DataFrame:
    """Short and long windows as shares of the normaliser (one row)."""
    w = by_node()
    (whole,) = free_names(series, "_norm")
    own = series.join(F.broadcast(norm.select(F.col("rain_norm").alias(whole))))
    share = lambda offsets: F.array(*[F.lag("rain", k, 0.0).over(w) / F.col(whole) for k in offsets])
    return own.withColumns({"short": share(SHORT_LAGS), "long": share(LONG_LAGS)}).drop(whole)


def shuffle_key(seed: int, *cols: str) -> Column:
    """A key to order rows by as by chance: MD5 of the seed and the row's values, the same on every engine."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]).cast("binary"))


def permuted(rows: DataFrame, cols: Sequence[str], seed: int = 0) -> DataFrame:
    """rows with ``place``, from 0, in an order of chance that the seed fixes; equal values of ``cols`` tie."""
    from tidegrid.operators.graph import relabel

    (by,) = free_names(rows, "_by")
    return relabel(rows.withColumn(by, shuffle_key(seed, *cols)), [by, *cols]).drop(by).withColumnRenamed("new_id", "place")


def sampled(rows: DataFrame, cols: Sequence[str], n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement (all if there are fewer): the first of the order that ``permuted`` gives, by an ordered take."""
    (by,) = free_names(rows, "_by")
    return rows.withColumn(by, shuffle_key(seed, *cols)).orderBy(by, *cols).limit(n).drop(by)


def sequences(series: DataFrame, label: str, window: int = 6, horizon: int = 3) -> DataFrame:
    """node_id, t, ``x`` (the rain of [t - window, t), oldest first) and ``y``, the label at t + horizon - 1, for every t that has both."""
    own = lags(series, range(window, 0, -1), "x").withColumn("y", F.lead(label, horizon - 1).over(by_node()) if horizon > 1 else F.col(label))
    return valid_steps(own, window, horizon).select("node_id", "t", "x", "y")


def encode_event(
    rain: DataFrame, thresholds: DataFrame, edges: DataFrame | None = None, half_life: float = 4.0, hours: int = 6, scale: float = 5.0
) -> DataFrame:
    """An event's series (node_id, t, rain) with ``cum``, ``ant``, ``p`` and ``label``: trailing sums, wetness, triggers against each
    node's threshold (node_id, threshold), states that decay (and go along ``edges``, if given), labels."""
    own = antecedent(trailing_sum(rain, hours)).join(thresholds.select("node_id", "threshold"), "node_id")
    trigger = F.when(F.col("cum").isNotNull(), F.round(trigger_probability(F.col("cum"), F.col("threshold"), F.col("ant"), scale), 9)).otherwise(0.0)
    own = own.withColumn("trig", trigger)
    if edges is None:
        own = decaying_max(own, "trig", half_life, "p")
    else:
        from tidegrid.operators.graph import propagate

        own = propagate(own, edges, "trig", half_life)
    own = own.withColumn("p", F.round("p", 6))
    return coherent(own.withColumn("wet", (F.col("p") >= 0.5).cast("int")), "wet").drop("trig", "wet", "threshold")
