"""Prediction tables: aggregates, rankings and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.risk import alert, as_coordinate, as_percent, risk_band


def node_summary(predictions: DataFrame) -> DataFrame:
    """Mean and maximum over the steps, by node."""
    return predictions.groupBy("node_id").agg(F.avg("p").alias("p_mean"), F.max("p").alias("p_max"))


def lead_summary(forecasts: DataFrame, leads: Sequence[int], prefix: str = "p_") -> DataFrame:
    """node_id, lead, p_mean and p_max over the steps of forecasts with a column for each lead: one aggregate by node, then a row a lead."""
    wide = forecasts.groupBy("node_id").agg(*[f(f"{prefix}{h}").alias(f"{n}_{h}") for h in leads for n, f in (("mean", F.avg), ("max", F.max))])
    rows = F.array(*[F.struct(F.lit(h).alias("lead"), F.col(f"mean_{h}").alias("p_mean"), F.col(f"max_{h}").alias("p_max")) for h in leads])
    return wide.select("node_id", F.explode(rows).alias("r")).select("node_id", "r.*")


def peak_step(predictions: DataFrame, first: int = 20) -> DataFrame:
    """The earliest of the first steps whose mean over nodes is largest."""
    steps = predictions.groupBy("t").agg(F.avg("p").alias("mean_p"))
    return steps.orderBy("t").limit(first).orderBy(F.desc("mean_p"), "t").limit(1)


def merge_batches(batches: DataFrame) -> DataFrame:
    """Predictions of overlapping batches: the mean for each node."""
    return batches.groupBy("node_id").agg((F.sum("p") / F.count("*")).alias("p"))


def top_nodes(nodes: DataFrame, n: int = 20, p: str = "p_mean") -> DataFrame:
    """The n largest with their rank, ties by node: one ordered take, then numbers on n rows."""
    top = nodes.orderBy(F.desc(p), "node_id").limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(p), "node_id"))).withColumn("risk", risk_band(F.col(p))["label"])


def high_risk(nodes: DataFrame, over: float = 0.7, n: int = 10, p: str = "p_mean") -> DataFrame:
    return nodes.filter(F.col(p) > over).orderBy(F.desc(p), "node_id").limit(n)


def band_counts(nodes: DataFrame, edges: tuple[float, ...], p: str = "p_mean") -> DataFrame:
    """One row: how many nodes are at or over each edge, and under the first."""
    return nodes.agg(F.count_if(F.col(p) < edges[0]).alias("under"), *[F.count_if(F.col(p) >= e).alias(f"over_{round(e * 100)}") for e in edges])


def category_counts(nodes: DataFrame, level: Column, n: int) -> DataFrame:
    """Nodes by level 0 to n - 1; levels without nodes are there with 0."""
    counts = nodes.groupBy(level.cast("int").alias("level")).agg(F.count("*").alias("n"))
    spine = nodes.sparkSession.range(n).select(F.col("id").cast("int").alias("level"))
    return spine.join(counts, "level", "left").select("level", F.coalesce("n", F.lit(0)).alias("n"))


def summary(nodes: DataFrame, p: str = "p_mean") -> DataFrame:
    return nodes.agg(F.count("*").alias("n"), F.avg(p).alias("mean"), F.stddev_pop(p).alias("std"), F.min(p).alias("min"), F.max(p).alias("max"))


def alert_row(nodes: DataFrame, threshold: float = 0.5, p: str = "p_mean") -> DataFrame:
    """One row: nodes at risk, their share, mean and maximum, and the alert state."""
    own = nodes.agg(F.count_if(F.col(p) >= threshold).alias("at_risk"), F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.max(p).alias("max_p"))
    share = F.coalesce(F.try_divide(F.col("at_risk"), F.col("n")), F.lit(0.0))
    return own.withColumn("share", share).withColumn("alert", alert(F.col("share")))


def display(nodes: DataFrame, p: str = "p_mean") -> DataFrame:
    """Text columns as a table shows them."""
    return nodes.select("node_id", as_coordinate(F.col("lat")).alias("lat"), as_coordinate(F.col("lon")).alias("lon"), as_percent(F.col(p)).alias("p"), risk_band(F.col(p))["label"].alias("risk"))


def paired_change(scenario: DataFrame, history: DataFrame, p: str = "p") -> DataFrame:
    """Scenario less history, by node."""
    return scenario.select("node_id", F.col(p).alias("p_scenario")).join(history.select("node_id", F.col(p).alias("p_history")), "node_id").withColumn("change", F.col("p_scenario") - F.col("p_history"))


def spread_over(steps: DataFrame, start: int, hours: int, spread: str = "std") -> DataFrame:
    """One row: mean and maximum of the spread over a window of steps."""
    return steps.filter(F.col("t").between(start, start + hours - 1)).agg(F.avg(spread).alias("mean_spread"), F.max(spread).alias("max_spread"))


def flood_report(nodes: DataFrame, threshold: float = 0.5, p: str = "p_mean") -> DataFrame:
    """One row: nodes, flooded or not, and by band of risk, with mean and maximum."""
    c = F.col(p)
    return nodes.agg(
        F.count("*").alias("total"), F.count_if(c >= threshold).alias("flooded"), F.count_if(c < threshold).alias("not_flooded"), F.count_if(c >= 0.8).alias("high_risk"),
        F.count_if((c >= 0.5) & (c < 0.8)).alias("medium_risk"), F.count_if((c >= 0.3) & (c < 0.5)).alias("low_risk"), F.count_if(c < 0.3).alias("no_risk"), F.avg(p).alias("mean"), F.max(p).alias("max"),
    )


def usable(history: DataFrame, least_f1: float = 0.05) -> bool:
    """Whether a training's best F1 reaches the least that a checkpoint must have."""
    best = history.agg(F.max("val_f1")).first()[0]
    return best is not None and best >= least_f1
