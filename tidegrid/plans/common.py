"""What the registered queries share: the tables as series, nodes, grids and scored pairs, in Spark and in SQL.

Mapping: a node is a user of ``events`` or a customer, rain is the hourly sum of ``value``, the graph is a grid
over the customers, and documents with labels are scored pairs.
"""

from __future__ import annotations

from math import ceil, sqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.operators import graph, series
from tidegrid.session import ship
from tidegrid.sources import tables


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return tables.table(spark, sf_dir, name)


def settled(c: Column) -> Column:
    """Six digits; exact halves, which engines may see a bit above or below, are moved up first."""
    return F.round(c + F.lit(1e-9), 6)


def rain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.dense(series.hourly(table(spark, sf_dir, "events").select("user_id", "ts", "value"), "user_id", "ts", "value"))


RAIN = """
    h AS (SELECT user_id AS node_id, date_trunc('hour', ts) AS ts, round(sum(value), 6) AS rain FROM events GROUP BY ALL),
    b AS (SELECT min(ts) AS t0, CAST(date_diff('hour', min(ts), max(ts)) AS INTEGER) AS last FROM h),
    s AS (SELECT node_id, CAST(t AS INTEGER) AS t, t0 + to_hours(CAST(t AS INTEGER)) AS ts
          FROM (SELECT DISTINCT node_id FROM h), b, range(0, (SELECT last + 1 FROM b)) AS r(t)),
    rain AS (SELECT s.node_id, s.t, s.ts, coalesce(h.rain, 0) AS rain FROM s LEFT JOIN h ON h.node_id = s.node_id AND h.ts = s.ts)"""


def grid_size(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """Customers, and the side of the square that holds them."""
    n = table(spark, sf_dir, "customer").count()
    return n, max(1, ceil(sqrt(n)))


def grid_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id (the customer key's place from 0), r, c, lat, lon and elev of every customer.

    Customer keys are consecutive; the place is the distance from the smallest one.
    """
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    first = customers.agg(F.min("c_custkey").alias("_first"))
    _, side = grid_size(spark, sf_dir)
    own = customers.join(F.broadcast(first)).withColumn("node_id", F.col("c_custkey") - F.col("_first"))
    return own.select(
        "node_id",
        F.floor(F.col("node_id") / side).cast("int").alias("r"),
        (F.col("node_id") % side).cast("int").alias("c"),
        (F.lit(12.95) + F.floor(F.col("node_id") / side) * 0.0013).alias("lat"),
        (F.lit(80.20) + (F.col("node_id") % side) * 0.0013).alias("lon"),
        (F.abs("c_acctbal") / 200).alias("elev"),
    )


def grid_edges(spark: SparkSession, sf_dir: str, nodes: DataFrame | None = None) -> DataFrame:
    """u, v, length, edge_type (1: drain) and capacity of the grid's edges."""
    n, side = grid_size(spark, sf_dir)
    nodes = grid_nodes(spark, sf_dir) if nodes is None else nodes
    own = graph.grid_edges(nodes, n, side)
    drain = ((F.col("u") * 7 + F.col("v") * 3) % 7 == 0) & (F.col("dr") == 1)
    kinds = F.array(*[F.lit(x) for x in ("river", "canal", "stream", "drain", "ditch", "other")])
    kind = F.get(kinds, ((F.col("u") + F.col("v")) % 6).cast("int"))
    return own.select(
        "u", "v", (100.0 + (F.col("u") * 13 + F.col("v") * 17) % 100).alias("length"), drain.cast("double").alias("edge_type"), F.when(drain, graph.waterway_capacity(kind)).otherwise(0.0).alias("capacity")
    )


GRID = """
    g AS (SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS side, min(c_custkey) AS first FROM customer),
    nodes AS (SELECT c_custkey - first AS node_id, CAST((c_custkey - first) // side AS INTEGER) AS r, CAST((c_custkey - first) % side AS INTEGER) AS c,
                     12.95::DOUBLE + ((c_custkey - first) // side) * 0.0013::DOUBLE AS lat, 80.20::DOUBLE + ((c_custkey - first) % side) * 0.0013::DOUBLE AS lon,
                     abs(c_acctbal) / 200 AS elev FROM customer, g),
    steps AS (SELECT * FROM (VALUES (0, 1), (1, 0), (1, 1), (0, -1), (-1, 0)) AS x(dr, dc)),
    e0 AS (SELECT node_id AS u, (nodes.r + dr) * side + nodes.c + dc AS v, dr, dc, nodes.r + dr AS r2, nodes.c + dc AS c2, side, n FROM nodes, steps, g),
    e1 AS (SELECT u, v, dr FROM e0 WHERE r2 >= 0 AND c2 >= 0 AND c2 < side AND v < n),
    edges AS (SELECT u, v, 100.0::DOUBLE + (u * 13 + v * 17) % 100 AS length, CASE WHEN (u * 7 + v * 3) % 7 = 0 AND dr = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS edge_type,
                     CASE WHEN (u * 7 + v * 3) % 7 = 0 AND dr = 1 THEN [1.0, 0.8, 0.5, 0.4, 0.25, 0.1][(u + v) % 6 + 1]::DOUBLE ELSE 0.0::DOUBLE END AS capacity FROM e1)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p (relative log length of a document, six digits), y (its quality label) and lead of labelled documents."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    own = docs.join(labels, "doc_id").select("doc_id", F.ln(F.col("n_chars") + 1.0).alias("x"), F.col("quality").alias("y"))
    stats = own.agg(F.min("x").alias("_lo"), F.max("x").alias("_hi"))
    p = (F.col("x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    leads = F.get(F.array(*[F.lit(h) for h in series.LEADS]), (F.col("doc_id") % 4).cast("int"))
    return own.join(F.broadcast(stats)).select("doc_id", F.round(p, 6).alias("p"), "y", leads.alias("lead"))


SCORED = """
    x AS (SELECT doc_id, ln(n_chars + 1.0::DOUBLE) AS x, quality AS y FROM documents JOIN labels USING (doc_id)),
    m AS (SELECT min(x) AS lo, max(x) AS hi FROM x),
    scored AS (SELECT doc_id, round((x - lo) / (hi - lo), 6) AS p, y, [1, 3, 6, 12][doc_id % 4 + 1] AS lead FROM x, m)"""


def risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id and p_mean, p_max of the flood states of the users' series."""
    from tidegrid.operators import report

    return report.node_summary(states(spark, sf_dir))


def states(spark: SparkSession, sf_dir: str, factor: float = 1.0) -> DataFrame:
    """node_id, t, p: six-hour rain (times a factor) over a threshold of 400, logistic, decaying."""
    own = series.trailing_sum(rain(spark, sf_dir), 6, "cum").withColumn("cum", F.col("cum") * F.lit(factor))
    trig = F.when(F.col("cum").isNotNull(), series.trigger_probability(F.col("cum"), F.lit(400.0), F.lit(0.0), 100.0)).otherwise(0.0)
    return series.decaying_max(own.withColumn("trig", F.round(trig, 9)), "trig", 4.0, "p").select("node_id", "t", F.round("p", 6).alias("p"))


STATES = f"""{RAIN},
    w AS (SELECT node_id, t, CASE WHEN t >= 6 THEN sum(rain) OVER (PARTITION BY node_id ORDER BY t ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) END AS cum FROM rain),
    trig AS (SELECT node_id, t, CASE WHEN cum IS NULL THEN 0.0::DOUBLE ELSE round(1 / (1 + exp(-(cum - 400.0::DOUBLE) / 100.0::DOUBLE)), 9) END AS trig FROM w),
    states AS (SELECT node_id, t, round(coalesce(max(CASE WHEN trig > 0 THEN log2(trig) + t / 4.0::DOUBLE END) OVER (PARTITION BY node_id ORDER BY t ROWS UNBOUNDED PRECEDING), -1e9) , 12) AS l FROM trig),
    p AS (SELECT node_id, t, round(CASE WHEN l < -1e8 THEN 0 ELSE pow(2.0::DOUBLE, l - t / 4.0::DOUBLE) END, 6) AS p FROM states),
    risk AS (SELECT node_id, avg(p) AS p_mean, max(p) AS p_max FROM p GROUP BY node_id)"""
