"""Graph construction and traversal: nodes and edges are DataFrames, every round of a traversal is one join."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegrid.functions.maths import clip
from tidegrid.functions.names import free_names

#: Relative capacity of each kind of waterway; others get the default.
WATERWAY_CAPACITY = {"river": 1.0, "canal": 0.8, "stream": 0.5, "drain": 0.4, "ditch": 0.25}
DEFAULT_CAPACITY = 0.1
#: Neighbours of a grid cell (row, column steps), in the order that ties are broken by.
GRID_STEPS = ((0, 1), (1, 0), (1, 1), (0, -1), (-1, 0))


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the cluster's shared folder (spark.checkpoint.dir), which cuts the lineage of a loop."""
    spark = df.sparkSession
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = getattr(spark.sparkContext, "_tidegrid_dir", None) or tempfile.mkdtemp(prefix="tidegrid-")
        spark.sparkContext._tidegrid_dir = top
    path = f"{top.rstrip('/')}/tidegrid-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of an edge table that a task gets on average, at most, where they are dealt by their number.
EDGE_ROWS = 500_000


def dealt(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """df, of about that many rows, by columns over as many parts as they need; few rows go to fewer parts than shuffles have."""
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(ceil(rows / EDGE_ROWS), min(usual, ceil(rows / 20_000)), 1), *by)


def waterway_capacity(kind: Column) -> Column:
    """The capacity of a kind of waterway, in any case; the default for others and null."""
    table = F.create_map(*[F.lit(x) for kv in WATERWAY_CAPACITY.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(kind)), F.lit(DEFAULT_CAPACITY))


def grid(spark: SparkSession, n: int, side: int, steps: Sequence[tuple[int, int]] = GRID_STEPS) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, r, c) 0 to n - 1 in rows of ``side``, and edges (u, v, dr, dc) by steps that stay inside."""
    nodes = spark.range(n).select(F.col("id").alias("node_id"), F.floor(F.col("id") / side).cast("int").alias("r"), (F.col("id") % side).cast("int").alias("c"))
    return nodes, grid_edges(nodes, n, side, steps)


def grid_edges(nodes: DataFrame, n: int, side: int, steps: Sequence[tuple[int, int]] = GRID_STEPS) -> DataFrame:
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in steps]))
    own = nodes.select("node_id", "r", "c", step.alias("s"))
    to_c, v = F.col("c") + F.col("s.dc"), (F.col("r") + F.col("s.dr")).cast("long") * side + F.col("c") + F.col("s.dc")
    inside = (F.col("r") + F.col("s.dr") >= 0) & (to_c >= 0) & (to_c < side) & (v < n)
    return own.filter(inside).select(F.col("node_id").alias("u"), v.alias("v"), F.col("s.dr").alias("dr"), F.col("s.dc").alias("dc"))


def floored_length(length: Column) -> Column:
    """At least 1; 1 if it is missing."""
    return F.greatest(F.coalesce(length, F.lit(1.0)), F.lit(1.0))


def without_loops(edges: DataFrame) -> DataFrame:
    return edges.filter("u <> v")


def shortest_parallel(edges: DataFrame, order: str = "key") -> DataFrame:
    """One edge for each (u, v), of the least length after the floor. Loops go.

    Edges are taken in their order: each that is shorter than all before it lays its attributes over those of the ones before,
    so that an attribute which it lacks keeps its value. Of equally short ones the first counts.
    """
    (shorter,) = free_names(edges, "_shorter")
    own = without_loops(edges).withColumn("length", floored_length(F.col("length")))
    place = F.struct(F.col(order).isNotNull().alias("a"), F.col(order).alias("b"))  # a missing order comes first
    before = Window.partitionBy("u", "v").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn(shorter, F.col("length") < F.coalesce(F.min("length").over(before), F.lit(float("inf"))))
    rest = [c for c in edges.columns if c not in ("u", "v", "length")]
    last = lambda c: F.max_by(c, F.when(F.col(shorter) & F.col(c).isNotNull(), place)).alias(c)
    found = own.groupBy("u", "v").agg(F.min("length").alias("length"), *[last(c) for c in rest])
    return found.select("u", "v", *[c for c in edges.columns if c not in ("u", "v")])


def both_directions(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.withColumns({"u": F.col("v"), "v": F.col("u")}))


def compose(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("u", "v")) -> DataFrame:
    """Union of two edge tables; where both have an edge, the right one's attributes win, one by one."""
    values = [c for c in left.columns if c not in keys]
    extra = [c for c in right.columns if c not in keys and c not in values]
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in values})
    out = left.join(renamed, list(keys), "full_outer")
    return out.select(*keys, *[F.coalesce(f"_r_{c}", c).alias(c) if f"_r_{c}" in out.columns else F.col(c) for c in values], *extra)


def components(edges: DataFrame, most_rounds: int = 60, rows: int | None = None, gathered: bool = True) -> DataFrame:
    """node and component (its smallest node) of every node with an edge; alternating star steps, each written out. Edges of which
    hardly any two are alike are better made distinct in parts by their number, ``rows``. Without ``gathered`` no
    side of a join goes through the driver to be broadcast."""
    plain = (lambda df: df) if gathered else (lambda df: df.hint("merge"))
    down = without_loops(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    edges = written((dealt(down, rows, "u", "v") if rows else down).distinct(), "wcc")
    before = None
    for _ in range(most_rounds):
        both = both_directions(edges)
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(plain(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        joined = large.join(plain(large.groupBy("u").agg(F.min("v").alias("m"))), "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        edges = written(without_loops(small).distinct(), "wcc")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = now
    raise RuntimeError(f"components: no end after {most_rounds} rounds")


def largest_component(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """The nodes of the largest component; of equals, that with the smallest node. ``rows`` as for ``components``."""
    found = written(components(edges, rows=rows), "found")
    top = found.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return found.join(F.broadcast(top), "component").select("node", "component", "n")


def drain_capacity(nodes: DataFrame, edges: DataFrame, both_ends: bool = True) -> DataFrame:
    """Each node's largest capacity of an edge that it has (or starts), 0 without one."""
    ends = edges.select(F.explode(F.array("u", "v")).alias("node_id"), "capacity") if both_ends else edges.select(F.col("u").alias("node_id"), "capacity")
    return nodes.join(ends.groupBy("node_id").agg(F.max("capacity").alias("drain")), "node_id", "left").withColumn("drain", F.coalesce("drain", F.lit(0.0)))


def on_waterway(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.filter("edge_type > 0.5").select(F.explode(F.array("u", "v")).alias("node_id"))
    return nodes.join(ends, "node_id", "left_semi")


def with_ends(edges: DataFrame, nodes: DataFrame, value: str) -> DataFrame:
    """Edges with the value of both ends; edges to unknown nodes go."""
    one = nodes.select(F.col("node_id").alias("u"), F.col(value).alias("from_value"))
    two = nodes.select(F.col("node_id").alias("v"), F.col(value).alias("to_value"))
    return edges.join(one, "u").join(two, "v")


def edge_features(edges: DataFrame, nodes: DataFrame, value: str, gain: float = 1000.0, steep: float = 0.001, least_range: float | None = None) -> DataFrame:
    """elev_diff_norm, length_norm, edge_type and flow_weight of each edge, from the fall from u to v.

    Without ``least_range`` the value is scaled to 0..1 first (a stand-in for heights); with it, it is a height, and
    its range counts as that much at least. Flow: on a waterway a logistic of the gradient by capacity, else
    0.2, and 0.1 more where it is steep.
    """
    stats = nodes.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    longest = edges.agg(F.max(floored_length(F.col("length"))).alias("_longest"))
    own = with_ends(edges, nodes, value).join(F.broadcast(stats)).join(F.broadcast(longest))
    span = F.col("_hi") - F.col("_lo")
    fall = F.col("from_value") - F.col("to_value")
    if least_range is None:
        fall = fall / F.greatest(span, F.lit(1e-6))
        norm = fall
    else:
        norm = fall / F.greatest(span, F.lit(least_range))
    length = floored_length(F.col("length"))
    gradient = fall / length
    water = F.lit(1.0) / (1 + F.exp(-gradient * gain)) * (0.5 + 0.5 * F.col("capacity"))
    flow = F.when(F.col("edge_type") > 0.5, water).otherwise(0.2 + 0.1 * (F.abs(gradient) > steep).cast("double"))
    return own.select(
        "u", "v", clip(norm, -1.0, 1.0).alias("elev_diff_norm"), clip(length / F.col("_longest"), 0.0, 1.0).alias("length_norm"), F.col("edge_type").cast("double").alias("edge_type"), clip(flow, 0.0, 1.0).alias("flow_weight")
    )


def benchmark_edge_features(edges: DataFrame, nodes: DataFrame, value: str = "elev") -> DataFrame:
    """elev_diff_norm, length_norm, edge_type and flow_weight of each edge: falls as shares of the range of heights (1 at least),
    lengths of the longest (1 at least); the flow is a drain's fall, 0 uphill, and 0.1 elsewhere."""
    stats = nodes.agg(F.greatest(F.max(value) - F.min(value), F.lit(1.0)).alias("_span"))
    longest = edges.agg(F.greatest(F.max("length"), F.lit(1.0)).alias("_longest"))
    own = with_ends(edges, nodes, value).join(F.broadcast(stats)).join(F.broadcast(longest))
    fall = (F.col("from_value") - F.col("to_value")) / F.col("_span")
    flow = F.when(F.col("edge_type") == 1, F.greatest(fall, F.lit(0.0))).otherwise(0.1)
    return own.select("u", "v", clip(fall, -1.0, 1.0).alias("elev_diff_norm"), (F.col("length") / F.col("_longest")).alias("length_norm"), F.col("edge_type").cast("double").alias("edge_type"), flow.alias("flow_weight"))


def k_hop(seeds: DataFrame, edges: DataFrame, k: int = 3, fanout: Sequence[int] | None = None, seed: int = 0) -> DataFrame:
    """node and hop of all nodes within k steps against the edges' direction (v's sources); the smallest hop of each.

    With ``fanout``, at most that many sources of a node are followed in each hop: those whose MD5 of seed + hop, node and source is
    smallest. Each task of the join keeps no more than that many of a node before the shuffle (a group limit below the window), so a
    hub's whole list is sorted nowhere. The edges are made distinct and written once, and so is each hop; they are made
    distinct in parts by their number, so that no task's memory grows with it.
    """
    raw = written(edges.select(F.col("v").alias("node"), F.col("u").alias("next")), "raw")
    n = raw.count()
    links = written(dealt(raw, n, "node", "next").distinct(), "links")
    seen = front = written(seeds.select(F.col("node").cast("long").alias("node"), F.lit(0).alias("hop")).distinct(), "hop")
    for h in range(1, k + 1):
        step = front.select("node").join(links, "node")
        if fanout is not None:
            key = F.md5(F.concat_ws("-", F.lit(str(seed + h)), F.col("node").cast("string"), F.col("next").cast("string")).cast("binary"))
            order = Window.partitionBy("node").orderBy("_key", "next")
            step = step.withColumn("_key", key).withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= fanout[h - 1])
        front = written(step.select(F.col("next").alias("node")).distinct().join(seen, "node", "left_anti").select("node", F.lit(h).alias("hop")), "hop")
        seen = seen.unionByName(front)
    return seen


def relabel(nodes: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """Consecutive numbers from 0 in an order: counts by range part first, so that no task numbers all rows."""
    k, part, n, start = free_names(nodes, "_key", "_part", "_n", "_first")
    parts = nodes.withColumn(k, F.struct(*order)).repartitionByRange(k).sortWithinPartitions(k).withColumn(part, F.spark_partition_id())
    parts = written(parts.drop(k), "parts")
    counts = parts.groupBy(part).agg(F.count("*").alias(n))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    first = counts.select(part, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(start))
    own = Window.partitionBy(part).orderBy(*order)
    return parts.withColumn("new_id", F.row_number().over(own) - 1).join(F.broadcast(first), part).withColumn("new_id", F.col("new_id") + F.col(start)).drop(part, start)


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, degrees (in and out), numbers of weak and of strong components, nodes without an edge among them."""
    from tidegrid.operators.order import quantiles
    from tidegrid.operators.strong import strong_components

    degree = edges.select(F.explode(F.array("u", "v")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("d"))
    own = written(nodes.select("node_id").join(degree, "node_id", "left").withColumn("d", F.coalesce("d", F.lit(0))), "degrees")
    middle = F.lit(quantiles(own, "d", [0.5])[0]).cast("double").alias("median_degree")
    sums = own.agg(F.count("*").alias("n_nodes"), F.avg("d").alias("avg_degree"), F.min("d").alias("min_degree"), F.max("d").alias("max_degree"), middle, F.count_if(F.col("d") == 0).alias("_alone"))
    found = written(strong_components(edges), "strong")
    strong = found.agg(F.count_distinct("component").alias("_strong"))
    # Weak components are those of the strong ones: as many, less one for each edge of a forest that spans what is between them.
    to = {x: found.select(F.col("node").alias(x), F.col("component").alias(f"_{x}")) for x in "uv"}
    between = edges.select("u", "v").join(to["u"].hint("merge"), "u").join(to["v"].hint("merge"), "v").filter("_u <> _v").select(F.col("_u").alias("u"), F.col("_v").alias("v"))
    joined = components(between, gathered=False).agg(F.count("*").alias("_in"), F.count_distinct("component").alias("_of"))
    weak = strong.join(joined).select((F.col("_strong") - F.col("_in") + F.col("_of")).alias("_weak"))
    size = edges.agg(F.count("*").alias("n_edges"))
    kinds = {"n_components": F.col("_weak") + F.col("_alone"), "n_strong_components": F.col("_strong") + F.col("_alone")}
    return sums.join(size).join(weak).join(strong).withColumns(kinds).drop("_weak", "_strong", "_alone")


def strongly_connected(nodes: DataFrame, edges: DataFrame) -> bool:
    """Whether a walk along the edges leads from each node to every other."""
    from tidegrid.operators.strong import strong_components

    found = nodes.select(F.col("node_id").alias("node")).join(strong_components(edges), "node", "left")
    n, alone, kinds = found.agg(F.count("*"), F.count_if(F.col("component").isNull()), F.count_distinct("component")).first()
    return n <= 1 or alone == 0 and kinds == 1


def propagate(series: DataFrame, edges: DataFrame, trigger: str, half_life: float = 4.0, strength: float = 0.9, least: float = 1e-7, out: str = "p") -> DataFrame:
    """p[t, v] = max(d p[t-1, v], trigger[t, v], strength max over u -> v of p[t-1, u]) for every row of the series.

    A value is a trigger times a factor for each edge that it goes along and each hour that it stays, in whatever order, so stays
    can come last: triggers go along edges hour by hour, and what they bring is one more trigger of the decaying maximum, in its
    closed form. A node's own closed form is known from the start; what comes to no more than that is dropped, for whatever it
    would bring later the node brings as well. The rest loses a factor of ``strength`` an hour and dies out by itself where states
    are over 0; where they are 0, below ``least``, under which a state may lack what its neighbours would add. A hub costs its edges,
    not pairs of its neighbours.
    """
    from tidegrid.operators.series import decaying_max

    at, of = ("node_id", "t"), F.col("_x")
    own = decaying_max(series.select(*at, F.coalesce(trigger, F.lit(0.0)).alias("_x")), "_x", half_life, "_own")
    own = written(own.select(F.col("node_id"), F.col("t").cast("long").alias("t"), "_x", "_own"), "triggers")
    links = written(edges.select(F.col("u").alias("node_id"), F.col("v").alias("_to")).distinct(), "links")
    front, fronts = own.filter((of >= least) & (of >= F.col("_own") * (1 - 1e-9))).select(*at, "_x"), []
    while True:
        along = front.join(links, "node_id").select(F.col("_to").alias("node_id"), (F.col("t") + 1).alias("t"), (of * F.lit(strength)).alias("_x"))
        along = along.filter(of >= least).groupBy(*at).agg(F.max("_x").alias("_x"))
        front = written(along.join(own.select(*at, "_own"), list(at)).filter(of > F.col("_own") * (1 + 1e-9)).select(*at, "_x"), "front")
        if front.isEmpty():
            break
        fronts.append(front)
    rows = own.select(*at, "_x")
    for x in fronts:
        rows = rows.unionByName(x)
    best = decaying_max(rows.groupBy(*at).agg(F.max("_x").alias("_x")), "_x", half_life, out)
    kept = series.drop(out).withColumn("t", F.col("t").cast("long")) if out in series.columns else series.withColumn("t", F.col("t").cast("long"))
    return kept.join(best.select(*at, out), list(at)).withColumn("t", F.col("t").cast(series.schema["t"].dataType))
