"""Queries on graphs, space and message passing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegrid.operators import features, gnn, graph, metrics, spatial, strong
from tidegrid.plans.common import GRID, grid_edges, grid_nodes, settled, table
from tidegrid.sources import tables


def grid_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_edges(spark, sf_dir).select("u", "v", "length", "edge_type", "capacity")


def node_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node_id"), F.when(F.col("c_nationkey") > 3, F.col("c_acctbal")).alias("x"))
    return tables.node_records(own)


def drainage_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_edges(spark, sf_dir).filter("edge_type > 0.5").select("u", "v", "capacity")


def both_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("u"), F.col("l_suppkey").alias("v"))
    return graph.both_directions(own).groupBy("u", "v").agg(F.count("*").alias("n"))


def edge_dedupe_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("u"), F.col("l_suppkey").alias("v"), (F.col("l_extendedprice") / 1000 - 5).alias("length"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), "l_quantity"
    )
    return graph.shortest_parallel(own).select("u", "v", F.round("length", 6).alias("length"), "key", "l_quantity")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and the parts of all their orders' lines; parts are numbered below 0."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    n = lines.count()  # from the files' footers
    lines, orders = graph.dealt(lines, n, "l_orderkey"), graph.dealt(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), n, "o_orderkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("u"), (-F.col("l_partkey") - 1).alias("v"))


_PAIRS = "pairs AS (SELECT o_custkey AS u, -l_partkey - 1 AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers of one market segment."""
    return table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("node"))


def wcc_largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.largest_component(_pairs(spark, sf_dir), table(spark, sf_dir, "lineitem").count()).select("node", "component")


def drain_capacity_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = grid_nodes(spark, sf_dir), grid_edges(spark, sf_dir)
    two = graph.drain_capacity(nodes.select("node_id"), edges)
    return two.join(graph.drain_capacity(nodes.select("node_id"), edges, both_ends=False).withColumnRenamed("drain", "drain_from"), "node_id")


def waterway_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.on_waterway(grid_nodes(spark, sf_dir), grid_edges(spark, sf_dir)).select("node_id")


def _edge_features(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    nodes = grid_nodes(spark, sf_dir)
    own = graph.edge_features(grid_edges(spark, sf_dir, nodes), nodes, **how)
    return own.select("u", "v", *[settled(F.col(c)).alias(c) for c in ("elev_diff_norm", "length_norm", "edge_type", "flow_weight")])


def edge_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edge_features(spark, sf_dir, value="lat")


def edge_features_refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edge_features(spark, sf_dir, value="elev", gain=50.0, steep=0.01, least_range=1.0)


def benchmark_edge_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = grid_nodes(spark, sf_dir)
    own = graph.benchmark_edge_features(grid_edges(spark, sf_dir, nodes), nodes)
    return own.select("u", "v", *[settled(F.col(c)).alias(c) for c in ("elev_diff_norm", "length_norm", "edge_type", "flow_weight")])


def khop_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = graph.both_directions(_pairs(spark, sf_dir))
    return graph.k_hop(_seeds(spark, sf_dir), edges, 3)


def khop_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of three hops of at most 15, 10 and 5 neighbours each, chosen by MD5."""
    edges = graph.both_directions(_pairs(spark, sf_dir))
    return graph.k_hop(_seeds(spark, sf_dir), edges, 3, fanout=(15, 10, 5))


def strong_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, with an edge for every order to the next order's customer within 4,096 order keys."""
    w = Window.partitionBy(F.floor(F.col("o_orderkey") / 4096)).orderBy("o_orderkey")
    own = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("u"), F.lead("o_custkey").over(w).alias("v"))
    return strong.strong_components(own.filter("v IS NOT NULL").select("u", "v"))


def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = graph.statistics(grid_nodes(spark, sf_dir), grid_edges(spark, sf_dir))
    return own.withColumn("avg_degree", F.round("avg_degree", 6))


def graph_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "lineitem")
    side = lambda flag: own.filter(F.col("l_returnflag") == flag).groupBy(F.col("l_partkey").alias("u"), F.col("l_suppkey").alias("v")).agg(F.max("l_quantity").alias("w"), F.min("l_discount").alias("d"))
    return graph.compose(side("A"), side("R"))


def relabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return graph.relabel(own, ["c_acctbal", "c_custkey"]).select("c_custkey", F.col("new_id").cast("long").alias("new_id"))


# --- message passing ----------------------------------------------------------------------------------------


def _x(nodes: DataFrame) -> DataFrame:
    return nodes.select("node_id", F.col("elev").alias("x"), (F.col("r") * 1.0 - F.col("c")).alias("z"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("node_id", *[settled(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes if c != "node_id"])


def sage_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = grid_nodes(spark, sf_dir)
    return _rounded(gnn.sage(grid_edges(spark, sf_dir, nodes), _x(nodes), ["x", "z"], "max"))


def sage_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = grid_nodes(spark, sf_dir)
    return _rounded(gnn.sage(grid_edges(spark, sf_dir, nodes), _x(nodes), ["x", "z"], "mean"))


def gcn_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = grid_nodes(spark, sf_dir)
    return _rounded(gnn.gcn(grid_edges(spark, sf_dir, nodes), _x(nodes), ["x"]))


def gat_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attention of one head: leaky ReLU of source, target and edge terms, softmax by target."""
    nodes = grid_nodes(spark, sf_dir)
    score = gnn.leaky_relu(0.05 * F.col("s_x") - 0.03 * F.col("t_x") + 0.01 * F.col("length") + 0.5 * F.col("edge_type")) * 0.7
    return _rounded(gnn.attention(grid_edges(spark, sf_dir, nodes), _x(nodes), "x", score))


def mc_dropout_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = gnn.dropout_samples(_x(grid_nodes(spark, sf_dir)), "x", 20)
    return _rounded(metrics.mean_and_spread(samples, ["node_id"]))


def network_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The users' snapshots with sixteen static features, and the edges of a grid with their four features."""
    from tidegrid.operators import series
    from tidegrid.plans.common import rain

    own = rain(spark, sf_dir)
    snap = series.valid_steps(series.snapshot(own, series.positive_percentile(own)))
    static = F.transform(F.sequence(F.lit(1), F.lit(16)), lambda k: F.sin(F.col("node_id") * k * 0.1))
    features = _edge_features(spark, sf_dir, value="elev", gain=50.0, steep=0.01, least_range=1.0)
    return snap.withColumn("static", static), features.select("u", "v", F.array("elev_diff_norm", "length_norm", "edge_type", "flow_weight").alias("e"))


def dense_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole network with fixed weights on every snapshot: encoders, attention and maximum layers, head (no SQL: see the tests)."""
    snap, edges = network_inputs(spark, sf_dir)
    return gnn.forward(snap, edges, gnn.weights(gnn.SHAPES))


def forward_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation of twenty forwards with units dropped, on every snapshot."""
    snap, edges = network_inputs(spark, sf_dir)
    return gnn.forward_with_spread(snap, edges, gnn.weights(gnn.SHAPES))


def gru_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recurrent baseline with fixed weights on every snapshot."""
    return gnn.gru_baseline(network_inputs(spark, sf_dir)[0], gnn.weights(gnn.GRU_SHAPES))


def older_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities and embeddings of the older network with fixed weights, on every snapshot."""
    snap, edges = network_inputs(spark, sf_dir)
    return gnn.older_forward(snap, edges, gnn.older_weights())


# --- space --------------------------------------------------------------------------------------------------


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x, y and elev of the first dimensions of the vectors."""
    e = lambda k: F.get("embedding", F.lit(k)).cast("double")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), e(0).alias("x"), e(1).alias("y"), (e(2) * 10).alias("elev"))


_POINTS = "pts AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE * 10 AS elev FROM embeddings)"
_KNN = f"""{_POINTS},
    d AS (SELECT a.id, b.id AS other, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS dist, a.elev AS e, b.elev AS oe FROM pts a JOIN pts b ON a.id <> b.id),
    knn AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY dist, other) AS INTEGER) AS rank FROM d QUALIFY rank <= 8)"""


def knn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir)
    return spatial.k_nearest(p, p, 8).select("id", "other", settled(F.col("dist")).alias("dist"), "rank")


def knn_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir)
    own = spatial.neighbour_slope(spatial.k_nearest(p, p, 8), p)
    return own.select("id", settled(F.col("slope")).alias("slope"), "uphill", settled(F.col("slope_mean_dist")).alias("slope_mean_dist"))


def nearest_drain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance to the nearest source of a drain, as a share of 2 km; nearest by cells of the grid."""
    nodes = grid_nodes(spark, sf_dir)
    drains = grid_edges(spark, sf_dir, nodes).filter("edge_type > 0.5").select(F.col("u").alias("node_id")).distinct().join(nodes, "node_id")
    p = lambda d: d.select(F.col("node_id").alias("id"), F.radians("lon").alias("x"), F.radians("lat").alias("y"))
    near = spatial.k_nearest(p(nodes), p(drains), 1, skip_self=False)
    return near.select(F.col("id").alias("node_id"), settled(F.least(F.col("dist") * 6_371_000.0 / 2000, F.lit(1.0))).alias("drain_dist"))


def drain_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without drains: the lowest tenth of the nodes by latitude stands for them."""
    nodes = grid_nodes(spark, sf_dir)
    found = features.drain_distance(nodes, grid_edges(spark, sf_dir, nodes).filter("edge_type < 0.5"))
    return found.select("node_id", settled(F.col("drain_dist")).alias("drain_dist"))


def drain_distance_by_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = grid_nodes(spark, sf_dir)
    found = features.drain_distance_by_max(nodes, grid_edges(spark, sf_dir, nodes))
    return found.select("node_id", settled(F.col("drain_dist")).alias("drain_dist"))


def lowest_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.lowest(grid_nodes(spark, sf_dir)).select("node_id", "lat")


def river_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rivers = spark.createDataFrame(tables.RIVERS, "r_lat double, r_lon double")
    return spatial.river_proximity(grid_nodes(spark, sf_dir).select("node_id", "lat", "lon"), rivers).select("node_id", settled(F.col("river")).alias("river"))


def coast_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_nodes(spark, sf_dir).select("node_id", settled(spatial.coast_distance(F.col("lat"), F.col("lon"), *tables.COAST)).alias("coast"))


def _stations(spark: SparkSession) -> DataFrame:
    return spark.range(7).select((80.2 + F.col("id") * 0.02).alias("s_x"), (12.95 + (F.col("id") * 3 % 7) * 0.02).alias("s_y"), (F.col("id") * F.col("id") + 1.0).alias("s_value"))


_STATIONS = "st AS (SELECT 80.2::DOUBLE + i * 0.02::DOUBLE AS s_x, 12.95::DOUBLE + (i * 3 % 7) * 0.02::DOUBLE AS s_y, i * i + 1.0::DOUBLE AS s_value FROM range(7) AS r(i))"


def idw_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = grid_nodes(spark, sf_dir).select("node_id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return spatial.idw_all(p, _stations(spark)).select("node_id", settled(F.col("value")).alias("value"))


def idw_k5(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir).withColumn("value", F.when(F.col("id") % 4 != 0, F.col("elev")))
    return spatial.idw_nearest(p, "value").select("id", settled(F.col("value")).alias("value"))


def station_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = _stations(spark).select(F.col("s_y").alias("lat"), F.col("s_value").alias("rain"))
    p = grid_nodes(spark, sf_dir).select("node_id", (F.col("lat") - 0.02).alias("lat"))
    return spatial.interpolate_by(p, st).select("node_id", settled(F.col("rain")).alias("rain"))


def raster_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a raster of 40 x 40, every 11th without data; nodes outside it, and these, get the median."""
    raster = spark.range(1600).select((F.col("id") % 40).cast("int").alias("col"), F.floor(F.col("id") / 40).cast("int").alias("row"), F.when(F.col("id") % 11 == 0, -9999.0).otherwise(F.col("id") * 0.5).alias("value"))
    p = grid_nodes(spark, sf_dir).select("node_id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    found = spatial.sample_raster(p, raster, 80.2003, 13.0003, 0.0007, -9999.0)
    return spatial.fill_raster(found).select("node_id", "row", "col", F.round("value", 6).alias("value"))


def raster_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three bands of a mosaic that the parts make, tiles of 20 x 20 cells that overlap by a column: nodata by band, then fills by band."""
    k, at = F.floor(F.col("p_partkey") / 400), F.col("p_partkey") % 400
    cells = table(spark, sf_dir, "part").select(k.alias("tile"), F.floor(at / 20).alias("row"), (at % 20).alias("col"), *[F.when(F.col("p_partkey") % n == 0, -9999.0).otherwise(c).alias(b) for b, n, c in (("red", 11, F.col("p_retailprice")), ("nir", 7, F.col("p_size") * 1.0), ("swir", 5, F.col("p_retailprice") / F.col("p_size")))])
    place = lambda c, start, step: F.lit(start) + c * F.lit(step)
    tiles = cells.select("tile").distinct().select("tile", place(F.col("tile") % 4, 80.2003, 0.0133).alias("x0"), place(F.floor(F.col("tile") / 4), 13.0003, -0.014).alias("y0"), F.lit(0.0007).alias("res"), F.lit(20).alias("rows"), F.lit(20).alias("cols"))
    p = grid_nodes(spark, sf_dir).select("node_id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    found = spatial.sample_tiles(p, tiles, cells, ["red", "nir", "swir"], {"red": -9999.0, "nir": -9999.0, "swir": -9999.0})
    return spatial.fill_bands(found, {"red": None, "nir": 0.0, "swir": None}).select("node_id", *[settled(F.col(b)).alias(b) for b in ("red", "nir", "swir")])


QUERIES = {
    f.__name__: f
    for f in (
        grid_graph, node_records, drainage_edges, both_directions, edge_dedupe_min, wcc_largest, drain_capacity_max, waterway_nodes, edge_features, edge_features_refined, khop_3, khop_sampled, strong_components,
        graph_stats, graph_compose, relabelled, sage_max, sage_mean, gcn_norm, gat_softmax, mc_dropout_stats, dense_forward, forward_spread, gru_baseline, older_embeddings, benchmark_edge_features, drain_fallback, drain_distance_by_max, lowest_nodes, knn_pairs, knn_slope, nearest_drain, river_proximity, coast_distance,
        idw_all, idw_k5, station_interp, raster_sample, raster_tiles,
    )
}

_HAV = "2 * 6371000.0::DOUBLE * asin(sqrt(least(greatest(pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2), 0), 1)))"
_EDGE = """SELECT u, v, round(least(greatest(fall / {span}, -1), 1) + 1e-9, 6) AS elev_diff_norm, round(length / longest + 1e-9, 6) AS length_norm, round(edge_type + 1e-9, 6) AS edge_type,
        round(least(greatest(CASE WHEN edge_type > 0.5 THEN 1 / (1 + exp(-fall / length * {gain}::DOUBLE)) * (0.5::DOUBLE + 0.5::DOUBLE * capacity)
            ELSE 0.2::DOUBLE + CASE WHEN abs(fall / length) > {steep}::DOUBLE THEN 0.1::DOUBLE ELSE 0 END END, 0), 1) + 1e-9, 6) AS flow_weight FROM f"""
_X = f"WITH {GRID}, x AS (SELECT node_id, elev AS x, r * 1.0::DOUBLE - c AS z FROM nodes)"
_REACH = f"""WITH RECURSIVE {_PAIRS}, sym AS (SELECT DISTINCT u, v FROM pairs UNION SELECT DISTINCT v, u FROM pairs)"""

ORACLES = {
    "grid_graph": f"WITH {GRID} SELECT u, v, length, edge_type, capacity FROM edges",
    "node_records": "SELECT c_custkey AS node_id, c_custkey AS osmid, CASE WHEN c_nationkey > 3 THEN c_acctbal ELSE 0 END AS lon, 0.0::DOUBLE AS lat FROM customer",
    "drainage_edges": f"WITH {GRID} SELECT u, v, capacity FROM edges WHERE edge_type > 0.5",
    "both_directions": "SELECT u, v, count(*) AS n FROM (SELECT l_partkey AS u, l_suppkey AS v FROM lineitem UNION ALL SELECT l_suppkey, l_partkey FROM lineitem) GROUP BY u, v",
    "edge_dedupe_min": """WITH e AS (SELECT l_partkey AS u, l_suppkey AS v, greatest(l_extendedprice / 1000 - 5, 1) AS length, l_orderkey * 10 + l_linenumber AS key, l_quantity FROM lineitem WHERE l_partkey <> l_suppkey)
        SELECT u, v, round(length, 6) AS length, key, l_quantity FROM e QUALIFY row_number() OVER (PARTITION BY u, v ORDER BY length, key) = 1""",
    # Smallest labels handed on round by round; twelve rounds are more than this graph's diameter.
    "wcc_largest": f"""WITH {_PAIRS}, sym AS MATERIALIZED (SELECT DISTINCT u, v FROM pairs UNION SELECT DISTINCT v, u FROM pairs), l0 AS MATERIALIZED (SELECT DISTINCT u AS node, u AS l FROM sym),
        {', '.join(f"l{k} AS MATERIALIZED (SELECT a.node, least(a.l, min(b.l)) AS l FROM l{k - 1} a JOIN sym ON sym.u = a.node JOIN l{k - 1} b ON b.node = sym.v GROUP BY a.node, a.l)" for k in range(1, 13))},
        t AS (SELECT l, count(*) AS n FROM l12 GROUP BY 1 ORDER BY n DESC, l LIMIT 1)
        SELECT node, l12.l AS component FROM l12 JOIN t ON t.l = l12.l""",
    "drain_capacity_max": f"""WITH {GRID} SELECT node_id, coalesce((SELECT max(capacity) FROM edges WHERE u = node_id OR v = node_id), 0) AS drain,
        coalesce((SELECT max(capacity) FROM edges WHERE u = node_id), 0) AS drain_from FROM nodes""",
    "benchmark_edge_features": f"""WITH {GRID}, s AS (SELECT greatest(max(elev) - min(elev), 1) AS span FROM nodes), m AS (SELECT greatest(max(length), 1) AS longest FROM edges),
        f AS (SELECT u, v, (a.elev - b.elev) / span AS fall, length / longest AS l, edge_type FROM edges JOIN nodes a ON a.node_id = u JOIN nodes b ON b.node_id = v, s, m)
        SELECT u, v, round(least(greatest(fall, -1), 1) + 1e-9, 6) AS elev_diff_norm, round(l + 1e-9, 6) AS length_norm, round(edge_type + 1e-9, 6) AS edge_type, round(CASE WHEN edge_type = 1 THEN greatest(fall, 0) ELSE 0.1::DOUBLE END + 1e-9, 6) AS flow_weight FROM f""",
    "drain_fallback": f"""WITH {GRID}, low AS (SELECT * FROM nodes ORDER BY lat, node_id LIMIT (SELECT n // 10 FROM g))
        SELECT a.node_id, round(least(min(6371000.0::DOUBLE * sqrt(pow(radians(a.lon) - radians(b.lon), 2) + pow(radians(a.lat) - radians(b.lat), 2))) / 2000, 1) + 1e-9, 6) AS drain_dist FROM nodes a, low b GROUP BY 1""",
    "drain_distance_by_max": f"""WITH {GRID}, s AS (SELECT DISTINCT u FROM edges WHERE edge_type > 0.5), dr AS (SELECT lat, lon FROM nodes JOIN s ON u = node_id),
        d AS (SELECT node_id, min(sqrt(pow(a.lon - b.lon, 2) + pow(a.lat - b.lat, 2))) AS d FROM nodes a, dr b GROUP BY 1) SELECT node_id, round(d / max(d) OVER () + 1e-9, 6) AS drain_dist FROM d""",
    "lowest_nodes": f"WITH {GRID} SELECT node_id, lat FROM nodes ORDER BY lat, node_id LIMIT (SELECT n // 10 FROM g)",
    "waterway_nodes": f"WITH {GRID} SELECT u AS node_id FROM edges WHERE edge_type > 0.5 UNION SELECT v FROM edges WHERE edge_type > 0.5",
    "edge_features": f"""WITH {GRID}, s AS (SELECT greatest(max(lat) - min(lat), 1e-6) AS span FROM nodes), l AS (SELECT max(greatest(length, 1)) AS longest FROM edges),
        f AS (SELECT u, v, (a.lat - b.lat) / span AS fall, length, edge_type, capacity, longest FROM edges JOIN nodes a ON a.node_id = u JOIN nodes b ON b.node_id = v, s, l)
        {_EDGE.format(span='1', gain='1000', steep='0.001')}""",
    "edge_features_refined": f"""WITH {GRID}, s AS (SELECT greatest(max(elev) - min(elev), 1.0) AS span FROM nodes), l AS (SELECT max(greatest(length, 1)) AS longest FROM edges),
        f AS (SELECT u, v, a.elev - b.elev AS fall, span, length, edge_type, capacity, longest FROM edges JOIN nodes a ON a.node_id = u JOIN nodes b ON b.node_id = v, s, l)
        {_EDGE.format(span='span', gain='50', steep='0.01')}""",
    "khop_3": f"""{_REACH}, r(node, hop) AS (SELECT DISTINCT c_custkey, 0 FROM customer WHERE c_mktsegment = 'BUILDING' UNION SELECT sym.v, r.hop + 1 FROM r JOIN sym ON sym.u = r.node WHERE r.hop < 3)
        SELECT node, min(hop) AS hop FROM r GROUP BY node""",
    "khop_sampled": f"""WITH {_PAIRS}, sym AS MATERIALIZED (SELECT DISTINCT u, v FROM pairs UNION SELECT DISTINCT v, u FROM pairs), s0 AS MATERIALIZED (SELECT DISTINCT c_custkey AS node, 0 AS hop FROM customer WHERE c_mktsegment = 'BUILDING'),
        {', '.join(f"c{h} AS MATERIALIZED (SELECT DISTINCT u AS node FROM (SELECT u, v FROM sym JOIN (SELECT node FROM s{h - 1} WHERE hop = {h - 1}) ON node = v QUALIFY row_number() OVER (PARTITION BY v ORDER BY md5('{h}-' || v || '-' || u), u) <= {n})), s{h} AS MATERIALIZED (SELECT * FROM s{h - 1} UNION ALL SELECT node, {h} FROM c{h} WHERE node NOT IN (SELECT node FROM s{h - 1}))" for h, n in ((1, 15), (2, 10), (3, 5)))}
        SELECT node, hop FROM s3""",
    "strong_components": """WITH RECURSIVE o AS (SELECT o_orderkey, o_custkey AS u, lead(o_custkey) OVER (PARTITION BY o_orderkey // 4096 ORDER BY o_orderkey) AS v FROM orders),
        e AS (SELECT DISTINCT u, v FROM o WHERE v IS NOT NULL), n AS (SELECT u AS node FROM e UNION SELECT v FROM e),
        r(a, b) AS (SELECT node, node FROM n UNION SELECT r.a, e.v FROM r JOIN e ON e.u = r.b)
        SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON y.a = x.b AND y.b = x.a GROUP BY x.a""",
    "graph_stats": f"""WITH RECURSIVE {GRID}, w(a, b) AS (SELECT node_id, node_id FROM nodes UNION SELECT w.a, x.v FROM w JOIN (SELECT u, v FROM edges UNION SELECT v, u FROM edges) x ON x.u = w.b),
        s(a, b) AS (SELECT node_id, node_id FROM nodes UNION SELECT s.a, edges.v FROM s JOIN edges ON edges.u = s.b),
        d AS (SELECT node_id, (SELECT count(*) FROM edges WHERE u = node_id) + (SELECT count(*) FROM edges WHERE v = node_id) AS d FROM nodes)
        SELECT count(*) AS n_nodes, round(avg(d), 6) AS avg_degree, min(d) AS min_degree, max(d) AS max_degree, median(d) AS median_degree, (SELECT count(*) FROM edges) AS n_edges, (SELECT count(DISTINCT c) FROM (SELECT min(b) AS c FROM w GROUP BY a)) AS n_components,
            (SELECT count(DISTINCT c) FROM (SELECT min(x.b) AS c FROM s x JOIN s y ON y.a = x.b AND y.b = x.a GROUP BY x.a)) AS n_strong_components FROM d""",
    "graph_compose": """WITH a AS (SELECT l_partkey AS u, l_suppkey AS v, max(l_quantity) AS w, min(l_discount) AS d FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL),
        b AS (SELECT l_partkey AS u, l_suppkey AS v, max(l_quantity) AS w, min(l_discount) AS d FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)
        SELECT coalesce(b.u, a.u) AS u, coalesce(b.v, a.v) AS v, coalesce(b.w, a.w) AS w, coalesce(b.d, a.d) AS d FROM a FULL JOIN b ON a.u = b.u AND a.v = b.v""",
    "relabelled": "SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS new_id FROM customer",
    "sage_max": f"{_X} SELECT n.node_id, round(coalesce(max(s.x), 0) + 1e-9, 6) AS max_x, round(coalesce(max(s.z), 0) + 1e-9, 6) AS max_z FROM nodes n LEFT JOIN edges ON v = n.node_id LEFT JOIN x s ON s.node_id = u GROUP BY 1",
    "sage_mean": f"{_X} SELECT n.node_id, round(coalesce(avg(s.x), 0) + 1e-9, 6) AS mean_x, round(coalesce(avg(s.z), 0) + 1e-9, 6) AS mean_z FROM nodes n LEFT JOIN edges ON v = n.node_id LEFT JOIN x s ON s.node_id = u GROUP BY 1",
    "gcn_norm": f"""{_X}, l AS (SELECT u, v FROM edges UNION ALL SELECT node_id, node_id FROM nodes), d AS (SELECT v, count(*)::DOUBLE AS d FROM l GROUP BY v)
        SELECT l.v AS node_id, round(sum(x.x / sqrt(a.d * b.d)) + 1e-9, 6) AS gcn_x FROM l JOIN d a ON a.v = l.v JOIN d b ON b.v = l.u JOIN x ON x.node_id = l.u GROUP BY 1""",
    "gat_softmax": f"""{_X}, q0 AS (SELECT v, s.x, 0.05::DOUBLE * s.x - 0.03::DOUBLE * t.x + 0.01::DOUBLE * length + 0.5::DOUBLE * edge_type AS e FROM edges JOIN x s ON s.node_id = u JOIN x t ON t.node_id = v),
        q1 AS (SELECT v, x, CASE WHEN e >= 0 THEN e ELSE 0.2::DOUBLE * e END * 0.7::DOUBLE AS e FROM q0)
        SELECT v AS node_id, round(sum(exp(e) * x) / sum(exp(e)) + 1e-9, 6) AS attended, count(*) AS n_sources FROM q1 GROUP BY v""",
    "mc_dropout_stats": f"""{_X}, s AS (SELECT node_id, x, s, sum(CASE WHEN (node_id * 7919 + s * 104729 + u * 1299709) % 1000 >= 200 THEN 1.0::DOUBLE ELSE 0 END) / (8 * 0.8::DOUBLE) AS m
            FROM x, range(20) AS a(s), range(8) AS b(u) GROUP BY ALL)
        SELECT node_id, round(avg(x * m) + 1e-9, 6) AS mean, round(stddev_samp(x * m) + 1e-9, 6) AS std, round(stddev_pop(x * m) + 1e-9, 6) AS std_pop FROM s GROUP BY 1""",
    "knn_pairs": f"WITH {_KNN} SELECT id, other, round(dist + 1e-9, 6) AS dist, rank FROM knn",
    "knn_slope": f"""WITH {_KNN} SELECT id, round(coalesce(max(CASE WHEN dist > 0 THEN degrees(atan(abs(oe - e) / dist)) END), 0.5) + 1e-9, 6) AS slope, count(*) FILTER (WHERE oe > e) AS uphill,
        round(degrees(atan(max(abs(oe - e)) / avg(dist))) + 1e-9, 6) AS slope_mean_dist FROM knn GROUP BY id""",
    "nearest_drain": f"""WITH {GRID}, dr AS (SELECT DISTINCT lat, lon FROM edges JOIN nodes ON node_id = u WHERE edge_type > 0.5)
        SELECT node_id, round(least(min(sqrt(pow(radians(n.lon) - radians(dr.lon), 2) + pow(radians(n.lat) - radians(dr.lat), 2))) * 6371000.0::DOUBLE / 2000, 1) + 1e-9, 6) AS drain_dist FROM nodes n, dr GROUP BY 1""",
    "river_proximity": f"""WITH {GRID}, rv(a, b) AS (VALUES {', '.join(f'({a}::DOUBLE, {b}::DOUBLE)' for a, b in tables.RIVERS)})
        SELECT node_id, round(max(exp(-pow({_HAV.format(a='lat', b='rv.a', c='lon', d='rv.b')} / 500, 2))) + 1e-9, 6) AS river FROM nodes, rv GROUP BY 1""",
    "coast_distance": f"WITH {GRID} SELECT node_id, round(least({_HAV.format(a='lat', b=f'{tables.COAST[0]}::DOUBLE', c='lon', d=f'{tables.COAST[1]}::DOUBLE')} / 30000, 1) + 1e-9, 6) AS coast FROM nodes",
    "idw_all": f"""WITH {GRID}, {_STATIONS}, w AS (SELECT node_id, s_value, 1 / pow(greatest(sqrt(pow(lon - s_x, 2) + pow(lat - s_y, 2)), 1e-10), 2) AS w FROM nodes, st)
        SELECT node_id, round(sum(w * s_value) / sum(w) + 1e-9, 6) AS value FROM w GROUP BY 1""",
    "idw_k5": f"""WITH {_POINTS}, d AS (SELECT a.id, b.elev, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS dist FROM pts a JOIN pts b ON b.id % 4 <> 0 WHERE a.id % 4 = 0
            QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY dist, b.id) <= 5),
        f AS (SELECT id, sum(elev / greatest(dist, 1e-10)) / sum(1 / greatest(dist, 1e-10)) AS v FROM d GROUP BY id)
        SELECT pts.id, round(CASE WHEN pts.id % 4 <> 0 THEN elev ELSE v END + 1e-9, 6) AS value FROM pts LEFT JOIN f ON f.id = pts.id""",
    "station_interp": f"""WITH {GRID}, {_STATIONS}, p AS (SELECT node_id, lat - 0.02::DOUBLE AS lat FROM nodes),
        a AS (SELECT node_id, lat, (SELECT max(s_y) FROM st WHERE s_y <= lat) AS lo, (SELECT min(s_y) FROM st WHERE s_y > lat) AS hi FROM p)
        SELECT node_id, round(CASE WHEN lo IS NULL THEN h.s_value WHEN hi IS NULL THEN l.s_value ELSE l.s_value + (h.s_value - l.s_value) * (lat - lo) / (hi - lo) END + 1e-9, 6) AS rain
        FROM a LEFT JOIN st l ON l.s_y = lo LEFT JOIN st h ON h.s_y = hi""",
    "raster_tiles": f"""WITH {GRID}, c AS (SELECT p_partkey // 400 AS tile, p_partkey % 400 // 20 AS row, p_partkey % 400 % 20 AS col, CASE WHEN p_partkey % 11 <> 0 THEN p_retailprice END AS red,
            CASE WHEN p_partkey % 7 <> 0 THEN p_size * 1.0::DOUBLE END AS nir, CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice / p_size END AS swir FROM part),
        t AS (SELECT DISTINCT tile, 80.2003::DOUBLE + tile % 4 * 0.0133::DOUBLE AS x0, 13.0003::DOUBLE + tile // 4 * -0.014::DOUBLE AS y0 FROM c),
        p AS (SELECT node_id, tile, CAST(floor((lon - x0) / 0.0007::DOUBLE) AS BIGINT) AS col, CAST(floor((y0 - lat) / 0.0007::DOUBLE) AS BIGINT) AS row FROM nodes, t),
        m AS (SELECT p.node_id, c.* FROM p JOIN c ON c.tile = p.tile AND c.row = p.row AND c.col = p.col),
        f AS (SELECT node_id, arg_min(red, tile) FILTER (WHERE red IS NOT NULL) AS red, arg_min(nir, tile) FILTER (WHERE nir IS NOT NULL) AS nir, arg_min(swir, tile) FILTER (WHERE swir IS NOT NULL) AS swir FROM m GROUP BY node_id)
        SELECT nodes.node_id, round(coalesce(red, (SELECT median(red) FROM f)) + 1e-9, 6) AS red, round(coalesce(nir, 0.0::DOUBLE) + 1e-9, 6) AS nir, round(coalesce(swir, (SELECT median(swir) FROM f)) + 1e-9, 6) AS swir
        FROM nodes LEFT JOIN f ON f.node_id = nodes.node_id""",
    "raster_sample": f"""WITH {GRID}, p AS (SELECT node_id, CAST(floor((lon - 80.2003::DOUBLE) / 0.0007::DOUBLE) AS INTEGER) AS col, CAST(floor((13.0003::DOUBLE - lat) / 0.0007::DOUBLE) AS INTEGER) AS row FROM nodes),
        v AS (SELECT *, CASE WHEN col BETWEEN 0 AND 39 AND row BETWEEN 0 AND 39 AND (row * 40 + col) % 11 <> 0 THEN (row * 40 + col) * 0.5::DOUBLE END AS value FROM p)
        SELECT node_id, row, col, round(coalesce(value, (SELECT median(value) FROM v)), 6) AS value FROM v""",
}
