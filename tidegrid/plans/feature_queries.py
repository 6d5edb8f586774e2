"""Queries on features, scaling, sources and scenarios."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions import maths, spectral
from tidegrid.operators import features, scale, series, spatial
from tidegrid.plans.common import GRID, RAIN, grid_edges, grid_nodes, rain, settled, table
from tidegrid.sources import tables


def _accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("b"), F.lit(5.0).alias("flat"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("gap"))


def minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = scale.min_max(_accounts(spark, sf_dir), ["b", "flat"])
    return own.select("c_custkey", settled(F.col("b_mm")).alias("b_mm"), "flat_mm")


def zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = scale.z_score(_accounts(spark, sf_dir), ["b", "flat"])
    return own.select("c_custkey", settled(F.col("b_z")).alias("b_z"), "flat_z")


def scale_on_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows' scores by mean and deviation of the training part (two thirds), with their part."""
    own = _accounts(spark, sf_dir).withColumn("part", F.when(F.col("c_custkey") % 3 != 0, "train").otherwise("test"))
    found = scale.z_score(own, ["b"], fit=own.filter("part = 'train'"))
    return found.select("c_custkey", "part", settled(F.col("b_z")).alias("b_z"))


def median_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scale.median_impute(_accounts(spark, sf_dir), ["gap"]).select("c_custkey", F.round("gap", 6).alias("gap"))


def static_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _accounts(spark, sf_dir).withColumnRenamed("c_custkey", "node_id")
    return features.static_defaults(own, ["gap", "nowhere"])


def elevation_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source with few values, one with most, and one with all."""
    own = grid_nodes(spark, sf_dir).select("node_id", F.when(F.col("node_id") % 3 == 0, F.lit(50.0)).alias("a"), F.when(F.col("node_id") % 9 != 0, F.col("elev") * 10).alias("b"), F.lit(7.0).alias("c"))
    return features.with_fallbacks(own, ["a", "b", "c"]).select("node_id", F.round("elev", 6).alias("elev"))


def _xy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scale.min_max(grid_nodes(spark, sf_dir).select("node_id", "lat", "lon"), ["lat", "lon"], "_01")


def synthetic_elevation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _xy(spark, sf_dir).select("node_id", settled(features.synthetic_elevation(F.col("lon_01"), F.col("lat_01"))).alias("elev"))


def _bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _xy(spark, sf_dir)
    own = own.withColumn("elev", features.synthetic_elevation(F.col("lon_01"), F.col("lat_01")))
    own = scale.min_max(own, ["elev"], "_01")
    return own.withColumns(features.synthetic_bands(F.col("lon_01"), F.col("lat_01"), F.col("elev"), F.col("elev_01")))


def spectral_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _bands(spark, sf_dir)
    green, red, nir, swir = (F.col(c) for c in ("green", "red", "nir", "swir"))
    own = own.withColumns({"ndvi": spectral.ndvi(nir, red), "ndwi": spectral.ndwi(green, nir), "ndbi": spectral.ndbi(swir, nir), "ndvi_old": spectral.clipped_difference(nir, red)})
    own = own.withColumns({"impervious": spectral.imperviousness(F.col("ndbi"), F.col("ndvi")), "vv": features.synthetic_radar(F.col("ndwi"), F.col("elev_01"))})
    return own.select("node_id", *[settled(F.col(c)).alias(c) for c in ("ndvi", "ndwi", "ndbi", "ndvi_old", "impervious", "vv")])


def safe_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", maths.safe_ratio(F.col("l_tax"), F.col("l_discount")).alias("r"))
    return own.select("l_orderkey", "l_linenumber", settled(F.col("r")).alias("r"))


def terrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slope and uphill counts of the eight nearest vectors, then wetness and logs."""
    e = lambda k: F.get("embedding", F.lit(k)).cast("double")
    p = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), e(0).alias("x"), e(1).alias("y"), (e(2) * 0.02).alias("elev"))
    own = spatial.neighbour_slope(spatial.k_nearest(p, p, 8), p).join(p, "id")
    found = features.terrain(own)
    flat = spectral.topographic_wetness_flat(F.col("slope"))
    return found.select("id", *[settled(F.col(c)).alias(c) for c in ("slope", "twi", "log_flow", "log_catchment")], settled(flat).alias("twi_flat"))


def node_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = scale.z_score(_accounts(spark, sf_dir), ["b"])
    e = maths.clip((F.col("b_z") + 3) / 6, 0.0, 1.0)
    return own.select("c_custkey", settled(features.flood_threshold(e, F.lit(0.4), F.lit(0.6), F.lit(0.1), (F.col("c_custkey") % 5) / 4)).alias("thr"))


def haversine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of each node to the first one."""
    own = grid_nodes(spark, sf_dir).select("node_id", "lat", "lon")
    return own.select("node_id", settled(maths.haversine(F.col("lat"), F.col("lon"), F.lit(12.95), F.lit(80.2)) / 1000).alias("km"))


def utm_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projected coordinates (no SQL: held against known points in the tests)."""
    x, y = maths.utm_northing_easting(F.col("lat"), F.col("lon"), 81.0)
    return grid_nodes(spark, sf_dir).select("node_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


def gauge_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic gauges over the customers' box, for every hour of the events."""
    own = features.synthetic_gauge_grid(rain(spark, sf_dir).select("t").distinct(), grid_nodes(spark, sf_dir))
    return own.select("t", "i", "j", *[settled(F.col(c)).alias(c) for c in ("lon", "lat", "precip_mm")])


def scenario_rain(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _xy(spark, sf_dir).withColumnsRenamed({"lat_01": "lat01", "lon_01": "lon01"})
    found = features.scenario_rain(own, tables.scenarios(spark), 5.0)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    return found.select("node_id", "name", settled(total("short")).alias("short"), settled(total("long")).alias("long"), settled(F.col("weight")).alias("weight"))


def event_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known events and those of an archive: of a country whatever the case, of a year or later, within a box."""
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("ID"),
        F.when(F.col("c_custkey") % 3 == 0, "INDIA").when(F.col("c_custkey") % 3 == 1, "Sri Lanka, india").alias("Country"),
        F.when(F.col("c_custkey") % 5 == 0, "unknown").otherwise(F.concat(F.lit("20"), F.lpad((F.col("c_custkey") % 20).cast("string"), 2, "0"), F.lit("-07-01"))).alias("Began"),
        F.lit("2019-01-01").alias("Ended"), F.when(F.col("c_custkey") % 4 != 0, 1.5).alias("Severity"), (12.0 + F.col("c_custkey") % 20 * 0.1).alias("Lat"), (79.5 + F.col("c_custkey") % 13 * 0.1).alias("Long"),
    )
    return tables.merge_events(tables.known_events(spark), tables.since(tables.of_country(rows, "India"), 2005))


def pivot_mean_reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean price by day and priority on the spine of all days, 0 where there is none."""
    orders = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("place"), "o_totalprice")
    means = orders.groupBy("day", "place").agg(F.round(F.avg("o_totalprice"), 4).alias("value"))
    spine = orders.select("place").distinct().join(F.broadcast(orders.agg(F.min("day").alias("a"), F.max("day").alias("b")))).select("place", F.explode(F.sequence("a", "b")).alias("day"))
    return series.reindex(means, spine, ["day", "place"], ["value"]).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def window_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a time range, both ends included, by type."""
    own = tables.between(table(spark, sf_dir, "events"), "ts", "2024-01-05 00:00:00", "2024-01-15 00:00:00")
    return own.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def static_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 16 features of the grid's nodes."""
    nodes = grid_nodes(spark, sf_dir)
    own = nodes.select("node_id", "lat", "lon", (F.col("lon") * 1000).alias("x"), (F.col("lat") * 1000).alias("y"), "elev")
    rivers = spark.createDataFrame(tables.RIVERS, "r_lat double, r_lon double")
    found = features.assemble(own, grid_edges(spark, sf_dir, nodes), rivers, tables.COAST)
    return found.select("node_id", *[F.round(F.col(c) + 1e-9, 5).alias(c) for c in features.FEATURES])


def idw_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly sums by event type as five gauges, at 20 points."""
    own = table(spark, sf_dir, "events").select(F.hour("ts").alias("t"), (F.col("event_id") % 5).alias("station"), "value")
    readings = own.groupBy("station", "t").agg(F.round(F.sum("value"), 4).alias("value"))
    stations = spark.range(5).select(F.col("id").alias("station"), (F.col("id") * 2.0).alias("s_x"), (F.col("id") * F.col("id") % 5 * 1.0).alias("s_y"))
    points = spark.range(20).select("id", (F.col("id") % 7 + 0.25).alias("x"), (F.col("id") % 3 + 0.5).alias("y"))
    return spatial.idw_by_hour(points, stations, readings).select("id", "t", settled(F.col("value")).alias("value"))


def tiles_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as overlapping tiles of a raster."""
    own = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("tile"), (F.col("l_partkey") % 50).cast("int").alias("row"), (F.col("l_suppkey") % 50).cast("int").alias("col"),
        tables.valid_elevation(F.when(F.col("l_quantity") < 5, F.lit(-9999.0)).otherwise(F.col("l_quantity"))).alias("value"),
    )
    return tables.merge_tiles(own)


QUERIES = {
    f.__name__: f
    for f in (
        minmax, zscore, scale_on_train, median_impute, static_defaults, elevation_fallback, synthetic_elevation, spectral_indices, safe_ratios, terrain, node_thresholds, haversine_pairs,
        utm_coordinates, gauge_grid, static_features, idw_hourly, tiles_first_wins, scenario_rain, event_union, pivot_mean_reindex, window_between,
    )
}

_XY = f"{GRID}, nb AS (SELECT min(lat) AS la, max(lat) AS lb, min(lon) AS lo, max(lon) AS lp FROM nodes), xy AS (SELECT node_id, lat, lon, (lat - la) / (lb - la) AS y, (lon - lo) / (lp - lo) AS x FROM nodes, nb)"


def _bump(cx: float, cy: float, w: float, h: float) -> str:
    return f"{h}::DOUBLE * exp(-(pow(x - {cx}::DOUBLE, 2) + pow(y - {cy}::DOUBLE, 2)) / {w}::DOUBLE)"


_ELEV = f"""el AS (SELECT node_id, x, y, least(greatest(3.0::DOUBLE + 20.0::DOUBLE * (1 - x) + CASE WHEN x > 0.88::DOUBLE THEN -(3.0::DOUBLE + 20.0::DOUBLE * (1 - x)) * 0.85::DOUBLE ELSE 0 END
    + {' + '.join(_bump(*b) for b in features.RELIEF)}, 0.1::DOUBLE), 80.0::DOUBLE) AS elev FROM xy)"""
_BANDS = f"""{_XY}, {_ELEV}, er AS (SELECT min(elev) AS e0, max(elev) AS e9 FROM el), f1 AS (SELECT *, (elev - e0) / (e9 - e0) AS en FROM el, er),
    f2 AS (SELECT *, 0.20::DOUBLE + 0.35::DOUBLE * sqrt(pow(x - 0.45::DOUBLE, 2) + pow(y - 0.55::DOUBLE, 2)) + 0.15::DOUBLE * en + {_bump(0.25, 0.35, 0.04, 0.4)} AS veg,
        least(greatest({_bump(0.12, 0.82, 0.008, 0.8)} + {_bump(0.58, 0.42, 0.005, 0.6)} + 0.4::DOUBLE * exp(-elev / 4.0::DOUBLE), 0), 1) AS wat FROM f1),
    f3 AS (SELECT *, least(greatest(1 - veg * 0.6::DOUBLE - wat * 0.4::DOUBLE, 0), 1) AS urb FROM f2),
    bd AS (SELECT node_id, en, 0.08::DOUBLE + 0.18::DOUBLE * wat + 0.04::DOUBLE * veg AS green, 0.06::DOUBLE + 0.10::DOUBLE * urb + 0.02::DOUBLE * veg AS red,
        0.18::DOUBLE + 0.40::DOUBLE * veg - 0.12::DOUBLE * wat AS nir, 0.12::DOUBLE + 0.30::DOUBLE * urb - 0.06::DOUBLE * veg AS swir FROM f3)"""
_ACC = "acc AS (SELECT c_custkey, c_acctbal AS b, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS gap FROM customer)"
_HAV = "2 * 6371000.0::DOUBLE * asin(sqrt(least(greatest(pow(sin(radians({a} - lat) / 2), 2) + cos(radians(lat)) * cos(radians({a})) * pow(sin(radians({b} - lon) / 2), 2), 0), 1)))"
_TERRAIN = """pts AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE * 0.02::DOUBLE AS elev FROM embeddings),
    d AS (SELECT a.id, a.elev AS e, b.elev AS oe, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS dist, b.id AS other FROM pts a JOIN pts b ON a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY dist, other) <= 8),
    s AS (SELECT id, coalesce(max(CASE WHEN dist > 0 THEN degrees(atan(abs(oe - e) / dist)) END), 0.5) AS slope, count(*) FILTER (WHERE oe > e) AS up FROM d GROUP BY id),
    r AS (SELECT min(elev) AS lo, max(elev) AS hi FROM pts),
    t AS (SELECT s.id, least(greatest(slope, 0), 45) AS slope, greatest(up, 1) * (1 + 3 * (1 - (elev - lo) / (hi - lo))) AS flow FROM s JOIN pts ON pts.id = s.id, r)"""

_STATIC = f"""{_BANDS.replace(_ELEV, "el AS (SELECT xy.node_id, x, y, elev FROM xy JOIN nodes ON nodes.node_id = xy.node_id)")},
    {_TERRAIN.replace("SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE * 0.02::DOUBLE AS elev FROM embeddings", "SELECT node_id AS id, lon * 1000 AS x, lat * 1000 AS y, elev FROM nodes")},
    ix AS (SELECT node_id, en, (nir - red) / (nir + red) AS ndvi, (green - nir) / (green + nir) AS ndwi, (swir - nir) / (swir + nir) AS ndbi FROM bd),
    ds AS (SELECT DISTINCT u FROM edges WHERE edge_type > 0.5), dp AS (SELECT radians(lat) AS la, radians(lon) AS lo FROM nodes JOIN ds ON u = node_id),
    dd AS (SELECT node_id, least(min(sqrt(pow(radians(lon) - lo, 2) + pow(radians(lat) - la, 2))) * 6371000.0::DOUBLE / 2000, 1) AS drain_dist FROM nodes, dp GROUP BY 1),
    cap AS (SELECT node_id, max(capacity) AS drain FROM (SELECT u AS node_id, capacity FROM edges UNION ALL SELECT v, capacity FROM edges) GROUP BY 1),
    raw AS (SELECT n.node_id, elev, t.slope, least(greatest(ln(flow / tan(radians(least(greatest(t.slope, 0.1), 89.9)))), 0), 25) AS twi, log10(flow) AS log_flow, log10(greatest(flow * 0.0225::DOUBLE, 0.01)) AS log_catchment, ndvi, ndwi, ndbi,
        least(greatest(0.5::DOUBLE * (1 + ndbi) - 0.3::DOUBLE * greatest(ndvi, 0), 0), 1) AS impervious, least(greatest(CASE WHEN ndwi > 0.1 THEN -22 ELSE -18 + 12 * en END, -35), 5) AS sar_vv,
        coalesce(drain, 0) AS drain, drain_dist, least({_HAV.format(a=tables.COAST[0], b=tables.COAST[1])} / 30000, 1) AS coast,
        greatest({', '.join(f"exp(-pow({_HAV.format(a=a, b=b)} / 500, 2))" for a, b in tables.RIVERS)}) AS river, lat AS lat_n, lon AS lon_n
        FROM nodes n JOIN t ON t.id = n.node_id JOIN ix ON ix.node_id = n.node_id JOIN dd ON dd.node_id = n.node_id LEFT JOIN cap ON cap.node_id = n.node_id)"""
_SHARES = {"ndvi", "ndwi", "ndbi", "impervious", "drain", "drain_dist", "coast", "river"}

ORACLES = {
    "static_features": f"WITH {_STATIC} SELECT node_id, "
    + ", ".join(f"round({c} + 1e-9, 5) AS {c}" if c in _SHARES else f"round(coalesce(({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0), 0) + 1e-9, 5) AS {c}" for c in features.FEATURES)
    + " FROM raw",
    "minmax": f"WITH {_ACC} SELECT c_custkey, round((b - min(b) OVER ()) / (max(b) OVER () - min(b) OVER ()) + 1e-9, 6) AS b_mm, 0.0::DOUBLE AS flat_mm FROM acc",
    "zscore": f"WITH {_ACC} SELECT c_custkey, round((b - avg(b) OVER ()) / stddev_pop(b) OVER () + 1e-9, 6) AS b_z, 0.0::DOUBLE AS flat_z FROM acc",
    "scale_on_train": f"WITH {_ACC}, s AS (SELECT avg(b) AS m, stddev_pop(b) AS s FROM acc WHERE c_custkey % 3 <> 0) SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN 'train' ELSE 'test' END AS part, round((b - m) / s + 1e-9, 6) AS b_z FROM acc, s",
    "median_impute": f"WITH {_ACC} SELECT c_custkey, round(coalesce(gap, (SELECT median(gap) FROM acc)), 6) AS gap FROM acc",
    "static_defaults": f"WITH {_ACC} SELECT c_custkey AS node_id, coalesce(gap, 0) AS gap, 0.0::DOUBLE AS nowhere FROM acc",
    "elevation_fallback": f"WITH {GRID} SELECT node_id, round(least(greatest(CASE WHEN node_id % 9 <> 0 THEN elev * 10 ELSE 7.0::DOUBLE END, 0), 200), 6) AS elev FROM nodes",
    "synthetic_elevation": f"WITH {_XY}, {_ELEV} SELECT node_id, round(elev + 1e-9, 6) AS elev FROM el",
    "spectral_indices": f"""WITH {_BANDS}, ix AS (SELECT node_id, en, (nir - red) / (nir + red) AS ndvi, (green - nir) / (green + nir) AS ndwi, (swir - nir) / (swir + nir) AS ndbi, least(greatest((nir - red) / (nir + red + 1e-8), -1), 1) AS ndvi_old FROM bd)
        SELECT node_id, round(ndvi + 1e-9, 6) AS ndvi, round(ndwi + 1e-9, 6) AS ndwi, round(ndbi + 1e-9, 6) AS ndbi, round(ndvi_old + 1e-9, 6) AS ndvi_old,
            round(least(greatest(0.5::DOUBLE * (1 + ndbi) - 0.3::DOUBLE * greatest(ndvi, 0), 0), 1) + 1e-9, 6) AS impervious,
            round(least(greatest(CASE WHEN ndwi > 0.1 THEN -22 ELSE -18 + 12 * en END, -35), 5) + 1e-9, 6) AS vv FROM ix""",
    "safe_ratios": "SELECT l_orderkey, l_linenumber, round(CASE WHEN abs(l_discount) > 1e-8 THEN l_tax / l_discount END + 1e-9, 6) AS r FROM lineitem",
    "terrain": f"""WITH {_TERRAIN} SELECT id, round(slope + 1e-9, 6) AS slope, round(least(greatest(ln(flow / tan(radians(least(greatest(slope, 0.1), 89.9)))), 0), 25) + 1e-9, 6) AS twi, round(log10(flow) + 1e-9, 6) AS log_flow,
        round(log10(greatest(flow * 0.0225::DOUBLE, 0.01)) + 1e-9, 6) AS log_catchment, round(least(greatest(ln(1 / tan(radians(slope + 0.001::DOUBLE))), -10), 10) + 1e-9, 6) AS twi_flat FROM t""",
    "node_thresholds": f"""WITH {_ACC}, z AS (SELECT c_custkey, (b - avg(b) OVER ()) / stddev_pop(b) OVER () AS z FROM acc)
        SELECT c_custkey, round(least(greatest(15.0::DOUBLE * exp(least(greatest((z + 3) / 6, 0), 1) * ln(80.0::DOUBLE / 15.0::DOUBLE)) * (1 - 0.25::DOUBLE * 0.4 - 0.18::DOUBLE * 0.6 + 0.10::DOUBLE * 0.1 + 0.15::DOUBLE * (c_custkey % 5) / 4), 12.0), 80.0) + 1e-9, 6) AS thr FROM z""",
    "haversine_pairs": f"""WITH {GRID} SELECT node_id, round(2 * 6371.0::DOUBLE * asin(sqrt(pow(sin(radians(12.95::DOUBLE - lat) / 2), 2) + cos(radians(lat)) * cos(radians(12.95::DOUBLE)) * pow(sin(radians(80.2::DOUBLE - lon) / 2), 2))) + 1e-9, 6) AS km FROM nodes""",
    "gauge_grid": f"""WITH {RAIN}, {GRID}, box AS (SELECT min(lon) AS a, max(lon) AS b, min(lat) AS c, max(lat) AS d FROM nodes),
        x AS (SELECT t, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, (('0x' || substr(md5('0-' || t || '-' || i || '-' || j), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296 AS u FROM (SELECT DISTINCT t FROM rain), range(10) AS p(i), range(10) AS q(j))
        SELECT t, i, j, round(a + i * (b - a) / 9 + 1e-9, 6) AS lon, round(c + j * (d - c) / 9 + 1e-9, 6) AS lat, round(-2.0::DOUBLE * ln(u) * CASE WHEN t % 24 BETWEEN 14 AND 18 THEN 1.5::DOUBLE ELSE 0.5::DOUBLE END + 1e-9, 6) AS precip_mm FROM x, box""",
    "scenario_rain": f"""WITH {_XY}, sc(name, i, d, a, p) AS (VALUES {', '.join(f"('{n}', {i}::DOUBLE, {d}::DOUBLE, {a}::DOUBLE, '{p}')" for n, i, d, a, p in tables.SCENARIOS)}),
        w AS (SELECT node_id, sc.*, CASE p WHEN 'south_biased' THEN 1 + 0.35::DOUBLE * (1 - y) + 0.10::DOUBLE * (1 - x) WHEN 'north_biased' THEN 1 + 0.30::DOUBLE * y ELSE 1 END AS w FROM xy, sc)
        SELECT node_id, name, round(list_sum([CASE WHEN h <= d THEN least(i * w / 5, 2) ELSE 0 END FOR h IN range(1, 7)]) + 1e-9, 6) AS short,
            round(list_sum([least(CASE WHEN h <= d THEN i * w ELSE a / 24 * w END / 5, 2) FOR h IN range(2, 25, 2)]) + 1e-9, 6) AS long, round(w + 1e-9, 6) AS weight FROM w""",
    "idw_hourly": """WITH rd AS (SELECT event_id % 5 AS station, CAST(hour(ts) AS INTEGER) AS t, round(sum(value), 4) AS value FROM events GROUP BY ALL),
        st AS (SELECT i AS station, i * 2.0::DOUBLE AS s_x, i * i % 5 * 1.0::DOUBLE AS s_y FROM range(5) AS r(i)), p AS (SELECT i AS id, i % 7 + 0.25::DOUBLE AS x, i % 3 + 0.5::DOUBLE AS y FROM range(20) AS r(i)),
        w AS (SELECT id, station, 1 / pow(greatest(sqrt(pow(x - s_x, 2) + pow(y - s_y, 2)), 1e-10), 2) AS w FROM p, st)
        SELECT id, t, round(sum(w * value) / sum(w) + 1e-9, 6) AS value FROM w JOIN rd ON rd.station = w.station GROUP BY ALL""",
    "tiles_first_wins": """WITH x AS (SELECT l_orderkey * 10 + l_linenumber AS tile, CAST(l_partkey % 50 AS INTEGER) AS row, CAST(l_suppkey % 50 AS INTEGER) AS col, l_quantity AS value FROM lineitem WHERE l_quantity >= 5)
        SELECT row, col, value FROM x QUALIFY row_number() OVER (PARTITION BY row, col ORDER BY tile, value) = 1""",
    "event_union": f"""WITH a AS (SELECT c_custkey AS k, CASE WHEN k % 3 = 0 THEN 'INDIA' WHEN k % 3 = 1 THEN 'Sri Lanka, india' END AS country, CASE WHEN k % 5 = 0 THEN 'unknown' ELSE '20' || lpad(CAST(k % 20 AS VARCHAR), 2, '0') || '-07-01' END AS began,
            12.0::DOUBLE + k % 20 * 0.1::DOUBLE AS lat, 79.5::DOUBLE + k % 13 * 0.1::DOUBLE AS lon, CASE WHEN k % 4 <> 0 THEN 1 ELSE 1 END AS severity FROM customer)
        SELECT * FROM (VALUES {', '.join(f"('{n}', '{b}', '{e}', {s}, {la}::DOUBLE, {lo}::DOUBLE, {p}::DOUBLE)" for n, b, e, s, la, lo, p in tables.KNOWN_EVENTS)}) AS x(name, began, ended, severity, lat, lon, peak_mm_day)
        UNION ALL SELECT 'DFO-' || k, began, '2019-01-01', severity, lat, lon, NULL FROM a WHERE lower(country) LIKE '%india%' AND year(TRY_CAST(began AS DATE)) >= 2005 AND lat BETWEEN 12.5 AND 13.5 AND lon BETWEEN 79.8 AND 80.5""",
    "pivot_mean_reindex": """WITH o AS (SELECT CAST(o_orderdate AS DATE) AS day, o_orderpriority AS place, o_totalprice FROM orders), m AS (SELECT day, place, round(avg(o_totalprice), 4) AS value FROM o GROUP BY ALL),
        s AS (SELECT place, CAST(unnest(generate_series((SELECT min(day) FROM o), (SELECT max(day) FROM o), INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT DISTINCT place FROM o))
        SELECT strftime(s.day, '%Y-%m-%d') AS day, s.place, coalesce(value, 0) AS value FROM s LEFT JOIN m ON m.day = s.day AND m.place = s.place""",
    "window_between": "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-15 00:00:00' GROUP BY 1",
}
