"""Static node features and synthetic sources, as column expressions over node tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions.maths import clip
from tidegrid.operators.scale import min_max

#: Area of a grid cell of about 150 m, in square kilometres.
CELL_KM2 = 0.0225
FEATURES = (
    "elev", "slope", "twi", "log_flow", "log_catchment", "ndvi", "ndwi", "ndbi", "impervious", "sar_vv", "drain", "drain_dist", "coast", "river", "lat_n", "lon_n",
)


def terrain(nodes: DataFrame, elev: str = "elev") -> DataFrame:
    """flow_acc from the uphill count and the relative height, then wetness and logs; slope from 0 to 45 degrees.

    Needs elev, slope and uphill columns (``neighbour_slope``).
    """
    from tidegrid.functions.spectral import topographic_wetness

    own = min_max(nodes, [elev], "_01")
    flow = F.greatest(F.col("uphill").cast("double"), F.lit(1.0)) * (1 + 3 * (1 - F.col(f"{elev}_01")))
    return (
        own.withColumn("flow_acc", flow)
        .withColumn("slope", clip(F.col("slope"), 0.0, 45.0))
        .withColumns({"twi": topographic_wetness(F.col("flow_acc"), F.col("slope")), "log_flow": F.log10("flow_acc"), "log_catchment": F.log10(F.greatest(F.col("flow_acc") * CELL_KM2, F.lit(0.01)))})
        .drop(f"{elev}_01")
    )


def flood_threshold(elev01: Column, twi01: Column, impervious: Column, slope01: Column, drain: Column, low: float = 15.0, high: float = 80.0) -> Column:
    """Rain that floods a node: log-uniform between the ends by relative height, less for wet and sealed ground, more
    for slopes and drains; from 0.8 of the lower end to the upper one."""
    from math import log

    base = F.exp(F.lit(log(low)) + elev01 * F.lit(log(high) - log(low)))
    return clip(base * (1 - 0.25 * twi01 - 0.18 * impervious + 0.10 * slope01 + 0.15 * drain), 0.8 * low, high)


def static_defaults(nodes: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named attributes, missing ones and nulls 0."""
    have = set(nodes.columns)
    return nodes.select("node_id", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in have else F.lit(0.0).alias(c) for c in names])


#: Fixed values of the synthetic relief: centre (x, y), square of the width, height.
RELIEF = ((0.10, 0.80, 0.04, 30.0), (0.20, 0.18, 0.03, 25.0), (0.45, 0.75, 0.06, 8.0), (0.50, 0.28, 0.015, -5.0), (0.55, 0.45, 0.012, -3.5), (0.85, 0.50, 0.010, -2.5))


def bump(x01: Column, y01: Column, cx: float, cy: float, width2: float, height: float) -> Column:
    return F.lit(height) * F.exp(-(F.pow(x01 - cx, 2) + F.pow(y01 - cy, 2)) / width2)


def synthetic_elevation(x01: Column, y01: Column) -> Column:
    """A plain that rises inland with hills, hollows and a flat strip at the coast; 0.1 to 80 metres, without noise."""
    base = 3.0 + 20.0 * (1 - x01)
    ground = base + F.when(x01 > 0.88, -base * 0.85).otherwise(0.0)
    for b in RELIEF:
        ground = ground + bump(x01, y01, *b)
    return clip(ground, 0.1, 80.0)


def synthetic_bands(x01: Column, y01: Column, elev: Column, elev01: Column) -> dict[str, Column]:
    """Green, red, near and short-wave infrared reflectance from shares of plants, water and buildings, without noise."""
    centre = F.sqrt(F.pow(x01 - 0.45, 2) + F.pow(y01 - 0.55, 2))
    plants = 0.20 + 0.35 * centre + 0.15 * elev01 + bump(x01, y01, 0.25, 0.35, 0.04, 0.4)
    water = clip(bump(x01, y01, 0.12, 0.82, 0.008, 0.8) + bump(x01, y01, 0.58, 0.42, 0.005, 0.6) + 0.4 * F.exp(-elev / 4.0), 0.0, 1.0)
    urban = clip(1 - plants * 0.6 - water * 0.4, 0.0, 1.0)
    bands = {
        "green": 0.08 + 0.18 * water + 0.04 * plants,
        "red": 0.06 + 0.10 * urban + 0.02 * plants,
        "nir": 0.18 + 0.40 * plants - 0.12 * water,
        "swir": 0.12 + 0.30 * urban - 0.06 * plants,
    }
    return {k: clip(v, 0.0, 1.0) for k, v in bands.items()}


def synthetic_radar(ndwi: Column, elev01: Column) -> Column:
    """Backscatter in decibels without noise: low over water, else by height; -35 to 5."""
    return clip(F.when(clip(ndwi, -1.0, 1.0) > 0.1, F.lit(-22.0)).otherwise(-18.0 + 12.0 * elev01), -35.0, 5.0)


def storm_hours(storms: DataFrame, hours: int, pad: int = 24) -> DataFrame:
    """t and pulse of each hour from -pad to hours + pad - 1: bell curves of the storms, smoothed within each storm (3 hours) and
    then over all hours (1.5 hours).

    Smoothing is linear, so it is done once here, on a table of hours, and not for every node.
    """
    from tidegrid.operators.series import gaussian_smooth

    length = F.col("end_hr") - F.col("start_hr")
    middle = length * (0.5 + F.col("skew") * 0.2)
    own = storms.select("start_hr", "end_hr", "peak", length.alias("_n"), middle.alias("_m"), F.explode(F.sequence(F.lit(0), length - 1)).alias("t"))
    bell = own.select(F.col("start_hr").alias("node_id"), "start_hr", "t", (F.col("peak") * F.exp(F.lit(-0.5) * F.pow((F.col("t") - F.col("_m")) / (F.col("_n") / 4.0), 2))).alias("rain"))
    smooth = gaussian_smooth(bell, 3.0).groupBy((F.col("start_hr") + F.col("t")).alias("t")).agg(F.sum("smooth").alias("pulse"))
    spine = storms.sparkSession.range(hours + 2 * pad).select((F.col("id") - pad).cast("int").alias("t"))
    summed = spine.join(smooth, "t", "left").select(F.lit(0).alias("node_id"), (F.col("t") + pad).alias("t"), F.coalesce("pulse", F.lit(0.0)).alias("rain"))
    return gaussian_smooth(summed, 1.5).select((F.col("t") - pad).alias("t"), F.col("smooth").alias("pulse"))


def quadrant_lag(lat: Column, lon: Column, mid_lat: Column, mid_lon: Column) -> Column:
    """Hours by which a quadrant's rain lags: south-west 10, north-west 6, south-east -4, north-east 0."""
    south = lat < mid_lat
    return F.when(lon < mid_lon, F.when(south, 10).otherwise(6)).otherwise(F.when(south, -4).otherwise(0))


def synthetic_rain(nodes: DataFrame, storms: DataFrame, hours: int, background: float = 0.8, most: float = 80.0) -> DataFrame:
    """node_id, t, rain of nodes (node_id, lat, lon), without the random factors.

    More rain to the south and west, each quadrant with its lag, a daily cycle, 0 to ``most``. Storm hours are a
    small table, joined on the hour.
    """
    stats = nodes.agg(*[f(c).alias(f"_{n}_{c}") for c in ("lat", "lon") for n, f in (("lo", F.min), ("hi", F.max), ("mid", F.avg))])
    own = nodes.join(F.broadcast(stats))
    part = lambda c: (F.col(c) - F.col(f"_lo_{c}")) / F.greatest(F.col(f"_hi_{c}") - F.col(f"_lo_{c}"), F.lit(1e-6))
    weight = 1 + 0.30 * (1 - part("lat")) + 0.10 * (1 - part("lon"))
    lag = quadrant_lag(F.col("lat"), F.col("lon"), F.col("_mid_lat"), F.col("_mid_lon"))
    own = own.select("node_id", weight.alias("weight"), lag.alias("lag"), F.explode(F.sequence(F.lit(0), F.lit(hours - 1))).alias("hour"))
    pulses = F.broadcast(storm_hours(storms, hours))  # one row an hour
    joined = own.withColumn("t", F.col("hour") - F.col("lag")).join(pulses, "t", "left")
    daily = 1 + 0.15 * F.sin(2 * F.pi() * (F.col("hour") % 24 - 18) / 24)
    rain = (background + F.coalesce("pulse", F.lit(0.0)) * F.col("weight")) * daily
    return joined.select("node_id", F.col("hour").alias("t"), clip(rain, 0.0, most).alias("rain"))


def synthetic_gauge_grid(hours: DataFrame, nodes: DataFrame, side: int = 10, mean: float = 2.0, seed: int = 0) -> DataFrame:
    """t, i, j, lon, lat, precip_mm of side x side gauges over the box of the nodes (lon, lat), for every hour (t): exponential rain,
    heavier from 14 to 18 h. The MD5 of seed, hour and place is the chance."""
    box = nodes.agg(*[f(c).alias(f"_{n}_{c}") for c in ("lon", "lat") for n, f in (("a", F.min), ("b", F.max))])
    at = lambda k, c: F.col(f"_a_{c}") + F.col(k) * (F.col(f"_b_{c}") - F.col(f"_a_{c}")) / (side - 1)
    axis = F.sequence(F.lit(0), F.lit(side - 1))
    own = hours.select("t").join(F.broadcast(box)).withColumn("i", F.explode(axis)).withColumn("j", F.explode(axis))
    key = F.md5(F.concat_ws("-", F.lit(str(seed)), *[F.col(c).cast("string") for c in ("t", "i", "j")]).cast("binary"))
    u = (F.conv(F.substring(key, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    hour = F.col("t") % 24
    factor = F.when((hour >= 14) & (hour <= 18), 1.5).otherwise(0.5)
    return own.select("t", "i", "j", at("i", "lon").alias("lon"), at("j", "lat").alias("lat"), (-F.lit(mean) * F.ln(u) * factor).alias("precip_mm"))


def with_fallbacks(nodes: DataFrame, sources: Sequence[str], least_share: float = 0.5, low: float = 0.0, high: float = 200.0, out: str = "elev") -> DataFrame:
    """The first source with a value on more than ``least_share`` of the nodes, held within its range; the last
    one in any case. Nodes that it lacks get their value from the sources after it."""
    shares = nodes.agg(*[(F.count(c) / F.count(F.lit(1))).alias(f"_s_{c}") for c in sources])
    own = nodes.join(F.broadcast(shares))
    picks = [F.when(F.col(f"_s_{c}") > least_share, F.col(c)) for c in sources[:-1]]
    return own.withColumn(out, clip(F.coalesce(*picks, F.col(sources[-1])), low, high)).drop(*shares.columns)


def pattern_weight(pattern: Column, lat01: Column, lon01: Column) -> Column:
    """Spatial weight of a scenario's pattern."""
    south = 1 + 0.35 * (1 - lat01) + 0.10 * (1 - lon01)
    return F.when(pattern == "south_biased", south).when(pattern == "north_biased", 1 + 0.30 * lat01).otherwise(1.0)


def scenario_rain(nodes: DataFrame, scenario: DataFrame, rain_norm: float) -> DataFrame:
    """``short`` (6 to 1 hours ago) and ``long`` (24 to 2 hours ago) windows of each node (lat01, lon01) and scenario.

    Hours within the duration have the intensity by the node's weight; before it the short window is dry and the
    long one has the antecedent rain over 24 hours. As shares of the normaliser (1 at least), 0 to 2. ``scenario``
    is a handful of rows.
    """
    own = nodes.join(F.broadcast(scenario)).withColumn("weight", pattern_weight(F.col("pattern"), F.col("lat01"), F.col("lon01")))
    norm = max(rain_norm, 1.0)

    def window(hours: range, before: Column) -> Column:
        wet = F.col("intensity") * F.col("weight")
        return F.array(*[clip(F.when(F.lit(h) <= F.col("duration"), wet).otherwise(before) / norm, 0.0, 2.0) for h in hours])

    return own.withColumns({"short": window(range(6, 0, -1), F.lit(0.0)), "long": window(range(24, 0, -2), F.col("antecedent") / 24 * F.col("weight"))})


def lowest(nodes: DataFrame, share: float = 0.1, by: str = "lat") -> DataFrame:
    """The int(n share) nodes that are lowest by a column, ties by node: an ordered take."""
    return nodes.orderBy(by, "node_id").limit(int(nodes.count() * share))


def drain_distance(nodes: DataFrame, edges: DataFrame, most_m: float = 2000.0) -> DataFrame:
    """node_id and ``drain_dist``, the distance to the nearest node (lat, lon) where a drain starts, as a share of 2 km and 1 at most.

    Without drains the lowest tenth of the nodes by latitude stands for them; without these every node is 500 m from one. What is
    farther than 2 km has a share of 1 wherever its drain is, so the search ends there.
    """
    from tidegrid.operators import spatial

    drains = nodes.join(edges.filter("edge_type > 0.5").select(F.col("u").alias("node_id")).distinct(), "node_id", "left_semi")
    if drains.isEmpty():
        drains = lowest(nodes)
    none = F.lit(500.0) if drains.isEmpty() else F.when(F.isnull("lat") | F.isnull("lon"), 500.0).otherwise(most_m)
    at = lambda d: d.select(F.col("node_id").alias("id"), F.radians("lon").alias("x"), F.radians("lat").alias("y"))
    near = spatial.k_nearest(at(nodes), at(drains), 1, skip_self=False, within=most_m / 6_371_000.0).select(F.col("id").alias("node_id"), (F.col("dist") * 6_371_000.0).alias("_m"))
    return nodes.select("node_id", none.alias("_none")).join(near, "node_id", "left").select("node_id", clip(F.coalesce("_m", "_none") / most_m, 0.0, 1.0).alias("drain_dist"))


def drain_distance_by_max(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id and ``drain_dist``: the plane distance in degrees to the nearest drain's start, as a share of the largest; 1 without drains."""
    from tidegrid.operators import spatial

    at = lambda d: d.select(F.col("node_id").alias("id"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    drains = nodes.join(edges.filter("edge_type > 0.5").select(F.col("u").alias("node_id")).distinct(), "node_id", "left_semi")
    near = spatial.k_nearest(at(nodes), at(drains), 1, skip_self=False).select(F.col("id").alias("node_id"), "dist")
    top = near.agg(F.max("dist").alias("_top"))
    found = nodes.select("node_id").join(near, "node_id", "left").join(F.broadcast(top))
    return found.select("node_id", F.when(F.col("dist").isNull(), 1.0).otherwise(F.coalesce(F.try_divide("dist", "_top"), F.lit(0.0))).alias("drain_dist"))


def assemble(nodes: DataFrame, edges: DataFrame, rivers: DataFrame, coast: tuple[float, float]) -> DataFrame:
    """node_id and the 16 ``FEATURES`` of nodes (node_id, lat, lon, x, y, elev), all but the shares as z-scores.

    Null samples of a band become its median.
    """
    from tidegrid.functions import spectral
    from tidegrid.operators import graph, spatial
    from tidegrid.operators.scale import median_impute, z_score

    own = min_max(nodes, ["x", "y", "elev"], "_01")
    p = own.select(F.col("node_id").alias("id"), "x", "y", "elev")
    ground = terrain(spatial.neighbour_slope(spatial.k_nearest(p, p, 8), p).join(p.select("id", "elev"), "id")).withColumnRenamed("id", "node_id")
    own = own.join(ground.select("node_id", "slope", "twi", "log_flow", "log_catchment"), "node_id")
    own = own.withColumns(synthetic_bands(F.col("x_01"), F.col("y_01"), F.col("elev"), F.col("elev_01")))
    green, red, nir, swir = (F.col(c) for c in ("green", "red", "nir", "swir"))
    own = own.withColumns({"ndvi": spectral.ndvi(nir, red), "ndwi": spectral.ndwi(green, nir), "ndbi": spectral.ndbi(swir, nir)})
    own = median_impute(own, ["ndvi", "ndwi", "ndbi"])
    own = own.withColumns({"impervious": spectral.imperviousness(F.col("ndbi"), F.col("ndvi")), "sar_vv": synthetic_radar(F.col("ndwi"), F.col("elev_01"))})
    own = graph.drain_capacity(own, edges)
    own = own.join(drain_distance(own.select("node_id", "lat", "lon"), edges), "node_id")
    river = spatial.river_proximity(own.select("node_id", "lat", "lon"), rivers).select("node_id", "river")
    own = own.join(river, "node_id").withColumn("coast", spatial.coast_distance(F.col("lat"), F.col("lon"), *coast))
    shares = {"ndvi", "ndwi", "ndbi", "impervious", "drain", "drain_dist", "coast", "river"}
    own = own.withColumns({"lat_n": F.col("lat"), "lon_n": F.col("lon")})
    scaled = [c for c in FEATURES if c not in shares]
    found = z_score(own, scaled, constant_to_zero=True)
    return found.select("node_id", *[F.col(f"{c}_z").alias(c) if c in scaled else F.col(c) for c in FEATURES])
