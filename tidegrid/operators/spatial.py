"""Neighbours and interpolation in the plane.

Points are dealt to square cells; a search looks at the cells around a point. Where a neighbour may lie
farther than the cells that were looked at, the search goes on with wider ones for the points that are left, so results are
exact. Ties are broken by id.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.maths import clip, haversine
from tidegrid.functions.names import free_names
from tidegrid.operators.graph import written
from tidegrid.operators.order import quantiles

#: Rows up to which a side (rivers, stations, drains of one map) is broadcast; more of them are found through cells.
BROADCAST_ROWS = 10_000


def cell(c: Column, size: float) -> Column:
    return F.floor(c / F.lit(size)).cast("long")


def _ring(points: DataFrame, size: float) -> DataFrame:
    """Every point once for each of the nine cells around it."""
    d = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    own = points.withColumn("_dx", F.explode(d)).withColumn("_dy", F.explode(d))
    return own.withColumns({"_cx": cell(F.col("x"), size) + F.col("_dx"), "_cy": cell(F.col("y"), size) + F.col("_dy")}).drop("_dx", "_dy")


def k_nearest(points: DataFrame, others: DataFrame, k: int, size: float | None = None, skip_self: bool = True, most_rounds: int = 60, within: float | None = None) -> DataFrame:
    """id, other, dist and rank of the k nearest ``others`` of each point; both have id, x and y.

    A neighbour nearer than a cell's side can't be outside the nine cells around a point. Points whose k-th neighbour
    isn't proven so go on with cells twice as wide; each round is written to the shared folder. ``size`` is the first
    side, by default that of a cell with k + 1 others at even density. Fewer than k others: all of them. Of
    others at one and the same place only the k + 1 with the smallest ids can be among the nearest, so a place that
    very many share makes no more pairs than that for each point. With ``within``, others farther than that don't count: cells grow no
    wider, and a point far from all others, for which the search would go over most of them, makes no pairs.
    """
    others = others.select("id", "x", "y")
    box = [f(F.col(c)) for c in ("x", "y") for f in (F.min, F.max)]
    n, x0, x1, y0, y1 = others.agg(F.count(F.lit(1)), *box).first()
    order = Window.partitionBy("id").orderBy("dist", "other")
    if not n:
        return points.sparkSession.createDataFrame([], f"id {points.schema['id'].dataType.simpleString()}, other {others.schema['id'].dataType.simpleString()}, dist double, rank int")
    least = min(k, n - (1 if skip_self else 0))
    p0, p1, q0, q1 = (v if v is not None else 0.0 for v in points.agg(*box).first())
    span = max(max(x1, p1) - min(x0, p0), max(y1, q1) - min(y0, q0), 1e-9)
    if size is None:
        size = max(((x1 - x0) * (y1 - y0) * (k + 1) / n) ** 0.5, span * 1e-6)
    if within is not None:
        size = min(size, within * (1 + 1e-9))
    same = Window.partitionBy("x", "y").orderBy("id")
    others = others.withColumn("_s", F.row_number().over(same)).filter(F.col("_s") <= k + 1).drop("_s")
    found, rest, whole = None, points.select("id", "x", "y"), Window.partitionBy("id")
    for _ in range(most_rounds):
        last = size > (span if within is None else min(span, within))
        near = others.select(F.col("id").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"), cell(F.col("x"), size).alias("_cx"), cell(F.col("y"), size).alias("_cy"))
        pairs = _ring(rest, size).join(near, ["_cx", "_cy"])
        if skip_self:
            pairs = pairs.filter(F.col("id") != F.col("other"))
        dist = F.sqrt(F.pow(F.col("x") - F.col("ox"), 2) + F.pow(F.col("y") - F.col("oy"), 2))
        pairs = pairs.select("id", "other", dist.alias("dist"))
        pairs = pairs if within is None else pairs.filter(F.col("dist") <= within)
        ranked = pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        proven = ranked.withColumns({"_n": F.count("*").over(whole), "_far": F.max("dist").over(whole)})
        done = written(proven.filter((F.col("_n") >= least) & ((F.col("_far") < size) | F.lit(last))).select("id", "other", "dist", "rank"), "nearest")
        found = done if found is None else found.unionByName(done)
        rest = written(rest.join(done.select("id").distinct(), "id", "left_anti"), "nearest-rest")
        if last or rest.isEmpty():
            return found
        size = size * 2 if within is None else min(size * 2, within * (1 + 1e-9))
    raise RuntimeError(f"k_nearest: no end after {most_rounds} rounds")


def beside(points: DataFrame, small: DataFrame, out: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """Points, each with the rows of a small table as an array of structs (``out``, sorted): one row is broadcast, points
    aren't moved, and neither repeated points nor an empty table lose any. The size is checked."""
    n = small.count()
    if n > most:
        raise ValueError(f"{n} rows are too many to stand beside every point: use k_nearest or idw_nearest")
    return points.join(F.broadcast(small.agg(F.array_sort(F.collect_list(F.struct(*small.columns))).alias(out))))


def nearest_in_table(points: DataFrame, targets: DataFrame, dist: Callable[[Column], Column], out: str = "dist") -> DataFrame:
    """Every point with the smallest distance to a small table of targets (null if it is empty); ``dist`` makes it of a
    target's struct and the point's columns. Larger tables are what ``k_nearest`` is for."""
    return beside(points, targets, "_targets").withColumn(out, F.array_min(F.transform("_targets", dist))).drop("_targets")


def river_proximity(points: DataFrame, rivers: DataFrame, scale_m: float = 500.0) -> DataFrame:
    """The largest Gaussian weight of the distance to the points of ``rivers`` (r_lat, r_lon), 0 without any."""
    near = nearest_in_table(points, rivers.select("r_lat", "r_lon"), lambda r: haversine(F.col("lat"), F.col("lon"), r["r_lat"], r["r_lon"]), "_near")
    return near.withColumn("river", F.coalesce(F.exp(-F.pow(F.col("_near") / scale_m, 2)), F.lit(0.0))).drop("_near")


def coast_distance(lat: Column, lon: Column, coast_lat: float, coast_lon: float, most_m: float = 30_000.0) -> Column:
    """Share of 30 km to one coast point, at most 1."""
    return clip(haversine(lat, lon, F.lit(coast_lat), F.lit(coast_lon)) / most_m, 0.0, 1.0)


def drain_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6_371_000.0) -> Column:
    """Euclidean distance of latitude and longitude in radians, in metres; the narrowing of longitudes is left out."""
    return F.lit(radius) * F.sqrt(F.pow(F.radians(lat1 - lat2), 2) + F.pow(F.radians(lon1 - lon2), 2))


def idw_all(points: DataFrame, stations: DataFrame, power: float = 2.0, floor: float = 1e-10) -> DataFrame:
    """Inverse-distance weights over all stations (s_x, s_y, s_value), a small table; null without one."""

    def add(sums: Column, s: Column) -> Column:
        d = F.greatest(F.sqrt(F.pow(F.col("x") - s["s_x"], 2) + F.pow(F.col("y") - s["s_y"], 2)), F.lit(floor))
        w = F.lit(1.0) / F.pow(d, F.lit(power))
        return F.struct((sums["a"] + w * s["s_value"]).alias("a"), (sums["b"] + w).alias("b"))

    none = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
    own = beside(points, stations.select("s_x", "s_y", "s_value").filter("s_value is not null"), "_stations")
    return own.withColumn("value", F.aggregate("_stations", none, add, lambda z: F.try_divide(z["a"], z["b"]))).drop("_stations")


def idw_nearest(points: DataFrame, value: str, size: float | None = None, k: int = 5, floor: float = 1e-10) -> DataFrame:
    """Points (id, x, y, value): a null value becomes the inverse-distance mean of the k nearest that have one."""
    known = points.filter(F.col(value).isNotNull())
    near = k_nearest(points.filter(F.col(value).isNull()), known, k, size, skip_self=False)
    w = F.lit(1.0) / F.greatest("dist", F.lit(floor))
    filled = near.join(known.select(F.col("id").alias("other"), F.col(value).alias("_v")), "other").groupBy("id").agg((F.sum(w * F.col("_v")) / F.sum(w)).alias("_filled"))
    return points.join(filled, "id", "left").withColumn(value, F.coalesce(value, "_filled")).drop("_filled")


def interpolate_by(points: DataFrame, stations: DataFrame, at: str = "lat", value: str = "rain", parts: int = 200) -> DataFrame:
    """Linear interpolation along one coordinate, flat beyond the ends: both sides of an as-of join. Null without stations.

    Stations are one row a position. Points and stations are dealt to parts of the coordinate, at quantiles of the stations',
    and sorted together within each: the last station at or before a point and the first one after it are window
    functions. What lies beyond a part's ends comes from a table of the parts' first and last stations.
    """
    stations = stations.select(F.col(at).cast("double").alias("_at"), F.struct(F.col(at).cast("double").alias("x"), F.col(value).cast("double").alias("v")).alias("_s")).filter("_at is not null")
    cuts = sorted(set(stations.approxQuantile("_at", [k / parts for k in range(1, parts)], 0.001)))
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<double>"), lambda c: c <= F.col("_at"))) if cuts else F.lit(0)
    own = points.withColumns({"_at": F.col(at).cast("double"), "_s": F.lit(None).cast("struct<x: double, v: double>"), "_point": F.lit(1)})
    both = own.unionByName(stations.withColumn("_point", F.lit(0)), allowMissingColumns=True).withColumn("_part", part)
    ends = stations.withColumn("_part", part).groupBy("_part").agg(F.min("_s").alias("_first"), F.max("_s").alias("_last"))
    spine = points.sparkSession.range(len(cuts) + 1).select(F.col("id").cast("int").alias("_part")).join(ends, "_part", "left")
    down, up = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    spine = spine.select("_part", F.last("_last", True).over(down).alias("_below"), F.last("_first", True).over(up).alias("_above"))  # a row for each part
    order = Window.partitionBy("_part").orderBy("_at", "_point")
    low = F.last("_s", True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    high = F.last("_s", True).over(Window.partitionBy("_part").orderBy(F.desc("_at"), F.desc("_point")).rowsBetween(Window.unboundedPreceding, -1))
    found = both.withColumns({"_lo": low, "_hi": high}).filter("_point = 1").join(F.broadcast(spine), "_part")
    found = found.withColumns({"_lo": F.coalesce("_lo", "_below"), "_hi": F.coalesce("_hi", "_above")})
    x0, v0, x1, v1 = F.col("_lo.x"), F.col("_lo.v"), F.col("_hi.x"), F.col("_hi.v")
    line = v0 + (v1 - v0) * (F.col("_at") - x0) / (x1 - x0)
    kept = [c for c in points.columns if c != value]
    return found.select(*kept, F.when(F.col("_lo").isNull(), v1).when(F.col("_hi").isNull(), v0).otherwise(line).alias(value))


def sample_raster(points: DataFrame, raster: DataFrame, x0: float, y0: float, res: float, nodata: float | None = None) -> DataFrame:
    """Each point with the value of the raster cell (row, col, value) that holds it; null outside and for nodata."""
    own = points.withColumns({"col": F.floor((F.col("x") - x0) / res).cast("int"), "row": F.floor((F.lit(y0) - F.col("y")) / res).cast("int")})
    value = F.col("value") if nodata is None else F.when(F.col("value") != nodata, F.col("value"))
    return own.join(raster.withColumn("value", value), ["row", "col"], "left")


def sample_tiles(points: DataFrame, tiles: DataFrame, cells: DataFrame, bands: Sequence[str], nodata: dict[str, float] | None = None, size: float | None = None) -> DataFrame:
    """Each point with all bands of the cell that holds it, from a mosaic of raster tiles in one pass; null where there is none.

    tiles: tile, x0 and y0 (the upper left corner), res, rows, cols; cells: tile, row, col and the bands. A tile holds its upper and left
    edge, not the others. Where tiles overlap that with the smallest id counts, band by band: a null, or the band's ``nodata`` value, lets
    the next one show. Tiles are found by an index: their bounds as squares of ``size`` (by default the largest side of a tile, so a tile
    has at most four), to which points are dealt; no point meets a tile that isn't near it.
    """
    nodata = nodata or {}
    if size is None:
        size = tiles.agg(F.max(F.greatest("rows", "cols") * F.col("res"))).first()[0] or 1.0
    left, top, square, point, at_row, at_col = free_names(points, "_left", "_top", "_square", "_point", "_row", "_col")
    own = written(points.withColumn(point, F.monotonically_increasing_id()), "points")
    span = lambda a, b: F.sequence(F.floor(a / size), F.floor(b / size))
    wide, high = F.col("cols") * F.col("res"), F.col("rows") * F.col("res")
    index = tiles.select("tile", F.col("x0").alias(left), F.col("y0").alias(top), "res", "rows", "cols", F.explode(span(F.col("x0"), F.col("x0") + wide)).alias("_sx"), span(F.col("y0") - high, F.col("y0")).alias("_sy"))
    index = index.withColumn("_sy", F.explode("_sy")).withColumn(square, F.struct("_sx", "_sy")).drop("_sx", "_sy")
    placed = own.select(point, F.col("x").alias("_x"), F.col("y").alias("_y"), F.struct(F.floor(F.col("x") / size).alias("_sx"), F.floor(F.col("y") / size).alias("_sy")).alias(square))
    near = placed.join(index, square).withColumns({at_col: F.floor((F.col("_x") - F.col(left)) / F.col("res")), at_row: F.floor((F.col(top) - F.col("_y")) / F.col("res"))})
    near = near.filter((F.col(at_col) >= 0) & (F.col(at_col) < F.col("cols")) & (F.col(at_row) >= 0) & (F.col(at_row) < F.col("rows")))
    value = lambda b: F.when(F.col(b) != nodata[b], F.col(b)) if b in nodata else F.col(b)
    known = cells.select("tile", F.col("row").cast("long").alias(at_row), F.col("col").cast("long").alias(at_col), *[value(b).alias(b) for b in bands])
    met = near.select(point, "tile", at_row, at_col).join(known, ["tile", at_row, at_col])
    first = met.groupBy(point).agg(*[F.min_by(b, F.when(F.col(b).isNotNull(), F.col("tile"))).alias(b) for b in bands])
    return own.drop(*bands).join(first, point, "left").drop(point)


def fill_bands(sampled: DataFrame, fills: dict[str, float | None]) -> DataFrame:
    """Null samples of each band to its constant, or, for None, to the exact median of the others."""
    own = written(sampled, "samples")
    by = {b: quantiles(own, b, [0.5])[0] if f is None else f for b, f in fills.items()}
    return own.withColumns({b: F.coalesce(F.col(b).cast("double"), F.lit(x).cast("double")) for b, x in by.items()})


def fill_raster(sampled: DataFrame, fill: float | None = None) -> DataFrame:
    """Null samples to a constant, or to the median of the others."""
    if fill is not None:
        return sampled.withColumn("value", F.coalesce("value", F.lit(fill)))
    middle = quantiles(written(sampled.select("value"), "samples"), "value", [0.5])[0]
    return sampled.withColumn("value", F.coalesce("value", F.lit(middle).cast("double")))


def neighbour_slope(pairs: DataFrame, elevation: DataFrame, none: float = 0.5) -> DataFrame:
    """Of neighbour pairs (id, other, dist): steepest slope in degrees, the uphill count, and the slope by mean distance."""
    e = elevation.select("id", "elev")
    both = pairs.join(e, "id").join(e.select(F.col("id").alias("other"), F.col("elev").alias("_oe")), "other")
    dz = F.abs(F.col("_oe") - F.col("elev"))
    grade = F.max(F.when(F.col("dist") > 0, dz / F.col("dist")))
    found = both.groupBy("id").agg(
        F.degrees(F.atan(grade)).alias("slope"),
        F.count_if(F.col("_oe") > F.col("elev")).alias("uphill"),
        F.degrees(F.atan(F.max(dz) / F.nullif(F.avg("dist"), F.lit(0.0)))).alias("slope_mean_dist"),
    )
    return elevation.select("id").join(found, "id", "left").withColumns({"slope": F.coalesce("slope", F.lit(none)), "uphill": F.coalesce("uphill", F.lit(0)), "slope_mean_dist": F.coalesce("slope_mean_dist", F.lit(none))})


def idw_by_hour(points: DataFrame, stations: DataFrame, readings: DataFrame, power: float = 2.0, floor: float = 1e-10) -> DataFrame:
    """id, t and the inverse-distance mean of each hour's readings (station, t, value) at each point.

    Weights depend on point and station alone: they are made once, on a small table of stations (station, s_x, s_y),
    and joined with the readings; no loop over hours. Hours without readings have no rows.
    """
    n = stations.count()
    if n > BROADCAST_ROWS:
        raise ValueError(f"{n} stations: use idw_nearest by hour")
    d = F.greatest(F.sqrt(F.pow(F.col("x") - F.col("s_x"), 2) + F.pow(F.col("y") - F.col("s_y"), 2)), F.lit(floor))
    weights = points.select("id", "x", "y").join(F.broadcast(stations)).select("id", "station", (F.lit(1.0) / F.pow(d, F.lit(power))).alias("_w"))
    return weights.join(readings, "station").groupBy("id", "t").agg((F.sum(F.col("_w") * F.col("value")) / F.sum("_w")).alias("value"))
