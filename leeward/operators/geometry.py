"""Grids, snapping and radius joins without a cross product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from leeward.functions.geo import (KM_PER_DEGREE, bearing_deg, haversine_km, local_xy_m, mollweide_to_lonlat)


def within_radius(left: DataFrame, right: DataFrame, left_at: tuple[str, str], right_at: tuple[str, str],
                  radius_km: float, on: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of rows at most ``radius_km`` apart, with ``distance_km``.

    The smaller side goes left: each of its rows is entered into every lattice square its
    bounding box touches, and the squares are joined by equality. The exact distance decides.
    """
    step = max(radius_km / KM_PER_DEGREE, 1e-6)
    squares_round = max(1, round(360.0 / step))
    lat, lon = (F.col(c) for c in left_at)
    reach = radius_km / KM_PER_DEGREE * 1.001
    # longitudes widen toward the poles; next to a pole the box goes all the way round
    widest_lat = F.abs(lat) + F.lit(reach)
    reach_lon = F.when(widest_lat >= 89.9, F.lit(180.0)).otherwise(
        F.least(F.lit(reach) / F.cos(F.radians(widest_lat)), F.lit(180.0)))

    def square(x: Column) -> Column:
        return F.floor(x / F.lit(step)).cast("long")

    boxed = (left.withColumn("__sy", F.explode(F.sequence(square(lat - F.lit(reach)), square(lat + F.lit(reach)))))
             .withColumn("__sx", F.explode(F.array_distinct(F.transform(
                 F.sequence(square(lon - reach_lon), square(lon + reach_lon)),
                 lambda s: F.pmod(s, F.lit(squares_round)))))))
    rlat, rlon = (F.col(c) for c in right_at)
    placed = right.withColumn("__sy", square(rlat)).withColumn("__sx", F.pmod(square(rlon), F.lit(squares_round)))
    pairs = boxed.join(placed, ["__sy", "__sx", *on])
    pairs = pairs.withColumn("distance_km", haversine_km(lat, lon, rlat, rlon))
    return pairs.filter(F.col("distance_km") <= radius_km).drop("__sy", "__sx")


def site_cities(sites: DataFrame, cities: DataFrame, max_km: float = 100.0, own_site_only: bool = False) -> DataFrame:
    """Cities within the radius of a site, with distance, bearing and offsets in metres."""
    sites = sites.select("site_no", "site_id", "jurisdiction_code", F.col("lat").alias("site_lat"),
                         F.col("lon").alias("site_lon"))
    on = ("site_no",) if own_site_only else ()
    if not own_site_only and "site_no" in cities.columns:
        cities = cities.drop("site_no")
    out = within_radius(sites, cities, ("site_lat", "site_lon"), ("lat", "lon"), max_km, on)
    x, y = local_xy_m(F.col("site_lat"), F.col("site_lon"), F.col("lat"), F.col("lon"))
    bearing = bearing_deg(F.col("site_lat"), F.col("site_lon"), F.col("lat"), F.col("lon"))
    return out.withColumn("bearing_deg", bearing).withColumn("x_m", x).withColumn("y_m", y)


def grid(sites: DataFrame, size: int, cell_km: float) -> DataFrame:
    """Square grid around every site: (site_no, cell_id, x_m, y_m, lat, lon, crs)."""
    half = size * cell_km * 1000.0 / 2
    cells = sites.select("site_no", "lat", "lon", F.explode(F.sequence(F.lit(0), F.lit(size * size - 1))).alias("cell_id"))
    x = (F.col("cell_id") % size + F.lit(0.5)) * F.lit(cell_km * 1000.0) - F.lit(half)
    y = (F.floor(F.col("cell_id") / size) + F.lit(0.5)) * F.lit(cell_km * 1000.0) - F.lit(half)
    metres = F.lit(KM_PER_DEGREE * 1000)
    out = cells.withColumn("x_m", x).withColumn("y_m", y)
    crs = F.concat(F.lit("local tangent plane, metres, origin "), F.col("site_no").cast("string"))
    return out.select(
        "site_no", F.col("cell_id").cast("long").alias("cell_id"),
        F.col("x_m").alias("x_m", metadata={"crs": "local tangent plane at the site", "unit": "m"}),
        F.col("y_m").alias("y_m", metadata={"crs": "local tangent plane at the site", "unit": "m"}),
        (F.col("lat") + F.col("y_m") / metres).alias("lat"),
        (F.col("lon") + F.col("x_m") / (metres * F.cos(F.radians(F.col("lat"))))).alias("lon"),
        crs.alias("crs"))


def cell_at(x_m: Column, y_m: Column, side: Column | int, extent_m: float = 200000.0) -> Column:
    """Number of the cell that holds a point of the site plane; NULL outside the grid."""
    side = side if isinstance(side, Column) else F.lit(side)
    step = F.lit(extent_m) / side
    ix = F.floor((x_m + F.lit(extent_m / 2)) / step).cast("long")
    iy = F.floor((y_m + F.lit(extent_m / 2)) / step).cast("long")
    return F.when((ix >= 0) & (ix < side) & (iy >= 0) & (iy < side), iy * side + ix)


def snap_to_cells(points: DataFrame, sites: DataFrame, side: Column | int, extent_m: float = 200000.0) -> DataFrame:
    """Points with (site_no, lat, lon) get the ``cell_id`` of their site's grid."""
    origin = sites.select("site_no", F.col("lat").alias("__lat0"), F.col("lon").alias("__lon0"))
    out = points.join(origin, "site_no")
    x, y = local_xy_m(F.col("__lat0"), F.col("__lon0"), F.col("lat"), F.col("lon"))
    return out.withColumn("cell_id", cell_at(x, y, side, extent_m)).drop("__lat0", "__lon0")


def population_points(points: DataFrame, x: str, y: str) -> DataFrame:
    lon, lat = mollweide_to_lonlat(F.col(x), F.col(y))
    return points.withColumn("lat", lat).withColumn("lon", lon)


def population_to_cells(points: DataFrame, sites: DataFrame, side: Column | int) -> DataFrame:
    """Inhabitants per grid cell."""
    cells = snap_to_cells(points, sites, side).filter(F.col("cell_id").isNotNull())
    return cells.groupBy("site_no", "cell_id").agg(F.sum("people").alias("people"), F.count(F.lit(1)).alias("n_points"))
