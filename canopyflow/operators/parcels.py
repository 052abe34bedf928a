"""Parcel features: repair, attributes, search, request checks and the reference grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyflow import constants as K
from canopyflow.functions import rings as R
from canopyflow.functions.geodesy import grid_zone, project_points


def normalize_features(features: DataFrame, rings: str = "rings") -> DataFrame:
    """Drop features without geometry and put axes in lon/lat order."""
    return features.where(F.col(rings).isNotNull()).withColumn(rings, R.repair_axes(rings))


def read_attributes(features: DataFrame, attrs: str = "attrs") -> DataFrame:
    """One column per known attribute, taken from the first alias that has a value."""
    columns = {name: F.coalesce(*[F.try_element_at(F.col(attrs), F.lit(a)) for a in aliases])
               for name, aliases in K.PARCEL_ALIASES.items()}
    return features.withColumns({f"attr_{name}": c for name, c in columns.items()})


def by_box(parcels: DataFrame, box: tuple[float, float, float, float], limit: int | None = None) -> DataFrame:
    """Parcels whose bounds meet a box; the bounds columns are pushed down."""
    minx, miny, maxx, maxy = box
    hit = ((F.col("xmin") <= maxx) & (F.col("xmax") >= minx) & (F.col("ymin") <= maxy) & (F.col("ymax") >= miny))
    found = parcels.where(hit)
    return found if limit is None else found.orderBy("parcel_id").limit(limit)


def by_code(parcels: DataFrame, code: str, limit: int | None = None, attrs: str = "attrs") -> DataFrame:
    """Parcels carrying a registry code under any of its attribute names."""
    value = F.coalesce(*[F.try_element_at(F.col(attrs), F.lit(a)) for a in K.PARCEL_ALIASES["code"]])
    found = parcels.where(value == code)
    return found if limit is None else found.orderBy("parcel_id").limit(limit)


def area_status(area_ha: Column) -> Column:
    """Reason why a parcel of this size is not analysed."""
    return (F.when(area_ha < K.PARCEL_MIN_HA, F.lit("too_small"))
            .when(area_ha > K.PARCEL_MAX_HA, F.lit("too_large")))


def request_reason(requests: DataFrame, zoning: bool = False) -> DataFrame:
    """Column ``reason`` for requests with an unusable geometry type or parameter."""
    kinds = ["Polygon", "MultiPolygon"] if zoning else ["Polygon"]
    low, high = (6, 200) if zoning else (10, 300)
    reason = (F.when(F.col("geometry_type").isNull() | ~F.col("geometry_type").isin(kinds), F.lit("geometry"))
              .when(~F.col("cloud_max").between(0, 100), F.lit("cloud_max"))
              .when(~F.col("max_scenes").between(low, high), F.lit("max_scenes")))
    if zoning:
        reason = reason.when(~F.col("min_area_ha").between(0.1, 100.0), F.lit("min_area_ha"))
    return requests.withColumn("reason", reason)


def grid_for_parcel(parcels: DataFrame, rings: str = "rings", max_side: int = K.MAX_GRID_SIDE) -> DataFrame:
    """Reference grid: zone of the centroid, bounds in metres, resolution and size.

    The resolution is the smallest multiple of 10 m that keeps both sides within
    ``max_side`` cells, which bounds every raster step that follows.
    """
    df = parcels.withColumns(R.bounds(rings)).withColumns(R.centroid(rings))
    df = df.withColumns({"zone": grid_zone(F.col("lon")), "south": F.col("lat") < 0})
    df = df.withColumn("epsg", F.when(F.col("south"), 32700).otherwise(32600) + F.col("zone"))
    # bounds are projected along their sides, 22 steps each
    steps = 22

    def point(i: Column) -> Column:
        side = F.floor(i / steps)
        t = (i % steps) / F.lit(float(steps))
        dx, dy = F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")
        lon = (F.when(side == 0, F.col("xmin") + dx * t).when(side == 1, F.col("xmax"))
               .when(side == 2, F.col("xmax") - dx * t).otherwise(F.col("xmin")))
        lat = (F.when(side == 0, F.col("ymin")).when(side == 1, F.col("ymin") + dy * t)
               .when(side == 2, F.col("ymax")).otherwise(F.col("ymax") - dy * t))
        return F.struct(lon.alias("lon"), lat.alias("lat"))

    frame = F.transform(F.sequence(F.lit(0), F.lit(4 * steps - 1)), point)
    df = df.withColumn("frame", project_points(frame, F.col("zone"), F.col("south")))
    df = df.withColumns({
        "grid_minx": F.array_min("frame.x"), "grid_maxx": F.array_max("frame.x"),
        "grid_miny": F.array_min("frame.y"), "grid_maxy": F.array_max("frame.y")}).drop("frame")
    wide, high = F.col("grid_maxx") - F.col("grid_minx"), F.col("grid_maxy") - F.col("grid_miny")
    longest = F.greatest(F.ceil(wide / 10.0), F.ceil(high / 10.0))
    df = df.withColumn("res", F.lit(10.0) * F.greatest(F.lit(1), F.ceil(longest / F.lit(float(max_side)))))
    return df.withColumns({
        "width": F.ceil(wide / F.col("res")).cast("int"), "height": F.ceil(high / F.col("res")).cast("int"),
        "origin_x": F.col("grid_minx"), "origin_y": F.col("grid_maxy")})
