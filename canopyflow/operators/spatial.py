"""Spatial joins on coarse buckets: an equi-join narrows, exact geometry decides.

Parcels are limited to 200 000 ha (``area_status``), so with the default bucket
a parcel is listed in a few dozen buckets at most.  Crowded buckets of clicks or
scenes are left to Spark's adaptive skew join, which needs no pass of its own over
the input.  Cells of a raster are better served by ``scanline``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyflow import constants as K
from canopyflow.functions import rings as R
from canopyflow.operators.skew import skew_join

BUCKET_DEG = 0.05


def _bucket(value: Column, size: float) -> Column:
    return F.floor(value / F.lit(size)).cast("bigint")


def _spread_over_buckets(df: DataFrame, size: float, margin: float = 0.0) -> DataFrame:
    """Repeat each row for every bucket its bounds (widened by ``margin``) meet."""
    m = F.lit(margin)
    xs = F.sequence(_bucket(F.col("xmin") - m, size), _bucket(F.col("xmax") + m, size))
    ys = F.sequence(_bucket(F.col("ymin") - m, size), _bucket(F.col("ymax") + m, size))
    return df.withColumn("bx", F.explode(xs)).withColumn("by", F.explode(ys))


def cells_in_parcels(cells: DataFrame, parcels: DataFrame, cell_size: float,
                     bucket: float = BUCKET_DEG) -> DataFrame:
    """Pairs of cells ``(x, y)`` (centres) and parcels ``(rings, bounds)`` that touch."""
    half = cell_size / 2
    placed = cells.withColumns({"bx": _bucket(F.col("x"), bucket), "by": _bucket(F.col("y"), bucket)})
    listed = _spread_over_buckets(parcels, bucket, half)
    near = skew_join(placed, listed, ["bx", "by"], spread=["x", "y"]).where(
        (F.col("x") + half >= F.col("xmin")) & (F.col("x") - half <= F.col("xmax"))
        & (F.col("y") + half >= F.col("ymin")) & (F.col("y") - half <= F.col("ymax")))
    return near.where(F.expr(R.touches_cell_sql("rings", "x", "y", f"{half!r}D"))).drop("bx", "by")


def scenes_over_parcels(scenes: DataFrame, parcels: DataFrame, start: str, end: str, cloud_max: float,
                        bucket: float = 0.1) -> DataFrame:
    """Pairs of scenes and parcels with overlapping bounds inside a period.

    A pair meeting in several buckets is reported only in the one holding the
    lower-left corner of the overlap.
    """
    wanted = scenes.where(F.col("obs_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
                          & (F.col("cloud") < cloud_max))
    left = _spread_over_buckets(wanted, bucket).withColumnsRenamed(
        {"xmin": "s_xmin", "ymin": "s_ymin", "xmax": "s_xmax", "ymax": "s_ymax"})
    right = _spread_over_buckets(parcels, bucket)
    pairs = left.join(right, ["bx", "by"])
    overlap = ((F.col("s_xmin") <= F.col("xmax")) & (F.col("s_xmax") >= F.col("xmin"))
               & (F.col("s_ymin") <= F.col("ymax")) & (F.col("s_ymax") >= F.col("ymin")))
    corner = ((_bucket(F.greatest("s_xmin", "xmin"), bucket) == F.col("bx"))
              & (_bucket(F.greatest("s_ymin", "ymin"), bucket) == F.col("by")))
    return pairs.where(overlap & corner).drop("bx", "by")


def pick_parcel(clicks: DataFrame, parcels: DataFrame, keys: Sequence[str] = ("click_id",),
                tolerance: float = K.PICK_TOLERANCE_DEG, bucket: float = BUCKET_DEG) -> DataFrame:
    """Parcel holding each clicked point, else the first one near it.

    ``ord`` on the parcel side is the order in which a registry lists them.
    """
    placed = clicks.withColumns({"bx": _bucket(F.col("x"), bucket), "by": _bucket(F.col("y"), bucket)})
    listed = _spread_over_buckets(parcels, bucket, tolerance)
    near = placed.join(listed, ["bx", "by"]).where(
        (F.col("xmin") <= F.col("x") + tolerance) & (F.col("xmax") >= F.col("x") - tolerance)
        & (F.col("ymin") <= F.col("y") + tolerance) & (F.col("ymax") >= F.col("y") - tolerance))
    hit = R.contains_point("rings", "x", "y")
    first = F.min(F.struct((~hit).alias("miss"), "ord", "parcel_id")).alias("pick")
    return (near.groupBy(*keys).agg(first)
            .select(*keys, F.col("pick.parcel_id").alias("parcel_id"), (~F.col("pick.miss")).alias("inside")))


def against_boundary(parcels: DataFrame, boundary: DataFrame, rings: str = "rings") -> DataFrame:
    """Column ``relation`` of every parcel to the single row of ``boundary(rings)``."""
    outline = boundary.select("rings").scalar()
    return (parcels.withColumn("boundary_rings", outline)
            .withColumn("relation", R.rings_relation(rings, "boundary_rings")).drop("boundary_rings"))
