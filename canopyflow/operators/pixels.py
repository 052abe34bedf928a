"""Band values to vegetation index: validity, scene means, monthly composites."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyflow import constants as K
from canopyflow.functions.numbers import E7
from canopyflow.schemas import MONTH_COLS, MONTHS

PIXEL = ["parcel_id", "px", "py"]


def band_offset(baseline: str = "baseline") -> Column:
    """Radiometric offset by processing baseline, compared as text."""
    return F.when(F.coalesce(F.col(baseline), F.lit(K.OFFSET_BASELINE)) >= K.OFFSET_BASELINE,
                  F.lit(K.BAND_OFFSET)).otherwise(F.lit(0))


def usable_index() -> tuple[Column, Column]:
    """Whether a pixel is usable, and its index in 1e-7 units.

    The offset cancels in the difference of the bands, so it is only needed in
    their sum.  Keeping the expressions this small matters: they are inlined
    into every filter and aggregate above.
    """
    total = F.col("b08") + F.col("b04") - 2 * band_offset()
    usable = (F.col("b04") > 0) & (F.col("b08") > 0) & F.col("scl").isin(*K.SCL_KEEP) & (total > K.MIN_BAND_SUM)
    index = (F.col("b08") - F.col("b04")) / total
    return usable, F.floor(index * float(E7) + 0.5).cast("bigint")


def valid_pixels(bands: DataFrame) -> DataFrame:
    """Usable pixels with their index ``ndvi_e7`` in 1e-7 units."""
    usable, index = usable_index()
    return bands.where(usable).withColumn("ndvi_e7", index)


def scene_points(pixels: DataFrame, keys: Sequence[str], carry: Sequence[Column] = (),
                 min_pixels: int = K.MIN_PIXELS) -> DataFrame:
    """Mean index per key and scene, where enough pixels are valid and the mean is plausible."""
    return plausible_means(pixels.groupBy(*keys).agg(F.sum("ndvi_e7").alias("total"), F.count(F.lit(1)).alias("pixels"), *carry),
                           min_pixels)


def plausible_means(totals: DataFrame, min_pixels: int = K.MIN_PIXELS) -> DataFrame:
    """``ndvi_e4`` from the sum ``total`` of ``pixels`` index values."""
    mean = F.col("total") / F.col("pixels") / F.lit(float(E7))
    return (totals.where(F.col("pixels") >= min_pixels)
            .withColumn("mean", mean)
            .where(F.col("mean").between(K.NDVI_LOW, K.NDVI_HIGH))
            .withColumn("ndvi_e4", F.floor(F.col("mean") * 1e4 + 0.5))
            .drop("total", "mean"))


def monthly_composite(pixels: DataFrame, pixel_keys: Sequence[str] = tuple(PIXEL),
                      min_months: int = K.MIN_VALID_MONTHS_PIXEL) -> DataFrame:
    """Mean index per pixel and month over all scenes, in 1e-7 units.

    One wide row per pixel from one aggregation; pixels seen in too few months
    are dropped in the same pass.  Values outside the plausible range become
    null rather than being filtered: a filter would be pushed below the index
    and compute it again.
    """
    plausible = (F.col("ndvi_e7") > int(K.NDVI_LOW * E7)) & (F.col("ndvi_e7") < int(K.NDVI_HIGH * E7))
    dated = pixels.select(*pixel_keys, F.month("obs_date").alias("month"), F.when(plausible, F.col("ndvi_e7")).alias("v"))
    sums = []
    for m in MONTHS:
        hit = F.when(F.col("month") == m, F.col("v"))
        sums += [F.sum(hit).alias(f"s{m}"), F.count(hit).alias(f"c{m}")]
    means = [F.when(F.col(f"c{m}") > 0, F.floor(F.col(f"s{m}") / F.col(f"c{m}") + 0.5)).alias(f"m{m}")
             for m in MONTHS]
    wide = dated.groupBy(*pixel_keys).agg(*sums).select(*pixel_keys, *means)
    present = sum((F.col(c).isNotNull().cast("int") for c in MONTH_COLS), F.lit(0))
    return wide.withColumn("n_months", present).where(F.col("n_months") >= min_months)


def coarsen(bands: DataFrame, factor: int | Column, keys: Sequence[str]) -> DataFrame:
    """Average blocks of ``factor`` x ``factor`` cells; the class code is the block's first."""
    block = [F.floor(F.col(c) / factor).alias(c) for c in ("px", "py")]
    return bands.groupBy(*keys, *block).agg(
        F.avg("b04").alias("b04"), F.avg("b08").alias("b08"),
        F.min(F.struct("py", "px", "scl")).getField("scl").alias("scl"))


def on_grid(bands: DataFrame, grids: DataFrame, cell: float = 10.0) -> DataFrame:
    """Pixels of ``cell`` metres on the cells of each parcel's grid (``grid_for_parcel``).

    Where a grid is coarser, blocks of its size are averaged, so that a cell of the
    result has the area the grid states; other parcels' pixels stay as they are and
    are not exchanged, and parcels without a grid count as such.  Columns besides
    the position and the bands must be those of a scene.
    """
    coarse = grids.where(F.col("res") > cell).select("parcel_id", F.round(F.col("res") / cell).cast("int").alias("_factor"))
    measured = ["px", "py", "b04", "b08", "scl"]
    scene = [c for c in bands.columns if c not in measured]
    merged = coarsen(bands.join(coarse, "parcel_id"), F.col("_factor"), [*scene, "_factor"]).drop("_factor")
    return bands.join(coarse, "parcel_id", "left_anti").select(*scene, *measured).unionByName(merged)
