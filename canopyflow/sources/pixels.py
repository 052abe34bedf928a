"""Pixel table: partitioned storage, windowed reads, and unusable windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WINDOW = ["parcel_id", "scene_id"]
FEW_WINDOWS = 200_000


def write_pixels(pixels: DataFrame, path: str) -> None:
    """Store pixels by tile and month, sorted by position inside each file.

    A read of one window then touches the files of its tile and months only, and
    within them the row groups of its rows.  ``obs_date`` and ``tile`` must exist.
    """
    placed = pixels.withColumn("month", F.date_trunc("month", "obs_date").cast("date"))
    band = F.floor(F.col("py") / 256)  # several files per partition, so no task holds a whole tile
    (placed.repartition("tile", "month", band).sortWithinPartitions("tile", "month", "py", "px")
     .write.mode("append").partitionBy("tile", "month").parquet(path))


def read_window(spark: SparkSession, path: str, tile: str, start: str, end: str,
                box: tuple[int, int, int, int]) -> DataFrame:
    """Bands of one tile inside a period and a cell box ``(px0, py0, px1, py1)``."""
    px0, py0, px1, py1 = box
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    return (spark.read.parquet(path)
            .where((F.col("tile") == tile) & F.col("month").between(F.trunc(first, "month"), last))
            .where(F.col("obs_date").between(first, last) & F.col("px").between(px0, px1) & F.col("py").between(py0, py1))
            .select("scene_id", "px", "py", "obs_date", "baseline", "scl", "b04", "b08"))


def _few(df: DataFrame) -> bool:
    return df.limit(FEW_WINDOWS + 1).count() <= FEW_WINDOWS


def selected_pixels(bands: DataFrame, selected: DataFrame) -> DataFrame:
    """Pixels that may belong to the windows of ``selected(parcel_id, scene_id, obs_date, tile)``.

    Only a narrowing: a list of windows that is short by count is broadcast, and
    beyond that the list of their tiles and months, so no pixel is exchanged; a
    join with ``selected`` after averaging decides.  On a stored table
    (``write_pixels``) tile and month of the list prune partitions at run time.
    """
    place = ["tile", "month"] if {"tile", "month"} <= set(bands.columns) else []
    wanted = selected.withColumn("month", F.trunc("obs_date", "month")).select(*WINDOW, *place)
    if _few(wanted):
        return bands.join(F.broadcast(wanted), [*WINDOW, *place], "left_semi")
    places = wanted.select(*place).distinct()
    return bands.join(F.broadcast(places), place, "left_semi") if place and _few(places) else bands


def window_totals(bands: DataFrame, *more: Column) -> DataFrame:
    """What one pass over the pixels tells of each window: ``reason`` it is unusable
    for, if any, and aggregates ``more``."""
    seen = bands.groupBy(*WINDOW).agg(
        *[F.count(c).alias(f"n_{c}") for c in ("b04", "b08", "scl")],
        (F.max("px") - F.min("px") + 1).alias("width"), (F.max("py") - F.min("py") + 1).alias("height"), *more)
    missing = F.least(F.col("n_b04"), F.col("n_b08"), F.col("n_scl")) == 0
    reason = (F.when(missing, F.lit("missing_band"))
              .when(F.least(F.col("width"), F.col("height")) < 2, F.lit("narrow_window")))
    return seen.withColumn("reason", reason).drop("n_b04", "n_b08", "n_scl", "width", "height")


def unusable_windows(bands: DataFrame) -> DataFrame:
    """Scenes of a parcel that lack a band or are narrower than two cells, with the reason."""
    return window_totals(bands).where(F.col("reason").isNotNull())


def without_windows(bands: DataFrame, rejects: DataFrame) -> DataFrame:
    """Pixels of the remaining windows.

    Rejects are normally few; only when counting confirms that are they
    broadcast, which spares the pixels an exchange.
    """
    listed = rejects.select(*WINDOW)
    return bands.join(F.broadcast(listed) if _few(listed) else listed, WINDOW, "left_anti")
