"""Scene selection: search, best scene per day, thinning, reference scene."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopyflow import constants as K


def search_scenes(scenes: DataFrame, bbox: tuple[float, float, float, float], start: str, end: str,
                  cloud_max: float) -> DataFrame:
    """Scenes meeting a box and a period below a cloud limit; every predicate is pushed down."""
    minx, miny, maxx, maxy = bbox
    return scenes.where(
        (F.col("xmin") <= maxx) & (F.col("xmax") >= minx) & (F.col("ymin") <= maxy) & (F.col("ymax") >= miny)
        & F.col("obs_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
        & (F.col("cloud") < cloud_max))


def cap_scenes(found: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
               limit: int = K.MAX_SCENES_FOUND) -> DataFrame:
    """The catalog's own result limit per parcel.

    A top-n rank: each task keeps at most ``limit`` rows per key before the
    exchange, so a parcel with very many scenes never arrives whole.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return found.withColumn("rn", rank).where(F.col("rn") <= limit).drop("rn")


def best_per_day(scenes: DataFrame, keys: Sequence[str], tie_breaks: Sequence[str],
                 date: str = "obs_date", cloud: str = "cloud") -> DataFrame:
    """Least cloudy scene per key and day; missing cloud counts as fully cloudy.

    Afterwards a key holds at most one row per calendar day, which bounds every
    later per-series window by the length of the archive in days.
    """
    order = [F.coalesce(F.col(cloud).cast("double"), F.lit(K.CLOUD_MISSING)), *tie_breaks]
    rank = F.row_number().over(Window.partitionBy(*keys, date).orderBy(*order))
    return scenes.withColumn("rn", rank).where(F.col("rn") == 1).drop("rn")


def thin_uniformly(scenes: DataFrame, keys: Sequence[str], max_scenes: int,
                   date: str = "obs_date") -> DataFrame:
    """Every ceil(n / max)-th scene from the first when a key has too many.

    Expects one scene per key and day (``best_per_day``).
    """
    by_key = Window.partitionBy(*keys)
    position = F.row_number().over(by_key.orderBy(date)) - 1
    step = F.ceil(F.count(F.lit(1)).over(by_key) / F.lit(max_scenes))
    return (scenes.withColumns({"scene_pos": position, "scene_step": step})
            .where(F.col("scene_pos") % F.col("scene_step") == 0)
            .drop("scene_pos", "scene_step"))


def reference_scene(scenes: DataFrame, keys: Sequence[str], tie_breaks: Sequence[str],
                    date: str = "obs_date", cloud: str = "cloud") -> DataFrame:
    """Least cloudy scene of March-May, else of the whole period, per key."""
    peak_season = F.month(date).isin(3, 4, 5)
    order = [peak_season.desc(), F.coalesce(F.col(cloud).cast("double"), F.lit(K.CLOUD_MISSING)),
             date, *tie_breaks]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return scenes.withColumn("rn", rank).where(F.col("rn") == 1).drop("rn")


def run_metadata(found: DataFrame, used: DataFrame, points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts per key: scenes found, scenes processed, valid dates."""
    def counts(df: DataFrame, name: str) -> DataFrame:
        one = [F.lit(int(name == c)).alias(c) for c in ("scenes_found", "scenes_processed", "valid_dates")]
        return df.select(*keys, *one)

    rows = (counts(found, "scenes_found").unionByName(counts(used, "scenes_processed"))
            .unionByName(counts(points, "valid_dates")))
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c)
                                     for c in ("scenes_found", "scenes_processed", "valid_dates")])
