"""Parcel analysis: observations to verdict, for every series in one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyflow import constants as K
from canopyflow.functions.numbers import half_up
from canopyflow.functions.profile import months_present
from canopyflow.operators import pixels, profiles, ranking, rules, smoothing
from canopyflow.operators import scenes as scene_ops
from canopyflow.sources.pixels import selected_pixels, window_totals


def length_status(profile: DataFrame) -> DataFrame:
    """Reason columns for series too short to analyse or to calibrate with; months are
    counted where the profile does not bring their number."""
    known = profile if "n_months" in profile.columns else profile.withColumn("n_months", months_present())
    return known.withColumns({
        "analysis_reason": F.when(F.col("n_obs") < K.MIN_DATES_ANALYSIS, F.lit("too_short")),
        "calibration_reason": F.when(F.col("n_obs") < K.MIN_DATES_CALIBRATION, F.lit("too_short"))
        .when(F.col("n_months") < K.MIN_MONTHS_SAMPLE, F.lit("few_months")),
    })


def analyze_observations(observations: DataFrame, keys: Sequence[str], curves: DataFrame, as_of: str,
                         overrides: str | None = None, min_dates: int = 0,
                         native_warp: bool = False) -> DataFrame:
    """Profile, rules, curve ranking and final verdict per series.

    ``observations`` holds one row per series and day.  ``overrides`` names a
    map column of threshold overrides that is constant within a series.  Series
    with fewer than ``min_dates`` dates keep their row, with ``status`` set.
    """
    group = [*keys, overrides] if overrides else list(keys)
    if overrides:
        # a map cannot be a grouping key, so it travels as its sorted entries
        observations = observations.withColumn(overrides, F.sort_array(F.map_entries(overrides)))
    profile = profiles.monthly_profile(observations, group)
    if overrides:
        profile = profile.withColumn(overrides, F.map_from_entries(overrides))
    return analyze_profile(profile, curves, as_of, overrides, min_dates, native_warp)


def analyze_profile(profile: DataFrame, curves: DataFrame, as_of: str, overrides: str | None = None,
                    min_dates: int = 0, native_warp: bool = False) -> DataFrame:
    """Rules, curve ranking and final verdict of monthly profiles (``monthly_profile``)."""
    classified = rules.classify(profile, overrides)
    classified = rules.in_progress(classified, F.lit(as_of).cast("date"))
    classified = rules.verdict_texts(rules.stage_details(rules.rule_details(classified)))
    ranked = ranking.rank_curves(profiles.fill_profile(classified), curves, native=native_warp)
    final = ranking.arbitrate_parcel(ranked)
    status = F.when(F.col("n_obs") < min_dates, F.lit("too_short")).otherwise(F.lit("ok"))
    return final.withColumn("status", status)


def select_scenes(scenes: DataFrame, keys: Sequence[str], tie_breaks: Sequence[str],
                  max_scenes: int | None = None) -> DataFrame:
    """Scenes to read per parcel: the best of each day, thinned evenly where a number is given."""
    best = scene_ops.best_per_day(scenes, keys, tie_breaks)
    return best if max_scenes is None else scene_ops.thin_uniformly(best, keys, max_scenes)


def series_from_pixels(bands: DataFrame, selected: DataFrame, min_pixels: int = K.MIN_PIXELS) -> DataFrame:
    """Observation per parcel and selected scene.

    Pixels are read once, those of scenes that were not chosen are left out where
    the list is short, and pixels are averaged per parcel and scene before they meet
    the scene list, so only one row per parcel and scene is exchanged, never a pixel.
    """
    window = ["parcel_id", "scene_id"]
    usable, index = pixels.usable_index()
    totals = window_totals(selected_pixels(bands, selected), F.sum(F.when(usable, index)).alias("total"),
                           F.count_if(usable).alias("pixels"))
    points = pixels.plausible_means(totals.where(F.col("reason").isNull()).drop("reason"), min_pixels)
    cloud = half_up(F.coalesce(F.col("cloud").cast("double"), F.lit(0.0)), 1).alias("cloud")
    return points.join(selected.select(*window, "obs_date", cloud, "tile"), window)


def analyze_parcels(bands: DataFrame, scenes: DataFrame, curves: DataFrame, as_of: str,
                    tie_breaks: Sequence[str] = ("scene_id",), max_scenes: int | None = None,
                    min_pixels: int = K.MIN_PIXELS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(verdicts, smoothed series, run metadata)`` from pixels and scenes.

    ``scenes`` lists candidate scenes per parcel (``scenes_over_parcels``).
    """
    keys = ["parcel_id"]
    chosen = select_scenes(scenes, keys, tie_breaks, max_scenes)
    series = series_from_pixels(bands, chosen, min_pixels)
    verdicts = analyze_observations(series, keys, curves, as_of, min_dates=K.MIN_DATES_ANALYSIS)
    return verdicts, smoothing.regularize(series, keys), scene_ops.run_metadata(scenes, chosen, series, keys)
