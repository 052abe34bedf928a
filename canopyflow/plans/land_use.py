"""Land-use zoning of parcels: pixels to classes, regions, outlines and areas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyflow import constants as K
from canopyflow.operators import outline, pixels, ranking, regions, rules, superpixels, zoning
from canopyflow.operators.profiles import fill_profile
from canopyflow.session import cut_lineage
from canopyflow.sources.curves import land_use_classes
from canopyflow.sources.pixels import unusable_windows, without_windows


@dataclass(frozen=True)
class LandUse:
    """Result tables, all keyed by ``parcel_id``."""

    zones: DataFrame
    class_pixels: DataFrame
    regions: DataFrame
    statistics: DataFrame
    totals: DataFrame
    status: DataFrame
    rejected_scenes: DataFrame


def parcel_status(bands: DataFrame, grids: DataFrame, min_scenes: int = K.MIN_SCENES_ZONING) -> DataFrame:
    """Scenes per parcel, and why a parcel is not mapped."""
    seen = bands.groupBy("parcel_id", "scene_id").agg(F.count(F.lit(1)).alias("n"))
    counted = seen.groupBy("parcel_id").agg(F.count(F.lit(1)).alias("scenes_used"))
    reason = F.when(F.col("scenes_used").isNull() | (F.col("scenes_used") < min_scenes), F.lit("few_scenes"))
    return (grids.select("parcel_id").join(counted, "parcel_id", "left").withColumn("reason", reason)
            .select("parcel_id", F.coalesce("scenes_used", F.lit(0)).alias("scenes_used"), "reason"))


def classify_zones(zone_profiles: DataFrame, curves: DataFrame, overrides: dict[str, float] | None = None) -> DataFrame:
    """Class and confidence of every zone of every parcel in one plan."""
    profiles, column = zone_profiles, None
    if overrides:
        column = "overrides"
        pairs = [F.lit(v) for item in overrides.items() for v in (item[0], str(item[1]))]
        profiles = profiles.withColumn(column, F.create_map(*pairs))
    classified = rules.classify(profiles, column)
    return ranking.arbitrate_zone(ranking.rank_curves(fill_profile(classified), curves))


def map_land_use(bands: DataFrame, grids: DataFrame, curves: DataFrame, rgb: DataFrame | None = None,
                 min_area_ha: float = 2.0, zones: int | None = None, rounds: int = 25,
                 overrides: dict[str, float] | None = None, clip: bool = False,
                 max_regions: int | None = None, cell: float | None = None) -> LandUse:
    """The whole zoning for all parcels at once.

    ``bands`` are property pixels with raw band values, ``grids`` comes from
    ``grid_for_parcel``.  With ``rgb`` the corn mask follows visible edges.
    ``clip`` keeps sieved classes inside their original pixels, and outlines of
    neighbouring classes then share their borders; without it hole filling may let
    classes overlap.  ``cell`` is the size of the pixels in metres where they are not
    on the cells of ``grids`` yet: parcels with a coarser grid are then averaged.
    """
    spark = bands.sparkSession
    if cell is not None:
        bands = pixels.on_grid(bands, grids, cell)
    rejects = cut_lineage(unusable_windows(bands))
    property_cells = bands.select("parcel_id", "px", "py")
    bands = without_windows(bands, rejects)
    scenes = cut_lineage(parcel_status(bands, grids))
    # parcels that cannot be mapped are listed in ``status`` and leave here
    ready = grids.join(scenes.where(F.col("reason").isNull()).select("parcel_id"), "parcel_id", "left_semi")
    composite = pixels.monthly_composite(pixels.valid_pixels(bands))
    zoned = zoning.segment(zoning.pixel_matrix(composite, ready, zones), rounds)
    zone_classes = cut_lineage(classify_zones(zoning.zone_profiles(zoned), curves, overrides)
                               .select("parcel_id", "zone_id", "n_px", "class", "confidence", "best", "margin",
                                       "zone_mean", "warp_override", "zone_class", "zone_confidence"))
    named = cut_lineage(zoning.class_pixels(zoned, zone_classes).select("parcel_id", "px", "py", "class"))

    refinement = scenes.select("parcel_id", F.lit("off").alias("method"))
    if rgb is not None:
        corn = named.where(F.col("class") == K.CORN)
        refined, report = superpixels.refine(corn, named, rgb)
        named = cut_lineage(zoning.corn_takes_precedence(named, refined))
        refinement = scenes.select("parcel_id").join(report.select("parcel_id", "method"), "parcel_id", "left")

    runs = cut_lineage(regions.row_runs(named))
    cleaned = regions.sieve(runs, ready, min_area_ha)
    if clip:
        cleaned = regions.clip_runs(cleaned, named)
    labelled = regions.label_regions(cleaned)
    table = cut_lineage(outline.region_table(labelled, land_use_classes(spark), ready, min_area_ha))
    listed = regions.top_regions(table, max_regions)
    shown = labelled.join(listed.select("parcel_id", "class", "region_id"), ["parcel_id", "class", "region_id"], "left_semi")
    outlines = outline.outline_regions(shown, ready, shared=clip)
    statistics = outline.class_statistics(labelled, table, ready, named)
    property_px = property_cells.groupBy("parcel_id", "px", "py").agg(F.count(F.lit(1)).alias("n")).groupBy(
        "parcel_id").agg(F.count(F.lit(1)).alias("n_px"))
    return LandUse(
        zones=zone_classes,
        class_pixels=named,
        regions=listed.join(outlines, ["parcel_id", "class", "region_id"]),
        statistics=statistics,
        totals=outline.parcel_totals(property_px, statistics, ready),
        status=scenes.join(refinement, "parcel_id", "left"),
        rejected_scenes=rejects,
    )
