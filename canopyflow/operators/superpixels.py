"""Superpixels that follow visible edges, and the majority vote on them.

Each segment keeps the grid cell it started in as its home.  A pixel considers
the segments at home in its own and the eight surrounding cells, so a cell meets
at most nine candidates.  Pixels are laid out by cell once; per round only the
segment centres travel.  Positions and colours of centres are integers in 1/64
units, which makes every comparison exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyflow.operators.fragments import connected_segments
from canopyflow.session import cut_lineage, lay_out

UNIT = 64
MIN_STRETCH_CELLS = 100
CELL = ["parcel_id", "cx", "cy"]


def stretch_bands(bands: DataFrame, keys: tuple[str, ...] = ("parcel_id", "band"),
                  low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Stretch ``value`` between two percentiles of the positive cells to 0..255.

    Values are sensor codes, so counting equal values first leaves at most 65 536
    rows per band whatever its size.  Bands with few cells become zero.
    """
    counts = bands.where(F.col("value") > 0).groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))
    limits = counts.groupBy(*keys).agg(
        F.percentile("value", F.array(F.lit(low), F.lit(high)), F.col("n")).alias("p"), F.sum("n").alias("cells"))
    joined = bands.join(limits, list(keys), "left")
    lo, hi = F.col("p")[0], F.col("p")[1]
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("value") - lo) / F.greatest(hi - lo, F.lit(1e-6))))
    usable = F.coalesce(F.col("cells") >= MIN_STRETCH_CELLS, F.lit(False))
    return joined.withColumn("stretched", F.when(usable, F.floor(share * 255).cast("int")).otherwise(0)).drop("p", "cells")


def segment_count(mask_pixels: Column, pixels_per_segment: int = 40, fewest: int = 60, most: int | None = None) -> Column:
    """Segments of a parcel: as many as its mask has room for, at least ``fewest``."""
    wanted = F.greatest(F.lit(fewest), F.floor(mask_pixels / pixels_per_segment))
    return wanted if most is None else F.least(F.lit(most), wanted)


def superpixels(rgb: DataFrame, mask: DataFrame, compactness: float = 10.0, rounds: int = 5,
                pixels_per_segment: int = 40, fewest: int = 60, most: int | None = None) -> DataFrame:
    """Pixels of ``rgb(parcel_id, px, py, r, g, b)`` with ``segment_id``.

    The number of segments per parcel follows its ``mask(parcel_id, px, py)``.
    Pixels without any colour belong to no segment.  Segments may be torn;
    ``connected_segments`` mends that.
    """
    valid = rgb.where(F.col("r") + F.col("g") + F.col("b") > 0)
    sizes = (valid.groupBy("parcel_id").agg(F.count(F.lit(1)).alias("n_valid"))
             .join(mask.groupBy("parcel_id").agg(F.count(F.lit(1)).alias("n_mask")), "parcel_id", "left"))
    step = F.greatest(F.lit(1), F.ceil(F.sqrt(F.col("n_valid") / segment_count(
        F.coalesce("n_mask", F.lit(0)), pixels_per_segment, fewest, most))))
    placed = valid.join(sizes.select("parcel_id", step.cast("bigint").alias("step")), "parcel_id")
    placed = lay_out(placed.withColumns({"cx": F.floor(F.col("px") / F.col("step")),
                                         "cy": F.floor(F.col("py") / F.col("step"))}), *CELL)
    values = ("px", "py", "r", "g", "b")

    def centres_of(pixels: DataFrame, home: tuple[str, str]) -> DataFrame:
        means = [F.floor(F.sum(v) * UNIT / F.count(F.lit(1)) + 0.5).cast("bigint").alias(f"c_{v}") for v in values]
        return pixels.groupBy("parcel_id", F.col(home[0]).alias("hx"), F.col(home[1]).alias("hy")).agg(*means)

    weight = int(round(compactness * compactness))
    centres = cut_lineage(centres_of(placed, ("cx", "cy")))
    for _ in range(rounds):
        centres = cut_lineage(centres_of(_nearest(placed, centres, weight), ("hx", "hy")))
    labelled = _nearest(placed, centres, weight)
    return labelled.select("parcel_id", "px", "py", (F.col("hy") * F.lit(1 << 20) + F.col("hx")).alias("segment_id"))


def _nearest(placed: DataFrame, centres: DataFrame, weight: int) -> DataFrame:
    around = F.sequence(F.lit(-1), F.lit(1))
    listed = (centres.withColumn("dx", F.explode(around)).withColumn("dy", F.explode(around))
              .withColumns({"cx": F.col("hx") + F.col("dx"), "cy": F.col("hy") + F.col("dy")})
              .groupBy(*CELL).agg(F.collect_list(F.struct("hy", "hx", "c_px", "c_py", "c_r", "c_g", "c_b")).alias("near")))

    def square(centre: str, value: str) -> str:
        return f"(c.{centre} - {UNIT} * {value}) * (c.{centre} - {UNIT} * {value})"

    colour = " + ".join(square(f"c_{v}", v) for v in "rgb")
    place = " + ".join(square(f"c_{v}", v) for v in ("px", "py"))
    best = F.expr(f"array_min(transform(near, c -> named_struct('d', step * step * ({colour}) + {weight} * ({place}), "
                  "'hy', c.hy, 'hx', c.hx)))")
    return (placed.join(listed, CELL).withColumn("best", best).drop("near")
            .withColumns({"hx": F.col("best.hx"), "hy": F.col("best.hy")}).drop("best"))


def vote(segments: DataFrame, mask: DataFrame, allowed: DataFrame) -> DataFrame:
    """Cells of segments of which at least half is masked, within ``allowed`` cells.

    All inputs carry ``(parcel_id, px, py)``.  Votes are counted map-side per
    segment; the winners go back by a join on the segment.
    """
    cell = ["parcel_id", "px", "py"]
    inside = segments.join(allowed.select(*cell), cell, "left_semi")
    marked = inside.join(mask.select(*cell, F.lit(1).alias("hit")), cell, "left")
    winners = (marked.groupBy("parcel_id", "segment_id")
               .agg(F.count("hit").alias("hits"), F.count(F.lit(1)).alias("n"))
               .where(F.col("hits") * 2 >= F.col("n")).select("parcel_id", "segment_id"))
    return inside.join(winners, ["parcel_id", "segment_id"], "left_semi").select(*cell)


def refine(mask: DataFrame, allowed: DataFrame, rgb: DataFrame, compactness: float = 10.0,
           rounds: int = 5) -> tuple[DataFrame, DataFrame]:
    """``(refined mask, status per parcel)`` by a vote of connected segments; parcels
    without colour keep their mask."""
    segments = lay_out(connected_segments(superpixels(rgb, mask, compactness, rounds)), "parcel_id", "px", "py")
    refined = vote(segments, mask, allowed)
    counts = segments.groupBy("parcel_id").agg(F.count_distinct("segment_id").alias("n_segments"))
    parcels = mask.select("parcel_id").distinct()
    status = parcels.join(counts, "parcel_id", "left").withColumns({
        "method": F.when(F.col("n_segments").isNull(), "off").otherwise("slic"),
        "reason": F.when(F.col("n_segments").isNull(), "no reference colour")})
    kept = mask.select("parcel_id", "px", "py").join(
        status.where(F.col("method") == "off").select("parcel_id"), "parcel_id", "left_semi")
    return refined.unionByName(kept), status
