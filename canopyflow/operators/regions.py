"""Raster regions as row runs: labelling, sieving, halos and outline edges.

A mask is held as horizontal runs ``(keys, py, x0, x1)``; a raster row holds at most
half as many runs as the grid is wide.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopyflow.operators.components import connected_components, contracted
from canopyflow.operators.skew import skew_join
from canopyflow.session import cut_lineage

MASK = ["parcel_id", "class"]
# cell numbers stay unique inside a grid whatever its width
ROW_STRIDE = 1 << 20
#: Rows whose runs are linked inside a task before the rounds begin.
ROW_BLOCK = 64


def cell_number(x: Column | str, y: Column | str) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    y = F.col(y) if isinstance(y, str) else y
    return (y * F.lit(ROW_STRIDE) + x).cast("bigint")


def row_runs(cells: DataFrame, keys: Sequence[str] = tuple(MASK)) -> DataFrame:
    """Maximal horizontal runs of a set of cells."""
    row = Window.partitionBy(*keys, "py").orderBy("px")
    return (cells.select(*keys, "px", "py")
            .withColumn("island", F.col("px") - F.row_number().over(row))
            .groupBy(*keys, "py", "island").agg(F.min("px").alias("x0"), F.max("px").alias("x1"))
            .drop("island"))


def run_cells(runs: DataFrame, keys: Sequence[str] = tuple(MASK)) -> DataFrame:
    return runs.select(*keys, F.explode(F.sequence("x0", "x1")).alias("px"), "py")


def _merge_runs(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join runs of one row that touch."""
    row = Window.partitionBy(*keys, "py").orderBy("x0")
    starts = (F.col("x0") > F.lag("x1").over(row) + 1) | F.lag("x1").over(row).isNull()
    return (runs.withColumn("starts", starts.cast("int"))
            .withColumn("island", F.sum("starts").over(row.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy(*keys, "py", "island").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))
            .drop("island"))


def _row_spans(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    return runs.groupBy(*keys, "py").agg(F.sort_array(F.collect_list(F.struct("x0", "x1"))).alias("spans"))


def _gaps(first: str, last: str, spans: str) -> Column:
    """Parts of ``[first, last]`` that the sorted ``spans`` leave open."""
    return F.expr(f"""
        filter(zip_with(concat(array({first}), transform({spans}, s -> s.x1 + 1)),
                        concat(transform({spans}, s -> s.x0 - 1), array({last})),
                        (a, b) -> named_struct('x0', greatest(a, {first}), 'x1', least(b, {last}))),
               g -> g.x0 <= g.x1)""")


def full_grid_runs(runs: DataFrame, grids: DataFrame, keys: Sequence[str] = tuple(MASK)) -> DataFrame:
    """Runs of both mask values over the whole grid ``grids(parcel_id, width, height)``."""
    masks = runs.select(*keys).distinct().join(grids.select("parcel_id", "width", "height"), "parcel_id")
    rows = masks.select(*keys, (F.col("width") - 1).cast("bigint").alias("last_x"),
                        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("height").cast("bigint") - 1)).alias("py"))
    spans = rows.join(_row_spans(runs, keys), [*keys, "py"], "left").withColumn(
        "spans", F.coalesce("spans", F.expr("CAST(array() AS array<struct<x0:bigint,x1:bigint>>)")))
    ones = F.transform("spans", lambda s: F.struct(s["x0"].alias("x0"), s["x1"].alias("x1"), F.lit(1).alias("value")))
    zeros = F.transform(_gaps("0L", "last_x", "spans"),
                        lambda s: F.struct(s["x0"].alias("x0"), s["x1"].alias("x1"), F.lit(0).alias("value")))
    return spans.select(*keys, "py", F.inline(F.concat(ones, zeros)))


def _touching(runs: DataFrame, keys: Sequence[str], diagonal: bool, cols: Sequence[str]) -> DataFrame:
    """Pairs of runs in adjacent rows that share a side (or corner)."""
    reach = 1 if diagonal else 0
    upper = runs.select(*keys, F.col("py"), *[F.col(c).alias(f"{c}_a") for c in ("x0", "x1", *cols)])
    lower = runs.select(*keys, (F.col("py") - 1).alias("py"), *[F.col(c).alias(f"{c}_b") for c in ("x0", "x1", *cols)])
    meet = (F.col("x0_a") <= F.col("x1_b") + reach) & (F.col("x0_b") <= F.col("x1_a") + reach)
    return upper.join(lower.hint("merge"), [*keys, "py"]).where(meet)


def label_regions(runs: DataFrame, keys: Sequence[str] = tuple(MASK), diagonal: bool = False) -> DataFrame:
    """Runs with ``region_id``, the smallest cell number of their connected region."""
    valued = runs if "value" in runs.columns else runs.withColumn("value", F.lit(1))
    # runs are read several times, so they are written once
    numbered = cut_lineage(valued.withColumn("node", cell_number("x0", "py")))
    pairs = _touching(numbered, keys, diagonal, ["node", "value"]).where(F.col("value_a") == F.col("value_b"))
    block = F.floor(F.col("py") / ROW_BLOCK).alias("block")
    edges = (pairs.select(*keys, block, F.col("node_a").alias("a"), F.col("node_b").alias("b"))
             .repartition(*keys, "block").sortWithinPartitions(*keys, "block"))
    labelled = connected_components(numbered, contracted(edges, keys), keys).withColumnRenamed("label", "region_id").drop("node")
    return labelled if "value" in runs.columns else labelled.drop("value")


def region_sizes(labelled: DataFrame, keys: Sequence[str] = tuple(MASK)) -> DataFrame:
    extra = [F.first("value").alias("value")] if "value" in labelled.columns else []
    return labelled.groupBy(*keys, "region_id").agg(
        F.sum(F.col("x1") - F.col("x0") + 1).alias("n_px"), *extra)


def sieve(runs: DataFrame, grids: DataFrame, min_area_ha: float, keys: Sequence[str] = tuple(MASK)) -> DataFrame:
    """Mask runs after small regions of either value took over their largest neighbour's value.

    A small region whose largest neighbour is small too follows that neighbour's
    own choice.  Two small regions that point at each other stay as they are;
    longer cycles cannot occur because neighbours are compared by (size, id).
    """
    keys = list(keys)
    limits = grids.select("parcel_id", min_region_pixels(F.lit(min_area_ha), F.col("res")).alias("min_px"))
    node = [*keys, "region_id"]
    labelled = label_regions(full_grid_runs(runs, grids, keys), keys, diagonal=True)
    sizes = region_sizes(labelled, keys).join(limits, "parcel_id").withColumn("small", F.col("n_px") < F.col("min_px"))
    small = sizes.where("small")

    vertical = _touching(labelled, keys, True, ["region_id", "value"]).where(F.col("value_a") != F.col("value_b"))
    beside = labelled.select(*keys, "py", (F.col("x1") + 1).alias("x"), F.col("region_id").alias("region_id_a")).join(
        labelled.select(*keys, "py", F.col("x0").alias("x"), F.col("region_id").alias("region_id_b")).hint("merge"), [*keys, "py", "x"])
    pairs = (vertical.select(*keys, "region_id_a", "region_id_b")
             .unionByName(beside.select(*keys, "region_id_a", "region_id_b")))
    both = pairs.select(*keys, F.inline(F.array(
        F.struct(F.col("region_id_a").alias("region_id"), F.col("region_id_b").alias("other")),
        F.struct(F.col("region_id_b").alias("region_id"), F.col("region_id_a").alias("other"))))).distinct()
    around = both.join(small.select(*node).hint("merge"), node, "left_semi")
    # the background touches most specks, so its key is hot
    other_sizes = sizes.select(*keys, F.col("region_id").alias("other"), F.col("n_px").alias("other_px"), "small")
    ranked = skew_join(around, other_sizes, [*keys, "other"], spread=["region_id"])
    # same size: the smaller region id wins
    choice = ranked.groupBy(*node).agg(
        F.max(F.struct(F.col("other_px").alias("px"), (-F.col("other")).alias("neg"), "small")).alias("top"))
    target = cut_lineage(choice.select(*node, (-F.col("top.neg")).alias("target"), (~F.col("top.small")).alias("done")))

    # follow the choices: every round doubles the distance looked ahead
    mutual = target.alias("t").join(
        target.select(*keys, F.col("region_id").alias("target"), F.col("target").alias("back")).hint("merge"), [*keys, "target"], "left")
    target = cut_lineage(mutual.select(
        *node, F.when(F.col("back") == F.col("region_id"), F.col("region_id")).otherwise(F.col("target")).alias("target"),
        (F.col("done") | F.coalesce(F.col("back") == F.col("region_id"), F.lit(False))).alias("done")))
    while not target.where(~F.col("done")).isEmpty():
        ahead = target.select(*keys, F.col("region_id").alias("target"), F.col("target").alias("next"),
                              F.col("done").alias("next_done"))
        target = cut_lineage(target.join(ahead.hint("merge"), [*keys, "target"], "left").select(
            *node, F.when(F.col("done"), F.col("target")).otherwise(F.coalesce("next", "target")).alias("target"),
            (F.col("done") | F.coalesce("next_done", F.lit(True))).alias("done")))

    # only two values exist, so it is enough to know the value of the final region
    ends = target.join(sizes.select(*keys, F.col("region_id").alias("target"), F.col("value").alias("new_value")).hint("merge"),
                       [*keys, "target"])
    recoded = skew_join(labelled, ends.select(*node, "new_value"), node, spread=["py", "x0"], how="left")
    kept = recoded.where(F.coalesce("new_value", "value") == 1)
    return _merge_runs(kept.select(*keys, "py", "x0", "x1"), keys)


def clip_runs(runs: DataFrame, support: DataFrame, keys: Sequence[str] = tuple(MASK)) -> DataFrame:
    """Cells of ``runs`` that also belong to ``support(keys, px, py)``."""
    cells = run_cells(runs, keys).join(support.select(*keys, "px", "py"), [*keys, "px", "py"], "left_semi")
    return row_runs(cells, keys)


def halo(cells: DataFrame, steps: int = 3, keys: Sequence[str] = ("parcel_id",)) -> DataFrame:
    """Cells within ``steps`` four-neighbour moves of the mask, the mask included.

    Works on runs, widened per row, so a wide mask does not multiply cell by cell.
    """
    wide = row_runs(cells, keys).select(
        *keys, F.explode(F.sequence(F.lit(-steps), F.lit(steps))).alias("dy"), "py", "x0", "x1")
    reach = F.lit(steps) - F.abs("dy")
    moved = wide.select(*keys, (F.col("py") + F.col("dy")).alias("py"),
                        (F.col("x0") - reach).alias("x0"), (F.col("x1") + reach).alias("x1"))
    return run_cells(_union_runs(moved, keys), keys)


def _union_runs(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union of overlapping runs per row."""
    row = Window.partitionBy(*keys, "py").orderBy("x0", "x1").rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy(*keys, "py").orderBy("x0", "x1").rowsBetween(Window.unboundedPreceding, 0)
    furthest = F.max("x1").over(row)
    starts = furthest.isNull() | (F.col("x0") > furthest + 1)
    return (runs.withColumn("starts", starts.cast("int"))
            .withColumn("island", F.sum("starts").over(order))
            .groupBy(*keys, "py", "island").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))
            .drop("island"))


def combine_masks(core: DataFrame, grown: DataFrame, allowed: DataFrame,
                  keys: Sequence[str] = ("parcel_id",), steps: int = 3) -> DataFrame:
    """Core mask plus the part of ``grown`` inside its halo, limited to ``allowed`` cells."""
    cell = [*keys, "px", "py"]
    near = grown.select(*cell).intersect(halo(core, steps, keys).select(*cell))
    return core.select(*cell).union(near).distinct().join(allowed.select(*cell), cell, "left_semi")


def boundary_segments(labelled: DataFrame, keys: Sequence[str] = tuple(MASK)) -> DataFrame:
    """Directed outline segments per region, interior on the right hand going clockwise.

    Horizontal segments are the parts of a run its upper or lower row leaves
    open; every run also has one unit segment at each end.  Corner coordinates
    count cells from the upper left.
    """
    keys = list(keys)
    spans = _row_spans(labelled, keys)
    cols = [*keys, "region_id", "py", "x0", "x1"]

    def open_parts(shift: int) -> DataFrame:
        other = spans.select(*keys, (F.col("py") + shift).alias("py"), "spans")
        near = F.expr("filter(coalesce(spans, CAST(array() AS array<struct<x0:bigint,x1:bigint>>)), "
                      "s -> s.x1 >= x0 AND s.x0 <= x1)")
        return (labelled.select(*cols).join(other, [*keys, "py"], "left").withColumn("near", near)
                .select(*keys, "region_id", "py", F.inline(_gaps("x0", "x1", "near"))))

    def corners(xa, ya, xb, yb):
        return [F.expr(e).cast("bigint").alias(n) for e, n in ((xa, "xa"), (ya, "ya"), (xb, "xb"), (yb, "yb"))]

    top = open_parts(1).select(*keys, "region_id", *corners("x0", "py", "x1 + 1", "py"))
    bottom = open_parts(-1).select(*keys, "region_id", *corners("x1 + 1", "py + 1", "x0", "py + 1"))
    left = labelled.select(*keys, "region_id", *corners("x0", "py + 1", "x0", "py"))
    right = labelled.select(*keys, "region_id", *corners("x1 + 1", "py", "x1 + 1", "py + 1"))
    return top.unionByName(bottom).unionByName(left).unionByName(right)


def min_region_pixels(min_area_ha: Column, res: Column) -> Column:
    return F.greatest(F.lit(2).cast("bigint"), F.floor(min_area_ha * 10_000 / (res * res)).cast("bigint"))


def top_regions(regions: DataFrame, limit: int | None = None) -> DataFrame:
    """All regions, or at most ``limit`` per parcel: class order first, larger areas first.

    ``truncated`` tells parcels where the limit cut something off.  The rank is a
    top-n, so each task sends at most ``limit`` + 1 rows of a parcel onwards.
    """
    if limit is None:
        return regions.withColumn("truncated", F.lit(False))
    order = Window.partitionBy("parcel_id").orderBy("class_ord", F.desc("area_ha"), "region_id")
    ranked = regions.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= limit + 1)
    cut = F.max("rn").over(Window.partitionBy("parcel_id")) > limit
    return ranked.withColumn("truncated", cut).where(F.col("rn") <= limit)
