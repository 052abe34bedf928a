"""Region polygons, tables of regions and their areas.

Rings come from ``arcs``; ``stitch`` and ``simplify`` do the same for the segments of
one small outline.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyflow import constants as K
from canopyflow.functions.numbers import half_up
from canopyflow.operators import arcs
from canopyflow.operators.regions import MASK, region_sizes

TOLERANCE_DEG = 0.0001


def stitch(starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Closed rings of corner points from directed segments.

    Where two rings touch in a corner the right turn is taken, which keeps to
    the same cell and leaves diagonal neighbours apart.
    """
    leaving: dict[tuple[int, int], list[int]] = {}
    for i, point in enumerate(map(tuple, starts)):
        leaving.setdefault(point, []).append(i)
    direction = np.sign(ends - starts)
    unused = set(range(len(starts)))
    rings = []
    for first in range(len(starts)):
        if first not in unused:
            continue
        ring, current = [], first
        while True:
            unused.discard(current)
            ring.append(starts[current])
            options = [i for i in leaving[tuple(ends[current])] if i in unused or i == first]
            dx, dy = direction[current]
            right = (-dy, dx)  # y grows downwards
            following = next((i for i in options if tuple(direction[i]) == right), None)
            current = options[0] if following is None else following
            if current == first:
                break
        points = np.array(ring)
        before, after = np.roll(points, 1, axis=0), np.roll(points, -1, axis=0)
        turn = ((points - before)[:, 0] * (after - points)[:, 1] - (points - before)[:, 1] * (after - points)[:, 0]) != 0
        corners = points[turn]
        rings.append(np.vstack([corners, corners[:1]]))
    return rings


def simplify(line: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker on a closed ring; at least a triangle is kept."""
    far = int(np.argmax(((line - line[0]) ** 2).sum(axis=1)))
    keep = np.zeros(len(line), dtype=bool)
    keep[[0, far, len(line) - 1]] = True
    stack = [(0, far), (far, len(line) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        chord = line[b] - line[a]
        length = np.hypot(*chord)
        gaps = line[a + 1:b] - line[a]
        dist = (np.abs(gaps[:, 0] * chord[1] - gaps[:, 1] * chord[0]) / length if length
                else np.hypot(gaps[:, 0], gaps[:, 1]))
        worst = int(np.argmax(dist))
        if dist[worst] > tolerance:
            keep[a + 1 + worst] = True
            stack += [(a, a + 1 + worst), (a + 1 + worst, b)]
    slim = line[keep]
    return slim if len(slim) >= 4 else line


def outline_regions(labelled: DataFrame, grids: DataFrame, keys: Sequence[str] = tuple(MASK),
                    tolerance: float = TOLERANCE_DEG, digits: int = 6, shared: bool = False) -> DataFrame:
    """Rings (outer ring first) in lon/lat for every labelled region.

    ``grids`` gives per parcel the upper-left corner ``(origin_x, origin_y)``,
    ``res``, the grid ``zone`` and ``south``.  With ``shared``, regions of all keys of
    a parcel take part in one map and keep common borders; they must not overlap
    then.  Otherwise each of the ``keys`` is a map of its own.
    """
    keys = list(keys)
    layer = keys[:1] if shared else keys
    region = [c for c in keys if c not in layer] + ["region_id"]
    return arcs.outlined(labelled, grids, layer, region, tolerance, digits).drop("ring_cells")


def _hectares(pixels: Column) -> Column:
    return pixels * F.col("res") * F.col("res") / F.lit(10_000.0)


def region_table(labelled: DataFrame, classes: DataFrame, grids: DataFrame, min_area_ha: float) -> DataFrame:
    """Regions with area, label and colour; those under the minimum area are left out.

    ``classes`` is the fixed class dimension (seven rows), so it is broadcast;
    an unknown class takes label and colour of the last one.
    """
    other = next(row for row in K.LAND_USE_CLASSES if row[0] == K.OTHER)
    return (region_sizes(labelled).join(grids.select("parcel_id", "res"), "parcel_id")
            .withColumn("exact_ha", _hectares(F.col("n_px"))).where(F.col("exact_ha") >= min_area_ha)
            .join(F.broadcast(classes), "class", "left")
            .withColumns({"label": F.coalesce("label", F.lit(other[1])),
                          "colour": F.coalesce("colour", F.lit(other[2])),
                          "class_ord": F.coalesce("class_ord", F.lit(len(K.LAND_USE_CLASSES))),
                          "area_ha": half_up("exact_ha", 1)})
            .drop("exact_ha", "res"))


def class_statistics(cleaned: DataFrame, regions: DataFrame, grids: DataFrame, present: DataFrame | None = None) -> DataFrame:
    """Area per class from the cleaned pixels and its number of polygons.

    With ``present(parcel_id, class)``, classes that lost all their pixels in cleaning
    are listed with an area of 0.
    """
    area = cleaned.groupBy("parcel_id", "class").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("n_px"))
    if present is not None:
        area = (present.select("parcel_id", "class").distinct().join(area, ["parcel_id", "class"], "full")
                .withColumn("n_px", F.coalesce("n_px", F.lit(0).cast("bigint"))))
    area = (area.join(grids.select("parcel_id", "res"), "parcel_id")
            .withColumn("area_ha", half_up(_hectares(F.col("n_px")), 1)).drop("res"))
    polygons = regions.groupBy("parcel_id", "class").agg(F.count(F.lit(1)).alias("n_polygons"))
    return (area.join(polygons, ["parcel_id", "class"], "left")
            .withColumn("n_polygons", F.coalesce("n_polygons", F.lit(0))))


def parcel_totals(property_px: DataFrame, statistics: DataFrame, grids: DataFrame) -> DataFrame:
    """Total area, corn area and share, and region count per parcel."""
    by_parcel = statistics.groupBy("parcel_id").agg(
        F.coalesce(F.sum(F.when(F.col("class") == K.CORN, F.col("area_ha"))), F.lit(0.0)).alias("corn_ha"),
        F.sum("n_polygons").alias("n_regions"))
    corn, exact = F.coalesce("corn_ha", F.lit(0.0)), _hectares(F.col("n_px"))
    return (property_px.join(grids.select("parcel_id", "res"), "parcel_id").join(by_parcel, "parcel_id", "left")
            .select("parcel_id", "n_px", half_up(exact, 1).alias("total_ha"), corn.alias("corn_ha"),
                    F.when(exact > 0, half_up(F.lit(100.0) * corn / exact, 1)).otherwise(0.0).alias("corn_pct"),
                    F.coalesce("n_regions", F.lit(0)).alias("n_regions")))
