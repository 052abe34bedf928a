"""Region outlines from shared arcs, so that neighbours keep the same border.

A raster is cut into square tiles.  Inside a tile, the sides between cells of
different regions are followed from node to node; a node is a corner where more
than two sides meet, or where an arc passes into the next tile.  Each arc is
simplified once and handed to the regions on both of its sides, forwards to one
and backwards to the other.  Rings are then put together from arcs.

A chord replaces part of an arc only if no other corner of an outline lies
between both, so arcs of a tile never cross.  A task holds one tile, or the arcs
of one region, which are no more than its result; grids may have any size.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyflow.functions.geodesy import unproject

TILE = 256
#: Steps right, down, left and up; rows count downwards.
STEPS = ((1, 0), (0, 1), (-1, 0), (0, -1))
RINGS_TYPE = "array<array<array<double>>>"
_RINGS = pa.list_(pa.list_(pa.list_(pa.float64())))


def tile_labels(code: np.ndarray, row: np.ndarray, x0: np.ndarray, x1: np.ndarray, tile: int) -> np.ndarray:
    """Labels of a tile, with their frame, from runs counted from its upper left; cells
    beyond all runs are left out, as they have no sides."""
    size = int(min(tile, max(1, row.max() + 2, x1.max() + 2)))
    labels = np.full((size + 2, size + 2), -1, np.int64)
    for c, y, a, b in zip(code, row + 1, x0 + 1, x1 + 1):
        if 0 <= y < size + 2:
            labels[y, max(0, a):max(0, b + 1)] = c
    return labels


def trace(labels: np.ndarray):
    """Arcs of one tile as ``(corners, steps, right, left)``.

    ``labels`` has a frame of one cell round the tile, -1 where no region is.  The
    tile has the upper and left sides of its own cells.  ``corners`` are the two
    ends and all turns in between, ``steps`` the first and last direction.
    """
    size = labels.shape[0] - 2
    up_left, up_right, down_left, down_right = labels[:-1, :-1], labels[:-1, 1:], labels[1:, :-1], labels[1:, 1:]
    sides = np.stack([up_right != down_right, down_left != down_right, up_left != down_left, up_left != up_right])
    degree = sides.sum(0)
    ys, xs = np.mgrid[:size + 1, :size + 1]
    inside = np.stack([(xs < size) & (ys < size), (xs < size) & (ys < size), (xs > 0) & (ys < size), (xs < size) & (ys > 0)])
    own = sides & inside
    node = (degree != 2) | (own.sum(0) == 1)
    right_of, left_of = (down_right, down_left, up_left, up_right), (up_right, down_right, down_left, up_left)

    def follow(x: int, y: int, step: int):
        corners, first = [(x, y)], step
        right, left = int(right_of[step][y, x]), int(left_of[step][y, x])
        start = (x, y)
        while True:
            own[step, y, x] = False
            x, y = x + STEPS[step][0], y + STEPS[step][1]
            own[(step + 2) % 4, y, x] = False
            if node[y, x] or (x, y) == start:
                return np.array([*corners, (x, y)], np.int64), (first, step), right, left
            onward = next(s for s in range(4) if s != (step + 2) % 4 and sides[s, y, x])
            if onward != step:
                corners.append((x, y))
                step = onward

    arcs = []
    for y, x in np.argwhere(node & own.any(0)).tolist():
        arcs += [follow(x, y, step) for step in range(4) if own[step, y, x]]
    for y, x in np.argwhere(own[0]).tolist():  # closed arcs without a node, from their upper left
        if own[0, y, x]:
            arcs.append(follow(x, y, 0))
    return arcs, np.argwhere(degree > 0)[:, ::-1]


def _on_path(path: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Which points lie on an axis-parallel path."""
    a, b = path[:-1, None], path[1:, None]
    return ((points >= np.minimum(a, b)) & (points <= np.maximum(a, b))).all(2).any(0)


def _between(path: np.ndarray, points: np.ndarray) -> bool:
    """Whether a point lies inside the path closed by its chord, or on the chord."""
    box = ((points >= path.min(0)) & (points <= path.max(0))).all(1)
    points = points[box]
    points = points[~_on_path(path, points)]
    if not len(points):
        return False
    chord = path[-1] - path[0]
    gap = points - path[0]
    along = gap @ chord
    on = (chord[0] * gap[:, 1] == chord[1] * gap[:, 0]) & (along >= 0) & (along <= chord @ chord)
    a, b = path[:, None].astype(float), np.roll(path, -1, axis=0)[:, None].astype(float)
    x, y = points[:, 0], points[:, 1]
    with np.errstate(divide="ignore", invalid="ignore"):
        at = (b[..., 0] - a[..., 0]) * (y - a[..., 1]) / (b[..., 1] - a[..., 1]) + a[..., 0]
    odd = (((a[..., 1] > y) != (b[..., 1] > y)) & (x < at)).sum(0) % 2 == 1
    return bool((on | odd).any())


def simplified(corners: np.ndarray, line: np.ndarray, tolerance: float, others: np.ndarray, keep_bent: bool) -> np.ndarray:
    """Positions of the corners that stay.

    ``line`` holds the corners in the unit of ``tolerance``, ``others`` all corners of
    the tile.  ``keep_bent`` leaves at least one corner between the ends.
    """
    last = len(corners) - 1
    keep = {0, last}
    closed = last > 0 and (corners[0] == corners[-1]).all()
    if closed:
        keep.add(int(np.argmax(((line - line[0]) ** 2).sum(1))))
    ends = sorted(keep)
    stack = list(zip(ends[:-1], ends[1:]))
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        chord, gap = line[b] - line[a], line[a + 1:b] - line[a]
        length = np.hypot(*chord)
        far = np.abs(gap[:, 0] * chord[1] - gap[:, 1] * chord[0]) / length if length else np.hypot(gap[:, 0], gap[:, 1])
        worst = a + 1 + int(np.argmax(far))
        bare = keep_bent and (a, b) == (0, last)
        if bare or far[worst - a - 1] > tolerance or _between(corners[a:b + 1], others):
            keep.add(worst)
            stack += [(a, worst), (worst, b)]
    if closed and len(keep) < 4:
        return np.arange(last + 1)
    return np.array(sorted(keep))


def tile_arcs(labelled: DataFrame, grids: DataFrame, layer: Sequence[str], region: Sequence[str],
              tolerance: float | None, digits: int = 6, tile: int = TILE) -> DataFrame:
    """Simplified arcs, a row for the region on each side, which lies on the right.

    ``labelled`` are runs of regions that do not overlap inside a ``layer``.  Points
    are in degrees, or with ``tolerance=None`` all corners in cells from the origin.
    """
    columns = ["origin_x", "origin_y", "res", "zone", "south"]
    reach = lambda low, high: F.sequence(F.greatest(F.lit(0), F.floor(low / tile)), F.floor(high / tile))
    dealt = (labelled.select(*layer, *region, "py", "x0", "x1")
             .withColumn("ty", F.explode(reach(F.col("py") - 1, F.col("py") + 1)))
             .withColumn("tx", F.explode(reach(F.col("x0") - 1, F.col("x1") + 1)))
             .join(grids.select("parcel_id", *columns), "parcel_id"))
    kinds = {f.name: f.dataType.simpleString() for f in labelled.schema}
    schema = (", ".join(f"`{c}` {kinds[c]}" for c in (*layer, *region))
              + f", ax long, ay long, bx long, by long, first int, last int, cross long, points {RINGS_TYPE[6:-1]}")

    def traced(group: pd.DataFrame) -> pd.DataFrame:
        top = group.iloc[0]
        x, y = int(top.tx) * tile, int(top.ty) * tile
        code, names = pd.factorize(pd.MultiIndex.from_frame(group[list(region)]), sort=True)
        arcs, others = trace(tile_labels(code, (group.py - y).to_numpy(), (group.x0 - x).to_numpy(), (group.x1 - x).to_numpy(), tile))
        pairs = Counter(frozenset(map(tuple, corners[[0, -1]].tolist())) for corners, *_ in arcs)
        out = []
        for corners, (first, last), right, left in arcs:
            places = corners + (x, y)
            if tolerance is None:
                points = places.astype(float)
            else:
                ends = corners[[0, -1]]
                rim = ((ends % tile == 0).any(1)).all()
                lon, lat = unproject(top.origin_x + places[:, 0] * top.res, top.origin_y - places[:, 1] * top.res, int(top.zone), bool(top.south))
                line = np.column_stack([lon, lat])
                bent = bool(rim) or pairs[frozenset(map(tuple, ends.tolist()))] > 1
                points = np.round(line[simplified(corners, line, tolerance, others, bent)], digits)
            cross = int((places[:-1, 0] * places[1:, 1] - places[1:, 0] * places[:-1, 1]).sum())
            (ax, ay), (bx, by) = places[0].tolist(), places[-1].tolist()
            if right >= 0:
                out.append([*(top[c] for c in layer), *names[right], ax, ay, bx, by, first, last, cross, points.tolist()])
            if left >= 0:
                out.append([*(top[c] for c in layer), *names[left], bx, by, ax, ay, (last + 2) % 4, (first + 2) % 4, -cross, points[::-1].tolist()])
        return pd.DataFrame(out, columns=[*layer, *region, "ax", "ay", "bx", "by", "first", "last", "cross", "points"])

    return dealt.groupBy(*layer, "ty", "tx").applyInPandas(traced, schema)


def rings_of(arcs: Sequence[tuple]) -> list[tuple[list, int]]:
    """Closed rings, with their signed areas in cells, from directed arcs
    ``(start, end, first, last, cross, points)``; where two rings meet in a corner
    the right turn is taken, which keeps to the same cell."""
    leaving = defaultdict(list)
    for i, arc in enumerate(arcs):
        leaving[arc[0]].append(i)
    unused, rings = set(range(len(arcs))), []
    for begin in range(len(arcs)):
        if begin not in unused:
            continue
        points, cross, current = [], 0, begin
        while current in unused:
            unused.discard(current)
            _, end, _, last, part, own = arcs[current]
            points += own[:-1]
            cross += part
            options = [i for i in leaving[end] if i in unused or i == begin]
            current = next((i for i in options if arcs[i][2] == (last + 1) % 4), options[0])
        rings.append((points + points[:1], cross // 2))
    return rings


def outlined(labelled: DataFrame, grids: DataFrame, layer: Sequence[str], region: Sequence[str],
             tolerance: float | None, digits: int = 6, tile: int = TILE) -> DataFrame:
    """``layer, region, rings, ring_cells``: rings of each region, outer ring first, and
    their exact areas in cells (holes are negative)."""
    arcs = tile_arcs(labelled, grids, layer, region, tolerance, digits, tile)
    kinds = {f.name: f.dataType.simpleString() for f in arcs.schema}
    keys = [*layer, *region]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keys) + f", rings {RINGS_TYPE}, ring_cells array<long>"

    parts = F.struct("ay", "ax", "first", "by", "bx", "last", "cross", "points")

    # a row is a region; a call of its own for each would cost more than its arcs
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rings, cells = [], []
            for listed in batch["arcs"]:
                found = rings_of([((a["ax"], a["ay"]), (a["bx"], a["by"]), a["first"], a["last"], a["cross"], a["points"])
                                  for a in listed.as_py()])
                found.sort(key=lambda r: (-r[1], r[0]))
                rings.append([r for r, _ in found])
                cells.append([int(a) for _, a in found])
            kept = [batch[c] for c in keys]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(rings, _RINGS), pa.array(cells, pa.list_(pa.int64()))],
                                             [*keys, "rings", "ring_cells"])

    regions = arcs.groupBy(*keys).agg(F.sort_array(F.collect_list(parts)).alias("arcs"))
    return regions.select(*keys, "arcs").mapInArrow(joined, schema)
