"""Polygons on a raster: the cells that a polygon touches, as row runs.

Every edge is listed once for each raster row it meets.  Its part inside the row
gives a range of touched cells, of which only the outermost are tested against
the edge itself; crossings of the row's middle line, taken in pairs, give the
cells inside.  The union of both is every cell that the polygon touches.  Cells
then meet runs by row and block of columns, so no cell looks at an edge.

Rings follow the even-odd rule: concave rings, holes and several parts need no
marking.  Lattice coordinates count cells from the origin; a polygon that only
meets a cell's border touches it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyflow.functions.geodesy import project_points

BLOCK = 256
#: Pairs of an edge and a row that a task looks at together.
STEP_ROWS = 500_000


def lattice_edges(polygons: DataFrame, keys: Sequence[str], origin_x: Column, origin_y: Column,
                  step_x: Column, step_y: Column, rings: str = "rings") -> DataFrame:
    """Edges ``(ua, va, ub, vb)`` in cells from the origin; a negative step counts downwards.

    Null polygons and rings of fewer than two points have no edges.
    """
    def place(p: Column) -> Column:
        return F.struct(((p[0] - origin_x) / step_x).alias("u"), ((p[1] - origin_y) / step_y).alias("v"))

    placed = F.transform(F.filter(rings, lambda r: F.size(r) >= 2), lambda r: F.transform(r, place))
    pairs = F.flatten(F.transform(placed, lambda r: F.arrays_zip(
        F.slice(r, 1, F.size(r) - 1).alias("a"), F.slice(r, 2, F.size(r) - 1).alias("b"))))
    edges = polygons.select(*keys, F.explode(pairs).alias("e"))
    return edges.select(*keys, *[F.col(f"e.{end}.{axis}").alias(f"{axis}{end}") for end in "ab" for axis in "uv"])


def edge_meets_cell(col: str, row: str) -> str:
    """SQL test of the edge ``(ua, va, ub, vb)`` against one closed cell: their boxes
    overlap and the corners are not all strictly on one side."""
    corners = ", ".join(f"(ub - ua) * (({row} + {dy}) - va) - (vb - va) * (({col} + {dx}) - ua)" for dx in (0, 1) for dy in (0, 1))
    return (f"(least(ua, ub) <= {col} + 1 AND greatest(ua, ub) >= {col} AND least(va, vb) <= {row} + 1 "
            f"AND greatest(va, vb) >= {row} AND least({corners}) <= 0 AND greatest({corners}) >= 0)")


def _meets(ua, va, ub, vb, col, row):
    """``edge_meets_cell`` for arrays."""
    corners = np.stack([(ub - ua) * ((row + dy) - va) - (vb - va) * ((col + dx) - ua) for dx in (0, 1) for dy in (0, 1)])
    return ((np.minimum(ua, ub) <= col + 1) & (np.maximum(ua, ub) >= col) & (np.minimum(va, vb) <= row + 1)
            & (np.maximum(va, vb) >= row) & (corners.min(0) <= 0) & (corners.max(0) >= 0))


def _edge_rows(ua, va, ub, vb, py):
    """For pairs of an edge and a raster row that it meets: touched cells ``x0..x1``, and
    the crossing of the row's middle line, NaN where there is none."""
    if not (np.isfinite(ua) & np.isfinite(ub)).all():
        raise ValueError("edges must have finite coordinates")
    level = va == vb
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        def at(line):
            part = (line - va) / (vb - va)
            return np.where(part <= 0, ua, np.where(part >= 1, ub, ua + (ub - ua) * part))

        ut, ul = np.where(level, ua, at(py)), np.where(level, ub, at(py + 1))
        middle = py + 0.5
        crossing = np.where((va > middle) != (vb > middle), (ub - ua) * (middle - va) / (vb - va) + ua, np.nan)
    c0, c1 = np.ceil(np.minimum(ut, ul) - 1).astype(np.int64), np.floor(np.maximum(ut, ul)).astype(np.int64)
    meets = lambda col: _meets(ua, va, ub, vb, col, py)
    x0 = np.where(meets(c0 - 1), c0 - 1, np.where(meets(c0), c0, c0 + 1))
    return x0, np.where(meets(c1 + 1), c1 + 1, np.where(meets(c1), c1, c1 - 1)), crossing


def _inside(unit, py, crossing):
    """Runs between crossings taken in pairs; a cell is inside when its middle has an odd
    number of crossings to the right."""
    known = ~np.isnan(crossing)
    unit, py, crossing = unit[known], py[known], crossing[known]
    order = np.lexsort((crossing, py, unit))
    unit, py, crossing = unit[order], py[order], crossing[order]
    place = np.arange(len(unit))
    head = np.r_[True, (unit[1:] != unit[:-1]) | (py[1:] != py[:-1])][:len(unit)]
    nth = place - np.maximum.accumulate(np.where(head, place, 0)) if len(place) else place
    first = np.flatnonzero((nth % 2 == 0) & ~np.r_[head[1:], np.ones(len(head[:1]), bool)])
    return unit[first], py[first], np.ceil(crossing[first] - 0.5).astype(np.int64), np.ceil(crossing[first + 1] - 0.5).astype(np.int64) - 1


def _united(unit, py, x0, x1):
    """Maximal runs of each unit and row."""
    some = x0 <= x1
    order = np.lexsort((x1[some], x0[some], py[some], unit[some]))
    unit, py, x0, x1 = (c[some][order] for c in (unit, py, x0, x1))
    if not len(unit):
        return unit, py, x0, x1
    head = np.r_[True, (unit[1:] != unit[:-1]) | (py[1:] != py[:-1])]
    # rows lie one behind the other, so that one running maximum serves all
    row, low = np.cumsum(head), x0.min()
    far = np.maximum.accumulate((x1 - low) + row * (x1.max() - low + 3))
    starts = np.flatnonzero(head | np.r_[True, (x0[1:] - low) + row[1:] * (x1.max() - low + 3) > far[:-1] + 1])
    return unit[starts], py[starts], x0[starts], np.maximum.reduceat(x1, starts)


def touched_runs(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, py, x0, x1``: maximal runs of the cells that the polygons touch.

    One exchange, of edges by polygon and block of raster rows, so that a tall polygon
    lies in several places; edges with missing coordinates touch nothing.  An edge is
    listed for each row inside a task only, for some ``STEP_ROWS`` of them at a time.
    """
    keys = list(keys)
    placed = edges.where("ua IS NOT NULL AND ub IS NOT NULL AND va IS NOT NULL AND vb IS NOT NULL").selectExpr(
        *(f"`{k}`" for k in keys), "ua", "va", "ub", "vb",
        "CAST(ceil(least(va, vb) - 1) AS bigint) AS top", "CAST(floor(greatest(va, vb)) AS bigint) AS bottom")
    at = lambda c: F.floor(F.col(c) / BLOCK).cast("bigint")
    dealt = placed.withColumn("_block", F.explode(F.sequence(at("top"), at("bottom")))).withColumns({
        "top": F.greatest("top", F.col("_block") * BLOCK), "bottom": F.least("bottom", F.col("_block") * BLOCK + BLOCK - 1)})
    edge = ("ua", "va", "ub", "vb", "top", "bottom")
    units = dealt.groupBy(*keys, "_block").agg(F.collect_list(F.struct(*edge)).alias("edges")).select(*keys, "edges")
    kinds = {f.name: f.dataType.simpleString() for f in edges.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["edges"]
            flat = lists.flatten()
            ua, va, ub, vb, top, bottom = (flat.field(name).to_numpy(zero_copy_only=False) for name in edge)
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            of, n = np.repeat(np.arange(len(ends)), np.diff(np.r_[0, ends])), bottom - top + 1
            step = np.r_[0, np.cumsum(n)][ends - 1] // STEP_ROWS if len(ends) else ends
            for a, b in _spans(step):
                these = np.arange(ends[a - 1] if a else 0, ends[b - 1])
                e = np.repeat(these, n[these])
                py = top[e] + np.arange(len(e)) - np.repeat(np.cumsum(n[these]) - n[these], n[these])
                x0, x1, crossing = _edge_rows(ua[e], va[e], ub[e], vb[e], py)
                inner = _inside(of[e], py, crossing)
                unit, *runs = _united(*(np.concatenate(c) for c in zip((of[e], py, x0, x1), inner)))
                at = pa.array(unit)
                yield pa.RecordBatch.from_arrays([*(batch[k].take(at) for k in keys), *map(pa.array, runs)], [*keys, "py", "x0", "x1"])

    return units.mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "py bigint, x0 bigint, x1 bigint"]))


def _spans(step: np.ndarray) -> list[tuple[int, int]]:
    """Spans of places with equal values."""
    cuts = np.r_[0, np.flatnonzero(step[1:] != step[:-1]) + 1, len(step)].tolist()
    return [(a, b) for a, b in zip(cuts[:-1], cuts[1:]) if b > a]


def on_runs(cells: DataFrame, runs: DataFrame, keys: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """Pairs of ``cells(px, py)`` and ``runs`` that hold them; both share ``keys``, if any.

    An equi-join by row and block of columns with an interval test.
    """
    at = lambda c: F.floor(F.col(c) / block).cast("bigint")
    listed = runs.withColumn("block", F.explode(F.sequence(at("x0"), at("x1"))))
    near = cells.withColumn("block", at("px")).join(listed, [*keys, "py", "block"])
    return near.where("px BETWEEN x0 AND x1").drop("block", "x0", "x1")


def cells_touched(cells: DataFrame, parcels: DataFrame, origin: tuple[float, float], step: float,
                  keys: Sequence[str] = ("parcel_id",)) -> DataFrame:
    """``cells(px, py)`` of one lattice with every parcel ``(keys, rings)`` that touches them."""
    edges = lattice_edges(parcels, keys, *map(F.lit, (*origin, step, step)))
    return on_runs(cells, touched_runs(edges, keys))


def property_runs(parcels: DataFrame, grids: DataFrame) -> DataFrame:
    """Cells of each parcel's own grid that its polygon touches, as runs.

    ``parcels(parcel_id, rings)`` are in degrees, ``grids`` come from
    ``grid_for_parcel``; rows count downwards and cells beyond the grid are cut off.
    """
    placed = parcels.select("parcel_id", "rings").join(
        grids.select("parcel_id", "zone", "south", "origin_x", "origin_y", "res", "width", "height"), "parcel_id")

    def metres(ring: Column) -> Column:
        points = F.transform(ring, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))
        return F.transform(project_points(points, F.col("zone"), F.col("south")), lambda p: F.array(p["x"], p["y"]))

    keys = ["parcel_id", "width", "height"]
    edges = lattice_edges(placed.withColumn("rings", F.transform("rings", metres)), keys,
                          F.col("origin_x"), F.col("origin_y"), F.col("res"), -F.col("res"))
    inside = touched_runs(edges, keys).where((F.col("py") >= 0) & (F.col("py") < F.col("height")))
    cut = inside.withColumns({"x0": F.greatest("x0", F.lit(0).cast("bigint")), "x1": F.least("x1", F.col("width").cast("bigint") - 1)})
    return cut.where("x0 <= x1").select("parcel_id", "py", "x0", "x1")
