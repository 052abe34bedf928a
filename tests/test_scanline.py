"""Polygons on a raster: runs against a test of every cell, and odd rings."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopyflow.functions import rings as R
from canopyflow.operators import parcels as P
from canopyflow.operators import regions, scanline
from tests.test_skew_and_plans import plan_of

RINGS = "parcel_id int, rings array<array<array<double>>>"


def closed(*points):
    return [[float(x), float(y)] for x, y in [*points, points[0]]]


POLYGONS = {
    1: [closed((1, 1), (9, 1), (9, 3), (3, 3), (3, 8), (1, 8))],  # concave, all on cell borders
    2: [closed((0.5, 0.5), (12.5, 1.5), (10.2, 11.7), (1.3, 9.9)), closed((4.5, 4.5), (8.25, 5), (7, 8.5))],  # hole
    3: [closed((0, 0), (2, 0), (2, 2), (0, 2)), closed((5, 5), (9.5, 5.5), (6, 9))],  # two parts
    4: [closed((3.25, 3.25), (3.75, 3.5), (3.5, 3.75))],  # inside one cell
    5: [closed((-5.5, -3.5), (4.5, -3.25), (4, 2))],  # negative coordinates
    6: [closed((2, 2), (2, 6), (2, 2))],  # no area, along a border
    7: [closed((0, 0), (10, 10), (10, 10.001), (0, 0.001))],  # a sliver through corners
    8: [[[3.0, 4.0], [3.0, 4.0]]],  # one point
}


def touched_by_hand(rings, low=-8, high=15):
    out = set()
    for row in range(low, high):
        for col in range(low, high):
            crossings, hit = 0, False
            for ring in rings:
                for (ua, va), (ub, vb) in zip(ring, ring[1:]):
                    corners = [(ub - ua) * (row + dy - va) - (vb - va) * (col + dx - ua) for dx in (0, 1) for dy in (0, 1)]
                    hit |= (min(ua, ub) <= col + 1 and max(ua, ub) >= col and min(va, vb) <= row + 1 and max(va, vb) >= row
                            and min(corners) <= 0 <= max(corners))
                    if (va > row + 0.5) != (vb > row + 0.5):
                        crossings += col + 0.5 < (ub - ua) * (row + 0.5 - va) / (vb - va) + ua
            if hit or crossings % 2:
                out.add((col, row))
    return out


def runs_of(spark, polygons):
    df = spark.createDataFrame(list(polygons.items()), RINGS)
    edges = scanline.lattice_edges(df, ["parcel_id"], *map(F.lit, (0.0, 0.0, 1.0, 1.0)))
    return scanline.touched_runs(edges, ["parcel_id"])


def test_runs_equal_a_test_of_every_cell(spark):
    rng = np.random.default_rng(4)
    polygons = POLYGONS | {100 + i: [closed(*rng.uniform(-6, 13, (rng.integers(3, 9), 2)))] for i in range(60)}
    found = {}
    for r in regions.run_cells(runs_of(spark, polygons), ["parcel_id"]).collect():
        found.setdefault(r.parcel_id, []).append((r.px, r.py))
    for k, rings in polygons.items():
        assert sorted(found.get(k, [])) == sorted(touched_by_hand(rings)), k


def test_runs_are_maximal_and_apart(spark):
    rows = sorted(tuple(r) for r in runs_of(spark, POLYGONS).collect())
    assert all(a[:2] != b[:2] or a[3] + 1 < b[2] for a, b in zip(rows, rows[1:]))


def test_odd_polygons(spark):
    odd = {1: None, 2: [], 3: [[]], 4: [[[1.0, 1.0]]]}
    assert runs_of(spark, odd).count() == 0
    assert runs_of(spark, POLYGONS).where("parcel_id < 0").count() == 0


@pytest.mark.parametrize("block", [1, 3, 256])
def test_cells_meet_runs(spark, block):
    cells = spark.range(-8, 15).select(F.col("id").alias("px")).crossJoin(spark.range(-8, 15).select(F.col("id").alias("py")))
    cells = cells.withColumn("note", F.lit("x")).union(cells.limit(5).withColumn("note", F.lit("again")))
    pairs = scanline.on_runs(cells, runs_of(spark, POLYGONS), block=block)
    got = sorted((r.parcel_id, r.px, r.py) for r in pairs.where("note = 'x'").collect())
    assert got == sorted((k, *c) for k, rings in POLYGONS.items() for c in touched_by_hand(rings))


def test_one_exchange_to_runs_and_none_over_pixels_twice(spark):
    runs = plan_of(runs_of(spark, POLYGONS))
    assert runs.count("Exchange hashpartitioning") == 1
    cells = spark.range(1000).select((F.col("id") % 20).alias("px"), (F.col("id") % 17).alias("py"), "id")
    plan = plan_of(scanline.on_runs(cells, runs_of(spark, POLYGONS)))
    assert plan.count("Range (0, 1000") == 1 and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_property_cells_of_a_parcel_grid(spark):
    ring = [[-56.0, -13.0], [-55.99, -12.997], [-55.993, -12.988], [-55.996, -12.994], [-56.0, -13.0]]
    parcels = spark.createDataFrame([(1, [ring]), (2, [[[x + 0.1, y] for x, y in ring]])], RINGS)
    grids = P.grid_for_parcel(parcels)
    runs = scanline.property_runs(parcels, grids)
    sizes = {r.parcel_id: r.n for r in runs.groupBy("parcel_id").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("n")).collect()}
    sides = {r.parcel_id: r for r in grids.collect()}
    exact = {r.parcel_id: r.ha for r in parcels.select("parcel_id", R.geodesic_area_ha("rings").alias("ha")).collect()}
    for k, n in sizes.items():
        outline = sides[k].width + sides[k].height
        assert exact[k] * 100 * 0.99 < n < exact[k] * 100 * 1.01 + 2 * outline
    rows = runs.groupBy("parcel_id").agg(F.min("py").alias("a"), F.max("py").alias("b"), F.min("x0").alias("c"), F.max("x1").alias("d")).collect()
    for r in rows:
        # the grid covers the projected box of the polygon, which the polygon itself need not fill
        assert 0 <= r.a <= 1 and 0 <= r.c <= 1
        assert 0 <= sides[r.parcel_id].height - 1 - r.b <= 1 and 0 <= sides[r.parcel_id].width - 1 - r.d <= 1


def test_edges_are_listed_by_row_inside_tasks(spark):
    """A polygon over many rows is exchanged by edge and block, not by edge and row."""
    tall = {1: [closed((0.5, -300.5), (3.5, -300.5), (3.5, 700.5), (0.5, 700.5))], 2: None, 3: [[[None, 1.0], [2.0, 2.0], [3.0, None]]]}
    runs = runs_of(spark, tall)
    assert "Window" not in plan_of(runs)
    assert sorted((r.parcel_id, r.py, r.x0, r.x1) for r in runs.collect()) == [(1, y, 0, 3) for y in range(-301, 701)]


@pytest.mark.parametrize("rows", [1, 7])
def test_steps_of_a_task_change_nothing(spark, monkeypatch, rows):
    whole = sorted(map(tuple, runs_of(spark, POLYGONS).collect()))
    monkeypatch.setattr(scanline, "STEP_ROWS", rows)
    assert sorted(map(tuple, runs_of(spark, POLYGONS).collect())) == whole
