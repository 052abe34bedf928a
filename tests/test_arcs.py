"""Outlines from shared arcs: areas, rings, shared vertices and no crossings."""

from __future__ import annotations

import numpy as np
import pytest

from canopyflow.operators import arcs, regions
from tests.test_regions import flood
from tests.test_skew_and_plans import plan_of

RUNS = "parcel_id int, class string, region_id long, py long, x0 long, x1 long"


def label_map(grid):
    out = np.full(grid.shape, -1, np.int64)
    for v in np.unique(grid[grid >= 0]):
        for cell, r in flood(grid == v, False).items():
            out[cell] = r
    return out


@pytest.fixture(scope="module")
def grids():
    rng = np.random.default_rng(12)
    nested = np.zeros((12, 14), int)
    nested[2:9, 3:11], nested[4:7, 5:9], nested[5, 6] = 1, 2, 1
    blobs = (np.add.outer(np.sin(np.arange(40) / 5), np.cos(np.arange(50) / 6)) * 2).astype(int) + 3
    blobs[:3, :4] = -1
    return [nested, np.full((9, 5), 7), rng.integers(-1, 3, (11, 13)), np.eye(6, dtype=int), blobs]


@pytest.fixture(scope="module")
def runs(spark, grids):
    rows = []
    for p, g in enumerate(grids):
        ids = label_map(g)
        rows += [(p, f"c{g[y, x]}", int(ids[y, x]), y, x, x) for y in range(g.shape[0]) for x in range(g.shape[1]) if g[y, x] >= 0]
    return spark.createDataFrame(rows, RUNS).cache()


@pytest.fixture(scope="module")
def frames(spark, grids):
    rows = [(p, 600_000.0 + 9000 * p, 8_600_000.0, 10.0, 21, True) for p in range(len(grids))]
    return spark.createDataFrame(rows, "parcel_id int, origin_x double, origin_y double, res double, zone int, south boolean")


def collected(df):
    return {(r.parcel_id, r["class"], r.region_id): r for r in df.collect()}


SHARED = (["parcel_id"], ["class", "region_id"])


@pytest.fixture(scope="module")
def exact(runs, frames):
    return collected(arcs.outlined(runs, frames, *SHARED, None, tile=8))


def shoelace(ring):
    a = np.array(ring)
    return float((a[:-1, 0] * a[1:, 1] - a[1:, 0] * a[:-1, 1]).sum() / 2)


def test_areas_and_ring_counts(exact, grids):
    cells = {}
    for p, g in enumerate(grids):
        ids = label_map(g)
        for r in np.unique(ids[g >= 0]):
            cells[p, f"c{g[ids == r][0]}", int(r)] = ids == r
    assert exact.keys() == cells.keys()
    for key, mask in cells.items():
        found = exact[key]
        assert sum(found.ring_cells) == mask.sum() and found.ring_cells[0] > 0 and all(a < 0 for a in found.ring_cells[1:])
        assert [shoelace(r) for r in found.rings] == found.ring_cells
        # holes of a 4-connected region are 8-connected parts of the rest, without the one outside
        rest = np.pad(~mask, 1, constant_values=True)
        assert len(found.rings) == len(set(flood(rest, True).values()))


@pytest.mark.parametrize("tile", [5, 64])
def test_tiles_do_not_change_areas(runs, frames, exact, tile):
    other = collected(arcs.outlined(runs, frames, *SHARED, None, tile=tile))
    assert {k: r.ring_cells for k, r in other.items()} == {k: r.ring_cells for k, r in exact.items()}


@pytest.mark.parametrize("tile", [8, 64])
def test_neighbours_share_their_border(runs, frames, tile):
    slim = collected(arcs.outlined(runs, frames, *SHARED, 0.0002, tile=tile))
    whole = collected(arcs.outlined(runs, frames, *SHARED, 0.0, tile=tile))
    used = {}
    for (p, *_), r in slim.items():
        for ring in r.rings:
            assert len(ring) >= 4 and ring[0] == ring[-1]
            for a, b in zip(ring, ring[1:]):
                used.setdefault(p, []).append((tuple(a), tuple(b)))
    assert sum(len(x) for x in used.values()) < sum(len(ring) - 1 for r in whole.values() for ring in r.rings)
    for p, sides in used.items():
        assert len(set(sides)) == len(sides)  # no side twice in the same direction
        both = {s for s in sides if s[::-1] in set(sides)}
        if p != 1:
            assert both  # inner borders are the same side, once in each direction
        lines = sorted({tuple(sorted(s)) for s in sides})
        for i, (a, b) in enumerate(lines):
            for c, d in lines[i + 1:]:
                assert not crosses(a, b, c, d), (p, a, b, c, d)


def crosses(a, b, c, d):
    def side(p, q, r):
        return np.sign(round(((q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])) * 1e14, 1))

    return side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0


def test_one_class_at_a_time_and_empty(runs, frames, exact):
    alone = collected(arcs.outlined(runs, frames, regions.MASK, ["region_id"], None))
    assert {k: r.ring_cells for k, r in alone.items()} == {k: r.ring_cells for k, r in exact.items()}
    assert arcs.outlined(runs.limit(0), frames, *SHARED, 0.0001).count() == 0


def test_regions_are_joined_in_batches(spark):
    """Only tiles are calls of their own; the many regions share theirs."""
    runs = spark.createDataFrame([(1, "a", 0, 0, 0, 0), (1, "b", 1, 0, 1, 1), (1, "a", 2, 0, 2, 5)],
                                 "parcel_id long, class string, region_id long, py long, x0 long, x1 long")
    frames = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 21, True)], "parcel_id long, origin_x double, origin_y double, res double, zone int, south boolean")
    rings = arcs.outlined(runs, frames, ["parcel_id"], ["class", "region_id"], None)
    assert "MapInArrow" in plan_of(rings)
    assert {(r["class"], r.region_id): r.ring_cells for r in rings.collect()} == {("a", 0): [1], ("b", 1): [1], ("a", 2): [4]}


def test_tiles_are_as_large_as_their_runs():
    """A small raster costs its own cells, and has the arcs it has in a whole tile."""
    rng = np.random.default_rng(3)
    for height, width in [(1, 1), (4, 9), (20, 25), (63, 3), (64, 64)]:
        cells = rng.integers(0, 3, (height, width))
        at = [(cells[y, x], y, x, x) for y in range(height) for x in range(width) if cells[y, x]]
        code, row, x0, x1 = np.array(at or [(0, 0, 0, 0)]).T
        labels = arcs.tile_labels(code, row, x0, x1, 64)
        assert labels.shape[0] == labels.shape[1] <= min(66, max(height, width) + 3)
        full = np.full((66, 66), -1)
        full[row + 1, x0 + 1] = code
        (found, corners), (want, every) = arcs.trace(labels), arcs.trace(full)
        assert (corners == every).all() and len(found) == len(want)
        for a, b in zip(found, want):
            assert (a[0] == b[0]).all() and a[1:] == b[1:]
