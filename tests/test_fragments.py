"""Connected segments against contraction by hand."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from canopyflow.operators import fragments
from tests.test_regions import flood

SCHEMA = "parcel_id int, px long, py long, segment_id long"


def frame(spark, grids):
    rows = [(p, x, y, int(g[y, x])) for p, g in enumerate(grids) for y in range(g.shape[0]) for x in range(g.shape[1]) if g[y, x] >= 0]
    return spark.createDataFrame(rows, SCHEMA)


def fragment_of(grid):
    out = {}
    for s in np.unique(grid[grid >= 0]):
        out |= flood(grid == s, False)
    return out


def connected_by_hand(grid):
    fragment = fragment_of(grid)
    size = Counter(fragment.values())
    segment = {f: int(grid[c]) for c, f in fragment.items()}
    main = {s: max((f for f in size if segment[f] == s), key=lambda f: (size[f], -f)) for s in set(segment.values())}
    at = {f: f for f in size}
    settled = set(main.values())
    while True:
        border = Counter()
        for (y, x), f in fragment.items():
            for other in ((y, x + 1), (y + 1, x)):
                if other in fragment and at[fragment[other]] != at[f]:
                    border[tuple(sorted((at[f], at[fragment[other]])))] += 1
        chosen = {}
        for node in set(at.values()) - settled:
            edges = [(n, -a, -b) for (a, b), n in border.items() if node in (a, b)]
            if edges:
                n, a, b = max(edges)
                chosen[node] = -a - b - node
        if not chosen:
            return {c: segment[at[f]] if at[f] in settled else at[f] + fragments.ISLANDS for c, f in fragment.items()}
        for f in at:
            node, seen = at[f], []
            while node in chosen and node not in seen:
                seen.append(node)
                node = chosen[node]
            at[f] = min(node, chosen[node]) if node in chosen else node


@pytest.fixture(scope="module")
def grids():
    rng = np.random.default_rng(8)
    torn = np.zeros((8, 9), int)
    torn[:, 4] = 1
    torn[2, 7], torn[3, 7], torn[6, 1] = 2, 2, 2
    island = np.full((7, 12), -1)
    island[1:3, 1:5], island[4:6, 7:11] = 3, 3
    island[4, 9] = 5
    nested = np.zeros((9, 9), int)
    nested[2:7, 2:7], nested[3:6, 3:6], nested[4, 4] = 1, 0, 1
    whole = np.repeat(np.arange(4), 5)[:, None] + np.zeros((1, 6), int)
    return [whole, torn, island, nested, rng.integers(0, 4, (15, 17)), rng.integers(0, 9, (20, 70)), np.where(rng.random((12, 12)) < 0.3, -1, rng.integers(0, 3, (12, 12)))]


@pytest.fixture(scope="module")
def done(spark, grids):
    return {(r.parcel_id, r.py, r.px): r.segment_id for r in fragments.connected_segments(frame(spark, grids)).collect()}


def test_segments_equal_contraction_by_hand(done, grids):
    assert done == {(p, *c): s for p, g in enumerate(grids) for c, s in connected_by_hand(g).items()}
    assert all(done[0, y, x] == grids[0][y, x] for y in range(20) for x in range(6))


def test_each_segment_is_one_component(done, grids):
    for p, g in enumerate(grids):
        ids = np.full(g.shape, -1)
        for (y, x) in zip(*np.nonzero(g >= 0)):
            ids[y, x] = done[p, y, x]
        assert all(len(set(flood(ids == s, False).values())) == 1 for s in np.unique(ids[g >= 0]))


def test_empty(spark, grids):
    assert fragments.connected_segments(frame(spark, grids[:1]).limit(0)).count() == 0


@pytest.mark.parametrize("block", [3, 64])
def test_borders_do_not_depend_on_blocks(spark, grids, block):
    found = [{(y, x): (p, f) for (y, x), f in fragment_of(g).items()} for p, g in enumerate(grids)]
    rows = [tuple(map(int, (p, y, x, x, f))) for cells in found for (y, x), (p, f) in cells.items()]
    runs = spark.createDataFrame(rows, "parcel_id int, py long, x0 long, x1 long, fragment long")
    got = {(r.parcel_id, r.a, r.b): r.n for r in fragments.shared_borders(runs, block).collect()}
    want = Counter()
    for cells in found:
        for (y, x), (p, f) in cells.items():
            for other in ((y, x + 1), (y + 1, x)):
                if other in cells and cells[other][1] != f:
                    want[p, min(f, cells[other][1]), max(f, cells[other][1])] += 1
    assert got == want
