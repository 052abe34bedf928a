"""Raster regions, sieving, outlines, halos and superpixels against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopyflow.operators import components, outline, regions, superpixels

STRIDE = regions.ROW_STRIDE


def mask_frame(spark, masks):
    rows = [(p, "c", int(x), int(y)) for p, m in enumerate(masks) for y, x in zip(*np.nonzero(m))]
    return spark.createDataFrame(rows, "parcel_id bigint, class string, px bigint, py bigint")


def grid_frame(spark, masks, res=10.0):
    rows = [(p, m.shape[1], m.shape[0], 600000.0, 8600000.0, res, 21, True) for p, m in enumerate(masks)]
    return spark.createDataFrame(rows, "parcel_id bigint, width int, height int, origin_x double, origin_y double, "
                                       "res double, zone int, south boolean")


def flood(mask, diagonal):
    """Region id (smallest cell number) per true cell."""
    near = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if diagonal else [])
    label = {}
    for y, x in zip(*np.nonzero(mask)):
        if (y, x) in label:
            continue
        label[y, x] = y * STRIDE + x
        stack = [(y, x)]
        while stack:
            cy, cx = stack.pop()
            for dy, dx in near:
                n = (cy + dy, cx + dx)
                if 0 <= n[0] < mask.shape[0] and 0 <= n[1] < mask.shape[1] and mask[n] and n not in label:
                    label[n] = y * STRIDE + x
                    stack.append(n)
    return label


def sieve_plain(mask, min_px):
    label, value = {}, {}
    for v in (True, False):
        for cell, r in flood(mask == v, True).items():
            label[cell] = r
            value[r] = v
    size = {}
    for r in label.values():
        size[r] = size.get(r, 0) + 1
    nearby = {}
    for (y, x), r in label.items():
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                o = label.get((y + dy, x + dx))
                if o is not None and o != r:
                    nearby.setdefault(r, set()).add(o)
    choice = {r: max(nearby[r], key=lambda o: (size[o], -o)) for r in size if size[r] < min_px and r in nearby}
    out = np.zeros(mask.shape, bool)
    for cell, r in label.items():
        end, seen = r, set()
        while end in choice and end not in seen:
            seen.add(end)
            end = choice[end]
        out[cell] = value[end] if size[end] >= min_px else value[r]
    return out


@pytest.fixture(scope="module")
def masks():
    rng = np.random.default_rng(3)
    specks = np.zeros((12, 15), bool)
    specks[2:8, 2:9] = True
    specks[4, 4] = False            # one-cell hole
    specks[10, 12] = True           # speck
    specks[8, 9] = True             # diagonal contact
    ring = np.zeros((9, 9), bool)
    ring[1:8, 1:8] = True
    ring[3:6, 3:6] = False
    ring[4, 4] = True
    snake = np.zeros((20, 20), bool)
    snake[::2] = True
    snake[1::4, -1] = True
    snake[3::4, 0] = True
    return [specks, ring, snake, rng.random((25, 30)) < 0.5, rng.random((18, 40)) < 0.3, rng.random((30, 22)) < 0.75]


@pytest.mark.parametrize("diagonal", [False, True])
def test_regions_equal_flood_fill(spark, masks, diagonal):
    labelled = regions.label_regions(regions.row_runs(mask_frame(spark, masks)), diagonal=diagonal)
    got = {}
    for r in labelled.collect():
        for x in range(r.x0, r.x1 + 1):
            got[r.parcel_id, r.py, x] = r.region_id
    want = {(p, y, x): v for p, m in enumerate(masks) for (y, x), v in flood(m, diagonal).items()}
    assert got == want


@pytest.mark.parametrize("min_px", [2, 4, 12])
def test_sieve_equals_brute_force(spark, masks, min_px):
    cleaned = regions.sieve(regions.row_runs(mask_frame(spark, masks)), grid_frame(spark, masks), min_px / 100)
    got = {(r.parcel_id, r.py, r.px) for r in regions.run_cells(cleaned).collect()}
    want = {(p, y, x) for p, m in enumerate(masks) for y, x in zip(*np.nonzero(sieve_plain(m, min_px)))}
    assert got == want


def test_sieve_fills_holes_and_drops_specks(spark, masks):
    cleaned = regions.sieve(regions.row_runs(mask_frame(spark, masks[:1])), grid_frame(spark, masks[:1]), 0.04)
    cells = {(r.py, r.px) for r in regions.run_cells(cleaned).collect()}
    assert (4, 4) in cells and (10, 12) not in cells
    clipped = {(r.py, r.px) for r in regions.run_cells(
        regions.clip_runs(cleaned, mask_frame(spark, masks[:1]))).collect()}
    assert clipped == cells - {(4, 4)}


def ring_area(ring):
    a = np.array(ring)
    return abs((a[:-1, 0] * a[1:, 1] - a[1:, 0] * a[:-1, 1]).sum() / 2)


def test_outline_segments_close_and_enclose_the_area(spark, masks):
    labelled = regions.label_regions(regions.row_runs(mask_frame(spark, masks)))
    by_region = {}
    for s in regions.boundary_segments(labelled).collect():
        by_region.setdefault((s.parcel_id, s.region_id), []).append((s.xa, s.ya, s.xb, s.yb))
    sizes = {(r.parcel_id, r.region_id): r.n_px for r in regions.region_sizes(labelled).collect()}
    assert by_region.keys() == sizes.keys()
    for key, segments in by_region.items():
        a = np.array(segments)
        rings = outline.stitch(a[:, :2], a[:, 2:])
        signed = sum((r[:-1, 0] * r[1:, 1] - r[1:, 0] * r[:-1, 1]).sum() / 2 for r in rings)
        assert signed == sizes[key]
        assert all((r[0] == r[-1]).all() for r in rings)


def test_outline_rings_in_degrees(spark, masks):
    keep = [masks[1]]
    labelled = regions.label_regions(regions.row_runs(mask_frame(spark, keep)))
    rows = outline.outline_regions(labelled, grid_frame(spark, keep), tolerance=1e-9).orderBy("region_id").collect()
    assert [len(r.rings) for r in rows] == [2, 1]  # a ring with a hole, and the cell inside it
    metres = 111_000 ** 2 * np.cos(np.radians(12.66))
    outer, hole = (ring_area(r) * metres for r in rows[0].rings)
    assert outer == pytest.approx(4900, rel=0.02) and hole == pytest.approx(900, rel=0.02)
    assert all(ring[0] == ring[-1] for r in rows for ring in r.rings)


def test_simplify_keeps_corners_within_tolerance():
    line = np.array([[0, 0], [1, 0.001], [2, 0], [2, 2], [0, 2], [0, 0]], float)
    slim = outline.simplify(line, 0.01)
    assert slim.tolist() == [[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]


def test_halo_is_three_dilations(spark, masks):
    want = set()
    for p, m in enumerate(masks):
        for y, x in zip(*np.nonzero(m)):
            want |= {(p, y + dy, x + dx) for dy in range(-3, 4) for dx in range(-3, 4) if abs(dx) + abs(dy) <= 3}
    got = {(r.parcel_id, r.py, r.px) for r in regions.halo(mask_frame(spark, masks)).collect()}
    assert got == want


def test_empty_mask(spark, masks):
    none = mask_frame(spark, masks).where("px < 0")
    assert regions.label_regions(regions.row_runs(none)).count() == 0
    assert regions.sieve(regions.row_runs(none), grid_frame(spark, masks), 0.1).count() == 0


def test_components_with_hubs(spark, monkeypatch):
    monkeypatch.setattr(components, "MIN_HOT_ROWS", 20)
    monkeypatch.setattr(components, "HOT_SHARE", 10)
    edges = [("k", 0, i) for i in range(1, 400)] + [("k", 1000 + i, 1001 + i) for i in range(300)]
    nodes = [("k", i) for i in range(400)] + [("k", 1000 + i) for i in range(301)] + [("z", 5)]
    got = components.connected_components(spark.createDataFrame(nodes, "g string, node bigint"),
                                          spark.createDataFrame(edges, "g string, a bigint, b bigint"), ["g"])
    labels = {(r.g, r.node): r.label for r in got.collect()}
    assert len(labels) == len(nodes)
    assert all(v == (0 if n < 1000 else 1000) for (g, n), v in labels.items() if g == "k") and labels["z", 5] == 5


def test_feature_limit_and_order(spark):
    rows = [(1, "a", i, i % 3, float(i), 5) for i in range(10)] + [(2, "a", 1, 0, 1.0, 5)]
    df = spark.createDataFrame(rows, "parcel_id bigint, class string, region_id bigint, class_ord int, area_ha double, n_px bigint")
    got = regions.top_regions(df, 4).collect()
    assert [(r.region_id, r.truncated) for r in sorted((r for r in got if r.parcel_id == 1), key=lambda r: r.rn)] == [
        (9, True), (6, True), (3, True), (0, True)]
    assert [r.truncated for r in got if r.parcel_id == 2] == [False]


def superpixels_plain(rgb, n_mask, weight=100, rounds=2, unit=64):
    cells = {(y, x): tuple(int(v) for v in rgb[y, x]) for y, x in np.ndindex(rgb.shape[:2]) if rgb[y, x].sum() > 0}
    k = min(800, max(60, n_mask // 40))
    step = max(1, int(np.ceil(np.sqrt(len(cells) / k))))
    home = {c: (c[0] // step, c[1] // step) for c in cells}

    def centres(assigned):
        groups = {}
        for (y, x), h in assigned.items():
            groups.setdefault(h, []).append((x, y, *cells[y, x]))
        return {h: [int(np.floor(sum(c) * unit / len(c) + 0.5)) for c in zip(*v)] for h, v in groups.items()}

    assigned = home
    for _ in range(rounds + 1):
        mid = centres(assigned)
        fresh = {}
        for (y, x), rgbv in cells.items():
            best = None
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    h = (y // step + dy, x // step + dx)
                    if h in mid:
                        c = mid[h]
                        d = (step * step * sum((c[2 + i] - unit * rgbv[i]) ** 2 for i in range(3))
                             + weight * ((c[0] - unit * x) ** 2 + (c[1] - unit * y) ** 2))
                        best = min(best or (d, *h), (d, *h))
            fresh[y, x] = best[1:]
        assigned = fresh
    return {c: h[0] * STRIDE + h[1] for c, h in assigned.items()}


def test_superpixels_equal_brute_force_and_vote(spark):
    rng = np.random.default_rng(8)
    rgb = rng.integers(0, 40, (24, 30, 3))
    rgb[:, 17:] += 120
    rgb[0, 0] = 0
    rows = [(7, x, y, *map(int, rgb[y, x])) for y, x in np.ndindex(rgb.shape[:2])]
    frame = spark.createDataFrame(rows, "parcel_id bigint, px bigint, py bigint, r bigint, g bigint, b bigint")
    mask = frame.where("px >= 16").select("parcel_id", "px", "py")
    segments = superpixels.superpixels(frame, mask, rounds=2)
    got = {(r.py, r.px): r.segment_id for r in segments.collect()}
    assert got == superpixels_plain(rgb, 24 * 14)
    allowed = frame.where("py > 1")
    refined, status = superpixels.refine(mask, allowed, frame, rounds=2)
    cells = {(r.py, r.px) for r in refined.collect()}
    assert status.first().method == "slic" and all(y > 1 for y, _ in cells)
    # the vote is on connected segments: fragments cut off from theirs count with a neighbour
    from tests.test_fragments import connected_by_hand
    torn = np.full(rgb.shape[:2], -1)
    for cell, s in got.items():
        torn[cell] = s
    whole, votes = connected_by_hand(torn), {}
    for (y, x), s in whole.items():
        if y > 1:
            votes.setdefault(s, []).append(x >= 16)
    assert cells == {(y, x) for (y, x), s in whole.items() if y > 1 and 2 * sum(votes[s]) >= len(votes[s])}
    moved = sum(s != torn[c] for c, s in whole.items())
    assert sum((y, x) in cells for y in range(2, 24) for x in range(17, 30)) >= 22 * 13 - moved
    kept, off = superpixels.refine(mask, allowed, frame.where("px < 0"))
    assert off.first().method == "off" and kept.count() == mask.count()


def test_joins_of_runs_and_edges_pass_the_driver_by(spark):
    from canopyflow.operators import components, skew
    runs = spark.createDataFrame([(1, "a", 0, 0, 3), (1, "a", 1, 2, 5)], "parcel_id long, class string, py long, x0 long, x1 long")
    edges = spark.createDataFrame([(1, 2, 1), (1, 3, 1)], "parcel_id long, u long, v long")
    salted = skew.salted_join(edges, edges.select("parcel_id", "u").distinct(), ["parcel_id", "u"], ["v"], edges.select("parcel_id", "u").limit(0))
    for df, rows in ((regions._touching(runs, regions.MASK, False, []), 1), (components._with_smallest(edges, ["parcel_id"], 2), 2), (salted, 2)):
        assert "SortMergeJoin" in df._jdf.queryExecution().executedPlan().toString()
        assert df.count() == rows


def test_edges_of_a_task_become_stars(spark, monkeypatch):
    """Runs of a snake are linked inside tasks, so that the rounds find one star and no path."""
    rows = [(p, k, 7 * i, 7 * i + 7) for p in ("x", None) for k in (1, 2) for i in range(50)] + [("y", 1, 3, 3)]
    edges = spark.createDataFrame(rows, "p string, k int, a bigint, b bigint").coalesce(1)
    stars = {tuple(r) for r in components.contracted(edges, ["p", "k"]).collect()}
    assert stars == {(p, k, 7 * i, 0) for p in ("x", None) for k in (1, 2) for i in range(1, 51)}

    snake = np.zeros((41, 9), bool)
    snake[::2] = True
    snake[1::4, -1] = snake[3::4, 0] = True
    found, whole = [], regions.connected_components

    def watched(nodes, links, keys):
        found.append(links.cache())
        return whole(nodes, links, keys)

    monkeypatch.setattr(regions, "connected_components", watched)
    labelled = regions.label_regions(regions.row_runs(mask_frame(spark, [snake])))
    assert [r.region_id for r in labelled.select("region_id").distinct().collect()] == [0]
    assert {r.b for r in found[0].collect()} == {0}


def test_stars_of_parts_join_into_the_same_regions(spark, monkeypatch):
    monkeypatch.setattr(components, "HELD_EDGES", 3)
    monkeypatch.setattr(regions, "ROW_BLOCK", 2)
    mask = np.random.default_rng(5).random((23, 17)) < 0.6
    labelled = regions.label_regions(regions.row_runs(mask_frame(spark, [mask])))
    got = {(r.py, x): r.region_id for r in labelled.collect() for x in range(r.x0, r.x1 + 1)}
    assert got == flood(mask, False)
