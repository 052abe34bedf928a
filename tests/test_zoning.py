"""Composites and zones against NumPy."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopyflow.operators import pixels, zoning
from canopyflow.plans import land_use
from canopyflow.schemas import MONTH_COLS
from canopyflow.sources.curves import literature_curves
from canopyflow.constants import LITERATURE_CURVES


def vectors_frame(spark, vectors):
    """``vectors[parcel] -> (n, 12)`` integers with -1 for missing, one pixel per row."""
    rows = []
    for p, v in enumerate(vectors):
        for i, row in enumerate(v):
            rows.append((p, i % 20, i // 20, *[None if x < 0 else int(x) for x in row], int((row >= 0).sum())))
    return spark.createDataFrame(rows, "parcel_id bigint, px bigint, py bigint, "
                                 + ", ".join(f"{c} bigint" for c in MONTH_COLS) + ", n_months int")


def fit_plain(v, k, rounds=25):
    v = v.astype(object)
    for j in range(12):
        seen = [x for x in v[:, j] if x >= 0]
        fill = int(np.floor(sum(seen) / len(seen) + 0.5)) if seen else 3_000_000
        v[:, j] = [x if x >= 0 else fill for x in v[:, j]]

    def dist(a, c):
        return sum((int(x) - int(y)) ** 2 for x, y in zip(a, c))

    def mean(rows):
        return [int(np.floor(sum(map(int, col)) / len(rows) + 0.5)) for col in zip(*rows)]

    order = sorted(range(len(v)), key=lambda i: (i // 20, i % 20))
    centre = [mean(v)]
    chosen = []
    for j in range(k):
        far = max(order, key=lambda i: min(dist(v[i], c) for c in (chosen or centre)))
        chosen.append(list(v[far]))
    label = None
    for _ in range(rounds + 1):
        label = [min(range(k), key=lambda j: (dist(row, chosen[j]), j)) for row in v]
        chosen = [mean([v[i] for i in range(len(v)) if label[i] == j]) if j in label else chosen[j] for j in range(k)]
    return label


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(11)
    out = []
    for p, n in enumerate((70, 130)):
        kinds = rng.integers(0, 4, n)
        base = np.array([c[2] for c in LITERATURE_CURVES])[kinds]
        v = np.round((base + rng.normal(0, .05, (n, 12))).clip(0, 1) * 1e7).astype(int)
        v[rng.random((n, 12)) < 0.15] = -1
        v[:, 4] = -1 if p == 0 else v[:, 4]
        out.append(v)
    return out


@pytest.mark.parametrize("block", [256, 4])
def test_zones_equal_numpy(spark, vectors, block, monkeypatch):
    monkeypatch.setattr(zoning, "BLOCK_SIDE", block)
    grids = spark.createDataFrame([(0, 10.0), (1, 10.0)], "parcel_id bigint, res double")
    matrix = zoning.pixel_matrix(vectors_frame(spark, vectors), grids, zones=4)
    got = {(r.parcel_id, r.py * 20 + r.px): r.zone_id for r in zoning.segment(matrix).collect()}
    for p, v in enumerate(vectors):
        assert [got[p, i] for i in range(len(v))] == fit_plain(v, 4)


def test_pixels_stay_in_place_between_rounds(spark, vectors):
    grids = spark.createDataFrame([(0, 10.0), (1, 10.0)], "parcel_id bigint, res double")
    matrix = zoning.pixel_matrix(vectors_frame(spark, vectors), grids, zones=3)
    step = zoning.lloyd_step(matrix, zoning.first_centres(matrix, 3), 3)
    plan = step._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    scan = next(i for i, line in enumerate(lines) if "Scan ExistingRDD" in line and "known" in line)
    join = max(i for i in range(scan) if "SortMergeJoin" in lines[i] or "BroadcastHashJoin" in lines[i])
    assert not any("Exchange" in line for line in lines[join:scan]), plan


def test_zone_numbers(spark):
    n = spark.createDataFrame([(x,) for x in (10, 49, 50, 399, 700, 15_000, 50_000, 100_000, 300_000)], "n bigint")
    got = [r.k for r in n.select(zoning.zone_count(F.col("n"), F.lit(10.0)).alias("k")).collect()]
    assert got == [1, 1, 2, 2, 3, 4, 5, 6, 7]


def test_pixel_rules(spark):
    rows = [  # b04, b08, scl, baseline, expected index or None
        (1500, 4500, 4, "04.00", (4500 - 1500) / 4000), (1500, 4500, 4, None, 3000 / 4000),
        (500, 3500, 5, "03.01", 3000 / 4000), (1500, 4500, 9, "04.00", None), (0, 4500, 4, "03.01", None),
        (1050, 1100, 4, "04.00", None), (1500, 4500, 4, "05.09", 3000 / 4000)]
    df = spark.createDataFrame([(i, *r[:4]) for i, r in enumerate(rows)], "i int, b04 int, b08 int, scl int, baseline string")
    got = {r.i: r.ndvi_e7 / 1e7 for r in pixels.valid_pixels(df).collect()}
    assert got == {i: pytest.approx(r[4]) for i, r in enumerate(rows) if r[4] is not None}


def test_scene_needs_enough_pixels_and_a_plausible_mean(spark):
    rows = [("few", 5_000_000)] * 7 + [("good", 5_000_000)] * 8 + [("edge", 9_800_000)] * 8 + [("high", 9_900_000)] * 8
    df = spark.createDataFrame(rows, "scene_id string, ndvi_e7 bigint")
    got = {r.scene_id: (r.ndvi_e4, r.pixels) for r in pixels.scene_points(df, ["scene_id"]).collect()}
    assert got == {"good": (5000, 8), "edge": (9800, 8)}  # the upper limit itself is accepted for scenes


def test_composite_drops_sparse_pixels_and_strict_limits(spark):
    rows = [(1, 0, 0, dt.date(2026, m, 1), 4_000_000) for m in range(1, 7)]
    rows += [(1, 0, 0, dt.date(2026, 1, 9), 6_000_000), (1, 0, 0, dt.date(2026, 7, 1), 9_800_000)]
    rows += [(1, 1, 0, dt.date(2026, m, 1), 4_000_000) for m in range(1, 6)]
    df = spark.createDataFrame(rows, "parcel_id bigint, px bigint, py bigint, obs_date date, ndvi_e7 bigint")
    got = pixels.monthly_composite(df).collect()
    assert len(got) == 1 and got[0].m1 == 5_000_000 and got[0].m7 is None and got[0].n_months == 6


def striped_bands(spark, parcels=2, side=24):
    """Left half corn after soy, right half forest-like; two scenes a month."""
    corn, forest = LITERATURE_CURVES[0][2], [0.62] * 12
    rows = []
    for p in range(parcels):
        for m in range(1, 13):
            for half in (0, 1):
                for y in range(side):
                    for x in range(side):
                        v = (corn if x < side // 2 else forest)[m - 1] + (0.01 if half else -0.01)
                        rows.append((p, x, y, m * 10 + half, dt.date(2025 if m >= 9 else 2026, m, 3 + half), "04.00", 4,
                                     round(1000 + 3000 * (1 - v)), round(1000 + 3000 * (1 + v))))
    for x in range(18):
        rows.append((9, x % 9, x // 9, 1, dt.date(2026, 1, 1), "04.00", 4, 2000, 4000))
    return spark.createDataFrame(rows, "parcel_id bigint, px bigint, py bigint, scene_id bigint, obs_date date, "
                                       "baseline string, scl int, b04 int, b08 int")


def test_whole_land_use_plan(spark):
    bands = striped_bands(spark).repartition(4)
    grids = spark.createDataFrame([(p, 24, 24, 600000.0, 8600000.0, 10.0, 21, True) for p in (0, 1, 9)],
                                  "parcel_id bigint, width int, height int, origin_x double, origin_y double, "
                                  "res double, zone int, south boolean")
    rgb = bands.select("parcel_id", "px", "py").distinct().select(
        "*", F.when(F.col("px") < 13, 200).otherwise(20).cast("bigint").alias("r"),
        F.lit(90).cast("bigint").alias("g"), F.lit(60).cast("bigint").alias("b"))
    done = land_use.map_land_use(bands, grids, literature_curves(spark), rgb=rgb, min_area_ha=0.2)
    status = {r.parcel_id: (r.reason, r.method) for r in done.status.collect()}
    assert status[9][0] == "few_scenes" and status[0] == (None, "slic") and done.rejected_scenes.count() == 0
    classes = {r.zone_class for r in done.zones.collect()}
    assert classes == {"milho_safrinha", "mata"}
    found = sorted((r.parcel_id, r["class"], r.label) for r in done.regions.collect())
    assert [f[:2] for f in found] == [(p, c) for p in (0, 1) for c in ("mata", "milho_safrinha")]
    totals = {r.parcel_id: r for r in done.totals.collect()}
    assert totals[0].total_ha == 5.8 and 2.5 < totals[0].corn_ha < 3.5 and totals[0].n_regions == 2
    assert totals[0].corn_pct == pytest.approx(100 * totals[0].corn_ha / 5.76, abs=0.06)
