"""Projection, areas, predicates and spatial joins."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopyflow.functions import rings as R
from canopyflow.functions.geodesy import epsg_code, grid_zone, project, unproject
from canopyflow.operators import pixels
from canopyflow.operators import parcels as P
from canopyflow.operators import spatial

SQUARE = [[[-56.0, -13.0], [-55.9, -13.0], [-55.9, -12.9], [-56.0, -12.9], [-56.0, -13.0]]]
HOLED = SQUARE + [[[-55.97, -12.97], [-55.97, -12.93], [-55.93, -12.93], [-55.93, -12.97], [-55.97, -12.97]]]
L_SHAPE = [[[0.0, 0.0], [4.0, 0.0], [4.0, 1.0], [1.0, 1.0], [1.0, 4.0], [0.0, 4.0], [0.0, 0.0]]]
RINGS = "id string, rings array<array<array<double>>>"


def test_projection_known_point_and_round_trip(spark):
    rng = np.random.default_rng(2)
    pts = [(float(lon), float(lat)) for lon, lat in zip(rng.uniform(-61, -50, 200), rng.uniform(-18, -7, 200))] + [(-57.0, 0.0)]
    df = spark.createDataFrame(pts, "lon double, lat double").withColumn("zone", grid_zone(F.col("lon")))
    x, y = project(F.col("lon"), F.col("lat"), F.col("zone"), F.lit(True))
    rows = df.select("lon", "lat", "zone", x.alias("x"), y.alias("y"), epsg_code(F.col("lon"), F.col("lat")).alias("epsg")).collect()
    for r in rows:
        lon, lat = unproject(np.array([r.x]), np.array([r.y]), r.zone, True)
        assert abs(lon[0] - r.lon) < 1e-9 and abs(lat[0] - r.lat) < 1e-9
    on_meridian = rows[-1]
    assert (on_meridian.zone, on_meridian.epsg) == (21, 32621)
    assert on_meridian.x == pytest.approx(500000, abs=1e-6) and on_meridian.y == pytest.approx(10_000_000, abs=1e-6)
    # one degree of latitude near the equator on the central meridian
    one = spark.range(1).select(project(F.lit(-57.0), F.lit(-1.0), F.lit(21), F.lit(True))[1].alias("y")).first().y
    assert 10_000_000 - one == pytest.approx(110574.39 * 0.9996, abs=0.5)


def test_areas_and_centroid(spark):
    df = spark.createDataFrame([("s", SQUARE), ("h", HOLED), ("l", L_SHAPE)], RINGS)
    c = R.centroid("rings")
    rows = {r.id: r for r in df.select("id", R.planar_area("rings").alias("a"), R.geodesic_area_ha("rings").alias("ha"),
                                       c["lon"].alias("lon"), c["lat"].alias("lat")).collect()}
    assert rows["l"].a == pytest.approx(7) and (rows["l"].lon, rows["l"].lat) == pytest.approx((19 / 14, 19 / 14))
    assert rows["h"].a == pytest.approx(0.01 - 0.0016) and rows["h"].lon == pytest.approx(-55.95)
    side = np.radians(0.1) * 6378137
    assert rows["s"].ha == pytest.approx(side * side * np.cos(np.radians(12.95)) / 1e4, rel=1e-6)


def test_points_and_cells(spark):
    pts = [(x, y) for x in (0.5, 1.04, 2.0, 3.9, 4.06, -0.04) for y in (0.5, 1.04, 2.0, 3.96, 4.2)]
    df = spark.createDataFrame([(L_SHAPE, x, y) for x, y in pts], "rings array<array<array<double>>>, x double, y double")
    inside = F.expr(R.contains_point_sql("rings", "x", "y"))
    touch = F.expr(R.touches_cell_sql("rings", "x", "y", "0.05D"))
    for r in df.select("x", "y", inside.alias("i"), touch.alias("t")).collect():
        assert r.i == (0 < r.x < 4 and 0 < r.y < 1 or 0 < r.x < 1 and 0 < r.y < 4)
        grown = (-.05 <= r.x <= 4.05 and -.05 <= r.y <= 1.05) or (-.05 <= r.x <= 1.05 and -.05 <= r.y <= 4.05)
        assert r.t == grown, (r.x, r.y)
    hole = spark.createDataFrame([(HOLED, -55.95, -12.95), (HOLED, -55.99, -12.95)], "rings array<array<array<double>>>, x double, y double")
    assert [r[0] for r in hole.select(inside).collect()] == [False, True]


def test_axis_repair_missing_geometry_and_aliases(spark):
    swapped = [[[p[1], p[0]] for p in SQUARE[0]]]
    df = spark.createDataFrame([("a", swapped, {"COD_IMOVEL": "X", "uf": "MT"}), ("b", SQUARE, {}), ("c", None, {})],
                               RINGS + ", attrs map<string,string>")
    rows = {r.id: r for r in P.read_attributes(P.normalize_features(df)).collect()}
    assert set(rows) == {"a", "b"} and rows["a"].rings == SQUARE == rows["b"].rings
    assert (rows["a"].attr_code, rows["a"].attr_state, rows["b"].attr_code) == ("X", "MT", None)


def test_largest_part_first_on_ties(spark):
    small = [[[p[0] / 2, p[1]] for p in SQUARE[0]]]
    shifted = [[[p[0] + 1, p[1]] for p in SQUARE[0]]]
    df = spark.createDataFrame([([small, SQUARE, shifted],)], "parts array<array<array<array<double>>>>")
    assert df.select(R.largest_part("parts")).first()[0] == SQUARE


def test_boundary_relations(spark):
    def square(x, y, s=0.4):
        x, y = float(x), float(y)
        return [[[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]]]
    shapes = [("in", square(.2, .2)), ("notch", square(2, 2)), ("cross", square(3.8, .3)), ("out", square(6, 6)),
              ("corner", square(.8, .8)), ("around", square(-1, -1, 9))]
    got = spatial.against_boundary(spark.createDataFrame(shapes, RINGS),
                                   spark.createDataFrame([("b", L_SHAPE)], RINGS))
    assert {r.id: r.relation for r in got.collect()} == {
        "in": "within", "notch": "outside", "cross": "crossing", "out": "outside", "corner": "crossing", "around": "crossing"}


def test_cells_join_equals_brute_force_with_crowded_bucket(spark, monkeypatch):
    from canopyflow.operators import skew
    rng = np.random.default_rng(4)
    parcels = []
    for i in range(12):
        cx, cy = rng.uniform(-56, -55.5, 2)
        cy -= -42.5
        angles = np.sort(rng.uniform(0, 2 * np.pi, 7))
        radius = rng.uniform(.01, .06, 7)
        ring = [[float(cx + r * np.cos(a)), float(cy + r * np.sin(a))] for a, r in zip(angles, radius)]
        parcels.append((f"p{i}", [ring + ring[:1]]))
    cells = [(int(i), float(x), float(y)) for i, (x, y) in enumerate(
        zip(rng.uniform(-56.05, -55.45, 1500), rng.uniform(-13.55, -12.95, 1500)))]
    cells += [(5000 + i, -55.75 + i * 1e-5, -13.25) for i in range(1000)]
    pf = spark.createDataFrame(parcels, RINGS).withColumns(R.bounds("rings"))
    cf = spark.createDataFrame(cells, "cell int, x double, y double")
    monkeypatch.setattr(skew.skew_join, "__defaults__", ("inner", 8, 50))
    pairs = spatial.cells_in_parcels(cf, pf, 0.004)
    got = {(r.cell, r.id) for r in pairs.select("cell", "id").collect()}
    assert pairs.count() == len(got)
    every = cf.crossJoin(pf).where(F.expr(R.touches_cell_sql("rings", "x", "y", "0.002D")))
    assert got == {(r.cell, r.id) for r in every.select("cell", "id").collect()} and len(got) > 50


def test_reference_grid_is_capped(spark):
    df = spark.createDataFrame([("s", SQUARE)], RINGS)
    fine = P.grid_for_parcel(df).first()
    assert (fine.zone, fine.epsg, fine.res) == (21, 32721, 20.0) and 1 <= max(fine.width, fine.height) <= 1024
    assert fine.width * fine.res == pytest.approx(10_850, rel=.01) and fine.height * fine.res == pytest.approx(11_070, rel=.01)
    coarse = P.grid_for_parcel(df, max_side=100).first()
    assert coarse.res % 10 == 0 and max(coarse.width, coarse.height) <= 100


def test_pixels_follow_a_coarser_grid(spark):
    sides = {1: 1085, 2: 40}  # cells of 10 m
    grids = spark.createDataFrame([(1, 20.0, 543, 543), (2, 10.0, 40, 40)], "parcel_id int, res double, width int, height int")
    bands = spark.createDataFrame([(p, n) for p, n in sides.items()], "parcel_id int, n int").select(
        "parcel_id", F.lit(7).alias("scene_id"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("px"), "n").select(
        "parcel_id", "scene_id", "px", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("py")).withColumns(
        {"b04": F.when(F.col("px") != 3, F.col("px")), "b08": F.col("py"), "scl": (F.col("px") + F.col("py")) % 7})
    placed = pixels.on_grid(bands, grids).cache()
    seen = {r.parcel_id: r for r in placed.groupBy("parcel_id").agg(
        F.count("*").alias("n"), F.max("px").alias("px"), F.max("py").alias("py"), F.sum("b08").alias("b08")).collect()}
    # as many cells as the grid has, so areas by res * res are right
    assert (seen[1].n, seen[1].px, seen[1].py) == (543 * 543, 542, 542)
    assert (seen[2].n, seen[2].px, seen[2].py, seen[2].b08) == (1600, 39, 39, 40 * 780)
    cells = {(r.px, r.py): (r.b04, r.b08, r.scl) for r in placed.where("parcel_id = 1 and px < 2 and py < 2").collect()}
    assert cells[0, 0] == (.5, .5, 0) and cells[1, 1] == (2.0, 2.5, 4)
    placed.unpersist()


def test_request_and_area_checks(spark):
    req = spark.createDataFrame([("Polygon", 50, 140, 2.0), ("MultiPolygon", 50, 140, 2.0), (None, 50, 140, 2.0),
                                 ("Polygon", 101, 140, 2.0), ("Polygon", 50, 250, 2.0), ("Polygon", 50, 8, 0.05)],
                                "geometry_type string, cloud_max int, max_scenes int, min_area_ha double")
    assert [r.reason for r in P.request_reason(req).collect()] == [None, "geometry", "geometry", "cloud_max", None, "max_scenes"]
    assert [r.reason for r in P.request_reason(req, zoning=True).collect()] == [
        None, None, "geometry", "cloud_max", "max_scenes", "min_area_ha"]
    areas = spark.createDataFrame([(9.9,), (10.0,), (200000.0,), (200001.0,)], "a double")
    assert [r.s for r in areas.select(P.area_status(F.col("a")).alias("s")).collect()] == ["too_small", None, None, "too_large"]
