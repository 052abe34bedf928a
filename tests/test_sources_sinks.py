"""Readers, stores and writers."""

from __future__ import annotations

import datetime as dt
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopyflow.operators import calibration, images, profiles
from canopyflow.sinks import files
from canopyflow.sources import geojson, samples
from canopyflow.sources.curves import literature_curves, providers
from canopyflow.sources.images import read_photos


def feature(kind, coordinates, **properties):
    return {"type": "Feature", "geometry": {"type": kind, "coordinates": coordinates}, "properties": properties}


RING = [[-56.123456, -13.0], [-56.0, -13.0], [-56.0, -12.987654], [-56.123456, -13.0]]


def test_geojson_reader_rejects_and_compacts(spark, tmp_path):
    (tmp_path / "ok.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [
        feature("Polygon", [RING], nome="A", other="x"), feature("MultiPolygon", [[RING], [RING]], codarea="7")]}))
    (tmp_path / "empty.geojson").write_text('{"type":"FeatureCollection","features":[]}')
    (tmp_path / "point.geojson").write_text('{"type":"Point","coordinates":[1,2]}')
    (tmp_path / "page.geojson").write_text("<html></html>")
    good, bad = geojson.read_collections(spark, str(tmp_path))
    reasons = {r.file.rsplit("/", 1)[1]: r.reason for r in bad.collect()}
    assert reasons == {"empty.geojson": "empty", "point.geojson": "not_a_collection", "page.geojson": "not_geojson"}
    rows = good.orderBy("ord").collect()
    assert [len(r.parts) for r in rows] == [1, 2]
    slim = geojson.compact(good)
    first = slim.orderBy("ord").first()
    assert first.digits == 4 and first.parts[0][0][0] == [-56.1235, -13.0] and first.properties == {"nome": "A"}
    assert geojson.compact(good, heavy_bytes=10).orderBy("ord").first().parts[0][0][0] == [-56.123, -13.0]
    doc = json.loads(files.compacted_collections(slim).first().geojson)
    assert [f["geometry"]["type"] for f in doc["features"]] == ["Polygon", "MultiPolygon"]
    assert doc["features"][1]["properties"] == {"codarea": "7"}


def write_png(path, rgb):
    def chunk(tag, data):
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))
    h, w, _ = rgb.shape
    raw = b"".join(b"\0" + row.astype(np.uint8).tobytes() for row in rgb)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0))
                     + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_photo_folder(spark, tmp_path):
    rng = np.random.default_rng(0)
    pictures = {}
    for label in ("milho", "algodao"):
        (tmp_path / label).mkdir()
        for i in range(2):
            pictures[label, f"{i}.png"] = rng.integers(0, 256, (20 + i, 30, 3))
            write_png(tmp_path / label / f"{i}.png", pictures[label, f"{i}.png"])
    (tmp_path / "milho" / "broken.png").write_bytes(b"not an image")
    (tmp_path / "milho" / "notes.txt").write_text("skip me")
    good, bad = read_photos(spark, str(tmp_path))
    assert [(r["class"], r.file) for r in bad.collect()] == [("milho", "broken.png")]
    from_files = {(r["class"], r.file): r for r in images.file_features(good).collect()}
    assert from_files.keys() == pictures.keys()
    pixels = [(f"{c}/{f}", int(x), int(y), *map(int, rgb[y, x])) for (c, f), rgb in pictures.items()
              for y, x in np.ndindex(rgb.shape[:2])]
    table = spark.createDataFrame(pixels, "image_id string, x bigint, y bigint, r int, g int, b int")
    for r in images.photo_features(table).collect():
        twin = from_files[tuple(r.image_id.split("/"))]
        for name in images.FEATURES:
            assert r[name] == twin[name], name
    summary = {r["class"]: r for r in images.class_summary(images.file_features(good)).collect()}
    assert summary["milho"].n == 2
    out = tmp_path / "features"
    files.write_csv(images.file_features(good), str(out))
    assert spark.read.option("header", True).csv(str(out)).count() == 4


def test_large_photo_is_reduced_first():
    row = images.image_row(np.full((1030, 600, 3), 128), max_side=512)
    assert row["r_mean"] == pytest.approx(128 / 255, abs=1e-5) and row["glcm_homogeneity"] == 1.0


def test_large_photo_counts_every_pixel(monkeypatch):
    rgb = np.full((1030, 601, 3), 100, np.uint8)
    rgb[-1, :, 0], rgb[:, -1, 1] = 255, 255  # the last row and column belong to no full block
    row = images.image_row(rgb)
    assert row["r_mean"] == pytest.approx((1029 * 100 + 255) / 1030 / 255, abs=1e-5)
    assert row["g_mean"] == pytest.approx((600 * 100 + 255) / 601 / 255, abs=1e-5)
    monkeypatch.setattr(images, "BLOCK_PIXELS", 5)
    assert images.image_row(rgb[:40]) == images.image_row(rgb[:40].copy(order="F")) and images.image_row(rgb)["r_std"] == row["r_std"]
    small = images._reduced(rgb, 512)
    assert small.shape == (344, 201, 3) and small[-1, 0, 0] == 255 and small[0, -1, 1] == 255 and (small[:-1, :, 0] == 100).all()
    one = images.image_row(rgb[:, :1])
    assert one["glcm_contrast"] is None and one["b_mean"] == row["b_mean"]
    assert set(images.image_row(rgb[:0]).values()) == {None}


def test_sample_store(spark, golden_dense, tmp_path):
    path = str(tmp_path / "store")
    assert samples.read_samples(spark, path).count() == 0
    assert {r.source for r in samples.current_curves(spark, path).collect()} == {"literatura"}
    profile = profiles.monthly_profile(golden_dense, ["series_id"])
    kinds = F.create_map(*[F.lit(v) for v in ("corn2", "milho_safrinha", "soy", "soja_unica", "pasture", "trigo", "corn1", "milho_1a_safra")])
    good, bad = calibration.build_samples(profile.withColumn("class", kinds[F.col("series_id")]).withColumn(
        "geometry", F.lit("{}")), "2026-09-01 00:00:00")
    assert [(r.series_id, r.reason) for r in bad.collect()] == [("pasture", "unknown_class")]
    samples.add_samples(good, path)
    samples.add_samples(good, path)  # a repeated append changes nothing
    stored = samples.read_samples(spark, path)
    assert stored.count() == 3 and "geometry" not in calibration.list_samples(stored).columns
    samples.remove_samples(stored.where(F.col("class") == "soja_unica"), path)
    curves = {r["class"]: r.source for r in samples.current_curves(spark, path).collect()}
    assert sorted(c for c, s in curves.items() if s == "calibrada") == ["milho_1a_safra", "milho_safrinha"]


def test_calibration_fills_months_from_literature(spark):
    rows = [("soja_unica", [0.5] * 6 + [None] * 6), ("soja_unica", [0.7] + [None] * 11), ("cevada", [0.1] + [None] * 11)]
    df = spark.createDataFrame(rows, "class string, monthly array<double>")
    got = {r["class"]: r for r in calibration.mean_curves(df, literature_curves(spark)).collect()}
    assert got["soja_unica"].monthly == [0.6] + [0.5] * 5 + [0.25, 0.25, 0.26, 0.35, 0.60, 0.82]
    assert got["cevada"].monthly == [0.1] + [0.3] * 11 and got["soja_unica"].n_samples == 2
    final = calibration.reference_curves(literature_curves(spark), calibration.mean_curves(df, literature_curves(spark)))
    assert "cevada" not in {r["class"] for r in final.collect()}


def test_providers(spark):
    assert [r.provider for r in providers(spark, only_active=True).collect()] == ["sentinel2"]
    assert providers(spark, active={"planetscope": True}, only_active=True).count() == 2


def test_feature_collections(spark, tmp_path):
    rows = [(1, "mata", 5, 1, "Mata", "#1", 2.0, [RING]), (1, "milho_safrinha", 1, 2, "Milho", "#2", 3.0, [RING]),
            (1, "milho_safrinha", 1, 3, "Milho", "#2", 9.0, [RING])]
    df = spark.createDataFrame(rows, "parcel_id bigint, class string, class_ord int, region_id bigint, label string, "
                                     "colour string, area_ha double, rings array<array<array<double>>>")
    files.write_feature_collections(df, str(tmp_path / "geo"))
    doc = json.loads(spark.read.text(str(tmp_path / "geo")).first().value)
    assert [(f["properties"]["class"], f["properties"]["area_ha"]) for f in doc["features"]] == [
        ("milho_safrinha", 9.0), ("milho_safrinha", 3.0), ("mata", 2.0)]
    assert doc["features"][0]["geometry"]["coordinates"][0][0] == RING[0]


def test_pixel_table_reads_only_its_window(spark, tmp_path):
    from canopyflow.sources.pixels import read_window, unusable_windows, without_windows, write_pixels
    rows = [(1, s, x, y, t, dt.date(2026, m, 5), "04.00", 4, 2000, 4000)
            for s, (t, m) in enumerate([("A", 1), ("A", 2), ("A", 3), ("B", 2)]) for x in range(4) for y in range(4)]
    rows += [(1, 9, x, 0, "A", dt.date(2026, 2, 6), "04.00", 4, 2000, 4000) for x in range(4)]
    rows += [(1, 8, x, x, "A", dt.date(2026, 2, 7), "04.00", 4, None, 4000) for x in range(4)]
    df = spark.createDataFrame(rows, "parcel_id bigint, scene_id bigint, px int, py int, tile string, obs_date date, "
                                     "baseline string, scl int, b04 int, b08 int")
    write_pixels(df, str(tmp_path / "px"))
    got = read_window(spark, str(tmp_path / "px"), "A", "2026-02-01", "2026-02-28", (1, 1, 2, 3))
    assert {(r.scene_id, r.px, r.py) for r in got.collect()} == {(1, x, y) for x in (1, 2) for y in (1, 2, 3)} | {(8, 1, 1), (8, 2, 2)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "PartitionFilters: []" not in scan and "PushedFilters: []" not in scan
    assert "month" in scan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    bad = unusable_windows(df)
    assert {(r.scene_id, r.reason) for r in bad.collect()} == {(9, "narrow_window"), (8, "missing_band")}
    assert {r.scene_id for r in without_windows(df, bad).collect()} == {0, 1, 2, 3}


def test_all_geometry_types_keep_their_coordinates(spark, tmp_path):
    p = [-56.1234567, 13.00005]
    line = [p, [1.0, 2.0, 3.99999]]
    kinds = {"Point": p, "MultiPoint": line, "LineString": line, "MultiLineString": [line, line], "Polygon": [RING],
             "MultiPolygon": [[RING], [RING]]}
    features = [feature(k, c, name=k) for k, c in kinds.items()]
    parts = [{"type": "Point", "coordinates": p}, {"type": "LineString", "coordinates": line}]
    features.append({"type": "Feature", "geometry": {"type": "GeometryCollection", "geometries": parts}, "properties": {}})
    features.append({"type": "Feature", "geometry": None, "properties": None})
    (tmp_path / "all.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    good, _ = geojson.read_collections(spark, str(tmp_path))

    def rounded(c, n):
        return [rounded(x, n) for x in c] if isinstance(c, list) else np.floor(c * 10 ** n + 0.5) / 10 ** n

    for heavy, n in ((None, 4), (10 ** 6, 4), (10, 3)):
        back = json.loads(files.compacted_collections(geojson.compact(good, heavy)).first().geojson)["features"]
        assert {f["geometry"]["type"]: f["geometry"]["coordinates"] for f in back[:6]} == {k: rounded(c, n) for k, c in kinds.items()}
        assert back[6]["geometry"]["geometries"] == [{**g, "coordinates": rounded(g["coordinates"], n)} for g in parts]
        assert back[7]["geometry"] is None and back[7]["properties"] == {}


def test_stored_pixels_are_read_once_and_only_where_chosen(spark, tmp_path, monkeypatch):
    from canopyflow.plans.parcel_analysis import select_scenes, series_from_pixels
    from canopyflow.sources import pixels as P
    rows = [(p, 10 * m + s, x, y, "AB"[p % 2], dt.date(2026, m, 5 + s), "04.00", 4, 2000, 3000 + 100 * m + s)
            for p in range(4) for m in range(1, 7) for s in (0, 1) for x in range(4) for y in range(4)]
    rows += [(0, 99, x, 0, "A", dt.date(2026, 2, 20), "04.00", 4, 2000, 4000) for x in range(12)]
    P.write_pixels(spark.createDataFrame(rows, "parcel_id bigint, scene_id bigint, px int, py int, tile string, obs_date date, "
                                               "baseline string, scl int, b04 int, b08 int"), str(tmp_path / "px"))
    scenes = [(p, 10 * m + s, "AB"[p % 2], dt.date(2026, m, 5 + s), 1.0 * s) for p in range(4) for m in (2, 5) for s in (0, 1)]
    scenes += [(0, 99, "A", dt.date(2026, 2, 20), 0.0), (3, 777, "B", dt.date(2026, 3, 1), 0.0)]
    listed = spark.createDataFrame(scenes, "parcel_id bigint, scene_id bigint, tile string, obs_date date, cloud double")
    chosen = select_scenes(listed, ["parcel_id"], ["scene_id"])
    found = []
    for most in (P.FEW_WINDOWS, 6, 0):  # windows are broadcast, then tiles and months (5 of them), then nothing
        monkeypatch.setattr(P, "FEW_WINDOWS", most)
        series = series_from_pixels(spark.read.parquet(str(tmp_path / "px")), chosen)
        plan = series._jdf.queryExecution().executedPlan().toString()
        scans = [line for line in plan.splitlines() if "FileScan" in line]
        assert len(scans) == 1 and ("dynamicpruning" in scans[0]) == (most > 0)
        found.append(sorted(tuple(r) for r in series.collect()))
    assert found[0] == found[1] == found[2]
    # a narrow window and a scene without pixels give no observation
    assert {r[:2] for r in found[0]} == {(p, 10 * m + s) for p in range(4) for m in (2, 5) for s in (0, 1)}
