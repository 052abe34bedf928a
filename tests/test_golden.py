"""Golden curves: classes, confidence, ranking, smoothing grid, calibration."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from canopyflow.operators import profiles, ranking, rules, smoothing
from canopyflow.plans.calibration import calibrate
from canopyflow.plans.parcel_analysis import analyze_observations
from canopyflow.sources.curves import literature_curves

KEYS = ["series_id"]


def test_rules_and_classes(golden):
    rows = {r.series_id: r for r in rules.classify(profiles.monthly_profile(golden, KEYS)).collect()}
    assert (rows["corn2"]["class"], rows["corn2"].confidence, rows["corn2"].met_weight) == ("milho_safrinha", 1.0, 10)
    assert (rows["pasture"]["class"], rows["pasture"].confidence) == ("perene", 0.1)
    assert (rows["soy"]["class"], rows["soy"].confidence) == ("soja_unica", 0.4)
    assert all(r.available_weight == 10 for r in rows.values())


EXPECTED_RANKING = {
    "corn2": [("milho_safrinha", .0158, 0), ("algodao", .0875, .07), ("milho_1a_safra", .0883, 1.8),
              ("soja_unica", .1017, 1.6), ("pastagem", .13, .57)],
    "corn1": [("milho_1a_safra", .01, -.62), ("soja_unica", .035, -.69), ("milho_safrinha", .1133, -1.8),
              ("pastagem", .1667, -1.4), ("algodao", .1767, -1.88)],
    "soy": [("soja_unica", .0167, 0), ("milho_1a_safra", .0408, .07), ("milho_safrinha", .0992, -1.6),
            ("algodao", .145, -1.8), ("pastagem", .1917, -1.12)],
}


@pytest.mark.parametrize("native", [False, True])
def test_ranking(spark, golden, native):
    filled = profiles.fill_profile(profiles.monthly_profile(golden, KEYS))
    ranked = ranking.rank_curves(filled, literature_curves(spark), native=native)
    rows = {r.series_id: r for r in ranked.collect()}
    for name, expected in EXPECTED_RANKING.items():
        found = [(e["class"], e.distance_e4 / 1e4, e.offset_months) for e in rows[name].ranking]
        assert [f[0] for f in found] == [e[0] for e in expected]
        for f, e in zip(found, expected):
            assert f[1] == pytest.approx(e[1], abs=1.01e-4) and f[2] == pytest.approx(e[2], abs=0.0101)
    assert rows["corn2"].margin == pytest.approx(.0717, abs=1e-4)
    assert rows["corn1"].margin == pytest.approx(.025, abs=1e-4)
    assert rows["soy"].margin == pytest.approx(.0241, abs=1e-4)


def test_smoothing_grid(golden_dense):
    rows = smoothing.regularize(golden_dense.where("series_id = 'corn2'"), KEYS).orderBy("grid_i").collect()
    assert len(rows) == 36 and str(rows[0].grid_date) == "2025-09-05"
    assert (rows[-1].grid_date - rows[0].grid_date).days == 350
    assert all(r.ndvi_smooth is not None for r in rows)


def test_calibrating_one_sample(spark, golden_dense):
    labels = spark.createDataFrame([("corn2", "milho_safrinha", "2025/26")], "series_id string, class string, season string")
    result = calibrate(golden_dense, labels, KEYS, literature_curves(spark), "2026-09-01 00:00:00")
    curves = {r["class"]: r for r in result.curves.collect()}
    own = curves["milho_safrinha"]
    assert (own.n_samples, own.source) == (1, "calibrada")
    assert own.monthly == [.80, .42, .72, .86, .80, .55, .38, .30, .28, .30, .60, .82]
    assert sum(c.source == "literatura" for c in curves.values()) == 4
    assert result.samples.first().season == "2025/26"


def test_full_analysis_row(spark, golden):
    done = analyze_observations(golden, KEYS, literature_curves(spark), as_of="2026-08-20", min_dates=6)
    rows = {r.series_id: r for r in done.collect()}
    corn = rows["corn2"]
    assert corn.final_class == "milho_safrinha" and corn.status == "ok" and not corn.in_progress
    assert len(corn.rules) == 6 and len(corn.stages) == 5 and all(s.ok is not None for s in corn.stages)
    assert corn.verdict.startswith("Milho safrinha") and "Pico milho (mar–mai): 0.86" in corn.summary


def test_cotton_overrides_corn(spark):
    curve = [0.55, 0.70, 0.85, 0.90, 0.80, 0.55, 0.35, 0.30, 0.28, 0.30, 0.35, 0.45]
    rows = [("c", m, round(v * 10000)) for m, v in zip(range(1, 13), curve)]
    obs = spark.createDataFrame(rows, "series_id string, m int, ndvi_e4 bigint").select(
        "series_id", F.make_date(F.lit(2026), "m", F.lit(15)).alias("obs_date"), "ndvi_e4")
    row = analyze_observations(obs, KEYS, literature_curves(spark), as_of="2027-01-01").first()
    assert row["class"] == "provavel_safrinha" and row.final_class == "algodao" and row.warp_override
    assert row.final_confidence == pytest.approx(min(0.95, 0.7 * row.confidence + 0.3), abs=1e-3)
    assert "DTW: algodao superou milho (margem 0." in row.summary


def test_summer_peak_is_settled_by_the_curves(spark):
    # maize of the first season, too wet from March on for the rules
    curve = {9: .30, 10: .55, 11: .66, 12: .69, 1: .68, 2: .72, 3: .65, 4: .62, 5: .62, 6: .60, 7: .60, 8: .35}
    rows = [("s", m, round(v * 10000)) for m, v in curve.items()]
    obs = spark.createDataFrame(rows, "series_id string, m int, ndvi_e4 bigint").select(
        "series_id", F.make_date(F.lit(2026), "m", F.lit(15)).alias("obs_date"), "ndvi_e4")
    row = analyze_observations(obs, KEYS, literature_curves(spark), as_of="2027-01-01").first()
    assert row["class"] == "pico_verao"
    expected = row.best["class"] if row.best["class"] in ("milho_1a_safra", "soja_unica") else "pico_verao"
    assert row.final_class == expected and row.tie_break == (expected != "pico_verao")
