"""Warping distance: Arrow form, SQL form and a plain loop agree."""

from __future__ import annotations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from canopyflow.functions.warp import register_sql_functions, warp_batch, warp_native, warp_sql, warp_to_curves
from canopyflow.operators import ranking
from canopyflow.sources.curves import literature_curves


def plain(a, b, band=3):
    inf = float("inf")
    cells = {(0, 0): (0.0, 0, 0)}
    for i in range(1, 13):
        for j in range(max(1, i - band), min(12, i + band) + 1):
            options = [cells.get(p, (inf, 0, 0)) for p in ((i - 1, j - 1), (i - 1, j), (i, j - 1))]
            best = min(options, key=lambda o: o[0])
            cells[i, j] = (abs(a[i - 1] - b[j - 1]) + best[0], best[1] + i - j, best[2] + 1)
    cost, shift, steps = cells[12, 12]
    return cost / 12, shift / steps


profile = st.lists(st.integers(0, 100).map(lambda v: v / 100), min_size=12, max_size=12)


@settings(max_examples=150, deadline=None)
@given(profile, profile)
def test_batch_equals_loop(a, b):
    cost, shift = warp_batch(np.array([a]), np.array([b]))
    assert (cost[0], shift[0]) == plain(a, b)


def test_all_forms_agree_on_random_profiles(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(0, 50, 12).astype(float).tolist(), [rng.integers(0, 50, 12).astype(float).tolist() for _ in range(i % 4)])
            for i in range(300)]
    rows += [(1000, None, [[0.0] * 12]), (1001, [1.0] * 12, None)]
    df = spark.createDataFrame(rows, "id int, a array<double>, curves array<array<double>>").repartition(5)
    got = {r.id: r.w for r in df.select("id", warp_to_curves("a", "curves").alias("w")).collect()}
    assert got[1000] is None and got[1001] is None
    for i, a, curves in rows[:300]:
        assert [(w.cost, w.shift) for w in got[i]] == [plain(a, b) for b in curves]
    pairs = df.where("id < 1000").select("id", "a", F.posexplode("curves").alias("k", "b"))
    for r in pairs.select("id", "k", warp_native("a", "b").alias("w")).collect():
        assert (r.w.cost, r.w.shift) == (got[r.id][r.k].cost, got[r.id][r.k].shift)


def test_sql_functions(spark):
    register_sql_functions(spark)
    row = spark.sql("SELECT warp_distance(a, a).cost AS c, cyclic_fill(b)[1] AS f FROM VALUES "
                    "(array_repeat(0.5D, 12), concat(array(1D, NULL, 3D), array_repeat(1D, 9))) AS t(a, b)").first()
    assert (row.c, row.f) == (0.0, 2.0)


def test_sql_form_takes_any_expression_and_band(spark):
    """Profiles may be expressions; they stand in the text once, so none is computed per cell."""
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(0, 9, 12).astype(float).tolist(), rng.integers(0, 9, 12).astype(float).tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, a array<double>, b array<double>").repartition(3)
    for band in (0, 1, 5, 12):
        text = warp_sql("transform(a, v -> v * 2)", "transform(b, v -> v + 1)", band)
        assert text.count("v * 2") == text.count("v + 1") == 1
        for r in df.select("id", F.expr(text).alias("w")).collect():
            _, a, b = rows[r.id]
            assert (r.w.cost, r.w.shift) == plain([v * 2 for v in a], [v + 1 for v in b], band)
    assert "v * 2" in warp_sql("transform(a, v -> v * 2)", "b").split("aggregate")[0]


def test_ranking_is_computed_once(spark, capsys):
    df = spark.createDataFrame([(1, [0.1] * 12), (2, None)], "series_id int, monthly array<double>")
    rows = ranking.ranking_rows(ranking.rank_curves(df, literature_curves(spark), native=True), ["series_id"])
    rows.explain("extended")
    assert capsys.readouterr().out.split("== Optimized")[1].split("== Physical")[0].count("array_sort") == 1
    assert {r.series_id for r in rows.collect()} == {1} and rows.count() == 5
