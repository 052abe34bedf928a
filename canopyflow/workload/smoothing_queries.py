"""Queries over regular grids, smoothing and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopyflow import constants as K
from canopyflow.functions.savgol import coefficients
from canopyflow.operators import calibration, profiles, ranking, scenes, smoothing
from canopyflow.sources.curves import literature_curves
from canopyflow.workload import series_sql as S
from canopyflow.workload import views as V
from canopyflow.workload.registry import query
from canopyflow.workload.series_queries import KEYS, observations, profile

# Scenes of the second half of each 97 days move to the day before it, so that real gaps of more than 40 days exist.
OPEN_DAYS = "greatest(0, dayofyear({d}) % 97 - 44)"


def sparse(spark, sf):
    moved = F.expr(f"CAST(date_sub(obs_date, CAST({OPEN_DAYS.format(d='obs_date')} AS int)) AS date)")
    raw = V.raw_observations(spark, sf).withColumn("obs_date", moved)
    return scenes.best_per_day(raw, KEYS, ["scene_ord", "ndvi_e4"])


_SPARSE = V.RAW_OBS + f""",
moved AS (SELECT * REPLACE (obs_date - CAST({OPEN_DAYS.format(d='obs_date')} AS INT) AS obs_date) FROM raw_obs),
sparse AS (SELECT * FROM moved QUALIFY row_number() OVER (PARTITION BY series_id, obs_date ORDER BY cloud, scene_ord, ndvi_e4) = 1)"""
_GRID = _SPARSE + """,
daily AS (SELECT series_id, obs_date, ndvi_e4 / 1 / 10000.0::DOUBLE AS ndvi FROM sparse),
spans AS (SELECT series_id, min(obs_date) AS d0, max(obs_date) AS d1 FROM daily GROUP BY 1 HAVING count(*) >= 4),
grid AS (SELECT series_id, CAST(i AS INT) AS grid_i, d0 + CAST(i * 10 AS INT) AS day
  FROM (SELECT *, unnest(range((d1 - d0) // 10 + 1)) AS i FROM spans))"""
_AROUND = _GRID + """,
around AS (SELECT g.*, p.obs_date AS px, p.ndvi AS py, q.obs_date AS qx, q.ndvi AS qy FROM grid g
  ASOF JOIN daily p ON p.series_id = g.series_id AND g.day >= p.obs_date
  ASOF JOIN daily q ON q.series_id = g.series_id AND g.day <= q.obs_date)"""
_VALUES = _AROUND + """,
valued AS (SELECT series_id, grid_i, day, CASE WHEN day - px <= 40 AND qx - day <= 40 THEN
  CASE WHEN day = px THEN py WHEN day = qx THEN qy ELSE (qy - py) / (qx - px) * (day - px) + py END END AS value FROM around)"""


def _dot(row, cols):
    return " + ".join(f"({float(w)!r}::DOUBLE * {c})" for w, c in zip(row, cols))


def _smooth_sql() -> str:
    table = coefficients(7, 2)
    name = {k: ("filled" if k == 0 else f"t{k + 7}") for k in range(-6, 7)}
    shifts = ", ".join(f"{'lag' if k < 0 else 'lead'}(filled, {abs(k)}) OVER w AS {name[k]}" for k in range(-6, 7) if k)
    whens = " ".join(f"WHEN grid_i = {r} THEN {_dot(table[r], [name[j - r] for j in range(7)])}" for r in range(3))
    whens += " " + " ".join(f"WHEN grid_i = n_grid - 1 - {r} THEN {_dot(table[6 - r], [name[j - 6 + r] for j in range(7)])}"
                            for r in range(3))
    middle = _dot(table[3], [name[j - 3] for j in range(7)])
    return f""",
edges AS (SELECT *, max(CASE WHEN value IS NOT NULL THEN grid_i END) OVER (PARTITION BY series_id ORDER BY grid_i) AS pi,
  min(CASE WHEN value IS NOT NULL THEN grid_i END) OVER (PARTITION BY series_id ORDER BY grid_i DESC) AS qi,
  count(*) OVER (PARTITION BY series_id) AS n_grid, count(value) OVER (PARTITION BY series_id) AS n_valid FROM valued),
bridged AS (SELECT e.*, coalesce(e.value, CASE WHEN e.qi IS NULL THEN p.value WHEN e.pi IS NULL THEN q.value
    ELSE (q.value - p.value) / (e.qi - e.pi) * (e.grid_i - e.pi) + p.value END) AS filled FROM edges e
  LEFT JOIN valued p ON p.series_id = e.series_id AND p.grid_i = e.pi
  LEFT JOIN valued q ON q.series_id = e.series_id AND q.grid_i = e.qi),
shifted AS (SELECT *, {shifts} FROM bridged WINDOW w AS (PARTITION BY series_id ORDER BY grid_i)),
smoothed AS (SELECT series_id, grid_i, day AS grid_date, {S.half_up('value', 4)} AS ndvi_raw,
  {S.half_up(f"CASE WHEN value IS NOT NULL THEN CASE WHEN n_valid >= 7 THEN CASE {whens} ELSE {middle} END ELSE value END END", 4)}
    AS ndvi_smooth FROM shifted)"""


_SMOOTHED = _VALUES + _smooth_sql()


@query("f2_date_grid", f"WITH {_GRID} SELECT series_id, grid_i, day FROM grid")
def f2(spark, sf):
    daily = smoothing.daily_values(sparse(spark, sf), KEYS)
    return smoothing.grid_dates(daily, KEYS).select("series_id", "grid_i", "day")


@query("w3_grid_neighbours", f"WITH {_AROUND} SELECT series_id, grid_i, px AS before_date, py AS before_ndvi, qx AS after_date, "
       "qy AS after_ndvi FROM around")
def w3(spark, sf):
    points = smoothing.neighbours(smoothing.daily_values(sparse(spark, sf), KEYS), KEYS)
    return points.select("series_id", "grid_i", F.col("before.obs_date").alias("before_date"),
                         F.col("before.ndvi").alias("before_ndvi"), F.col("after.obs_date").alias("after_date"),
                         F.col("after.ndvi").alias("after_ndvi"))


@query("w4_grid_interpolation", f"WITH {_VALUES} SELECT series_id, grid_i, value FROM valued")
def w4(spark, sf):
    points = smoothing.neighbours(smoothing.daily_values(sparse(spark, sf), KEYS), KEYS)
    return smoothing.interpolate(points).select("series_id", "grid_i", "value")


@query("w5_smoothed_series", f"WITH {_SMOOTHED} SELECT series_id, grid_date, ndvi_raw, ndvi_smooth FROM smoothed")
def w5(spark, sf):
    return (smoothing.regularize(sparse(spark, sf), KEYS)
            .select("series_id", "grid_date", "ndvi_raw", "ndvi_smooth"))


@query("f20_smoothed_monthly_mean", f"""WITH {_SMOOTHED} SELECT series_id, CAST(month(grid_date) AS INT) AS month,
  CAST(sum(floor(ndvi_smooth * 10000 + 0.5)) AS DOUBLE) / count(*) / 10000.0::DOUBLE AS ndvi FROM smoothed
  WHERE ndvi_smooth IS NOT NULL GROUP BY 1, 2""")
def f20(spark, sf):
    return smoothing.monthly_means(smoothing.regularize(sparse(spark, sf), KEYS), KEYS)


_REF_CURVE = "[" + ", ".join(f"{v}::DOUBLE" for v in K.LITERATURE_CURVES[0][2]) + "]"


@query("j4_j5_chart_rows", f"""WITH {_SMOOTHED} SELECT coalesce(o.series_id, s.series_id) AS series_id,
  coalesce(o.obs_date, s.grid_date) AS date, o.ndvi_e4 / 10000.0::DOUBLE AS ndvi, s.ndvi_smooth,
  {_REF_CURVE}[CAST(month(coalesce(o.obs_date, s.grid_date)) AS INT)] AS reference
  FROM sparse o FULL JOIN smoothed s ON s.series_id = o.series_id AND s.grid_date = o.obs_date""")
def j4(spark, sf):
    obs = sparse(spark, sf)
    seen = obs.select("series_id", "obs_date", (F.col("ndvi_e4") / 10000.0).alias("ndvi"))
    return smoothing.chart_rows(seen, smoothing.regularize(obs, KEYS), literature_curves(spark), KEYS)


@query("u2_date_axis", f"""WITH {_GRID} SELECT series_id, obs_date AS date FROM sparse UNION SELECT series_id, day FROM grid""")
def u2(spark, sf):
    obs = sparse(spark, sf)
    return smoothing.date_axis(obs, smoothing.regularize(obs, KEYS), KEYS)


# ---- calibration -------------------------------------------------------------------------
CLASSES = [c for c, _, _ in K.LITERATURE_CURVES]
_CLASS_OF = "['" + "', '".join(CLASSES[:3] + ["outra_lavoura"] + CLASSES[4:]) + "'][CAST(series_id // 10000 % 5 + 1 AS INT)]"


def labelled(spark, sf):
    names = F.array(*[F.lit(c) for c in [*CLASSES[:3], "outra_lavoura", *CLASSES[4:]]])
    return profile(spark, sf).withColumn("class", F.get(names, (F.expr("series_id div 10000") % 5).cast("int")))


_REASON = f"""CASE WHEN class NOT IN ({", ".join(f"'{c}'" for c in CLASSES)}) THEN 'unknown_class'
  WHEN n_obs < 8 THEN 'too_short' WHEN {" + ".join(f"(m{m} IS NOT NULL)::INT" for m in S.MONTHS)} < 6 THEN 'few_months' END"""
_SAMPLES = S.PROFILE + f""",
labelled AS (SELECT *, {_CLASS_OF} AS class FROM profile),
samples AS (SELECT * FROM labelled WHERE {_REASON} IS NULL)"""
_CURVES = _SAMPLES + f""",
calibrated AS (SELECT class, count(*) AS n_samples, {", ".join(
    f"floor(CAST(sum(floor(m{m} * 1e7::DOUBLE + 0.5::DOUBLE)) AS DOUBLE) / count(m{m}) / 1e7::DOUBLE * 1000 + 0.5) / 1000.0::DOUBLE AS m{m}"
    for m in S.MONTHS)} FROM samples GROUP BY 1)"""


@query("p6_sample_checks", f"WITH {S.PROFILE}, labelled AS (SELECT *, {_CLASS_OF} AS class FROM profile) "
       f"SELECT series_id, class, {_REASON} AS reason FROM labelled")
def p6_samples(spark, sf):
    return labelled(spark, sf).select("series_id", "class", calibration.sample_reason(8).alias("reason"))


def samples(spark, sf):
    return calibration.build_samples(labelled(spark, sf), "2024-01-01 00:00:00")[0]


@query("a10_calibrated_curves", f"WITH {_CURVES} SELECT class, n_samples, {S.ALL} FROM calibrated")
def a10(spark, sf):
    curves = calibration.mean_curves(samples(spark, sf), literature_curves(spark))
    return curves.select("class", "n_samples", *[F.get("monthly", F.lit(m - 1)).alias(f"m{m}") for m in S.MONTHS])


@query("j6_reference_curves", f"""WITH {_CURVES}, {S.curves_values("lit")} SELECT curve_class AS class, coalesce(n_samples, 0) AS n_samples,
  CASE WHEN n_samples IS NULL THEN 'literatura' ELSE 'calibrada' END AS source, {", ".join(f"coalesce(m{m}, b{m}) AS m{m}" for m in S.MONTHS)}
  FROM lit LEFT JOIN calibrated ON class = curve_class""")
def j6(spark, sf):
    literature = literature_curves(spark)
    curves = calibration.reference_curves(literature, calibration.mean_curves(samples(spark, sf), literature))
    return curves.select("class", "n_samples", "source",
                         *[F.get("monthly", F.lit(m - 1)).alias(f"m{m}") for m in S.MONTHS])


@query("j16_delete_samples", f"""WITH {_SAMPLES} SELECT class, count(*) AS n FROM samples WHERE NOT (m1 > 0.5 AND class = 'soja_unica')
  GROUP BY 1""")
def j16(spark, sf):
    stored = samples(spark, sf)
    gone = stored.where((F.get("monthly", F.lit(0)) > 0.5) & (F.col("class") == "soja_unica")).select("sample_id")
    return calibration.delete_samples(stored, gone).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@query("p16_list_samples", f"WITH {_SAMPLES} SELECT class, n_obs AS n_dates, m4 AS april FROM samples")
def p16(spark, sf):
    return calibration.list_samples(samples(spark, sf)).select("class", "n_dates", F.get("monthly", F.lit(3)).alias("april"))


@query("w6_ranking_with_calibrated_curves", f"""WITH {_CURVES}, {S.curves_values("lit")}, curves AS (SELECT curve_ord, curve_class,
  curve_label, {", ".join(f"coalesce(m{m}, b{m}) AS b{m}" for m in S.MONTHS)} FROM lit LEFT JOIN calibrated ON class = curve_class),
  {S.filled()}, {S.warped("filled", "series_id")}, {S.ranked("series_id")} SELECT series_id, best_class, best_similarity, margin FROM best""")
def w6_calibrated(spark, sf):
    literature = literature_curves(spark)
    curves = calibration.reference_curves(literature, calibration.mean_curves(samples(spark, sf), literature))
    df = ranking.rank_curves(profiles.fill_profile(profile(spark, sf)), curves)
    return df.select("series_id", F.col("best.class").alias("best_class"),
                     F.col("best.similarity").alias("best_similarity"), "margin")


