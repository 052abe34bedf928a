"""Queries over observation series: selection, profiles, rules, ranking, verdict."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopyflow import constants as K
from canopyflow.functions.numbers import half_up
from canopyflow.functions.warp import register_sql_functions
from canopyflow.operators import profiles, ranking, rules, scenes
from canopyflow.plans import parcel_analysis
from canopyflow.schemas import MONTH_COLS
from canopyflow.sources.curves import literature_curves
from canopyflow.workload import series_sql as S
from canopyflow.workload import views as V
from canopyflow.workload.registry import query

KEYS = ["series_id"]
RULES = list(K.RULE_WEIGHTS)


def observations(spark, sf):
    return scenes.best_per_day(V.raw_observations(spark, sf), KEYS, ["scene_ord", "ndvi_e4"])


def profile(spark, sf):
    return profiles.monthly_profile(observations(spark, sf), KEYS)


def classified(spark, sf):
    return rules.classify(profile(spark, sf))


def ranked(spark, sf, native=False):
    return ranking.rank_curves(profiles.fill_profile(profile(spark, sf)), literature_curves(spark), native=native)


# ---- sources and series filters ----------------------------------------------
@query("src7_ready_series", f"WITH {V.RAW_OBS} SELECT series_id, count(*) AS n_obs, sum(ndvi_e4)::BIGINT AS total_e4 "
       "FROM raw_obs GROUP BY series_id")
def src7(spark, sf):
    return V.raw_observations(spark, sf).groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n_obs"), F.sum("ndvi_e4").alias("total_e4"))


@query("w1_best_scene_per_day", f"WITH {V.OBS} SELECT series_id, obs_date, scene_ord, cloud, ndvi_e4 FROM obs")
def w1(spark, sf):
    return observations(spark, sf).select("series_id", "obs_date", "scene_ord", "cloud", "ndvi_e4")


@query("w2_thin_scenes", f"""WITH {V.OBS} SELECT series_id, obs_date, scene_ord FROM (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY obs_date) - 1 AS pos,
         ceil(count(*) OVER (PARTITION BY series_id) / 20.0) AS step FROM obs)
WHERE pos % step = 0""")
def w2(spark, sf):
    return scenes.thin_uniformly(observations(spark, sf), KEYS, 20).select("series_id", "obs_date", "scene_ord")


@query("w8_reference_scene", f"""WITH {V.RAW_OBS} SELECT series_id, obs_date, cloud, scene_ord FROM (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY (month(obs_date) IN (3, 4, 5)) DESC,
    cloud, obs_date, scene_ord) AS rn FROM raw_obs) WHERE rn = 1""")
def w8(spark, sf):
    return (scenes.reference_scene(V.raw_observations(spark, sf), KEYS, ["scene_ord"])
            .select("series_id", "obs_date", "cloud", "scene_ord"))


@query("t1_series_in_date_order", f"""WITH {V.OBS} SELECT series_id,
  string_agg(strftime(obs_date, '%Y%m%d') || ':' || ndvi_e4, ',' ORDER BY obs_date) AS series FROM obs GROUP BY 1""")
def t1(spark, sf):
    point = F.struct("obs_date", "ndvi_e4")
    return (observations(spark, sf).groupBy("series_id")
            .agg(F.sort_array(F.collect_list(point)).alias("points"))
            .select("series_id", F.array_join(F.transform("points", lambda p: F.concat(
                F.date_format(p["obs_date"], "yyyyMMdd"), F.lit(":"), p["ndvi_e4"].cast("string"))), ",")
                .alias("series")))


@query("a17_run_metadata", f"""WITH {V.OBS} SELECT r.series_id, r.found AS scenes_found, o.used AS scenes_processed,
  o.valid AS valid_dates FROM (SELECT series_id, count(*) AS found FROM raw_obs GROUP BY 1) r
  JOIN (SELECT series_id, count(*) AS used, count(*) FILTER (cloud < 70) AS valid FROM obs GROUP BY 1) o
  USING (series_id)""")
def a17(spark, sf):
    found, used = V.raw_observations(spark, sf), observations(spark, sf)
    return scenes.run_metadata(found, used, used.where(F.col("cloud") < 70), KEYS)


@query("p6_series_length_status", f"""WITH {V.OBS} SELECT series_id, part, n_obs, n_months,
  CASE WHEN n_obs < 6 THEN 'too_short' END AS analysis_reason,
  CASE WHEN n_obs < 8 THEN 'too_short' WHEN n_months < 6 THEN 'few_months' END AS calibration_reason
  FROM (SELECT series_id, scene_ord % 9 AS part, count(*) AS n_obs, count(DISTINCT month(obs_date)) AS n_months FROM obs GROUP BY 1, 2)""")
def p6(spark, sf):
    """Series cut into nine parts each, so that short ones exist."""
    parts = observations(spark, sf).withColumn("part", F.col("scene_ord") % 9)
    prof = profiles.monthly_profile(parts, [*KEYS, "part"])
    return (parcel_analysis.length_status(prof)
            .select("series_id", "part", "n_obs", F.col("n_months").cast("bigint").alias("n_months"),
                    "analysis_reason", "calibration_reason"))


_LOOSE = """loose AS (SELECT l_orderkey, l_suppkey AS series_id,
  CASE WHEN l_linenumber = 1 THEN 'n/a' WHEN l_linenumber = 2 THEN strftime(l_shipdate, '%Y-%m-%d') || 'T10:00:00Z'
       ELSE strftime(l_shipdate, '%Y-%m-%d') END AS date,
  CASE WHEN l_linenumber = 7 THEN 'abc' WHEN l_linenumber = 6 THEN NULL
       ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR) END AS ndvi FROM lineitem)"""


@query("p9_malformed_rows", f"""WITH {_LOOSE}, parsed AS (
  SELECT series_id, try_cast(substr(date, 1, 10) AS DATE) AS d, try_cast(ndvi AS DOUBLE) AS v FROM loose)
SELECT series_id, CASE WHEN d IS NULL THEN 'bad_date' WHEN v IS NULL THEN 'bad_value' END AS reject_reason,
  count(*) AS n, CAST(sum(floor(v * 10000 + 0.5)) AS BIGINT) AS total_e4 FROM parsed GROUP BY 1, 2""")
def p9(spark, sf):
    li = V.table(spark, sf, "lineitem")
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    loose = li.select(
        F.col("l_suppkey").alias("series_id"),
        F.when(F.col("l_linenumber") == 1, "n/a")
        .when(F.col("l_linenumber") == 2, F.concat(day, F.lit("T10:00:00Z"))).otherwise(day).alias("date"),
        F.when(F.col("l_linenumber") == 7, "abc").when(F.col("l_linenumber") == 6, F.lit(None))
        .otherwise(F.col("l_quantity").cast("int").cast("string")).alias("ndvi"))
    return (profiles.parse_observations(loose).groupBy("series_id", "reject_reason")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("ndvi_e4").alias("total_e4")))


@query("f1_date_parts", f"""WITH {V.RAW_OBS} SELECT series_id, min(obs_date) AS first_date,
  max(obs_date - first) AS max_days, CAST(sum(month(obs_date)) AS BIGINT) AS month_sum FROM (
  SELECT *, min(obs_date) OVER (PARTITION BY series_id) AS first FROM raw_obs) GROUP BY 1""")
def f1(spark, sf):
    raw = V.raw_observations(spark, sf)
    spans = raw.groupBy("series_id").agg(F.min("obs_date").alias("first_date"), F.max("obs_date").alias("last"),
                                         F.sum(F.month("obs_date")).alias("month_sum"))
    return spans.select("series_id", "first_date",
                        F.date_diff("last", "first_date").cast("bigint").alias("max_days"), "month_sum")


@query("f3_default_period", """SELECT series, start_date, end_date FROM (SELECT l_orderkey AS series,
  CASE WHEN l_linenumber <= 2 THEN DATE '2001-12-31' - INTERVAL 335 DAY
       WHEN l_linenumber <= 4 AND CAST(l_shipdate AS DATE) + 500 - CAST(l_shipdate AS DATE) > 400
         THEN CAST(l_shipdate AS DATE) + 500 - INTERVAL 12 MONTH
       ELSE CAST(l_shipdate AS DATE) END::DATE AS start_date,
  CASE WHEN l_linenumber <= 4 AND l_linenumber > 2 THEN CAST(l_shipdate AS DATE) + 500
       ELSE DATE '2001-12-31' END AS end_date FROM lineitem)""")
def f3(spark, sf):
    from canopyflow.functions.dates import default_period
    li = V.table(spark, sf, "lineitem")
    day = F.to_date("l_shipdate")
    given = li.select(F.col("l_orderkey").alias("series"),
                      F.when(F.col("l_linenumber") > 2, day).alias("s"),
                      F.when(F.col("l_linenumber").between(3, 4), F.date_add(day, 500)).alias("e"))
    first, last = default_period("s", "e", F.lit("2001-12-31").cast("date"), 335, max_days=400)
    return given.select("series", first.alias("start_date"), last.alias("end_date"))


@query("f4_season_year", """SELECT year(l_shipdate - INTERVAL 8 MONTH) AS season, month(l_shipdate) AS month,
  make_date(year(l_shipdate - INTERVAL 8 MONTH) + CASE WHEN month(l_shipdate) >= 9 THEN 0 ELSE 1 END,
            month(l_shipdate), 15) AS mid_month, count(*) AS n FROM lineitem GROUP BY 1, 2, 3""")
def f4(spark, sf):
    from canopyflow.functions.dates import season_mid_month, season_year
    li = V.table(spark, sf, "lineitem")
    return (li.groupBy(season_year("l_shipdate").cast("bigint").alias("season"),
                       F.month("l_shipdate").cast("bigint").alias("month"))
            .agg(F.count(F.lit(1)).alias("n"))
            .withColumn("mid_month", season_mid_month(F.col("season").cast("int"), F.col("month").cast("int"))))


# ---- profiles and rules ----------------------------------------------------------
@query("a2_monthly_profile", f"WITH {S.PROFILE} SELECT series_id, {S.ALL}, n_obs, last_date FROM profile")
def a2(spark, sf):
    return profile(spark, sf)


@query("a3_seasonal_features", f"""WITH {S.FEATURES} SELECT series_id, soy_peak, valley, corn_peak, after_peak,
  season_end, off_season, summer_peak FROM features""")
def a3(spark, sf):
    return classified(spark, sf).select("series_id", "soy_peak", "valley", "corn_peak", "after_peak",
                                        "season_end", "off_season", "summer_peak")


@query("a4_annual_amplitude", f"WITH {S.FEATURES} SELECT series_id, n_months, amplitude FROM features")
def a4(spark, sf):
    return classified(spark, sf).select("series_id", "n_months", "amplitude")


@query("a5_rule_score", f"""WITH {S.CLASSIFIED} SELECT series_id, available_weight, met_weight, confidence, reason
FROM classified""")
def a5(spark, sf):
    return classified(spark, sf).select("series_id", "available_weight", "met_weight", "confidence", "reason")


@query("f5_rule_predicates", f"WITH {S.CLASSIFIED} SELECT series_id, "
       + ", ".join(f"rule_{r}" for r in RULES) + " FROM classified")
def f5(spark, sf):
    return classified(spark, sf).select("series_id", *[f"rule_{r}" for r in RULES])


@query("f6_class_decision", f"WITH {S.CLASSIFIED} SELECT series_id, class, confidence FROM classified")
def f6(spark, sf):
    return classified(spark, sf).select("series_id", "class", "confidence")


@query("a5_rules_tall", f"""WITH {S.CLASSIFIED} SELECT name, weight, count(*) AS n,
  count(*) FILTER (met IS NOT NULL) AS available, count(*) FILTER (met) AS met FROM (
  {" UNION ALL ".join(f"SELECT '{r}' AS name, {w} AS weight, rule_{r} AS met FROM classified WHERE n_months >= 4"
                      for r, w in K.RULE_WEIGHTS.items())}) GROUP BY 1, 2""")
def a5_tall(spark, sf):
    rows = rules.rule_details(classified(spark, sf)).select(F.inline("rules"))
    return rows.groupBy("name", "weight").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("available").alias("available"), F.count_if("met").alias("met"))


_STAGE_SQL = [
    ("Entressafra / preparo de solo", "off_season", "off_season BETWEEN 0.20::DOUBLE AND 0.45::DOUBLE"),
    ("Pico da soja", "soy_peak", "soy_peak >= 0.65::DOUBLE"),
    ("Vale: colheita soja + plantio milho", "valley", "valley <= 0.55::DOUBLE"),
    ("Pico do milho safrinha", "corn_peak", "corn_peak >= 0.70::DOUBLE"),
    ("Senescência / colheita do milho", "season_end", "season_end <= corn_peak - 0.25::DOUBLE"),
]


@query("f8_growth_stages", f"WITH {S.CLASSIFIED} " + " UNION ALL ".join(
    f"SELECT series_id, '{n}' AS stage, {S.half_up(c, 2)} AS observed, {ok} AS ok FROM classified WHERE reason IS NULL"
    for n, c, ok in _STAGE_SQL))
def f8(spark, sf):
    staged = rules.stage_details(classified(spark, sf))
    return staged.select("series_id", F.inline("stages")).select("series_id", "stage", "observed", "ok")


_SUMMARY = " || ".join(
    f"'{lead}' || coalesce(printf('%.2f', {S.half_up(c, 2)}), '—')" for lead, c in (
        ("Pico soja (nov–jan): ", "soy_peak"), (" · Vale (jan–fev): ", "valley"),
        (" · Pico milho (mar–mai): ", "corn_peak"), (" · Jun–jul: ", "season_end"),
        (" · Amplitude: ", "amplitude"))) + " || '.'"


@query("f7_verdict_text", f"""WITH {S.CLASSIFIED} SELECT series_id, {S.verdict_case('class', 0)} AS verdict,
  {S.verdict_case('class', 1)} AS emoji,
  CASE reason WHEN 'few_months' THEN '{K.INSUFFICIENT_SUMMARY}' WHEN 'low_weight' THEN '{K.LOW_WEIGHT_SUMMARY}'
    ELSE {_SUMMARY} || CASE WHEN DATE '2001-07-15' - last_date < 45 AND month(last_date) <= 7
      THEN '{K.IN_PROGRESS_SUMMARY}' ELSE '' END END AS summary FROM classified""")
def f7(spark, sf):
    df = rules.in_progress(classified(spark, sf), F.lit("2001-07-15").cast("date"))
    return rules.verdict_texts(df).select("series_id", "verdict", "emoji", "summary")


@query("a27_season_in_progress", f"""WITH {S.CLASSIFIED} SELECT series_id, last_date,
  reason IS NULL AND DATE '2001-07-15' - last_date < 45 AND month(last_date) <= 7 AS in_progress FROM classified""")
def a27(spark, sf):
    df = rules.in_progress(classified(spark, sf), F.lit("2001-07-15").cast("date"))
    return df.select("series_id", "last_date", "in_progress")


_OVERRIDES = {
    "vigor_min": "CASE WHEN series_id % 3 = 0 THEN 0.8::DOUBLE ELSE 0.70::DOUBLE END",
    "soja_min": "CASE WHEN series_id % 3 = 1 THEN 0.9::DOUBLE ELSE 0.65::DOUBLE END",
}


@query("p10_threshold_overrides", f"WITH {S.FEATURES}, {S.classified(thr=_OVERRIDES)} "
       "SELECT series_id, class, confidence, "
       f"{_OVERRIDES['vigor_min']} AS vigor_min, {_OVERRIDES['soja_min']} AS soja_min FROM classified")
def p10(spark, sf):
    given = (F.when(F.col("series_id") % 3 == 0, F.create_map(
                 F.lit("vigor_min"), F.lit("0.8"), F.lit("soja_min"), F.lit("abc"), F.lit("other"), F.lit("1")))
             .when(F.col("series_id") % 3 == 1, F.create_map(F.lit("soja_min"), F.lit("0.9"))))
    df = rules.classify(profile(spark, sf).withColumn("overrides", given), "overrides")
    return df.select("series_id", "class", "confidence", "thr.vigor_min", "thr.soja_min")


# ---- warping and verdict -------------------------------------------------------------
@query("w10_cyclic_fill", f"WITH {S.PROFILE}, {S.filled()} SELECT series_id, "
       + ", ".join(f"f{m}" for m in S.MONTHS) + " FROM filled")
def w10(spark, sf):
    df = profiles.fill_profile(profile(spark, sf))
    return df.select("series_id", *[F.col("monthly")[m - 1].alias(f"f{m}") for m in S.MONTHS])


@query("j3_series_by_curves", f"WITH {S.PROFILE}, {S.curves_values()} SELECT series_id, curve_class AS class, "
       f"m1 - b1 AS january_gap FROM profile CROSS JOIN curves")
def j3(spark, sf):
    df = profile(spark, sf).withColumn("curves", ranking.curve_list(literature_curves(spark)))
    return (df.select("series_id", "m1", F.inline("curves"))
            .select("series_id", "class", (F.col("m1") - F.col("monthly")[0]).alias("january_gap")))


@query("f9_warp_distance", f"""WITH {S.WARPED} SELECT series_id, curve_class AS class, distance_r AS distance,
  offset_months FROM ranked""")
def f9(spark, sf):
    return (ranking.ranking_rows(ranked(spark, sf), KEYS)
            .select("series_id", "class", "distance", "offset_months"))


@query("f9_warp_distance_sql_function", f"""WITH {S.WARPED} SELECT series_id, curve_class AS class, distance, shift
FROM warped""")
def f9_sql(spark, sf):
    register_sql_functions(spark)
    df = profile(spark, sf).withColumn("curves", ranking.curve_list(literature_curves(spark)))
    pairs = df.select("series_id", F.array(*MONTH_COLS).alias("raw"), F.inline("curves"))
    named = pairs.selectExpr("series_id", "class", "cyclic_fill(raw) AS filled", "monthly")
    return (named.selectExpr("series_id", "class", "warp_distance(filled, monthly) AS w")
            .select("series_id", "class", F.col("w.cost").alias("distance"), F.col("w.shift").alias("shift")))


@query("f10_similarity", f"WITH {S.WARPED} SELECT series_id, curve_class AS class, similarity FROM ranked")
def f10(spark, sf):
    return ranking.ranking_rows(ranked(spark, sf, native=True), KEYS).select("series_id", "class", "similarity")


@query("w6_curve_ranking", f"""WITH {S.WARPED} SELECT series_id, CAST(rank AS INT) AS rank, curve_class AS class,
  margin FROM ranked JOIN best USING (series_id)""")
def w6(spark, sf):
    df = ranked(spark, sf)
    return df.select("series_id", "margin", F.posexplode("ranking").alias("pos", "r")).select(
        "series_id", (F.col("pos") + 1).alias("rank"), F.col("r.class").alias("class"), "margin")


_FINAL = f"""SELECT series_id, class AS rule_class,
  CASE WHEN class = 'pico_verao' AND best_class IN ('milho_1a_safra', 'soja_unica') THEN best_class
       WHEN class IN ('milho_safrinha', 'provavel_safrinha') AND best_class = 'algodao'
            AND coalesce(margin, 0) >= 0.04::DOUBLE THEN 'algodao' ELSE class END AS final_class,
  CASE WHEN class IN ('milho_safrinha', 'provavel_safrinha') AND best_class = 'algodao'
            AND coalesce(margin, 0) >= 0.04::DOUBLE
       THEN {S.half_up("least(0.95::DOUBLE, confidence * 0.7::DOUBLE + best_similarity * 0.3::DOUBLE)", 3)}
       ELSE confidence END AS final_confidence,
  best_class, best_similarity, margin FROM classified LEFT JOIN best USING (series_id)"""


@query("f11_parcel_verdict", f"WITH {S.PROFILE}, {S.VERDICT_PARTS} {_FINAL}")
def f11(spark, sf):
    result = parcel_analysis.analyze_observations(observations(spark, sf), KEYS, literature_curves(spark),
                                                  as_of="2001-12-31")
    return result.select("series_id", F.col("class").alias("rule_class"), "final_class", "final_confidence",
                         F.col("best.class").alias("best_class"), F.col("best.similarity").alias("best_similarity"),
                         "margin")
