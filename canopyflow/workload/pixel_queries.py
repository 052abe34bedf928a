"""Queries over pixels: index, composites, zones, masks and regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopyflow import constants as K
from canopyflow.operators import arcs, outline, pixels, ranking, regions, rules, zoning
from canopyflow.operators.profiles import fill_profile
from canopyflow.schemas import MONTH_COLS
from canopyflow.session import cut_lineage
from canopyflow.sources.curves import land_use_classes, literature_curves
from canopyflow.sources.pixels import unusable_windows
from canopyflow.workload import pixel_sql as S
from canopyflow.workload import series_sql as SS
from canopyflow.workload import views as V
from canopyflow.workload.registry import query

MONTHS_SQL = ", ".join(MONTH_COLS)
RES = 10.0


def valid(spark, sf):
    return pixels.valid_pixels(V.pixel_bands(spark, sf))


def composite(spark, sf):
    return pixels.monthly_composite(valid(spark, sf))


def zoned(spark, sf):
    return zoning.segment(zoning.pixel_matrix(composite(spark, sf), grids(spark, sf), zones=S.ZONE_K), S.ZONE_ROUNDS)


def masks(spark, sf):
    kind = F.when(F.col("m4") >= 6_500_000, "bright").when(F.col("m4").isNotNull(), "dark").otherwise("unseen")
    return composite(spark, sf).select("parcel_id", kind.alias("class"), "px", "py")


def grids(spark, sf):
    """Grid of every parcel; corners lie in zone 21 south."""
    parts = V.table(spark, sf, "part").select(F.expr("p_partkey div 500").alias("parcel_id")).distinct()
    return parts.select("parcel_id", F.lit(S.GRID_W).alias("width"), F.lit(S.GRID_H).alias("height"),
                        (F.lit(600_000.0) + F.col("parcel_id") * 1000).alias("origin_x"), F.lit(8_600_000.0).alias("origin_y"),
                        F.lit(RES).alias("res"), F.lit(21).alias("zone"), F.lit(True).alias("south"))


# ---- band arithmetic --------------------------------------------------------------
@query("src2_band_window", f"""WITH {S.PIXEL_BANDS} SELECT parcel_id, count(*) AS n, sum(b04)::BIGINT AS b04,
  sum(b08)::BIGINT AS b08 FROM pixel_bands WHERE px BETWEEN 5 AND 19 AND py BETWEEN 2 AND 17 GROUP BY 1""")
def src2(spark, sf):
    window = F.col("px").between(5, 19) & F.col("py").between(2, 17)
    return (V.pixel_bands(spark, sf).where(window).groupBy("parcel_id")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("b04").alias("b04"), F.sum("b08").alias("b08")))


@query("src2_unusable_windows", f"""WITH {S.PIXEL_BANDS} SELECT parcel_id, scene_id, 'narrow_window' AS reason FROM pixel_bands
  GROUP BY 1, 2 HAVING max(px) - min(px) < 1 OR max(py) - min(py) < 1""")
def src2_windows(spark, sf):
    return unusable_windows(V.pixel_bands(spark, sf))


@query("f14_pixels_on_grid", f"""WITH {S.PIXEL_BANDS}, placed AS (SELECT *, year(obs_date) AS scene_id_, 1 + parcel_id % 3 AS f FROM pixel_bands)
SELECT parcel_id, scene_id_ AS scene_id, px // f AS px, py // f AS py, avg(b04) AS b04, avg(b08) AS b08,
  min(ROW(py, px, scl))[3]::INT AS scl, 100.0::DOUBLE * f * f AS cell_m2 FROM placed WHERE f > 1 GROUP BY 1, 2, 3, 4, f
UNION ALL SELECT parcel_id, scene_id_, px, py, b04, b08, scl, 100 FROM placed WHERE f = 1""")
def f14_pixels(spark, sf):
    """Grids of 10, 20 and 30 m; years stand in for scenes, so that blocks have several pixels."""
    bands = V.pixel_bands(spark, sf).withColumn("scene_id", F.year("obs_date")).drop("obs_date", "baseline")
    side = 1 + F.col("parcel_id") % 3
    placed = pixels.on_grid(bands, bands.select("parcel_id").distinct().select("parcel_id", (F.lit(10.0) * side).alias("res")))
    return placed.select("*", (F.lit(100.0) * side * side).alias("cell_m2"))


@query("p1_band_offset", f"""WITH {S.VALID} SELECT baseline, off AS band_offset, count(*) AS n FROM shifted GROUP BY 1, 2""")
def p1(spark, sf):
    return (V.pixel_bands(spark, sf).groupBy("baseline", pixels.band_offset().alias("band_offset"))
            .agg(F.count(F.lit(1)).alias("n")))


@query("p2_p3_valid_pixel_index", f"""WITH {S.VALID} SELECT parcel_id, px, py, scene_id, obs_date, ndvi_e7 FROM valid""")
def p2(spark, sf):
    return valid(spark, sf).select("parcel_id", "px", "py", "scene_id", "obs_date", "ndvi_e7")


@query("p4_range_guards", f"""WITH {S.VALID} SELECT parcel_id, count(*) AS n,
  count(*) FILTER (ndvi_e7 > -2000000 AND ndvi_e7 < 9800000) AS strict_ok,
  count(*) FILTER (ndvi_e7 / 1e7::DOUBLE BETWEEN -0.2::DOUBLE AND 0.98::DOUBLE) AS inclusive_ok FROM valid GROUP BY 1""")
def p4(spark, sf):
    v = F.col("ndvi_e7")
    return valid(spark, sf).groupBy("parcel_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if((v > -2_000_000) & (v < 9_800_000)).alias("strict_ok"),
        F.count_if((v / 1e7).between(K.NDVI_LOW, K.NDVI_HIGH)).alias("inclusive_ok"))


@query("a1_p5_scene_means", f"""WITH {S.VALID} SELECT parcel_id, month_no, pixels,
  CAST(floor(total / pixels / 1e7::DOUBLE * 1e4::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS ndvi_e4, last_date FROM (
  SELECT parcel_id, year(obs_date) * 100 + month(obs_date) AS month_no, CAST(sum(ndvi_e7) AS DOUBLE) AS total,
    count(*) AS pixels, max(obs_date) AS last_date FROM valid GROUP BY 1, 2)
  WHERE pixels >= 8 AND total / pixels / 1e7::DOUBLE BETWEEN -0.2::DOUBLE AND 0.98::DOUBLE""")
def a1(spark, sf):
    monthly = valid(spark, sf).withColumn(
        "month_no", (F.year("obs_date") * 100 + F.month("obs_date")).cast("bigint"))
    return pixels.scene_points(monthly, ["parcel_id", "month_no"], [F.max("obs_date").alias("last_date")])


@query("a6_monthly_composite", f"WITH {S.COMPOSITE} SELECT parcel_id, px, py, {MONTHS_SQL} FROM composite")
def a6(spark, sf):
    return composite(spark, sf).select("parcel_id", "px", "py", *MONTH_COLS)


@query("a7_valid_months", f"WITH {S.COMPOSITE} SELECT parcel_id, n_months, count(*) AS n FROM composite GROUP BY 1, 2")
def a7(spark, sf):
    return composite(spark, sf).groupBy("parcel_id", "n_months").agg(F.count(F.lit(1)).alias("n"))


@query("a11_imputed_pixels", f"WITH {S.IMPUTED} SELECT parcel_id, px, py, {MONTHS_SQL}, known FROM imputed")
def a11(spark, sf):
    return zoning.impute(zoning.place(composite(spark, sf)), grids(spark, sf)).drop("n_pixels", "block", "res")


@query("f13_zone_count", f"""WITH {S.IMPUTED}, scaled AS (SELECT parcel_id, n_pixels, s, n_pixels * s AS n FROM means
  CROSS JOIN (SELECT unnest([1, 30, 120, 800, 3000]) AS s))
SELECT parcel_id, n, CASE WHEN n < 50 THEN 1 ELSE least(CASE WHEN n * 0.01::DOUBLE < 100 THEN 3
  WHEN n * 0.01::DOUBLE < 300 THEN 4 WHEN n * 0.01::DOUBLE < 800 THEN 5 WHEN n * 0.01::DOUBLE < 2000 THEN 6 ELSE 7 END,
  greatest(2, n // 200)) END AS zones FROM scaled""")
def f13(spark, sf):
    scaled = zoning.parcel_means(zoning.place(composite(spark, sf))).select(
        "parcel_id", F.explode(F.array(*[F.col("n_pixels") * s for s in (1, 30, 120, 800, 3000)])).alias("n"))
    return scaled.withColumn("zones", zoning.zone_count(F.col("n"), F.lit(RES)))


# ---- zones --------------------------------------------------------------------------
_SEEDS = """seeds AS MATERIALIZED (SELECT parcel_id, CAST(px // 10 AS INT) AS zone_id, {m} FROM (SELECT *,
  row_number() OVER (PARTITION BY parcel_id, px // 10 ORDER BY py, px) AS rn FROM imputed) WHERE rn = 1)""".format(m=MONTHS_SQL)


@query("r1_kmeans_one_step", f"""WITH {S.IMPUTED}, {_SEEDS}, {S.lloyd("imputed", "seeds", "step")}
SELECT parcel_id, zone_id, {MONTHS_SQL} FROM step""")
def r1_step(spark, sf):
    matrix = zoning.pixel_matrix(composite(spark, sf), grids(spark, sf), zones=3)
    first = F.min(F.struct("py", "px", F.array(*MONTH_COLS).alias("v"))).alias("pick")
    seeds = (matrix.groupBy("parcel_id", F.expr("px div 10").alias("zone_id"))
             .agg(first, F.first("k").alias("k"), F.collect_set("block").alias("b"))
             .groupBy("parcel_id", "k")
             .agg(F.sort_array(F.collect_list(F.struct("zone_id", "pick.v"))).alias("s"),
                  F.array_distinct(F.flatten(F.collect_list("b"))).alias("blocks"))
             .select("parcel_id", "k", "blocks", F.flatten("s.v").alias("centres")))
    step = zoning.lloyd_step(matrix, seeds, 3)
    parts = F.posexplode(F.transform(F.sequence(F.lit(0), F.col("k") - 1),
                                     lambda j: F.slice("centres", j * 12 + 1, 12)))
    return (step.select("parcel_id", parts.alias("zone_id", "c"))
            .select("parcel_id", "zone_id", *[F.col("c")[i].alias(c) for i, c in enumerate(MONTH_COLS)]))


@query("r1_kmeans_zones", f"WITH {S.ZONED} SELECT parcel_id, px, py, zone_id FROM zoned")
def r1(spark, sf):
    return zoned(spark, sf).select("parcel_id", "px", "py", "zone_id")


@query("a8_zone_monthly_means", f"WITH {S.ZONE_PROFILES} SELECT parcel_id, zone_id, {MONTHS_SQL}, n_obs FROM zone_profiles")
def a8(spark, sf):
    return zoning.zone_profiles(zoned(spark, sf)).select("parcel_id", "zone_id", *MONTH_COLS, "n_obs")


@query("a9_zone_pixels", f"""WITH {S.ZONED} SELECT parcel_id, zone_id, count(*) AS n_px,
  count(*) OVER (PARTITION BY parcel_id) AS n_zones FROM zoned GROUP BY 1, 2""")
def a9(spark, sf):
    sizes = zoned(spark, sf).groupBy("parcel_id", "zone_id").agg(F.count(F.lit(1)).alias("n_px"))
    per_parcel = sizes.groupBy("parcel_id").agg(F.count(F.lit(1)).alias("n_zones"))
    return sizes.join(per_parcel, "parcel_id")


@query("a14_zone_mean", f"""WITH {S.ZONE_PROFILES} SELECT parcel_id, zone_id, zone_mean,
  CASE WHEN zone_mean >= 0.55::DOUBLE THEN 'mata' ELSE 'pastagem' END AS kind FROM zone_profiles""")
def a14(spark, sf):
    return zoning.zone_profiles(zoned(spark, sf)).select(
        "parcel_id", "zone_id", "zone_mean",
        F.when(F.col("zone_mean") >= K.FOREST_MEAN_MIN, "mata").otherwise("pastagem").alias("kind"))


ZONE_CLASSES = S.ZONE_PROFILES + ",\n" + ",\n".join([
    SS.features("zone_profiles", "zone_features"), SS.classified("zone_features", "classified"),
    SS.curves_values(), SS.filled("zone_profiles", "filled"), SS.warped("filled", "parcel_id, zone_id"),
    SS.ranked("parcel_id, zone_id")]) + """,
zone_classes AS (SELECT c.parcel_id, c.zone_id, c.n_px, c.class AS rule_class, CASE
    WHEN c.n_obs < 6 THEN 'outras'
    WHEN c.class IN ('milho_safrinha', 'provavel_safrinha') AND b.best_class = 'algodao'
         AND coalesce(b.margin, 0) >= 0.04::DOUBLE THEN 'algodao'
    WHEN c.class = 'perene' THEN CASE WHEN c.zone_mean >= 0.55::DOUBLE THEN 'mata' ELSE 'pastagem' END
    WHEN c.class IN ('inconclusivo', 'dados_insuficientes') THEN 'outras'
    WHEN c.class = 'provavel_safrinha' THEN 'milho_safrinha' ELSE c.class END AS zone_class,
  CASE WHEN c.n_obs < 6 THEN 0.0::DOUBLE ELSE c.confidence END AS zone_confidence
  FROM classified c JOIN best b USING (parcel_id, zone_id))"""


def zone_classes(spark, profiles_):
    classified = rules.classify(profiles_)
    return ranking.arbitrate_zone(ranking.rank_curves(fill_profile(classified), literature_curves(spark)))


@query("r2_f12_zone_classes", f"WITH {ZONE_CLASSES} SELECT parcel_id, zone_id, rule_class, zone_class, zone_confidence "
       "FROM zone_classes")
def r2(spark, sf):
    done = zone_classes(spark, zoning.zone_profiles(zoned(spark, sf)))
    return done.select("parcel_id", "zone_id", F.col("class").alias("rule_class"), "zone_class", "zone_confidence")


@query("j12_j13_class_pixels", f"""WITH {ZONE_CLASSES}, labels(class, label, colour) AS (VALUES
  {", ".join(f"('{c}', '{n}', '{h}')" for c, n, h in K.LAND_USE_CLASSES)})
SELECT parcel_id, px, py, zone_class AS class, label, colour FROM zoned JOIN zone_classes USING (parcel_id, zone_id)
  LEFT JOIN labels ON class = zone_class""")
def j12(spark, sf):
    z = zoned(spark, sf)
    named = zoning.class_pixels(z, zone_classes(spark, zoning.zone_profiles(z)))
    return (named.join(F.broadcast(land_use_classes(spark)), "class", "left")
            .select("parcel_id", "px", "py", "class", "label", "colour"))


# ---- masks and regions -------------------------------------------------------------------
@query("w11_row_runs", f"""WITH {S.MASKS} SELECT parcel_id, class, py, min(px) AS x0, max(px) AS x1 FROM (
  SELECT *, px - row_number() OVER (PARTITION BY parcel_id, class, py ORDER BY px) AS island FROM masks)
  GROUP BY parcel_id, class, py, island""")
def w11(spark, sf):
    return regions.row_runs(masks(spark, sf))


@query("r3_connected_regions", f"""WITH {S.REGIONS} SELECT parcel_id, class, region_id, count(*) AS n_px
  FROM regions GROUP BY 1, 2, 3""")
def r3(spark, sf):
    return regions.region_sizes(regions.label_regions(regions.row_runs(masks(spark, sf))))


@query("r4_sieve", f"WITH {S.SIEVED} SELECT parcel_id, class, px, py FROM sieved")
def r4(spark, sf):
    cleaned = regions.sieve(regions.row_runs(masks(spark, sf)), grids(spark, sf), S.SIEVE_MIN / 100)
    return regions.run_cells(cleaned)


_EDGES = " UNION ALL ".join(
    f"""SELECT m.parcel_id, m.class, '{side}' AS side, count(*) AS n, sum(m.px)::BIGINT AS sx, sum(m.py)::BIGINT AS sy
  FROM masks m LEFT JOIN masks o ON o.parcel_id = m.parcel_id AND o.class = m.class AND o.px = m.px + {dx}
    AND o.py = m.py + {dy} WHERE o.px IS NULL GROUP BY 1, 2""" for side, dx, dy in
    (("top", 0, -1), ("bottom", 0, 1), ("left", -1, 0), ("right", 1, 0)))


@query("r5_outline_edges", f"WITH {S.MASKS} {_EDGES}")
def r5_edges(spark, sf):
    runs = regions.row_runs(masks(spark, sf)).withColumn("region_id", F.lit(0).cast("bigint"))
    seg = regions.boundary_segments(runs)
    side = (F.when(F.col("ya") == F.col("yb"), F.when(F.col("xa") < F.col("xb"), "top").otherwise("bottom"))
            .when(F.col("ya") > F.col("yb"), "left").otherwise("right"))
    low, high = F.least("xa", "xb"), F.greatest("xa", "xb")
    n = F.when(F.col("ya") == F.col("yb"), high - low).otherwise(F.lit(1))
    # cells on the inner side of the segment
    sx = (F.when(F.col("ya") == F.col("yb"), (low + high - 1) * (high - low) / 2)
          .when(F.col("ya") > F.col("yb"), F.col("xa")).otherwise(F.col("xa") - 1)).cast("bigint")
    row = (F.when(side == "top", F.col("ya")).when(side == "bottom", F.col("ya") - 1)
           .otherwise(F.least("ya", "yb")))
    return (seg.select("parcel_id", "class", side.alias("side"), n.alias("n"), sx.alias("sx"), (row * n).alias("sy"))
            .groupBy("parcel_id", "class", "side").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy")]))


@query("r5_region_rings", f"""WITH {S.REGIONS}, quads AS (SELECT parcel_id, class, region_id, cell % 1048576 + dx AS qx,
    cell // 1048576 + dy AS qy, count(*) AS n, sum(dx + 2 * dy) AS places FROM regions
    CROSS JOIN (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) corner(dx, dy) GROUP BY ALL),
  euler AS (SELECT parcel_id, class, region_id, (count(*) FILTER (n = 1) - count(*) FILTER (n = 3)
    + 2 * count(*) FILTER (n = 2 AND places = 3)) // 4 AS e FROM quads GROUP BY ALL)
SELECT parcel_id, class, region_id, 2 - e AS n_rings, n_px FROM euler
  JOIN (SELECT parcel_id, class, region_id, count(*) AS n_px FROM regions GROUP BY ALL) USING (parcel_id, class, region_id)""")
def r5_rings(spark, sf):
    """Signed area in cells and number of rings, in one map of all classes."""
    labelled = regions.label_regions(regions.row_runs(masks(spark, sf)))
    rings = arcs.outlined(labelled, grids(spark, sf), ["parcel_id"], ["class", "region_id"], None)
    area = F.expr("""aggregate(transform(rings, r -> aggregate(sequence(0, size(r) - 2), 0D,
        (s, i) -> s + r[i][0] * r[i + 1][1] - r[i + 1][0] * r[i][1])), 0D, (s, a) -> s + a) / 2""")
    return rings.select("parcel_id", "class", "region_id", F.size("rings").cast("bigint").alias("n_rings"), area.cast("bigint").alias("n_px"))


@query("r5_region_outlines")
def r5_outlines(spark, sf):
    """Simplified outlines in degrees; tests hold their topology."""
    labelled = regions.label_regions(regions.row_runs(masks(spark, sf)))
    rings = outline.outline_regions(labelled, grids(spark, sf), shared=True)
    return rings.select("parcel_id", "class", "region_id", F.size("rings").alias("n_rings"), F.to_json("rings").alias("coordinates"))


@query("u4_halo", f"""WITH {S.MASKS}, offs AS (SELECT dx, dy FROM (SELECT unnest(range(-3, 4)) AS dx)
  CROSS JOIN (SELECT unnest(range(-3, 4)) AS dy) WHERE abs(dx) + abs(dy) <= 3)
SELECT DISTINCT parcel_id, px + dx AS px, py + dy AS py FROM masks CROSS JOIN offs WHERE class = 'bright'""")
def u4(spark, sf):
    core = masks(spark, sf).where(F.col("class") == "bright").select("parcel_id", "px", "py")
    return regions.halo(core)


@query("u3_mask_algebra", f"""WITH {S.MASKS}, offs AS (SELECT dx, dy FROM (SELECT unnest(range(-3, 4)) AS dx)
  CROSS JOIN (SELECT unnest(range(-3, 4)) AS dy) WHERE abs(dx) + abs(dy) <= 3),
  a AS (SELECT parcel_id, px, py FROM masks WHERE class = 'bright' AND px < 8),
  b AS (SELECT parcel_id, px, py FROM masks WHERE px >= 6), prop AS (SELECT parcel_id, px, py FROM masks WHERE py > 0)
SELECT * FROM (SELECT * FROM a UNION (SELECT * FROM b INTERSECT SELECT parcel_id, px + dx, py + dy FROM a CROSS JOIN offs))
  INTERSECT SELECT * FROM prop""")
def u3(spark, sf):
    cells = masks(spark, sf)
    core = cells.where((F.col("class") == "bright") & (F.col("px") < 8)).select("parcel_id", "px", "py")
    grown = cells.where(F.col("px") >= 6).select("parcel_id", "px", "py")
    allowed = cells.where(F.col("py") > 0).select("parcel_id", "px", "py")
    return regions.combine_masks(core, grown, allowed)


@query("j14_corn_precedence", f"""WITH {S.MASKS}, corn AS (SELECT parcel_id, px, py FROM masks WHERE px % 3 = 0)
SELECT parcel_id, px, py, 'milho_safrinha' AS class FROM corn UNION ALL
SELECT m.parcel_id, m.px, m.py, m.class FROM masks m WHERE px % 3 <> 0""")
def j14(spark, sf):
    cells = masks(spark, sf)
    corn = cells.where(F.col("px") % 3 == 0).select("parcel_id", "px", "py")
    return zoning.corn_takes_precedence(cells, corn)


_AREA = "floor(n_px * 0.01::DOUBLE * 10 + 0.5) / 10"
_REGION_TABLE = f"""region_table AS (SELECT parcel_id, class, region_id, count(*) AS n_px,
  (floor(count(*) * 0.01::DOUBLE * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE) AS area_ha FROM regions GROUP BY 1, 2, 3
  HAVING count(*) * 0.01::DOUBLE >= 0.05::DOUBLE)"""


def region_table(spark, sf):
    labelled = regions.label_regions(regions.row_runs(masks(spark, sf)))
    return outline.region_table(labelled, land_use_classes(spark), grids(spark, sf), 0.05)


@query("w7_top_regions", f"""WITH {S.REGIONS}, {_REGION_TABLE}, ordered AS (SELECT *, row_number() OVER (
  PARTITION BY parcel_id ORDER BY area_ha DESC, region_id) AS rn, count(*) OVER (PARTITION BY parcel_id) AS n
  FROM region_table) SELECT parcel_id, class, region_id, area_ha, n > 3 AS truncated FROM ordered WHERE rn <= 3""")
def w7(spark, sf):
    return (regions.top_regions(region_table(spark, sf), 3)
            .select("parcel_id", "class", "region_id", "area_ha", "truncated"))


_STATS = """stats AS (SELECT parcel_id, class, count(*) AS n_px,
    (floor(count(*) * 0.01::DOUBLE * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE) AS area_ha FROM masks GROUP BY 1, 2),
  class_stats AS (SELECT s.*, coalesce(r.n, 0) AS n_polygons FROM stats s
    LEFT JOIN (SELECT parcel_id, class, count(*) AS n FROM region_table GROUP BY 1, 2) r USING (parcel_id, class))"""


@query("a12_class_statistics", f"WITH {S.REGIONS}, {_REGION_TABLE}, {_STATS} SELECT * FROM class_stats")
def a12(spark, sf):
    runs = regions.row_runs(masks(spark, sf))
    return outline.class_statistics(runs, region_table(spark, sf), grids(spark, sf))


@query("a12_emptied_classes", f"""WITH {S.SIEVED}, kept AS (SELECT parcel_id, class, count(*) AS n_px FROM sieved GROUP BY 1, 2)
SELECT parcel_id, class, coalesce(n_px, 0) AS n_px, {S.half_up("coalesce(n_px, 0) * 0.01::DOUBLE", 1)} AS area_ha
FROM (SELECT DISTINCT parcel_id, class FROM masks) FULL JOIN kept USING (parcel_id, class)""")
def a12_emptied(spark, sf):
    """Areas after sieving; classes that vanish stay listed."""
    cells, squares = masks(spark, sf), grids(spark, sf)
    cleaned = cut_lineage(regions.sieve(regions.row_runs(cells), squares, S.SIEVE_MIN / 100))
    table = outline.region_table(cleaned.withColumn("region_id", F.lit(0).cast("bigint")), land_use_classes(spark), squares, 0.0)
    return outline.class_statistics(cleaned, table, squares, cells).select("parcel_id", "class", "n_px", "area_ha")


_CORN = "CASE class WHEN 'bright' THEN 'milho_safrinha' ELSE class END"


@query("a13_parcel_totals", f"""WITH {S.REGIONS}, {_REGION_TABLE}, {_STATS},
  totals AS (SELECT parcel_id, sum(n_px)::BIGINT AS n_px, coalesce(sum(area_ha) FILTER (class = 'bright'), 0.0) AS corn_ha,
    sum(n_polygons)::BIGINT AS n_regions FROM class_stats GROUP BY 1)
SELECT parcel_id, n_px, {S.half_up("n_px * 0.01::DOUBLE", 1)} AS total_ha, corn_ha, n_regions,
  {S.half_up("100.0::DOUBLE * corn_ha / (n_px * 0.01::DOUBLE)", 1)} AS corn_pct FROM totals""")
def a13(spark, sf):
    runs = regions.row_runs(masks(spark, sf))
    stats = outline.class_statistics(runs, region_table(spark, sf), grids(spark, sf)).withColumn(
        "class", F.when(F.col("class") == "bright", K.CORN).otherwise(F.col("class")))
    prop = masks(spark, sf).groupBy("parcel_id").agg(F.count(F.lit(1)).alias("n_px"))
    return outline.parcel_totals(prop, stats, grids(spark, sf))
