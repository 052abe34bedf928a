"""Queries over parcels, scenes as footprints, and points."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopyflow import constants as K
from canopyflow.functions import rings as R
from canopyflow.functions.geodesy import _ALPHA, _E, _RECT, FALSE_EAST, FALSE_NORTH, SCALE
from canopyflow.operators import parcels as P
from canopyflow.operators import scenes as SC
from canopyflow.operators import scanline, spatial
from canopyflow.operators.regions import min_region_pixels
from canopyflow.workload import views as V
from canopyflow.workload.registry import query


def located(spark, sf):
    """Parcels with geometry and repaired axes."""
    return P.normalize_features(V.parcel_features(spark, sf))


HAS_RINGS = "parcel_id % 17 <> 3"


@query("src1_scene_search", f"""WITH {V.SCENES} SELECT scene_id, obs_date, cloud FROM scenes
  WHERE xmin <= -56.0 AND xmax >= -56.6 AND ymin <= -13.1 AND ymax >= -13.7
    AND obs_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' AND cloud < 70""")
def src1(spark, sf):
    found = SC.search_scenes(V.scenes(spark, sf), (-56.6, -13.7, -56.0, -13.1), "1996-01-01", "1999-12-31", 70)
    return found.select("scene_id", "obs_date", "cloud")


@query("t4_scene_cap", f"""WITH {V.SCENES} SELECT tile, scene_id, obs_date FROM (SELECT *, row_number() OVER (
  PARTITION BY tile ORDER BY obs_date, scene_id) AS rn FROM scenes) WHERE rn <= 500""")
def t4(spark, sf):
    return SC.cap_scenes(V.scenes(spark, sf), ["tile"], ["obs_date", "scene_id"]).select("tile", "scene_id", "obs_date")


@query("src3_parcels_by_box", f"""WITH {V.PARCELS} SELECT parcel_id FROM parcels WHERE xmin <= -55.8 AND xmax >= -56.3
  AND ymin <= -13.2 AND ymax >= -13.9""")
def src3(spark, sf):
    return P.by_box(V.parcel_features(spark, sf), (-56.3, -13.9, -55.8, -13.2)).select("parcel_id")


@query("src4_parcel_by_code", f"WITH {V.PARCELS} SELECT parcel_id FROM parcels WHERE parcel_id = 77")
def src4(spark, sf):
    return P.by_code(V.parcel_features(spark, sf), "MT-77").select("parcel_id")


@query("p7_request_checks", """SELECT o_orderkey AS request_id, CASE
  WHEN o_orderpriority[1] NOT IN ('1', '2') THEN 'geometry'
  WHEN o_custkey % 130 > 100 THEN 'cloud_max' WHEN o_orderkey % 300 NOT BETWEEN 6 AND 200 THEN 'max_scenes'
  WHEN o_custkey % 150 NOT BETWEEN 0.1 AND 100 THEN 'min_area_ha' END AS reason FROM orders""")
def p7(spark, sf):
    o = V.table(spark, sf, "orders")
    kind = (F.when(F.col("o_orderpriority").startswith("1"), "Polygon")
            .when(F.col("o_orderpriority").startswith("2"), "MultiPolygon")
            .when(F.col("o_orderpriority").startswith("3"), "Point"))
    req = o.select(F.col("o_orderkey").alias("request_id"), kind.alias("geometry_type"),
                   (F.col("o_custkey") % 130).alias("cloud_max"), (F.col("o_orderkey") % 300).alias("max_scenes"),
                   (F.col("o_custkey") % 150).cast("double").alias("min_area_ha"))
    return P.request_reason(req, zoning=True).select("request_id", "reason")


_AREA_SQL = """(abs((radians(xmax) - radians(xmin)) * (sin(radians(ymin)) + sin(radians(ymin)))
  + (radians(xmin) - radians(xmax)) * (sin(radians(ymax)) + sin(radians(ymax)))) * (6378137.0::DOUBLE * 6378137.0 / 2) / 1e4)"""


@query("f16_geodesic_area", f"WITH {V.PARCELS} SELECT parcel_id, floor({_AREA_SQL} * 100 + 0.5) / 100 AS area_ha "
       f"FROM parcels WHERE {HAS_RINGS}")
def f16(spark, sf):
    area = F.floor(R.geodesic_area_ha("rings") * 100 + 0.5) / 100.0
    return located(spark, sf).select("parcel_id", area.alias("area_ha"))


@query("p8_parcel_area_check", f"""WITH {V.PARCELS} SELECT parcel_id, CASE WHEN {_AREA_SQL} / s < 10 THEN 'too_small'
  WHEN {_AREA_SQL} / s > 200000 THEN 'too_large' END AS reason FROM (SELECT *, CASE parcel_id % 3 WHEN 0 THEN 100.0
  WHEN 1 THEN 1.0 ELSE 0.01 END AS s FROM parcels WHERE {HAS_RINGS})""")
def p8(spark, sf):
    shrink = F.when(F.col("parcel_id") % 3 == 0, 100.0).when(F.col("parcel_id") % 3 == 1, 1.0).otherwise(0.01)
    area = R.geodesic_area_ha("rings") / shrink
    return located(spark, sf).select("parcel_id", P.area_status(area).alias("reason"))


@query("p11_attribute_aliases", f"""WITH {V.PARCELS} SELECT parcel_id, 'MT-' || parcel_id AS code, municipality,
  CAST(parcel_id % 900 AS VARCHAR) AS area_ha, CAST(NULL AS VARCHAR) AS state FROM parcels""")
def p11(spark, sf):
    df = P.read_attributes(V.parcel_features(spark, sf))
    return df.select("parcel_id", F.col("attr_code").alias("code"), F.col("attr_municipality").alias("municipality"),
                     F.col("attr_area_ha").alias("area_ha"), F.col("attr_state").alias("state"))


@query("p12_features_with_geometry", f"WITH {V.PARCELS} SELECT parcel_id FROM parcels WHERE {HAS_RINGS}")
def p12(spark, sf):
    return located(spark, sf).select("parcel_id")


@query("p13_axis_repair", f"""WITH {V.PARCELS} SELECT parcel_id, xmin AS first_x, ymin AS first_y, xmax AS third_x,
  ymax AS third_y FROM parcels WHERE {HAS_RINGS}""")
def p13(spark, sf):
    p = F.col("rings")[0]
    return located(spark, sf).select("parcel_id", p[0][0].alias("first_x"), p[0][1].alias("first_y"),
                                     p[2][0].alias("third_x"), p[2][1].alias("third_y"))


@query("p14_property_whitelist", f"""WITH {V.PARCELS} SELECT parcel_id, 'codarea=' || parcel_id || ';nome=' || municipality
  AS kept FROM parcels""")
def p14(spark, sf):
    from canopyflow.sources.geojson import keep_properties
    attrs = F.map_from_arrays(
        F.array(F.lit("codarea"), F.lit("extra"), F.lit("nome")),
        F.array(F.col("parcel_id").cast("string"), F.lit("x"), F.col("municipality")))
    kept = V.parcel_features(spark, sf).withColumn("properties", attrs).withColumn(
        "properties", keep_properties("properties"))
    entries = F.transform(F.array_sort(F.map_entries("properties")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return kept.select("parcel_id", F.array_join(entries, ";").alias("kept"))


@query("p15_coordinate_rounding", f"""WITH {V.PARCELS} SELECT parcel_id, floor(xmin * 1.00037 * 1000 + 0.5) / 1000 AS x3,
  floor(ymax * 1.00037 * 1e6 + 0.5) / 1e6 AS y6 FROM parcels WHERE {HAS_RINGS}""".replace("1.00037", "1.00037::DOUBLE"))
def p15(spark, sf):
    scaled = F.expr("transform(rings, r -> transform(r, p -> transform(p, v -> v * 1.00037D)))")
    df = located(spark, sf).withColumn("rings", scaled)
    df = df.withColumns({"r3": R.round_rings("rings", 3), "r6": R.round_rings("rings", 6)})
    return df.select("parcel_id", F.col("r3")[0][0][0].alias("x3"), F.col("r6")[0][2][1].alias("y6"))


@query("f15_planar_area", f"""WITH {V.PARCELS} SELECT parcel_id, abs((xmin * ymin - xmax * ymin) + (xmax * ymax - xmax * ymin)
  + (xmax * ymax - xmin * ymax) + (xmin * ymin - xmin * ymax)) / 2 AS area FROM parcels WHERE {HAS_RINGS}""")
def f15(spark, sf):
    return located(spark, sf).select("parcel_id", R.planar_area("rings").alias("area"))


@query("f17_bounds_centroid", f"""WITH {V.PARCELS} SELECT parcel_id, xmin, ymin, xmax, ymax,
  floor((xmin + xmax) / 2 * 1e6 + 0.5) / 1e6 AS lon, floor((ymin + ymax) / 2 * 1e6 + 0.5) / 1e6 AS lat
  FROM (SELECT *, parcel_id AS pid FROM parcels) WHERE {HAS_RINGS}""")
def f17(spark, sf):
    c = R.centroid("rings")
    df = located(spark, sf).drop("xmin", "ymin", "xmax", "ymax").withColumns(R.bounds("rings"))
    # rectangles with an even number of hundredths have their centre on a grid line
    return df.select("parcel_id", "xmin", "ymin", "xmax", "ymax",
                     *[(F.floor(c[a] * 1e6 + 0.5) / 1e6).alias(a) for a in ("lon", "lat")])


@query("f21_min_region_pixels", """SELECT p_partkey AS id, greatest(2, CAST(floor(ha * 10000 / (res * res)) AS BIGINT)) AS min_px
  FROM (SELECT p_partkey, 0.5 + p_partkey % 40 AS ha, 10.0 * (1 + p_partkey % 5) AS res FROM part)""")
def f21(spark, sf):
    part = V.table(spark, sf, "part")
    ha, res = F.lit(0.5) + F.col("p_partkey") % 40, F.lit(10.0) * (1 + F.col("p_partkey") % 5)
    return part.select(F.col("p_partkey").alias("id"), min_region_pixels(ha, res).alias("min_px"))


@query("w9_largest_part", f"""WITH {V.PARCELS} SELECT parcel_id, xmin + (parcel_id % 3) AS part_x FROM parcels WHERE {HAS_RINGS}""")
def w9(spark, sf):
    """Three copies side by side; the one at index ``parcel_id % 3`` is whole, the others are half as high."""
    def copy(i: int):
        grow = f"CASE WHEN parcel_id % 3 = {i} THEN 1D ELSE 0.5D END"
        return F.expr(f"transform(rings, r -> transform(r, p -> array(p[0] + {i}, "
                      f"r[0][1] + (p[1] - r[0][1]) * {grow})))")
    df = located(spark, sf).withColumn("parts", F.array(copy(0), copy(1), copy(2)))
    best = df.withColumn("best", R.largest_part("parts"))
    return best.select("parcel_id", F.col("best")[0][0][0].alias("part_x"))


_ALPHAS = [repr(a) for a in _ALPHA]


def _projected_sql() -> str:
    north = " + ".join(["xi", *[f"{a}::DOUBLE * sin({2.0 * j} * xi) * cosh({2.0 * j} * eta)" for j, a in enumerate(_ALPHAS, 1)]])
    east = " + ".join(["eta", *[f"{a}::DOUBLE * cos({2.0 * j} * xi) * sinh({2.0 * j} * eta)" for j, a in enumerate(_ALPHAS, 1)]])
    k = f"{SCALE * _RECT!r}::DOUBLE"
    return f"""frame AS (SELECT parcel_id, zone, i, CASE i // 22 WHEN 0 THEN xmin + (xmax - xmin) * t WHEN 1 THEN xmax
      WHEN 2 THEN xmax - (xmax - xmin) * t ELSE xmin END AS lon, CASE i // 22 WHEN 0 THEN ymin
      WHEN 1 THEN ymin + (ymax - ymin) * t WHEN 2 THEN ymax ELSE ymax - (ymax - ymin) * t END AS lat
    FROM (SELECT *, (i % 22) / 22.0::DOUBLE AS t, CAST(floor(((xmin + xmax) / 2 + 180) / 6) AS INT) + 1 AS zone
          FROM parcels CROSS JOIN (SELECT unnest(range(88)) AS i) WHERE {HAS_RINGS})),
  conf AS (SELECT *, sinh(atanh(s) - {_E!r}::DOUBLE * atanh({_E!r}::DOUBLE * s)) AS t,
      radians(lon - (zone * 6 - 183)) AS lam FROM (SELECT *, sin(radians(lat)) AS s FROM frame)),
  ang AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1.0 + t * t)) AS eta FROM conf),
  metres AS (SELECT parcel_id, zone, {FALSE_EAST}::DOUBLE + {k} * ({east}) AS x,
      {k} * ({north}) + {FALSE_NORTH}::DOUBLE AS y FROM ang),
  box AS (SELECT parcel_id, zone, max(x) - min(x) AS w, max(y) - min(y) AS h FROM metres GROUP BY 1, 2),
  sized AS (SELECT *, 10.0::DOUBLE * greatest(1, ceil(greatest(ceil(w / 10.0::DOUBLE), ceil(h / 10.0::DOUBLE)) / 128.0::DOUBLE)) AS res FROM box)"""


@query("f14_reference_grid", f"""WITH {V.PARCELS}, {_projected_sql()} SELECT parcel_id, zone, 32700 + zone AS epsg, res,
  CAST(ceil(w / res) AS INT) AS width, CAST(ceil(h / res) AS INT) AS height FROM sized""")
def f14(spark, sf):
    return (P.grid_for_parcel(located(spark, sf), max_side=128)
            .select("parcel_id", "zone", "epsg", "res", "width", "height"))


_POINTS = """points AS (SELECT l_orderkey * 10 + l_linenumber AS point_id, -57.0::DOUBLE + (l_partkey * 7919 % 2100) * 0.001::DOUBLE + 0.0005::DOUBLE AS x,
  -14.0::DOUBLE + (l_orderkey * 104729 % 1900) * 0.001::DOUBLE + 0.0005::DOUBLE AS y FROM lineitem)"""


def points(spark, sf):
    li = V.table(spark, sf, "lineitem")
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("point_id"),
                     (F.lit(-57.0) + (F.col("l_partkey") * 7919 % 2100) * F.lit(0.001) + F.lit(0.0005)).alias("x"),
                     (F.lit(-14.0) + (F.col("l_orderkey") * 104729 % 1900) * F.lit(0.001) + F.lit(0.0005)).alias("y"))


def boxes(spark, sf):
    return located(spark, sf).select("parcel_id", "xmin", "ymin", "xmax", "ymax", "rings")


# parcel outlines in fractions of their bounds: concave, with a hole, of two parts, and with a notch
SHAPES = [
    [[(0.013, 0.021), (0.987, 0.021), (0.987, 0.473), (0.412, 0.473), (0.412, 0.968), (0.013, 0.968)]],
    [[(0.031, 0.217), (0.713, 0.019), (0.981, 0.779), (0.283, 0.973)], [(0.381, 0.407), (0.619, 0.353), (0.673, 0.597), (0.419, 0.641)]],
    [[(0.017, 0.029), (0.447, 0.071), (0.123, 0.951)], [(0.563, 0.519), (0.971, 0.547), (0.943, 0.983), (0.557, 0.939)]],
    [[(0.023, 0.037), (0.961, 0.511), (0.043, 0.977), (0.471, 0.499)]],
]
LATTICE = (-57.0, -14.0, 0.001)
_SHAPE_EDGES = ", ".join(
    f"({k}, {', '.join(f'{v}::DOUBLE' for v in (*a, *b))})" for k, rings in enumerate(SHAPES) for ring in rings
    for a, b in zip(ring, [*ring[1:], ring[0]]))


def shaped(spark, sf):
    """Parcels with one of the four outlines."""
    def ring(points):
        at = lambda low, high, f: F.col(low) + (F.col(high) - F.col(low)) * F.lit(f)
        return F.array(*[F.array(at("xmin", "xmax", x), at("ymin", "ymax", y)) for x, y in [*points, points[0]]])

    kinds = [F.array(*[ring(r) for r in rings]) for rings in SHAPES]
    pick = F.coalesce(*[F.when(F.col("parcel_id") % len(kinds) == k, rings) for k, rings in enumerate(kinds)])
    return V.parcels(spark, sf).select("parcel_id", pick.alias("rings"))


def lattice_cells(spark, sf):
    li = V.table(spark, sf, "lineitem")
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("point_id"),
                     (F.col("l_partkey") * 7919 % 2100).alias("px"), (F.col("l_orderkey") * 104729 % 1900).alias("py"))


_LATTICE_EDGES = f"""shape(kind, xa, ya, xb, yb) AS (VALUES {_SHAPE_EDGES}),
  edges AS (SELECT parcel_id, (xmin + (xmax - xmin) * xa - {LATTICE[0]}::DOUBLE) / {LATTICE[2]}::DOUBLE AS ua,
    (ymin + (ymax - ymin) * ya - {LATTICE[1]}::DOUBLE) / {LATTICE[2]}::DOUBLE AS va,
    (xmin + (xmax - xmin) * xb - {LATTICE[0]}::DOUBLE) / {LATTICE[2]}::DOUBLE AS ub,
    (ymin + (ymax - ymin) * yb - {LATTICE[1]}::DOUBLE) / {LATTICE[2]}::DOUBLE AS vb FROM parcels JOIN shape ON kind = parcel_id % 4),
  box AS (SELECT parcel_id, min(least(ua, ub)) AS u0, max(greatest(ua, ub)) AS u1, min(least(va, vb)) AS v0, max(greatest(va, vb)) AS v1
    FROM edges GROUP BY 1)"""
_TOUCHES = f"""bool_or({scanline.edge_meets_cell('px', 'py')}) OR
  sum(CASE WHEN (va > py + 0.5::DOUBLE) <> (vb > py + 0.5::DOUBLE)
           AND px + 0.5::DOUBLE < (ub - ua) * ((py + 0.5::DOUBLE) - va) / (vb - va) + ua THEN 1 ELSE 0 END) % 2 = 1"""


@query("j1_cells_in_parcels", f"""WITH {V.PARCELS}, {_LATTICE_EDGES},
  cells AS (SELECT row_number() OVER () AS rid, l_orderkey * 10 + l_linenumber AS point_id, l_partkey * 7919 % 2100 AS px, l_orderkey * 104729 % 1900 AS py FROM lineitem),
  near AS (SELECT * FROM cells JOIN box ON px + 1 >= u0 AND px <= u1 AND py + 1 >= v0 AND py <= v1),
  hits AS (SELECT parcel_id, point_id FROM near JOIN edges USING (parcel_id) GROUP BY 1, 2, rid, px, py HAVING {_TOUCHES})
SELECT parcel_id, count(*) AS n, sum(point_id)::BIGINT AS ids FROM hits GROUP BY 1""")
def j1(spark, sf):
    pairs = scanline.cells_touched(lattice_cells(spark, sf), shaped(spark, sf), LATTICE[:2], LATTICE[2])
    return pairs.groupBy("parcel_id").agg(F.count(F.lit(1)).alias("n"), F.sum("point_id").alias("ids"))


@query("j1_parcel_runs", f"""WITH {V.PARCELS}, {_LATTICE_EDGES},
  cells AS (SELECT *, unnest(range(CAST(ceil(u0 - 1) AS BIGINT), CAST(floor(u1) AS BIGINT) + 1)) AS px FROM (
    SELECT *, unnest(range(CAST(ceil(v0 - 1) AS BIGINT), CAST(floor(v1) AS BIGINT) + 1)) AS py FROM box)),
  hits AS (SELECT parcel_id, px, py FROM cells JOIN edges USING (parcel_id) GROUP BY 1, 2, 3 HAVING {_TOUCHES})
SELECT parcel_id, py, min(px) AS x0, max(px) AS x1 FROM (SELECT *, px - row_number() OVER (PARTITION BY parcel_id, py ORDER BY px) AS island
  FROM hits) GROUP BY parcel_id, py, island""")
def j1_runs(spark, sf):
    edges = scanline.lattice_edges(shaped(spark, sf), ["parcel_id"], *map(F.lit, (*LATTICE[:2], LATTICE[2], LATTICE[2])))
    return scanline.touched_runs(edges, ["parcel_id"])


@query("j2_scenes_over_parcels", f"""WITH {V.PARCELS}, {V.SCENES} SELECT parcel_id, count(*) AS n, sum(scene_id)::BIGINT AS ids
  FROM scenes s JOIN parcels p ON s.xmin <= p.xmax AND s.xmax >= p.xmin AND s.ymin <= p.ymax AND s.ymax >= p.ymin
  WHERE cloud < 70 AND obs_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31' GROUP BY 1""")
def j2(spark, sf):
    pairs = spatial.scenes_over_parcels(V.scenes(spark, sf).select("scene_id", "obs_date", "cloud", "xmin", "ymin", "xmax", "ymax"),
                                        V.parcels(spark, sf).select("parcel_id", "xmin", "ymin", "xmax", "ymax"),
                                        "1997-01-01", "1997-12-31", 70)
    return pairs.groupBy("parcel_id").agg(F.count(F.lit(1)).alias("n"), F.sum("scene_id").alias("ids"))


@query("j7_pick_parcel", f"""WITH {V.PARCELS}, {_POINTS}, near AS (SELECT p.point_id, q.parcel_id,
  NOT (x > xmin AND x < xmax AND y > ymin AND y < ymax) AS miss
  FROM (SELECT point_id, any_value(x) AS x, any_value(y) AS y FROM (SELECT point_id, min(x) AS x, min(y) AS y FROM points GROUP BY 1) GROUP BY 1) p
  JOIN parcels q ON xmin <= x + 0.003::DOUBLE AND xmax >= x - 0.003::DOUBLE AND ymin <= y + 0.003::DOUBLE
    AND ymax >= y - 0.003::DOUBLE WHERE {HAS_RINGS})
SELECT point_id, parcel_id, NOT miss AS inside FROM (SELECT *, row_number() OVER (PARTITION BY point_id
  ORDER BY miss, parcel_id) AS rn FROM near) WHERE rn = 1""")
def j7(spark, sf):
    clicks = points(spark, sf).groupBy("point_id").agg(F.min("x").alias("x"), F.min("y").alias("y"))
    listed = boxes(spark, sf).withColumn("ord", F.col("parcel_id"))
    return spatial.pick_parcel(clicks, listed, ["point_id"])


def boundary(spark, sf):
    """Box spanned by the suppliers' positions on the parcel layout, as one polygon."""
    s = V.table(spark, sf, "supplier").agg((F.min("s_suppkey") * 0.0 - 56.482).alias("x0"),
                                           (F.min("s_suppkey") * 0.0 - 13.781).alias("y0"),
                                           (F.max("s_nationkey") * 0.0 - 55.513).alias("x1"),
                                           (F.max("s_nationkey") * 0.0 - 12.719).alias("y1"))
    c = [("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0")]
    return s.select(F.array(F.array(*[F.array(a, b) for a, b in c])).alias("rings"))


@query("j8_boundary_relation", f"""WITH {V.PARCELS} SELECT parcel_id, CASE
  WHEN xmin >= -56.482 AND xmax <= -55.513 AND ymin >= -13.781 AND ymax <= -12.719 THEN 'within'
  WHEN xmin <= -55.513 AND xmax >= -56.482 AND ymin <= -12.719 AND ymax >= -13.781 THEN 'crossing'
  ELSE 'outside' END AS relation FROM parcels WHERE {HAS_RINGS}""")
def j8(spark, sf):
    return spatial.against_boundary(boxes(spark, sf), boundary(spark, sf)).select("parcel_id", "relation")


_PROVIDERS = ", ".join(f"('{p[0]}', '{p[1]}', {p[2]}::DOUBLE, {str(p[5]).upper()})" for p in K.PROVIDERS)


@query("src10_scenes_of_active_providers", f"""WITH providers(provider, label, res_m, active) AS (VALUES {_PROVIDERS})
SELECT provider, label, res_m, count(*) AS n_scenes FROM orders JOIN providers
  ON provider = CASE WHEN o_orderkey % 3 = 0 THEN 'sentinel2' WHEN o_orderkey % 3 = 1 THEN 'planetscope' ELSE 'maxar' END
  WHERE active OR provider = 'maxar' GROUP BY 1, 2, 3""")
def src10(spark, sf):
    """Six fixed provider rows, so the dimension is broadcast."""
    from canopyflow.sources.curves import providers
    kind = (F.when(F.col("o_orderkey") % 3 == 0, "sentinel2").when(F.col("o_orderkey") % 3 == 1, "planetscope")
            .otherwise("maxar"))
    usable = providers(spark, active={"maxar": True}, only_active=True)
    return (V.table(spark, sf, "orders").select(kind.alias("provider")).join(F.broadcast(usable), "provider")
            .groupBy("provider", "label", "res_m").agg(F.count(F.lit(1)).alias("n_scenes")))
