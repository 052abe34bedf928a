"""Queries that run a whole plan, a stream, or a write and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from canopyflow import constants as K
from canopyflow import schemas
from canopyflow.functions.numbers import half_up
from canopyflow.plans import land_use, parcel_analysis
from canopyflow.plans.calibration import calibrate
from canopyflow.session import shared_dir
from canopyflow.sinks import files
from canopyflow.sources import geojson
from canopyflow.sources import samples as sample_store
from canopyflow.sources.pixels import write_pixels
from canopyflow.sources.curves import land_use_classes, literature_curves
from canopyflow.streaming import audit as audit_stream
from canopyflow.streaming import progress
from canopyflow.streaming import verdicts as verdict_stream
from canopyflow.streaming.snapshot import read_snapshot
from canopyflow.operators import calibration, outline, regions
from canopyflow.workload import pixel_sql as PS
from canopyflow.workload import series_sql as S
from canopyflow.workload import views as V
from canopyflow.workload.parcel_queries import HAS_RINGS, located
from canopyflow.workload.pixel_queries import _REGION_TABLE, grids, masks
from canopyflow.workload.registry import query
from canopyflow.workload.series_queries import _FINAL, KEYS, observations
from canopyflow.workload.smoothing_queries import _CURVES, _SAMPLES, CLASSES, labelled, samples


def fresh_dir(spark) -> str:
    """New folder below the shared one."""
    return f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"


# ---- parcel analysis from pixels ---------------------------------------------------
_POINTS = PS.VALID + """,
points AS (SELECT parcel_id, scene_id, pixels, CAST(floor(total / pixels / 1e7::DOUBLE * 1e4::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS ndvi_e4
  FROM (SELECT parcel_id, year(obs_date) * 100 + month(obs_date) AS scene_id, CAST(sum(ndvi_e7) AS DOUBLE) AS total,
    count(*) AS pixels FROM valid GROUP BY 1, 2)
  WHERE pixels >= 8 AND total / pixels / 1e7::DOUBLE BETWEEN -0.2::DOUBLE AND 0.98::DOUBLE),
listed AS (SELECT parcel_id, year(obs_date) * 100 + month(obs_date) AS scene_id, max(obs_date) AS obs_date,
    max(b04) % 101 AS cloud FROM pixel_bands GROUP BY 1, 2),
placed AS (SELECT *, row_number() OVER (PARTITION BY parcel_id ORDER BY obs_date) - 1 AS pos,
    ceil(count(*) OVER (PARTITION BY parcel_id) / 60.0) AS step FROM listed),
series AS (SELECT p.parcel_id, l.obs_date, p.ndvi_e4 FROM points p JOIN placed l USING (parcel_id, scene_id) WHERE pos % step = 0)"""


def monthly_scenes(bands):
    """Calendar months stand in for scenes, so that each has many pixels."""
    dated = bands.withColumn("scene_id", (F.year("obs_date") * 100 + F.month("obs_date")).cast("bigint"))
    listed = dated.groupBy("parcel_id", "scene_id").agg(
        F.max("obs_date").alias("obs_date"), (F.max("b04") % 101).cast("double").alias("cloud"),
        F.lit("T21").alias("tile"))
    return dated, listed


@query("analysis_from_pixels", f"WITH {_POINTS}, {S.profile('series', 'parcel_id')}, "
       + S.VERDICT_PARTS.replace("series_id", "parcel_id") + " " + _FINAL.replace("series_id", "parcel_id"))
def analysis_from_pixels(spark, sf):
    bands, scenes = monthly_scenes(V.pixel_bands(spark, sf))
    verdicts, _, _ = parcel_analysis.analyze_parcels(bands, scenes, literature_curves(spark), "2001-12-31", max_scenes=60)
    return verdicts.select("parcel_id", F.col("class").alias("rule_class"), "final_class", "final_confidence",
                           F.col("best.class").alias("best_class"), F.col("best.similarity").alias("best_similarity"), "margin")


@query("src2_stored_scenes", f"""WITH {PS.VALID}, listed AS (SELECT parcel_id, year(obs_date) * 100 + month(obs_date) AS scene_id,
    max(obs_date) AS obs_date, max(b04) % 101 AS cloud FROM pixel_bands GROUP BY 1, 2),
  points AS (SELECT parcel_id, year(obs_date) * 100 + month(obs_date) AS scene_id, count(*) AS pixels,
    CAST(sum(ndvi_e7) AS DOUBLE) / count(*) / 1e7::DOUBLE AS mean FROM valid GROUP BY 1, 2),
  narrow AS (SELECT parcel_id, year(obs_date) * 100 + month(obs_date) AS scene_id FROM pixel_bands GROUP BY 1, 2
    HAVING max(px) - min(px) < 1 OR max(py) - min(py) < 1)
SELECT parcel_id, scene_id, pixels, CAST(floor(mean * 1e4::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS ndvi_e4, obs_date, 'T' || parcel_id % 3 AS tile
  FROM points JOIN listed USING (parcel_id, scene_id) ANTI JOIN narrow USING (parcel_id, scene_id)
  WHERE cloud < 40 AND pixels >= 2 AND mean BETWEEN -0.2::DOUBLE AND 0.98::DOUBLE""")
def src2_stored(spark, sf):
    """Pixels stored by tile and month, of which the chosen scenes are read."""
    tile = F.concat(F.lit("T"), (F.col("parcel_id") % 3).cast("string"))
    bands, listed = monthly_scenes(V.pixel_bands(spark, sf))
    path = fresh_dir(spark)
    write_pixels(bands.withColumn("tile", tile), path)
    chosen = parcel_analysis.select_scenes(listed.withColumn("tile", tile).where("cloud < 40"), ["parcel_id"], ["scene_id"])
    return parcel_analysis.series_from_pixels(spark.read.parquet(path), chosen, min_pixels=2).drop("cloud")


@query("calibration_from_series", f"""WITH {_CURVES.replace("'outra_lavoura'", "'pastagem'")} SELECT class, n_samples, {S.ALL} FROM calibrated""")
def calibration_from_series(spark, sf):
    obs = observations(spark, sf)
    names = F.array(*[F.lit(c) for c in CLASSES])
    labels = obs.select("series_id").distinct().withColumn(
        "class", F.get(names, (F.expr("series_id div 10000") % 5).cast("int")))
    result = calibrate(obs, labels, KEYS, literature_curves(spark), "2024-01-01 00:00:00")
    return result.curves.where(F.col("source") == "calibrada").select(
        "class", "n_samples", *[F.get("monthly", F.lit(m - 1)).alias(f"m{m}") for m in S.MONTHS])


# ---- land use ------------------------------------------------------------------------
@query("land_use_regions")
def land_use_regions(spark, sf):
    bands, _ = monthly_scenes(V.pixel_bands(spark, sf))
    result = land_use.map_land_use(bands, grids(spark, sf), literature_curves(spark),
                                   min_area_ha=0.1, zones=5)
    return result.regions.select("parcel_id", "class", "region_id", "area_ha", "label", "colour",
                                 F.size("rings").alias("n_rings"), "truncated")


# ---- files ------------------------------------------------------------------------------
@query("snk1_json_lines", f"WITH {V.OBS} SELECT series_id, obs_date, ndvi_e4 FROM obs")
def snk1(spark, sf):
    path = fresh_dir(spark)
    files.write_json_lines(observations(spark, sf).select("series_id", "obs_date", "ndvi_e4"), path)
    return spark.read.schema("series_id bigint, obs_date date, ndvi_e4 bigint").json(path)


@query("snk4_csv_with_header", f"WITH {V.OBS} SELECT series_id, obs_date, ndvi_e4 / 10000.0::DOUBLE AS ndvi FROM obs")
def snk4(spark, sf):
    path = fresh_dir(spark)
    files.write_csv(observations(spark, sf).select("series_id", "obs_date", (F.col("ndvi_e4") / 10000.0).alias("ndvi")), path)
    return spark.read.schema("series_id bigint, obs_date date, ndvi double").option("header", True).csv(path)


def region_outlines(spark, sf):
    labelled = regions.label_regions(regions.row_runs(masks(spark, sf)))
    table = outline.region_table(labelled, land_use_classes(spark), grids(spark, sf), 0.05)
    return table.join(outline.outline_regions(labelled, grids(spark, sf)), ["parcel_id", "class", "region_id"])


@query("snk2_feature_collections", f"""WITH {PS.REGIONS}, {_REGION_TABLE} SELECT parcel_id, count(*) AS n_features,
  {S.half_up("sum(area_ha)", 1)} AS area_ha, 'FeatureCollection' AS type FROM region_table GROUP BY 1""")
def snk2(spark, sf):
    """The text is read back as JSON to be compared."""
    texts = files.feature_collections(region_outlines(spark, sf))
    doc = F.from_json("geojson", "type string, features array<struct<type:string,properties:struct<area_ha:double>>>")
    parsed = texts.withColumn("doc", doc)
    total = F.aggregate("doc.features", F.lit(0.0), lambda acc, f: acc + f["properties"]["area_ha"])
    return parsed.select("parcel_id", F.size("doc.features").cast("bigint").alias("n_features"),
                         half_up(total, 1).alias("area_ha"), F.col("doc.type").alias("type"))


_KINDS = ("Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon", "GeometryCollection")


@query("snk6_compacted", f"""WITH {V.PARCELS} SELECT ({list(_KINDS)})[parcel_id % 7 + 1] AS kind, count(*) AS n,
  sum(floor(xmin * 1.00037::DOUBLE * 1e4 + 0.5))::BIGINT AS x4, sum(floor(ymin * 1.00037::DOUBLE * 1e4 + 0.5))::BIGINT AS y4,
  sum(length(municipality))::BIGINT AS letters FROM parcels WHERE {HAS_RINGS} GROUP BY 1""")
def snk6(spark, sf):
    """Files of up to 100 features of all geometry types are written, read, compacted, written and read again."""
    scaled = F.expr("transform(rings, r -> transform(r, p -> transform(p, v -> v * 1.00037D)))")
    kind = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (F.col("parcel_id") % 7 + 1).cast("int"))
    ring = F.get("rings", F.lit(0))
    nested = {1: F.get(ring, F.lit(0)), 2: ring, 3: F.array(ring), 4: F.array(F.array(ring))}
    text = F.coalesce(*[F.when(kind == k, F.to_json(nested[n])) for k, n in geojson.DEPTHS.items()])
    member = F.array(F.struct(F.lit("Point").alias("type"), F.to_json(nested[1]).alias("coordinates")))
    features = located(spark, sf).where("rings IS NOT NULL").withColumn("rings", scaled).select(
        F.expr("parcel_id div 100").alias("file"), F.col("parcel_id").alias("ord"), kind.alias("geometry_type"),
        text.alias("coordinates"), F.when(kind == "GeometryCollection", member).alias("geometries"),
        F.create_map(F.lit("name"), F.col("municipality"), F.lit("other"), F.lit("x")).alias("properties"))
    raw, slim = fresh_dir(spark), fresh_dir(spark)
    files.compacted_collections(features).write.partitionBy("file").text(raw)
    found, _ = geojson.read_collections(spark, raw)
    files.compacted_collections(geojson.compact(found)).select("geojson").write.text(slim)
    doc = F.from_json("value", schemas.GEOJSON_COLLECTION)
    back = spark.read.text(slim).select(F.explode(doc["features"]).alias("f")).select("f.geometry.*", "f.properties")
    first = F.regexp_extract_all(F.coalesce("coordinates", F.get("geometries", F.lit(0))["coordinates"]), F.lit(r"(-?[0-9.]+)"))
    at = lambda k: F.sum(F.round(F.get(first, F.lit(k)).cast("double") * 1e4)).cast("bigint")
    return back.groupBy(F.col("type").alias("kind")).agg(
        F.count("*").alias("n"), at(0).alias("x4"), at(1).alias("y4"),
        F.sum(F.when(F.size("properties") == 1, F.length(F.col("properties")["name"]))).cast("bigint").alias("letters"))


@query("snk3_analysis_documents", f"""WITH {S.PROFILE}, {S.VERDICT_PARTS}, final AS ({_FINAL})
SELECT series_id AS parcel_id, final_class, n_obs AS n_points FROM final JOIN profile USING (series_id)""")
def snk3(spark, sf):
    """A document for every series; its parcel gives outline and attributes."""
    obs = observations(spark, sf).withColumnRenamed("series_id", "parcel_id")
    seasons = obs.select("parcel_id", F.expr("parcel_id div 10000").alias("supplier")).distinct()
    outlines = located(spark, sf).withColumnRenamed("parcel_id", "supplier").join(seasons, "supplier").drop("supplier")
    verdicts = parcel_analysis.analyze_observations(obs, ["parcel_id"], literature_curves(spark), "2001-12-31")
    docs = files.analysis_documents(verdicts, obs, outlines, "1", "2024-01-01T00:00:00Z")
    path = fresh_dir(spark)
    files.write_json_lines(docs, path)
    back = spark.read.schema("parcel_id bigint, classification struct<final_class:string>, "
                             "series array<struct<date:date,ndvi:double>>").json(path)
    return back.select("parcel_id", "classification.final_class", F.size("series").cast("bigint").alias("n_points"))


@query("snk5_sample_store", f"""WITH {_SAMPLES} SELECT class, (2 * count(*) - count(*) FILTER (m1 > 0.5 AND class = 'soja_unica'))::BIGINT AS n,
  sum(n_obs * 2 - CASE WHEN m1 > 0.5 AND class = 'soja_unica' THEN n_obs ELSE 0 END)::BIGINT AS n_dates FROM samples GROUP BY 1""")
def snk5(spark, sf):
    """Two key layouts, a batch that arrives twice, and deletions between them."""
    path = f"{fresh_dir(spark)}/samples"
    by_series = samples(spark, sf)
    two_keys = labelled(spark, sf).withColumns({"supplier": F.expr("series_id div 10000"), "harvest": F.col("series_id") % 10000}).drop("series_id")
    sample_store.add_samples(by_series, path)
    gone = by_series.where((F.get("monthly", F.lit(0)) > 0.5) & (F.col("class") == "soja_unica")).select("sample_id")
    sample_store.remove_samples(gone, path)
    sample_store.add_samples(by_series, path)
    sample_store.add_samples(calibration.build_samples(two_keys, "2024-01-01 00:00:00")[0], path)
    return sample_store.read_samples(spark, path).groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.sum("n_dates").alias("n_dates"))


# ---- streams ------------------------------------------------------------------------------
@query("st1_audit_ingest", f"""WITH {V.SESSIONS}, {V.USERS}, {V.AUDIT} SELECT a.id, a.event, coalesce(a.target, '') AS target,
  coalesce(u.username, 'anon') AS username FROM audit a
  LEFT JOIN (sessions s JOIN users u ON u.user_id = s.user_id AND u.active)
    ON s.token = CASE WHEN a.id % 5 <> 0 THEN 'tok' || a.user_id END AND s.expires_at >= a.ts""")
def st1(spark, sf):
    token = F.when(F.col("id") % 5 != 0, F.concat(F.lit("tok"), F.col("user_id").cast("string")))
    events = V.as_audit(V.stream(spark, sf, "events")).withColumn("token", token)
    out = fresh_dir(spark)
    audit_stream.ingest(events, V.sessions(spark, sf), V.users(spark, sf), f"{out}/events", f"{out}/state").awaitTermination()
    return spark.read.parquet(f"{out}/events").select("id", "event", "target", "username")


@query("st2_live_daily_counts", f"WITH {V.AUDIT} SELECT CAST(ts AS DATE) AS day, event, count(*) AS n FROM audit GROUP BY 1, 2")
def st2(spark, sf):
    out = fresh_dir(spark)
    counts = audit_stream.live_counts(V.as_audit(V.stream(spark, sf, "events")))
    audit_stream.keep_counts(counts, f"{out}/counts", f"{out}/state").awaitTermination()
    return read_snapshot(spark, f"{out}/counts", counts.schema)


@query("st4_progress", f"""WITH {S.PROFILE} SELECT count(*) AS done, count(*) FILTER (WHERE n_obs < {K.MIN_DATES_ANALYSIS}) AS failed
  FROM profile""")
def st4(spark, sf):
    """Counters that pass by while verdicts are written."""
    verdicts = parcel_analysis.analyze_observations(observations(spark, sf), KEYS, literature_curves(spark), "2001-12-31",
                                                    min_dates=K.MIN_DATES_ANALYSIS)
    counted, seen = progress.count_series(verdicts)
    counted.write.parquet(f"{fresh_dir(spark)}/verdicts")
    return spark.createDataFrame([(seen.get["done"], seen.get["failed"])], "done bigint, failed bigint")


@query("st3_incremental_verdicts", f"WITH {S.PROFILE}, {S.VERDICT_PARTS}, final AS ({_FINAL}) "
       "SELECT series_id, final_class, final_confidence, n_obs, last_date FROM final JOIN profile USING (series_id)")
def st3(spark, sf):
    out = fresh_dir(spark)
    arriving = V.as_observations(V.stream(spark, sf, "lineitem"))
    verdict_stream.update_verdicts(arriving, literature_curves(spark), KEYS, ["scene_ord", "ndvi_e4"],
                                   out, f"{out}/state", "2001-12-31").awaitTermination()
    return verdict_stream.latest_verdicts(spark.read.parquet(f"{out}/verdicts"), KEYS)
