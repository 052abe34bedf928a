"""Writers; each task writes its own part, nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyflow.functions import rings as R
from canopyflow.functions.numbers import half_up


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def polygon(rings: Column) -> Column:
    return F.struct(F.lit("Polygon").alias("type"), rings.alias("coordinates"))


def feature_collections(regions: DataFrame) -> DataFrame:
    """One GeoJSON text per parcel from regions with rings, in class and area order.

    The region cap (600 a parcel) bounds what is collected into one row.
    """
    properties = F.struct("class", "label", "colour", "area_ha")
    feature = F.struct(F.lit("Feature").alias("type"), polygon(F.col("rings")).alias("geometry"),
                       properties.alias("properties"))
    listed = F.sort_array(F.collect_list(F.struct(
        "class_ord", (-F.col("area_ha")).alias("smaller"), "region_id", feature.alias("feature"))))
    grouped = regions.groupBy("parcel_id").agg(listed.alias("items"))
    collection = F.struct(F.lit("FeatureCollection").alias("type"),
                          F.transform("items", lambda i: i["feature"]).alias("features"))
    return grouped.select("parcel_id", F.to_json(collection).alias("geojson"))


def write_feature_collections(regions: DataFrame, path: str) -> None:
    """One line of GeoJSON per parcel."""
    feature_collections(regions).select("geojson").write.mode("errorifexists").text(path)


def compacted_collections(features: DataFrame) -> DataFrame:
    """GeoJSON text per source file from ``sources.geojson.compact``."""

    def simple(kind: Column, coordinates: Column) -> Column:
        return F.concat(F.lit('{"type":"'), kind, F.lit('","coordinates":'), F.coalesce(coordinates, F.lit("[]")), F.lit("}"))

    members = F.transform("geometries", lambda g: simple(g["type"], g["coordinates"]))
    collection = F.concat(F.lit('{"type":"GeometryCollection","geometries":['), F.array_join(members, ","), F.lit("]}"))
    geometry = (F.when(F.col("geometry_type").isNull(), "null").when(F.col("geometries").isNotNull(), collection)
                .otherwise(simple(F.col("geometry_type"), F.col("coordinates"))))
    text = F.concat(F.lit('{"type":"Feature","geometry":'), geometry, F.lit(',"properties":'),
                    F.coalesce(F.to_json("properties"), F.lit("{}")), F.lit("}"))
    grouped = features.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("ord", text.alias("t")))).alias("f"))
    body = F.array_join(F.transform("f", lambda x: x["t"]), ",")
    return grouped.select("file", F.concat(F.lit('{"type":"FeatureCollection","features":['), body, F.lit("]}"))
                          .alias("geojson"))


def analysis_documents(verdicts: DataFrame, series: DataFrame, parcels: DataFrame, version: str,
                       generated_at: str, regions: DataFrame | None = None) -> DataFrame:
    """Nested document per parcel: polygon, area, series, verdict, attributes, regions.

    A series holds at most one point per day, so it fits into its row.
    """
    points = series.groupBy("parcel_id").agg(
        F.sort_array(F.collect_list(F.struct("obs_date", "ndvi_e4"))).alias("points"))
    series_ndvi = F.transform("points", lambda p: F.struct(
        p["obs_date"].alias("date"), (p["ndvi_e4"] / 10000.0).alias("ndvi")))
    outlines = parcels.select(
        "parcel_id", "attrs", F.struct(
            F.lit("Feature").alias("type"), polygon(F.col("rings")).alias("geometry"),
            F.struct(half_up(R.geodesic_area_ha("rings"), 1).alias("area_ha")).alias("properties")).alias("polygon"))
    verdict = F.struct("final_class", "final_confidence", "verdict", "emoji", "summary", "rules", "stages",
                       "ranking", "margin", "in_progress", "thr")
    docs = (verdicts.select("parcel_id", verdict.alias("classification"))
            .join(points.select("parcel_id", series_ndvi.alias("series")), "parcel_id")
            .join(outlines, "parcel_id", "left"))
    vectorized = F.lit(None).cast("string")
    if regions is not None:
        docs = docs.join(feature_collections(regions), "parcel_id", "left")
        vectorized = F.col("geojson")
    return docs.select(
        "parcel_id", F.lit(version).alias("version"), F.lit(generated_at).alias("generated_at"), "polygon", "series",
        "classification", F.col("attrs").alias("parcel_attributes"), vectorized.alias("vectorized"))
