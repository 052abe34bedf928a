"""GeoJSON feature collections: reading, checking and compacting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyflow import constants as K
from canopyflow import schemas

POLYGON = "array<array<array<double>>>"
MULTIPOLYGON = f"array<{POLYGON}>"
#: How deep the coordinates of each geometry type are nested.
DEPTHS = {"Point": 1, "MultiPoint": 2, "LineString": 2, "MultiLineString": 3, "Polygon": 3, "MultiPolygon": 4}


def read_collections(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(features, rejects)`` of all GeoJSON files under ``path``.

    Each file is one JSON document.  Files that are no feature collection, or an
    empty one, land in ``rejects`` with a reason instead of failing the run.
    """
    text = (spark.read.option("wholetext", True).text(path)
            .select(F.input_file_name().alias("file"), F.trim("value").alias("value")))
    parsed = text.withColumn("doc", F.from_json("value", schemas.GEOJSON_COLLECTION))
    reason = (F.when(~F.col("value").startswith("{") | F.col("doc").isNull(), F.lit("not_geojson"))
              .when(F.coalesce(F.col("doc.type"), F.lit("")) != "FeatureCollection", F.lit("not_a_collection"))
              .when(F.coalesce(F.size("doc.features"), F.lit(0)) == 0, F.lit("empty")))
    checked = parsed.withColumn("reason", reason)
    features = (checked.where(F.col("reason").isNull())
                .select("file", F.posexplode("doc.features").alias("ord", "f"))
                .select("file", "ord", F.col("f.geometry.type").alias("geometry_type"),
                        F.col("f.geometry.coordinates").alias("coordinates"),
                        F.col("f.geometry.geometries").alias("geometries"),
                        F.col("f.properties").alias("properties"))
                .withColumn("parts", parse_parts("geometry_type", "coordinates")))
    return features, checked.where(F.col("reason").isNotNull()).select("file", "reason")


def parse_parts(kind: str, coordinates: str) -> Column:
    """Polygon parts of a Polygon or MultiPolygon coordinate text, null otherwise."""
    one = F.from_json(F.col(coordinates), POLYGON)
    many = F.from_json(F.col(coordinates), MULTIPOLYGON)
    return (F.when(F.col(kind) == "Polygon", F.when(one.isNotNull(), F.array(one)))
            .when(F.col(kind) == "MultiPolygon", many))


def keep_properties(properties: str, names: tuple[str, ...] = K.GEOJSON_KEEP_PROPERTIES) -> Column:
    return F.map_filter(properties, lambda k, v: k.isin(*names))


def round_parts(parts: str, digits: int) -> Column:
    scale = f"{10 ** digits}D"
    return F.expr(f"transform({parts}, g -> transform(g, r -> transform(r, p -> "
                  f"transform(p, v -> floor(v * {scale} + 0.5D) / {scale}))))")


def round_coordinates(kind: Column, coordinates: Column, digits: int) -> Column:
    """Coordinate text of any geometry type at ``digits`` decimals; text that does not
    fit its type stays as it is."""
    scale = float(10 ** digits)

    def rounded(value: Column, depth: int) -> Column:
        if depth == 0:
            return F.floor(value * scale + 0.5) / scale
        return F.transform(value, lambda v: rounded(v, depth - 1))

    texts = [F.when(kind == name, F.to_json(rounded(F.from_json(coordinates, "array<" * n + "double" + ">" * n), n)))
             for name, n in DEPTHS.items()]
    return F.coalesce(*texts, coordinates)


def compact(features: DataFrame, heavy_bytes: int | None = None) -> DataFrame:
    """Per feature: whitelisted properties and coordinates at four decimals.

    With ``heavy_bytes``, a file whose compacted text would still exceed it gets three
    decimals for all of its features.  All geometry types keep their coordinates
    (``coordinates`` as text, ``geometries`` of a collection, ``parts`` of polygons).
    """
    slim = features.withColumn("properties", keep_properties("properties"))

    def at(digits: int) -> dict[str, Column]:
        return {"parts": round_parts("parts", digits),
                "coordinates": round_coordinates(F.col("geometry_type"), F.col("coordinates"), digits),
                "geometries": F.transform("geometries", lambda g: F.struct(
                    g["type"].alias("type"), round_coordinates(g["type"], g["coordinates"], digits).alias("coordinates")))}

    if heavy_bytes is None:
        return slim.withColumns({**at(4), "digits": F.lit(4)})
    sized = slim.withColumns(at(4))
    n_bytes = F.length(F.to_json(F.struct("coordinates", "geometries", "properties")))
    weights = sized.groupBy("file").agg(F.sum(n_bytes).alias("file_bytes"))
    heavy = F.col("file_bytes") > heavy_bytes
    three, four = at(3), at(4)
    rounded = {name: F.when(heavy, three[name]).otherwise(four[name]) for name in three}
    return (slim.join(weights, "file").withColumns({**rounded, "digits": F.when(heavy, 3).otherwise(4)})
            .drop("file_bytes"))
