"""Row layouts of the tables the operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T

RINGS = T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType())))

SCENES = T.StructType([
    T.StructField("scene_id", T.LongType()),
    T.StructField("obs_date", T.DateType()),
    T.StructField("cloud", T.DoubleType()),
    T.StructField("tile", T.StringType()),
    T.StructField("baseline", T.StringType()),
    T.StructField("xmin", T.DoubleType()),
    T.StructField("ymin", T.DoubleType()),
    T.StructField("xmax", T.DoubleType()),
    T.StructField("ymax", T.DoubleType()),
])

CURVES = T.StructType([
    T.StructField("curve_ord", T.IntegerType()),
    T.StructField("class", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("monthly", T.ArrayType(T.DoubleType())),
    T.StructField("n_samples", T.LongType()),
    T.StructField("source", T.StringType()),
])

SAMPLES = T.StructType([
    T.StructField("sample_id", T.StringType()),
    T.StructField("class", T.StringType()),
    T.StructField("season", T.StringType()),
    T.StructField("municipality", T.StringType()),
    T.StructField("note", T.StringType()),
    T.StructField("geometry", T.StringType()),
    T.StructField("monthly", T.ArrayType(T.DoubleType())),
    T.StructField("n_dates", T.LongType()),
    T.StructField("created_at", T.TimestampType()),
])

AUDIT_EVENTS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("username", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("event", T.StringType()),
    T.StructField("page", T.StringType()),
    T.StructField("target", T.StringType()),
    T.StructField("meta", T.StringType()),
    T.StructField("ip", T.StringType()),
])

PROVIDERS = T.StructType([
    T.StructField("provider", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("res_m", T.DoubleType()),
    T.StructField("revisit", T.StringType()),
    T.StructField("bands", T.ArrayType(T.StringType())),
    T.StructField("active", T.BooleanType()),
    T.StructField("note", T.StringType()),
])

# GeoJSON geometries differ in nesting depth, so coordinates are kept as text
# and parsed per geometry type.
GEOJSON_COLLECTION = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("features", T.ArrayType(T.StructType([
        T.StructField("type", T.StringType()),
        T.StructField("geometry", T.StructType([
            T.StructField("type", T.StringType()),
            T.StructField("coordinates", T.StringType()),
            T.StructField("geometries", T.ArrayType(T.StructType([
                T.StructField("type", T.StringType()),
                T.StructField("coordinates", T.StringType()),
            ]))),
        ])),
        T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
    ]))),
])

MONTHS = list(range(1, 13))
MONTH_COLS = [f"m{m}" for m in MONTHS]
