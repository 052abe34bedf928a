"""Reference curves and other small fixed dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyflow import constants as K
from canopyflow import schemas


def literature_curves(spark: SparkSession) -> DataFrame:
    rows = [(i, name, label, monthly, 0, K.SOURCE_LITERATURE)
            for i, (name, label, monthly) in enumerate(K.LITERATURE_CURVES)]
    return spark.createDataFrame(rows, schemas.CURVES)


def land_use_classes(spark: SparkSession) -> DataFrame:
    rows = [(i, *row) for i, row in enumerate(K.LAND_USE_CLASSES)]
    return spark.createDataFrame(rows, "class_ord int, class string, label string, colour string")


def providers(spark: SparkSession, active: dict[str, bool] | None = None,
              only_active: bool = False) -> DataFrame:
    """Imagery providers; ``active`` overrides the flag of single providers."""
    overrides = active or {}
    rows = [(*row[:5], overrides.get(row[0], row[5]), row[6]) for row in K.PROVIDERS]
    df = spark.createDataFrame(rows, schemas.PROVIDERS)
    return df.where(F.col("active")) if only_active else df
