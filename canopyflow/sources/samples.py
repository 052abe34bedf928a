"""Append-only store of labelled samples.

Additions and deletions are two folders that only ever grow, so a lost executor
or a repeated write cannot damage what is already stored.  Reading subtracts the
deletions.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyflow import schemas
from canopyflow.operators.calibration import SAMPLE_COLUMNS, delete_samples, mean_curves, reference_curves
from canopyflow.sources.curves import literature_curves


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    """Table at ``path``, or an empty one when nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    stored = _read(spark, f"{path}/added", schemas.SAMPLES)
    removed = _read(spark, f"{path}/removed", "sample_id string")
    # a batch that was appended twice carries the same content-derived ids
    return delete_samples(stored, removed.distinct()).dropDuplicates(["sample_id"])


def add_samples(samples: DataFrame, path: str) -> None:
    samples.select(*SAMPLE_COLUMNS).write.mode("append").parquet(f"{path}/added")


def remove_samples(ids: DataFrame, path: str) -> None:
    ids.select(F.col("sample_id").cast("string")).write.mode("append").parquet(f"{path}/removed")


def current_curves(spark: SparkSession, path: str) -> DataFrame:
    """Curves in force for the samples stored right now."""
    literature = literature_curves(spark)
    return reference_curves(literature, mean_curves(read_samples(spark, path), literature))
