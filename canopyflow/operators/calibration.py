"""Reference curves from labelled samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyflow import constants as K
from canopyflow.functions.numbers import E7, to_fixed
from canopyflow.schemas import MONTH_COLS, SAMPLES


def sample_reason(min_dates: int = K.MIN_OBS_SAMPLE) -> Column:
    """Why a labelled profile cannot become a sample; null when it can."""
    present = F.lit(0)
    for c in MONTH_COLS:
        present = present + F.col(c).isNotNull().cast("int")
    known = [name for name, _, _ in K.LITERATURE_CURVES]
    return (F.when(F.col("class").isNull() | ~F.col("class").isin(known), F.lit("unknown_class"))
            .when(F.col("n_obs") < min_dates, F.lit("too_short"))
            .when(present < K.MIN_MONTHS_SAMPLE, F.lit("few_months")))


def build_samples(labelled: DataFrame, created_at: str, min_dates: int = K.MIN_DATES_CALIBRATION) -> tuple[DataFrame, DataFrame]:
    """``(samples, rejects)`` from profiles with ``class`` and sample attributes.

    The id hashes the whole row with its keys, so a retried task repeats the same id
    and equal profiles of different parcels differ; rows that are equal in every
    column are one sample.
    """
    checked = labelled.withColumn("reason", sample_reason(min_dates))
    for name in ("season", "municipality", "note", "geometry"):
        if name not in labelled.columns:
            checked = checked.withColumn(name, F.lit(None).cast("string"))
    content = F.to_json(F.struct(*sorted(labelled.columns)))
    samples = checked.where(F.col("reason").isNull()).select(
        F.sha2(content, 256).alias("sample_id"), "class", "season", "municipality", "note",
        "geometry", F.array(*MONTH_COLS).alias("monthly"), F.col("n_obs").cast("bigint").alias("n_dates"),
        F.lit(created_at).cast("timestamp").alias("created_at"))
    return samples, checked.where(F.col("reason").isNotNull())


def mean_curves(samples: DataFrame, literature: DataFrame) -> DataFrame:
    """Mean curve per class; months nobody saw come from the literature, else a default.

    One aggregation over twelve positions: no sample is exploded, and the map
    side sends one row per class.
    """
    sums = []
    for i in range(12):
        value = to_fixed(F.get("monthly", F.lit(i)), E7)
        sums += [F.sum(value).alias(f"s{i}"), F.count(value).alias(f"c{i}")]
    totals = samples.groupBy("class").agg(F.count(F.lit(1)).alias("n_samples"), *sums)
    base = literature.select("class", "label", F.col("monthly").alias("base"))
    # one row per literature class, a fixed handful
    joined = totals.join(F.broadcast(base), "class", "left")
    months = [F.coalesce(F.when(F.col(f"c{i}") > 0, F.floor(F.col(f"s{i}") / F.col(f"c{i}") / float(E7) * 1000 + 0.5) / 1000.0),
                         F.get("base", F.lit(i)), F.lit(K.MISSING_MONTH_VALUE)) for i in range(12)]
    return joined.select("class", F.coalesce("label", "class").alias("label"), F.array(*months).alias("monthly"), "n_samples")


def reference_curves(literature: DataFrame, calibrated: DataFrame) -> DataFrame:
    """Literature curves, replaced by calibrated ones where at least one sample exists.

    The left side is the fixed curve table; whatever else was calibrated is left out.
    """
    own = calibrated.where(F.col("n_samples") >= 1).select(
        "class", F.col("label").alias("own_label"), F.col("monthly").alias("own_monthly"),
        F.col("n_samples").alias("own_n"))
    joined = literature.join(own, "class", "left")
    use = F.col("own_n").isNotNull()
    return joined.select(
        "curve_ord", "class", F.when(use, F.col("own_label")).otherwise(F.col("label")).alias("label"),
        F.when(use, F.col("own_monthly")).otherwise(F.col("monthly")).alias("monthly"),
        F.coalesce("own_n", F.lit(0)).cast("bigint").alias("n_samples"),
        F.when(use, F.lit(K.SOURCE_CALIBRATED)).otherwise(F.lit(K.SOURCE_LITERATURE)).alias("source"))


def list_samples(samples: DataFrame) -> DataFrame:
    return samples.drop("geometry")


def delete_samples(samples: DataFrame, removed: DataFrame) -> DataFrame:
    """Samples whose id is not in ``removed(sample_id)``."""
    return samples.join(removed.select("sample_id"), "sample_id", "left_anti")


SAMPLE_COLUMNS = SAMPLES.fieldNames()
