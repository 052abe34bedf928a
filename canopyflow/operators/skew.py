"""Joins that stay balanced when one key holds a large share of the rows.

A key counts as hot when it holds more than ``1 / HOT_SHARE`` of the rows, so
there can never be more than ``HOT_SHARE`` hot keys.  That bound is what makes
broadcasting the list of hot keys safe at any data size.  Rows of a hot key are
spread over ``SALTS`` slices and only the matching rows of the other side are
repeated; every other row takes part in an ordinary equi-join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 1000
MIN_HOT_ROWS = 100_000
SALTS = 64


def hot_keys(df: DataFrame, keys: Sequence[str], share: int = HOT_SHARE,
             min_rows: int = MIN_HOT_ROWS) -> DataFrame:
    """Keys holding more than ``1/share`` of the rows, counted map-side first."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_key_rows"))
    total = df.agg(F.count(F.lit(1))).scalar()
    return (counts.where(F.col("n_key_rows") * share > F.greatest(total, F.lit(share * min_rows)))
            .select(*keys))


def salted_join(big: DataFrame, small: DataFrame, keys: Sequence[str], spread: Sequence[Column | str],
                hot: DataFrame, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Equi-join in which the rows of the ``hot`` keys are cut into slices.

    ``hot`` must have a bounded number of rows (see ``hot_keys``).  ``spread``
    are columns of ``big`` that differ between rows of one key.
    """
    keys = list(keys)
    marks = F.broadcast(hot.select(*keys).withColumn("is_hot", F.lit(True)))
    slice_of = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
    left = (big.join(marks, keys, "left")
            .withColumn("salt", F.when(F.col("is_hot"), slice_of).otherwise(F.lit(0)))
            .drop("is_hot"))
    right = (small.join(marks, keys, "left")
             .withColumn("salt", F.explode(
                 F.when(F.col("is_hot"), F.sequence(F.lit(0), F.lit(salts - 1)))
                 .otherwise(F.array(F.lit(0)))))
             .drop("is_hot"))
    # never by way of the driver: the salted side grows with the data
    return left.join(right.hint("merge"), [*keys, "salt"], how).drop("salt")


def skew_join(big: DataFrame, small: DataFrame, keys: Sequence[str], spread: Sequence[Column | str],
              how: str = "inner", salts: int = SALTS, min_hot_rows: int = MIN_HOT_ROWS) -> DataFrame:
    """``salted_join`` that finds the hot keys of ``big`` itself.

    Keys below ``min_hot_rows`` rows are never salted.
    """
    return salted_join(big, small, keys, spread, hot_keys(big, list(keys), min_rows=min_hot_rows), how, salts)
