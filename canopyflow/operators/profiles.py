"""Observation series to monthly profiles."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyflow.functions.dates import iso_date
from canopyflow.functions.numbers import E4, to_fixed
from canopyflow.functions.profile import cyclic_fill, months_array
from canopyflow.schemas import MONTH_COLS, MONTHS


def parse_observations(raw: DataFrame, date: str = "date", value: str = "ndvi") -> DataFrame:
    """Typed observations from loose text columns, with a reason for bad rows.

    Rows whose date or value cannot be read get ``reject_reason``; NaN counts as
    unreadable because one NaN would spoil every mean it enters.
    """
    parsed = (raw.withColumn("obs_date", iso_date(F.col(date).cast("string")))
              .withColumn("ndvi_e4", to_fixed(F.col(value).try_cast("double"), E4)))
    reason = (F.when(F.col("obs_date").isNull(), F.lit("bad_date"))
              .when(F.col("ndvi_e4").isNull(), F.lit("bad_value")))
    return parsed.withColumn("reject_reason", reason)


def monthly_profile(observations: DataFrame, keys: Sequence[str], date: str = "obs_date",
                    value_e4: str = "ndvi_e4") -> DataFrame:
    """Mean per calendar month in columns ``m1..m12``, all years pooled.

    One aggregation with twelve conditional integer sums: the map side reduces
    every series to at most one row per partition before the only exchange.
    ``n_months`` counts the months with a value from one mask of bits, so that who
    needs no more does not hold the sums.
    """
    seen = F.bit_or(F.when(F.col(value_e4).isNotNull(), F.call_function("shiftleft", F.lit(1), F.col("month") - 1)))
    sums = [seen.alias("seen_months")]
    for m in MONTHS:
        hit = F.when(F.col("month") == m, F.col(value_e4))
        sums += [F.sum(hit).alias(f"s{m}"), F.count(hit).alias(f"c{m}")]
    totals = observations.withColumn("month", F.month(date)).groupBy(*keys).agg(
        *sums, F.count(F.lit(1)).alias("n_obs"), F.max(date).alias("last_date"))
    means = month_means(lambda m: F.col(f"s{m}"), lambda m: F.col(f"c{m}"))
    n_months = F.bit_count(F.coalesce("seen_months", F.lit(0))).alias("n_months")
    return totals.select(*keys, *means, "n_obs", "last_date", n_months)


def month_means(total: Callable[[int], Column], count: Callable[[int], Column]) -> list[Column]:
    """Columns ``m1..m12`` from each month's integer sum and number of values."""
    return [F.when(count(m) > 0, total(m) / count(m) / F.lit(float(E4))).alias(f"m{m}") for m in MONTHS]


def fill_profile(profiles: DataFrame) -> DataFrame:
    """Add ``monthly`` with gaps filled around the year; null if nothing is known."""
    return (profiles.withColumn("raw_monthly", months_array())
            .withColumn("monthly", cyclic_fill("raw_monthly"))
            .drop("raw_monthly"))


def profile_rows(profiles: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Long form ``(keys, month, ndvi)`` of a profile table."""
    pairs = F.array(*[F.struct(F.lit(m).alias("month"), F.col(c).alias("ndvi"))
                      for m, c in zip(MONTHS, MONTH_COLS)])
    return profiles.select(*keys, F.inline(pairs))
