"""Incremental verdicts: new observations reclassify only the series they touch."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StringType, StructType

from canopyflow import constants as K
from canopyflow.operators import profiles
from canopyflow.plans.parcel_analysis import analyze_profile

AVAILABLE = {"availableNow": True}
#: Day number of a missing date; real ones count from 1970.
NO_DAY = -(1 << 31)
SUMS, COUNTS = "month_sums", "month_counts"


def _ordered(observations: DataFrame, keys: Sequence[str], tie_breaks: Sequence[str]) -> DataFrame:
    """Key columns, then the columns of the state in the order that ranks a day's
    observations.  No column has nulls: each tie-break brings a flag, by which a
    missing one comes first, as in a batch."""
    types = dict((f.name, f.dataType) for f in observations.schema.fields)
    cloud = F.coalesce(F.col("cloud").cast("double"), F.lit(K.CLOUD_MISSING))
    columns = [F.coalesce(F.unix_date("obs_date"), F.lit(NO_DAY)).alias("_day"),
               F.when(F.isnan(cloud), F.lit(float("inf"))).otherwise(cloud).alias("_cloud")]
    for i, name in enumerate(tie_breaks):
        zero = F.lit("" if isinstance(types[name], StringType) else 0).cast(types[name])
        columns += [F.col(name).isNotNull().alias(f"_has{i}"), F.coalesce(name, zero).alias(f"_tie{i}")]
    columns += [F.col("ndvi_e4").isNotNull().alias("_valued"), F.coalesce(F.col("ndvi_e4").cast("long"), F.lit(0)).alias("_value")]
    return observations.select(*keys, *columns)


def _month_totals(best: Sequence[tuple]) -> tuple[list[int], list[int]]:
    """Sums and counts of the values of one series by calendar month."""
    known = [(row[0], row[-1]) for row in best if row[-2] and row[0] != NO_DAY]
    month = np.array([day for day, _ in known], "datetime64[D]").astype("datetime64[M]").astype(np.int64) % 12
    sums, counts = [0] * 12, [0] * 12
    for m, (_, value) in zip(month.tolist(), known):
        sums[m] += value
        counts[m] += 1
    return sums, counts


def _rank(row: tuple) -> tuple:
    """What ranks the observations of a day; NaN comes behind all numbers."""
    return tuple((v != v, 0 if v != v else v) for v in row[1:-2])


def profile_stream(observations: DataFrame, keys: Sequence[str], tie_breaks: Sequence[str]) -> DataFrame:
    """Monthly profile of every series that a batch touches, from keyed state.

    The state of a series is its best observation of each day (``best_per_day``),
    so a batch costs its own rows and the state of the series in it; no history is
    read again.  A state has at most one entry a day, however many scenes arrive.
    Observations may come in any order and more than once; the first of equal ones
    stays.  Tie-breaks are numbers or strings.  A missing date counts as a day of
    its own that belongs to no month, and a missing value counts as a date only,
    as in ``monthly_profile``.
    """
    rows = _ordered(observations, keys, tie_breaks)
    fields = [f for f in rows.schema.fields if f.name not in keys]
    names = [f.name for f in fields]
    state_type = ", ".join(f"{f.name} array<{f.dataType.simpleString()}>" for f in fields)
    key_fields = StructType([f for f in rows.schema.fields if f.name in keys])
    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in key_fields),
                     f"{SUMS} array<bigint>, {COUNTS} array<bigint>, n_obs bigint, _last int"])

    # a table of its own for each series would cost more than its few rows
    def merge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = {row[0]: row for row in zip(*state.get)} if state.exists else {}
        for batch in batches:
            for row in zip(*(batch[name].tolist() for name in names)):
                kept = best.get(row[0])
                if kept is None or _rank(row) < _rank(kept):
                    best[row[0]] = row
        ordered = [best[day] for day in sorted(best)]
        state.update(tuple(map(list, zip(*ordered))))
        sums, counts = _month_totals(ordered)
        yield pd.DataFrame({**{k: [v] for k, v in zip(keys, key)}, SUMS: [sums], COUNTS: [counts],
                            "n_obs": [len(ordered)], "_last": [ordered[-1][0]]})

    totals = rows.groupBy(*keys).applyInPandasWithState(merge, out, state_type, "update", GroupStateTimeout.NoTimeout)
    last = F.when(F.col("_last") != NO_DAY, F.date_from_unix_date("_last")).alias("last_date")
    return totals.select(*keys, *profiles.month_means(lambda m: F.col(SUMS)[m - 1], lambda m: F.col(COUNTS)[m - 1]), "n_obs", last)


def update_verdicts(observations: DataFrame, curves: DataFrame, keys: Sequence[str], tie_breaks: Sequence[str],
                    store: str, checkpoint: str, as_of: str, trigger: Mapping = AVAILABLE) -> StreamingQuery:
    """Write the verdicts of the series that a batch touches to ``store/verdicts/batch=N``.

    What is known of a series lives in the state below ``checkpoint``
    (``profile_stream``).  Batch folders are overwritten when a batch is repeated.
    ``latest_verdicts`` gives the current verdict of every series.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        verdicts = analyze_profile(batch, curves, as_of)
        (verdicts.select(*keys, "final_class", "final_confidence", "n_obs", "last_date")
         .write.mode("overwrite").parquet(f"{store}/verdicts/batch={batch_id}"))

    return (profile_stream(observations, keys, tie_breaks).writeStream.outputMode("update").foreachBatch(handle)
            .option("checkpointLocation", checkpoint).trigger(**trigger).start())


def latest_verdicts(verdicts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Newest verdict per series from all batches, reduced map-side."""
    values = [c for c in verdicts.columns if c not in keys]
    newest = F.max_by(F.struct(*values), F.col("batch")).alias("v")
    return verdicts.groupBy(*keys).agg(newest).select(*keys, "v.*").drop("batch")
