"""Banded time-warping distance between 12-month profiles.

Each cell carries ``(cost, sum of offsets, steps)`` forward, so the mean path
offset needs no back-tracking.  Ties prefer the diagonal, then the step in the
first series, then the step in the second.  Two equal forms exist: an Arrow
function that advances a whole batch per cell (default), and one SQL expression
that stays in the JVM and can be registered as a SQL function.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from canopyflow.constants import WARP_BAND
from canopyflow.functions.profile import CYCLIC_FILL_SQL

WARP_TYPE = "array<struct<cost:double,shift:double>>"


def warp_batch(a: np.ndarray, b: np.ndarray, band: int = WARP_BAND) -> tuple[np.ndarray, np.ndarray]:
    """Distance and mean offset of row-aligned profile batches of shape (n, 12)."""
    n, length = a.shape
    inf = np.full(n, np.inf)
    zero = np.zeros(n)
    previous = [(zero, zero, zero)] + [(inf, zero, zero)] * length
    for i in range(1, length + 1):
        current = [(inf, zero, zero)] * (length + 1)
        for j in range(max(1, i - band), min(length, i + band) + 1):
            options = (previous[j - 1], previous[j], current[j - 1])
            costs = np.stack([o[0] for o in options])
            pick = costs.argmin(axis=0)
            rows = np.arange(n)
            cost = np.abs(a[:, i - 1] - b[:, j - 1]) + costs[pick, rows]
            shift = np.stack([o[1] for o in options])[pick, rows] + (i - j)
            steps = np.stack([o[2] for o in options])[pick, rows] + 1
            current[j] = (cost, shift, steps)
        previous = current
    cost, shift, steps = previous[length]
    return cost / length, shift / np.maximum(steps, 1)


def _lists_to_matrix(values: pa.Array) -> np.ndarray:
    flat = values.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(values), -1)


def warp_to_curves(profile: Column | str, curves: Column | str, band: int = WARP_BAND) -> Column:
    """Distances of one profile to each curve of an ``array<array<double>>`` column."""

    @F.arrow_udf(WARP_TYPE)
    def run(profiles: pa.Array, curve_lists: pa.Array) -> pa.Array:
        usable = pa.compute.and_(pa.compute.is_valid(profiles), pa.compute.is_valid(curve_lists))
        keep = usable.to_numpy(zero_copy_only=False).astype(bool)
        counts = np.where(keep, pa.compute.fill_null(
            pa.compute.list_value_length(curve_lists), 0).to_numpy(zero_copy_only=False), 0)
        picked_profiles = profiles.filter(usable)
        picked_curves = curve_lists.filter(usable).flatten()
        if len(picked_profiles):
            a = np.repeat(_lists_to_matrix(picked_profiles), counts[keep], axis=0)
            cost, shift = warp_batch(a, _lists_to_matrix(picked_curves), band)
        else:
            cost = shift = np.zeros(0)
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        items = pa.StructArray.from_arrays([pa.array(cost), pa.array(shift)], ["cost", "shift"])
        return pa.ListArray.from_arrays(pa.array(offsets), items, mask=pa.array(~keep))

    # marked so that the optimizer evaluates the batch once and never copies the
    # call into a filter or generator
    return run.asNondeterministic()(profile, curves)


def warp_sql(a: str, b: str, band: int = WARP_BAND, length: int = 12) -> str:
    """The same recursion as one SQL expression returning ``struct<cost,shift>``.

    A line holds the cells of the band only, by ``k = j - i + band``: the diagonal is
    ``k`` of the line before, the step in the first series ``k + 1``.  Both profiles
    are bound once, whatever expressions they are.
    """
    blank = "named_struct('c', CAST('Infinity' AS DOUBLE), 's', 0D, 'n', 0D)"
    start = "named_struct('c', 0D, 's', 0D, 'n', 0D)"
    choose = (
        "CASE WHEN row[k].c <= row[k + 1].c AND row[k].c <= element_at(cur, -1).c THEN row[k] "
        "WHEN row[k + 1].c <= element_at(cur, -1).c THEN row[k + 1] ELSE element_at(cur, -1) END"
    )
    cell = (
        f"CASE WHEN i + k - {band} BETWEEN 1 AND {length} THEN transform(array({choose}), p -> "
        f"named_struct('c', abs(v.a[i - 1] - v.b[i + k - {band + 1}]) + p.c, 's', p.s + ({band} - k), 'n', p.n + 1D))[0] "
        f"ELSE {blank} END"
    )
    line = (f"slice(aggregate(sequence(0, {2 * band}), array({blank}), (cur, k) -> concat(cur, array({cell}))), "
            f"2, {2 * band + 1})")
    first = f"concat(array_repeat({blank}, {band}), array({start}), array_repeat({blank}, {band + 1}))"
    return (
        f"transform(array(named_struct('a', {a}, 'b', {b})), v -> aggregate(sequence(1, {length}), {first}, "
        f"(row, i) -> concat({line}, array({blank})), row -> named_struct('cost', row[{band}].c / {length}, "
        f"'shift', row[{band}].s / row[{band}].n)))[0]"
    )


def warp_native(a: str, b: str, band: int = WARP_BAND) -> Column:
    return F.expr(warp_sql(a, b, band))


def register_sql_functions(spark: SparkSession) -> None:
    """Make ``cyclic_fill(profile)`` and ``warp_distance(a, b)`` callable from SQL."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION cyclic_fill(a ARRAY<DOUBLE>) RETURNS ARRAY<DOUBLE> "
        f"RETURN {CYCLIC_FILL_SQL.format(a='a')}")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION warp_distance(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) "
        f"RETURNS STRUCT<cost: DOUBLE, shift: DOUBLE> RETURN {warp_sql('a', 'b')}")
