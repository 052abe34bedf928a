"""Expressions over a 12-month profile held in columns ``m1..m12``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from canopyflow.schemas import MONTH_COLS

# Neighbours wrap around the year: the profile is laid out three times, known
# months keep their position, and a gap is filled on the line between the
# nearest known months on both sides.
CYCLIC_FILL_SQL = """
CASE WHEN exists({a}, v -> v IS NOT NULL) THEN
  transform(
    array(filter(
      transform(concat({a}, {a}, {a}), (v, i) -> struct(i - 12 AS pos, v AS val)),
      s -> s.val IS NOT NULL)),
    known -> transform({a}, (v, i) -> coalesce(v,
      transform(
        array(struct(
          element_at(filter(known, s -> s.pos < i), -1) AS p,
          element_at(filter(known, s -> s.pos > i), 1) AS q)),
        n -> (n.q.val - n.p.val) / (n.q.pos - n.p.pos) * (i - n.p.pos) + n.p.val)[0])))[0]
END
"""


def months_array() -> Column:
    return F.array(*MONTH_COLS)


def cyclic_fill(array_sql: str) -> Column:
    """Fill missing months of an array column; null when every month is missing.

    A complete profile skips the fill expression altogether.
    """
    filled = F.expr(CYCLIC_FILL_SQL.format(a=array_sql))
    complete = F.expr(f"NOT exists({array_sql}, v -> v IS NULL)")
    return F.when(complete, F.expr(array_sql)).otherwise(filled)


def peak(*months: int) -> Column:
    return F.greatest(*[F.col(f"m{m}") for m in months])


def valley(*months: int) -> Column:
    return F.least(*[F.col(f"m{m}") for m in months])


def mean_of(*months: int) -> Column:
    """Mean of the months that have a value; null when none has."""
    cols = [F.col(f"m{m}") for m in months]
    total, count = F.lit(0.0), F.lit(0)
    for c in cols:
        total = total + F.coalesce(c, F.lit(0.0))
        count = count + c.isNotNull().cast("int")
    return F.when(count > 0, total / count)


def months_present() -> Column:
    count = F.lit(0)
    for c in MONTH_COLS:
        count = count + F.col(c).isNotNull().cast("int")
    return count


def seasonal_features() -> dict[str, Column]:
    """The season windows every rule and stage is built from."""
    return {
        "n_months": months_present(),
        "soy_peak": peak(11, 12, 1),
        "valley": valley(1, 2),
        "corn_peak": peak(3, 4, 5),
        "after_peak": peak(6, 7, 8),
        "season_end": mean_of(6, 7),
        "off_season": mean_of(9, 10),
        "summer_peak": peak(12, 1, 2),
        "amplitude": peak(*range(1, 13)) - valley(*range(1, 13)),
    }
