"""Regular time grid, gap-aware interpolation and polynomial smoothing.

After averaging to one value per series and day, a series is never longer than
the archive has days.  That bounds every window partition used here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopyflow import constants as K
from canopyflow.functions.dates import date_grid
from canopyflow.functions.numbers import E4, half_up
from canopyflow.functions.savgol import coefficients, effective_window


def daily_values(observations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One value per series and day; several on a day are averaged."""
    return (observations.groupBy(*keys, "obs_date")
            .agg((F.sum("ndvi_e4") / F.count(F.lit(1)) / F.lit(float(E4))).alias("ndvi"),
                 F.count(F.lit(1)).alias("n_rows")))


def grid_dates(daily: DataFrame, keys: Sequence[str], step_days: int = K.STEP_DAYS,
               min_obs: int = K.MIN_OBS_SMOOTHING) -> DataFrame:
    """Grid points of every series that has enough observations."""
    spans = (daily.groupBy(*keys).agg(F.min("obs_date").alias("first"), F.max("obs_date").alias("last"),
                                      F.sum("n_rows").alias("n_obs")).where(F.col("n_obs") >= min_obs))
    return spans.select(*keys, F.posexplode(date_grid("first", "last", step_days)).alias("grid_i", "day"))


def neighbours(daily: DataFrame, keys: Sequence[str], step_days: int = K.STEP_DAYS) -> DataFrame:
    """Grid points with the observation at or before and the one at or after."""
    points = (daily.select(*keys, F.col("obs_date").alias("day"), F.struct("obs_date", "ndvi").alias("seen"),
                           F.lit(None).cast("int").alias("grid_i"))
              .unionByName(grid_dates(daily, keys, step_days).withColumn(
                  "seen", F.lit(None).cast("struct<obs_date:date,ndvi:double>"))))
    ahead, back = Window.partitionBy(*keys).orderBy("day"), Window.partitionBy(*keys).orderBy(F.desc("day"))
    span = (Window.unboundedPreceding, Window.currentRow)
    return (points.withColumn("before", F.last("seen", ignorenulls=True).over(ahead.rangeBetween(*span)))
            .withColumn("after", F.last("seen", ignorenulls=True).over(back.rangeBetween(*span)))
            .where(F.col("grid_i").isNotNull()).drop("seen"))


def interpolate(points: DataFrame, max_gap_days: int = K.MAX_GAP_DAYS) -> DataFrame:
    """Linear value per grid point; null when either side is too far away."""
    lead, trail = F.date_diff("day", "before.obs_date"), F.date_diff("after.obs_date", "day")
    rise = F.col("after.ndvi") - F.col("before.ndvi")
    line = rise / F.date_diff("after.obs_date", "before.obs_date") * lead + F.col("before.ndvi")
    value = F.when(lead == 0, F.col("before.ndvi")).when(trail == 0, F.col("after.ndvi")).otherwise(line)
    return points.withColumn("value", F.when((lead <= max_gap_days) & (trail <= max_gap_days), value))


def _fill_by_index(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    ahead, back = Window.partitionBy(*keys).orderBy("grid_i"), Window.partitionBy(*keys).orderBy(F.desc("grid_i"))
    span = (Window.unboundedPreceding, Window.currentRow)
    known = F.when(F.col("value").isNotNull(), F.struct("grid_i", "value"))
    df = (points.withColumn("known", known)
          .withColumn("p", F.last("known", ignorenulls=True).over(ahead.rowsBetween(*span)))
          .withColumn("q", F.last("known", ignorenulls=True).over(back.rowsBetween(*span))))
    slope = (F.col("q.value") - F.col("p.value")) / (F.col("q.grid_i") - F.col("p.grid_i"))
    between = slope * (F.col("grid_i") - F.col("p.grid_i")) + F.col("p.value")
    filled = F.coalesce("value", F.when(F.col("q").isNull(), F.col("p.value"))
                        .when(F.col("p").isNull(), F.col("q.value")).otherwise(between))
    return df.withColumn("filled", filled).drop("known", "p", "q")


def _dot(weights: Sequence[float], columns: Sequence[Column]) -> Column:
    total = None
    for w, c in zip(weights, columns):
        term = F.lit(float(w)) * c
        total = term if total is None else total + term
    return total


def smooth(points: DataFrame, keys: Sequence[str], window: int = K.SG_WINDOW, order: int = K.SG_ORDER) -> DataFrame:
    """Add ``ndvi_raw`` and ``ndvi_smooth`` (four decimals) to interpolated grid points.

    Gaps are bridged by position only while filtering and are null again after.
    Series with too few valid points keep their unsmoothed values.
    """
    width = effective_window(window)
    half = width // 2
    table = coefficients(width, order)
    whole = Window.partitionBy(*keys)
    ordered = whole.orderBy("grid_i")
    df = _fill_by_index(points, keys).withColumns({
        "n_grid": F.count(F.lit(1)).over(whole), "n_valid": F.count("value").over(whole)})
    names = {}
    for k in range(-(width - 1), width):
        names[k] = f"t{k + width}"
        shifted = F.lag("filled", -k) if k < 0 else F.lead("filled", k)
        df = df.withColumn(names[k], F.col("filled") if k == 0 else shifted.over(ordered))
    i, last = F.col("grid_i"), F.col("n_grid") - 1
    smoothed = None
    for r in range(half):
        start = _dot(table[r], [F.col(names[j - r]) for j in range(width)])
        smoothed = F.when(i == r, start) if smoothed is None else smoothed.when(i == r, start)
    for r in range(half):
        row = width - 1 - r
        smoothed = smoothed.when(i == last - r, _dot(table[row], [F.col(names[j - row]) for j in range(width)]))
    smoothed = smoothed.otherwise(_dot(table[half], [F.col(names[j - half]) for j in range(width)]))
    enough = F.col("n_valid") >= max(window, 5)
    result = F.when(F.col("value").isNotNull(), F.when(enough, smoothed).otherwise(F.col("value")))
    return df.select(*keys, "grid_i", F.col("day").alias("grid_date"),
                     half_up("value", 4).alias("ndvi_raw"), half_up(result, 4).alias("ndvi_smooth"), "n_valid")


def regularize(observations: DataFrame, keys: Sequence[str], step_days: int = K.STEP_DAYS,
               max_gap_days: int = K.MAX_GAP_DAYS, window: int = K.SG_WINDOW, order: int = K.SG_ORDER) -> DataFrame:
    """Observations to a smoothed regular series in long form."""
    daily = daily_values(observations, keys)
    return smooth(interpolate(neighbours(daily, keys, step_days), max_gap_days), keys, window, order)


def monthly_means(smoothed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean of the smoothed values per calendar month, gaps skipped."""
    e4 = F.floor(F.col("ndvi_smooth") * E4 + 0.5)
    return (smoothed.where(F.col("ndvi_smooth").isNotNull())
            .groupBy(*keys, F.month("grid_date").alias("month"))
            .agg((F.sum(e4) / F.count(F.lit(1)) / F.lit(float(E4))).alias("ndvi")))


def chart_rows(observations: DataFrame, smoothed: DataFrame, curves: DataFrame, keys: Sequence[str],
               reference: str = "milho_safrinha") -> DataFrame:
    """Observed, smoothed and reference values on the union of both date axes."""
    monthly = curves.where(F.col("class") == reference).select("monthly").scalar()
    left = observations.select(*keys, F.col("obs_date").alias("date"), "ndvi")
    right = smoothed.select(*keys, F.col("grid_date").alias("date"), "ndvi_smooth")
    return (left.join(right, [*keys, "date"], "full_outer")
            .withColumn("reference", F.get(monthly, F.month("date") - 1)))


def date_axis(observations: DataFrame, smoothed: DataFrame, keys: Sequence[str]) -> DataFrame:
    return (observations.select(*keys, F.col("obs_date").alias("date"))
            .union(smoothed.select(*keys, F.col("grid_date").alias("date"))).distinct())
