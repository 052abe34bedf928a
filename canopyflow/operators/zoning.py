"""Land-use zones: k-means on monthly vectors for all parcels at once, then classes.

All values are integers in 1e-7 units and centres are rounded to that unit, so
squared distances and sums are exact and the zones do not depend on partitioning.
A parcel is cut into square blocks when its pixels are laid out, so no task
depends on the size of a parcel.  The pixels never move again: in every round
only the centres travel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyflow import constants as K
from canopyflow.functions.numbers import E4, E7
from canopyflow.schemas import MONTH_COLS, MONTHS
from canopyflow.session import cut_lineage, keep_layout, lay_out

MAX_ZONES = 7
BLOCK_SIDE = 256


def zone_count(n_pixels: Column, res: Column) -> Column:
    """Number of zones by parcel size; a single one when there are few pixels."""
    area = n_pixels * res * res / F.lit(10_000.0)
    by_area = (F.when(area < 100, 3).when(area < 300, 4).when(area < 800, 5)
               .when(area < 2000, 6).otherwise(7))
    capped = F.least(by_area, F.greatest(F.lit(2), F.floor(n_pixels / 200).cast("int")))
    return F.when(n_pixels < K.MIN_PIXELS_ZONING, F.lit(1)).otherwise(capped)


def place(composite: DataFrame) -> DataFrame:
    """Composite pixels laid out by parcel and block of 256 x 256 cells."""
    block = F.floor(F.col("py") / BLOCK_SIDE) * 65536 + F.floor(F.col("px") / BLOCK_SIDE)
    return lay_out(composite.withColumn("block", block.cast("bigint")), "parcel_id", "block")


def parcel_means(placed: DataFrame) -> DataFrame:
    """Per parcel: pixel count, blocks, and the mean of every month.

    Empty months get the default value.  A capped grid has at most 16 blocks.
    """
    default = F.lit(int(K.MISSING_MONTH_VALUE * E7)).cast("bigint")
    fills = [F.coalesce(F.floor(F.try_divide(F.sum(c), F.count(c)) + 0.5).cast("bigint"), default).alias(f"fill{m}")
             for m, c in zip(MONTHS, MONTH_COLS)]
    return placed.groupBy("parcel_id").agg(
        F.count(F.lit(1)).alias("n_pixels"), F.collect_set("block").alias("blocks"), *fills)


def impute(placed: DataFrame, grids: DataFrame) -> DataFrame:
    """Fill missing months with the parcel mean; ``known`` keeps one bit per real month."""
    joined = attach(placed, parcel_means(placed).join(grids.select("parcel_id", "res"), "parcel_id"))
    known = F.lit(0)
    for m, c in zip(MONTHS, MONTH_COLS):
        known = known + F.when(F.col(c).isNotNull(), 1 << (m - 1)).otherwise(0)
    filled = [F.coalesce(F.col(c), F.col(f"fill{m}")).alias(c) for m, c in zip(MONTHS, MONTH_COLS)]
    return joined.select("parcel_id", "block", "px", "py", *filled, known.alias("known"), "n_pixels", "res")


def pixel_matrix(composite: DataFrame, grids: DataFrame, zones: int | None = None) -> DataFrame:
    """Imputed pixel vectors laid out by parcel and block, ready for the rounds.

    ``grids(parcel_id, res)`` gives the cell size; ``zones`` fixes their number.
    """
    k = F.lit(zones) if zones else zone_count(F.col("n_pixels"), F.col("res"))
    filled = impute(place(composite), grids)
    return keep_layout(filled.withColumn("k", F.least(k, F.col("n_pixels")).cast("int")).drop("res"))


def per_block(per_parcel: DataFrame) -> DataFrame:
    """Repeat a parcel row once per block of that parcel."""
    return per_parcel.withColumn("block", F.explode("blocks")).drop("blocks")


def attach(pixels: DataFrame, per_parcel: DataFrame) -> DataFrame:
    """Join parcel-level columns onto laid-out pixels without moving the pixels."""
    return pixels.join(per_block(per_parcel), ["parcel_id", "block"])


def _distance(j: int) -> Column:
    """Squared distance to centre ``j`` of the flat array ``centres``; null beyond the last.

    Written out month by month, so it compiles to plain integer arithmetic.
    """
    gaps = [f"({c} - get(centres, {j * 12 + i}))" for i, c in enumerate(MONTH_COLS)]
    return F.expr(" + ".join(f"{g} * {g}" for g in gaps))


def _with_distances(pixels: DataFrame, most: int) -> DataFrame:
    return pixels.withColumns({f"d{j}": _distance(j) for j in range(most)})


def _closest(most: int) -> str:
    return "d0" if most == 1 else "least(" + ", ".join(f"d{j}" for j in range(most)) + ")"


def _nearest(most: int) -> Column:
    hits = " ".join(f"WHEN d{j} = {_closest(most)} THEN {j}" for j in range(most))
    return F.expr(f"CASE {hits} END")


def assign(matrix: DataFrame, centres: DataFrame, most: int = MAX_ZONES) -> DataFrame:
    """Zone of the nearest centre for every pixel, the first one on ties."""
    near = _with_distances(attach(matrix, centres.select("parcel_id", "blocks", "centres")), most)
    return near.withColumn("zone_id", _nearest(most)).drop("centres", *[f"d{j}" for j in range(most)])


def largest_zone_count(matrix: DataFrame) -> int:
    return matrix.agg(F.max("k")).first()[0] or 1


def first_centres(matrix: DataFrame, most: int = MAX_ZONES) -> DataFrame:
    """Deterministic start: farthest pixel from the parcel mean, then farthest-first.

    Each round keeps one candidate per parcel and partition before the exchange.
    """
    vector = [F.col(c) for c in MONTH_COLS]
    centre = matrix.groupBy("parcel_id").agg(
        F.first("k").alias("k"), F.collect_set("block").alias("blocks"),
        F.array(*[F.floor(F.sum(c) / F.count(c) + 0.5) for c in MONTH_COLS]).alias("centres"))
    centre = cut_lineage(centre)
    for j in range(most):
        wanted = centre if j == 0 else centre.where(F.col("k") > j)
        seen = max(j, 1)
        far = _with_distances(attach(matrix, wanted.select("parcel_id", "blocks", "centres")), seen)
        dmin = F.expr(_closest(seen))
        pick = F.max(F.struct(dmin.alias("d"), (-F.col("py")).alias("y"), (-F.col("px")).alias("x"),
                              F.array(*vector).alias("v"))).alias("pick")
        chosen = far.groupBy("parcel_id").agg(pick).select("parcel_id", F.col("pick.v").alias("v"))
        grown = (F.col("v") if j == 0 else F.when(F.col("v").isNull(), F.col("centres"))
                 .otherwise(F.concat("centres", "v")))
        centre = cut_lineage(centre.join(chosen, "parcel_id", "left").select(
            "parcel_id", "k", "blocks", grown.alias("centres")))
    return centre


def lloyd_step(matrix: DataFrame, centres: DataFrame, most: int = MAX_ZONES) -> DataFrame:
    """One assign-and-update round; a centre without pixels stays where it is."""
    sums = assign(matrix, centres, most).groupBy("parcel_id", "zone_id").agg(
        *[F.floor(F.sum(c) / F.count(c) + 0.5).cast("bigint").alias(c) for c in MONTH_COLS])
    # at most MAX_ZONES entries per parcel
    fresh = sums.groupBy("parcel_id").agg(F.map_from_entries(F.collect_list(
        F.struct("zone_id", F.array(*MONTH_COLS)))).alias("fresh"))
    moved = F.flatten(F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: F.coalesce(
        F.try_element_at("fresh", j), F.slice("centres", j * 12 + 1, 12))))
    return (centres.join(fresh, "parcel_id")
            .select("parcel_id", "k", "blocks", moved.alias("next"), "centres")
            .select("parcel_id", "k", "blocks", F.col("next").alias("centres"),
                    (F.col("next") != F.col("centres")).alias("moved")))


def fit_zones(matrix: DataFrame, rounds: int = 25, most: int = MAX_ZONES) -> DataFrame:
    """Centres after at most ``rounds`` rounds over all parcels together.

    Parcels whose centres stand still are finished; stopping them early gives
    the same centres as running every round.
    """
    active = first_centres(matrix, most).withColumn("moved", F.lit(True))
    finished = None
    for _ in range(rounds):
        stepped = cut_lineage(lloyd_step(matrix, active.drop("moved"), most))
        still = stepped.where(~F.col("moved"))
        finished = still if finished is None else finished.unionByName(still)
        active = stepped.where("moved")
        if active.isEmpty():
            break
    return finished.unionByName(active).select("parcel_id", "k", "blocks", "centres")


def segment(matrix: DataFrame, rounds: int = 25) -> DataFrame:
    """Pixels with their zone, written once because profiles, masks and statistics all read them."""
    most = largest_zone_count(matrix)
    return keep_layout(assign(matrix, fit_zones(matrix, rounds, most), most))


def zone_profiles(zoned: DataFrame) -> DataFrame:
    """Monthly mean of the real (not imputed) values per zone, four decimals.

    Columns as ``monthly_profile`` gives them, so the series operators apply.
    """
    known = {m: F.col("known").bitwiseAND(F.lit(1 << (m - 1))) > 0 for m in MONTHS}
    sums = []
    for m, c in zip(MONTHS, MONTH_COLS):
        value = F.when(known[m], F.col(c))
        sums += [F.sum(value).alias(f"s{m}"), F.count(value).alias(f"c{m}")]
    totals = zoned.groupBy("parcel_id", "zone_id").agg(*sums, F.count(F.lit(1)).alias("n_px"))
    means = [F.when(F.col(f"c{m}") > 0,
                    F.floor(F.col(f"s{m}") / F.col(f"c{m}") / F.lit(float(E7)) * 1e4 + 0.5)).alias(f"e{m}")
             for m in MONTHS]
    wide = totals.select("parcel_id", "zone_id", "n_px", *means)
    present = sum((F.col(f"e{m}").isNotNull().cast("bigint") for m in MONTHS), F.lit(0).cast("bigint"))
    total = sum((F.coalesce(F.col(f"e{m}"), F.lit(0)) for m in MONTHS), F.lit(0).cast("bigint"))
    return wide.select(
        "parcel_id", "zone_id", "n_px",
        *[(F.col(f"e{m}") / F.lit(float(E4))).alias(f"m{m}") for m in MONTHS],
        present.alias("n_obs"), F.try_divide(total, present * E4).alias("zone_mean"))


def zone_series(profiles: DataFrame, start_year: Column) -> DataFrame:
    """Zone profile as dated observations on the 15th of each month of the season."""
    from canopyflow.functions.dates import season_mid_month
    rows = F.array(*[F.struct(F.lit(m).alias("month"), F.col(c).alias("ndvi")) for m, c in zip(MONTHS, MONTH_COLS)])
    return (profiles.select("parcel_id", "zone_id", start_year.alias("start_year"), F.inline(rows))
            .where(F.col("ndvi").isNotNull())
            .select("parcel_id", "zone_id", season_mid_month("start_year", "month").alias("obs_date"), "ndvi"))


def class_pixels(zoned: DataFrame, zone_classes: DataFrame) -> DataFrame:
    """Class of every pixel through its zone.

    Zone classes travel as one small map per parcel and block, so pixels stay put.
    """
    maps = zone_classes.groupBy("parcel_id").agg(F.map_from_entries(
        F.collect_list(F.struct("zone_id", "zone_class"))).alias("by_zone"))
    blocks = zoned.groupBy("parcel_id").agg(F.collect_set("block").alias("blocks"))
    joined = attach(zoned, maps.join(blocks, "parcel_id"))
    return (joined.withColumn("class", F.try_element_at("by_zone", F.col("zone_id")))
            .select("parcel_id", "px", "py", "zone_id", "class"))


def corn_takes_precedence(pixels: DataFrame, corn: DataFrame) -> DataFrame:
    """Refined corn pixels, plus the pixels of other classes they do not cover."""
    keys = ["parcel_id", "px", "py"]
    others = pixels.where(F.col("class") != K.CORN).select(*keys, "class").join(corn.select(*keys), keys, "left_anti")
    return others.unionByName(corn.select(*keys, F.lit(K.CORN).alias("class")))
