"""Ranking of profiles against reference curves, and the final arbitration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyflow import constants as K
from canopyflow.functions.numbers import half_up
from canopyflow.functions.warp import warp_sql, warp_to_curves


def curve_list(curves: DataFrame) -> Column:
    """All curves of length 12 as one array value, in curve order.

    Curves are one row per crop class, a fixed small domain.  Folding them into
    a scalar subquery lets every series meet every curve without a join.
    """
    usable = curves.where(F.size("monthly") == 12)
    entry = F.struct("curve_ord", "class", "label", "monthly")
    return usable.agg(F.sort_array(F.collect_list(entry)).alias("curves")).scalar()


def rank_curves(profiles: DataFrame, curves: DataFrame, band: int = K.WARP_BAND,
                native: bool = False) -> DataFrame:
    """Add ``ranking`` (best first), ``best`` and ``margin`` to filled profiles.

    Ranking happens inside the row, on an array with one entry per curve, so
    neither the pairing nor the ordering needs an exchange.
    """
    df = profiles.withColumn("curves", curve_list(curves))
    if native:
        each = warp_sql("monthly", "k.monthly", band)
        df = df.withColumn("warped", F.expr(
            f"CASE WHEN monthly IS NOT NULL THEN transform(curves, k -> {each}) END"))
    else:
        df = df.withColumn("warped", warp_to_curves("monthly", F.col("curves.monthly"), band))
    zipped = F.zip_with("curves", "warped", lambda c, w: F.struct(
        F.floor(w["cost"] * 1e4 + 0.5).alias("distance_e4"),
        c["curve_ord"].alias("curve_ord"),
        c["class"].alias("class"),
        c["label"].alias("label"),
        half_up(F.lit(1.0) / (F.lit(1.0) + w["cost"]), 4).alias("similarity"),
        half_up(w["shift"], 2).alias("offset_months"),
    ))
    # struct order compares the rounded distance first, then the curve order
    df = df.withColumn("ranking", F.array_sort(zipped)).drop("curves", "warped")
    first, second = F.try_element_at("ranking", F.lit(1)), F.try_element_at("ranking", F.lit(2))
    margin = (second["distance_e4"] - first["distance_e4"]) / F.lit(1e4)
    return df.withColumns({"best": first, "margin": margin})


def ranking_rows(ranked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Long form, one row per series and curve with its rank.

    The outer form keeps the optimizer from testing the ranking for emptiness first,
    which would compute it once more for every test.
    """
    exploded = ranked.select(*keys, F.posexplode_outer("ranking").alias("pos", "r")).where(F.col("pos").isNotNull())
    return exploded.select(
        *keys, (F.col("pos") + 1).alias("rank"), F.col("r.class").alias("class"),
        F.col("r.label").alias("label"), (F.col("r.distance_e4") / F.lit(1e4)).alias("distance"),
        F.col("r.similarity").alias("similarity"), F.col("r.offset_months").alias("offset_months"))


def _cotton_wins() -> Column:
    corn = F.col("class").isin("milho_safrinha", "provavel_safrinha")
    clear = F.coalesce(F.col("margin"), F.lit(0.0)) >= K.COTTON_MARGIN
    return F.coalesce(corn & (F.col("best.class") == "algodao") & clear, F.lit(False))


def arbitrate_parcel(ranked: DataFrame) -> DataFrame:
    """Let the curve ranking settle what the rules alone cannot separate.

    Adds the ``final_*`` columns; texts are added when ``verdict`` is present.
    """
    tie_break = F.coalesce(
        (F.col("class") == "pico_verao") & F.col("best.class").isin("milho_1a_safra", "soja_unica"),
        F.lit(False))
    cotton = _cotton_wins()
    blended = half_up(F.least(F.lit(K.COTTON_MAX_CONFIDENCE),
                              F.col("confidence") * 0.7 + F.col("best.similarity") * 0.3), 3)
    out = ranked.withColumns({
        "final_class": F.when(tie_break, F.col("best.class"))
                        .when(cotton, F.lit("algodao")).otherwise(F.col("class")),
        "final_confidence": F.when(cotton, blended).otherwise(F.col("confidence")),
        "tie_break": tie_break,
        "warp_override": cotton,
    })
    if "verdict" in ranked.columns:
        text, sign = K.COTTON_VERDICT
        out = out.withColumns({
            "verdict": F.when(tie_break, F.concat(F.col("best.label"), F.lit(K.TIE_BREAK_SUFFIX)))
                        .when(cotton, F.lit(text)).otherwise(F.col("verdict")),
            "emoji": F.when(cotton, F.lit(sign)).otherwise(F.col("emoji")),
            "summary": F.when(cotton, F.concat("summary", F.format_string(K.COTTON_SUMMARY, "margin")))
                        .otherwise(F.col("summary")),
        })
    return out


def arbitrate_zone(ranked: DataFrame, mean_value: str = "zone_mean") -> DataFrame:
    """Land-use class of a zone: cotton veto, forest or pasture, fallbacks.

    Unlike the parcel form there is no summer tie-break and the confidence of
    the rules is kept.
    """
    forest = F.when(F.col(mean_value) >= K.FOREST_MEAN_MIN, F.lit("mata")).otherwise(F.lit("pastagem"))
    short = F.col("n_obs") < K.MIN_POINTS_ZONE
    return ranked.withColumns({
        "warp_override": _cotton_wins() & ~short,
        "zone_class": F.when(short, F.lit(K.OTHER))
                       .when(_cotton_wins(), F.lit("algodao"))
                       .when(F.col("class") == "perene", forest)
                       .when(F.col("class").isin("inconclusivo", "dados_insuficientes"), F.lit(K.OTHER))
                       .when(F.col("class") == "provavel_safrinha", F.lit(K.CORN))
                       .otherwise(F.col("class")),
        "zone_confidence": F.when(short, F.lit(0.0)).otherwise(F.col("confidence")),
    })
