"""Weighted phenology rules, class decision and growth stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyflow import constants as K
from canopyflow.functions.numbers import half_up, text2
from canopyflow.functions.profile import seasonal_features


def resolve_thresholds(df: DataFrame, overrides: str | None = None) -> DataFrame:
    """Struct column ``thr``: defaults, replaced by readable known overrides."""
    fields = []
    for name, default in K.THRESHOLDS.items():
        value = F.lit(default)
        if overrides is not None:
            given = F.try_element_at(F.col(overrides), F.lit(name)).try_cast("double")
            value = F.coalesce(given, value)
        fields.append(value.alias(name))
    return df.withColumn("thr", F.struct(*fields))


def _rule_table() -> list[tuple[str, Column, Column]]:
    """(name, available, met) per rule; availability looks at features only."""
    soy, low, corn = F.col("soy_peak"), F.col("valley"), F.col("corn_peak")
    after, end, amplitude = F.col("after_peak"), F.col("season_end"), F.col("amplitude")
    thr = {name: F.col(f"thr.{name}") for name in K.THRESHOLDS}
    return [
        ("vigor_milho", corn.isNotNull(), corn >= thr["vigor_min"]),
        ("pico_no_outono", corn.isNotNull() & after.isNotNull(), corn - after >= thr["outono_min"]),
        ("vale_jan_fev", low.isNotNull() & soy.isNotNull(),
         (soy - low >= thr["vale_queda_min"]) & (low <= thr["vale_max"])),
        ("soja_forte", soy.isNotNull(), soy >= thr["soja_min"]),
        ("senescencia", end.isNotNull() & corn.isNotNull(), corn - end >= thr["senesc_min"]),
        ("amplitude", F.lit(True), amplitude >= thr["ampl_min"]),
    ]


def _decision(confidence: Column) -> Column:
    soy, corn = F.col("soy_peak"), F.col("corn_peak")
    soy_only = (soy >= 0.7) & (corn.isNull() | (corn < 0.6))
    return (
        F.when(confidence >= K.CONFIRMED_MIN, F.lit("milho_safrinha"))
        .when(confidence >= K.PROBABLE_MIN, F.lit("provavel_safrinha"))
        .when(soy_only, F.lit("soja_unica"))
        .when(F.col("amplitude") < F.col("thr.ampl_min") - F.lit(0.10), F.lit("perene"))
        .when(F.col("summer_peak") >= 0.7, F.lit("pico_verao"))
        .otherwise(F.lit("inconclusivo"))
    )


def classify(profiles: DataFrame, overrides: str | None = None) -> DataFrame:
    """Features, rule outcomes, confidence and class for every profile row.

    Pure column arithmetic on ``m1..m12``: no exchange, stays in one codegen
    stage with whatever produced the profile.
    """
    df = profiles.withColumns(seasonal_features())
    df = resolve_thresholds(df, overrides)
    available, met = F.lit(0), F.lit(0)
    for i, (name, can, does) in enumerate(_rule_table()):
        weight = K.RULE_WEIGHTS[name]
        df = df.withColumn(f"rule_{name}", F.when(can, does))
        hit = F.col(f"rule_{name}")
        available = available + F.when(hit.isNotNull(), weight).otherwise(0)
        met = met + F.when(hit, weight).otherwise(0)
    df = df.withColumns({"available_weight": available, "met_weight": met})
    enough = (F.col("n_months") >= K.MIN_MONTHS) & (F.col("available_weight") >= K.MIN_AVAILABLE_WEIGHT)
    score = half_up(F.col("met_weight") / F.col("available_weight"), 3)
    df = df.withColumn("confidence", F.when(enough, score).otherwise(F.lit(0.0)))
    reason = (F.when(F.col("n_months") < K.MIN_MONTHS, F.lit("few_months"))
              .when(F.col("available_weight") < K.MIN_AVAILABLE_WEIGHT, F.lit("low_weight")))
    return df.withColumns({
        "class": F.when(enough, _decision(F.col("confidence"))).otherwise(F.lit("dados_insuficientes")),
        "reason": reason,
    })


def rule_details(classified: DataFrame) -> DataFrame:
    """Array column ``rules`` with one explained entry per rule."""
    def two(name: str) -> Column:
        return F.format_string("%.2f", F.col(f"thr.{name}"))

    # fixed values: rule descriptions
    texts = {
        "vigor_milho": F.concat(F.lit("Pico de NDVI em mar–mai ≥ "), two("vigor_min"),
                                F.lit(" (vigor do milho safrinha)")),
        "pico_no_outono": F.concat(F.lit("Pico de mar–mai supera jun–ago em ≥ "), two("outono_min"),
                                   F.lit(" (ciclo curto de outono)")),
        "vale_jan_fev": F.concat(F.lit("Vale jan–fev: queda ≥ "), two("vale_queda_min"),
                                 F.lit(" e NDVI ≤ "), two("vale_max")),
        "soja_forte": F.concat(F.lit("Soja vigorosa antes do vale (nov–jan ≥ "), two("soja_min"), F.lit(")")),
        "senescencia": F.concat(F.lit("Senescência do milho em jun–jul (queda ≥ "), two("senesc_min"),
                                F.lit(" do pico)")),
        "amplitude": F.concat(F.lit("Amplitude anual ≥ "), two("ampl_min"),
                              F.lit(" (rotação anual, não perene)")),
    }
    entries = [
        F.struct(F.lit(name).alias("name"), text.alias("description"),
                 F.lit(K.RULE_WEIGHTS[name]).alias("weight"),
                 F.col(f"rule_{name}").isNotNull().alias("available"),
                 F.col(f"rule_{name}").alias("met"))
        for name, text in texts.items()
    ]
    listed = F.array(*entries)
    return classified.withColumn("rules", F.when(F.col("n_months") >= K.MIN_MONTHS, listed)
                                 .otherwise(F.slice(listed, 1, 0)))


def stage_details(classified: DataFrame) -> DataFrame:
    """Array column ``stages``: five growth stages with observed value and check."""
    def two(name: str) -> Column:
        return F.format_string("%.2f", F.col(f"thr.{name}"))

    corn = F.col("corn_peak")
    # fixed values: stage names, windows and expected texts
    table = [
        ("Entressafra / preparo de solo", "set–out", F.lit("0.25–0.35"), F.col("off_season"),
         F.col("off_season").between(0.20, 0.45)),
        ("Pico da soja", "nov–jan", F.concat(F.lit("≥ "), two("soja_min")), F.col("soy_peak"),
         F.col("soy_peak") >= F.col("thr.soja_min")),
        ("Vale: colheita soja + plantio milho", "jan–fev", F.concat(F.lit("≤ "), two("vale_max")),
         F.col("valley"), F.col("valley") <= F.col("thr.vale_max")),
        ("Pico do milho safrinha", "mar–mai", F.concat(F.lit("≥ "), two("vigor_min")), corn,
         corn >= F.col("thr.vigor_min")),
        ("Senescência / colheita do milho", "jun–jul", F.concat(F.lit("queda ≥ "), two("senesc_min")),
         F.col("season_end"), F.col("season_end") <= corn - F.col("thr.senesc_min")),
    ]
    entries = [
        F.struct(F.lit(stage).alias("stage"), F.lit(window).alias("window"), expected.alias("expected"),
                 half_up(seen, 2).alias("observed"), ok.alias("ok"))
        for stage, window, expected, seen, ok in table
    ]
    listed = F.array(*entries)
    return classified.withColumn("stages", F.when(F.col("reason").isNull(), listed)
                                 .otherwise(F.slice(listed, 1, 0)))


def in_progress(classified: DataFrame, as_of: Column) -> DataFrame:
    """Flag seasons whose last observation is recent and falls in January-July."""
    fresh = F.date_diff(as_of, F.col("last_date")) < K.IN_PROGRESS_DAYS
    flag = fresh & (F.month("last_date") <= 7) & F.col("reason").isNull()
    return classified.withColumn("in_progress", F.coalesce(flag, F.lit(False)))


def verdict_texts(classified: DataFrame) -> DataFrame:
    """Columns ``verdict``, ``emoji`` and ``summary``; needs ``in_progress``."""
    verdict, emoji = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, (text, sign) in K.VERDICTS.items():
        verdict = F.when(F.col("class") == name, F.lit(text)).otherwise(verdict)
        emoji = F.when(F.col("class") == name, F.lit(sign)).otherwise(emoji)
    summary = F.concat(
        F.lit("Pico soja (nov–jan): "), text2("soy_peak"), F.lit(" · Vale (jan–fev): "), text2("valley"),
        F.lit(" · Pico milho (mar–mai): "), text2("corn_peak"), F.lit(" · Jun–jul: "), text2("season_end"),
        F.lit(" · Amplitude: "), text2("amplitude"), F.lit("."),
        F.when(F.col("in_progress"), F.lit(K.IN_PROGRESS_SUMMARY)).otherwise(F.lit("")))
    short = (F.when(F.col("reason") == "few_months", F.lit(K.INSUFFICIENT_SUMMARY))
             .when(F.col("reason") == "low_weight", F.lit(K.LOW_WEIGHT_SUMMARY)))
    return classified.withColumns({"verdict": verdict, "emoji": emoji,
                                   "summary": F.coalesce(short, summary)})
