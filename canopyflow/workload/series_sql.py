"""SQL twins of the series operators, built from shared query parts."""

from __future__ import annotations

from canopyflow.constants import LITERATURE_CURVES, RULE_WEIGHTS, THRESHOLDS, VERDICTS
from canopyflow.workload.views import OBS

MONTHS = range(1, 13)


def half_up(x: str, d: int) -> str:
    scale = f"{10 ** d}.0::DOUBLE"
    return f"(floor(({x}) * {scale} + 0.5::DOUBLE) / {scale})"


def profile(source: str, keys: str, name: str = "profile") -> str:
    cols = ",\n  ".join(
        f"CASE WHEN count(ndvi_e4) FILTER (month(obs_date) = {m}) > 0 THEN "
        f"CAST(sum(ndvi_e4) FILTER (month(obs_date) = {m}) AS DOUBLE) "
        f"/ count(ndvi_e4) FILTER (month(obs_date) = {m}) / 10000.0::DOUBLE END AS m{m}" for m in MONTHS)
    return (f"{name} AS (SELECT {keys}, {cols}, count(*) AS n_obs, max(obs_date) AS last_date "
            f"FROM {source} GROUP BY {keys})")


def _mean(*ms: int) -> str:
    total = " + ".join(["0.0::DOUBLE", *[f"coalesce(m{m}, 0.0::DOUBLE)" for m in ms]])
    count = " + ".join(f"(m{m} IS NOT NULL)::INT" for m in ms)
    return f"CASE WHEN ({count}) > 0 THEN ({total}) / ({count}) END"


def _cols(*ms: int) -> str:
    return ", ".join(f"m{m}" for m in ms)


ALL = _cols(*MONTHS)


def features(source: str = "profile", name: str = "features") -> str:
    present = " + ".join(f"(m{m} IS NOT NULL)::INT" for m in MONTHS)
    return f"""{name} AS (SELECT *, {present} AS n_months, greatest({_cols(11, 12, 1)}) AS soy_peak,
  least({_cols(1, 2)}) AS valley, greatest({_cols(3, 4, 5)}) AS corn_peak,
  greatest({_cols(6, 7, 8)}) AS after_peak, {_mean(6, 7)} AS season_end, {_mean(9, 10)} AS off_season,
  greatest({_cols(12, 1, 2)}) AS summer_peak, greatest({ALL}) - least({ALL}) AS amplitude FROM {source})"""


def classified(source: str = "features", name: str = "classified", thr: dict[str, str] | None = None) -> str:
    t = {k: f"{v}::DOUBLE" for k, v in THRESHOLDS.items()}
    t.update(thr or {})
    rules = {
        "vigor_milho": ("corn_peak IS NOT NULL", f"corn_peak >= {t['vigor_min']}"),
        "pico_no_outono": ("corn_peak IS NOT NULL AND after_peak IS NOT NULL",
                           f"corn_peak - after_peak >= {t['outono_min']}"),
        "vale_jan_fev": ("valley IS NOT NULL AND soy_peak IS NOT NULL",
                         f"soy_peak - valley >= {t['vale_queda_min']} AND valley <= {t['vale_max']}"),
        "soja_forte": ("soy_peak IS NOT NULL", f"soy_peak >= {t['soja_min']}"),
        "senescencia": ("season_end IS NOT NULL AND corn_peak IS NOT NULL",
                        f"corn_peak - season_end >= {t['senesc_min']}"),
        "amplitude": ("TRUE", f"amplitude >= {t['ampl_min']}"),
    }
    flags = ", ".join(f"CASE WHEN {can} THEN {does} END AS rule_{n}" for n, (can, does) in rules.items())
    avail = " + ".join(f"CASE WHEN rule_{n} IS NOT NULL THEN {w} ELSE 0 END" for n, w in RULE_WEIGHTS.items())
    met = " + ".join(f"CASE WHEN rule_{n} THEN {w} ELSE 0 END" for n, w in RULE_WEIGHTS.items())
    return f"""{name}_rules AS (SELECT *, {flags} FROM {source}),
{name}_weights AS (SELECT *, {avail} AS available_weight, {met} AS met_weight FROM {name}_rules),
{name}_scores AS (SELECT *, CASE WHEN n_months >= 4 AND available_weight >= 5
  THEN {half_up('met_weight::DOUBLE / available_weight', 3)} ELSE 0.0::DOUBLE END AS confidence FROM {name}_weights),
{name} AS (SELECT *, CASE
    WHEN n_months < 4 OR available_weight < 5 THEN 'dados_insuficientes'
    WHEN confidence >= 0.72::DOUBLE THEN 'milho_safrinha'
    WHEN confidence >= 0.5::DOUBLE THEN 'provavel_safrinha'
    WHEN soy_peak >= 0.7::DOUBLE AND (corn_peak IS NULL OR corn_peak < 0.6::DOUBLE) THEN 'soja_unica'
    WHEN amplitude < {t['ampl_min']} - 0.10::DOUBLE THEN 'perene'
    WHEN summer_peak >= 0.7::DOUBLE THEN 'pico_verao'
    ELSE 'inconclusivo' END AS class,
  CASE WHEN n_months < 4 THEN 'few_months' WHEN available_weight < 5 THEN 'low_weight' END AS reason
  FROM {name}_scores)"""


def filled(source: str = "profile", name: str = "filled") -> str:
    parts = []
    for m in MONTHS:
        back = [(m - 1 - k) % 12 + 1 for k in range(1, 13)]
        ahead = [(m - 1 + k) % 12 + 1 for k in range(1, 13)]
        p = f"coalesce({_cols(*back)})"
        q = f"coalesce({_cols(*ahead)})"
        dp = "CASE " + " ".join(f"WHEN m{b} IS NOT NULL THEN {k + 1}" for k, b in enumerate(back)) + " END"
        dq = "CASE " + " ".join(f"WHEN m{b} IS NOT NULL THEN {k + 1}" for k, b in enumerate(ahead)) + " END"
        parts.append(f"coalesce(m{m}, ({q} - {p}) / ({dp} + {dq}) * ({dp}) + {p}) AS f{m}")
    return f"{name} AS (SELECT *, {', '.join(parts)} FROM {source})"


def curves_values(name: str = "curves") -> str:
    rows = ", ".join(
        f"({i}, '{c}', '{label}', " + ", ".join(f"{v}::DOUBLE" for v in m) + ")"
        for i, (c, label, m) in enumerate(LITERATURE_CURVES))
    cols = ", ".join(f"b{m}" for m in MONTHS)
    return f"{name}(curve_ord, curve_class, curve_label, {cols}) AS (VALUES {rows})"


def warped(source: str, keys: str, name: str = "warped") -> str:
    """The banded recursion as a chain of steps, one per cell."""
    keep = f"{keys}, curve_ord, curve_class, curve_label, " + ", ".join(
        [f"f{m}" for m in MONTHS] + [f"b{m}" for m in MONTHS])
    steps = [f"w0 AS (SELECT {keep} FROM {source} CROSS JOIN curves)"]
    inf = "'inf'::DOUBLE"

    def cell(i: int, j: int) -> tuple[str, str, str]:
        if i == 0 and j == 0:
            return "0.0::DOUBLE", "0.0::DOUBLE", "0.0::DOUBLE"
        if i == 0 or j == 0 or abs(i - j) > 3:
            return inf, "0.0::DOUBLE", "0.0::DOUBLE"
        return f"c{i}_{j}", f"s{i}_{j}", f"n{i}_{j}"

    # one step per cell: repeated aliases inside one SELECT would be expanded
    last = "w0"
    for i in MONTHS:
        for j in range(max(1, i - 3), min(12, i + 3) + 1):
            d, u, left = cell(i - 1, j - 1), cell(i - 1, j), cell(i, j - 1)
            pick = "CASE WHEN {d} <= {u} AND {d} <= {l} THEN {x} WHEN {u} <= {l} THEN {y} ELSE {z} END"
            out = [pick.format(d=d[0], u=u[0], l=left[0], x=d[k], y=u[k], z=left[k]) for k in range(3)]
            steps.append(f"w{i}_{j} AS (SELECT *, abs(f{i} - b{j}) + {out[0]} AS c{i}_{j}, "
                         f"{out[1]} + ({i - j}) AS s{i}_{j}, {out[2]} + 1 AS n{i}_{j} FROM {last})")
            last = f"w{i}_{j}"
    steps.append(f"{name} AS (SELECT {keys}, curve_ord, curve_class, curve_label, "
                 f"c12_12 / 12 AS distance, s12_12 / n12_12 AS shift FROM {last})")
    return ",\n".join(steps)


def ranked(keys: str, source: str = "warped", name: str = "ranked") -> str:
    return f"""{name}_d AS (SELECT *, floor(distance * 1e4::DOUBLE + 0.5::DOUBLE) AS d4,
    {half_up('1.0::DOUBLE / (1.0::DOUBLE + distance)', 4)} AS similarity,
    {half_up('shift', 2)} AS offset_months FROM {source}),
{name} AS (SELECT *, d4 / 1e4::DOUBLE AS distance_r,
    row_number() OVER (PARTITION BY {keys} ORDER BY d4, curve_ord) AS rank FROM {name}_d),
best AS (SELECT {keys}, max(curve_class) FILTER (rank = 1) AS best_class,
    max(similarity) FILTER (rank = 1) AS best_similarity,
    (max(d4) FILTER (rank = 2) - max(d4) FILTER (rank = 1)) / 1e4::DOUBLE AS margin
  FROM {name} GROUP BY {keys})"""


PROFILE = OBS + ",\n" + profile("obs", "series_id")
FEATURES = PROFILE + ",\n" + features()
CLASSIFIED = FEATURES + ",\n" + classified()
WARPED = PROFILE + ",\n" + ",\n".join([curves_values(), filled(), warped("filled", "series_id"), ranked("series_id")])
VERDICT_PARTS = ",\n".join([features(), classified(), curves_values(), filled(),
                            warped("filled", "series_id"), ranked("series_id")])


def verdict_case(column: str, index: int) -> str:
    whens = " ".join(f"WHEN '{c}' THEN '{v[index]}'" for c, v in VERDICTS.items())
    return f"CASE {column} {whens} END"
