"""SQL twins of the pixel, zone and region operators."""

from __future__ import annotations

from canopyflow.workload.series_sql import half_up
from canopyflow.workload.views import PIXEL_BANDS

MONTHS = range(1, 13)

VALID = PIXEL_BANDS + """,
shifted AS (SELECT *, CASE WHEN coalesce(baseline, '04.00') >= '04.00' THEN 1000 ELSE 0 END AS off FROM pixel_bands),
valid AS (SELECT *, CAST(floor((b08 - b04)::DOUBLE / ((b08 - off) + (b04 - off))::DOUBLE * 1e7::DOUBLE + 0.5::DOUBLE)
                         AS BIGINT) AS ndvi_e7
  FROM shifted WHERE b04 > 0 AND b08 > 0 AND scl IN (4, 5) AND (b08 - off) + (b04 - off) > 200)"""

_MONTH_MEANS = ", ".join(
    f"CAST(floor(CAST(sum(ndvi_e7) FILTER (month(obs_date) = {m}) AS DOUBLE) "
    f"/ count(*) FILTER (month(obs_date) = {m}) + 0.5::DOUBLE) AS BIGINT) AS m{m}" for m in MONTHS)
_PRESENT = " + ".join(f"(m{m} IS NOT NULL)::INT" for m in MONTHS)
COMPOSITE = VALID + f""",
wide AS (SELECT parcel_id, px, py, {_MONTH_MEANS} FROM valid
  WHERE ndvi_e7 > -2000000 AND ndvi_e7 < 9800000 GROUP BY 1, 2, 3),
composite AS (SELECT *, {_PRESENT} AS n_months FROM wide WHERE {_PRESENT} >= 6)"""

_FILLS = ", ".join(
    f"coalesce(CAST(floor(CAST(sum(m{m}) AS DOUBLE) / nullif(count(m{m}), 0) + 0.5::DOUBLE) AS BIGINT), 3000000) AS fill{m}"
    for m in MONTHS)
IMPUTED = COMPOSITE + f""",
means AS (SELECT parcel_id, count(*) AS n_pixels, {_FILLS} FROM composite GROUP BY 1),
imputed AS (SELECT c.parcel_id, px, py, n_pixels, {", ".join(f"coalesce(m{m}, fill{m}) AS m{m}" for m in MONTHS)},
  {" + ".join(f"CASE WHEN m{m} IS NOT NULL THEN {1 << (m - 1)} ELSE 0 END" for m in MONTHS)} AS known
  FROM composite c JOIN means USING (parcel_id))"""

_M = ", ".join(f"m{m}" for m in MONTHS)


def _dist(a: str, b: str) -> str:
    return " + ".join(f"({a}.m{m} - {b}.m{m}) * ({a}.m{m} - {b}.m{m})" for m in MONTHS)


def _means(alias: str = "") -> str:
    return ", ".join(f"CAST(floor(CAST(sum({alias}m{m}) AS DOUBLE) / count(*) + 0.5::DOUBLE) AS BIGINT) AS m{m}"
                     for m in MONTHS)


def lloyd(source: str, centres: str, name: str) -> str:
    """One assign-and-update round: ``{name}_a`` labels, ``{name}`` centres."""
    return f"""{name}_a AS MATERIALIZED (SELECT parcel_id, px, py, known, {_M}, zone_id FROM (
    SELECT p.*, c.zone_id, row_number() OVER (PARTITION BY p.parcel_id, p.px, p.py
      ORDER BY {_dist('p', 'c')}, c.zone_id) AS rn
    FROM {source} p JOIN {centres} c USING (parcel_id)) WHERE rn = 1),
{name} AS MATERIALIZED (SELECT c.parcel_id, c.zone_id, {", ".join(f"coalesce(n.m{m}, c.m{m}) AS m{m}" for m in MONTHS)}
  FROM {centres} c LEFT JOIN (SELECT parcel_id, zone_id, {_means()} FROM {name}_a GROUP BY 1, 2) n
  USING (parcel_id, zone_id))"""


def kmeans(k: int, rounds: int) -> str:
    """Farthest-first start and ``rounds`` rounds, as one chain of steps."""
    steps = ["pix AS MATERIALIZED (SELECT * FROM imputed)",
             f"mid AS (SELECT parcel_id, {_means()} FROM pix GROUP BY 1)"]
    for j in range(k):
        if j == 0:
            near = f"SELECT p.*, {_dist('p', 'c')} AS d FROM pix p JOIN mid c USING (parcel_id)"
        else:
            near = (f"SELECT p.parcel_id, p.px, p.py, {', '.join(f'any_value(p.m{m}) AS m{m}' for m in MONTHS)}, "
                    f"min({_dist('p', 'c')}) AS d FROM pix p JOIN start{j - 1} c USING (parcel_id) GROUP BY 1, 2, 3")
        pick = (f"SELECT parcel_id, {j} AS zone_id, {_M} FROM (SELECT *, row_number() OVER (PARTITION BY parcel_id "
                f"ORDER BY d DESC, py, px) AS rn FROM ({near})) WHERE rn = 1")
        before = f"SELECT * FROM start{j - 1} UNION ALL " if j else ""
        steps.append(f"start{j} AS MATERIALIZED ({before}{pick})")
    last = f"start{k - 1}"
    for r in range(rounds):
        steps.append(lloyd("pix", last, f"round{r}"))
        last = f"round{r}"
    steps.append(lloyd("pix", last, "final"))
    steps.append(f"zoned AS (SELECT parcel_id, px, py, zone_id, known, {_M} FROM final_a)")
    return ",\n".join(steps)


ZONE_K, ZONE_ROUNDS = 5, 25
ZONED = IMPUTED + ",\n" + kmeans(ZONE_K, ZONE_ROUNDS)

_ZONE_MEANS = ", ".join(
    f"floor(CAST(sum(m{m}) FILTER (known & {1 << (m - 1)} > 0) AS DOUBLE) / count(*) FILTER (known & {1 << (m - 1)} > 0) "
    f"/ 1e7::DOUBLE * 1e4::DOUBLE + 0.5::DOUBLE) AS e{m}" for m in MONTHS)
ZONE_PROFILES = ZONED + f""",
zone_e AS (SELECT parcel_id, zone_id, count(*) AS n_px, {_ZONE_MEANS} FROM zoned GROUP BY 1, 2),
zone_profiles AS (SELECT parcel_id, zone_id, n_px, {", ".join(f"e{m} / 10000.0::DOUBLE AS m{m}" for m in MONTHS)},
  {" + ".join(f"(e{m} IS NOT NULL)::INT" for m in MONTHS)} AS n_obs,
  ({" + ".join(f"coalesce(e{m}, 0)" for m in MONTHS)}) / (10000 * ({" + ".join(f"(e{m} IS NOT NULL)::INT" for m in MONTHS)}))
    AS zone_mean, DATE '2001-12-31' AS last_date FROM zone_e)"""


def components(nodes: str, pairs: str, name: str) -> str:
    """Smallest reachable cell per cell, by plain reachability."""
    return f"""{name}_reach AS (SELECT parcel_id, class, cell, cell AS other FROM {nodes}
  UNION SELECT r.parcel_id, r.class, r.cell, p.b FROM {name}_reach r
  JOIN {pairs} p ON p.parcel_id = r.parcel_id AND p.class = r.class AND p.a = r.other),
{name} AS (SELECT parcel_id, class, cell, min(other) AS region_id FROM {name}_reach GROUP BY 1, 2, 3)"""


# masks for the region operators: pixels bright in April, darker ones, and those not seen then
MASKS = COMPOSITE + """,
masks AS (SELECT parcel_id, CASE WHEN m4 >= 6500000 THEN 'bright' WHEN m4 IS NOT NULL THEN 'dark'
  ELSE 'unseen' END AS class, px, py, py * 1048576 + px AS cell FROM composite)"""
GRID_W, GRID_H = 25, 20
FULL = MASKS + f""",
cells AS (SELECT c.parcel_id, c.class, x.px, y.py, y.py * 1048576 + x.px AS cell,
    CASE WHEN m.cell IS NULL THEN 0 ELSE 1 END AS value
  FROM (SELECT DISTINCT parcel_id, class FROM masks) c
  CROSS JOIN (SELECT unnest(range({GRID_W})) AS px) x CROSS JOIN (SELECT unnest(range({GRID_H})) AS py) y
  LEFT JOIN masks m ON m.parcel_id = c.parcel_id AND m.class = c.class AND m.px = x.px AND m.py = y.py)"""


def neighbours(source: str, name: str, diagonal: bool, same: bool = True) -> str:
    reach = ("abs(a.px - b.px) <= 1 AND abs(a.py - b.py) <= 1" if diagonal
             else "abs(a.px - b.px) + abs(a.py - b.py) = 1")
    value = ""
    if source == "cells":
        value = f" AND a.value {'=' if same else '<>'} b.value"
    return f"""{name} AS MATERIALIZED (SELECT a.parcel_id, a.class, a.cell AS a, b.cell AS b FROM {source} a JOIN {source} b
  ON a.parcel_id = b.parcel_id AND a.class = b.class AND {reach} AND a.cell <> b.cell{value})"""


REGIONS = "RECURSIVE " + MASKS + ",\n" + neighbours("masks", "pairs", False) + ",\n" + components("masks", "pairs", "regions")

SIEVE_MIN = 6
SIEVED = ("RECURSIVE " + FULL + ",\n" + neighbours("cells", "pairs", True) + ",\n" + components("cells", "pairs", "lab")
          + ",\n" + neighbours("cells", "apart", True, same=False) + f""",
sized AS MATERIALIZED (SELECT parcel_id, class, region_id, count(*) AS n_px, any_value(value) AS value
  FROM lab JOIN cells USING (parcel_id, class, cell) GROUP BY 1, 2, 3),
choice AS MATERIALIZED (SELECT parcel_id, class, region_id, other FROM (
  SELECT s.parcel_id, s.class, s.region_id, o.region_id AS other, row_number() OVER (
      PARTITION BY s.parcel_id, s.class, s.region_id ORDER BY o.n_px DESC, o.region_id) AS rn
  FROM (SELECT DISTINCT p.parcel_id, p.class, x.region_id AS ra, y.region_id AS rb FROM apart p
        JOIN lab x ON x.parcel_id = p.parcel_id AND x.class = p.class AND x.cell = p.a
        JOIN lab y ON y.parcel_id = p.parcel_id AND y.class = p.class AND y.cell = p.b) n
  JOIN sized s ON s.parcel_id = n.parcel_id AND s.class = n.class AND s.region_id = n.ra
  JOIN sized o ON o.parcel_id = n.parcel_id AND o.class = n.class AND o.region_id = n.rb
  WHERE s.n_px < {SIEVE_MIN}) WHERE rn = 1),
walk AS (SELECT parcel_id, class, region_id, region_id AS at, 0 AS hops FROM choice
  UNION ALL SELECT w.parcel_id, w.class, w.region_id, c.other, hops + 1 FROM walk w
  JOIN choice c ON c.parcel_id = w.parcel_id AND c.class = w.class AND c.region_id = w.at WHERE hops < 40),
ends AS (SELECT w.parcel_id, w.class, w.region_id, any_value(s.value) AS new_value FROM walk w
  JOIN sized s ON s.parcel_id = w.parcel_id AND s.class = w.class AND s.region_id = w.at
  WHERE s.n_px >= {SIEVE_MIN} GROUP BY 1, 2, 3),
sieved AS (SELECT l.parcel_id, l.class, c.px, c.py FROM lab l JOIN cells c USING (parcel_id, class, cell)
  LEFT JOIN ends e USING (parcel_id, class, region_id) WHERE coalesce(e.new_value, c.value) = 1)""")

__all__ = ["VALID", "COMPOSITE", "IMPUTED", "ZONED", "ZONE_PROFILES", "MASKS", "REGIONS", "SIEVED", "half_up", "lloyd"]
