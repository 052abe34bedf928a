"""Queries over photo pixels, superpixels and band stretching."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopyflow.operators import fragments, images, superpixels
from canopyflow.workload import pixel_sql as PS
from canopyflow.workload import views as V
from canopyflow.workload.pixel_queries import composite, masks, valid
from canopyflow.workload.registry import query
from canopyflow.workload.series_sql import half_up

_R, _G, _B = "(r / 255.0::DOUBLE)", "(g / 255.0::DOUBLE)", "(b / 255.0::DOUBLE)"
_INDEX = f"""indexed AS (SELECT *, 2.0::DOUBLE * {_G} - {_R} - {_B} AS exg,
  ({_G} - {_R}) / ({_G} + {_R} - {_B} + 1e-6::DOUBLE) AS vari,
  (2.0::DOUBLE * {_G} - {_R} - {_B}) / (2.0::DOUBLE * {_G} + {_R} + {_B} + 1e-6::DOUBLE) AS gli,
  {_G} > {_R} AND {_G} > {_B} AS is_green,
  abs({_R} - {_G}) < 0.08::DOUBLE AND {_R} > {_B} + 0.05::DOUBLE AS is_yellow,
  CAST(floor((0.2125::DOUBLE * {_R} + 0.7154::DOUBLE * {_G} + 0.0721::DOUBLE * {_B}) * 63.0::DOUBLE) AS INT) AS level FROM photo)"""


def _std(c: str) -> str:
    return half_up(f"sqrt(CAST(count(*) * sum({c} * {c}) - sum({c}) * sum({c}) AS DOUBLE)) / count(*) / 255.0::DOUBLE", 5)


def _fixed_mean(c: str) -> str:
    return half_up(f"CAST(sum(floor({c} * 1e7::DOUBLE + 0.5::DOUBLE)) AS DOUBLE) / count(*) / 1e7::DOUBLE", 5)


_STATS = f"""{V.PHOTO_PIXELS}, {_INDEX}, stats AS (SELECT image_id, class,
  {", ".join(f"{half_up(f'CAST(sum({c}) AS DOUBLE) / count(*) / 255.0::DOUBLE', 5)} AS {c}_mean" for c in "rgb")},
  {", ".join(f"{_std(c)} AS {c}_std" for c in "rgb")}, {", ".join(f"{_fixed_mean(c)} AS {c}_mean" for c in ("exg", "vari", "gli"))},
  {half_up("CAST(count(*) FILTER (is_green) AS DOUBLE) / count(*)", 5)} AS px_green,
  {half_up("CAST(count(*) FILTER (is_yellow) AS DOUBLE) / count(*)", 5)} AS px_yellow FROM indexed GROUP BY 1, 2)"""
KEYS = ("image_id", "class")


@query("f18_colour_indices", f"""WITH {V.PHOTO_PIXELS}, {_INDEX} SELECT image_id, x, y, exg, vari, gli, is_green, is_yellow
FROM indexed""")
def f18(spark, sf):
    from canopyflow.functions.colour import indices
    return V.photo_pixels(spark, sf).select("image_id", "x", "y", *[c.alias(n) for n, c in indices().items()])


@query("a18_photo_statistics", f"WITH {_STATS} SELECT * FROM stats")
def a18(spark, sf):
    return images.colour_statistics(V.photo_pixels(spark, sf), KEYS)


@query("a19_photo_texture", f"""WITH {V.PHOTO_PIXELS}, {_INDEX}, pairs AS (SELECT p.image_id, p.class, (p.level - q.level) * (p.level - q.level) AS gap
  FROM indexed p JOIN indexed q ON q.image_id = p.image_id AND q.y = p.y AND q.x = p.x + 1),
  gaps AS (SELECT image_id, class, gap, count(*) AS n FROM pairs GROUP BY 1, 2, 3)
SELECT image_id, class, {half_up("CAST(sum(n * gap) AS DOUBLE) / sum(n)", 5)} AS glcm_contrast,
  {half_up("list_reduce(list_prepend(0.0::DOUBLE, list(n / (1.0::DOUBLE + gap) ORDER BY gap)), lambda a, v: a + v) / sum(n)", 5)} AS glcm_homogeneity
FROM gaps GROUP BY 1, 2""")
def a19(spark, sf):
    return images.texture(V.photo_pixels(spark, sf), KEYS)


# photos as files hold them: 64 rows of 7 pixels, black where the table has none
_FILES = V.PHOTO_PIXELS.replace("photo AS", "seen AS", 1) + """, photo AS (SELECT image_id, class, y, x, coalesce(r, 0) AS r,
  coalesce(g, 0) AS g, coalesce(b, 0) AS b FROM (SELECT DISTINCT image_id, class FROM seen) CROSS JOIN range(64) AS rows(y)
  CROSS JOIN range(1, 8) AS columns_(x) LEFT JOIN seen USING (image_id, class, y, x))"""


@query("a18_photo_files", f"""WITH {_STATS.replace(V.PHOTO_PIXELS, _FILES)}, pairs AS (SELECT p.image_id, (p.level - q.level) * (p.level - q.level) AS gap
  FROM indexed p JOIN indexed q ON q.image_id = p.image_id AND q.y = p.y AND q.x = p.x + 1),
  gaps AS (SELECT image_id, gap, count(*) AS n FROM pairs GROUP BY 1, 2),
  textures AS (SELECT image_id, {half_up("CAST(sum(n * gap) AS DOUBLE) / sum(n)", 5)} AS glcm_contrast,
  {half_up("list_reduce(list_prepend(0.0::DOUBLE, list(n / (1.0::DOUBLE + gap) ORDER BY gap)), lambda a, v: a + v) / sum(n)", 5)} AS glcm_homogeneity
  FROM gaps GROUP BY 1)
SELECT stats.* EXCLUDE (image_id), image_id || '.png' AS file, glcm_contrast, glcm_homogeneity FROM stats JOIN textures USING (image_id)""")
def a18_files(spark, sf):
    """The file form of the features, over photos put together from the pixel table."""
    colour = F.concat(*[F.lpad(F.hex(c), 2, "0") for c in ("b", "g", "r")])
    # cells in their order, each with the black ones before it
    black, size = "000000", 64 * 7
    cell = F.when(F.col("x").between(1, 7) & F.col("y").between(0, 63), F.struct(
        (F.col("y") * 7 + F.col("x") - 1).cast("int").alias("at"), F.coalesce(colour, F.lit(black)).alias("colour")))
    photos = (V.photo_pixels(spark, sf).where("image_id IS NOT NULL").groupBy(*KEYS)
              .agg(F.sort_array(F.collect_list(cell)).alias("cells")))
    data = F.expr(f"""concat(array_join(transform(cells, (c, i) -> concat(repeat('{black}', c.at - 1 -
        CASE WHEN i = 0 THEN -1 ELSE cells[i - 1].at END), c.colour)), ''), repeat('{black}', {size - 1} - coalesce(try_element_at(cells, -1).at, -1)))""")
    files = photos.select("class", F.concat(F.col("image_id").cast("string"), F.lit(".png")).alias("file"), F.lit(64).alias("height"),
                          F.lit(7).alias("width"), F.lit(3).alias("n_channels"), F.unhex(data).alias("data"))
    return images.file_features(files)


@query("a20_photo_class_summary", f"""WITH {_STATS} SELECT class, count(*) AS n,
  {half_up("sum(floor(exg_mean * 1e5::DOUBLE + 0.5::DOUBLE)) / count(*) / 1e5::DOUBLE", 3)} AS exg,
  {half_up("sum(floor(px_yellow * 1e5::DOUBLE + 0.5::DOUBLE)) / count(*) / 1e5::DOUBLE", 3)} AS yellow FROM stats GROUP BY 1""")
def a20(spark, sf):
    return images.class_summary(images.colour_statistics(V.photo_pixels(spark, sf), KEYS))


def bands(spark, sf):
    v = valid(spark, sf)
    both = F.array(F.struct(F.lit("b04").alias("band"), F.col("b04").alias("value")),
                   F.struct(F.lit("b08").alias("band"), F.when(F.col("parcel_id") != 1, F.col("b08")).otherwise(0).alias("value")))
    return v.select("parcel_id", "px", "py", "scene_id", F.inline(both))


def _quantile(p: float) -> str:
    pos = f"((len(vs) - 1) * {p}::DOUBLE)"
    lo, hi = f"vs[CAST(floor({pos}) AS INT) + 1]", f"vs[CAST(ceil({pos}) AS INT) + 1]"
    return f"CASE WHEN floor({pos}) = ceil({pos}) THEN {lo}::DOUBLE ELSE {lo} * (ceil({pos}) - {pos}) + {hi} * ({pos} - floor({pos})) END"


@query("a16_percentile_stretch", f"""WITH {PS.VALID}, bands AS (SELECT parcel_id, px, py, scene_id, 'b04' AS band, b04 AS value FROM valid
  UNION ALL SELECT parcel_id, px, py, scene_id, 'b08', CASE WHEN parcel_id <> 1 THEN b08 ELSE 0 END FROM valid),
  lists AS (SELECT parcel_id, band, list(value ORDER BY value) AS vs FROM bands WHERE value > 0 GROUP BY 1, 2),
  limits AS (SELECT parcel_id, band, len(vs) AS cells, {_quantile(0.02)} AS lo, {_quantile(0.98)} AS hi FROM lists)
SELECT parcel_id, band, px, py, scene_id, CASE WHEN cells >= 100 THEN CAST(floor(greatest(0.0::DOUBLE, least(1.0::DOUBLE,
  (value - lo) / greatest(hi - lo, 1e-6::DOUBLE))) * 255) AS INT) ELSE 0 END AS stretched
FROM bands LEFT JOIN limits USING (parcel_id, band)""")
def a16(spark, sf):
    return superpixels.stretch_bands(bands(spark, sf)).select("parcel_id", "band", "px", "py", "scene_id", "stretched")


@query("a15_j15_segment_vote", f"""WITH {PS.MASKS}, seg AS (SELECT parcel_id, px, py, (py // 4) * 100 + px // 4 AS segment_id,
  class = 'bright' AS hit FROM masks WHERE py > 1)
SELECT parcel_id, px, py FROM seg JOIN (SELECT parcel_id, segment_id FROM seg GROUP BY 1, 2
  HAVING count(*) FILTER (hit) * 2 >= count(*)) w USING (parcel_id, segment_id)""")
def a15(spark, sf):
    cells = masks(spark, sf)
    segments = cells.select("parcel_id", "px", "py", F.expr("(py div 4) * 100 + px div 4").alias("segment_id"))
    return superpixels.vote(segments, cells.where(F.col("class") == "bright"), cells.where(F.col("py") > 1))


def rgb(spark, sf):
    def byte(c):
        return F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.coalesce(F.col(c), F.lit(0)) * 255 / 10_000_000))).cast("bigint")
    return composite(spark, sf).select("parcel_id", "px", "py", byte("m4").alias("r"), byte("m1").alias("g"), byte("m7").alias("b"))


def _byte(c: str) -> str:
    return f"CAST(greatest(0, least(255, floor(coalesce({c}, 0) * 255 / 1e7::DOUBLE))) AS BIGINT)"


def _centres(source: str, hx: str, hy: str) -> str:
    means = ", ".join(f"CAST(floor(sum({v}) * 64 / count(*)::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS c_{v}" for v in ("px", "py", "r", "g", "b"))
    return f"SELECT parcel_id, {hx} AS hx, {hy} AS hy, {means} FROM {source} GROUP BY 1, 2, 3"


def _segments(rounds: int) -> str:
    """Assignment rounds as a chain of steps; ``step{rounds}`` has the last one."""
    square = lambda v: f"(c_{v} - 64 * {v}) * (c_{v} - 64 * {v})"
    colour, place = " + ".join(map(square, "rgb")), " + ".join(map(square, ("px", "py")))
    parts = [PS.MASKS, f"""colours AS (SELECT parcel_id, px, py, {_byte('m4')} AS r, {_byte('m1')} AS g, {_byte('m7')} AS b FROM composite),
  usable AS (SELECT * FROM colours WHERE r + g + b > 0),
  sizes AS (SELECT parcel_id, count(*) AS n_valid FROM usable GROUP BY 1),
  bright AS (SELECT parcel_id, count(*) AS n_mask FROM masks WHERE class = 'bright' GROUP BY 1),
  spaced AS (SELECT parcel_id, CAST(greatest(1, ceil(sqrt(n_valid / greatest(60, floor(coalesce(n_mask, 0) / 40))))) AS BIGINT) AS step
    FROM sizes LEFT JOIN bright USING (parcel_id)),
  placed AS MATERIALIZED (SELECT *, px // step AS cx, py // step AS cy FROM usable JOIN spaced USING (parcel_id))""",
             f"centres0 AS MATERIALIZED ({_centres('placed', 'cx', 'cy')})"]
    for k in range(rounds + 1):
        parts.append(f"""step{k} AS MATERIALIZED (SELECT p.*, hx, hy FROM placed p JOIN centres{k} c ON c.parcel_id = p.parcel_id
    AND abs(hx - cx) <= 1 AND abs(hy - cy) <= 1 QUALIFY row_number() OVER (PARTITION BY p.parcel_id, px, py
    ORDER BY step * step * ({colour}) + 100 * ({place}), hy, hx) = 1)""")
        if k < rounds:
            parts.append(f"centres{k + 1} AS MATERIALIZED ({_centres(f'step{k}', 'hx', 'hy')})")
    return ",\n".join(parts)


def bright(spark, sf):
    return masks(spark, sf).where(F.col("class") == "bright")


@query("r6_assignment_step", f"WITH {_segments(0)} SELECT parcel_id, px, py, hy * 1048576 + hx AS segment_id FROM step0")
def r6_step(spark, sf):
    return superpixels.superpixels(rgb(spark, sf), bright(spark, sf), rounds=0)


@query("r6_superpixels", f"WITH {_segments(3)} SELECT parcel_id, px, py, hy * 1048576 + hx AS segment_id FROM step3")
def r6(spark, sf):
    return superpixels.superpixels(rgb(spark, sf), bright(spark, sf), rounds=3)


@query("r6_connected_segments", f"WITH {_segments(0)} SELECT parcel_id, count(*) AS n_px, 1::BIGINT AS most_components FROM usable GROUP BY 1")
def r6_connected(spark, sf):
    """Every coloured pixel is in one segment, and no segment has more than one component."""
    segments = fragments.connected_segments(superpixels.superpixels(rgb(spark, sf), bright(spark, sf), rounds=3))
    return fragments.components_per_segment(segments).groupBy("parcel_id").agg(
        F.sum("n_px").alias("n_px"), F.max("components").alias("most_components"))
