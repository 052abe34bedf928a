"""Photo features: colour statistics, texture, and summaries per class.

Two forms give the same table: one over a pixel table, all in Spark expressions,
and one over decoded image files, where a photo becomes one row inside its task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopyflow.functions import colour as C
from canopyflow.functions.numbers import E7, half_up, to_fixed

#: Pixels of a photo that are looked at together.
BLOCK_PIXELS = 1 << 18
FEATURES = ("r_mean", "g_mean", "b_mean", "r_std", "g_std", "b_std", "exg_mean", "vari_mean", "gli_mean",
            "px_green", "px_yellow", "glcm_contrast", "glcm_homogeneity")


def _std(total: Column, squares: Column, n: Column) -> Column:
    """Population deviation from exact integer sums, on the 0..1 scale."""
    return F.sqrt((n * squares - total * total).cast("double")) / n / F.lit(255.0)


def colour_statistics(pixels: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Means, deviations, index means and colour shares per image."""
    idx = C.indices()
    sums = []
    for c in "rgb":
        sums += [F.sum(F.col(c).cast("bigint")).alias(f"{c}1"), F.sum((F.col(c) * F.col(c)).cast("bigint")).alias(f"{c}2")]
    for name in ("exg", "vari", "gli"):
        sums.append(F.sum(to_fixed(idx[name], E7)).alias(name))
    totals = pixels.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums,
                                       F.count_if(idx["is_green"]).alias("green"),
                                       F.count_if(idx["is_yellow"]).alias("yellow"))
    n = F.col("n")
    means = [half_up(F.col(f"{c}1") / n / F.lit(255.0), 5).alias(f"{c}_mean") for c in "rgb"]
    stds = [half_up(_std(F.col(f"{c}1"), F.col(f"{c}2"), n), 5).alias(f"{c}_std") for c in "rgb"]
    index = [half_up(F.col(i) / n / F.lit(float(E7)), 5).alias(f"{i}_mean") for i in ("exg", "vari", "gli")]
    shares = [half_up(F.col(s) / n, 5).alias(f"px_{s}") for s in ("green", "yellow")]
    return totals.select(*keys, *means, *stds, *index, *shares)


def texture(pixels: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Contrast and homogeneity of the co-occurrence of horizontal neighbours.

    The window covers one pixel row of one image; equal level pairs are counted
    before anything else is computed, at most 64 x 64 per image.
    """
    row = Window.partitionBy(*keys, "y").orderBy("x")
    levels = pixels.select(*keys, "x", "y", C.gray_level().alias("a"))
    pairs = (levels.withColumn("b", F.when(F.lead("x").over(row) == F.col("x") + 1, F.lead("a").over(row)))
             .where(F.col("b").isNotNull()))
    counts = pairs.groupBy(*keys, "a", "b").agg(F.count(F.lit(1)).alias("n"))
    gap = (F.col("a") - F.col("b")) * (F.col("a") - F.col("b"))
    # homogeneity depends on the squared gap only, so it is summed per gap in a fixed order
    by_gap = counts.groupBy(*keys, gap.alias("gap")).agg(F.sum("n").alias("n"))
    listed = by_gap.groupBy(*keys).agg(F.sum("n").alias("pairs"), F.sum(F.col("n") * F.col("gap")).alias("spread"),
                                       F.sort_array(F.collect_list(F.struct("gap", "n"))).alias("gaps"))
    even = F.aggregate("gaps", F.lit(0.0), lambda acc, e: acc + e["n"] / (F.lit(1.0) + e["gap"]))
    return listed.select(*keys, half_up(F.col("spread") / F.col("pairs"), 5).alias("glcm_contrast"),
                         half_up(even / F.col("pairs"), 5).alias("glcm_homogeneity"))


def photo_features(pixels: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    return colour_statistics(pixels, keys).join(texture(pixels, keys), list(keys), "left")


def class_summary(features: DataFrame) -> DataFrame:
    """Images, mean green excess and mean yellow share per class, in exact units of 1e-5."""
    def mean5(name: str) -> Column:
        return half_up(F.sum(F.floor(F.col(name) * 1e5 + 0.5)) / F.count(F.lit(1)) / F.lit(1e5), 3)

    return features.groupBy("class").agg(F.count(F.lit(1)).alias("n"), mean5("exg_mean").alias("exg"),
                                         mean5("px_yellow").alias("yellow"))


def _reduced(rgb: np.ndarray, max_side: int) -> np.ndarray:
    """Block means such that no side is above ``max_side``; blocks at the right and
    lower edge are smaller, so every pixel counts."""
    step = max(1, -(-max(rgb.shape[:2]) // max_side))
    if step == 1:
        return rgb
    down, across = (np.arange(0, side, step) for side in rgb.shape[:2])
    total = np.add.reduceat(np.add.reduceat(rgb.astype(np.int64), down, axis=0), across, axis=1)
    cells = np.outer(np.diff(np.r_[down, rgb.shape[0]]), np.diff(np.r_[across, rgb.shape[1]]))
    return (2 * total + cells[..., None]) // (2 * cells[..., None])


def _half_up(value: float) -> float:
    return math.floor(value * 1e5 + 0.5) / 1e5


def image_row(rgb: np.ndarray, max_side: int | None = None) -> dict[str, float | None]:
    """The thirteen features of one decoded image of shape (height, width, 3).

    Sums are integers over all pixels, taken in blocks of rows, and equal those of
    ``photo_features``; an image one pixel wide has no texture, one without pixels
    no feature at all.
    """
    if max_side is not None:
        rgb = _reduced(rgb, max_side)
    n, pairs = rgb.shape[0] * rgb.shape[1], rgb.shape[0] * max(0, rgb.shape[1] - 1)
    if n == 0:
        return dict.fromkeys(FEATURES)
    first, second, fixed, shares = np.zeros(3, np.int64), np.zeros(3, np.int64), np.zeros(3, np.int64), np.zeros(2, np.int64)
    gaps = np.zeros(C.GRAY_LEVELS ** 2, np.int64)
    wr, wg, wb = C.GRAY_WEIGHTS
    rows = max(1, BLOCK_PIXELS // rgb.shape[1])
    for top in range(0, rgb.shape[0], rows):
        block = rgb[top:top + rows].astype(np.int64)
        first += block.sum(axis=(0, 1))
        second += (block * block).sum(axis=(0, 1))
        r, g, b = (block[..., c] / 255.0 for c in range(3))
        index = (2.0 * g - r - b, (g - r) / (g + r - b + C.EPSILON), (2.0 * g - r - b) / (2.0 * g + r + b + C.EPSILON))
        fixed += [np.floor(i * float(E7) + 0.5).astype(np.int64).sum() for i in index]
        shares += [((g > r) & (g > b)).sum(), ((np.abs(r - g) < C.YELLOW_GAP) & (r > b + C.YELLOW_LEAD)).sum()]
        level = np.floor((wr * r + wg * g + wb * b) * float(C.GRAY_LEVELS - 1)).astype(np.int64)
        gaps += np.bincount(((level[:, :-1] - level[:, 1:]) ** 2).ravel(), minlength=len(gaps))
    values = [int(s) / n / 255.0 for s in first]
    values += [math.sqrt(float(n * int(q) - int(s) ** 2)) / n / 255.0 for s, q in zip(first, second)]
    values += [int(s) / n / float(E7) for s in fixed] + [int(s) / n for s in shares]
    if pairs:
        seen = np.flatnonzero(gaps).tolist()
        values += [sum(int(gaps[d]) * d for d in seen) / pairs, sum(int(gaps[d]) / (1.0 + d) for d in seen) / pairs]
    return dict.fromkeys(FEATURES) | {name: _half_up(v) for name, v in zip(FEATURES, values)}


def file_features(images: DataFrame, max_side: int | None = None) -> DataFrame:
    """Features of ``images(class, file, height, width, n_channels, data)``, over all
    pixels or, with ``max_side``, over block means of larger photos."""
    schema = "class string, file string, " + ", ".join(f"{f} double" for f in FEATURES)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                grid = np.frombuffer(row.data, dtype=np.uint8).reshape(row.height, row.width, row.n_channels)
                # stored blue first; a single channel is gray
                rgb = grid[..., [2, 1, 0]] if row.n_channels >= 3 else np.repeat(grid[..., :1], 3, axis=2)
                rows.append({"class": row[0], "file": row.file, **image_row(rgb, max_side)})
            yield pd.DataFrame(rows, columns=["class", "file", *FEATURES]).astype(dict.fromkeys(FEATURES, float))

    return images.select("class", "file", "height", "width", "n_channels", "data").mapInPandas(run, schema)
