"""Colour indices of 8-bit RGB pixels, scaled to 0..1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values of the photo model
EPSILON = 1e-6
YELLOW_GAP, YELLOW_LEAD = 0.08, 0.05
GRAY_WEIGHTS = (0.2125, 0.7154, 0.0721)
GRAY_LEVELS = 64


def indices(r: str = "r", g: str = "g", b: str = "b") -> dict[str, Column]:
    red, green, blue = (F.col(c) / F.lit(255.0) for c in (r, g, b))
    return {
        "exg": F.lit(2.0) * green - red - blue,
        "vari": (green - red) / (green + red - blue + F.lit(EPSILON)),
        "gli": (F.lit(2.0) * green - red - blue) / (F.lit(2.0) * green + red + blue + F.lit(EPSILON)),
        "is_green": (green > red) & (green > blue),
        "is_yellow": (F.abs(red - green) < F.lit(YELLOW_GAP)) & (red > blue + F.lit(YELLOW_LEAD)),
    }


def gray_level(r: str = "r", g: str = "g", b: str = "b") -> Column:
    wr, wg, wb = GRAY_WEIGHTS
    gray = (F.lit(wr) * (F.col(r) / F.lit(255.0)) + F.lit(wg) * (F.col(g) / F.lit(255.0))
            + F.lit(wb) * (F.col(b) / F.lit(255.0)))
    return F.floor(gray * F.lit(float(GRAY_LEVELS - 1))).cast("int")
