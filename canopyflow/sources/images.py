"""Folder of labelled photos: the sub-directory is the class."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyflow import constants as K


def read_photos(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """``(images, rejects)`` of all photos below ``root``.

    A file that cannot be decoded is listed in ``rejects`` and the others go on.
    """
    wanted = F.lower(F.regexp_extract("origin", r"\.([A-Za-z]+)$", 1)).isin(*K.IMAGE_EXTENSIONS)
    raw = (spark.read.format("image").option("recursiveFileLookup", True).load(root)
           .select("image.*").where(wanted)
           .withColumns({"class": F.regexp_extract("origin", r"([^/]+)/[^/]+$", 1),
                         "file": F.regexp_extract("origin", r"([^/]+)$", 1)}))
    images = raw.where(F.col("width") > 0).select(
        "class", "file", "height", "width", F.col("nChannels").alias("n_channels"), "data")
    return images, raw.where(F.col("width") <= 0).select("class", "file", F.lit("unreadable").alias("reason"))
