"""Images: decoding, shape filter, crop windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.draws import integer


def read_images(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """``(path, height, width, channels, data)`` of the images below the paths; files that are none are left out.

    ``data`` holds rows of pixels from the top, each in blue, green, red order.
    """
    images = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(paths)
    i = F.col("image")
    return images.select(i["origin"].alias("path"), i["height"].alias("height"), i["width"].alias("width"), i["nChannels"].alias("channels"), i["data"].alias("data"))


def filter_uniform_shape(df: DataFrame, expected: tuple[int, int] | None = None, path: str = "path") -> DataFrame:
    """Rows of the ``expected`` (height, width), by default that of the row of the smallest path."""
    if expected is not None:
        return df.where((F.col("height") == expected[0]) & (F.col("width") == expected[1]))
    first = df.agg(F.min(F.struct(path, "height", "width")).alias("_first")).select(F.col("_first.height").alias("_h"), F.col("_first.width").alias("_w"))
    # one row, whatever the number of images
    return df.crossJoin(F.broadcast(first)).where((F.col("height") == F.col("_h")) & (F.col("width") == F.col("_w"))).select(*df.columns)


def _axis(crop: int | float, size: Column, low: Column, high: Column, seed: str, key: Column) -> tuple[Column, Column]:
    length = F.lit(crop) if isinstance(crop, int) else F.floor(F.lit(crop) * size).cast("int")
    first = F.greatest(low - length, F.lit(0))
    choices = F.least(size - length + 1, high + length) - first
    start = F.when(choices > 0, first + integer(seed, key, choices)).cast("int")
    return start, start + length


def crop_windows(df: DataFrame, crop: tuple[int | float, int | float], seed=0, key: str = "id") -> DataFrame:
    """``df (height, width, ymin, ymax, xmin, xmax)`` with a window drawn about each box, and the share of the box in it.

    Sizes are pixels if whole numbers, else shares of the image. A window that fits nowhere is null.
    """
    y0, y1 = _axis(crop[0], F.col("height"), F.col("ymin"), F.col("ymax"), f"{seed}:y", F.col(key))
    x0, x1 = _axis(crop[1], F.col("width"), F.col("xmin"), F.col("xmax"), f"{seed}:x", F.col(key))
    out = df.withColumns({"crop_ymin": y0, "crop_ymax": y1, "crop_xmin": x0, "crop_xmax": x1})
    common = lambda a: F.greatest(F.least(f"{a}max", f"crop_{a}max") - F.greatest(f"{a}min", f"crop_{a}min"), F.lit(0))
    area = (F.col("ymax") - F.col("ymin")) * (F.col("xmax") - F.col("xmin"))
    whole = F.col("crop_ymin").isNotNull() & F.col("crop_xmin").isNotNull() & (area > 0)
    return out.withColumn("ratio", F.when(whole, common("y") * common("x") / area))
