"""Rasters as tables of pixels (doc, y, x, p): thresholds, masks, levels and colours by windows and sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def box_sums(pixels: DataFrame, radius: int, values: dict[str, Column], keys: tuple[str, ...] = ("doc",)) -> DataFrame:
    """pixels with the sums of values over the square around each, cut at the edges, and its size n."""
    down = Window.partitionBy(*keys, "x").orderBy("y").rowsBetween(-radius, radius)
    across = Window.partitionBy(*keys, "y").orderBy("x").rowsBetween(-radius, radius)
    values = values | {"n": F.lit(1)}
    columns = pixels.withColumns({f"_{k}": F.sum(v).over(down) for k, v in values.items()})
    return columns.withColumns({k: F.sum(f"_{k}").over(across).cast("long") for k in values}).drop(*(f"_{k}" for k in values))


def sauvola(pixels: DataFrame, radius: int, k: float = 0.34, r: float = 128.0) -> DataFrame:
    """pixels with mean, var (whole numbers) and dark."""
    p = F.col("p").cast("long")
    s = box_sums(pixels, radius, {"s1": p, "s2": p * p})
    s = s.withColumn("mean", F.expr("s1 div n")).withColumn("var", F.expr("s2 div n") - F.col("mean") * F.col("mean"))
    t = F.col("p") + F.col("mean") * F.lit(k - 1)
    bound = F.col("mean").cast("double") * F.col("mean") * F.lit(k * k / (r * r)) * F.col("var")
    dark = ((t <= 0) | (t * t <= bound)) if k >= 0 else ((t <= 0) & (t * t >= bound))
    return s.withColumn("dark", dark).drop("s1", "s2")


def neighbours(mask: DataFrame, radius: int) -> DataFrame:
    """mask (doc, y, x, dark) with the number of other dark pixels around each."""
    one = F.col("dark").cast("int")
    return box_sums(mask, radius, {"c": one}).withColumn("others", F.col("c") - one).drop("c", "n")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pixels dark in either mask."""
    return a.join(b.select("doc", "y", "x", F.col("dark").alias("_dark")), ["doc", "y", "x"]).withColumn("dark", F.col("dark") | F.col("_dark")).drop("_dark")


def complement(mask: DataFrame) -> DataFrame:
    return mask.withColumn("dark", ~F.col("dark"))


def colour_mode(pixels: DataFrame, keys: tuple[str, ...] = ("doc",)) -> DataFrame:
    """RGB unless all pixels are grey; then Bitonal if none is between the least and the greatest, else Grayscale."""
    least, most = F.least("r", "g", "b"), F.greatest("r", "g", "b")
    ends = pixels.groupBy(*keys).agg(F.bool_and(least == most).alias("grey"), F.min(least).alias("lo"), F.max(most).alias("hi"), F.count_distinct(F.when(least == most, F.col("r"))).alias("kinds"))
    return ends.select(*keys, F.when(~F.col("grey"), "RGB").when(F.col("kinds") <= 2, "Bitonal").otherwise("Grayscale").alias("mode"))
