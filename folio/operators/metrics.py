"""Figures on runs: timings, sizes, reports, warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.operators.sequence import with_context

LOADED = "image_load"


def millis(seconds: Column, count: Column) -> Column:
    """Whole milliseconds of each of count, cut off; NULL where there is none."""
    return F.floor(seconds / F.nullif(count, F.lit(0)) * 1000).cast("long")


def timing_summary(timings: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, step_key, ms): each step's seconds over the number of images loaded, not over its own count."""
    keys = keys or []
    steps = timings.groupBy(*keys, "step_key").agg(F.sum("seconds").alias("seconds"), F.sum(F.when(F.col("step_key") == LOADED, 1).otherwise(0)).alias("own"))
    loaded = F.sum("own").over(Window.partitionBy(*(keys or [F.lit(0)])))  # one row a step by now
    return steps.withColumn("ms", millis(F.col("seconds"), loaded)).drop("seconds", "own")


def report_windows(pages: DataFrame, every: int, order: str) -> DataFrame:
    """pages with ``report``, the number of the block of ``every`` rows within the item; the last may be short."""
    counted = with_context(pages, ["doc"], order, before={"_rows": F.lit(1)})
    return counted.withColumn("report", F.floor(F.col("_rows") / every).cast("int")).drop("_rows")


def compression_ratio(source_bytes: DataFrame, output_bytes: DataFrame) -> DataFrame:
    """(doc, ratio) of source over output, both (doc, bytes) with any number of rows an item."""
    a = source_bytes.groupBy("doc").agg(F.sum("bytes").alias("source"))
    b = output_bytes.groupBy("doc").agg(F.sum("bytes").alias("output"))
    return a.join(b, "doc").withColumn("ratio", F.col("source") / F.nullif(F.col("output"), F.lit(0)))


def layer_breakdown(images: DataFrame, totals: DataFrame) -> DataFrame:
    """Bytes of the first image of each page (background), the second and its mask, and the rest of each item.

    images: (doc, page, ord, bytes, mask_bytes); totals: (doc, total).
    """
    part = lambda cond, c: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0)).cast("long")
    sums = images.groupBy("doc").agg(part(F.col("ord") == 0, "bytes").alias("background"), part(F.col("ord") == 1, "bytes").alias("foreground"), part(F.col("ord") == 1, "mask_bytes").alias("mask"))
    joined = sums.join(totals, "doc")
    joined = joined.withColumn("rest", F.col("total") - F.col("background") - F.col("foreground") - F.col("mask"))
    for c in ("background", "foreground", "mask", "rest"):
        joined = joined.withColumn(f"{c}_share", F.format_string("%.2f%%", F.col(c) * 100.0 / F.col("total")))
    return joined


def warning_union(warnings: DataFrame) -> DataFrame:
    """(doc, warnings): the sorted set of all warnings of an item's rows, from an array column."""
    return warnings.select("doc", F.explode_outer("warnings").alias("w")).groupBy("doc").agg(F.array_sort(F.collect_set("w")).alias("warnings"))


def offsets(objects: DataFrame, keys: list[str], order: str, size: str) -> DataFrame:
    """objects with ``offset``, the bytes of those before them."""
    return with_context(objects, keys, order, before={"offset": F.col(size).cast("long")})
