"""Page sizes and resolutions of whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.geometry import LEAST_UNITS, guess_dpi, valid_width, whole_number
from folio.operators.scandata import is_skipped, output_index

INVALID_SIZE = "invalid-page-size"


def with_document(geometry: DataFrame, items: DataFrame) -> DataFrame:
    """geometry with its page's and its item's resolution as numbers."""
    own = items.select("doc", whole_number(F.col("dpi")).alias("doc_dpi"))
    return geometry.join(own, "doc", "left").withColumn("page_dpi_int", whole_number(F.col("page_dpi")))


def _some(dpi: Column) -> Column:
    return F.nullif(dpi, F.lit(0))


def resolution() -> Column:
    """The page's own resolution, else the item's, else the given one, else the guess; 0 is none."""
    return F.coalesce(_some(F.col("page_dpi_int")), _some(F.col("doc_dpi")), _some(F.col("dpi")), guess_dpi(F.col("imwidth"), F.col("imheight")))


def page_sizes(pages: DataFrame) -> DataFrame:
    """width, height in points, ppi, font_scale and warnings of pages from with_document.

    A width out of range is tried with the item's resolution if the page's own was used, then with the guess; then it
    is the least that is allowed.  An image without width has no height.
    """
    imwidth, imheight = F.col("imwidth"), F.col("imheight")
    item = F.coalesce(_some(F.col("doc_dpi")), _some(F.col("dpi")))
    first = imwidth / (resolution() / 72)
    second = F.when(~valid_width(first) & _some(F.col("page_dpi_int")).isNotNull() & item.isNotNull(), imwidth / (item / 72)).otherwise(first)
    third = F.when(valid_width(second), second).otherwise(imwidth / (guess_dpi(imwidth, imheight) / 72))
    width = F.when(valid_width(third), third).otherwise(F.lit(LEAST_UNITS + 1))
    out = pages.withColumn("width", width).withColumn("height", imheight * F.col("width") / F.nullif(imwidth, F.lit(0))).withColumn("ppi", 72 * imwidth / F.col("width"))
    scale = F.coalesce(F.col("hocr_dpi"), F.lit(72)) / F.nullif(F.col("ppi"), F.lit(0.0))
    return out.withColumn("font_scale", scale).withColumn("warnings", F.when(valid_width(first), F.array().cast("array<string>")).otherwise(F.array(F.lit(INVALID_SIZE))))


def image_pass_resolution(geometry: DataFrame, scandata: DataFrame) -> DataFrame:
    """use_dpi of the kept pages: the list's, else the OCR's if there is a list, else the given one."""
    listed = output_index(scandata)
    dpi = listed.where(~F.col("skipped")).select("doc", "out_idx", whole_number(F.col("ppi")).alias("list_dpi"))
    joined = geometry.join(listed.select("doc", F.col("idx").alias("page_idx"), "skipped", "out_idx"), ["doc", "page_idx"], "left").where(~F.coalesce("skipped", F.lit(False))).join(dpi, ["doc", "out_idx"], "left")
    return joined.withColumn("use_dpi", F.coalesce("list_dpi", F.when(F.col("skipped").isNotNull(), F.col("hocr_dpi")), F.col("dpi")))


def without_skipped(pages: DataFrame, scandata: DataFrame) -> DataFrame:
    """pages (doc, page_idx, ...) without those that the list takes out; joined before any image is read."""
    skipped = scandata.where(is_skipped(F.col("add_to_access"))).select("doc", F.col("idx").alias("page_idx"))
    return pages.join(skipped, ["doc", "page_idx"], "left_anti")
