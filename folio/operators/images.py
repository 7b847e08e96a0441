"""Images on pages: placement, masks, scale, colour verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_PIXELS = 10000
DEFAULT_SCALE = 300 / 72


def first_placements(placements: DataFrame) -> DataFrame:
    """The first placement of each image on a page; placements: (doc, page, xref, ord, bbox_w, bbox_h)."""
    order = Window.partitionBy("doc", "page", "xref").orderBy("ord")
    return placements.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def with_placement(images: DataFrame, placements: DataFrame) -> DataFrame:
    return images.join(first_placements(placements).drop("ord"), ["doc", "page", "xref"])


def with_mask(images: DataFrame, masks: DataFrame) -> DataFrame:
    """images with the size of their mask; a mask number of 0 or NULL is none."""
    m = masks.select("doc", F.col("xref").alias("mask_xref"), F.col("width").alias("mask_width"), F.col("height").alias("mask_height"), F.col("depth").alias("mask_depth"))
    has = images.withColumn("mask_xref", F.when(F.col("mask_xref") > 0, F.col("mask_xref")))
    return has.join(m, ["doc", "mask_xref"], "left")


def page_scale(placed: DataFrame) -> DataFrame:
    """(doc, page, scale): for width and height the ratio of the last image that is finer than its place, the larger of both."""
    last = lambda ratio, ok: F.max_by(F.when(ok, ratio), F.when(ok, F.col("ord")))
    w, h = F.col("width") / F.nullif(F.col("bbox_w"), F.lit(0)), F.col("height") / F.nullif(F.col("bbox_h"), F.lit(0))
    own = placed.groupBy("doc", "page").agg(last(w, F.col("bbox_w") < F.col("width")).alias("sw"), last(h, F.col("bbox_h") < F.col("height")).alias("sh"))
    return own.select("doc", "page", F.coalesce(F.greatest("sw", "sh"), F.lit(1.0)).alias("scale"))


def limited_scale(scale: Column, width: Column, height: Column) -> Column:
    """scale, less where a side would have more than MOST_PIXELS."""
    return F.least(scale, MOST_PIXELS / width, MOST_PIXELS / height)


def depth_verdict(images: DataFrame) -> DataFrame:
    """(doc, tiff): does every page hold images of the one depth 1?"""
    pages = images.groupBy("doc", "page").agg(F.collect_set("depth").alias("depths"))
    return pages.groupBy("doc").agg(F.bool_and((F.size("depths") == 1) & F.array_contains("depths", 1)).alias("tiff"))


def document_verdict(pages: DataFrame, images: DataFrame) -> DataFrame:
    """(doc, verdict): RGB, Grayscale or Bitonal, or unknown; pages: (doc, page, mode), images: (doc, page, mode).

    A page in colour decides; without images the pages' modes do; else images in colour, then grey pages or
    images, then 1-bit images.
    """
    p = pages.groupBy("doc").agg(*(F.coalesce(F.bool_or(F.col("mode") == m), F.lit(False)).alias(f"p_{m}") for m in ("RGB", "Grayscale", "Bitonal")))
    is_in = lambda *m: F.coalesce(F.bool_or(F.col("mode").isin(*m)), F.lit(False))
    i = images.groupBy("doc").agg(is_in("RGB", "RGBA").alias("i_rgb"), is_in("L", "LA").alias("i_grey"), is_in("1").alias("i_bit"), F.lit(True).alias("any"))
    return p.join(i, "doc", "left").select(
        "doc",
        F.when(F.col("p_RGB"), "RGB")
        .when(F.col("any").isNull(), F.when(F.col("p_Grayscale"), "Grayscale").when(F.col("p_Bitonal"), "Bitonal").otherwise("unknown"))
        .when(F.col("i_rgb"), "RGB")
        .when(F.col("p_Grayscale") | F.col("i_grey"), "Grayscale")
        .when(F.col("i_bit"), "Bitonal")
        .otherwise("unknown")
        .alias("verdict"),
    )


def page_record(images: DataFrame, geometry: DataFrame) -> DataFrame:
    """(doc, page, record): the nested facts of each page, its images in order; no images gives NULL."""
    own = images.groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.struct("ord", "xref", "mask_xref", "width", "height", "depth", "label"))).alias("image_data"))
    g = geometry.select("doc", F.col("page_idx").alias("page"), "imwidth", "imheight")
    return g.join(own, ["doc", "page"], "left").select("doc", "page", F.struct(F.array(F.lit(0), F.lit(0), "imwidth", "imheight").alias("page_rect"), "image_data").alias("record"))


def without_draw_commands(content: Column, labels: Column) -> Column:
    """content with the lines that draw one of the labels emptied."""
    commands = F.transform(labels, lambda x: F.concat(F.lit("/"), x, F.lit(" Do")))
    return F.array_join(F.transform(F.split(content, "\n", -1), lambda line: F.when(F.array_contains(commands, F.trim(line)), "").otherwise(line)), "\n")


def layer_views(images: DataFrame, masks_only: bool = False) -> DataFrame:
    """(doc, page, ord, layer, xref): the images of each page, each followed by its mask; or the masks alone."""
    image = F.struct(F.lit("image").alias("layer"), F.col("xref").alias("xref"))
    mask = F.when(F.col("mask_xref") > 0, F.struct(F.lit("mask").alias("layer"), F.col("mask_xref").alias("xref")))
    views = F.array(mask) if masks_only else F.array(image, mask)
    return images.select("doc", "page", "ord", F.explode(F.filter(views, lambda v: v.isNotNull())).alias("v")).select("doc", "page", "ord", "v.layer", "v.xref")


def copied_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Links by address of pages that the new document has too, and how many others a page had.

    links: (doc, page, kind, uri); pages: (doc, page).
    """
    kept = links.join(pages, ["doc", "page"])
    return kept.groupBy("doc", "page").agg(F.count_if(F.col("kind") == "uri").alias("copied"), F.count_if(F.col("kind") != "uri").alias("skipped"))
