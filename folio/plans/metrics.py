"""Queries on timings, sizes, images and colour verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.functions import colour as C
from folio.operators import images as I
from folio.operators import metrics as M
from folio.operators import scandata as S
from folio.operators.geometry import page_sizes, with_document
from folio.plans.pages import PAGES_SQL, SKIP_SQL, pages, read


def timings(spark, d):
    """Each step of a page once; seconds as whole ten-thousandths, so sums are exact."""
    once = read(spark, d, "timings").dropDuplicates(["doc", "page_idx", "step_key", "seconds", "logged_at"])
    return once.withColumn("seconds", F.round(F.col("seconds") * 10000).cast("long"))


T_SQL = "t AS (SELECT DISTINCT doc, page_idx, step_key, round(seconds * 10000)::BIGINT AS s, logged_at FROM timings)"


def timing_summary(spark, d):
    t = M.timing_summary(timings(spark, d).withColumn("seconds", F.col("seconds")))
    return t.select("step_key", (F.floor(F.col("ms") / 10000)).cast("long").alias("ms"))


def timing_by_item(spark, d):
    t = M.timing_summary(timings(spark, d), ["doc"])
    return t.select("doc", "step_key", F.floor(F.col("ms") / 10000).cast("long").alias("ms"))


def time_per_page(spark, d):
    t = timings(spark, d).groupBy("doc").agg(F.sum("seconds").alias("s"), F.count_distinct("page_idx").alias("pages"))
    return t.select("doc", "pages", F.expr("(s div 10) div pages").alias("ms_per_page"))


def report_windows(spark, d):
    per_page = timings(spark, d).groupBy("doc", "page_idx").agg(F.sum("seconds").alias("s"))
    r = M.report_windows(per_page, 4, "page_idx")
    return r.groupBy("doc", "report").agg(F.count("*").alias("pages"), F.min("page_idx").alias("first_page"), F.sum("s").alias("s"))


def compression_ratio(spark, d):
    """Raw bytes of the pages that are kept over those of all their images as stored sizes allow."""
    g = read(spark, d, "page_geometry")
    kept = pages(spark, d).where(~S.is_skipped(F.col("add_to_access"))).select("doc", F.col("idx").alias("page_idx"))
    source = g.join(kept, ["doc", "page_idx"]).select("doc", (F.col("imwidth").cast("long") * F.col("imheight")).alias("bytes"))
    i = read(spark, d, "page_images").select("doc", F.expr("cast(width as bigint) * height * depth div 8").alias("bytes"))
    return M.compression_ratio(source, i).select("doc", "source", "output", F.expr("cast(source as decimal(20,0)) * 1000000 div nullif(output, 0)").alias("ratio_millionths"))


def layer_breakdown(spark, d):
    i = read(spark, d, "page_images").select("doc", "page", "ord", F.expr("cast(width as bigint) * height * depth div 8").alias("bytes"), F.when(F.col("mask_xref") > 0, F.expr("cast(width as bigint) * height div 8")).alias("mask_bytes"))
    totals = i.groupBy("doc").agg((F.sum("bytes") + F.coalesce(F.sum("mask_bytes"), F.lit(0)) + 1000).alias("total"))
    return M.layer_breakdown(i, totals).select("doc", "total", "background", "foreground", "mask", "rest")


def image_position(spark, d):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("doc", "page").orderBy("ord")) - 1
    return read(spark, d, "page_images").select("doc", "page", "xref", n.cast("int").alias("position"), F.when(n == 0, "background").when(n == 1, "foreground").otherwise("other").alias("layer"))


def first_placement(spark, d):
    """Each image with the first of two placements, the page and a quarter of it."""
    i = read(spark, d, "page_images")
    p = i.select("doc", "page", "xref", F.explode(F.array(F.struct(F.lit(0).alias("ord"), (F.col("width") / 3).alias("bbox_w"), (F.col("height") / 3).alias("bbox_h")), F.struct(F.lit(1).alias("ord"), F.col("width").cast("double").alias("bbox_w"), F.col("height").cast("double").alias("bbox_h")))).alias("p")).select("doc", "page", "xref", "p.*")
    w = I.with_placement(i, p)
    return w.select("doc", "page", "xref", F.floor(F.col("bbox_w") * 1000).cast("long").alias("bbox_w"), F.floor(F.col("bbox_h") * 1000).cast("long").alias("bbox_h"))


def mask_left_join(spark, d):
    i = read(spark, d, "page_images")
    masks = i.where("mask_xref > 0").select("doc", F.col("mask_xref").alias("xref"), "width", "height", F.lit(1).alias("depth"))
    return I.with_mask(i, masks).select("doc", "page", "ord", "xref", "mask_width", "mask_height", "mask_depth")


def placed(spark, d):
    i = read(spark, d, "page_images").where("width > 0 and height > 0")
    g = page_sizes(with_document(read(spark, d, "page_geometry"), read(spark, d, "items"))).where("imwidth > 0").select("doc", F.col("page_idx").alias("page"), F.col("width").alias("bbox_w"), F.col("height").alias("bbox_h"))
    return i.join(g, ["doc", "page"])


def page_scale(spark, d):
    return I.page_scale(placed(spark, d)).select("doc", "page", F.floor(F.col("scale") * 1000 + 0.5).cast("long").alias("scale"))


def scale_clamp(spark, d):
    s = I.page_scale(placed(spark, d)).join(placed(spark, d).groupBy("doc", "page").agg(F.first("bbox_w").alias("w"), F.first("bbox_h").alias("h")), ["doc", "page"])
    k = I.limited_scale(F.col("scale"), F.col("w"), F.col("h"))
    return s.select("doc", "page", F.floor(k * 1000 + 0.5).cast("long").alias("scale"), F.floor(72 * k).cast("long").alias("ppi"))


def depth_sets(spark, d):
    return I.depth_verdict(read(spark, d, "page_images"))


def modes(spark, d):
    i = read(spark, d, "page_images").withColumn("mode", C.pixel_mode(F.col("depth"), F.when((F.col("depth") == 8) & (F.col("stream_filter") == "DCTDecode"), 3).otherwise(1)))
    p = i.groupBy("doc", "page").agg(F.min("depth").alias("depth")).select("doc", "page", F.when(F.col("depth") == 1, "Bitonal").otherwise("Grayscale").alias("mode"))
    return p, i.select("doc", "page", "mode")


def document_verdict(spark, d):
    return I.document_verdict(*modes(spark, d))


def stream_formats(spark, d):
    return read(spark, d, "page_images").groupBy(C.stream_format(F.col("stream_filter")).alias("format")).agg(F.count("*").alias("images"))


def page_records(spark, d):
    r = I.page_record(read(spark, d, "page_images"), read(spark, d, "page_geometry"))
    return r.select("doc", "page", F.coalesce(F.size("record.image_data"), F.lit(-1)).alias("images"), F.col("record.image_data")[0]["xref"].alias("first_xref"), F.array_join(F.col("record.page_rect"), ",").alias("rect"))


def warning_union(spark, d):
    return M.warning_union(page_sizes(with_document(read(spark, d, "page_geometry"), read(spark, d, "items")))).select("doc", F.array_join("warnings", ",").alias("warnings"))


def link_counts(spark, d):
    """Links of two kinds counted per item: images with a mask stand for links by address, the others by name."""
    kind = F.when(F.col("mask_xref") > 0, "uri").otherwise("named")
    return read(spark, d, "page_images").groupBy("doc").agg(F.count("*").alias("links"), F.count_if(kind == "named").alias("skipped"))


def layer_views(spark, d):
    return I.layer_views(read(spark, d, "page_images"))


def mask_views(spark, d):
    return I.layer_views(read(spark, d, "page_images"), masks_only=True)


def copied_links(spark, d):
    """Images stand for links, those with a mask by address; pages are the kept ones."""
    links = read(spark, d, "page_images").select("doc", "page", F.when(F.col("mask_xref") > 0, "uri").otherwise("named").alias("kind"), "label")
    kept = pages(spark, d).where(~S.is_skipped(F.col("add_to_access"))).select("doc", F.col("idx").alias("page"))
    return I.copied_links(links, kept)


def metadata_defaults(spark, d):
    from folio.functions.text import first_given, stamp

    i = read(spark, d, "items")
    return i.select("doc", first_given(F.col("title"), F.col("source"), F.lit("No title")).alias("title"), stamp(F.col("scanned_at"), pdf=True).alias("created"), stamp(F.col("scanned_at")).alias("iso"))


def ppi_of_width(spark, d):
    """Pixels an inch of pages as wide as an image at its resolution, and of half that."""
    g = read(spark, d, "page_geometry").where("imwidth > 0 and dpi is not null")
    width = F.col("imwidth") * 72 / F.col("dpi")
    return g.select("doc", "page_idx", F.floor(72 / (width / F.col("imwidth")) + 0.5).cast("int").alias("ppi"), F.floor(72 / (width / 2 / F.col("imwidth")) + 0.5).cast("int").alias("half"))


def object_offsets(spark, d):
    i = read(spark, d, "page_images").withColumn("size", F.length(F.format_string("%d 0 obj %dx%d endobj", "xref", "width", "height")))
    return M.offsets(i, ["doc"], "xref", "size").select("doc", "xref", "size", "offset")


def file_names(spark, d):
    from folio.functions.text import file_name

    return read(spark, d, "page_geometry").select("doc", "page_idx", file_name(F.col("doc").cast("string"), F.col("page_idx"), "jp2").alias("name"))


QUERIES = {f.__name__: f for f in (timing_summary, timing_by_item, time_per_page, report_windows, compression_ratio, layer_breakdown, image_position, first_placement, mask_left_join, page_scale, scale_clamp, depth_sets, document_verdict, stream_formats, page_records, warning_union, link_counts, layer_views, mask_views, copied_links, metadata_defaults, ppi_of_width, object_offsets, file_names)}

from folio.plans.pages import ORACLES as _P  # noqa: E402

SIZE_SQL = _P["page_size"].rsplit("SELECT doc, page_idx, floor(width", 1)[0]
PLACED_SQL = f"{SIZE_SQL.rstrip()}, pl AS (SELECT i.*, w5.width AS bbox_w, w5.height AS bbox_h FROM page_images i JOIN w5 ON i.doc = w5.doc AND i.page = w5.page_idx WHERE i.width > 0 AND i.height > 0 AND w5.imwidth > 0), sc AS (SELECT doc, page, coalesce(greatest(arg_max(CASE WHEN bbox_w < width THEN width / bbox_w END, CASE WHEN bbox_w < width THEN ord END), arg_max(CASE WHEN bbox_h < height THEN height / bbox_h END, CASE WHEN bbox_h < height THEN ord END)), 1.0) AS scale, min(bbox_w) AS w, min(bbox_h) AS h FROM pl GROUP BY doc, page)"
ORACLES = {
    "timing_summary": f"WITH {T_SQL} SELECT step_key, (sum(s) * 1000 // (SELECT count(*) FROM t WHERE step_key = 'image_load') // 10000)::BIGINT AS ms FROM t GROUP BY step_key",
    "timing_by_item": f"WITH {T_SQL}, n AS (SELECT doc, count(*) AS n FROM t WHERE step_key = 'image_load' GROUP BY doc) SELECT t.doc, step_key, (sum(s) * 1000 // any_value(n.n) // 10000)::BIGINT AS ms FROM t LEFT JOIN n ON t.doc = n.doc GROUP BY t.doc, step_key",
    "time_per_page": f"WITH {T_SQL} SELECT doc, count(DISTINCT page_idx) AS pages, ((sum(s) // 10) // count(DISTINCT page_idx))::BIGINT AS ms_per_page FROM t GROUP BY doc",
    "report_windows": f"WITH {T_SQL}, p AS (SELECT doc, page_idx, sum(s) AS s FROM t GROUP BY doc, page_idx), r AS (SELECT *, (row_number() OVER (PARTITION BY doc ORDER BY page_idx) - 1) // 4 AS report FROM p) SELECT doc, report::INT AS report, count(*) AS pages, min(page_idx) AS first_page, sum(s)::BIGINT AS s FROM r GROUP BY doc, report",
    "compression_ratio": f"WITH {PAGES_SQL}, a AS (SELECT g.doc, sum(imwidth::BIGINT * imheight) AS source FROM page_geometry g JOIN p ON g.doc = p.doc AND g.page_idx = p.idx WHERE NOT {SKIP_SQL} GROUP BY g.doc), b AS (SELECT doc, sum(width::BIGINT * height * depth // 8) AS output FROM page_images GROUP BY doc) SELECT a.doc, source::BIGINT AS source, output::BIGINT AS output, (source * 1000000 // output)::BIGINT AS ratio_millionths FROM a JOIN b ON a.doc = b.doc",
    "layer_breakdown": "WITH i AS (SELECT *, width::BIGINT * height * depth // 8 AS b, CASE WHEN mask_xref > 0 THEN width::BIGINT * height // 8 END AS m FROM page_images), a AS (SELECT doc, sum(b) + coalesce(sum(m), 0) + 1000 AS total, coalesce(sum(b) FILTER (ord = 0), 0) AS background, coalesce(sum(b) FILTER (ord = 1), 0) AS foreground, coalesce(sum(m) FILTER (ord = 1), 0) AS mask FROM i GROUP BY doc) SELECT doc, total::BIGINT AS total, background::BIGINT AS background, foreground::BIGINT AS foreground, mask::BIGINT AS mask, (total - background - foreground - mask)::BIGINT AS rest FROM a",
    "image_position": "SELECT doc, page, xref, (row_number() OVER w - 1)::INT AS position, CASE row_number() OVER w WHEN 1 THEN 'background' WHEN 2 THEN 'foreground' ELSE 'other' END AS layer FROM page_images WINDOW w AS (PARTITION BY doc, page ORDER BY ord)",
    "first_placement": "SELECT doc, page, xref, floor(width / 3 * 1000)::BIGINT AS bbox_w, floor(height / 3 * 1000)::BIGINT AS bbox_h FROM page_images",
    "mask_left_join": "SELECT doc, page, ord, xref, CASE WHEN mask_xref > 0 THEN width END AS mask_width, CASE WHEN mask_xref > 0 THEN height END AS mask_height, CASE WHEN mask_xref > 0 THEN 1 END AS mask_depth FROM page_images",
    "page_scale": f"{PLACED_SQL} SELECT doc, page, floor(scale * 1000 + 0.5)::BIGINT AS scale FROM sc",
    "scale_clamp": f"{PLACED_SQL} SELECT doc, page, floor(least(scale, 10000 / w, 10000 / h) * 1000 + 0.5)::BIGINT AS scale, floor(72 * least(scale, 10000 / w, 10000 / h))::BIGINT AS ppi FROM sc",
    "depth_sets": "SELECT doc, bool_and(ok) AS tiff FROM (SELECT doc, page, min(depth) = 1 AND max(depth) = 1 AS ok FROM page_images GROUP BY doc, page) GROUP BY doc",
    "document_verdict": "WITH i AS (SELECT *, CASE WHEN depth = 8 AND stream_filter = 'DCTDecode' THEN 'RGB' WHEN depth = 1 THEN '1' ELSE 'L' END AS mode FROM page_images), p AS (SELECT doc, page, CASE WHEN min(depth) = 1 THEN 'Bitonal' ELSE 'Grayscale' END AS mode FROM i GROUP BY doc, page) SELECT p.doc, CASE WHEN bool_or(p.mode = 'RGB') OR bool_or(coalesce(i.mode = 'RGB', false)) THEN 'RGB' WHEN bool_or(p.mode = 'Grayscale') OR bool_or(i.mode = 'L') THEN 'Grayscale' WHEN bool_or(i.mode = '1') THEN 'Bitonal' ELSE 'unknown' END AS verdict FROM p JOIN i ON p.doc = i.doc GROUP BY p.doc",
    "stream_formats": "SELECT CASE stream_filter WHEN 'JPXDecode' THEN 'jpeg2000' WHEN 'DCTDecode' THEN 'jpeg' WHEN 'JBIG2Decode' THEN 'jbig2' WHEN 'CCITTFaxDecode' THEN 'ccitt' WHEN 'FlateDecode' THEN 'png' END AS format, count(*) AS images FROM page_images GROUP BY 1",
    "page_records": "WITH i AS (SELECT doc, page, count(*) AS n, arg_min(xref, ord) AS x FROM page_images GROUP BY doc, page) SELECT g.doc, g.page_idx AS page, coalesce(n, -1)::INT AS images, x AS first_xref, concat('0,0,', imwidth, ',', imheight) AS rect FROM page_geometry g LEFT JOIN i ON g.doc = i.doc AND g.page_idx = i.page",
    "warning_union": f"{SIZE_SQL} SELECT doc, CASE WHEN bool_or(bad) THEN 'invalid-page-size' ELSE '' END AS warnings FROM w5 GROUP BY doc",
    "link_counts": "SELECT doc, count(*) AS links, count(*) FILTER (NOT coalesce(mask_xref > 0, false)) AS skipped FROM page_images GROUP BY doc",
    "layer_views": "SELECT doc, page, ord, 'image' AS layer, xref FROM page_images UNION ALL SELECT doc, page, ord, 'mask', mask_xref FROM page_images WHERE mask_xref > 0",
    "mask_views": "SELECT doc, page, ord, 'mask' AS layer, mask_xref AS xref FROM page_images WHERE mask_xref > 0",
    "copied_links": f"WITH {PAGES_SQL} SELECT i.doc, i.page, count(*) FILTER (coalesce(mask_xref > 0, false)) AS copied, count(*) FILTER (NOT coalesce(mask_xref > 0, false)) AS skipped FROM page_images i JOIN p ON i.doc = p.doc AND i.page = p.idx WHERE NOT {SKIP_SQL} GROUP BY i.doc, i.page",
    "metadata_defaults": "SELECT doc, CASE WHEN trim(title) <> '' THEN title WHEN trim(source) <> '' THEN source ELSE 'No title' END AS title, strftime(scanned_at, 'D:%Y%m%d%H%M%SZ') AS created, strftime(scanned_at, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM items",
    "ppi_of_width": "SELECT doc, page_idx, floor(72 / (imwidth * 72 / dpi / imwidth) + 0.5)::INT AS ppi, floor(72 / (imwidth * 72 / dpi / 2 / imwidth) + 0.5)::INT AS half FROM page_geometry WHERE imwidth > 0 AND dpi IS NOT NULL",
    "object_offsets": "WITH i AS (SELECT *, length(xref || ' 0 obj ' || width || 'x' || height || ' endobj') AS size FROM page_images) SELECT doc, xref, size::INT AS size, coalesce(sum(size) OVER (PARTITION BY doc ORDER BY xref ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset FROM i",
    "file_names": "SELECT doc, page_idx, doc || '_' || lpad(page_idx::VARCHAR, 6, '0') || '.jp2' AS name FROM page_geometry",
}
