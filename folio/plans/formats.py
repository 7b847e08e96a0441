"""Queries that write a format and read it again."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from folio.operators.page_words import page_lines
from folio.plans.metrics import modes
from folio.plans.pages import OUT_SQL, PAGES_SQL, pages, read
from folio.plans.text import SIZE_SQL, WORDS_SQL, placed
from folio.sources import archive, codecs, hocr, images, pdf, scandata
from folio.sources.stored import shared_folder


def hocr_words(spark, d):
    """OCR words through hOCR and back."""
    pages_ = page_lines(read(spark, d, "ocr_words"), read(spark, d, "page_geometry"), ["imwidth", "imheight", "hocr_dpi"])
    text = pages_.select(F.concat_ws("/", "doc", "page_idx").alias("doc"), hocr.write_page(F.col("lines"), F.col("imwidth"), F.col("imheight"), F.col("hocr_dpi")).alias("hocr"))
    r = hocr.hocr_words(text)
    m = lambda c, n: F.floor(c * 1000 + 0.5).cast("long").alias(n)
    return r.select("doc", "page_width", "page_height", "scan_res", F.col("line").alias("line_no"), F.col("word").alias("word_no"), "text", m(F.col("conf"), "conf"), m(F.col("bbox.x0"), "x0"), m(F.col("bbox.y1"), "y1"), m(F.col("fontsize"), "fontsize"), "direction")


def scandata_round_trip(spark, d):
    p = pages(spark, d)
    xml = scandata.book_xml(p, read(spark, d, "items").select("doc", "dpi"))
    r = scandata.scandata_pages(xml)
    return r.select("doc", "idx", "leaf_num", F.col("page_type._VALUE").alias("kind"), F.col("page_type._title").alias("title"), "add_to_access", F.nullif(F.trim("page_number"), F.lit("")).alias("page_number"), "ppi")


def pdf_page_facts(spark, d):
    """Pages of the text-only documents, read from their bytes."""
    from folio.plans.text import text_parts
    from folio.sources.pdf_parts import assembled

    pages_ = pdf.pdf_pages(assembled(text_parts(spark, d)))
    return pages_.groupBy("doc").agg(F.count("*").alias("pages"), F.count_if("has_text").alias("with_text"))


def page_image_files(spark, d):
    """Rasters of the test vectors as PNG and back to rasters, with what the first bytes tell."""
    from folio.plans.raster import pages_of

    @F.udf("binary")
    def png(data, h, w):
        import numpy as np

        return images.encode_png(np.frombuffer(data, np.uint8).reshape(h, w))

    r = pages_of(spark, d)
    files = r.select("doc", "page_idx", png("data", "height", "width").alias("content"))
    back = images.rasters(images.with_probe(files).select("doc", "page_idx", "content", "probe")).withColumnRenamed("data", "decoded")
    probed = images.with_probe(files).select("page_idx", F.col("probe.format").alias("format"), F.col("probe.width").alias("probe_width"), F.col("probe.height").alias("probe_height"))
    return back.join(r.select("page_idx", "data"), "page_idx").join(probed, "page_idx").select("page_idx", "format", "probe_width", "probe_height", "mode", (F.col("decoded") == F.col("data")).alias("same"))


def page_zips(spark, d):
    """Names in the archives of page images, and the bytes of the rasters in them."""
    import io
    import zipfile

    from folio.plans.raster import pages_of

    def run(batches):
        for rows in batches:
            out = []
            for r in rows.itertuples():
                with zipfile.ZipFile(io.BytesIO(r.zip)) as z:
                    out += [(r.doc, int(r.pages), n, int(images.decode(z.read(n)).size)) for n in z.namelist()]
            yield pd.DataFrame(out, columns=["doc", "pages", "name", "bytes"])

    z = archive.page_zips(pages_of(spark, d), spark.range(1).select(F.col("id").alias("doc"), F.lit("vectors").alias("identifier")))
    return z.mapInPandas(run, "doc long, pages int, name string, bytes long")


def page_json(spark, d):
    from folio.operators.images import page_record

    j = archive.page_json(page_record(read(spark, d, "page_images"), read(spark, d, "page_geometry")))
    return j.select("doc", F.get_json_object("json", "$.page_count").cast("int").alias("page_count"), F.get_json_object("json", "$.page_data[0].image_data[0].xref").cast("int").alias("first_xref"))


def item_rasters(spark, d):
    """An image file for every page of every item: the strips of the test vectors, dealt out over docs and pages in turn."""
    from folio.plans.raster import pages_of

    strips = images.write_stack(pages_of(spark, d).withColumnRenamed("page_idx", "strip"), shared_folder(spark, "folio-strips"), ["strip"])
    number = read(spark, d, "embeddings").agg((F.expr("max(vec_id) div 25") + 1).alias("strips"))
    keys = read(spark, d, "page_geometry").select("doc", "page_idx").distinct().crossJoin(F.broadcast(number))  # one row
    dealt = keys.select("doc", "page_idx", F.pmod(F.col("doc") + F.col("page_idx"), F.col("strips")).cast("int").alias("strip"))
    return dealt.join(strips, "strip").select("doc", "page_idx", "path")


def recoded(spark, d):
    """Layered documents of all items with pages, from image files, with the text layer of the same pages."""
    from folio.plans.recode import Options, recode

    parts, report = recode(item_rasters(spark, d), *(read(spark, d, n) for n in ("ocr_words", "page_geometry", "scandata_pages", "items")), Options(bg_downsample=2))
    size = parts.groupBy("doc").agg(F.sum(F.length("data")).alias("bytes"))
    return report.join(size, "doc").select("doc", "pages", "source_bytes", (F.col("bytes") > 0).alias("written"), F.array_join("warnings", ",").alias("warnings"))


def recoded_bitonal(spark, d):
    """The same documents in one bit a pixel: one picture a page, by the documents' parts read again."""
    from folio.plans.recode import Options, recode

    parts, report = recode(item_rasters(spark, d), *(read(spark, d, n) for n in ("ocr_words", "page_geometry", "scandata_pages", "items")), Options(bitonal=True, limit=3))
    found = lambda pattern: F.sum(F.size(F.expr(f"regexp_extract_all(decode(data, 'ISO-8859-1'), '{pattern}', 0)"))).alias("n")
    one_bit = parts.groupBy("doc").agg(found("/BitsPerComponent 1 ").alias("pictures"))
    return report.join(one_bit, "doc").select("doc", "pages", "source_bytes", F.col("pictures").cast("long").alias("pictures"))


def pdf_rasters(spark, d):
    """Documents of four strips each as PDF, with a line of text on every page: (doc, pdf)."""
    from folio.plans.raster import pages_of

    def run(key, rows):
        pages = [{"width": r.width / 2, "height": r.height / 2, "content": "BT\n3 Tr /f-0-0 8 Tf [ <00410020> ] TJ\nET\n", "images": [{"width": r.width, "height": r.height, "data": bytes(r.data)}]} for r in rows.sort_values("page_idx").itertuples()]
        return pd.DataFrame({"doc": [key[0]], "pdf": [pdf.build(pages, f"Strips {key[0]}")]})

    strips = pages_of(spark, d).withColumn("doc", F.expr("page_idx div 4"))
    return strips.groupBy("doc").applyInPandas(run, "doc long, pdf binary")  # four pages


def recompressed(spark, d):
    """What is on the pages of PDFs whose pictures were separated into layers, and of the PDFs before."""
    from folio.plans.recompress import recompress

    before = pdf_rasters(spark, d)
    facts = lambda f: pdf.pdf_pages(f).select("doc", "page", "has_text", F.size("images").alias("images"), F.size(F.filter("images", lambda x: x["mask_xref"] > 0)).alias("masks"), F.col("images")[0]["bbox"].alias("bbox"))
    after = facts(recompress(before))
    return after.join(facts(before).select("doc", "page", F.col("images").alias("were"), F.col("bbox").alias("at")), ["doc", "page"]).select("doc", "page", "has_text", "were", "images", "masks", (F.col("bbox") == F.col("at")).alias("in_place"))


def pdf_page_pictures(spark, d):
    """Size, mode and scale of the pictures of PDFs, and whether their pixels are those of the strips they were made of."""
    from folio.plans.raster import pages_of

    r = pdf.page_rasters(pdf_rasters(spark, d))
    own = pages_of(spark, d).select(F.expr("page_idx div 4").alias("doc"), (F.col("page_idx") % 4).alias("page_idx"), F.col("data").alias("was"))
    return r.join(own, ["doc", "page_idx"]).select("doc", "page_idx", "height", "width", "mode", (F.col("data") == F.col("was")).alias("same"))


def recoded_from_pdf(spark, d):
    """Pages of PDFs recoded with OCR pages in which some are skipped: the n-th kept page takes the n-th page of the PDF."""
    from folio.plans.recode import Options, recode

    data = [read(spark, d, n) for n in ("ocr_words", "page_geometry", "scandata_pages", "items")]
    _, report = recode(pdf.page_rasters(pdf_rasters(spark, d)), *data, Options(from_pdf=True, limit=4))
    return report.select("doc", "pages", "source_bytes")


def page_json_facts(spark, d):
    """Page facts through JSON and back, boxes in two decimals."""
    from folio.operators.images import page_record

    j = archive.page_json(page_record(read(spark, d, "page_images"), read(spark, d, "page_geometry")))
    return archive.read_page_json(j).select("doc", "page", "xref", "width", "height", "depth", "label", "mask_xref")


def codec_commands(spark, d):
    rows = [(i, e, n, " ".join(codecs.command(i, e, ["-x"], n))) for i in codecs.PROGRAMS for e in (True, False) for n in (1, 4)]
    return spark.createDataFrame(rows, "implementation string, encoding boolean, threads int, command string")


def text_verdicts(spark, d):
    """Pages' and images' modes counted per document."""
    p, i = modes(spark, d)
    return i.groupBy("doc", "mode").agg(F.count("*").alias("images"))


QUERIES = {f.__name__: f for f in (hocr_words, scandata_round_trip, pdf_page_facts, page_image_files, page_zips, page_json, page_json_facts, pdf_page_pictures, recompressed, recoded, recoded_bitonal, recoded_from_pdf, codec_commands, text_verdicts)}
STRIPS_SQL = "st AS (SELECT k::INT AS strip, (least(25, n - k * 25) * 4)::INT AS h FROM (SELECT count(*) AS n FROM embeddings), (SELECT unnest(range(0, 1 + (SELECT count(*) FROM embeddings) // 25)) AS k) WHERE k * 25 < n)"
KEPT_SQL = f"{OUT_SQL}, kp AS (SELECT o.doc, o.idx, o.out_idx FROM o JOIN (SELECT DISTINCT doc, page_idx FROM page_geometry WHERE imwidth > 0) g ON o.doc = g.doc AND o.idx = g.page_idx WHERE NOT o.skipped)"
ORACLES = {
    "page_zips": f"WITH {STRIPS_SQL} SELECT 0::BIGINT AS doc, (SELECT count(*) FROM st)::INT AS pages, 'vectors_png/vectors_' || lpad(strip::VARCHAR, 4, '0') || '.png' AS name, h::BIGINT * 256 AS bytes FROM st",
    "page_json_facts": "SELECT g.doc, g.page_idx AS page, i.xref, i.width, i.height, i.depth, i.label, i.mask_xref FROM (SELECT DISTINCT doc, page_idx FROM page_geometry) g JOIN page_images i ON g.doc = i.doc AND g.page_idx = i.page",
    "pdf_page_pictures": f"WITH {STRIPS_SQL} SELECT strip::BIGINT // 4 AS doc, strip % 4 AS page_idx, h AS height, 256 AS width, 'L' AS mode, true AS same FROM st",
    "recompressed": f"WITH {STRIPS_SQL} SELECT strip::BIGINT // 4 AS doc, strip % 4 AS page, true AS has_text, 1 AS were, 2 AS images, 1 AS masks, true AS in_place FROM st",
    "recoded": f"{SIZE_SQL.strip()}, {STRIPS_SQL}, {KEPT_SQL} SELECT kp.doc, count(*) AS pages, sum(h * 256)::BIGINT AS source_bytes, true AS written, CASE WHEN bool_or(coalesce(bad, false)) THEN 'invalid-page-size' ELSE '' END AS warnings FROM kp JOIN st ON (kp.doc + kp.idx) % (SELECT count(*) FROM st) = st.strip JOIN w5 z ON kp.doc = z.doc AND kp.idx = z.page_idx GROUP BY kp.doc",
    "recoded_bitonal": f"WITH {STRIPS_SQL}, {KEPT_SQL} SELECT kp.doc, count(*) AS pages, sum(h * 256)::BIGINT AS source_bytes, count(*) AS pictures FROM kp JOIN st ON (kp.doc + kp.idx) % (SELECT count(*) FROM st) = st.strip WHERE out_idx < 3 GROUP BY kp.doc",
    "recoded_from_pdf": f"WITH {STRIPS_SQL}, {KEPT_SQL} SELECT kp.doc, count(*) AS pages, coalesce(sum(h * 256), 0)::BIGINT AS source_bytes FROM kp LEFT JOIN st ON kp.doc = st.strip // 4 AND kp.out_idx = st.strip % 4 WHERE out_idx < 4 GROUP BY kp.doc",
    "hocr_words": f"""WITH {WORDS_SQL}, n AS (SELECT w.*, imwidth, imheight, hocr_dpi, dense_rank() OVER (PARTITION BY w.doc, w.page_idx ORDER BY line) - 1 AS ln, row_number() OVER (PARTITION BY w.doc, w.page_idx, line ORDER BY word) - 1 AS wn FROM w JOIN page_geometry g ON w.doc = g.doc AND w.page_idx = g.page_idx)
      SELECT doc || '/' || page_idx AS doc, imwidth AS page_width, imheight AS page_height, hocr_dpi AS scan_res, ln::INT AS line_no, wn::INT AS word_no, trim(coalesce(text, '')) AS text, floor(conf * 1000 + 0.5)::BIGINT AS conf, floor(bbox.x0 * 1000 + 0.5)::BIGINT AS x0, floor(bbox.y1 * 1000 + 0.5)::BIGINT AS y1, floor(fontsize * 1000 + 0.5)::BIGINT AS fontsize, direction FROM n""",
    "scandata_round_trip": f"WITH {PAGES_SQL} SELECT doc, idx, leaf_num, page_type._VALUE AS kind, page_type._title AS title, add_to_access, nullif(trim(page_number), '') AS page_number, ppi FROM p",
    "pdf_page_facts": f"WITH {WORDS_SQL} SELECT w.doc, count(DISTINCT w.page_idx) AS pages, count(DISTINCT w.page_idx) AS with_text FROM w JOIN page_geometry g ON w.doc = g.doc AND w.page_idx = g.page_idx WHERE g.imwidth > 0 GROUP BY w.doc",
    "page_image_files": "SELECT k::INT AS page_idx, 'png' AS format, 256 AS probe_width, (least(25, n - k * 25) * 4)::INT AS probe_height, 'L' AS mode, true AS same FROM (SELECT count(*) AS n FROM embeddings), (SELECT unnest(range(0, 1000)) AS k) WHERE k * 25 < n",
    "page_json": "SELECT g.doc, count(*)::INT AS page_count, any_value(x) AS first_xref FROM page_geometry g LEFT JOIN (SELECT doc, arg_min(xref, ord) AS x FROM page_images WHERE page = 0 GROUP BY doc) i ON g.doc = i.doc GROUP BY g.doc",
    "codec_commands": "SELECT i AS implementation, e AS encoding, n AS threads, concat(CASE i WHEN 'kakadu' THEN 'kdu' WHEN 'openjpeg' THEN 'opj' ELSE 'grk' END, CASE WHEN i = 'kakadu' THEN CASE WHEN e THEN '_compress' ELSE '_expand' END ELSE CASE WHEN e THEN '_compress' ELSE '_decompress' END END, ' -x ', CASE i WHEN 'kakadu' THEN '-num_threads ' WHEN 'openjpeg' THEN '-threads ' ELSE '-H ' END, CASE WHEN i = 'kakadu' AND n = 1 THEN 0 ELSE n END) AS command FROM (SELECT unnest(['kakadu', 'openjpeg', 'grok']) AS i), (SELECT unnest([true, false]) AS e), (SELECT unnest([1, 4]) AS n)",
    "text_verdicts": "SELECT doc, CASE WHEN depth = 8 AND stream_filter = 'DCTDecode' THEN 'RGB' WHEN depth = 1 THEN '1' ELSE 'L' END AS mode, count(*) AS images FROM page_images GROUP BY 1, 2",
}
