"""Queries on OCR words and the text layer."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.functions import text as X
from folio.functions.geometry import clip_baseline
from folio.operators import text_layer as T
from folio.operators.geometry import page_sizes, with_document
from folio.plans.metrics import SIZE_SQL
from folio.plans.pages import read
from folio.sources.codecs import DEFAULT_FLAGS


def words(spark, d):
    return T.words_once(read(spark, d, "ocr_words"))


def sizes(spark, d):
    return page_sizes(with_document(read(spark, d, "page_geometry"), read(spark, d, "items"))).where("imwidth > 0").select("doc", "page_idx", "ppi", "height")


def placed(spark, d):
    return T.placed_words(words(spark, d), sizes(spark, d))


def milli(c, name=None):
    return F.floor((c if not isinstance(c, str) else F.col(c)) * 1000 + 0.5).cast("long").alias(name or c)


def line_confidence(spark, d):
    w = words(spark, d).withColumn("conf", F.round(F.col("conf") * 100).cast("long"))
    return w.groupBy("doc", "page_idx", "line").agg(F.count("*").alias("words"), F.expr("coalesce(sum(conf) div count(conf), 0)").alias("confidence"))


def admit_lines(spark, d):
    return T.line_confidence(words(spark, d)).select("doc", "page_idx", "line", "words", "admitted")


def bbox_downscale(spark, d):
    return words(spark, d).select("doc", "page_idx", "line", "word", T.scaled_box(F.col("bbox"), 3).alias("b")).select("doc", "page_idx", "line", "word", "b.*")


def bbox_validity(spark, d):
    g = read(spark, d, "page_geometry").select("doc", "page_idx", "imwidth", "imheight")
    return words(spark, d).join(g, ["doc", "page_idx"]).select("doc", "page_idx", "line", "word", T.box_status(F.col("bbox"), F.col("imwidth"), F.col("imheight")).alias("status"))


def admit_paragraphs(spark, d):
    return T.admitted_paragraphs(words(spark, d))


def utf16_hex(spark, d):
    return words(spark, d).select("text").distinct().select("text", X.utf16_hex(F.col("text")).alias("hex"))


def title_hex(spark, d):
    return read(spark, d, "items").select("doc", X.title_hex(F.col("title")).alias("hex"))


def xml_escape(spark, d):
    return read(spark, d, "documents").select("doc_id", X.xml_escape(F.col("text")).alias("text"))


def baseline_clip(spark, d):
    w = words(spark, d).where("word = 0").join(sizes(spark, d), ["doc", "page_idx"])
    b, l = F.col("line_bbox"), F.col("baseline")  # noqa: E741
    y1 = b["y1"] + l["const"]
    a, c = clip_baseline(F.col("ppi"), b["x0"], y1, b["x1"], y1 + l["slope"] * (b["x1"] - b["x0"]))
    return w.select("doc", "page_idx", "line", milli(a, "y1"), milli(c, "y2"))


def word_baseline(spark, d):
    return placed(spark, d).select("doc", "page_idx", "line", "word", milli("x"), milli("y"), milli("length"))


def affine_matrix(spark, d):
    return placed(spark, d).where("word = 0").select("doc", "page_idx", "line", *(milli(c) for c in "abcd"))


def font_fallback(spark, d):
    return placed(spark, d).select("doc", "page_idx", "line", "word", milli("size"))


def text_delta(spark, d):
    return T.with_moves(placed(spark, d)).select("doc", "page_idx", "line", "word", milli("dx"), milli("dy"), "new_font", "new_matrix")


def h_stretch(spark, d):
    return placed(spark, d).select("doc", "page_idx", "line", "word", F.floor(F.col("stretch") * 10 + 0.5).cast("long").alias("stretch"))


def text_streams(spark, d):
    """What the hidden text layer of each page holds: words, all of their codes in order, changes of font and of matrix."""
    s = T.page_streams(placed(spark, d))
    codes = F.array_join(F.regexp_extract_all("content", F.lit("<([0-9A-F]*)>"), 1), "")
    return s.select("doc", "page_idx", F.regexp_count("content", F.lit("TJ")).cast("long").alias("words"), F.sha2(codes, 256).alias("codes"), F.regexp_count("content", F.lit(" Tf")).cast("long").alias("fonts"), F.regexp_count("content", F.lit(" Tm")).cast("long").alias("matrices"))


def text_parts(spark, d):
    """The text-only documents of the items with OCR words, as parts."""
    from folio.sources.pdf_parts import document_parts

    s = page_sizes(with_document(read(spark, d, "page_geometry"), read(spark, d, "items"))).where("imwidth > 0").select("doc", "page_idx", "width", "height")
    content = T.page_streams(placed(spark, d)).join(s, ["doc", "page_idx"])
    titles = read(spark, d, "items").select("doc", "title", F.lit(None).cast("string").alias("nums"), F.lit(None).cast("array<struct<level:int,title:string,page:int>>").alias("toc"))
    keys = read(spark, d, "ocr_words").select("doc", "page_idx").distinct().join(s.select("doc", "page_idx"), ["doc", "page_idx"])
    return document_parts(content, titles, keys=keys)


def text_pdf(spark, d):
    """Of each text-only document the parts, the objects that are written, the numbers of its table and whether that stands where the file says."""
    from folio.sources.pdf_parts import BLOCK

    parts = text_parts(spark, d).withColumn("text", F.expr("decode(data, 'ISO-8859-1')"))
    in_table = F.col("text").rlike("^(xref\\n|[0-9]{10} [0-9]{5} [nf] )")
    number = lambda pattern: F.regexp_extract("text", pattern, 1).try_cast("long")
    of = parts.groupBy("doc").agg(
        F.count("*").alias("parts"),
        F.sum(F.regexp_count("text", F.lit("(?m)^[0-9]+ 0 obj$"))).cast("long").alias("objects"),
        F.max(number("^xref\\n0 ([0-9]+)\\n")).alias("numbers"),
        (F.max(number("startxref\\n([0-9]+)\\n%%EOF\\n$")) == F.sum(F.when(in_table, 0).otherwise(F.length("data")))).alias("placed"),
    )
    return of.withColumn("table_parts", F.ceil(F.col("numbers") / BLOCK).cast("long"))


def codec_arguments(spark, d):
    from folio.sources.codecs import flags_table

    return flags_table(spark)


QUERIES = {f.__name__: f for f in (line_confidence, admit_lines, bbox_downscale, bbox_validity, admit_paragraphs, utf16_hex, title_hex, xml_escape, baseline_clip, word_baseline, affine_matrix, font_fallback, text_delta, h_stretch, text_streams, text_pdf, codec_arguments)}

WORDS_SQL = "w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc, page_idx, line, word ORDER BY loaded_at) AS rk FROM ocr_words) WHERE rk = 1)"
PLACED_SQL = f"""{SIZE_SQL.strip()}, {WORDS_SQL},
j AS (SELECT w.*, s.ppi, s.height AS ph, line_bbox.x0 AS lx1, line_bbox.x1 AS lx2, line_bbox.y1 + baseline.const AS a1, line_bbox.y1 + baseline.const + baseline.slope * (line_bbox.x1 - line_bbox.x0) AS a2,
   first(direction) OVER (PARTITION BY w.doc, w.page_idx, w.line ORDER BY word) AS fd FROM w JOIN w5 s ON w.doc = s.doc AND w.page_idx = s.page_idx WHERE s.imwidth > 0),
k AS (SELECT *, abs(a1 - a2) * 72 < 2 * ppi AND 2 * ppi < abs(lx1 - lx2) * 72 AS flat, CASE WHEN fd = 'unspecified' THEN 'LTR' ELSE fd END AS dir FROM j),
l AS (SELECT *, CASE WHEN flat THEN (a1 + a2) / 2 ELSE a1 END AS ly1, CASE WHEN flat THEN (a1 + a2) / 2 ELSE a2 END AS ly2, dir = 'RTL' AS rtl FROM k),
m AS (SELECT *, (lx2 - lx1) * (lx2 - lx1) + (ly2 - ly1) * (ly2 - ly1) AS span, CASE WHEN rtl THEN bbox.x1 ELSE bbox.x0 END AS wx, CASE WHEN rtl THEN bbox.y1 ELSE bbox.y0 END AS wy FROM l),
o AS (SELECT *, ((wx - lx2) * (lx2 - lx1) + (wy - ly2) * (ly2 - ly1)) / nullif(span, 0) AS share,
   sqrt((bbox.x1 - bbox.x0) * (bbox.x1 - bbox.x0) + (bbox.y1 - bbox.y0) * (bbox.y1 - bbox.y0)) * 72 / ppi AS length,
   CASE WHEN fontsize > 0 THEN fontsize WHEN abs(ly2 - ly1) > 0 THEN abs(ly2 - ly1) ELSE 8 END AS size, atan2(ly1 - ly2, lx2 - lx1) AS theta, CASE WHEN rtl THEN -1 ELSE 1 END AS sgn FROM m),
pl AS (SELECT *, coalesce(lx2 + share * (lx2 - lx1), lx1) * 72 / ppi AS x, ph - coalesce(ly2 + share * (ly2 - ly1), ly1) * 72 / ppi AS y FROM o),
mv AS (SELECT *, x - lag(x) OVER q AS dx, y - lag(y) OVER q AS dy, coalesce(lag(size) OVER q <> size, true) AS new_font, coalesce(lag(dir) OVER q <> dir, true) AS new_matrix FROM pl WINDOW q AS (PARTITION BY doc, page_idx, par ORDER BY line, word))"""
TEXT_PAGES_SQL = f"WITH {WORDS_SQL}, n AS (SELECT w.doc, count(DISTINCT w.page_idx) AS n FROM w JOIN page_geometry g ON w.doc = g.doc AND w.page_idx = g.page_idx WHERE g.imwidth > 0 GROUP BY w.doc)"
M3 = "floor({0} * 1000 + 0.5)::BIGINT AS {1}"
ORACLES = {
    "codec_arguments": "SELECT * FROM (VALUES " + ", ".join(f"('{f}', '{i}', '{layer}', {str(hq).lower()}, '{flags}')" for f, i, layer, hq, flags in DEFAULT_FLAGS) + ") AS t(format, implementation, layer, hq, flags)",
    "text_pdf": f"{TEXT_PAGES_SQL}, z AS (SELECT doc, n, (n + 31) // 32 AS nodes FROM n), y AS (SELECT *, 14 + 6 * n + 3 * nodes AS numbers FROM z) SELECT doc, 1 + n + (numbers + 4095) // 4096 AS parts, 12 + 3 * n + 3 * nodes AS objects, numbers, true AS placed, (numbers + 4095) // 4096 AS table_parts FROM y",
    "line_confidence": f"WITH {WORDS_SQL} SELECT doc, page_idx, line, count(*) AS words, coalesce(sum(round(conf * 100)::BIGINT) // nullif(count(conf), 0) + CASE WHEN sum(round(conf * 100)::BIGINT) < 0 AND sum(round(conf * 100)::BIGINT) % count(conf) <> 0 THEN 0 ELSE 0 END, 0)::BIGINT AS confidence FROM w GROUP BY doc, page_idx, line",
    "admit_lines": f"WITH {WORDS_SQL} SELECT doc, page_idx, line, count(*)::INT AS words, coalesce(avg(conf), 0) >= 20 AND bool_or(trim(coalesce(text, '')) <> '') AS admitted FROM w GROUP BY doc, page_idx, line",
    "bbox_downscale": f"WITH {WORDS_SQL} SELECT doc, page_idx, line, word, trunc(bbox.x0 / 3)::INT AS x0, trunc(bbox.y0 / 3)::INT AS y0, trunc(bbox.x1 / 3)::INT AS x1, trunc(bbox.y1 / 3)::INT AS y1 FROM w",
    "bbox_validity": f"WITH {WORDS_SQL} SELECT w.doc, w.page_idx, line, word, CASE WHEN bbox.x0 = bbox.x1 OR bbox.y0 = bbox.y1 THEN 'degenerate' WHEN bbox.x0 > bbox.x1 OR bbox.y0 > bbox.y1 THEN 'inverted' WHEN bbox.x0 < 0 OR bbox.y0 < 0 OR bbox.x1 > imwidth OR bbox.y1 > imheight THEN 'outside' ELSE 'ok' END AS status FROM w JOIN page_geometry g ON w.doc = g.doc AND w.page_idx = g.page_idx",
    "admit_paragraphs": f"WITH {WORDS_SQL} SELECT doc, page_idx, par FROM w GROUP BY doc, page_idx, par HAVING bool_or(trim(coalesce(text, '')) <> '')",
    "utf16_hex": "SELECT text, CASE WHEN text IS NOT NULL THEN coalesce(list_aggregate(list_transform(range(1, length(text) + 1), lambda i: CASE WHEN unicode(text[i:i]) < 65536 THEN lpad(to_hex(unicode(text[i:i])), 4, '0') ELSE to_hex(55296 + (unicode(text[i:i]) - 65536) // 1024) || to_hex(56320 + (unicode(text[i:i]) - 65536) % 1024) END), 'string_agg', ''), '') END AS hex FROM (SELECT DISTINCT text FROM ocr_words)",
    "title_hex": "SELECT doc, CASE WHEN title IS NOT NULL THEN 'FEFF' || list_aggregate(list_transform(range(1, length(title) + 1), lambda i: lpad(to_hex(unicode(title[i:i])), 4, '0')), 'string_agg', '') END AS hex FROM items",
    "xml_escape": "SELECT doc_id, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS text FROM documents",
    "baseline_clip": f"{PLACED_SQL} SELECT doc, page_idx, line, {M3.format('ly1', 'y1')}, {M3.format('ly2', 'y2')} FROM l WHERE word = 0",
    "word_baseline": f"{PLACED_SQL} SELECT doc, page_idx, line, word, {M3.format('x', 'x')}, {M3.format('y', 'y')}, {M3.format('length', 'length')} FROM pl",
    "affine_matrix": f"{PLACED_SQL} SELECT doc, page_idx, line, {M3.format('sgn * cos(theta)', 'a')}, {M3.format('sgn * sin(theta)', 'b')}, {M3.format('-sin(theta)', 'c')}, {M3.format('cos(theta)', 'd')} FROM pl WHERE word = 0",
    "font_fallback": f"{PLACED_SQL} SELECT doc, page_idx, line, word, {M3.format('size', 'size')} FROM pl",
    "text_delta": f"{PLACED_SQL} SELECT doc, page_idx, line, word, {M3.format('dx', 'dx')}, {M3.format('dy', 'dy')}, new_font, new_matrix FROM mv",
    "h_stretch": f"{PLACED_SQL} SELECT doc, page_idx, line, word, floor(2 * round_even(100 * length / (size * (length(coalesce(text, '')) + 1)) * 1000, 0) / 1000 * 10 + 0.5)::BIGINT AS stretch FROM pl",
}
ORACLES["text_streams"] = f"""{PLACED_SQL}, hx AS ({ORACLES["utf16_hex"]})
  SELECT doc, page_idx, count(*) FILTER (mv.length > 0) AS words, sha256(coalesce(string_agg(CASE WHEN mv.length > 0 THEN coalesce(hex, '') || '0020' END, '' ORDER BY par, line, word), '')) AS codes, sum(new_font::INT)::BIGINT AS fonts, sum(new_matrix::INT)::BIGINT AS matrices
  FROM mv LEFT JOIN hx ON mv.text IS NOT DISTINCT FROM hx.text GROUP BY doc, page_idx"""
