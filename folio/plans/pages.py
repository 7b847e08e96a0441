"""Queries on page lists, labels, resolutions and page sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import geometry as G
from folio.functions import labels as L
from folio.operators import geometry as OG
from folio.operators import scandata as S


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def pages(spark: SparkSession, d: str) -> DataFrame:
    return S.pages_once(read(spark, d, "scandata_pages"))


def series(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("doc", "idx", F.col("page_number").alias("label"))


PAGES_SQL = "p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc, idx ORDER BY loaded_at DESC NULLS LAST) AS rk FROM scandata_pages) WHERE rk = 1)"
ROMAN_SQL = "regexp_full_match(upper({0}), 'M{{0,4}}(CM|CD|D?C{{0,3}})(XC|XL|L?X{{0,3}})(IX|IV|V?I{{0,3}})') AND length({0}) > 0"


def kind_sql(x: str) -> str:
    roman = ROMAN_SQL.format(x)
    return f"""CASE WHEN {x} IS NULL THEN 0 WHEN regexp_full_match({x}, '[0-9]+') THEN 1
      WHEN regexp_full_match({x}, '[a-z]+') AND {roman} THEN 2 WHEN regexp_full_match({x}, '[A-Z]+') AND {roman} THEN 3
      WHEN regexp_full_match({x}, '[A-Z]+') THEN 4 WHEN regexp_full_match({x}, '[a-z]+') THEN 5 ELSE 0 END"""


def roman_sql(x: str) -> str:
    """The numeral's letters one by one, each subtracted where a larger one follows."""
    val = "[1,5,10,50,100,500,1000][list_position(['I','V','X','L','C','D','M'], {0})]"
    a = val.format(f"upper({x})[i:i]")
    b = f"coalesce({val.format(f'upper({x})[i+1:i+1]')}, 0)"
    return f"list_sum(list_transform(range(1, length({x}) + 1), lambda i: CASE WHEN {a} < {b} THEN -{a} ELSE {a} END))"


CLASSIFIED_SQL = f"""{PAGES_SQL}, s AS (SELECT doc, idx, page_number AS label FROM p),
a AS (SELECT *, {kind_sql('label')} AS kind0, (SELECT t.label FROM s t WHERE t.doc = s.doc AND t.idx > s.idx AND t.label IS NOT NULL ORDER BY t.idx LIMIT 1) AS nxt FROM s),
b AS (SELECT *, {kind_sql('nxt')} AS nk FROM a),
c AS (SELECT *, CASE WHEN kind0 = 3 AND nk = 4 THEN 4 WHEN kind0 = 2 AND nk = 5 THEN 5 ELSE kind0 END AS kind1 FROM b),
e AS (SELECT *, kind1 IN (4, 5) AS letters, (nxt IS NULL OR (length(label) = 1 AND length(nxt) = 1 AND ascii(nxt) = ascii(label) + 1) OR nk = kind1) AS stands,
   (kind1 = 4 AND nk = 2 OR kind1 = 5 AND nk = 3) AS mixed FROM c),
f AS (SELECT doc, idx, label, nxt, kind0, CASE WHEN NOT letters OR stands THEN kind1 ELSE 0 END AS kind,
   NOT ((label IS NOT NULL AND kind0 = 0) OR (letters AND NOT stands AND mixed)) AS ok FROM e),
g AS (SELECT *, CASE WHEN kind = 1 THEN try_cast(label AS INT) WHEN kind IN (2, 3) THEN {roman_sql('label')}::INT
   WHEN kind IN (4, 5) THEN ascii(upper(label)) - 64 + 26 * (length(label) - 1) END AS value FROM f)"""
RANGES_SQL = f"""{CLASSIFIED_SQL},
h AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN 0 WHEN kind <> coalesce(lag(kind) OVER w, 0) THEN 1
   WHEN kind <> 0 AND lag(kind) OVER w <> 0 AND value <> lag(value) OVER w + 1 THEN 1 ELSE 0 END AS br FROM g WINDOW w AS (PARTITION BY doc ORDER BY idx)),
k AS (SELECT *, sum(br) OVER (PARTITION BY doc ORDER BY idx) AS run, min(ok::INT) OVER (PARTITION BY doc) = 1 AS all_ok FROM h),
r AS (SELECT doc, run, min(idx) AS start, min(kind) AS kind, count(*)::INT AS n, bool_and(all_ok) AS all_ok, first(label ORDER BY idx) AS first_label, first(value ORDER BY idx) AS first_value, last(value ORDER BY idx) AS last_value FROM k GROUP BY doc, run)"""
NAME_SQL = "['invalid','arabic','roman-lower','roman-upper','alpha-upper','alpha-lower'][kind + 1]"
SKIP_SQL = "coalesce(add_to_access = 'false', false)"
INT_SQL = "CASE WHEN regexp_full_match(trim({0}), '[+-]?[0-9]{{1,9}}') THEN try_cast(trim({0}) AS INT) END"
OUT_SQL = f"{PAGES_SQL}, o AS (SELECT *, {SKIP_SQL} AS skipped, idx - coalesce(sum(({SKIP_SQL})::INT) OVER (PARTITION BY doc ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS out_idx FROM p)"
GUESS_SQL = "list_sort(list_transform([1,2,3,4,5], lambda k: {{'o': abs({0} / 8.27 - [72,96,150,300,600][k]) + abs({1} / 11.69 - [72,96,150,300,600][k]), 'k': k}}))[1].k"


def page_labels(spark, d):
    return S.label_bounds(series(spark, d))


def label_values(spark, d):
    """The labels and values of each run of labels as lists."""
    r = S.label_ranges(series(spark, d))
    return r.select("doc", "start", "kind", F.array_join("values", ",", "-").alias("labels"), F.array_join(r.numbers.cast("array<string>"), ",", "-").alias("numbers"))


def label_types(spark, d):
    return S.classified(series(spark, d)).select("doc", "idx", "label", "kind0", "kind", "ok")


def label_values_roman(spark, d):
    s = series(spark, d).withColumn("kind", L.label_kind(F.col("label")))
    return s.where(F.col("kind").isin(L.ROMAN_LOWER, L.ROMAN_UPPER)).select("doc", "idx", "label", L.roman_value(F.col("label")).alias("value"))


def label_values_alpha(spark, d):
    s = series(spark, d).where(F.col("label").rlike("^([A-Z]+|[a-z]+)$"))
    return s.select("doc", "idx", "label", L.alpha_value(F.col("label")).alias("value"))


def label_lookahead(spark, d):
    return S.classified(series(spark, d)).select("doc", "idx", F.col("next").alias("next_label"))


def label_pdf_nums(spark, d):
    return S.label_dictionary(S.label_bounds(series(spark, d)))


def skip_pages(spark, d):
    return pages(spark, d).where(S.is_skipped(F.col("add_to_access"))).select("doc", "idx")


def accessible_numbers(spark, d):
    return S.page_resolutions(pages(spark, d)).select("doc", "idx", "page_number")


def accessible_dpi(spark, d):
    return S.page_resolutions(pages(spark, d)).select("doc", "idx", "ppi", "ppi_int")


def document_dpi(spark, d):
    return read(spark, d, "items").select("doc", G.whole_number(F.col("dpi")).alias("dpi"))


def output_index(spark, d):
    return S.output_index(pages(spark, d)).select("doc", "idx", "skipped", "out_idx")


def toc(spark, d):
    return S.table_of_contents(pages(spark, d))


def limit_pages(spark, d):
    return S.first_kept(pages(spark, d), 5).select("doc", "idx", "out_idx")


def limit_pages_compatible(spark, d):
    return S.first_kept(pages(spark, d), 5, compatible=True).select("doc", "idx", "out_idx")


def hq_pages(spark, d):
    counts = pages(spark, d).groupBy("doc").agg(F.count("*").cast("int").alias("pages"))
    return S.hq_pages(counts, "1,2,-1,-4,0,40")


def guess_dpi(spark, d):
    return read(spark, d, "page_geometry").select("doc", "page_idx", G.guess_dpi(F.col("imwidth"), F.col("imheight")).alias("guess"))


def dpi_precedence(spark, d):
    return OG.with_document(read(spark, d, "page_geometry"), read(spark, d, "items")).select("doc", "page_idx", "page_dpi_int", "doc_dpi", OG.resolution().alias("used_dpi"))


def page_size(spark, d):
    sized = OG.page_sizes(OG.with_document(read(spark, d, "page_geometry"), read(spark, d, "items")))
    r = lambda c: F.floor(F.col(c) * 1000 + 0.5).cast("long").alias(c)
    return sized.select("doc", "page_idx", r("width"), r("height"), r("ppi"), r("font_scale"), F.array_join("warnings", ",").alias("warnings"))


def page_size_validity(spark, d):
    g = read(spark, d, "page_geometry").where("dpi is not null")
    return g.select("doc", "page_idx", G.valid_width(F.col("imwidth") / (F.col("dpi") / 72)).alias("valid"))


def image_pass_dpi(spark, d):
    return OG.image_pass_resolution(read(spark, d, "page_geometry"), pages(spark, d)).select("doc", "page_idx", "use_dpi")


def anti_join_skips(spark, d):
    return OG.without_skipped(read(spark, d, "page_geometry"), pages(spark, d)).select("doc", "page_idx")


def join_image_by_index(spark, d):
    """Pages with the images that stand at their own position, the first of each page; none is an error elsewhere."""
    first = read(spark, d, "page_images").where("ord = 0").select("doc", F.col("page").alias("idx"), "xref", "width", "height")
    return pages(spark, d).select("doc", "idx").join(first, ["doc", "idx"], "left")


def join_dpi_left(spark, d):
    """Kept pages with the resolution at their number among the kept ones."""
    kept = S.output_index(pages(spark, d)).where(~F.col("skipped"))
    dpi = kept.select("doc", F.col("out_idx"), G.whole_number(F.col("ppi")).alias("ppi"))
    return kept.select("doc", "idx", "out_idx").join(dpi, ["doc", "out_idx"], "left")


def join_hq_left(spark, d):
    hq = hq_pages(spark, d).withColumn("hq", F.lit(True))
    kept = S.output_index(pages(spark, d)).where(~F.col("skipped")).select("doc", F.col("out_idx").alias("page_idx"))
    return kept.join(hq, ["doc", "page_idx"], "left").withColumn("hq", F.coalesce("hq", F.lit(False)))


def zip_inner(spark, d):
    """Pages and geometry position by position, as far as both go."""
    return pages(spark, d).select("doc", "idx", "leaf_num").join(read(spark, d, "page_geometry").select("doc", F.col("page_idx").alias("idx"), "imwidth"), ["doc", "idx"])


QUERIES = {f.__name__: f for f in (page_labels, label_values, label_types, label_values_roman, label_values_alpha, label_lookahead, label_pdf_nums, skip_pages, accessible_numbers, accessible_dpi, document_dpi, output_index, toc, limit_pages, limit_pages_compatible, hq_pages, guess_dpi, dpi_precedence, page_size, page_size_validity, image_pass_dpi, anti_join_skips, join_image_by_index, join_dpi_left, join_hq_left, zip_inner)}

GEO_SQL = f"""q AS (SELECT g.*, {INT_SQL.format('g.page_dpi')} AS page_dpi_int, {INT_SQL.format('i.dpi')} AS doc_dpi FROM page_geometry g LEFT JOIN items i ON g.doc = i.doc),
u AS (SELECT *, [72,96,150,300,600][{GUESS_SQL.format('imwidth', 'imheight')}] AS guess FROM q),
v AS (SELECT *, coalesce(nullif(page_dpi_int, 0), nullif(doc_dpi, 0), nullif(dpi, 0), guess) AS used_dpi, coalesce(nullif(doc_dpi, 0), nullif(dpi, 0)) AS item_dpi FROM u)"""
HQ_SQL = f"{PAGES_SQL}, n AS (SELECT doc, count(*) AS pages FROM p GROUP BY doc), hq AS (SELECT DISTINCT doc, (CASE WHEN i > 0 THEN i - 1 WHEN i = 0 THEN 0 ELSE i + pages END)::INT AS page_idx FROM n, (SELECT unnest([1, 2, -1, -4, 0, 40]) AS i) WHERE CASE WHEN i > 0 THEN i <= pages ELSE abs(i) < pages END)"
ORACLES = {
    "page_labels": f"WITH {RANGES_SQL} SELECT doc, start, kind, {NAME_SQL} AS kind_name, n, first_label, first_value, last_value, all_ok FROM r",
    "label_values": f"WITH {RANGES_SQL}, z AS (SELECT doc, run, string_agg(coalesce(label, '-'), ',' ORDER BY idx) AS labels, string_agg(coalesce(value::VARCHAR, '-'), ',' ORDER BY idx) AS numbers FROM k GROUP BY doc, run) SELECT r.doc, start, kind, labels, numbers FROM r JOIN z ON r.doc = z.doc AND r.run = z.run",
    "label_types": f"WITH {CLASSIFIED_SQL} SELECT doc, idx, label, kind0, kind, ok FROM g",
    "label_values_roman": f"WITH {PAGES_SQL}, s AS (SELECT doc, idx, page_number AS label, {kind_sql('page_number')} AS kind FROM p) SELECT doc, idx, label, {roman_sql('label')}::INT AS value FROM s WHERE kind IN (2, 3)",
    "label_values_alpha": f"WITH {PAGES_SQL} SELECT doc, idx, page_number AS label, ascii(upper(page_number)) - 64 + 26 * (length(page_number) - 1)::INT AS value FROM p WHERE regexp_full_match(page_number, '[A-Z]+|[a-z]+')",
    "label_lookahead": f"WITH {CLASSIFIED_SQL} SELECT doc, idx, nxt AS next_label FROM g",
    "label_pdf_nums": f"WITH {RANGES_SQL} SELECT doc, string_agg(start::VARCHAR || CASE WHEN kind = 0 THEN ' << >>' ELSE ' << /S /' || ['','D','r','R','A','a'][kind + 1] || ' /St ' || first_value::VARCHAR || ' >>' END, ' ' ORDER BY start) AS nums FROM r GROUP BY doc",
    "skip_pages": f"WITH {PAGES_SQL} SELECT doc, idx FROM p WHERE {SKIP_SQL}",
    "accessible_numbers": f"WITH {PAGES_SQL} SELECT doc, idx, page_number FROM p WHERE NOT {SKIP_SQL}",
    "accessible_dpi": f"WITH {PAGES_SQL} SELECT doc, idx, ppi, {INT_SQL.format('ppi')} AS ppi_int FROM p WHERE NOT {SKIP_SQL}",
    "document_dpi": f"SELECT doc, {INT_SQL.format('dpi')} AS dpi FROM items",
    "output_index": f"WITH {OUT_SQL} SELECT doc, idx, skipped, out_idx FROM o",
    "toc": f"WITH {PAGES_SQL}, t AS (SELECT *, coalesce(sum((NOT {SKIP_SQL})::INT) OVER (PARTITION BY doc ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS accessible_page FROM p) SELECT doc, idx, page_type._title AS title, coalesce({INT_SQL.format('page_type._level')}, 1) AS level, page_type._label AS label, leaf_num AS leaf, accessible_page FROM t WHERE page_type._title IS NOT NULL",
    "limit_pages": f"WITH {OUT_SQL} SELECT doc, idx, out_idx FROM o WHERE NOT skipped AND out_idx < 5",
    "limit_pages_compatible": f"WITH {OUT_SQL} SELECT doc, idx, out_idx FROM o WHERE NOT skipped AND out_idx < 4",
    "hq_pages": f"WITH {HQ_SQL} SELECT doc, page_idx FROM hq",
    "guess_dpi": f"SELECT doc, page_idx, [72,96,150,300,600][{GUESS_SQL.format('imwidth', 'imheight')}] AS guess FROM page_geometry",
    "dpi_precedence": f"WITH {GEO_SQL} SELECT doc, page_idx, page_dpi_int, doc_dpi, used_dpi FROM v",
    "page_size": f"""WITH {GEO_SQL},
      w1 AS (SELECT *, imwidth / (used_dpi / 72) AS a FROM v),
      w2 AS (SELECT *, a <= 3 OR a >= 14400 AS bad, CASE WHEN (a <= 3 OR a >= 14400) AND nullif(page_dpi_int, 0) IS NOT NULL AND item_dpi IS NOT NULL THEN imwidth / (item_dpi / 72) ELSE a END AS b FROM w1),
      w3 AS (SELECT *, CASE WHEN b <= 3 OR b >= 14400 THEN imwidth / (guess / 72) ELSE b END AS c FROM w2),
      w4 AS (SELECT *, CASE WHEN c <= 3 OR c >= 14400 THEN 4.0 ELSE c END AS width FROM w3),
      w5 AS (SELECT *, imheight * width / nullif(imwidth, 0) AS height, 72 * imwidth / width AS ppi FROM w4)
      SELECT doc, page_idx, floor(width * 1000 + 0.5)::BIGINT AS width, floor(height * 1000 + 0.5)::BIGINT AS height, floor(ppi * 1000 + 0.5)::BIGINT AS ppi,
        floor(coalesce(hocr_dpi, 72) / nullif(ppi, 0) * 1000 + 0.5)::BIGINT AS font_scale, CASE WHEN bad THEN 'invalid-page-size' ELSE '' END AS warnings FROM w5""",
    "page_size_validity": "SELECT doc, page_idx, imwidth / (dpi / 72) > 3 AND imwidth / (dpi / 72) < 14400 AS valid FROM page_geometry WHERE dpi IS NOT NULL",
    "image_pass_dpi": f"WITH {OUT_SQL}, k AS (SELECT doc, out_idx, {INT_SQL.format('ppi')} AS ppi FROM o WHERE NOT skipped) SELECT g.doc, g.page_idx, coalesce(k.ppi, CASE WHEN o.doc IS NOT NULL THEN g.hocr_dpi END, g.dpi) AS use_dpi FROM page_geometry g LEFT JOIN o ON g.doc = o.doc AND g.page_idx = o.idx LEFT JOIN k ON o.doc = k.doc AND o.out_idx = k.out_idx WHERE NOT coalesce(o.skipped, false)",
    "anti_join_skips": f"WITH {PAGES_SQL} SELECT doc, page_idx FROM page_geometry g WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.doc = g.doc AND p.idx = g.page_idx AND {SKIP_SQL})",
    "join_image_by_index": f"WITH {PAGES_SQL} SELECT p.doc, p.idx, i.xref, i.width, i.height FROM p LEFT JOIN page_images i ON p.doc = i.doc AND p.idx = i.page AND i.ord = 0",
    "join_dpi_left": f"WITH {OUT_SQL} SELECT doc, idx, out_idx, {INT_SQL.format('ppi')} AS ppi FROM o WHERE NOT skipped",
    "join_hq_left": f"WITH {HQ_SQL}, o AS (SELECT *, {SKIP_SQL} AS skipped, idx - coalesce(sum(({SKIP_SQL})::INT) OVER (PARTITION BY doc ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS out_idx FROM p) SELECT o.doc, o.out_idx AS page_idx, hq.doc IS NOT NULL AS hq FROM o LEFT JOIN hq ON o.doc = hq.doc AND o.out_idx = hq.page_idx WHERE NOT o.skipped",
    "zip_inner": f"WITH {PAGES_SQL} SELECT p.doc, p.idx, p.leaf_num, g.imwidth FROM p JOIN page_geometry g ON p.doc = g.doc AND p.idx = g.page_idx",
}
