"""Words travel once, as blocks of their page; hOCR read as XML gives what the HTML parser gives."""

import datetime

import __spark_entry__ as entry
from folio.operators.page_words import page_lines
from folio.operators.text_layer import words_once
from folio.sources import hocr


def test_one_exchange_of_blocks(spark, data):
    plan = entry.queries()["hocr_words"](spark, data)._jdf.queryExecution().sparkPlan().toString()
    whole = entry.queries()["hocr_words"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert whole.count("Exchange ") == 1 and "min_by" not in plan


def test_lines_of_odd_words(spark):
    """Repeated rows, in place and far away, NULLs in what is not a key, pages without a size and sizes without words."""
    box, at = (1.0, 2.5, 30.25, 4.0), [datetime.datetime(2024, 1, d) for d in (1, 2, 3)]
    rows = [(1, p, n, w, f"{p} {n} {w}", 50.0 + w, box, at[1]) for p in (3, 1, 2) for n in (2, 0) for w in (1, 0, 4)]
    rows += [(1, 1, 0, 1, "later", 1.0, box, at[2]), (1, 1, 0, 0, "earlier", None, None, at[0]), (1, 2, 2, 4, "never", 1.0, box, None), (2, 1, 0, 0, None, None, None, None), (2, 1, 0, 0, "text", 3.0, box, None), (9, 1, 0, 0, "no size", 3.0, box, at[0])]
    kind = "struct<x0:double,y0:double,x1:double,y1:double>"
    words = spark.createDataFrame([(d, p, n, w, t, c, b, 8.0, "LTR", b, (0.1, c), x) for d, p, n, w, t, c, b, x in rows], f"doc long, page_idx int, line int, word int, text string, conf double, bbox {kind}, fontsize double, direction string, line_bbox {kind}, baseline struct<slope:double,const:double>, loaded_at timestamp")
    sizes = spark.createDataFrame([(d, p, 100 * p) for d, p in ((1, 1), (1, 2), (1, 3), (2, 1), (5, 1))], "doc long, page_idx int, imwidth int")
    got = {(r.doc, r.page_idx): (r.imwidth, [[(w.text, w.conf, w.bbox and w.bbox.x0) for w in x.words] for x in r.lines]) for r in page_lines(words.repartition(5), sizes, ["imwidth"]).collect()}
    want: dict = {}
    for r in sorted(words_once(words).where("doc != 9").collect(), key=lambda r: (r.line, r.word)):
        want.setdefault((r.doc, r.page_idx), (100 * r.page_idx, {}))[1].setdefault(r.line, []).append((r.text, r.conf, r.bbox and r.bbox.x0))
    assert got == {k: (w, list(x.values())) for k, (w, x) in want.items()}


def test_xml_and_html_readings_agree(monkeypatch):
    page = '<div class="ocr_page" title="bbox 0 0 {w} 200; scan_res 300 300"><p class="ocr_par" dir="rtl"><span class="ocr_line" title="bbox 1 2 3 4; baseline 0.1 -2"><span class="ocrx_word" title="bbox 1 2 3 4; x_wconf 90.5; x_fsize 9">a &amp; <b>ü</b>&lt;</span> <SPAN CLASS="ocrx_word x" TITLE="x_fsize 7;bbox 5 6">z</SPAN><br/></span></p></div>'
    texts = [page.format(w=100), f"<html><body>{page.format(w=1)}{page.format(w=2)}</body></html>", page.format(w=3) + page.format(w=4), page[:-10], page.replace("ü", "&nbsp;&#128;\r"), '<div class="ocr_page" title="bbox 0 0 9 9"><span class="ocrx_word">x</span></div>', "", "no page"]
    fast = [hocr.parse(t) for t in texts]
    read = hocr._Reader

    def slow(t):
        r = read()
        r.feed(t)
        r.close()
        return r

    monkeypatch.setattr(hocr, "_read", slow)
    assert fast == [hocr.parse(t) for t in texts] and len(fast[0]) == 2 and len(fast[1]) == 4
