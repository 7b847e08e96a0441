"""Repairs of misread words: in any size of corpus, in broken words and in figures."""

import random

from pyspark.sql import functions as F

from folio.llm import pages

WORDS = "the old baker sold a red boat near town while her clerk found some maps under an empty roof before winter and nobody knew why it was so late".split()


def ocr(spark, rows):
    out = [(doc, page, par, line, k, w) for doc, page, line, par, text in rows for k, w in enumerate(text.split())]
    return spark.createDataFrame(out, "doc long, page_idx int, par int, line int, word int, text string")


def body(rng, docs, put):
    """Pages of random lines, with the lines of put in their places."""
    return [(d, p, n, 1, put.get((d, p, n)) or " ".join(rng.choice(WORDS) for _ in range(9))) for d in range(1, docs + 1) for p in range(3) for n in range(1, 9)]


def test_repairs_do_not_depend_on_the_size(spark):
    sentence = "nobody knew why the old {} sold a red boat"
    put = {(d, p, 4): sentence.format("baker") for d in range(1, 9) for p in range(3)}
    put[2, 1, 4] = sentence.format("bauer")  # u for k is no usual confusion
    rows = ocr(spark, body(random.Random(31), 8, put))
    items = spark.createDataFrame([(0, "Some title")], "doc long, title string")
    one = {(r.doc, r.page_idx, r.line) for r in pages.page_noise(rows, items)[1].where("word = 'bauer'").collect()}
    assert one == {(2, 1, 4)}
    many = rows.crossJoin(spark.range(12).select(F.col("id").alias("copy"))).withColumn("doc", F.col("doc") + 100 * F.col("copy")).drop("copy")
    got = {(r.doc, r.page_idx, r.line) for r in pages.page_noise(many, items)[1].where("word = 'bauer'").collect()}
    assert got == {(2 + 100 * k, 1, 4) for k in range(12)}


def test_cyrillic_confusions():
    for misread, true in (("стлрый", "старый"), ("дадёкий", "далёкий"), ("пяистани", "пристани"), ("нлшёл", "нашёл"), ("щум", "шум")):
        assert pages.misread_cost(misread, true) == 0.5, misread


def test_broken_words_figures_and_pages(spark):
    """Misread words that are broken over pages, figures with letters, and paragraphs over a page's end come out mended."""
    rng = random.Random(32)
    rows = [(d, p, 0, n, k, w) for d in range(14) for p in range(3) for n in range(8) for k, w in enumerate(("nobody knew why the old baker sold a red boat" if n == 7 else " ".join(rng.choice(WORDS) for _ in range(9))).split())]
    for p, n, par, text in ((0, 0, 0, "nobody knew why the old Bakcr sold a red boat"), (0, 1, 0, "before winter and nobody knew why the old ba-"), (1, 0, 0, "kcr sold a red boat near town about l8o4 and"), (1, 1, 1, "Nobody knew.")):
        rows += [(50, p, par, n, k, w) for k, w in enumerate(text.split())]
    df = spark.createDataFrame(rows, "doc long, page_idx int, par int, line int, word int, text string")
    items = spark.createDataFrame([(0, "Some title")], "doc long, title string")
    got = [(r.first_page, r.last_page, r.text) for r in pages.item_paragraphs(df, items).where("doc = 50").orderBy("paragraph").collect()]
    assert [(a, b) for a, b, _ in got] == [(0, 1), (1, 1)] and got[1][2] == "Nobody knew."
    assert got[0][2].startswith("nobody knew why the old Baker sold a red boat before winter and nobody knew why the old baker sold a red boat near town") and got[0][2].endswith("1804 and")
    by_page = {(r.page_idx, r.par): r.text for r in pages.page_paragraphs(df, items).where("doc = 50").collect()}
    assert by_page[0, 0].endswith("the old baker") and by_page[1, 0].startswith("sold a red boat")


def test_exported_texts(spark):
    sentence = "nobody knew why the old baker sold a red boat near town while her clerk found some maps"
    texts = [(k, "\n".join([sentence] * 6), 1, 0) for k in range(6)]
    texts += [(7, "A HISTORY OF BOATS\nnobody knew why the old bakcr sold a red bo-\nat near town\n[12]\fA HISTORY OF BOATS\nwhile her clerk found some maps.\n\nNobody knew.", 1, 3), (8, None, 1, 0), (9, "", None, None), (10, " \n\f", 1, 0)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, item long, page_from int")
    items = spark.createDataFrame([(1, "A History of Boats")], "doc long, title string")
    got = {r.doc_id: r.text for r in pages.document_paragraphs(docs, items).collect()}
    assert got[7] == "nobody knew why the old baker sold a red boat near town while her clerk found some maps.\n\nNobody knew."
    assert set(got) == {*range(6), 7} and pages.document_paragraphs(docs.limit(0), items).count() == 0
