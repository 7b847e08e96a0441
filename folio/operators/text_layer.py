"""Operators on OCR words: admission of lines, boxes, and the hidden text layer of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import geometry as G
from folio.functions.text import utf16_hex

LEAST_CONFIDENCE = 20


def words_once(words: DataFrame) -> DataFrame:
    """words without repeated rows; of rows that differ the first by loaded_at (NULL last) and then by text stays."""
    keys = ["doc", "page_idx", "line", "word"]
    first = [F.col("loaded_at").isNull(), F.col("loaded_at")] if "loaded_at" in words.columns else []
    own = words.groupBy(*keys).agg(F.min_by(F.struct(*(c for c in words.columns if c not in keys)), F.struct(*first, F.coalesce("text", F.lit("")))).alias("_own"))
    return own.select(*keys, "_own.*").select(*words.columns)


def line_confidence(words: DataFrame, also: list[Column] | None = None) -> DataFrame:
    """(doc, page_idx, line, words, confidence, admitted) and what is to be summed up also: mean confidence (0 where there is none) and admission to the mask."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), " ")
    own = words.groupBy("doc", "page_idx", "line").agg(F.count("*").cast("int").alias("words"), F.coalesce(F.avg("conf"), F.lit(0.0)).alias("confidence"), F.trim(text).alias("line_text"), *(also or []))
    return own.withColumn("admitted", (F.col("confidence") >= LEAST_CONFIDENCE) & (F.col("line_text") != ""))


def scaled_box(box: Column, downsample: int | None) -> Column:
    """x0, y0, x1, y1 of a box as whole numbers, cut off, after division."""
    by = downsample or 1
    return F.struct(*((box[c] / by).cast("int").alias(c) for c in ("x0", "y0", "x1", "y1")))


def box_status(box: Column, width: Column, height: Column) -> Column:
    """degenerate before inverted before outside, else ok."""
    return (
        F.when((box["x0"] == box["x1"]) | (box["y0"] == box["y1"]), "degenerate")
        .when((box["x0"] > box["x1"]) | (box["y0"] > box["y1"]), "inverted")
        .when((box["x0"] < 0) | (box["y0"] < 0) | (box["x1"] > width) | (box["y1"] > height), "outside")
        .otherwise("ok")
    )


def admitted_paragraphs(words: DataFrame) -> DataFrame:
    """(doc, page_idx, par) of paragraphs with any visible character."""
    return words.groupBy("doc", "page_idx", "par").agg(F.bool_or(F.trim(F.coalesce("text", F.lit(""))) != "").alias("any")).where("any").drop("any")


def placed_words(words: DataFrame, pages: DataFrame) -> DataFrame:
    """words with where and how the text layer writes them; pages: (doc, page_idx, ppi, height)."""
    j = words.join(pages, ["doc", "page_idx"])
    box, base, ppi = F.col("line_bbox"), F.col("baseline"), F.col("ppi")
    x1, x2 = box["x0"], box["x1"]
    y1 = box["y1"] + base["const"]
    y2 = y1 + base["slope"] * (x2 - x1)
    c1, c2 = G.clip_baseline(ppi, x1, y1, x2, y2)
    j = j.withColumn("lx1", x1).withColumn("lx2", x2).withColumn("ly1", c1).withColumn("ly2", c2)
    first = Window.partitionBy("doc", "page_idx", "line").orderBy("word")
    direction = F.first("direction").over(first.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    j = j.withColumn("dir", F.when(direction.isNull() | direction.isin("LTR", "RTL"), direction).when(direction == "unspecified", "LTR").otherwise(F.raise_error(F.concat(F.lit("unknown direction: "), direction)).cast("string")))
    line = {k: F.col(f"l{k}") for k in ("x1", "y1", "x2", "y2")}
    word = {k: F.col("bbox")[k] for k in ("x0", "y0", "x1", "y1")}
    foot = G.word_baseline(F.col("dir") == "RTL", ppi, F.col("height"), word, line)
    j = j.withColumns(foot)
    size = G.font_size(F.col("fontsize"), F.col("ly1"), F.col("ly2"))
    j = j.withColumn("size", size)
    return j.withColumn("stretch", G.stretch(F.col("length"), F.col("size"), F.coalesce("text", F.lit("")))).withColumns(G.text_matrix(F.col("dir") == "RTL", *(F.col(f"l{k}") for k in ("x1", "y1", "x2", "y2"))))


def with_moves(placed: DataFrame) -> DataFrame:
    """placed words with their step from the word before in the paragraph and what changes there."""
    w = Window.partitionBy("doc", "page_idx", "par").orderBy("line", "word")
    return placed.withColumn("dx", F.col("x") - F.lag("x").over(w)).withColumn("dy", F.col("y") - F.lag("y").over(w)).withColumn("new_font", F.coalesce(F.lag("size").over(w) != F.col("size"), F.lit(True))).withColumn("new_matrix", F.coalesce(F.lag("dir").over(w) != F.col("dir"), F.lit(True)))


def page_streams(placed: DataFrame, visible: bool = False) -> DataFrame:
    """(doc, page_idx, content): the text operators of each page."""
    w = Window.partitionBy("doc", "page_idx", "par").orderBy("line", "word")
    j = with_moves(placed)
    # a step is written in the axes of the last matrix
    at = F.when(F.col("new_matrix"), F.struct("a", "b", "c", "d"))
    j = j.withColumn("m", F.last(at, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    num = lambda x: F.format_string("%.8f", G.prec(x))
    m = F.col("m")
    matrix = F.concat(*(F.concat(F.lit(" "), num(F.col(c))) for c in ("a", "b", "c", "d", "x", "y")), F.lit(" Tm "))
    move = F.concat(F.lit(" "), num(F.col("dx") * m["a"] + F.col("dy") * m["b"]), F.lit(" "), num(F.col("dx") * m["c"] + F.col("dy") * m["d"]), F.lit(" Td "))
    font = F.when(F.col("new_font"), F.concat(F.lit("/f-0-0 "), F.format_string("%.3f", "size"), F.lit(" Tf "))).otherwise("")
    show = F.when(F.col("length") > 0, F.concat(F.format_string("%.8f", "stretch"), F.lit(" Tz [ <"), utf16_hex(F.coalesce("text", F.lit(""))), F.lit("0020> ] TJ"))).otherwise("")
    piece = F.concat(F.when(F.col("new_matrix"), matrix).otherwise(move), font, show)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "word", piece.alias("piece")))), lambda x: x["piece"]), " \n")
    blocks = j.groupBy("doc", "page_idx", "par").agg(F.concat(F.lit("BT\n0 Tr" if visible else "BT\n3 Tr"), body, F.lit(" \nET\n")).alias("block"))
    return blocks.groupBy("doc", "page_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("par", "block"))), lambda x: x["block"]), "").alias("content"))
