"""The queries of this package: name to function of a session and the folder of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .languages import document_languages, language_segments, unnamed_languages
from .leaks import leaked, without_leaks
from .lines import repeated_lines, without_repeated_lines
from .packing import pack_texts
from .pages import document_paragraphs, item_paragraphs, page_noise, page_paragraphs
from .pieces import split_texts
from .quality import quality, unnatural_texts
from .sentences import sentence_model, sentence_units
from .util import spread, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines(table(spark, d, "documents")).select("doc_id", "line_no")


def p1_clean(spark: SparkSession, d: str) -> DataFrame:
    return without_repeated_lines(table(spark, d, "documents")).select("doc_id", "text")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return page_noise(table(spark, d, "ocr_words"), table(spark, d, "items"))[0]


def p2_repairs(spark: SparkSession, d: str) -> DataFrame:
    """Misread words and figures with what they stand for."""
    return page_noise(table(spark, d, "ocr_words"), table(spark, d, "items"))[1]


def p2_text(spark: SparkSession, d: str) -> DataFrame:
    """Readable paragraphs of each page."""
    return page_paragraphs(table(spark, d, "ocr_words"), table(spark, d, "items"))


def p2_items(spark: SparkSession, d: str) -> DataFrame:
    """Readable paragraphs of each item, over the ends of pages."""
    return item_paragraphs(table(spark, d, "ocr_words"), table(spark, d, "items"))


def p2_documents(spark: SparkSession, d: str) -> DataFrame:
    """The exported texts as readable paragraphs."""
    return document_paragraphs(table(spark, d, "documents"), table(spark, d, "items"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return unnamed_languages(language_segments(table(spark, d, "documents"), table(spark, d, "languages")))


def p3_segments(spark: SparkSession, d: str) -> DataFrame:
    return language_segments(table(spark, d, "documents"), table(spark, d, "languages"))


def p3_documents(spark: SparkSession, d: str) -> DataFrame:
    """Each document's language with its share and confidence."""
    return document_languages(p3_segments(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return unnatural_texts(quality(table(spark, d, "documents"), table(spark, d, "languages"))).distinct()


def p4_stats(spark: SparkSession, d: str) -> DataFrame:
    """Every document's statistics, distance from the prose of its language and contributions."""
    return quality(table(spark, d, "documents"), table(spark, d, "languages"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    proof = docs.join(table(spark, d, "proof_docs").select("doc_id"), "doc_id", "left_semi")
    return sentence_units(proof, sentence_model(docs)).select("doc_id", "end_pos").distinct()


def p5_units(spark: SparkSession, d: str) -> DataFrame:
    """The sentences of all documents."""
    docs = table(spark, d, "documents")
    return sentence_units(spread(docs.select("doc_id", "text")), sentence_model(docs))


def _limits(spark: SparkSession, d: str, purpose: str) -> list[tuple[int, int]]:
    rows = table(spark, d, "size_limits").where(F.col("purpose") == purpose).select("capacity", "overlap").distinct().collect()  # a small fixed table
    return sorted((r[0], r[1] or 0) for r in rows if r[0])


def p6_packing(spark: SparkSession, d: str) -> DataFrame:
    return pack_texts(table(spark, d, "documents"), [c for c, _ in _limits(spark, d, "container")])


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """Share of the containers' room that is used."""
    load = p6_packing(spark, d).groupBy("capacity", "container").agg(F.sum("tokens").alias("load"), F.count("*").alias("items"))
    return load.groupBy("capacity").agg(F.count("*").alias("containers"), F.sum("items").alias("items"), F.max("load").alias("fullest"), (F.sum("load") / (F.col("capacity") * F.count("*"))).alias("used"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id").distinct()


def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    """The documents that held test passages, without them."""
    docs = table(spark, d, "documents")
    leaks = leaked(docs, table(spark, d, "eval_items")).persist()
    return without_leaks(docs.join(leaks.select("doc_id").distinct(), "doc_id", "left_semi"), leaks).select("doc_id", "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = split_texts(table(spark, d, "documents"), 4096, 128, only_oversized=True)
    return pieces.where("piece_no = 1").select("doc_id").distinct()


def p8_pieces(spark: SparkSession, d: str) -> DataFrame:
    docs, out = table(spark, d, "documents"), None
    for capacity, overlap in _limits(spark, d, "piece"):
        one = split_texts(docs, capacity, overlap).withColumn("capacity", F.lit(capacity))
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {f.__name__: f for f in (p1_found, p1_clean, p2_found, p2_repairs, p2_text, p2_items, p2_documents, p3_found, p3_segments, p3_documents, p4_found, p4_stats, p5_found, p5_units, p6_packing, p6_fill, p7_found, p7_clean, p8_found, p8_pieces)}
ORACLES: dict[str, str] = {}
