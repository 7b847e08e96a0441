"""Page lists in XML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The schema is given, never inferred: a title such as T0 would become a time.
SCHEMA = "bookData struct<dpi:string>, pageData struct<page:array<struct<_leafNum:string,pageType:struct<_VALUE:string,_title:string,_level:string,_label:string>,addToAccessFormats:string,pageNumber:string,ppi:string>>>"


def scandata_pages(texts: DataFrame, key: str = "doc", column: str = "xml") -> DataFrame:
    """(key, book_dpi, idx, leaf_num, page_type, add_to_access, page_number, ppi); the text is parsed once."""
    book = texts.select(key, F.from_xml(F.col(column), SCHEMA, {"rowTag": "book"}).alias("b"))
    page = book.select(key, F.col("b.bookData.dpi").alias("book_dpi"), F.posexplode("b.pageData.page").alias("idx", "p"))
    return page.select(key, "book_dpi", "idx", F.col("p._leafNum").alias("leaf_num"), F.col("p.pageType").alias("page_type"), F.col("p.addToAccessFormats").alias("add_to_access"), F.col("p.pageNumber").alias("page_number"), F.col("p.ppi").alias("ppi"))


def read_scandata(spark: SparkSession, path: str) -> DataFrame:
    return scandata_pages(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("xml")), "path")


def book_xml(pages: DataFrame, dpi: DataFrame) -> DataFrame:
    """(doc, xml) of page lists, the inverse of scandata_pages; dpi: (doc, dpi)."""
    esc = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    tag = lambda name, c: F.coalesce(F.concat(F.lit(f"<{name}>"), esc(c), F.lit(f"</{name}>")), F.lit(""))
    t = F.col("page_type")
    attr = lambda n: F.coalesce(F.concat(F.lit(f' {n}="'), esc(t[f"_{n}"]), F.lit('"')), F.lit(""))
    one = F.concat(F.lit('<page leafNum="'), esc(F.coalesce("leaf_num", F.lit(""))), F.lit('"><pageType'), attr("title"), attr("level"), attr("label"), F.lit(">"), esc(F.coalesce(t["_VALUE"], F.lit(""))), F.lit("</pageType>"), tag("addToAccessFormats", F.col("add_to_access")), tag("pageNumber", F.col("page_number")), tag("ppi", F.col("ppi")), F.lit("</page>"))
    body = pages.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", one.alias("x")))), lambda q: q["x"]), "").alias("body"))
    return body.join(dpi, "doc", "left").select("doc", F.concat(F.lit("<book><bookData>"), tag("dpi", F.col("dpi")), F.lit("</bookData><pageData>"), F.col("body"), F.lit("</pageData></book>")).alias("xml"))
