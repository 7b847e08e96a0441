"""Operators on the page list of scanned items: which pages are kept, their numbers, labels and contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import labels as L
from folio.functions.geometry import whole_number
from folio.operators.sequence import with_context


def latest(rows: DataFrame, keys: list[str], by: str, also: list[Column] | None = None) -> DataFrame:
    """One row of each key, the latest loaded; ties go to the first by ``also``."""
    order = Window.partitionBy(*keys).orderBy(F.col(by).desc_nulls_last(), *(also or []))
    return rows.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def pages_once(scandata: DataFrame) -> DataFrame:
    return latest(scandata, ["doc", "idx"], "loaded_at")


def is_skipped(flag: Column) -> Column:
    """Only the exact text false takes a page out; a missing flag keeps it."""
    return F.coalesce(flag == "false", F.lit(False))


def output_index(pages: DataFrame) -> DataFrame:
    """pages with skipped and out_idx, the page's number among those kept."""
    skipped = pages.withColumn("skipped", is_skipped(F.col("add_to_access")))
    counted = with_context(skipped, ["doc"], "idx", before={"_out": F.col("skipped").cast("int")})
    return counted.withColumn("out_idx", (F.col("idx") - F.col("_out")).cast("int")).drop("_out")


def first_kept(pages: DataFrame, n: int, compatible: bool = False) -> DataFrame:
    """The first n kept pages of each item; the compatible form gives n - 1."""
    return output_index(pages).where(~F.col("skipped") & (F.col("out_idx") < (n - 1 if compatible else n)))


def page_resolutions(pages: DataFrame) -> DataFrame:
    return pages.where(~is_skipped(F.col("add_to_access"))).select("doc", "idx", "page_number", "ppi", whole_number(F.col("ppi")).alias("ppi_int"))


def hq_pages(page_counts: DataFrame, spec: str) -> DataFrame:
    """(doc, page_idx) of signed numbers from 1: i counts from the start, -i from the end; beyond the pages none.

    0 is the first page, and the negative of the number of pages is beyond it.
    """
    i = F.explode(F.transform(F.split(F.lit(spec), ","), lambda x: F.trim(x).cast("int")))
    at = F.when(F.col("i") > 0, F.col("i") - 1).when(F.col("i") == 0, 0).otherwise(F.col("i") + F.col("pages"))
    inside = F.when(F.col("i") > 0, F.col("i") <= F.col("pages")).otherwise(F.abs("i") < F.col("pages"))
    return page_counts.withColumn("i", i).where(inside).select("doc", at.cast("int").alias("page_idx")).distinct()


def table_of_contents(pages: DataFrame) -> DataFrame:
    """Titled pages with their level (1 where none is given) and the number of kept pages before them."""
    kept = (~is_skipped(F.col("add_to_access"))).cast("int")
    numbered = with_context(pages, ["doc"], "idx", before={"kept_before": kept}).withColumn("accessible_page", F.col("kept_before").cast("int"))
    t = F.col("page_type")
    return numbered.where(t["_title"].isNotNull()).select("doc", "idx", t["_title"].alias("title"), F.coalesce(whole_number(t["_level"]), F.lit(1)).alias("level"), t["_label"].alias("label"), F.col("leaf_num").alias("leaf"), "accessible_page")


def _judged(label: Column, following: Column, strict: bool) -> dict[str, Column]:
    """kind0, next_kind, kind, value and ok of a label before the next one that is given."""
    k0, nk = L.label_kind(label), L.label_kind(following)
    k1 = F.when((k0 == L.ROMAN_UPPER) & (nk == L.ALPHA_UPPER), L.ALPHA_UPPER).when((k0 == L.ROMAN_LOWER) & (nk == L.ALPHA_LOWER), L.ALPHA_LOWER).otherwise(k0)
    successor = (F.length(label) == 1) & (F.length(following) == 1) & (F.ascii(following) == F.ascii(label) + 1)
    mixed = ((k1 == L.ALPHA_UPPER) & (nk == L.ROMAN_LOWER)) | ((k1 == L.ALPHA_LOWER) & (nk == L.ROMAN_UPPER))
    letters = k1.isin(L.ALPHA_UPPER, L.ALPHA_LOWER)
    stands = following.isNull() | successor | (nk == k1)
    kind = F.when(~letters | stands, k1).otherwise(L.INVALID)
    unreadable = label.isNotNull() & (k0 == L.INVALID)
    undecided = letters & ~stands & mixed
    ok = ~(unreadable | undecided)
    if strict:
        ahead = following.isNotNull() & (nk == L.INVALID) & k1.isin(L.ROMAN_LOWER, L.ROMAN_UPPER, L.ALPHA_UPPER, L.ALPHA_LOWER)
        ok = F.when(undecided | ahead, F.raise_error(F.concat(F.lit("page label cannot be told: "), label)).cast("boolean")).otherwise(ok)
    return {"kind0": k0, "next_kind": nk, "kind": kind, "value": L.label_value(label, kind), "ok": ok}


def classified(series: DataFrame, strict: bool = False) -> DataFrame:
    """(doc, idx, label) with kind, value and ok of every label in its series.

    A roman label before one that is only a letter sequence is one too; a letter label stands if nothing follows, the
    next is its successor or of its kind.  Where the look-ahead meets what cannot be decided the label is invalid and
    not ok; in the strict form the query fails.
    """
    own = with_context(series, ["doc"], "idx", following={"next": F.col("label")})
    return own.withColumns(_judged(F.col("label"), F.col("next"), strict))


def label_runs(series: DataFrame, strict: bool = False) -> DataFrame:
    """classified labels with run, the number of their run of consecutive labels of one kind.

    What follows the row before is this row's label, or what follows that, so its kind is told in this row too and the
    labels are gone along once; the run numbers are running sums.
    """
    label = F.col("label")
    own = with_context(series, ["doc"], "idx", following={"next": label}, previous={"_was": F.struct(label.alias("label"))})
    here, was = _judged(label, F.col("next"), strict), _judged(F.col("_was")["label"], F.coalesce(label, F.col("next")), False)
    judged = own.withColumns(here | {"_kind": was["kind"], "_value": was["value"]})
    both = (F.col("kind") != L.INVALID) & (F.col("_kind") != L.INVALID)
    breaks = (F.col("kind") != F.col("_kind")) | both & (F.col("value") != F.col("_value") + 1)
    broken = judged.withColumn("_break", F.when(F.col("_was").isNull(), 0).otherwise(F.coalesce(breaks, F.lit(True)).cast("int"))).drop("_was", "_kind", "_value")
    return with_context(broken, ["doc"], "idx", before={"_run": F.col("_break")}).withColumn("run", F.col("_run") + F.col("_break")).drop("_run", "_break")


def label_bounds(series: DataFrame, strict: bool = False) -> DataFrame:
    """Runs of labels by their first and last: (doc, start, kind, kind_name, n, first_label, first_value, last_value, all_ok)."""
    runs = label_runs(series, strict)
    own = runs.groupBy("doc", "run").agg(F.min("idx").alias("start"), F.first("kind").alias("kind"), F.count("*").cast("int").alias("n"), F.min("ok").alias("ok"), F.min_by(F.struct("label", "value"), "idx").alias("a"), F.max_by(F.struct("label", "value"), "idx").alias("z"))
    ok = own.groupBy("doc").agg(F.min("ok").alias("all_ok"))
    return own.join(ok, "doc").select("doc", "start", "kind", L.kind_name(F.col("kind")).alias("kind_name"), "n", F.col("a.label").alias("first_label"), F.col("a.value").alias("first_value"), F.col("z.value").alias("last_value"), "all_ok")


def label_ranges(series: DataFrame, strict: bool = False) -> DataFrame:
    """Runs with all their labels: (doc, start, kind, kind_name, n, values, numbers, all_ok); a row is as long as its run."""
    runs = label_runs(series, strict)
    ordered = F.array_sort(F.collect_list(F.struct("idx", "label", "value")))
    own = runs.groupBy("doc", "run").agg(F.min("idx").alias("start"), F.first("kind").alias("kind"), F.count("*").cast("int").alias("n"), F.min("ok").alias("ok"), ordered.alias("of"))
    ok = own.groupBy("doc").agg(F.min("ok").alias("all_ok"))
    return own.join(ok, "doc").select("doc", "start", "kind", L.kind_name(F.col("kind")).alias("kind_name"), "n", F.transform("of", lambda x: x["label"]).alias("values"), F.transform("of", lambda x: x["value"]).alias("numbers"), "all_ok")


def label_dictionary(bounds: DataFrame) -> DataFrame:
    """(doc, nums): the text of each item's PDF page-label array, from label_bounds."""
    entry = F.concat(F.col("start").cast("string"), F.when(F.col("kind") == L.INVALID, " << >>").otherwise(F.concat(F.lit(" << /S /"), L.kind_style(F.col("kind")), F.lit(" /St "), F.col("first_value").cast("string"), F.lit(" >>"))))
    return bounds.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", entry.alias("entry")))), lambda x: x["entry"]), " ").alias("nums"))
