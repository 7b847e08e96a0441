"""The words of a page as one row.

A word as a row of its own is several times as large in a shuffle as it is in a file.  So the words of a page that are
read together travel as one block of compressed columns, once, by page; repeated rows are taken out where a page's
blocks meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BOX = ("x0", "y0", "x1", "y1")
NUMBERS = ("conf", *(f"b{c}" for c in BOX), "fontsize", *(f"l{c}" for c in BOX), "slope", "const")
BLOCK = pa.schema([("line", pa.int32()), ("word", pa.int32()), ("loaded_at", pa.int64()), ("text", pa.string()), ("direction", pa.string()), *((c, pa.float64()) for c in NUMBERS)])
#: Words that are taken apart at a time.
MOST = 50_000
_BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
LINES = f"array<struct<bbox:{_BOX},baseline:struct<slope:double,const:double>,words:array<struct<text:string,conf:double,bbox:{_BOX},fontsize:double,direction:string>>>>"


def starts(columns: list[pa.Array]) -> np.ndarray:
    """Where a row differs from the one before it in any of the columns."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        values, none = pc.fill_null(c, 0).to_numpy(zero_copy_only=False), c.is_null().to_numpy(zero_copy_only=False)
        new[1:] |= (values[1:] != values[:-1]) | (none[1:] != none[:-1])
    return np.flatnonzero(new)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        b = b.take(pc.sort_indices(b, [("doc", "ascending"), ("page_idx", "ascending")]))
        at = starts([b.column("doc"), b.column("page_idx")])
        block = pa.RecordBatch.from_arrays([b.column(n).cast(BLOCK.field(n).type) for n in BLOCK.names], schema=BLOCK)
        bodies = []
        for k, end in zip(at.tolist(), [*at[1:].tolist(), b.num_rows]):
            raw = block.slice(k, end - k).serialize()
            bodies.append((end - k).to_bytes(4, "little") + raw.size.to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True))
        yield pa.RecordBatch.from_arrays([b.column("doc").take(pa.array(at)), b.column("page_idx").take(pa.array(at)), pa.array(bodies, pa.binary())], ["doc", "page_idx", "block"])


def _lines(blocks: list[list[bytes]]) -> pa.Array:
    """The lines of pages, a list of blocks each; of rows with the same line and word the first stays by loaded_at (NULL last) and then by text."""
    parts = [pa.ipc.read_record_batch(pa.decompress(x[12:], int.from_bytes(x[4:12], "little"), "zstd"), BLOCK) for own in blocks for x in own]
    page = np.repeat(np.repeat(np.arange(len(blocks)), [len(own) for own in blocks]), [len(x) for x in parts])
    t = pa.Table.from_batches(parts, BLOCK).combine_chunks()
    t = t.append_column("page", pa.array(page)).append_column("late", t["loaded_at"].is_null()).append_column("plain", pc.fill_null(t["text"], ""))
    t = t.take(pc.sort_indices(t, [(c, "ascending") for c in ("page", "line", "word", "late", "loaded_at", "plain")], null_placement="at_start"))
    t = t.take(pa.array(starts([t[c].combine_chunks() for c in ("page", "line", "word")])))
    t = {n: t[n].combine_chunks() for n in t.column_names}
    at = starts([t["page"], t["line"]])
    box = lambda k: pa.StructArray.from_arrays([t[f"{k}{c}"] for c in BOX], list(BOX))
    first = pa.array(at)
    words = pa.StructArray.from_arrays([t["text"], t["conf"], box("b"), t["fontsize"], t["direction"]], ["text", "conf", "bbox", "fontsize", "direction"])
    baseline = pa.StructArray.from_arrays([t["slope"], t["const"]], ["slope", "const"])
    lists = pa.ListArray.from_arrays(pa.array([*at.tolist(), len(words)], pa.int32()), words)
    lines = pa.StructArray.from_arrays([box("l").take(first), baseline.take(first), lists], ["bbox", "baseline", "words"])
    ends = np.searchsorted(t["page"].to_numpy()[at], np.arange(len(blocks) + 1))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), lines)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        blocks, own, sizes = b.column("blocks"), [], []
        for k in range(b.num_rows + 1):
            if own and (k == b.num_rows or sum(sizes) >= MOST):
                done = b.slice(k - len(own), len(own))
                yield pa.RecordBatch.from_arrays([done.column("doc"), done.column("page_idx"), done.column("sizes"), _lines(own)], ["doc", "page_idx", "sizes", "lines"])
                own, sizes = [], []
            if k < b.num_rows:
                own.append(blocks[k].as_py())
                sizes.append(sum(int.from_bytes(x[:4], "little") for x in own[-1]))


def page_lines(words: DataFrame, geometry: DataFrame, columns: list[str]) -> DataFrame:
    """(doc, page_idx, columns of geometry, lines): each page that has words and a size, with its lines from top to bottom.

    Words are taken once, as by text_layer.words_once.
    """
    loaded = F.unix_micros(F.col("loaded_at").cast("timestamp")) if "loaded_at" in words.columns else F.lit(None).cast("long")
    flat = words.where("doc is not null and page_idx is not null").select(
        "doc", "page_idx", "line", "word", loaded.alias("loaded_at"), "text", "direction", "conf", "fontsize", *(F.col("bbox")[c].alias(f"b{c}") for c in BOX), *(F.col("line_bbox")[c].alias(f"l{c}") for c in BOX), *(F.col("baseline")[c].alias(c) for c in ("slope", "const"))
    )
    kinds = dict(words.dtypes) | dict(geometry.dtypes)
    size = ", ".join(f"{c}: {kinds[c]}" for c in columns)
    blocks = flat.mapInArrow(_packed, f"doc {kinds['doc']}, page_idx {kinds['page_idx']}, block binary").withColumn("size", F.lit(None).cast(f"struct<{size}>"))
    sizes = geometry.select("doc", "page_idx", F.lit(None).cast("binary").alias("block"), F.struct(*columns).alias("size"))
    pages = blocks.unionByName(sizes).groupBy("doc", "page_idx").agg(F.collect_list("block").alias("blocks"), F.collect_list("size").alias("sizes"))
    met = pages.where((F.size("blocks") > 0) & (F.size("sizes") > 0))
    made = met.mapInArrow(_unpacked, f"doc {kinds['doc']}, page_idx {kinds['page_idx']}, sizes array<struct<{size}>>, lines {LINES}")
    return made.select("doc", "page_idx", F.explode("sizes").alias("size"), "lines").select("doc", "page_idx", "size.*", "lines")
