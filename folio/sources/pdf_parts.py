"""Documents of any length as rows of bytes.

A document's objects have their numbers from its number of pages alone, so every page is put together where it lies,
layers compressed, and only bytes move.  Offsets are running sums over the parts, the cross-reference table is made in
blocks of BLOCK numbers, and the parts in order are the file.  No task holds a document.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.operators.sequence import with_context
from folio.sources.pdf import Image, PRODUCER, image_entries, pdf_date, srgb_profile, text_string, xmp
from folio.sources.stored import stored

NODE = 32
BLOCK = 4096
#: Object numbers: fixed ones, then SLOTS a page, then NODES a group of NODE pages, then the outline.
FIXED = 14
SLOTS = 6
NODES = 3
CATALOG, TREE, INFO, UNICODE, DESCRIPTOR, CID, FONT, STRUCTURE, META, INTENT, PARENTS, OUTLINE, PROFILE = range(1, FIXED)
CONTENT, PAGE, BACK, FORE, MASK, ELEMENT = range(SLOTS)
HEAD = b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"
PART = "doc long, seq long, data binary, entries array<struct<number:long,at:long>>, source_bytes long, warnings array<string>"
DATE = datetime(2000, 1, 1, tzinfo=UTC)


class _Part:
    def __init__(self, data: bytes = b""):
        self.pieces, self.size, self.entries = [data] if data else [], len(data), []

    def put(self, number: int, body: str | bytes) -> None:
        raw = b"%d 0 obj\n" % number + (body.encode("latin-1", "replace") if isinstance(body, str) else body) + b"\nendobj\n"
        self.entries.append({"number": number, "at": self.size})
        self.pieces.append(raw)
        self.size += len(raw)

    def stream(self, number: int, data: bytes, entries: str = "", compress: bool = True) -> None:
        if compress:
            data, entries = zlib.compress(data), entries + " /Filter /FlateDecode"
        self.put(number, f"<< /Length {len(data)}{entries} >>\nstream\n".encode() + data + b"\nendstream")

    def image(self, number: int, image: Image, smask: int | None = None) -> None:
        """An image; data that a codec has encoded are stored as they are."""
        self.stream(number, image.data, image_entries(image, smask), compress=image.filter is None)

    def row(self, doc: int, seq: int, source_bytes: int = 0, warnings: list[str] | None = None) -> tuple:
        return doc, seq, b"".join(self.pieces), self.entries, source_bytes, warnings or []


def page_number(n: int, slot: int) -> int:
    return FIXED + SLOTS * n + slot


def _given(r) -> dict[str, Image]:
    """The layers that a row brings as raw bytes."""
    if not isinstance(getattr(r, "mask", None), bytes | bytearray):
        return {}
    raw = lambda data, h, w, bits=8: Image(int(w), int(h), bytes(data), 1 if bits == 1 else len(data) // int(h * w), bits)
    return {"mask": raw(r.mask, r.mask_height, r.mask_width, 1), "background": raw(r.background, r.bg_height, r.bg_width), "foreground": raw(r.foreground, r.fg_height, r.fg_width)}


def _page(r, layers: dict[str, Image]) -> _Part:
    """The objects of a page; layers: a background, and a foreground with its mask; or one picture under ``whole``."""
    part, n, total = _Part(), int(r.n), int(r.pages)
    node = FIXED + SLOTS * total + NODES * (n // NODE)
    number = lambda slot: page_number(n, slot)
    names = []
    if "mask" in layers:  # in its own size
        part.image(number(MASK), layers["mask"])
    for name, slot, smask in (("whole", BACK, None), ("background", BACK, None), ("foreground", FORE, number(MASK))):
        if name in layers:
            part.image(number(slot), layers[name], smask)
            names.append((f"Im{len(names)}", slot))
    draw = [f"q {r.width:.3f} 0 0 {r.height:.3f} 0 0 cm /{name} Do Q\n" for name, _ in names]
    content = r.content if isinstance(r.content, str) else ""
    part.stream(number(CONTENT), ("".join(draw) + content).encode("latin-1", "replace"))
    objects = f" /XObject << {' '.join(f'/{name} {number(slot)} 0 R' for name, slot in names)} >>" if names else ""
    part.put(number(PAGE), f"<< /Type /Page /Parent {node} 0 R /MediaBox [0 0 {r.width:.3f} {r.height:.3f}] /CropBox [0 0 {r.width:.3f} {r.height:.3f}] /Rotate 0 /Tabs /S /StructParents {n} /Contents {number(CONTENT)} 0 R /Resources << /Font << /f-0-0 {FONT} 0 R >>{objects} >> >>")
    part.put(number(ELEMENT), f"<< /Type /StructElem /S /Div /Pg {number(PAGE)} 0 R /P {node + 2} 0 R >>")
    if n % NODE == 0:  # the first page of a group brings the group's nodes
        own = range(n, min(n + NODE, total))
        part.put(node, f"<< /Type /Pages /Parent {TREE} 0 R /Kids [{' '.join(f'{page_number(k, PAGE)} 0 R' for k in own)}] /Count {len(own)} >>")
        part.put(node + 1, f"<< /Limits [{own[0]} {own[-1]}] /Nums [{' '.join(f'{k} [{page_number(k, ELEMENT)} 0 R]' for k in own)}] >>")
        part.put(node + 2, f"<< /Type /StructElem /S /Sect /P {STRUCTURE} 0 R /K [{' '.join(f'{page_number(k, ELEMENT)} 0 R' for k in own)}] >>")
    return part


def _head(r, language: str | None, created: datetime, meta: dict[str, str], conforming: bool) -> _Part:
    part, total = _Part(HEAD), int(r.pages)
    nodes = [FIXED + SLOTS * total + NODES * k for k in range(-(-total // NODE))]
    title = meta.get("title") or (r.title if isinstance(r.title, str) else "")
    toc = [t for t in (r.toc if r.toc is not None else ()) if 0 <= t["page"] < total]
    first = FIXED + SLOTS * total + NODES * len(nodes)
    extra = (f" /PageLabels << /Nums [{r.nums}] >>" if isinstance(r.nums, str) and r.nums else "") + (f" /Outlines {OUTLINE} 0 R" if toc else "") + (f" /Lang ({language})" if language else "")
    part.put(CATALOG, f"<< /Type /Catalog /Pages {TREE} 0 R /MarkInfo << /Marked true >> /StructTreeRoot {STRUCTURE} 0 R /Metadata {META} 0 R /OutputIntents [{INTENT} 0 R]{extra} >>")
    part.put(TREE, f"<< /Type /Pages /Kids [{' '.join(f'{k} 0 R' for k in nodes)}] /Count {total} >>")
    part.put(INFO, f"<< /Producer {text_string(PRODUCER)} /CreationDate ({pdf_date(created)}) /Title {text_string(title)}{''.join(f" /{k} {text_string(meta[k.lower()])}" for k in ("Author", "Subject", "Creator") if meta.get(k.lower()))} >>")
    part.stream(UNICODE, b"/CIDInit /ProcSet findresource begin 12 dict begin begincmap /CMapName /Units def /CMapType 2 def 1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0000> <FFFF> <0000> endbfrange endcmap end end")
    part.put(DESCRIPTOR, "<< /Type /FontDescriptor /FontName /Glyphless /Flags 5 /FontBBox [0 0 500 1000] /Ascent 1000 /Descent -1 /CapHeight 1000 /ItalicAngle 0 /StemV 80 >>")
    part.put(CID, f"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Glyphless /CIDSystemInfo << /Registry (Adobe) /Ordering (Identity) /Supplement 0 >> /FontDescriptor {DESCRIPTOR} 0 R /DW 500 >>")
    part.put(FONT, f"<< /Type /Font /Subtype /Type0 /BaseFont /Glyphless /Encoding /Identity-H /DescendantFonts [{CID} 0 R] /ToUnicode {UNICODE} 0 R >>")
    part.put(STRUCTURE, f"<< /Type /StructTreeRoot /K [{' '.join(f'{k + 2} 0 R' for k in nodes)}] /ParentTree {PARENTS} 0 R >>")
    part.stream(META, xmp(title, PRODUCER, created, conforming, meta), " /Type /Metadata /Subtype /XML", compress=False)
    part.put(INTENT, f"<< /Type /OutputIntent /S /GTS_PDFA1 /OutputConditionIdentifier (sRGB) /Info (sRGB) /DestOutputProfile {PROFILE} 0 R >>")
    part.stream(PROFILE, srgb_profile(), " /N 3")
    part.put(PARENTS, f"<< /Kids [{' '.join(f'{k + 1} 0 R' for k in nodes)}] >>")
    if toc:
        _outline(part, toc, first)
    return part


def _outline(part: _Part, toc: list, first: int) -> None:
    parent, stack = [], [(0, OUTLINE)]
    for k, t in enumerate(toc):
        while len(stack) > 1 and stack[-1][0] >= t["level"]:
            stack.pop()
        parent.append(stack[-1][1])
        stack.append((t["level"], first + k))
    rows: dict[int, list[int]] = {}
    for k, p in enumerate(parent):
        rows.setdefault(p, []).append(first + k)
    at = {n: (row, k) for row in rows.values() for k, n in enumerate(row)}
    for k, t in enumerate(toc):
        row, i = at[first + k]
        links = (f" /Prev {row[i - 1]} 0 R" if i else "") + (f" /Next {row[i + 1]} 0 R" if i + 1 < len(row) else "")
        if own := rows.get(first + k):
            links += f" /First {own[0]} 0 R /Last {own[-1]} 0 R /Count {len(own)}"
        part.put(first + k, f"<< /Title {text_string(t['title'])} /Parent {parent[k]} 0 R /Dest [{page_number(t['page'], PAGE)} 0 R /Fit]{links} >>")
    top = rows[OUTLINE]
    part.put(OUTLINE, f"<< /Type /Outlines /First {top[0]} 0 R /Last {top[-1]} 0 R /Count {len(top)} >>")


def document_parts(pages: DataFrame, documents: DataFrame, language: str | None = None, created: datetime = DATE, keys: DataFrame | None = None, render: Callable | None = None, meta: dict[str, str] | None = None, conforming: bool = True) -> DataFrame:
    """(doc, seq, data): the parts of each document, to be put together by seq.

    pages: (doc, page_idx, width, height, content) and, for layers, mask (1 bit a pixel), mask_height, mask_width,
    background, bg_height, bg_width, foreground, fg_height, fg_width; or what render(rows) makes layers of, a row after
    the other, as (layers, source bytes, warnings), where the part is written.  documents: (doc, title, nums, toc array<struct<level, title,
    page>>).  keys: the (doc, page_idx) of pages, where they are to be had more cheaply.  meta: author, subject, creator
    and the like; conforming: PDF/A-3B is claimed, which visible text without an embedded font does not meet.
    Documents without pages have no parts.
    """
    return reported_parts(pages, documents, language, created, keys, render, meta, conforming)[0]


def reported_parts(pages: DataFrame, documents: DataFrame, language: str | None = None, created: datetime = DATE, keys: DataFrame | None = None, render: Callable | None = None, meta: dict[str, str] | None = None, conforming: bool = True) -> tuple[DataFrame, DataFrame]:
    """document_parts, and (doc, pages, source_bytes, warnings) of what render tells."""
    keys = stored(pages.select("doc", "page_idx") if keys is None else keys, "keys")  # contents and layers are made once, for the parts
    counts = keys.groupBy("doc").agg(F.count("*").alias("pages"))
    numbered = pages.join(with_context(keys, ["doc"], "page_idx", before={"n": F.lit(1)}), ["doc", "page_idx"])
    columns = ["doc", "seq", "data", "entries", "source_bytes", "warnings"]

    def page_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            made = render(pdf.itertuples(index=False)) if render else ((_given(r), 0, []) for r in pdf.itertuples(index=False))
            for r, (layers, size, warnings) in zip(pdf.itertuples(index=False), made):
                rows.append(_page(r, layers).row(int(r.doc), 1 + int(r.n), size, warnings))
            yield pd.DataFrame(rows, columns=columns)

    def head_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([_head(r, language, created, meta or {}, conforming).row(int(r.doc), 0) for r in pdf.itertuples(index=False)], columns=columns)

    heads = counts.join(documents.select("doc", "title", "nums", "toc"), "doc", "left").mapInPandas(head_rows, PART)
    body = numbered.join(counts, "doc").mapInPandas(page_rows, PART).unionByName(heads)
    body = stored(body, "parts")  # what has been encoded is not encoded again, whatever is lost
    placed = stored(with_context(body.select("doc", "seq", F.length("data").cast("long").alias("size"), "entries"), ["doc"], "seq", before={"offset": F.col("size")}), "places")
    entries = placed.select("doc", F.explode("entries").alias("e"), "offset").select("doc", F.col("e.number").alias("number"), (F.col("offset") + F.col("e.at")).alias("at"))
    ends = placed.groupBy("doc").agg(F.max(F.col("offset") + F.col("size")).alias("start"), F.max("seq").alias("last"))
    top = entries.groupBy("doc").agg((F.max("number") + 1).alias("numbers"))
    sizes = ends.join(top, "doc")

    def table(key, pdf: pd.DataFrame) -> pd.DataFrame:
        doc, block = int(key[0]), int(key[1])
        numbers, start, last = int(pdf["numbers"].iloc[0]), int(pdf["start"].iloc[0]), int(pdf["last"].iloc[0])
        at = dict(zip(pdf["number"].tolist(), pdf["at"].tolist()))
        lines = [f"xref\n0 {numbers}\n"] if block == 0 else []
        for k in range(block * BLOCK, min((block + 1) * BLOCK, numbers)):
            lines.append(f"{at[k]:010d} 00000 n \n" if k in at else f"{0:010d} {65535 if k == 0 else 1:05d} f \n")
        if (block + 1) * BLOCK >= numbers:
            lines.append(f"trailer\n<< /Size {numbers} /Root {CATALOG} 0 R /Info {INFO} 0 R >>\nstartxref\n{start}\n%%EOF\n")
        return pd.DataFrame({"doc": [doc], "seq": [last + 1 + block], "data": ["".join(lines).encode()]})

    # every block has at least its first page's or head's objects, as numbers are dense but for unused slots
    tables = entries.join(sizes, "doc").withColumn("block", F.floor(F.col("number") / BLOCK)).groupBy("doc", "block").applyInPandas(table, "doc long, seq long, data binary")
    report = body.where("seq > 0").groupBy("doc").agg(F.count("*").alias("pages"), F.sum("source_bytes").alias("source_bytes"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("warnings")))).alias("warnings"))
    return body.select("doc", "seq", "data").unionByName(tables), report


def assembled(parts: DataFrame) -> DataFrame:
    """(doc, pdf) of documents that fit in a row; others are written by write_files."""
    return parts.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("seq", F.hex("data").alias("h")))).alias("p")).select("doc", F.unhex(F.array_join(F.transform("p", lambda x: x["h"]), "")).alias("pdf"))


def write_files(parts: DataFrame, folder: str) -> None:
    """Writes {doc}.pdf to a folder that all executors share, part after part; a file appears when it is whole."""
    os.makedirs(folder, exist_ok=True)

    def write(rows) -> None:
        doc, out, name = None, None, None
        for r in rows:
            if r.doc != doc:
                if out:
                    out.close()
                    os.replace(name, os.path.join(folder, f"{doc}.pdf"))
                doc, name = r.doc, os.path.join(folder, f".{r.doc}.{os.getpid()}.part")
                out = open(name, "wb")
            out.write(r.data)
        if out:
            out.close()
            os.replace(name, os.path.join(folder, f"{doc}.pdf"))

    parts.repartition("doc").sortWithinPartitions("doc", "seq").foreachPartition(write)
