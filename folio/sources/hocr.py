"""OCR output in hOCR: pages, lines and words as rows."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.parsers.expat import ExpatError, ParserCreate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
WORDS = f"page_idx int, page_width int, page_height int, scan_res int, par int, line int, line_bbox {BOX}, baseline struct<slope:double,const:double>, word int, text string, conf double, bbox {BOX}, fontsize double, direction string"
LINES = ("ocr_line", "ocr_caption", "ocr_header", "ocr_textfloat", "ocrx_line")
BOX_NAMES = ("x0", "y0", "x1", "y1")
#: Words that are given on at a time.
MOST = 50_000
VOID = ("br", "img", "meta", "link", "hr", "input")


def properties(title: str) -> dict[str, list[str]]:
    out = {}
    for part in (title or "").split(";"):
        words = part.split()
        if words:
            out[words[0]] = words[1:]
    return out


def _numbers(values: list[str] | None, n: int) -> tuple[float, ...] | None:
    try:
        return tuple(float(x) for x in values[:n]) if values and len(values) >= n else None
    except ValueError:
        return None


class _Reader(HTMLParser):
    """Collects words; bad nesting does no harm beyond the element it is in."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.pages: list[dict] = []
        self.stack: list[str] = []
        self.word = None
        self.par = -1

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        a = dict(attrs)
        kinds = (a.get("class") or "").split()
        p = properties(a.get("title") or "")
        kind = next((k for k in kinds if k == "ocr_page" or k == "ocr_par" or k in LINES or k == "ocrx_word"), "")
        self.stack.append(kind)
        box = _numbers(p.get("bbox"), 4)
        if kind == "ocr_page":
            res = _numbers(p.get("scan_res"), 2)
            self.pages.append({"box": box, "res": int(res[1]) if res else None, "lines": [], "words": []})
            self.par = -1
        elif kind == "ocr_par":
            self.par += 1
            self.direction = {"rtl": "RTL", "ltr": "LTR"}.get((a.get("dir") or "").lower(), "unspecified")
        elif kind in LINES and self.pages:
            base = _numbers(p.get("baseline"), 2) or (0.0, 0.0)
            self.pages[-1]["lines"].append((max(self.par, 0), box, base, p.get("x_size")))
        elif kind == "ocrx_word" and self.pages:
            conf, size = _numbers(p.get("x_wconf"), 1), _numbers(p.get("x_fsize"), 1)
            direction = {"rtl": "RTL", "ltr": "LTR"}.get((a.get("dir") or "").lower(), getattr(self, "direction", "unspecified"))
            self.word = [max(len(self.pages[-1]["lines"]) - 1, 0), box, conf[0] if conf else None, size[0] if size else 0.0, direction, ""]

    def handle_endtag(self, tag):
        if tag in VOID or not self.stack:
            return
        if self.stack.pop() == "ocrx_word" and self.word is not None:
            self.pages[-1]["words"].append(self.word)
            self.word = None

    def handle_data(self, data):
        if self.word is not None:
            self.word[-1] += data


#: What an XML parser would read in another way than an HTML parser does.
_NOT_XML = re.compile("\r|&#|<!\\[|<!ENTITY|<(?:script|style)", re.IGNORECASE)


def _read(text: str) -> _Reader:
    """Well-formed texts go through the XML parser, which is several times as fast; others through the HTML parser."""
    if text and not _NOT_XML.search(text):
        reader, parser = _Reader(), ParserCreate()
        parser.buffer_text = True
        parser.StartElementHandler = lambda tag, a: reader.handle_starttag(tag.lower(), [(k.lower(), v) for k, v in a.items()])
        parser.EndElementHandler = lambda tag: reader.handle_endtag(tag.lower())
        parser.CharacterDataHandler = reader.handle_data
        try:
            parser.Parse(text, True)
            return reader
        except ExpatError:
            pass
    reader = _Reader()
    reader.feed(text or "")
    reader.close()
    return reader


def _found(text: str, font_scale: float = 1.0) -> Iterator[tuple]:
    """The words of an hOCR text in the order of WORDS, boxes and baselines as tuples; a page without words gives none."""
    for k, page in enumerate(_read(text).pages):
        b = page["box"] or (0, 0, 0, 0)
        width, height, lines = int(b[2] - b[0]), int(b[3] - b[1]), page["lines"]
        last, n = None, 0
        for line, wbox, conf, size, direction, word in page["words"]:
            n = n + 1 if line == last else 0
            last = line
            par, lbox, base, _ = lines[line] if lines else (0, None, (0.0, 0.0), None)
            yield k, width, height, page["res"], par, line, lbox, base, n, word.strip(), conf, wbox, size * font_scale, direction


def parse(text: str, font_scale: float = 1.0) -> list[tuple]:
    """The words of an hOCR text as rows of WORDS; a page without words gives none."""
    box = lambda b: dict(zip(BOX_NAMES, b)) if b else None
    return [(*r[:6], box(r[6]), {"slope": r[7][0], "const": r[7][1]}, *r[8:11], box(r[11]), *r[12:]) for r in _found(text, font_scale)]


COLUMNS = [x.strip().split(" ")[0] for x in re.split(r",\s(?=[a-z_]+ )", WORDS)]


def hocr_words(texts: DataFrame, key: str = "doc", column: str = "hocr") -> DataFrame:
    """(key, WORDS) of a table with an hOCR text a row."""
    kind = dict(texts.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for k, t in enumerate(b.column(1).to_pylist()):
                own = list(_found(t))
                at += [k] * len(own)
                rows += own
                if len(rows) >= MOST or (rows and k + 1 == b.num_rows):
                    yield _batch(key, b.column(0).take(pa.array(at)), rows)
                    at, rows = [], []

    return texts.select(key, column).mapInArrow(run, f"{key} {kind}, {WORDS}")


def _batch(key: str, keys: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    made = []
    for name, values in zip(COLUMNS, zip(*rows)):
        if names := {"line_bbox": BOX_NAMES, "bbox": BOX_NAMES, "baseline": ("slope", "const")}.get(name):
            none = (None,) * len(names)
            parts = [pa.array(x, pa.float64()) for x in zip(*(v or none for v in values))]
            made.append(pa.StructArray.from_arrays(parts, list(names), mask=pa.array([v is None for v in values])))
        else:
            made.append(pa.array(values, pa.string() if name in ("text", "direction") else pa.float64() if name in ("conf", "fontsize") else pa.int32()))
    return pa.RecordBatch.from_arrays([keys, *made], [key, *COLUMNS])


def read_hocr(spark: SparkSession, path: str) -> DataFrame:
    return hocr_words(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("hocr")), "path")


def write_page(words: Column, width: Column, height: Column, res: Column) -> Column:
    """hOCR of a page from an array of lines struct<bbox, baseline, words array<struct<text, conf, bbox, fontsize, direction>>>."""
    esc = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    box = lambda b: F.concat_ws(" ", F.lit("bbox"), b["x0"].cast("string"), b["y0"].cast("string"), b["x1"].cast("string"), b["y1"].cast("string"))
    word = lambda w: F.concat(F.lit('<span class="ocrx_word" dir="'), F.lower(w["direction"]), F.lit('" title="'), box(w["bbox"]), F.coalesce(F.concat(F.lit("; x_wconf "), w["conf"].cast("string")), F.lit("")), F.lit("; x_fsize "), w["fontsize"].cast("string"), F.lit('">'), esc(F.coalesce(w["text"], F.lit(""))), F.lit("</span>"))
    line = lambda x: F.concat(F.lit('<span class="ocr_line" title="'), box(x["bbox"]), F.lit("; baseline "), x["baseline"]["slope"].cast("string"), F.lit(" "), x["baseline"]["const"].cast("string"), F.lit('">'), F.array_join(F.transform(x["words"], word), " "), F.lit("</span>"))
    return F.concat(F.lit('<div class="ocr_page" title="bbox 0 0 '), width.cast("string"), F.lit(" "), height.cast("string"), F.coalesce(F.concat(F.lit("; scan_res "), res.cast("string"), F.lit(" "), res.cast("string")), F.lit("")), F.lit('"><p class="ocr_par">'), F.array_join(F.transform(words, line), "\n"), F.lit("</p></div>"))
