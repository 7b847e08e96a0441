"""From page rasters and OCR words to layered, searchable documents."""

from __future__ import annotations

import importlib
import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.operators import geometry as OG
from folio.operators import kernels as K
from folio.operators import scandata as S
from folio.operators import text_layer as T
from folio.operators.mrc import DENOISE, FORM_BITONAL, filled_layers, page_form, page_mask
from folio.operators.mrc import page_layers as separate
from folio.sources import codecs, images
from folio.sources.pdf import Image
from folio.sources.pdf_parts import reported_parts
from folio.sources.stored import stored

MODES = ("mrc", "skip")
#: PDF filter and file suffix of each layer format; raw layers are deflated by the writer.
FILTERS = {"flate": (None, "raw"), "jpeg": ("DCTDecode", "jpg"), "jpeg2000": ("JPXDecode", "jp2"), "jbig2": ("JBIG2Decode", "jbig2"), "ccitt": ("CCITTFaxDecode", "g4")}


@dataclass(frozen=True)
class Options:
    """Settings of a run; ``limit`` counts kept pages.

    Layers go through the encoders that are registered under their formats; ``codecs`` names the module that registers
    them on the workers.  Without flags of their own the layers get the defaults of format and implementation.
    """

    mode: str = "mrc"
    denoise: str = "fast"
    downsample: int | None = None
    fg_downsample: int | None = None
    bg_downsample: int | None = None
    hq_pages: str | None = None
    limit: int | None = None
    dpi: int | None = None
    grayscale: bool = False
    bitonal: bool = False
    visible_text: bool = False
    language: str | None = None
    strict_labels: bool = False
    from_pdf: bool = False
    layer_format: str = "flate"
    mask_format: str = "flate"
    implementation: str = "openjpeg"
    bg_flags: str | None = None
    fg_flags: str | None = None
    hq_bg_flags: str | None = None
    hq_fg_flags: str | None = None
    codecs: str | None = None
    side_output: str | None = None
    meta: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        if self.denoise not in DENOISE:
            raise ValueError(f"denoise must be one of {DENOISE}")
        if self.layer_format not in ("flate", "jpeg", "jpeg2000") or self.mask_format not in ("flate", "jbig2", "ccitt"):
            raise ValueError("layers are flate, jpeg or jpeg2000, masks flate, jbig2 or ccitt")
        for n in (self.downsample, self.fg_downsample, self.bg_downsample, self.limit, self.dpi):
            if n is not None and n < 1:
                raise ValueError("factors, limits and resolutions must be 1 or more")

    def flags(self, layer: str, hq: bool) -> str | None:
        own = {("bg", False): self.bg_flags, ("fg", False): self.fg_flags, ("bg", True): self.hq_bg_flags, ("fg", True): self.hq_fg_flags}[layer, hq]
        return own or (None if self.layer_format == "flate" else codecs.default_flags(self.layer_format, self.implementation, layer, hq))


def text_boxes(words: DataFrame, geometry: DataFrame) -> DataFrame:
    """(doc, page_idx, boxes, imwidth, imheight): boxes of the lines that are admitted to the mask, from top to bottom, in the OCR's pixels.

    Degenerate, inverted and outside boxes are left out, the latter by the page that the OCR saw.
    """
    size = geometry.groupBy("doc", "page_idx").agg(F.first("imwidth").alias("imwidth"), F.first("imheight").alias("imheight"))
    lines = T.line_confidence(words, [F.min_by("line_bbox", "word").alias("box")]).where("admitted")
    boxed = lines.withColumn("b", T.scaled_box(F.col("box"), None)).join(size, ["doc", "page_idx"], "left")
    far = F.lit(2**31 - 1)
    good = boxed.where(T.box_status(F.col("b"), F.coalesce("imwidth", far), F.coalesce("imheight", far)) == "ok")
    return good.groupBy("doc", "page_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "b"))), lambda x: x["b"]).alias("boxes"), F.first("imwidth").alias("imwidth"), F.first("imheight").alias("imheight"))


def _load(r) -> np.ndarray | None:
    """The raster of a page: of its file, or of the bytes in the row; bool where it has one bit a pixel."""
    path = getattr(r, "path", None)
    if isinstance(path, str):
        with open(path.removeprefix("file:"), "rb") as f:
            data = f.read()
        kind = images.probe(data[:65536])[0]
        return np.asarray(codecs.decoder(kind)(data)) if kind not in (None, "png", "pnm") else images.decode(data)
    data = getattr(r, "data", None)
    if not isinstance(data, bytes | bytearray):
        return None
    h, w, n = int(r.raster_height), int(r.raster_width), int(r.channels or 1)
    if not h or not w or len(data) < h * w * n:
        return None
    v = np.frombuffer(data, np.uint8)[: h * w * n].reshape(h, w, n)
    v = v[:, :, 0] if n in (1, 2) else v[:, :, :3]  # alpha is dropped
    return v > 127 if getattr(r, "mode", None) == "1" else v


def _boxes(r, shape: tuple[int, ...]) -> list[tuple[int, int, int, int]]:
    """The row's boxes in the pixels of a raster of that shape."""
    if r.boxes is None or not hasattr(r.boxes, "__len__"):
        return []
    x = shape[1] / r.imwidth if r.imwidth and r.imwidth == r.imwidth else 1.0
    y = shape[0] / r.imheight if r.imheight and r.imheight == r.imheight else 1.0
    return [(int(b["x0"] * x), int(b["y0"] * y), int(b["x1"] * x), int(b["y1"] * y)) for b in r.boxes]


def _one_bit(mask: np.ndarray, options: Options) -> Image:
    """A picture of one bit a pixel, 1 white."""
    if options.mask_format != "flate":
        return Image(mask.shape[1], mask.shape[0], codecs.encoder(options.mask_format)(mask, None), 1, 1, FILTERS[options.mask_format][0])
    return Image(mask.shape[1], mask.shape[0], np.packbits(mask, axis=1).tobytes(), 1, 1)


#: Pages of so many pixels together are held at a time.
HELD_PIXELS = 1 << 20


def page_layers(r, options: Options) -> tuple[dict[str, Image], int, list[str]]:
    """Encoded layers of a page, the bytes of its raster and warnings; reading, separating and encoding in one go."""
    return next(batch_layers([r], options))


def batch_layers(rows: Iterable, options: Options) -> Iterator[tuple[dict[str, Image], int, list[str]]]:
    """page_layers of each row, in order; small pages are separated side by side, as many as HELD_PIXELS allow."""
    if options.codecs:
        importlib.import_module(options.codecs)
    held, pixels = [], 0
    for r in rows:
        held.append(_masked(r, options))
        if (image := held[-1][1]) is not None:
            pixels += image.size
        if pixels >= HELD_PIXELS or len(held) >= 1000:
            yield from _separated(held, options)
            held, pixels = [], 0
    yield from _separated(held, options)


def _masked(r, options: Options) -> tuple:
    """(row, image to be separated or None, its mask, layers that are ready, bytes of the raster, warnings)."""
    warnings = list(r.warnings) if hasattr(r.warnings, "__len__") else []
    image = _load(r)
    if image is None:
        return r, None, None, {}, 0, warnings
    size = image.size
    form = page_form(image, options.bitonal)
    if form == FORM_BITONAL:  # a page of one bit goes past the separation
        return r, None, None, {"whole": _one_bit(image, options)}, size, warnings
    if options.grayscale and image.ndim == 3:
        image = K.adaptive_gray(image)
    if options.downsample and (small := K.shrink(image, options.downsample)) is not None:
        image = small
    dpi = int(r.dpi) if r.dpi and r.dpi == r.dpi else options.dpi
    mask = page_mask(image, _boxes(r, image.shape), dpi, options.denoise)
    if options.bitonal:  # which has no other layers
        layers = {"whole": _one_bit(~mask, options)}
        if options.side_output:
            _aside(r, layers, options)
        return r, None, None, layers, size, warnings
    return r, image, mask, {}, size, warnings


def _separated(held: list[tuple], options: Options) -> Iterator[tuple[dict[str, Image], int, list[str]]]:
    open_ = [k for k, x in enumerate(held) if x[1] is not None]
    filled = dict(zip(open_, filled_layers([held[k][2] for k in open_], [held[k][1] for k in open_])))
    for k, (r, image, mask, layers, size, warnings) in enumerate(held):
        if image is not None:
            hq = bool(r.hq) if r.hq is not None and r.hq == r.hq else False
            made = separate(mask, image, None if hq else options.fg_downsample, None if hq else options.bg_downsample, filled=filled.pop(k))
            warnings = warnings + made["warnings"]
            layers = {"mask": _one_bit(mask, options)}
            for name, short in (("background", "bg"), ("foreground", "fg")):
                v = made[name]
                n = v.shape[2] if v.ndim == 3 else 1
                data = v.tobytes() if options.layer_format == "flate" else codecs.encoder(options.layer_format)(v, options.flags(short, hq))
                layers[name] = Image(v.shape[1], v.shape[0], data, n, 8, FILTERS[options.layer_format][0])
            if options.side_output:
                _aside(r, layers, options)
        yield layers, size, warnings


def _aside(r, layers: dict[str, Image], options: Options) -> None:
    """Writes a page's layers as files beside the document, into a folder that all executors share."""
    folder = os.path.join(options.side_output, str(r.doc))
    os.makedirs(folder, exist_ok=True)
    for name, short in (("mask", "mask"), ("whole", "mask"), ("background", "bg"), ("foreground", "fg")):
        if name in layers:
            suffix = FILTERS[options.mask_format if short == "mask" else options.layer_format][1]
            target = os.path.join(folder, f"{int(r.page_idx):06d}_{short}.{suffix}")
            with open(f"{target}.{os.getpid()}", "wb") as f:
                f.write(layers[name].data)
            os.replace(f"{target}.{os.getpid()}", target)


def recode(rasters: DataFrame, words: DataFrame, geometry: DataFrame, scandata: DataFrame, items: DataFrame, options: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """The documents' parts (doc, seq, data) and a report (doc, pages, source_bytes, warnings).

    rasters: (doc, page_idx, path) of image files in a folder that all executors share, so that no pixel is moved; or
    (doc, page_idx, height, width, channels, data), whose bytes go with the page through its joins.  With ``from_pdf``
    their page_idx counts the pages of a document that leaves the skipped ones out.  What is known of a page is joined
    first, skipped pages go before anything is read; then reading, separating, encoding and writing is one narrow stage.
    """
    pages = S.pages_once(scandata).persist()
    kept = S.output_index(pages).where(~F.col("skipped"))
    if options.limit:
        kept = kept.where(F.col("out_idx") < options.limit)
    kept = kept.select("doc", F.col("idx").alias("page_idx"), "out_idx")
    once = T.words_once(words.repartition("doc", "page_idx"))  # all that follows goes by page
    sizes = OG.page_sizes(OG.with_document(geometry, items)).where("imwidth > 0").select("doc", "page_idx", "ppi", F.col("width").alias("page_width"), F.col("height").alias("page_height"), "warnings")
    base = stored(kept.join(sizes, ["doc", "page_idx"]), "pages")
    content = T.page_streams(T.placed_words(once, base.select("doc", "page_idx", "ppi", F.col("page_height").alias("height"))), options.visible_text)
    out = base.drop("ppi").join(content, ["doc", "page_idx"], "left")
    render = None
    if options.mode == "mrc":
        source = rasters.withColumnsRenamed({"height": "raster_height", "width": "raster_width"}).drop("boxes", "dpi")
        at = ["doc", "out_idx"] if options.from_pdf else ["doc", "page_idx"]
        if options.from_pdf:
            source = source.withColumnRenamed("page_idx", "out_idx")
        resolution = geometry.groupBy("doc", "page_idx").agg(F.max("dpi").alias("dpi"))
        out = out.join(text_boxes(once, geometry), ["doc", "page_idx"], "left").join(resolution, ["doc", "page_idx"], "left")
        if options.hq_pages:
            counts = base.groupBy("doc").agg(F.count("*").cast("int").alias("pages"))
            hq = S.hq_pages(counts, options.hq_pages).select("doc", F.col("page_idx").alias("out_idx"), F.lit(True).alias("hq"))
            out = out.join(hq, ["doc", "out_idx"], "left")
        else:
            out = out.withColumn("hq", F.lit(False))
        out = out.join(source, at, "left")

        def render(rows):
            return batch_layers(rows, options)
    else:

        def render(rows):
            return (({}, 0, list(r.warnings) if hasattr(r.warnings, "__len__") else []) for r in rows)

    toc = S.table_of_contents(pages).groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "level", "title", "accessible_page"))), lambda x: F.struct(x["level"].alias("level"), x["title"].alias("title"), x["accessible_page"].alias("page"))).alias("toc"))
    labels = S.label_dictionary(S.label_bounds(pages.where(~S.is_skipped(F.col("add_to_access"))).select("doc", "idx", F.col("page_number").alias("label")), options.strict_labels))
    named = stored(items.select("doc", "title").dropDuplicates(["doc"]).join(toc, "doc", "left").join(labels, "doc", "left"), "documents")
    pages.unpersist()
    ready = out.withColumnsRenamed({"page_width": "width", "page_height": "height"}).drop("page_idx").withColumnRenamed("out_idx", "page_idx")
    keys = base.select("doc", F.col("out_idx").alias("page_idx"))
    return reported_parts(ready, named, options.language, keys=keys, render=render, meta=options.meta, conforming=not options.visible_text)
