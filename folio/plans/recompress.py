"""Pictures of existing PDFs separated into layers, in their places, with the rest of the pages kept."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from folio.operators.mrc import decompose
from folio.sources import pdf

#: Least resolution of a picture that is unknown, and the factor of the background.
DPI, BG_DOWNSAMPLE = 72, 3


def without_pictures(content: str, labels: list[str]) -> str:
    """A page's commands without those that draw the pictures of these labels; the case of letters does not count."""
    drawn = "|".join(re.escape(x) for x in labels)
    return re.sub(rf"(?i)/(?:{drawn})\s+Do\b", "", content) if labels else content


def recompress(files: DataFrame, boxes: DataFrame | None = None, denoise: str = "fast", bg_downsample: int = BG_DOWNSAMPLE) -> DataFrame:
    """(doc, pdf) of files (doc, pdf), each picture replaced in its place by a background and a masked foreground.

    boxes: (doc, page_idx, boxes) of the text lines, page by page in the order of the document, in the pictures' pixels.
    A file is a row and stays one; pictures that cannot be read stay out, links and text stay; NULL files stay NULL.
    """
    rows = files.select("doc", "pdf")
    if boxes is not None:
        from pyspark.sql import functions as F

        own = boxes.groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("page_idx", "boxes"))).alias("boxes"))
        rows = rows.join(own, "doc", "left")

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                found = getattr(r, "boxes", None)
                out.append((r.doc, _document(bytes(r.pdf), found if isinstance(found, dict) else {}, denoise, bg_downsample) if r.pdf is not None else None))
            yield pd.DataFrame(out, columns=["doc", "pdf"])

    return rows.mapInPandas(run, "doc long, pdf binary")


def _document(data: bytes, boxes: dict, denoise: str, bg_downsample: int) -> bytes:
    reader = pdf.Reader(data)
    pages = []
    for p in reader.pages():
        layers = []
        for im in p["images"]:
            v = reader.pixels(im["xref"])
            if v is None:
                continue
            width = im["bbox"][2] - im["bbox"][0]
            v = v.astype(np.uint8) * 255 if v.dtype == bool else np.ascontiguousarray(v)
            own = [tuple(int(b[c]) for c in ("x0", "y0", "x1", "y1")) for b in boxes.get(p["page"], ())]
            made = decompose(v, own, round(im["width"] / width * 72) if width > 0 else DPI, denoise, None, bg_downsample)
            raw = lambda x: {"width": x.shape[1], "height": x.shape[0], "data": x.tobytes(), "components": x.shape[2] if x.ndim == 3 else 1}
            mask = made["mask"]
            layers.append({**raw(made["background"]), "bbox": im["bbox"]})
            layers.append({**raw(made["foreground"]), "bbox": im["bbox"], "mask": {"width": mask.shape[1], "height": mask.shape[0], "data": np.packbits(mask, axis=1).tobytes(), "bits": 1}})
        box = p["rect"]
        pages.append({"width": box[2] - box[0], "height": box[3] - box[1], "content": without_pictures(p["content"], [im["label"] for im in p["images"]]), "images": layers, "links": p["links"]})
    return pdf.build(pages, reader.title())
