"""Decomposition of page rasters into a mask, a foreground and a background."""

from __future__ import annotations

import time

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from folio.operators import kernels as K

DENOISE = ("none", "fast", "bregman")
TOO_SMALL = "too-small-to-downsample"
LINE_K = 0.1
FILL_FOREGROUND, FILL_BACKGROUND = 3, 10


#: Which writing a box holds: (least and most share of dark, least and most share of light, whether light is the rarer
#: and quieter one, or None where that does not matter) -> choice.  The first row that holds decides.
CHOICES = (
    (0.3, 1.0, 0.3, 1.0, None, None),
    (0.0, 0.2, 0.2, 1.0, None, "dark"),
    (0.0, 1.0, 0.0, 0.3, True, "light"),
    (0.0, 0.2, 0.0, 1.0, None, "dark"),
)
QUIET = 0.1


def line_mask(gray: np.ndarray, boxes: list[tuple[int, int, int, int]], dpi: int | None) -> np.ndarray:
    """Mask of the text in the boxes (x0, y0, x1, y1); dark and light writing are told apart by CHOICES; later boxes win."""
    out = np.zeros(gray.shape, bool)
    window = K.window_for(dpi)
    cut = [(*slice(y0, y1).indices(gray.shape[0])[:2], *slice(x0, x1).indices(gray.shape[1])[:2]) for x0, y0, x1, y1 in boxes]
    cut = [c for c in cut if c[0] < c[1] and c[2] < c[3]]
    for (y0, y1, x0, x1), (on_light, on_dark, a, b) in zip(cut, K.boxed_sauvola(gray, cut, window, LINE_K)):
        made = {"dark": on_light, "light": on_dark}

        def quieter() -> bool:
            if b >= a:
                return False
            s, t = (K.noise_level(made[k].astype(float)) for k in ("dark", "light"))
            return t < s or max(s, t) < QUIET

        choice = next((c for low, high, low2, high2, quiet, c in CHOICES if _within(a, low, high) and _within(b, low2, high2) and (quiet is None or quieter())), None)
        if choice:
            out[y0:y1, x0:x1] = made[choice]
    return out


def _within(share: float, low: float, high: float) -> bool:
    """low itself belongs to what lies above 0.3 and not to what lies above 0.2; no upper end belongs, but for 1."""
    return (share >= low if low in (0.0, 0.3) else share > low) and (share < high or high == 1.0)


FORM_BITONAL, FORM_FORCED, FORM_LAYERS = "bitonal", "forced", "layers"


def page_form(image: np.ndarray, force_bitonal: bool = False) -> str:
    """How a page is written: one of one bit as it is, else as the inverse of its mask where that is asked for, else in layers."""
    return FORM_BITONAL if image.dtype == bool else FORM_FORCED if force_bitonal else FORM_LAYERS


def threshold_mask(gray: np.ndarray, dpi: int | None) -> np.ndarray:
    """Mask of the whole page, blurred first by a tenth of its noise where that is above 1."""
    sigma = K.page_noise_level(gray)
    v = np.clip(K.gaussian(gray, 0.1 * sigma), 0, 255).astype(np.uint8) if sigma > 1 else gray
    return K.sauvola(v, K.window_for(dpi))


def page_mask(image: np.ndarray, boxes: list, dpi: int | None = None, denoise: str = "fast", timed=lambda key, f, *args: f(*args)) -> np.ndarray:
    """Where a page has writing: in its boxes or by the threshold of the whole page, without specks."""
    if denoise not in DENOISE:
        raise ValueError(f"denoise must be one of {DENOISE}")
    gray = timed("grey_conversion", K.gray_of, image)
    mask = timed("hocr_mask_gen", line_mask, gray, boxes, dpi)
    mask = mask | timed("threshold", threshold_mask, gray, dpi)
    if denoise == "fast":
        return timed("fast_denoise", K.denoise, mask)
    return timed("denoise", K.total_variation, mask) if denoise == "bregman" else mask


def page_layers(mask: np.ndarray, image: np.ndarray, fg_downsample: int | None = None, bg_downsample: int | None = None, timed=lambda key, f, *args: f(*args), filled: tuple[np.ndarray, np.ndarray] | None = None) -> dict:
    """foreground, background and warnings of a page with its mask; filled: both in full size, where they have been made."""
    layers, warnings = {}, []
    for k, (name, m, n, factor) in enumerate((("fg", mask, FILL_FOREGROUND, fg_downsample), ("bg", ~mask, FILL_BACKGROUND, bg_downsample))):
        layer = filled[k] if filled else timed(f"{name}_partial_blur", K.fill, m, image, n)
        if factor and factor > 1:
            small = timed(f"{name}_downsample", K.shrink, layer, factor)
            if small is None:
                warnings.append(TOO_SMALL)
            else:
                layer = small
        layers[name] = layer
    return {"mask": mask, "foreground": layers["fg"], "background": layers["bg"], "warnings": sorted(set(warnings))}


def filled_layers(masks: list[np.ndarray], images: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Foreground and background in full size; grey pages of one size are filled side by side."""
    out: list = [None] * len(images)
    alike: dict[tuple, list[int]] = {}
    for k, v in enumerate(images):
        alike.setdefault(v.shape if v.ndim == 2 else (k,), []).append(k)
    for own in alike.values():
        if images[own[0]].ndim == 2:
            m, v = np.stack([masks[k] for k in own]), np.stack([images[k] for k in own])
            both = zip(K.fill_all(m, v, FILL_FOREGROUND), K.fill_all(~m, v, FILL_BACKGROUND))
        else:
            both = [(K.fill(masks[k], images[k], FILL_FOREGROUND), K.fill(~masks[k], images[k], FILL_BACKGROUND)) for k in own]
        for k, x in zip(own, both):
            out[k] = x
    return out


def decompose(image: np.ndarray, boxes: list, dpi: int | None = None, denoise: str = "fast", fg_downsample: int | None = None, bg_downsample: int | None = None) -> dict:
    """mask, foreground, background (arrays), warnings and seconds of each step."""
    timing = []

    def timed(key: str, f, *args):
        at = time.perf_counter()
        out = f(*args)
        timing.append((key, time.perf_counter() - at))
        return out

    mask = page_mask(image, boxes, dpi, denoise, timed)
    return page_layers(mask, image, fg_downsample, bg_downsample, timed) | {"timing": timing}


SCHEMA = (
    "doc long, page_idx int, height int, width int, mask binary, fg_height int, fg_width int, foreground binary, bg_height int, bg_width int, background binary, "
    "warnings array<string>, timing array<struct<key:string,seconds:double>>"
)


def components(pages: DataFrame, denoise: str = "fast", fg_downsample: int | None = None, bg_downsample: int | None = None) -> DataFrame:
    """pages (doc, page_idx, height, width, channels, data binary, dpi, boxes array<struct<x0,y0,x1,y1>>) decomposed, a page a row.

    Layers are raw bytes; nothing is shuffled.  Rows with NULL data, or too little of it, are left out.
    """

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                n = int(r.channels or 1)
                if r.data is None or len(r.data) < r.height * r.width * n or not r.height or not r.width:
                    continue
                image = np.frombuffer(r.data, np.uint8)[: r.height * r.width * n].reshape(r.height, r.width, n)
                image = image[:, :, 0] if n == 1 else image
                boxes = [tuple(int(b[c]) for c in ("x0", "y0", "x1", "y1")) for b in (r.boxes if r.boxes is not None else ())]
                out = decompose(image, boxes, int(r.dpi) if r.dpi and r.dpi == r.dpi else None, denoise, fg_downsample, bg_downsample)
                fg, bg = out["foreground"], out["background"]
                rows.append((r.doc, r.page_idx, r.height, r.width, np.packbits(out["mask"], axis=1).tobytes(), *fg.shape[:2], fg.tobytes(), *bg.shape[:2], bg.tobytes(), out["warnings"], [{"key": k, "seconds": s} for k, s in out["timing"]]))
            yield pd.DataFrame(rows, columns=["doc", "page_idx", "height", "width", "mask", "fg_height", "fg_width", "foreground", "bg_height", "bg_width", "background", "warnings", "timing"])

    return pages.mapInPandas(run, SCHEMA)
