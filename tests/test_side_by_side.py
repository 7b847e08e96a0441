"""Pages and boxes that are gone through side by side come out as one by one."""

from types import SimpleNamespace

import numpy as np

from folio.operators import kernels as K
from folio.plans import recode as R


def row(v, n, boxes=None):
    return SimpleNamespace(doc=1, page_idx=n, path=None, raster_height=v.shape[0], raster_width=v.shape[1], channels=1 if v.ndim == 2 else 3, data=v.tobytes(), boxes=boxes, imwidth=None, imheight=None, dpi=60, hq=False, warnings=[])


def pages(seed):
    rng = np.random.default_rng(seed)
    shapes = [(40, 50), (41, 50), (40, 50), (40, 50, 3), (1, 1), (40, 50)]
    return [row(rng.integers(0, 256, s, dtype=np.uint8), n, [{"x0": 3, "y0": 4, "x1": 30 + n, "y1": 20}, {"x0": 0, "y0": 19, "x1": 50, "y1": 60}]) for n, s in enumerate(shapes)]


def test_pages_and_boxes(monkeypatch):
    rows, options = pages(0), R.Options(bg_downsample=2)
    rows.insert(2, SimpleNamespace(**{**vars(rows[0]), "data": None, "warnings": ["x"]}))
    alone = [R.page_layers(r, options) for r in rows]
    assert list(R.batch_layers(iter(rows), options)) == alone and alone[2] == ({}, 0, ["x"])
    monkeypatch.setattr(R, "HELD_PIXELS", 3000)
    assert list(R.batch_layers(rows, options)) == alone
    gray = np.frombuffer(rows[0].data, np.uint8).reshape(40, 50)
    boxes = [(0, 5, 0, 50), (3, 4, 7, 8), (0, 40, 0, 50)]
    for small in (1, 10, 1 << 14):
        monkeypatch.setattr(K, "SMALL_BOX", small)
        for (y0, y1, x0, x1), (a, b, p, q) in zip(boxes, K.boxed_sauvola(gray, boxes, 15, 0.1)):
            crop = gray[y0:y1, x0:x1]
            assert (a == K.sauvola(crop, 15, 0.1)).all() and (b == K.sauvola(255 - crop, 15, 0.1)).all() and (p, q) == (a.mean(), b.mean())
