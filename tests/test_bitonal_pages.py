"""A page that is written in one bit has no other layers, so none are made."""

import numpy as np

from folio.operators import kernels as K
from folio.plans import recode as R
from test_side_by_side import row


def test_nothing_is_filled(monkeypatch):
    v = np.random.default_rng(1).integers(0, 256, (30, 40), dtype=np.uint8)
    mask = R.page_layers(row(v, 0), R.Options())[0]["mask"]
    for name in ("fill", "fill_all"):
        monkeypatch.setattr(K, name, None, raising=False)
    layers, size, _ = R.page_layers(row(v, 0), R.Options(bitonal=True))
    assert list(layers) == ["whole"] and size == v.size
    bits = [np.unpackbits(np.frombuffer(x.data, np.uint8).reshape(30, -1), axis=1)[:, :40] for x in (mask, layers["whole"])]
    assert (bits[0] == 1 - bits[1]).all()
