"""Dense kernels against loops written pixel by pixel."""

import numpy as np
import pytest

from folio.operators import kernels as K
from folio.operators.mrc import decompose


def slow_sauvola(gray, window, k):
    h, w = gray.shape
    r = window // 2
    out = np.zeros((h, w), bool)
    for y in range(h):
        for x in range(w):
            box = gray[max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1].astype(int)
            mean = int(box.sum()) // box.size
            var = int((box**2).sum()) // box.size - mean * mean
            t = int(gray[y, x]) + mean * (k - 1)
            out[y, x] = t <= 0 or t * t <= mean * mean * (k * k / 128**2) * var
    return out


def slow_fill(mask, image, n):
    h, w = image.shape
    out = image.astype(int).copy()
    for y in range(h):
        for x in range(w):
            if mask[y, x]:
                continue
            total = count = 0
            for j in range(max(0, y - n), min(h, y + n)):
                for i in range(max(0, x - n), min(w, x + n)):
                    if mask[j, i]:
                        total, count = total + int(image[j, i]), count + 1
            for j in range(max(0, y - n), y):
                for i in range(max(0, x - n), x):
                    total, count = total + out[j, i], count + 1
            out[y, x] = total // count if count else 0
    return out.astype(np.uint8)


def slow_denoise(mask, least, n):
    out = mask.copy()
    h, w = mask.shape
    for y in range(n, h - n):
        for x in range(n, w - n):
            if out[y, x] and out[y - n : y + n + 1, x - n : x + n + 1].sum() - 1 < least:
                out[y, x] = False
    return out


@pytest.mark.parametrize("seed", range(6))
def test_sauvola_fill_denoise(seed):
    rng = np.random.default_rng(seed)
    shape = rng.integers(1, 28, 2)
    gray = rng.integers(0, 256, shape, dtype=np.uint8)
    mask = rng.random(shape) < rng.random()
    for window, k in ((3, 0.34), (15, 0.1)):
        assert (K.sauvola(gray, window, k) == slow_sauvola(gray, window, k)).all()
    for n in (1, 3, 10):
        assert (K.fill(mask, gray, n) == slow_fill(mask, gray, n)).all()
    assert (K.denoise(mask) == slow_denoise(mask, 4, 2)).all()


def test_edges():
    one = np.array([[7]], np.uint8)
    assert not K.sauvola(one, 51).any() and K.sauvola(np.zeros((1, 1), np.uint8), 51).all()
    full, none = np.ones((4, 4), bool), np.zeros((4, 4), bool)
    image = np.arange(16, dtype=np.uint8).reshape(4, 4)
    assert (K.fill(full, image, 3) == image).all() and not K.fill(none, image, 3).any()
    assert (K.denoise(full) == full).all()
    assert K.window_for(None) == 51 and K.window_for(300) == 75 and K.window_for(400) == 101
    assert K.noise_level(one) == 0 and K.shrink(image, 5) is None


def test_noise_grows_with_noise():
    rng = np.random.default_rng(1)
    flat = np.full((64, 64), 128.0)
    levels = [K.noise_level(flat + rng.normal(0, s, flat.shape)) for s in (1, 4, 16)]
    assert levels == sorted(levels) and abs(levels[1] - 4) < 1


def test_blurs_keep_masked_pixels():
    rng = np.random.default_rng(2)
    image = rng.integers(0, 256, (20, 30), dtype=np.uint8)
    mask = rng.random((20, 30)) < 0.4
    for f in (K.partial_blur, K.partial_box_blur):
        assert (f(mask, image)[mask] == image[mask]).all()
    solid = np.zeros((20, 20), bool)
    solid[4:16, 4:16] = True
    assert (K.total_variation(solid) == solid).mean() > 0.9


def test_adaptive_gray_and_luma():
    rng = np.random.default_rng(3)
    image = rng.integers(0, 256, (8, 9, 3), dtype=np.uint8)
    assert K.adaptive_gray(image).shape == (8, 9) and K.gray_of(image)[0, 0] == (image[0, 0].astype(int) @ [299, 587, 114] + 500) // 1000


def test_decompose():
    page = np.full((60, 80), 235, np.uint8)
    page[20:26, 10:60] = 20
    out = decompose(page, [(5, 15, 70, 32)], 60, bg_downsample=3, fg_downsample=100)
    assert out["mask"][22, 30] and not out["mask"][50, 30]
    assert out["background"].shape == (20, 26) and out["warnings"] == ["too-small-to-downsample"]
    assert (out["foreground"][out["mask"]] == page[out["mask"]]).all()
    assert decompose(np.dstack([page] * 3), [], None)["background"].shape == (60, 80, 3)
    with pytest.raises(ValueError):
        decompose(page, [], denoise="x")
