"""Dense kernels on one page's raster, a row or a column at a time.

Gray rasters are (h, w) uint8, colour ones (h, w, 3); masks are (h, w) bool, True where there is writing.
"""

from __future__ import annotations

import heapq

import numpy as np


def _along(v: np.ndarray, axis: int, before: int, after: int) -> np.ndarray:
    """Sums over the places i-before .. i+after-1 of an axis, cut at its ends."""
    n = v.shape[axis]
    shape = list(v.shape)
    shape[axis] = n + 1
    c = np.zeros(shape, v.dtype)
    if axis == 0:  # whole rows, as numpy sums up along the last axis only at full speed
        for k in range(n):
            np.add(c[k], v[k], out=c[k + 1])
    else:
        np.cumsum(v, axis, out=c[(slice(None),) * axis + (slice(1, None),)])
    at = lambda a, b: (slice(None),) * axis + (slice(a, b),)
    out, m = np.empty_like(v), max(n - after, 0)
    out[at(0, m)] = c[at(after, after + m)]
    out[at(m, n)] = c[at(n, n + 1)]
    out[at(before, n)] -= c[at(0, max(n - before, 0))]
    return out


def _box(v: np.ndarray, up: int, down: int, left: int, right: int) -> np.ndarray:
    """Sums over rows y-up .. y+down-1 and columns x-left .. x+right-1, cut at the edges."""
    return _along(_along(v, 0, up, down), 1, left, right)


def _cells(n: int, before: int, after: int) -> np.ndarray:
    """How many places _along sums up."""
    i = np.arange(n)
    return np.minimum(i + after, n) - np.maximum(i - before, 0)


def summed(v: np.ndarray) -> np.ndarray:
    """Sums of all above and to the left, in doubles, which are exact for whole numbers below 2^53."""
    out = np.zeros((v.shape[0] + 1, v.shape[1] + 1))
    out[1:, 1:] = v.cumsum(0, dtype=float).cumsum(1)
    return out


def window_for(dpi: int | None) -> int:
    """Side of the threshold window: a quarter inch, odd; 51 where the resolution is not known."""
    if not dpi:
        return 51
    n = int(dpi / 4)
    return n + 1 - n % 2


def sauvola(gray: np.ndarray, window: int = 51, k: float = 0.34, r: float = 128.0) -> np.ndarray:
    """True where a pixel is dark against the mean and spread of its window (whole-number mean and variance)."""
    h, w = gray.shape
    up, down = window_reach(window)
    size = np.outer(_cells(h, up, down), _cells(w, up, down)).astype(float)
    v = gray.astype(np.int64)
    return dark(gray.astype(float), _box(v, up, down, up, down), _box(v * v, up, down, up, down), size, k, r)


def window_reach(window: int) -> tuple[int, int]:
    """Places before a pixel, and from it on, that are in its window."""
    half = window // 2
    return (half if window % 2 else half - 1), half + 1


def dark(v: np.ndarray, total: np.ndarray, squares: np.ndarray, size: np.ndarray, k: float, r: float = 128.0) -> np.ndarray:
    """sauvola's decision from the sums of the windows, all in doubles: whole numbers this small are divided exactly enough to be cut off."""
    mean = np.floor(total / size)
    var = np.floor(squares / size) - mean * mean
    t = v + mean * (k - 1)
    bound = mean**2 * (k * k / (r * r)) * var
    return (t <= 0) | (t * t <= bound) if k >= 0 else (t <= 0) & (t * t >= bound)


#: Boxes of up to so many pixels are gone through side by side, so many pixels at a time.
SMALL_BOX, BOX_PIXELS = 1 << 14, 1 << 17


def boxed_sauvola(gray: np.ndarray, boxes: list[tuple[int, int, int, int]], window: int, k: float) -> list[tuple[np.ndarray, np.ndarray, float, float]]:
    """sauvola of each box (y0, y1, x0, x1; none empty, all inside) for itself, and of its inverse, and the shares of both."""
    made: list = [None] * len(boxes)
    small, tables = [], None
    for n, (y0, y1, x0, x1) in enumerate(boxes):
        if (y1 - y0) * (x1 - x0) > SMALL_BOX:
            crop = gray[y0:y1, x0:x1]
            both = sauvola(crop, window, k), sauvola(255 - crop, window, k)
            made[n] = *both, *(float(q.mean()) for q in both)
        else:
            small.append(n)
    while small:
        sizes = np.cumsum([(boxes[n][1] - boxes[n][0]) * (boxes[n][3] - boxes[n][2]) for n in small])
        own, small = small[: (many := max(1, int(np.searchsorted(sizes, BOX_PIXELS, "right"))))], small[many:]
        tables = tables or (summed(gray), summed(gray.astype(float) ** 2))
        for n, x in zip(own, _boxed(gray, tables, np.array([boxes[n] for n in own]), window, k)):
            made[n] = x
    return made


def _boxed(gray: np.ndarray, tables: tuple[np.ndarray, np.ndarray], b: np.ndarray, window: int, k: float) -> list[tuple[np.ndarray, np.ndarray, float, float]]:
    up, down = window_reach(window)
    y0, y1, x0, x1 = b.T
    wide, size = x1 - x0, (y1 - y0) * (x1 - x0)
    ends = np.cumsum(size)
    of = np.repeat(np.arange(len(b)), size)
    at = np.arange(ends[-1]) - (ends - size)[of]
    dy, dx = np.divmod(at, wide[of])
    y, x = dy + y0[of], dx + x0[of]
    top, bottom = np.maximum(y - up, y0[of]), np.minimum(y + down, y1[of])
    left, right = np.maximum(x - up, x0[of]), np.minimum(x + down, x1[of])
    w = gray.shape[1] + 1
    corners = [bottom * w + right, top * w + right, bottom * w + left, top * w + left]
    total, squares = ((p := t.ravel())[corners[0]] - p[corners[1]] - p[corners[2]] + p[corners[3]] for t in tables)
    n = ((bottom - top) * (right - left)).astype(float)
    v = gray[y, x].astype(float)
    a = dark(v, total, squares, n, k)
    c = dark(255 - v, 255 * n - total, 65025 * n - 510 * total + squares, n, k)
    ones = [(np.add.reduceat(q, ends - size, dtype=np.int64) / size).tolist() for q in (a, c)]
    return [(a[e - s : e].reshape(-1, m), c[e - s : e].reshape(-1, m), p, q) for e, s, m, p, q in zip(ends.tolist(), size.tolist(), wide.tolist(), *ones)]


def fill(mask: np.ndarray, image: np.ndarray, n: int) -> np.ndarray:
    """Where mask is False, the mean of the masked pixels around and of what was filled in the rows above.

    Masked pixels count in rows y-n .. y+n-1 and columns x-n .. x+n-1; filled rows y-n .. y-1 in columns x-n .. x-1
    count once more, masked pixels included.  Each row needs only rows above it, so it is one step.
    """
    if image.ndim == 3:
        return np.moveaxis(fill_all(np.broadcast_to(mask, (image.shape[2], *mask.shape)), np.moveaxis(image, 2, 0), n), 0, 2)
    return fill_all(mask[None], image[None], n)[0]


def fill_all(masks: np.ndarray, images: np.ndarray, n: int) -> np.ndarray:
    """fill of pictures of one size (k, h, w), side by side: a step is a row of them all."""
    many, h, w = images.shape
    kind = np.float32 if 255 * 6 * n * n < 1 << 24 else np.float64  # holds the sums of a pixel exactly
    m = np.ascontiguousarray(masks.astype(bool).swapaxes(0, 1))
    v = np.ascontiguousarray(images.swapaxes(0, 1))
    whole = np.int32 if 255 * max(h, 2 * n * w) < 1 << 31 else np.int64
    box = lambda q: _along(_along(q.astype(whole), 0, n, n), 2, n, n)
    total, count = box(np.where(m, v, 0)), box(m)
    y, x = np.arange(h), np.arange(w)
    count += np.outer(y - np.maximum(y - n, 0), x - np.maximum(x - n, 0)).astype(whole)[:, None, :]
    count = np.maximum(count, 1).astype(kind)  # nothing to count is nothing to sum up
    out = np.empty((h, many, w), np.uint8)
    rows = np.zeros((many, w), whole)  # sums of the last n finished rows
    across = np.zeros((many, w + 1), whole)
    mean = np.empty((many, w), kind)
    for k in range(h):
        np.cumsum(rows, 1, out=across[:, 1:])
        own = total[k]
        own += across[:, :w]
        own[:, n:] -= across[:, : max(w - n, 0)]
        np.divide(own, count[k], out=mean, casting="unsafe", dtype=kind)
        np.copyto(mean, v[k], where=m[k])
        out[k] = mean  # cut off
        rows += out[k]
        if k >= n:
            rows -= out[k - n]
    return np.ascontiguousarray(out.swapaxes(0, 1))


def denoise(mask: np.ndarray, least: int = 4, n: int = 2) -> np.ndarray:
    """mask without pixels that have fewer than least others in their box, in reading order, each seeing what went before.

    Pixels nearer than n to an edge stay.
    """
    h, w = mask.shape
    out = mask.astype(bool).copy()
    if h < 2 * n + 1 or w < 2 * n + 1:
        return out
    count = _box(out.astype(np.int32), n, n + 1, n, n + 1) - 1
    inner = np.zeros_like(out)
    inner[n : h - n, n : w - n] = True
    heap = np.flatnonzero((out & inner & (count < least)).ravel()).tolist()
    heapq.heapify(heap)
    while heap:
        at = heapq.heappop(heap)
        y, x = divmod(at, w)
        if not out[y, x]:
            continue
        out[y, x] = False
        for j in range(max(y - n, 0), min(y + n + 1, h)):
            for i in range(max(x - n, 0), min(x + n + 1, w)):
                count[j, i] -= 1
                # only pixels still ahead in reading order can fall by it
                if out[j, i] and inner[j, i] and count[j, i] == least - 1 and j * w + i > at:
                    heapq.heappush(heap, j * w + i)
    return out


#: The high-pass filter of the Daubechies wavelet of two vanishing moments.
DB2 = np.array([-0.48296291314469025, 0.836516303737469, -0.22414386804185735, -0.12940952255092145])


def noise_level(gray: np.ndarray) -> float:
    """Noise as the median size of the diagonal wavelet detail over 0.67449; 0 where there is none."""
    v = gray.astype(float)
    if min(v.shape) < 2:
        return 0.0
    v = np.pad(v, 3, mode="symmetric")
    rows = sum(DB2[k] * v[:, k : v.shape[1] - 3 + k] for k in range(4))[:, 1::2]
    detail = np.abs(sum(DB2[k] * rows[k : rows.shape[0] - 3 + k] for k in range(4))[1::2])
    detail = detail[detail > 0]
    return float(np.median(detail) / 0.67448975019608171) if len(detail) else 0.0


def page_noise_level(gray: np.ndarray) -> float:
    """Noise of the middle half of a page, of all of it where that is too small."""
    h, w = gray.shape
    middle = gray[h // 2 - h // 4 : h // 2 + h // 4, w // 2 - w // 4 : w // 2 + w // 4]
    return noise_level(middle if min(middle.shape, default=0) >= 2 else gray)


def gaussian(v: np.ndarray, sigma: float) -> np.ndarray:
    """Separable Gaussian blur, mirrored at the edges, cut at four sigma."""
    if sigma <= 0:
        return v.astype(float)
    r = int(4 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return _separable(v.astype(float), k / k.sum(), r)


def _separable(v: np.ndarray, kernel: np.ndarray, r: int) -> np.ndarray:
    for axis in (0, 1):
        pad = [(0, 0)] * v.ndim
        pad[axis] = (r, r)
        p = np.pad(v, pad, mode="symmetric")
        n = v.shape[axis]
        v = sum(kernel[k] * np.take(p, np.arange(k, k + n), axis) for k in range(len(kernel)))
    return v


def partial_blur(mask: np.ndarray, image: np.ndarray, sigma: float = 5.0) -> np.ndarray:
    """Blur of the masked pixels alone, by their weights; masked pixels keep their values."""
    m = mask.astype(float)
    out = gaussian(image * m, sigma) / (gaussian(m, sigma) + 1e-5)
    return np.where(mask, image, np.clip(out, 0, 255)).astype(np.uint8)


def partial_box_blur(mask: np.ndarray, image: np.ndarray, size: int = 5) -> np.ndarray:
    r = size // 2
    m = mask.astype(float)
    kernel = np.full(2 * r + 1, 1 / (2 * r + 1))
    out = _separable(image * m, kernel, r) / (_separable(m, kernel, r) + 1e-5)
    return np.where(mask, image, np.clip(out, 0, 255)).astype(np.uint8)


def total_variation(mask: np.ndarray, weight: float = 1.0, rounds: int = 100, tol: float = 1e-4) -> np.ndarray:
    """mask smoothed by total variation (Chambolle's dual iteration), True above 0.4."""
    v = mask.astype(float)
    p = np.zeros((2, *v.shape))
    step, last = 0.25, None
    for _ in range(rounds):
        div = p.sum(0)
        div[1:] -= p[0, :-1]
        div[:, 1:] -= p[1, :, :-1]
        u = v + div
        g = np.zeros_like(p)
        g[0, :-1] = np.diff(u, axis=0)
        g[1, :, :-1] = np.diff(u, axis=1)
        norm = np.sqrt((g**2).sum(0))
        energy = ((div**2).sum() + weight * norm.sum()) / v.size
        p = (p + step * g) / (1 + step * norm / weight)
        p[0, -1] = 0
        p[1, :, -1] = 0
        if last is not None and abs(last - energy) < tol * max(last, 1e-12):
            break
        last = energy
    return u > 0.4


def gray_of(image: np.ndarray) -> np.ndarray:
    """Grey of a colour raster, in thousandths 299, 587 and 114."""
    if image.ndim == 2:
        return image
    v = image[:, :, :3].astype(np.int64)
    return ((v[:, :, 0] * 299 + v[:, :, 1] * 587 + v[:, :, 2] * 114 + 500) // 1000).astype(np.uint8)


def adaptive_gray(image: np.ndarray) -> np.ndarray:
    """Grey of a colour page with levels stretched by its brightness: V (1 - S/2) after the stretch."""
    v = image.astype(float) / 255
    low, mean, std = v.min((0, 1)), v.mean((0, 1)), v.std((0, 1))
    top = v[:, :, 2].max()
    bright = round(float(mean.prod() / (top * (1 - std).prod())), 4) if top > 0 else 0.0
    least = min(int(196 * low[0] + 14.5), 50)
    #: Slope and offset of each channel's upper level in per cent.
    upper = [min(int(a * bright + b), 95) for a, b in ((35.66, 48.5), (39.22, 44.5), (45.16, 36.5))]
    out = np.empty(image.shape, np.uint8)
    for c, high in enumerate(upper):
        a, b = least * 255 / 100, high * 255 / 100
        x = image[:, :, c].astype(float)
        out[:, :, c] = np.clip(np.where(x <= a, 0, np.where(x >= b, 255, (x - a) * 255 / (b - a))), 0, 255).astype(np.uint8)
    o = out.astype(float) / 255
    value = o.max(2)
    saturation = np.divide(value - o.min(2), value, out=np.zeros_like(value), where=value > 0)
    return (value * (1 - saturation / 2) * 255).astype(np.uint8)


def shrink(image: np.ndarray, factor: int) -> np.ndarray | None:
    """Means of factor x factor blocks, or None where a side would vanish."""
    h, w = image.shape[0] // factor, image.shape[1] // factor
    if not h or not w:
        return None
    v = image[: h * factor, : w * factor].astype(float)
    return v.reshape(h, factor, w, factor, *image.shape[2:]).mean((1, 3)).round().astype(np.uint8)
