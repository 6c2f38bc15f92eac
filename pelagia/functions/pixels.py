"""Pixel kernels over stacks of images of one shape: arrays (n, height, width) of float64.

Borders: edge (aaa|abc), symmetric (cba|abc), reflect (cb|abc) and constant (zero).
"""

from __future__ import annotations

from functools import cache

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

EPS = 1e-7
#: A value this close below the edge of a bin or a threshold is on it: sums in another order give the same regions.
EDGE = 1e-9


def clean(x: np.ndarray) -> np.ndarray:
    """NaN and -inf become 0, +inf becomes 1, and everything is clipped to [0, 1]; a copy."""
    return np.clip(np.nan_to_num(np.asarray(x, float), nan=0.0, posinf=1.0, neginf=0.0), 0.0, 1.0)


def _per_image(f, x: np.ndarray) -> np.ndarray:
    return np.asarray(f(x.reshape(len(x), -1), axis=1)).reshape(-1, 1, 1)


def _odd(k: int) -> int:
    return k if k % 2 else k + 1


def _checked(k: int) -> int:
    if k < 3 or k % 2 == 0:
        raise ValueError(f"a window must be odd and at least 3, not {k}")
    return k


def windows(x: np.ndarray, k: int, border: str, kx: int | None = None) -> np.ndarray:
    """(n, height, width, k * kx): the neighbourhood of every pixel."""
    kx = kx or k
    p = np.pad(x, ((0, 0), (k // 2, k // 2), (kx // 2, kx // 2)), mode=border)
    return sliding_window_view(p, (k, kx), axis=(1, 2)).reshape(*x.shape, k * kx)


def _padded(x: np.ndarray, r: int, border: str) -> np.ndarray:
    """(height, width, n) with a border: the same pixel of all images lies together, so a shifted image is one long run."""
    return np.pad(np.ascontiguousarray(x.transpose(1, 2, 0)), ((r, r), (r, r), (0, 0)), mode=border)


@cache
def _network(n: int, ranks: tuple[int, ...]) -> list[tuple[int, int, bool, bool]]:
    """Batcher's merge exchange of n values, without the steps that those ranks do not need: (i, j, is the smaller needed, is
    the larger)."""
    steps, p = [], 1
    while p < n:
        k = p
        while k:
            for j in range(k % p, n - k, 2 * k):
                steps += [(i, i + k) for i in range(j, min(j + k, n - k)) if i // (2 * p) == (i + k) // (2 * p)]
            k //= 2
        p *= 2
    needed, out = set(ranks), []
    for i, j in reversed(steps):
        if i in needed or j in needed:
            out.append((i, j, i in needed, j in needed))
            needed |= {i, j}
    return out[::-1]


def ranked(values: list[np.ndarray], *ranks: int) -> list[np.ndarray]:
    """Elementwise the values of those ranks (0: the smallest) among arrays of one shape."""
    v = list(values)
    for i, j, low, high in _network(len(v), ranks):
        v[i], v[j] = np.minimum(v[i], v[j]) if low else None, np.maximum(v[i], v[j]) if high else None
    return [v[r] for r in ranks]


def _runs(x: np.ndarray, k: int) -> np.ndarray:
    """Sums of k neighbours down the first axis, put together from sums of 1, 2, 4 ..."""
    n, size, at, out = len(x) - k + 1, 1, 0, None
    while True:
        if k & size:
            out = x[at : at + n] if out is None else out + x[at : at + n]
            at += size
        if 2 * size > k:
            return out
        x, size = x[:-size] + x[size:], 2 * size


# --- intensity -----------------------------------------------------------------------------------------------------


def normalize_image(x: np.ndarray, target_min: float = 0.0, target_max: float = 1.0) -> np.ndarray:
    """Min-max to the target range; an image without range becomes target_min. +inf counts as target_max before scaling."""
    if not x.size:
        raise ValueError("an empty image")
    x = np.nan_to_num(np.asarray(x, float), nan=0.0, posinf=target_max, neginf=target_min)
    lo, hi = _per_image(np.min, x), _per_image(np.max, x)
    flat = hi - lo <= EPS
    return np.where(flat, target_min, target_min + (x - lo) / np.where(flat, 1.0, hi - lo) * (target_max - target_min))


def min_max_normalize(x: np.ndarray, target_min: float = 0.0, target_max: float = 1.0) -> np.ndarray:
    lo, hi = _per_image(np.min, x), _per_image(np.max, x)
    flat = hi == lo
    return np.where(flat, 0.0, target_min + (x - lo) / np.where(flat, 1.0, hi - lo) * (target_max - target_min))


def robust_min_max_normalize(x: np.ndarray, p_low: float = 1.0, p_high: float = 99.0, target_min: float = 0.0, target_max: float = 1.0) -> np.ndarray:
    lo, hi = (_per_image(lambda a, axis, p=p: np.percentile(a, p, axis=axis), x) for p in (p_low, p_high))
    flat = hi == lo
    return np.where(flat, 0.0, target_min + (np.clip(x, lo, hi) - lo) / np.where(flat, 1.0, hi - lo) * (target_max - target_min))


def z_score_normalize(x: np.ndarray) -> np.ndarray:
    mean, std = _per_image(np.mean, x), _per_image(np.std, x)
    return np.where(std == 0, 0.0, (x - mean) / np.where(std == 0, 1.0, std))


def stretch_contrast(x: np.ndarray, lower: float = 2.0, upper: float = 98.0) -> np.ndarray:
    if not 0 <= lower < upper <= 100:
        raise ValueError("percentiles must satisfy 0 <= lower < upper <= 100")
    x = clean(x)
    lo, hi = (_per_image(lambda a, axis, p=p: np.percentile(a, p, axis=axis), x) for p in (lower, upper))
    flat = hi - lo <= EPS
    return np.where(flat, x, (np.clip(x, lo, hi) - lo) / np.where(flat, 1.0, hi - lo))


def quantize(x: np.ndarray) -> np.ndarray:
    """8 bits, half to even."""
    return np.rint(clean(x) * 255)


def truncate(x: np.ndarray) -> np.ndarray:
    """8 bits, cut off."""
    return np.floor(clean(x) * 255)


def histogram_equalize(x: np.ndarray) -> np.ndarray:
    """Global equalisation of the 8-bit image, in [0, 1]."""
    out = []
    for q in quantize(x).astype(int):
        cdf = np.cumsum(np.bincount(q.ravel(), minlength=256))
        first = cdf[q.min()]
        out.append(q if first == q.size else np.rint(255 * (cdf - first) / (q.size - first))[q])
    return np.array(out, float) / 255


def clahe(x: np.ndarray, clip_limit: float = 2.0, tiles: tuple[int, int] = (8, 8)) -> np.ndarray:
    """Contrast-limited equalisation: clipped histograms of tiles, their maps blended bilinearly."""
    rows, cols = tiles
    out = []
    for q in quantize(x).astype(int):
        h, w = q.shape
        p = np.pad(q, ((0, -h % rows), (0, -w % cols)), mode="reflect" if min(h, w) > 1 else "edge")
        th, tw = p.shape[0] // rows, p.shape[1] // cols
        area = th * tw
        limit = max(int(clip_limit * area / 256), 1)
        maps = np.empty((rows, cols, 256))
        for i in range(rows):
            for j in range(cols):
                hist = np.bincount(p[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256)
                over = int(np.maximum(hist - limit, 0).sum())
                hist = np.minimum(hist, limit) + over // 256
                if rest := over % 256:
                    hist[:: max(256 // rest, 1)][:rest] += 1
                maps[i, j] = np.clip(np.rint(np.cumsum(hist) * (255 / area)), 0, 255)
        fy, fx = (np.arange(h) / th - 0.5)[:, None], (np.arange(w) / tw - 0.5)[None, :]
        y0, x0 = np.floor(fy).astype(int), np.floor(fx).astype(int)
        ay, ax = fy - y0, fx - x0
        at = lambda y, x: maps[np.clip(y, 0, rows - 1), np.clip(x, 0, cols - 1), q]  # noqa: B023, E731
        out.append(np.rint((at(y0, x0) * (1 - ax) + at(y0, x0 + 1) * ax) * (1 - ay) + (at(y0 + 1, x0) * (1 - ax) + at(y0 + 1, x0 + 1) * ax) * ay))
    return np.array(out) / 255


# --- geometry ------------------------------------------------------------------------------------------------------


def _area(src: int, dst: int) -> np.ndarray:
    edges = np.arange(dst + 1) * (src / dst)
    return np.clip(np.minimum(edges[1:, None], np.arange(1, src + 1)) - np.maximum(edges[:-1, None], np.arange(src)), 0, None) / (src / dst)


def _linear(src: int, dst: int) -> np.ndarray:
    at = np.clip((np.arange(dst) + 0.5) * src / dst - 0.5, 0, src - 1)
    low = np.minimum(at.astype(int), max(src - 2, 0))
    out = np.zeros((dst, src))
    out[np.arange(dst), low] = 1 - (at - low)
    if src > 1:
        out[np.arange(dst), low + 1] += at - low
    return out


def resize(x: np.ndarray, width: int, height: int) -> np.ndarray:
    """By area where a side shrinks, else bilinear."""
    if width <= 0 or height <= 0:
        raise ValueError("sizes must be positive")
    h, w = x.shape[1:]
    weights = _area if width < w or height < h else _linear
    return weights(h, height) @ x @ weights(w, width).T


def suppress_corner(x: np.ndarray, fraction: float = 0.4) -> np.ndarray:
    """Zero the top-left triangle (0, 0), (fraction * w, 0), (0, fraction * h)."""
    h, w = x.shape[1:]
    mh, mw = int(h * fraction), int(w * fraction)
    yy, xx = np.mgrid[:h, :w]
    return np.where(xx * mh + yy * mw <= mw * mh, 0.0, x)


def bounding_box(mask: np.ndarray, margin: int = 10) -> tuple[int, int, int, int]:
    """(top, bottom, left, right), ends exclusive; of an empty mask the whole image."""
    h, w = mask.shape
    ys, xs = np.nonzero(mask)
    if not len(ys):
        return 0, h, 0, w
    return max(ys.min() - margin, 0), min(ys.max() + margin + 1, h), max(xs.min() - margin, 0), min(xs.max() + margin + 1, w)


def otsu(values: np.ndarray) -> int:
    """The 8-bit threshold with the largest variance between what is at most it and what is above."""
    hist = np.bincount(values.astype(int).ravel(), minlength=256).astype(float)
    n, s = np.cumsum(hist), np.cumsum(hist * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (s[-1] * n - s * n[-1]) ** 2 / (n * (n[-1] - n))
    return int(np.argmax(np.nan_to_num(between, nan=-1, posinf=-1)))


def ellipse(k: int) -> np.ndarray:
    r = k // 2
    half = np.rint(r * np.sqrt(np.maximum(r * r - (np.arange(k) - r) ** 2, 0)) / max(r, 1)).astype(int)
    return np.abs(np.arange(k) - r)[None, :] <= half[:, None]


def dilate(mask: np.ndarray, shape: np.ndarray) -> np.ndarray:
    k = shape.shape[0] // 2
    p = np.pad(mask, k)
    return (sliding_window_view(p, shape.shape) & shape).any((2, 3))


def erode(mask: np.ndarray, shape: np.ndarray) -> np.ndarray:
    return ~dilate(~mask & True, shape)


def largest_component(mask: np.ndarray) -> np.ndarray:
    """The largest 8-connected part: runs of rows joined with overlapping runs of the row above."""
    parent: list[int] = []
    runs: list[tuple[int, int, int]] = []

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    above: list[int] = []
    for y, row in enumerate(mask):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], row.astype(np.int8), [0]])))
        here = []
        for a, z in zip(edge[::2], edge[1::2], strict=True):
            i = len(runs)
            runs.append((y, int(a), int(z)))
            parent.append(i)
            here.append(i)
            for j in above:
                if runs[j][1] <= z and a <= runs[j][2]:
                    p, q = sorted((find(i), find(j)))
                    parent[q] = p
        above = here
    if not runs:
        return np.ones_like(mask)
    sizes: dict[int, int] = {}
    for i, (_, a, z) in enumerate(runs):
        sizes[find(i)] = sizes.get(find(i), 0) + z - a
    best = max(sizes, key=lambda i: (sizes[i], -i))
    out = np.zeros_like(mask)
    for i, (y, a, z) in enumerate(runs):
        if find(i) == best:
            out[y, a:z] = True
    return out


def segment_breast(x: np.ndarray) -> np.ndarray:
    """1 where the breast is: Otsu, opening and closing by an ellipse, the largest component."""
    shape, out = ellipse(7), []
    for q in quantize(normalize_image(x)):
        m = q > otsu(q)
        for f in (erode, erode, dilate, dilate, dilate, dilate, erode, erode):
            m = f(m, shape)
        out.append(largest_component(m))
    return np.array(out, float)


# --- sharpening and filters ----------------------------------------------------------------------------------------


def gaussian_weights(k: int, sigma: float) -> np.ndarray:
    g = np.exp(-((np.arange(k) - k // 2) ** 2) / (2 * sigma * sigma))
    return g / g.sum()


def blur(x: np.ndarray, k: tuple[int, int] = (5, 5), sigma: float = 1.0) -> np.ndarray:
    kx, ky = _odd(k[0]), _odd(k[1])
    return windows(x, ky, "reflect" if min(x.shape[1:]) > 1 else "edge", kx) @ np.outer(gaussian_weights(ky, sigma), gaussian_weights(kx, sigma)).ravel()


def unsharp_mask(x: np.ndarray, amount: float = 1.0, sigma: float = 1.0, kernel_size: tuple[int, int] = (5, 5)) -> np.ndarray:
    x = clean(x)
    return np.clip(x + amount * (x - blur(x, kernel_size, sigma)), 0, 1)


def laplacian_sharpen(x: np.ndarray, strength: float = 0.5) -> np.ndarray:
    x = clean(x)
    return np.clip(x + strength * (windows(x, 3, "reflect") @ np.array([0, -1, 0, -1, 4, -1, 0, -1, 0.0])), 0, 1)


def denoise_median(x: np.ndarray, kernel_size: int = 5) -> np.ndarray:
    k, (rows, cols) = _checked(kernel_size), x.shape[1:]
    p = _padded(quantize(x).astype(np.uint8), k // 2, "edge")
    return ranked([p[dy : dy + rows, dx : dx + cols] for dy in range(k) for dx in range(k)], k * k // 2)[0].transpose(2, 0, 1) / 255


def denoise_gaussian(x: np.ndarray, kernel_size: tuple[int, int] = (5, 5), sigma: float = 1.0) -> np.ndarray:
    return np.clip(blur(clean(x), kernel_size, sigma), 0, 1)


def _wiener(x: np.ndarray, size: tuple[int, int], noise: float | None) -> np.ndarray:
    w = windows(x, size[0], "constant", size[1])
    m = w.mean(-1)
    s2 = (w * w).mean(-1) - m * m
    n = _per_image(np.mean, s2) if noise is None else noise
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(s2 < n, m, m + (1 - np.where(s2 == 0, 0, n / s2)) * (x - m))


def denoise_wiener(x: np.ndarray, size: tuple[int, int] = (5, 5), noise: float | None = None) -> np.ndarray:
    return np.clip(_wiener(clean(x), size, noise), 0, 1)


def denoise_bilateral(x: np.ndarray, d: int = 9, sigma_color: float = 75.0, sigma_space: float = 75.0) -> np.ndarray:
    x, r = clean(x), d // 2
    sc = sigma_color / 255 if sigma_color > 1 else sigma_color
    rows, cols = x.shape[1:]
    p = _padded(x, r, "reflect")
    mid = p[r : r + rows, r : r + cols]
    total, weights = np.zeros(mid.shape), np.zeros(mid.shape)
    for dy in range(-r, r + 1):
        for dx in range(-r, r + 1):
            far = dy * dy + dx * dx
            if far <= r * r:
                other = p[r + dy : r + dy + rows, r + dx : r + dx + cols]
                w = np.exp(-((other - mid) ** 2) / (2 * sc * sc)) * np.exp(-far / (2 * sigma_space**2))
                total += w * other
                weights += w
    return np.clip(total / weights, 0, 1).transpose(2, 0, 1)


def denoise_nlm(x: np.ndarray, h: float = 10.0, template: int = 7, search: int = 21) -> np.ndarray:
    """Non-local means of the 8-bit image; h of at most 1 is a share of 100."""
    h = h * 100 if h <= 1 else h
    q, t, s = quantize(x), template // 2, search // 2
    rows, cols = q.shape[1:]
    p = _padded(q, s + t, "reflect")
    # squares of a template are whole numbers, exact in single precision up to 2 ** 24
    small = p.astype(np.float32) if template * template * 255 * 255 < 1 << 24 else p
    mid = small[s : s + rows + 2 * t, s : s + cols + 2 * t]
    total, weights = np.zeros((rows, cols, len(q))), np.zeros((rows, cols, len(q)))
    for dy in range(search):
        for dx in range(search):
            sq = mid - small[dy : dy + rows + 2 * t, dx : dx + cols + 2 * t]
            sq *= sq
            sq = _runs(_runs(sq, template).swapaxes(0, 1), template).swapaxes(0, 1).astype(float)
            w = np.exp(-sq / (template * template) / (h * h))
            total += w * p[dy + t : dy + t + rows, dx + t : dx + t + cols]
            weights += w
    return (np.rint(total / weights) / 255).transpose(2, 0, 1)


def anscombe(x: np.ndarray) -> np.ndarray:
    return 2 * np.sqrt(np.maximum(x, 0) + 3 / 8)


def inverse_anscombe(y: np.ndarray) -> np.ndarray:
    return np.maximum((y / 2) ** 2 - 3 / 8, 0)


def denoise_anscombe_wiener(x: np.ndarray, scale: float = 255.0, size: tuple[int, int] = (5, 5), sigma: float = 1.0, compat: bool = False) -> np.ndarray:
    """Variance stabilisation around a Wiener filter. compat clips the filter's result to [0, 1], which the inverse maps to 0."""
    y = _wiener(anscombe(clean(x) * scale), size, sigma**2)
    return np.clip(inverse_anscombe(np.clip(y, 0, 1) if compat else y) / scale, 0, 1)


def denoise_adaptive_median(x: np.ndarray, max_window_size: int = 7) -> np.ndarray:
    x, r = clean(x), _checked(max_window_size) // 2
    rows, cols = x.shape[1:]
    p = _padded(x, r, "symmetric")
    out, flat, (_, wide, n) = np.empty((rows, cols, len(x))), p.ravel(), p.shape
    # where the pixels that no window has settled lie: in the result and in the padded images
    left = np.arange(out.size)
    at = (left // (cols * n) + r) * wide * n + left % (cols * n) + r * n
    for k in range(3, max_window_size + 1, 2):
        around = [(dy * wide + dx) * n for dy in range(-(k // 2), k // 2 + 1) for dx in range(-(k // 2), k // 2 + 1)]
        low, mid, high = ranked([flat[at + o] for o in around], 0, k * k // 2, k * k - 1)
        fits = (low < mid) & (mid < high)
        c = flat[at]
        out.ravel()[left] = np.where(fits & (low < c) & (c < high), c, mid)
        left, at = left[~fits], at[~fits]
        if not len(left):
            break
    return out.transpose(2, 0, 1)


def denoise_kuan(x: np.ndarray, window_size: int = 7, noise_var: float = 0.04, damping: float = 1.0) -> np.ndarray:
    x, noise_var = clean(x), max(noise_var, 1e-8)
    w = windows(x, _checked(window_size), "symmetric")
    m = w.mean(-1)
    s2 = np.maximum((w * w).mean(-1) - m * m, 1e-8)
    k = np.clip((1 - noise_var * m * m / s2) / (1 + noise_var), 0, 1)
    return np.clip(m + k * damping * (x - m), 0, 1)


# --- metrics: one value per image of two stacks --------------------------------------------------------------------


def _pair(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if a.shape != b.shape:
        raise ValueError("images differ in shape")
    fix = lambda x: np.nan_to_num(np.asarray(x, float), nan=0.0, posinf=1.0, neginf=0.0)
    return fix(a), fix(b)


def mse(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = _pair(a, b)
    return ((a - b) ** 2).mean((1, 2))


def mae(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = _pair(a, b)
    return np.abs(a - b).mean((1, 2))


def data_range(a: np.ndarray) -> np.ndarray:
    """1 for images within [-.05, 1.05], else the larger of 1 and their range."""
    lo, hi = a.min((1, 2)), a.max((1, 2))
    return np.where((lo >= -0.05) & (hi <= 1.05), 1.0, np.maximum(hi - lo, 1.0))


def psnr(a: np.ndarray, b: np.ndarray, range_: float | None = None) -> np.ndarray:
    a, b = _pair(a, b)
    r = data_range(a) if range_ is None else np.full(len(a), float(range_))
    if (r <= 0).any():
        raise ValueError("the data range must be positive")
    with np.errstate(divide="ignore"):
        return np.where((m := mse(a, b)) == 0, np.inf, 10 * np.log10(r * r / m))


def snr(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = _pair(a, b)
    s, n = (a * a).sum((1, 2)), ((a - b) ** 2).sum((1, 2))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n == 0, np.inf, np.where(s == 0, 0.0, 10 * np.log10(s / n)))


def ssim(a: np.ndarray, b: np.ndarray, range_: float | None = None, win_size: int | None = None) -> np.ndarray:
    """Uniform windows fully inside the image, sample covariances, K1 = .01 and K2 = .03."""
    a, b = _pair(a, b)
    side = min(a.shape[1:])
    k = win_size or (7 if side >= 7 else max(3, side - (side % 2 == 0)))
    r = data_range(a) if range_ is None else np.full(len(a), float(range_))
    u, v = (sliding_window_view(x, (k, k), axis=(1, 2)).reshape(len(a), -1, k * k) for x in (a, b))
    mu, mv, n = u.mean(-1), v.mean(-1), k * k
    vu, vv, uv = u.var(-1, ddof=1), v.var(-1, ddof=1), ((u * v).mean(-1) - mu * mv) * n / (n - 1)
    c1, c2 = ((0.01 * r) ** 2)[:, None], ((0.03 * r) ** 2)[:, None]
    s = ((2 * mu * mv + c1) * (2 * uv + c2)) / ((mu * mu + mv * mv + c1) * (vu + vv + c2))
    return np.where((a == b).all((1, 2)), 1.0, np.clip(s.mean(-1), -1, 1))


def entropy(x: np.ndarray, bins: int = 256) -> np.ndarray:
    x = np.nan_to_num(np.asarray(x, float), nan=0.0, posinf=1.0, neginf=0.0).reshape(len(x), -1)
    if not x.size:
        return np.zeros(len(x))
    lo, hi = x.min(1, keepdims=True), x.max(1, keepdims=True)
    flat = lo == hi
    at = np.minimum(np.floor((x - lo) / np.where(flat, 1.0, hi - lo) * bins + EDGE), bins - 1).astype(int)
    n = np.bincount((at + np.arange(len(x))[:, None] * bins).ravel(), minlength=len(x) * bins).reshape(len(x), bins)
    p = n / x.shape[1]
    return np.where(flat[:, 0], 0.0, -(p * np.log2(np.where(n > 0, p, 1.0))).sum(1))


def ring_regions(x: np.ndarray, mask: np.ndarray, background: np.ndarray | None = None, radius: int = 15, air: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """Masks of one image: the region, and its background: the given one without the region, else a ring of tissue
    around it, else all tissue outside, else all outside."""
    if mask.shape != x.shape or (background is not None and background.shape != x.shape):
        raise ValueError("mask and image differ in shape")
    roi = mask > 0
    if background is not None:
        return roi, (background > 0) & ~roi
    for bg in (dilate(roi, ellipse(2 * radius + 1)) & ~roi & (x > air), ~roi & (x > air), ~roi):
        if bg.any():
            break
    return roi, bg


def otsu_regions(x: np.ndarray, air: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """Masks of one image or of each of a stack: tissue at or above its Otsu threshold, and tissue below; without tissue the
    image, twice."""
    if x.ndim == 2:
        roi, bg = otsu_regions(x[None], air)
        return roi[0], bg[0]
    tissue = x > air
    some = tissue.any((1, 2))
    q = np.floor(np.clip(np.where(tissue, x, 0.0), 0, 1) * 255 + EDGE).astype(int) + np.arange(len(x))[:, None, None] * 256
    hist = np.bincount(q[tissue], minlength=len(x) * 256).reshape(len(x), 256).astype(float)
    n, s = np.cumsum(hist, 1), np.cumsum(hist * np.arange(256), 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (s[:, -1:] * n - s * n[:, -1:]) ** 2 / (n * (n[:, -1:] - n))
    t = np.argmax(np.nan_to_num(between, nan=-1, posinf=-1), 1) / 255
    lo, hi = np.where(tissue, x, np.inf).min((1, 2)), np.where(tissue, x, -np.inf).max((1, 2))
    above = lambda t: tissue & (x >= (t - EDGE)[:, None, None])
    below = lambda t: tissue & (x < (t - EDGE)[:, None, None])
    good = (lo + EDGE < t) & (t < hi - EDGE) & above(t).any((1, 2)) & below(t).any((1, 2))
    t = np.where(good, t, (np.where(some, lo, 0.0) + np.where(some, hi, 0.0)) / 2)
    none = ~some[:, None, None]
    return above(t) | none, below(t) | none


def _moments(x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, mean and variance of each image's pixels in its mask; 0 where there are none."""
    n = mask.sum((1, 2))
    some = np.maximum(n, 1)
    mean = np.where(mask, x, 0.0).sum((1, 2)) / some
    return n, mean, (np.where(mask, x - mean[:, None, None], 0.0) ** 2).sum((1, 2)) / some


def stack_cnr(x: np.ndarray, roi: np.ndarray, background: np.ndarray) -> np.ndarray:
    """cnr of each image of a stack, its regions as masks."""
    (n1, m1, v1), (n0, m0, v0) = _moments(x, roi), _moments(x, background)
    d = np.sqrt(v0 + v1)
    return np.where((n1 == 0) | (n0 == 0) | (d <= 1e-12), 0.0, np.abs(m1 - m0) / np.where(d <= 1e-12, 1.0, d))


def stack_contrast(x: np.ndarray, roi: np.ndarray, background: np.ndarray, eps: float = EPS) -> np.ndarray:
    """Michelson's contrast of each image of a stack, its regions as masks."""
    (n1, a, _), (n0, b, _) = _moments(x, roi), _moments(x, background)
    return np.where((n1 == 0) | (n0 == 0), 0.0, np.abs(a - b) / (a + b + eps))


def stack_cii(new: np.ndarray, old: np.ndarray, eps: float = EPS) -> np.ndarray:
    """cii of contrasts."""
    return np.where(old > eps, new / np.where(old > eps, old, 1.0), np.where(new <= eps, 1.0, new / eps))


def cnr(roi: np.ndarray, background: np.ndarray, definition: str = "standard") -> float:
    if not len(roi) or not len(background):
        return 0.0
    d = np.sqrt(background.var() + (roi.var() if definition == "standard" else 0.0))
    return 0.0 if d <= 1e-12 else float(abs(roi.mean() - background.mean()) / d)


def contrast(roi: np.ndarray, background: np.ndarray, method: str = "michelson", eps: float = EPS) -> float:
    if not len(roi) or not len(background):
        return 0.0
    a, b = roi.mean(), background.mean()
    return float(abs(a - b) / ((a + b if method == "michelson" else b) + eps))


def cii(roi: np.ndarray, background: np.ndarray, old_roi: np.ndarray, old_background: np.ndarray, method: str = "michelson", eps: float = EPS) -> float:
    new, old = contrast(roi, background, method, eps), contrast(old_roi, old_background, method, eps)
    return new / old if old > eps else 1.0 if new <= eps else new / eps
