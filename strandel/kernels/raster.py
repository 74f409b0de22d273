"""Raster kernels in numpy: thinning, labelling, distance, smoothing, sampling, background."""

from __future__ import annotations

import numpy as np

MAD_SCALE = 1.4826
#: The eight neighbours clockwise from the north.
RING = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]


def _around(mask: np.ndarray) -> list[np.ndarray]:
    padded, (h, w) = np.pad(mask, 1), mask.shape
    return [padded[1 + a : 1 + a + h, 1 + b : 1 + b + w] for a, b in RING]


def degree(mask: np.ndarray) -> np.ndarray:
    """Number of 8-neighbours of each set pixel, 0 elsewhere."""
    return np.where(mask, sum(p.astype(np.int16) for p in _around(mask)), 0)


def thin(mask: np.ndarray) -> np.ndarray:
    """One-pixel skeleton by the two-subiteration parallel thinning of Zhang and Suen (1984)."""
    out = np.asarray(mask, bool).copy()
    while True:
        before = out.sum()
        for first in (True, False):
            p = _around(out)
            count = sum(x.astype(np.int16) for x in p)
            turns = sum((~p[k] & p[(k + 1) % 8]).astype(np.int16) for k in range(8))
            n, e, s, w = p[0], p[2], p[4], p[6]
            open_ = (~(n & e & s) & ~(e & s & w)) if first else (~(n & e & w) & ~(n & s & w))
            out &= ~(out & (count >= 2) & (count <= 6) & (turns == 1) & open_)
        if out.sum() == before:
            return out


def least_of_parts(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each of `n` things the smallest one that it is joined to over the pairs (u, v)."""
    root = np.arange(n)
    while len(u):
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            break
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(root, up := root[root]):
            root = up
    return root


def label(mask: np.ndarray) -> np.ndarray:
    """8-connected labels from 1, in the order of their first pixel row by row.

    Works on runs of set pixels: two runs of neighbouring rows touch where they overlap by a corner.
    """
    mask = np.asarray(mask, bool)
    h, w = mask.shape
    step = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, start = np.nonzero(step == 1)
    stop = np.nonzero(step == -1)[1]
    wide = w + 2
    low = np.searchsorted(row * wide + stop, (row + 1) * wide + start, "left")
    high = np.searchsorted(row * wide + start, (row + 1) * wide + stop, "right")
    count = np.maximum(0, high - low)
    u = np.repeat(np.arange(len(row)), count)
    v = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
    number = np.unique(least_of_parts(len(row), u, v), return_inverse=True)[1].astype(np.int32) + 1
    out = np.zeros(mask.shape, np.int32)
    out[mask] = np.repeat(number, stop - start)
    return out


def dilate(mask: np.ndarray, times: int = 1, plus: bool = False) -> np.ndarray:
    """Grown by the 3 x 3 square, or by the plus."""
    for _ in range(times):
        near = _around(mask)
        mask = mask | np.logical_or.reduce(near[::2] if plus else near)
    return mask


def prune(skeleton: np.ndarray, most: int = 3, rounds: int = 20) -> np.ndarray:
    """Without pieces of at most `most` pixels that touch a junction and have a free end."""
    out = skeleton.copy()
    for _ in range(rounds):
        deg = degree(out)
        joint = out & (deg >= 3)
        pieces = label(out & ~joint)
        n = pieces.max() + 1
        size = np.bincount(pieces.ravel(), minlength=n)
        touch, free = np.zeros(n, bool), np.zeros(n, bool)
        touch[np.unique(pieces[dilate(joint)])] = True
        free[np.unique(pieces[out & (deg <= 1)])] = True
        doomed = (size <= most) & touch & free
        doomed[0] = False
        if not doomed.any():
            break
        out &= ~doomed[pieces]
    return out


def distance(sources: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Euclidean distance to the nearest set pixel and that pixel's row and column.

    Separable and exact: distances along columns first, then along each row the least of the lower
    envelope, evaluated for all columns of a row at once. Without sources the distance is infinite.
    """
    h, w = sources.shape
    rows = np.arange(h)[:, None]
    up = np.maximum.accumulate(np.where(sources, rows, -(10**7)), 0)
    down = np.minimum.accumulate(np.where(sources, rows, 10**7)[::-1], 0)[::-1]
    near = np.where(rows - up <= down - rows, up, down)
    gap = (near - rows).astype(float) ** 2
    cols = np.arange(w)
    square = (cols[:, None] - cols[None, :]).astype(float) ** 2
    best, at_r, at_c = np.empty((h, w)), np.empty((h, w), int), np.empty((h, w), int)
    for r in range(h):
        total = square + gap[r][None, :]
        k = total.argmin(1)
        best[r], at_r[r], at_c[r] = total[cols, k], near[r, k], k
    return np.where(best > 10**12, np.inf, np.sqrt(best)), at_r, at_c


def gaussian(image: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian blur, 4 sigma wide, edges mirrored with the edge pixel repeated."""
    half = int(4 * sigma + 0.5)
    taps = np.exp(-0.5 * (np.arange(-half, half + 1) / sigma) ** 2)
    taps /= taps.sum()
    out = np.asarray(image, float)
    for axis in (0, 1):
        wide = np.pad(out, [(half, half) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric")
        sums = np.cumsum(wide, axis) if half == 0 else None
        if sums is None:
            n = out.shape[axis]
            out = sum(t * np.take(wide, np.arange(k, k + n), axis) for k, t in enumerate(taps))
    return out


def gradient(image: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Size of the Sobel gradient of the blurred image."""
    p = np.pad(gaussian(image, sigma), 1, mode="symmetric")
    dx = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[1:-1, :-2] + p[2:, :-2])
    dy = (p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[:-2, 1:-1] + p[:-2, 2:])
    return np.hypot(dx, dy)


def sample(image: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Bilinear values, places held inside the image."""
    h, w = image.shape
    r, c = np.clip(rows, 0, h - 1), np.clip(cols, 0, w - 1)
    r0, c0 = np.minimum(r.astype(int), max(h - 2, 0)), np.minimum(c.astype(int), max(w - 2, 0))
    r1, c1, fr, fc = np.minimum(r0 + 1, h - 1), np.minimum(c0 + 1, w - 1), r - r0, c - c0
    return (image[r0, c0] * (1 - fc) + image[r0, c1] * fc) * (1 - fr) + (image[r1, c0] * (1 - fc) + image[r1, c1] * fc) * fr


def robust_sigma(values: np.ndarray) -> float:
    v = np.asarray(values, float)
    v = v[np.isfinite(v)]
    return float(MAD_SCALE * np.median(np.abs(v - np.median(v)))) if len(v) >= 2 else float("nan")


def background(image: np.ndarray, sigma: float = 24.0, share: float = 0.2, grow: int = 3, least: float = 0.02) -> tuple[np.ndarray, np.ndarray, float]:
    """Local level of the background, where it is trusted, and its noise.

    Pixels beyond `share` of the way from the 20th to the 99th percentile, grown a little, are left out."""
    low, high = np.percentile(image, [20, 99])
    front = dilate(image > low + share * max(1e-6, high - low), grow, plus=True)
    back = (~front).astype(float)
    weight = gaussian(back, sigma)
    sure = weight >= least
    rest = image[~front]
    level = float(np.median(rest)) if rest.size else float(low)
    return np.where(sure, gaussian(image * back, sigma) / np.maximum(weight, 1e-6), level), sure, robust_sigma(rest) if rest.size >= 8 else float("nan")
