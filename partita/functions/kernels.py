"""Numeric kernels on small rasters and descriptor sets, for use in Arrow UDFs. Rasters are (values, mask) arrays of one shape."""

from __future__ import annotations

import numpy as np


def shifted(a: np.ndarray, b: np.ndarray, dx: int, dy: int) -> tuple[np.ndarray, np.ndarray]:
    """The parts of a and of b that overlap when b is moved by (dx, dy)."""
    h, w = a.shape
    ay, by = slice(max(0, dy), min(h, h + dy)), slice(max(0, -dy), min(h, h - dy))
    ax, bx = slice(max(0, dx), min(w, w + dx)), slice(max(0, -dx), min(w, w - dx))
    return a[ay, ax], b[by, bx]


def transforms(a: np.ndarray) -> list[np.ndarray]:
    """As it is, left-right, up-down."""
    return [a, a[:, ::-1], a[::-1, :]]


def masked_similarity(a, ma, b, mb, dx: int = 0, dy: int = 0, least: float = 0.05) -> tuple[float, float]:
    """(score, overlap): 0.62 * correlation from 0 to 1 + 0.38 * (1 - mean difference) over both masks; 0 under `least` of overlap."""
    x, y = shifted(a, b, dx, dy)
    p, q = shifted(ma.astype(bool), mb.astype(bool), dx, dy)
    both, either = p & q, max(1, min(int(ma.sum()), int(mb.sum())))
    overlap = float(both.sum()) / either
    if both.sum() < 4 or overlap < least:
        return 0.0, overlap
    u, v = x[both].astype(np.float64), y[both].astype(np.float64)
    du, dv = u - u.mean(), v - v.mean()
    size = np.sqrt((du @ du) * (dv @ dv))
    corr = float(du @ dv / size) if size > 1e-12 else 0.0
    return 0.62 * (corr + 1) / 2 + 0.38 * (1 - min(1.0, float(np.abs(u - v).mean()))), overlap


def template_match(a, ma, b, mb, shifts=(-2, -1, 0, 1, 2), flips: bool = True) -> tuple[float, int, int, int]:
    """(score, transform, dx, dy): the best over transforms and shifts; of equal scores the first."""
    best = (-1.0, 0, 0, 0)
    pairs = list(zip(transforms(b), transforms(mb), strict=True))[: 3 if flips else 1]
    for t, (x, m) in enumerate(pairs):
        for dy in shifts:
            for dx in shifts:
                s, _ = masked_similarity(a, ma, x, m, dx, dy)
                if s > best[0]:
                    best = (s, t, dx, dy)
    return best


def phase_shift(a: np.ndarray, b: np.ndarray, most: int = 18) -> tuple[int, int]:
    """(dx, dy) by which b is moved against a, by phase correlation, clipped to most."""
    f = np.fft.fft2(a) * np.conj(np.fft.fft2(b))
    r = np.real(np.fft.ifft2(f / np.maximum(np.abs(f), 1e-12)))
    y, x = np.unravel_index(int(np.argmax(r)), r.shape)
    dy, dx = (int(v - n) if v > n // 2 else int(v) for v, n in ((y, r.shape[0]), (x, r.shape[1])))
    return int(np.clip(dx, -most, most)), int(np.clip(dy, -most, most))


def sharpness(a: np.ndarray, mask: np.ndarray) -> float:
    """Variance of the Laplacian within the mask."""
    lap = np.zeros(a.shape)
    lap[1:-1, 1:-1] = a[:-2, 1:-1] + a[2:, 1:-1] + a[1:-1, :-2] + a[1:-1, 2:] - 4 * a[1:-1, 1:-1]
    return float(lap[mask.astype(bool)].var()) if mask.any() else 0.0


def stack_gain(a, ma, b, mb, dx: int = 0, dy: int = 0) -> float:
    """Sharpness of the mean of two aligned rasters over the mean of theirs, from 0 to 1 (1.35 times: 1)."""
    x, y = shifted(np.asarray(a, np.float64), np.asarray(b, np.float64), dx, dy)
    p, q = shifted(ma.astype(bool), mb.astype(bool), dx, dy)
    both = p & q
    base = (sharpness(x, both) + sharpness(y, both)) / 2
    return float(np.clip(sharpness((x + y) / 2, both) / base, 0, 1.35) / 1.35) if base > 1e-12 else 0.0


def mutual_matches(a: np.ndarray, b: np.ndarray, floor: float = 0.72) -> list[tuple[int, int, float]]:
    """Descriptor pairs that are each other's nearest by cosine and reach the floor."""
    if not len(a) or not len(b):
        return []
    a, b = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) for x in (np.asarray(a, np.float64), np.asarray(b, np.float64)))
    s = a @ b.T
    j, i = s.argmax(axis=1), s.argmax(axis=0)
    return [(k, int(j[k]), float(s[k, j[k]])) for k in range(len(a)) if i[j[k]] == k and s[k, j[k]] >= floor]
