"""Filters over stacks of tiles (n, height, width), and corner responses of the same shape.

Edges are continued by their own value; gradients are one-sided there.
"""

from __future__ import annotations

import numpy as np

from tessera.operators.spectral import window_sums


def padded(v: np.ndarray, r: int) -> np.ndarray:
    return np.pad(v, ((0, 0), (r, r), (r, r)), mode="edge")


def box(v: np.ndarray, r: int = 1) -> np.ndarray:
    return window_sums(padded(v, r), 2 * r + 1, 2 * r + 1)


def gradients(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Along y and x; one-sided at the edges."""
    return np.gradient(v, axis=1), np.gradient(v, axis=2)


def blurred(v: np.ndarray, sigma: float) -> np.ndarray:
    r = max(1, round(3 * sigma))
    g = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    g /= g.sum()
    p = padded(v, r)
    p = sum(w * p[:, i : i + v.shape[1]] for i, w in enumerate(g))
    return sum(w * p[:, :, i : i + v.shape[2]] for i, w in enumerate(g))


def structure(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    gy, gx = gradients(v)
    return box(gx * gx), box(gy * gy), box(gx * gy)


def harris(v: np.ndarray, k: float = 0.04) -> np.ndarray:
    xx, yy, xy = structure(v)
    return xx * yy - xy * xy - k * (xx + yy) ** 2


def min_eigen(v: np.ndarray) -> np.ndarray:
    xx, yy, xy = structure(v)
    return (xx + yy) / 2 - np.sqrt(((xx - yy) / 2) ** 2 + xy * xy)


def hessian_of(v: np.ndarray, weight: float = 0.9) -> np.ndarray:
    gy, gx = gradients(v)
    (yy, xy), xx = gradients(gy), gradients(gx)[1]
    return xx * yy - (weight * xy) ** 2


def hessian(v: np.ndarray) -> np.ndarray:
    """Determinant of the Hessian of the smoothed tile, the response that SURF approximates by boxes."""
    return hessian_of(box(v) / 9)


#: The circle of radius 3 around a pixel, as (x, y), clockwise from the top.
RING = [(0, -3), (1, -3), (2, -2), (3, -1), (3, 0), (3, 1), (2, 2), (1, 3), (0, 3), (-1, 3), (-2, 2), (-3, 1), (-3, 0), (-3, -1), (-2, -2), (-1, -3)]


def fast(v: np.ndarray, threshold: float = 0.1, arc: int = 9) -> np.ndarray:
    """Score of pixels with `arc` adjacent pixels of the circle all brighter or all darker by threshold."""
    pad = padded(v, 3)
    diff = np.stack([pad[:, 3 + y : 3 + y + v.shape[1], 3 + x : 3 + x + v.shape[2]] - v for x, y in RING])
    out = np.zeros_like(v)
    for sign in (1, -1):
        over = sign * diff > threshold
        twice = np.concatenate((over, over[: arc - 1]))
        run = np.stack([twice[i : i + arc].all(axis=0) for i in range(16)]).any(axis=0)
        out = np.maximum(out, np.where(run, np.where(over, np.abs(diff) - threshold, 0).sum(axis=0), 0))
    return out
