"""Correlation of tiles: normalised cross-correlation and phase correlation by numpy FFT, a whole Arrow batch of pairs at once.

Nulls, ties and odd sizes: a pair whose pixel array is null, of another length than height * width or holds a null gets null shift and correlation;
peaks are compared to 9 places and ties go to the first in column-major order; a correlation that is undefined (constant or too few pixels) is -1, in a
surface 0; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

EPS = np.finfo(float).eps


def window_sums(images: np.ndarray, height: int, width: int) -> np.ndarray:
    """Sums over all height x width windows of the last two axes, from running sums."""
    s = np.zeros((*images.shape[:-2], images.shape[-2] + 1, images.shape[-1] + 1))
    s[..., 1:, 1:] = images.cumsum(axis=-2).cumsum(axis=-1)
    return s[..., height:, width:] - s[..., :-height, width:] - s[..., height:, :-width] + s[..., :-height, :-width]


def normxcorr2(template: np.ndarray, search: np.ndarray) -> np.ndarray:
    """Correlation of each template with each whole placement in its search image (last two axes); 0 where either is constant."""
    th, tw = template.shape[-2:]
    t = template - template.mean(axis=(-2, -1), keepdims=True)
    s = search - search.mean(axis=(-2, -1), keepdims=True)
    shape = (s.shape[-2] + th, s.shape[-1] + tw)
    product = np.fft.irfft2(np.fft.rfft2(s, shape) * np.conj(np.fft.rfft2(t, shape)), shape)[..., : s.shape[-2] - th + 1, : s.shape[-1] - tw + 1]
    total, squares = window_sums(s, th, tw), window_sums(s * s, th, tw)
    spread = np.sqrt(np.maximum(squares - total * total / (th * tw), 0) * (t * t).sum(axis=(-2, -1))[..., None, None])
    return np.where(spread > 1e-12, product / np.where(spread > 1e-12, spread, 1), 0.0)


def first_peak(surface: np.ndarray) -> tuple[int, int]:
    """(row, column) of the maximum, the first in column-major order (to 9 places)."""
    at = int(np.round(surface, 9).T.argmax())
    return at % surface.shape[0], at // surface.shape[0]


def phase_correlation(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inverse transform of the cross-power spectrum, each bin divided by its size; an empty bin counts as 1. Over the last two axes."""
    cross = np.fft.fft2(a) * np.conj(np.fft.fft2(b))
    cross = np.where(cross == 0, EPS, cross)
    return np.real(np.fft.ifft2(cross / np.abs(cross)))


def subregion(image: np.ndarray, x: int, y: int) -> np.ndarray:
    """What stays inside the image when it is moved by (x, y); empty if nothing does."""
    h, w = image.shape
    if abs(x) >= w or abs(y) >= h:
        return image[:0, :0]
    return image[max(0, y) : h + min(0, y), max(0, x) : w + min(0, x)]


def shared(a: np.ndarray, b: np.ndarray, x: int, y: int) -> tuple[np.ndarray, np.ndarray]:
    """The pixels of a and of b that lie on each other when b is moved by (x, y); the images may differ in size."""
    r0, r1, c0, c1 = max(0, y), min(a.shape[0], b.shape[0] + y), max(0, x), min(a.shape[1], b.shape[1] + x)
    if r0 >= r1 or c0 >= c1:
        return a[:0, :0], b[:0, :0]
    return a[r0:r1, c0:c1], b[r0 - y : r1 - y, c0 - x : c1 - x]


def overlap_ncc(a: np.ndarray, b: np.ndarray, x: int, y: int) -> float:
    """Correlation of the overlap of a with b moved by (x, y); -1 where it is undefined."""
    p, q = shared(a, b, x, y)
    if p.size < 2:
        return -1.0
    p, q = p - p.mean(), q - q.mean()
    spread = np.sqrt((p * p).sum() * (q * q).sum())
    return float((p * q).sum() / spread) if spread > 1e-12 else -1.0


def disambiguate(a: np.ndarray, b: np.ndarray, row: int, col: int, direction: str) -> tuple[int, int, float]:
    """Of the eight shifts that a peak may stand for, the one whose overlap correlates best, the first of equals."""
    h, w = max(a.shape[0], b.shape[0]), max(a.shape[1], b.shape[1])
    places = [(x, y) for y in (row, h - row) for x in (col, w - col)]
    places += [(-x, y) for x, y in places] if direction == "north" else [(x, -y) for x, y in places]
    values = [round(overlap_ncc(a, b, x, y), 9) for x, y in places]
    best = int(np.argmax(values))
    return (*places[best], values[best])


def peak_shift(surface: np.ndarray, a: np.ndarray, b: np.ndarray, direction: str, peaks: int = 2) -> tuple[int, int, float]:
    """Shift (x, y) of b against a: the best of the surface's strongest peaks."""
    order = np.argsort(-np.round(surface, 9).T.ravel(), kind="stable")[:peaks]
    found = [disambiguate(a, b, int(p) % surface.shape[0], int(p) // surface.shape[0], direction) for p in order]
    return max(found, key=lambda x: x[2])


def pciam(a: np.ndarray, b: np.ndarray, direction: str, peaks: int = 2) -> tuple[int, int, float]:
    """Shift (x, y) of b against a by phase correlation."""
    return peak_shift(phase_correlation(a, b), a, b, direction, peaks)


def ncc_shifts(a: np.ndarray, b: np.ndarray, direction: str, overlap: float) -> list[tuple[int, int, float]]:
    """Shifts of pairs of one direction: the strip of b that should overlap is looked for in a somewhat wider strip of a."""
    (h, w), (hb, wb) = a.shape[1:], b.shape[1:]
    if direction == "north":
        top = max(0, h - round(h * (overlap + 0.1)))
        off, search, template = (0, top), a[:, top:], b[:, : max(1, round(hb * overlap))]
    else:
        left = max(0, w - round(w * (overlap + 0.1)))
        off, search, template = (left, 0), a[:, :, left:], b[:, :, : max(1, round(wb * overlap))]
    # of a larger tile only what fits is looked for
    surfaces = normxcorr2(template[:, : search.shape[1], : search.shape[2]], search)
    peaks = [first_peak(s) for s in surfaces]
    return [(c + off[0], r + off[1], float(s[r, c])) for s, (r, c) in zip(surfaces, peaks, strict=True)]


def shifts(sides: list[tuple[np.ndarray | None, np.ndarray | None]], directions: list[str], method: str, overlap: float) -> list[tuple[int, int, float] | None]:
    """Shift (x, y) and correlation of each pair of images, None where one is missing. Pairs of equal sizes and direction go through the transforms
    together; images of different sizes are filled with zeros to a common one for phase correlation only."""
    out: list[tuple[int, int, float] | None] = [None] * len(sides)
    kinds: dict[tuple, list[int]] = {}
    for i, ((a, b), d) in enumerate(zip(sides, directions, strict=True)):
        if a is not None and b is not None and a.size and b.size:
            kinds.setdefault((a.shape, b.shape, d), []).append(i)
    for (one, two, d), at in kinds.items():
        a, b = (np.stack([sides[i][n] for i in at]) for n in (0, 1))
        if method == "phase":
            h, w = max(one[0], two[0]), max(one[1], two[1])
            full = [np.pad(v, ((0, 0), (0, h - v.shape[1]), (0, w - v.shape[2]))) for v in (a, b)]
            got = [peak_shift(s, p, q, d) for s, p, q in zip(phase_correlation(*full), a, b, strict=True)]
        else:
            got = ncc_shifts(a, b, d, overlap)
        for i, g in zip(at, got, strict=True):
            out[i] = g
    return out


def stacked(arrays: list, height: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(which of the pixel arrays are whole, those as a stack of images)."""
    flat = [None if x is None or len(x) != height * width else np.asarray(x, float) for x in arrays]
    good = np.array([x is not None and np.isfinite(x).all() for x in flat], bool)
    return good, np.array([x for x, g in zip(flat, good, strict=True) if g]).reshape(-1, height, width)


def align(pairs: DataFrame, height: int, width: int, keys: str, method: str = "phase", overlap: float = 0.5) -> DataFrame:
    """(keys, tx, ty, ncc) of pairs with pixel arrays pa (of prev) and pb (of cur) and a direction."""
    names = [k.split()[0] for k in keys.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            whole = [tuple(stacked([p], height, width)[1] for p in (pa, pb)) for pa, pb in zip(x["pa"], x["pb"], strict=True)]
            good = np.array([len(a) == len(b) == 1 for a, b in whole], bool)
            got = shifts([(a[0], b[0]) if g else (None, None) for (a, b), g in zip(whole, good, strict=True)], x["direction"].tolist(), method, overlap)
            out = x[names].copy()
            for n, (column, kind) in enumerate((("tx", "Int32"), ("ty", "Int32"), ("ncc", "float64"))):
                values = np.full(len(x), None, object)
                values[good] = [None if g is None else round(g[n], 6) for g, ok in zip(got, good, strict=True) if ok]
                out[column] = pd.array(values, kind) if kind == "Int32" else pd.Series(values, out.index, dtype=kind)
            yield out

    return pairs.mapInPandas(run, f"{keys}, tx int, ty int, ncc double")
