"""Keypoints across scales of one image: SIFT (differences of Gaussians), SURF (box-filtered Hessians) and KAZE (Hessians after diffusion that stops at edges).

Each builds layers of responses, takes points that no neighbour in place or scale exceeds, fits a parabola around them for places between pixels and scales, gives
them the direction of their surroundings and a descriptor turned with it. Scores are responses of images from 0 to 1. Written from the methods' papers (Lowe 2004; Bay et
al. 2008; Alcantarilla et al. 2012); numbers are not meant to equal a library's.
"""

from __future__ import annotations

import numpy as np

from tessera.operators.corners import blurred, gradients
from tessera.operators.points import Points

SCALES, SIGMA = 3, 1.6


def neighbours_max(cube: np.ndarray) -> np.ndarray:
    """Maximum over each cell's 27 neighbours in a cube of layers, itself included; cells beyond the edge count as -inf."""
    for axis in range(3):
        p = np.pad(cube, [(1, 1) if a == axis else (0, 0) for a in range(3)], constant_values=-np.inf)
        n = cube.shape[axis]
        cube = np.maximum.reduce([np.take(p, np.arange(i, i + n), axis=axis) for i in range(3)])
    return cube


def peaks(cube: np.ndarray, least: float) -> np.ndarray:
    """(layer, row, column) of inner cells above `least` that no neighbour exceeds."""
    if min(cube.shape) < 3:
        return np.empty((0, 3), int)
    top = (cube > least) & (cube >= neighbours_max(cube))
    return np.argwhere(top[1:-1, 1:-1, 1:-1]) + 1


def refined(cube: np.ndarray, at: np.ndarray, rounds: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places, offsets, values, Hessians) of peaks by Newton's step on central differences; a step of more than half a cell moves the place, and a point that
    leaves the cube or doesn't settle is dropped."""
    at, alive = at.copy(), np.ones(len(at), bool)
    shape = np.array(cube.shape)
    for i in range(rounds + 1):
        s = lambda d, at=at: cube[tuple((at + d).T)]
        e = np.eye(3, dtype=int)
        g = np.stack([(s(e[k]) - s(-e[k])) / 2 for k in range(3)], axis=1)
        h = np.empty((len(at), 3, 3))
        for k in range(3):
            h[:, k, k] = s(e[k]) - 2 * s(0 * e[k]) + s(-e[k])
            for m in range(k):
                h[:, k, m] = h[:, m, k] = (s(e[k] + e[m]) - s(e[k] - e[m]) - s(e[m] - e[k]) + s(-e[k] - e[m])) / 4
        sound = np.abs(np.linalg.det(h)) > 1e-18
        off = np.zeros_like(g)
        off[sound] = -np.linalg.solve(h[sound], g[sound][..., None])[..., 0]
        far = np.abs(off).max(axis=1, initial=0) > 0.5
        if i == rounds or not far.any():
            break
        new = at + np.where(far[:, None], np.clip(np.rint(off), -1, 1).astype(int), 0)
        out = ((new < 1) | (new > shape - 2)).any(axis=1)
        alive &= ~out
        at = np.where(out[:, None], at, new)
    keep = alive & sound & (np.abs(off).max(axis=1, initial=0) <= 1)
    value = s(0 * e[0]) + (g * off).sum(axis=1) / 2
    return at[keep], off[keep], value[keep], h[keep]


def sampled(layer: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Values at places between pixels, bilinear; the edge's value beyond it."""
    y, x = np.clip(y, 0, layer.shape[0] - 1), np.clip(x, 0, layer.shape[1] - 1)
    r, c = np.minimum(y.astype(int), max(layer.shape[0] - 2, 0)), np.minimum(x.astype(int), max(layer.shape[1] - 2, 0))
    r1, c1 = np.minimum(r + 1, layer.shape[0] - 1), np.minimum(c + 1, layer.shape[1] - 1)
    fy, fx = y - r, x - c
    return (1 - fy) * ((1 - fx) * layer[r, c] + fx * layer[r, c1]) + fy * ((1 - fx) * layer[r1, c] + fx * layer[r1, c1])


def directions(gy: np.ndarray, gx: np.ndarray, y: float, x: float, sigma: float, share: float = 0.8) -> list[float]:
    """Directions of the gradients around a point: peaks of a smoothed histogram of 36 bins, weighed by size and nearness, of at least this share of the highest."""
    r = max(1, round(3 * sigma))
    rows = np.arange(max(0, round(y) - r), min(gy.shape[0], round(y) + r + 1))
    columns = np.arange(max(0, round(x) - r), min(gy.shape[1], round(x) + r + 1))
    a, b = gy[np.ix_(rows, columns)], gx[np.ix_(rows, columns)]
    weight = np.hypot(a, b) * np.exp(-((rows[:, None] - y) ** 2 + (columns - x) ** 2) / (2 * sigma * sigma))
    turn = np.arctan2(a, b) / (2 * np.pi) * 36
    low = np.floor(turn).astype(int)
    part = turn - low
    bins = np.bincount((low % 36).ravel(), (weight * (1 - part)).ravel(), 36) + np.bincount(((low + 1) % 36).ravel(), (weight * part).ravel(), 36)
    for _ in range(2):
        bins = (np.roll(bins, 1) + bins + np.roll(bins, -1)) / 3
    if bins.max() <= 1e-15:
        return [0.0]
    left, right = np.roll(bins, 1), np.roll(bins, -1)
    found = np.flatnonzero((bins > left) & (bins >= right) & (bins >= share * bins.max()))
    return [float((k + (left[k] - right[k]) / (2 * (left[k] - 2 * bins[k] + right[k]))) * 2 * np.pi / 36) for k in found] or [float(bins.argmax() * 2 * np.pi / 36)]


def turned(y: float, x: float, angle: float, step: float, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(u, v, rows, columns): an n x n net of this step around a point, turned by the angle; u and v in steps from the centre."""
    u, v = np.meshgrid(np.arange(n) - (n - 1) / 2, np.arange(n) - (n - 1) / 2)
    c, s = np.cos(angle) * step, np.sin(angle) * step
    return u, v, y + s * u + c * v, x + c * u - s * v


def unit(d: np.ndarray) -> np.ndarray:
    length = np.sqrt((d * d).sum())
    return d / length if length > 1e-12 else d


def histograms(gy: np.ndarray, gx: np.ndarray, y: float, x: float, angle: float, sigma: float) -> np.ndarray:
    """SIFT's 128 numbers: eight directions in 4 x 4 parts, shared out to neighbouring parts and directions, cut off at 0.2."""
    u, v, rows, columns = turned(y, x, angle, 3 * sigma / 4, 20)
    a, b = sampled(gy, rows, columns), sampled(gx, rows, columns)
    weight = np.hypot(a, b) * np.exp(-(u * u + v * v) / (2 * 8.0**2))
    turn = ((np.arctan2(a, b) - angle) / (2 * np.pi) * 8) % 8
    at = [u / 4 + 1.5, v / 4 + 1.5, turn]
    low = [np.floor(t).astype(int) for t in at]
    out = np.zeros((4, 4, 8))
    for k in range(8):
        up = [k & 1, k >> 1 & 1, k >> 2]
        cell = [b + n for b, n in zip(low, up, strict=True)]
        part = np.prod([t - b if n else 1 - (t - b) for t, b, n in zip(at, low, up, strict=True)], axis=0)
        good = (cell[0] >= 0) & (cell[0] < 4) & (cell[1] >= 0) & (cell[1] < 4)
        np.add.at(out, (cell[1][good], cell[0][good], cell[2][good] % 8), (weight * part)[good])
    return unit(np.minimum(unit(out.ravel()), 0.2))


def sums(gy: np.ndarray, gx: np.ndarray, y: float, x: float, angle: float, scale: float) -> np.ndarray:
    """SURF's 64 numbers: in 4 x 4 parts the sums of both derivatives, along and across the direction, and of their sizes."""
    u, v, rows, columns = turned(y, x, angle, scale, 20)
    a, b = sampled(gy, rows, columns), sampled(gx, rows, columns)
    weight = np.exp(-(u * u + v * v) / (2 * 3.3**2 * 4))
    along, across = (np.cos(angle) * b + np.sin(angle) * a) * weight, (np.cos(angle) * a - np.sin(angle) * b) * weight
    parts = lambda t: t.reshape(4, 5, 4, 5).sum(axis=(1, 3))
    return unit(np.stack([parts(along), parts(np.abs(along)), parts(across), parts(np.abs(across))], axis=2).ravel())


def collected(rows: list[tuple]) -> Points:
    if not rows:
        return Points.of([], [], [])
    x, y, score, size, angle, f = zip(*rows, strict=True)
    return Points.of(x, y, score, size, angle, np.array(f))


def sift(v: np.ndarray, least: float = 0.0, edge: float = 10.0) -> Points:
    """`least` bounds the size of the difference of Gaussians; points on edges (curvatures further apart than `edge`) are left out."""
    rows, base, step = [], blurred(v[None], np.sqrt(SIGMA**2 - 0.25))[0], 1.0
    while min(base.shape) >= 8:
        layers = [base]
        for k in range(1, SCALES + 3):
            was, now = (SIGMA * 2 ** (i / SCALES) for i in (k - 1, k))
            layers.append(blurred(layers[-1][None], np.sqrt(now**2 - was**2))[0])
        d = np.diff(np.stack(layers), axis=0)
        for sign in (1, -1):
            at, off, value, h = refined(sign * d, peaks(sign * d, 0.5 * least))
            for (s, r, c), (ds, dr, dc), score, m in zip(at, off, value, h, strict=True):
                det = m[1, 1] * m[2, 2] - m[1, 2] ** 2
                if score <= least or det <= 0 or (m[1, 1] + m[2, 2]) ** 2 * edge >= (edge + 1) ** 2 * det:
                    continue
                sigma = SIGMA * 2 ** ((s + ds) / SCALES)
                gy, gx = (g[0] for g in gradients(layers[s][None]))
                for angle in directions(gy, gx, r + dr, c + dc, 1.5 * sigma):
                    f = histograms(gy, gx, r + dr, c + dc, angle, sigma)
                    rows.append(((c + dc) * step, (r + dr) * step, score, sigma * step, angle, f))
        base, step = layers[SCALES][::2, ::2], step * 2
    return collected(rows)


def box_sums(v: np.ndarray) -> np.ndarray:
    out = np.zeros((v.shape[0] + 1, v.shape[1] + 1))
    out[1:, 1:] = v.cumsum(axis=0).cumsum(axis=1)
    return out


def box_at(total: np.ndarray, top: int, left: int, height: int, width: int) -> np.ndarray:
    """For each pixel the sum of the box whose first corner lies (top, left) from it; beyond the image nothing is added."""
    h, w = total.shape[0] - 1, total.shape[1] - 1
    r0, r1 = (np.clip(np.arange(h) + t, 0, h) for t in (top, top + height))
    c0, c1 = (np.clip(np.arange(w) + t, 0, w) for t in (left, left + width))
    return total[np.ix_(r1, c1)] - total[np.ix_(r0, c1)] - total[np.ix_(r1, c0)] + total[np.ix_(r0, c0)]


def box_hessian(v: np.ndarray, size: int) -> np.ndarray:
    """Determinant of second derivatives by boxes in a window of `size` (9, 15, 21, ...), by area."""
    total, lobe, half = box_sums(v), size // 3, size // 2
    wide = 2 * lobe - 1
    yy = box_at(total, -half, -(wide // 2), size, wide) - 3 * box_at(total, -(lobe // 2), -(wide // 2), lobe, wide)
    xx = box_at(total, -(wide // 2), -half, wide, size) - 3 * box_at(total, -(wide // 2), -(lobe // 2), wide, lobe)
    xy = box_at(total, -lobe, 1, lobe, lobe) + box_at(total, 1, -lobe, lobe, lobe) - box_at(total, -lobe, -lobe, lobe, lobe) - box_at(total, 1, 1, lobe, lobe)
    area = float(size * size)
    out = xx / area * yy / area - (0.9 * xy / area) ** 2
    # where the window leaves the image the sums are of less than it
    out[:half] = out[-half:] = 0
    out[:, :half] = out[:, -half:] = 0
    return out


def surf(v: np.ndarray, least: float = 0.0) -> Points:
    rows: list[tuple] = []
    for octave in range(4):
        grow = 6 * 2**octave
        sizes = [9 + grow * k + (grow - 6) for k in range(4)]
        if sizes[2] >= min(v.shape):
            break
        cube = np.stack([box_hessian(v, s) for s in sizes])
        at, off, value, _ = refined(cube, peaks(cube, least))
        for (s, r, c), (ds, dr, dc), score in zip(at, off, value, strict=True):
            scale = 1.2 * (sizes[s] + grow * ds) / 9
            gy, gx = (g[0] for g in gradients(blurred(v[None], scale)))
            for angle in directions(gy, gx, r + dr, c + dc, 2 * scale, 1.0):
                rows.append((c + dc, r + dr, score, scale, angle, sums(gy, gx, r + dr, c + dc, angle, scale)))
    return collected(rows)


def diffused(v: np.ndarray, time: float, contrast: float) -> np.ndarray:
    """After diffusion for so long that slows down where gradients reach the contrast, in steps of at most a quarter."""
    n = max(1, int(np.ceil(time / 0.25)))
    for _ in range(n):
        gy, gx = gradients(blurred(v[None], 1.0))
        g = (1 / (1 + (gy * gy + gx * gx) / contrast**2))[0]
        p, q = np.pad(v, 1, mode="edge"), np.pad(g, 1, mode="edge")
        flow = sum((q[1 + a : q.shape[0] - 1 + a, 1 + b : q.shape[1] - 1 + b] + g) / 2 * (p[1 + a : p.shape[0] - 1 + a, 1 + b : p.shape[1] - 1 + b] - v) for a, b in ((0, 1), (0, -1), (1, 0), (-1, 0)))
        v = v + time / n * flow
    return v


def kaze(v: np.ndarray, least: float = 0.0, octaves: int = 3, parts: int = 3) -> Points:
    gy, gx = gradients(blurred(v[None], 1.0))
    size = np.hypot(gy, gx)
    contrast = max(float(np.quantile(size[size > 0], 0.7)), 1e-6) if size.any() else 1.0
    sigmas = [SIGMA * 2 ** (k / parts) for k in range(octaves * parts + 2) if SIGMA * 2 ** (k / parts) < min(v.shape) / 4]
    if len(sigmas) < 3:
        return collected([])
    layers, now, level = [], 0.0, v
    for s in sigmas:
        level, now = diffused(level, s * s / 2 - now, contrast), s * s / 2
        layers.append(level)
    cube = []
    for s, u in zip(sigmas, layers, strict=True):
        a, b = (g[0] for g in gradients(u[None]))
        (yy, xy), xx = (g[0] for g in gradients(a[None])), gradients(b[None])[1][0]
        cube.append(s**4 * (xx * yy - xy * xy))
    rows = []
    at, off, value, _ = refined(np.stack(cube), peaks(np.stack(cube), least))
    for (s, r, c), (ds, dr, dc), score in zip(at, off, value, strict=True):
        sigma = SIGMA * 2 ** ((s + ds) / parts)
        a, b = (g[0] for g in gradients(layers[s][None]))
        for angle in directions(a, b, r + dr, c + dc, 2 * sigma, 1.0):
            rows.append((c + dc, r + dr, score, sigma, angle, sums(a, b, r + dr, c + dc, angle, sigma)))
    return collected(rows)
