"""Keypoints of one image as arrays, and what is common to all methods that find them."""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np


def suppress(points: np.ndarray, scores: np.ndarray, radius: int) -> np.ndarray:
    """Indexes of the points (x, y) that stay, best first: a point falls to a better one within radius in both axes."""
    order = np.lexsort((points[:, 0], points[:, 1], -scores))
    if not len(order):
        return order
    taken = np.zeros(points.max(axis=0) + 2 * radius + 1, bool)
    stay: list[int] = []
    for i in order.tolist():
        x, y = points[i]
        if not taken[x + radius, y + radius]:
            stay.append(i)
            taken[x : x + 2 * radius + 1, y : y + 2 * radius + 1] = True
    return np.array(stay, int)



@dataclass
class Points:
    """Keypoints, best first: places (x, y), scores, sizes (the scale at which they were found, in pixels), angles (radians, from x towards y), and
    descriptors: rows of numbers (f) or words of 64 bits (bits), the other one without columns."""

    x: np.ndarray
    y: np.ndarray
    score: np.ndarray
    size: np.ndarray
    angle: np.ndarray
    f: np.ndarray
    bits: np.ndarray

    @classmethod
    def of(cls, x, y, score, size=1.0, angle=0.0, f=None, bits=None) -> Points:
        """Sorted by falling score, then y, x, size and angle."""
        n = len(x)
        full = [np.broadcast_to(np.asarray(v, float), n) for v in (x, y, score, size, angle)]
        order = np.lexsort((full[4], full[3], full[0], full[1], -full[2]))
        f = np.empty((n, 0)) if f is None or not n else np.asarray(f, float)
        bits = np.empty((n, 0), np.int64) if bits is None or not n else np.asarray(bits, np.int64)
        return cls(*(v[order] for v in (*full, f, bits)))

    def take(self, rows: np.ndarray) -> Points:
        return Points(*(getattr(self, c.name)[rows] for c in fields(self)))

    def moved(self, dx: float, dy: float) -> Points:
        return Points(self.x + dx, self.y + dy, *(getattr(self, c.name) for c in fields(self)[2:]))

    def inside(self, r0: int, r1: int, c0: int, c1: int) -> Points:
        """Those whose pixel lies in these rows and columns."""
        x, y = np.rint(self.x), np.rint(self.y)
        return self.take(np.flatnonzero((y >= r0) & (y < r1) & (x >= c0) & (x < c1)))

    def quota(self, cut: tuple[int, int, int, int], most: int | None, blocks: int = 1) -> Points:
        """The best `most`; with blocks, the best most // blocks**2 of each of blocks x blocks equal parts of the cut, what is left over at the far edges in none."""
        if most is None:
            return self
        if blocks == 1:
            return self.take(np.arange(min(most, len(self.x))))
        r0, r1, c0, c1 = cut
        h, w = (r1 - r0) // blocks, (c1 - c0) // blocks
        if not h or not w:
            return self.take(np.empty(0, int))
        row, column = ((np.rint(v).astype(int) - start) // step for v, start, step in ((self.y, r0, h), (self.x, c0, w)))
        stay, held = [], {}
        for i, key in enumerate(zip(row.tolist(), column.tolist(), strict=True)):
            held[key] = held.get(key, 0) + 1
            if max(key) < blocks and held[key] <= most // blocks**2:
                stay.append(i)
        return self.take(np.array(stay, int))
