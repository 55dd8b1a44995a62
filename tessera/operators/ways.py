"""Ways over the pixels of an image, around its walls."""

from __future__ import annotations

import numpy as np

#: A distance from here on means that there is no way.
UNREACHABLE = 99999


def steps(wall: np.ndarray, row: int, column: int) -> np.ndarray:
    """Number of steps to each pixel from one, over the four neighbours, around walls."""
    out = np.full(wall.shape, UNREACHABLE, np.int32)
    if not (0 <= row < wall.shape[0] and 0 <= column < wall.shape[1]) or wall[row, column]:
        return out
    front = np.zeros(wall.shape, bool)
    front[row, column] = True
    n = 0
    while front.any():
        out[front] = n
        near = np.zeros(wall.shape, bool)
        near[1:] |= front[:-1]
        near[:-1] |= front[1:]
        near[:, 1:] |= front[:, :-1]
        near[:, :-1] |= front[:, 1:]
        front = near & ~wall & (out == UNREACHABLE)
        n += 1
    return out


def filled(ways: np.ndarray, wall: np.ndarray) -> np.ndarray:
    """Ways (..., h, w) in which each pixel of a wall, row by row, has the value of the one above it to the left; at the edges the nearest place stands for what lies beyond."""
    out = ways.copy()
    for c in np.flatnonzero(wall[0]):
        out[..., 0, c] = out[..., 0, max(c - 1, 0)]
    for r in range(1, wall.shape[0]):
        above = out[..., r - 1, :]
        moved = np.concatenate((above[..., :1], above[..., :-1]), axis=-1)
        out[..., r, :] = np.where(wall[r], moved, out[..., r, :])
    return out
