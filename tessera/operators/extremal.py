"""Maximally stable regions of one image by a tree of components (Matas et al. 2002): pixels join in the order of their values, and a component
is stable where its area hardly changes over a span of levels."""

from __future__ import annotations

import numpy as np

from tessera.operators.corners import gradients
from tessera.operators.points import Points
from tessera.operators.scale_space import directions, sums


def component_tree(level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(parent, level, area, moments) of the components of {pixels of a level or less}, as a tree: a node for each level at which a component gains pixels; parents come
    after children and a root is its own. moments: sums of 1, y, x, yy, xy, xx."""
    h, w = level.shape
    flat = level.ravel()
    order = np.argsort(flat, kind="stable").tolist()
    values = flat.tolist()
    top = [-1] * (h * w)  # union-find over pixels; a root pixel knows its node
    node_of = [-1] * (h * w)
    parent: list[int] = []
    at: list[int] = []
    sums_: list[list[float]] = []

    def root(p: int) -> int:
        while top[p] != p:
            top[p] = top[top[p]]
            p = top[p]
        return p

    for p in order:
        y, x = divmod(p, w)
        v = values[p]
        top[p], node_of[p] = p, len(parent)
        parent.append(len(parent))
        at.append(v)
        sums_.append([1, y, x, y * y, x * y, x * x])
        me = p
        for q in (p - w if y else -1, p + w if y + 1 < h else -1, p - 1 if x else -1, p + 1 if x + 1 < w else -1):
            if q < 0 or top[q] < 0:
                continue
            other = root(q)
            if other == me:
                continue
            a, b = node_of[me], node_of[other]
            if at[b] == v and at[a] == v:  # one component of this level
                parent[a], keep, gone = b, b, a
            else:
                parent[b], keep, gone = a, a, b
            sums_[keep] = [s + t for s, t in zip(sums_[keep], sums_[gone], strict=True)]
            top[me] = other
            me = other
            node_of[me] = keep
    # nodes that were taken into another one of their own level are no components of their own
    parent_, at_ = np.array(parent), np.array(at)
    own = (at_[parent_] != at_) | (parent_ == np.arange(len(parent_)))
    number = np.cumsum(own) - 1

    def up(n: np.ndarray) -> np.ndarray:
        while not own[n].all():
            n = np.where(own[n], n, parent_[n])
        return n

    whole = np.flatnonzero(own)
    order_ = np.argsort(at_[whole], kind="stable")
    place = np.empty(len(whole), int)
    place[order_] = np.arange(len(whole))
    above = place[number[up(parent_[whole])]]
    moments = np.array(sums_, float)[whole][order_]
    return above[order_], at_[whole][order_], moments[:, 0], moments


def stable(level: np.ndarray, delta: int, most: float, least_area: int, most_area: float) -> tuple[np.ndarray, np.ndarray]:
    """(moments, growth) of stable components: growth is the area at level + delta, less the component's own, by its own; at most `most`, and less than
    that of the component below it and no more than that of the one above. Areas lie between least_area and most_area * pixels."""
    parent, at, area, moments = component_tree(level)
    n = np.arange(len(parent))
    # climb to the last ancestor that still begins by level + delta
    above = n.copy()
    while True:
        nxt = parent[above]
        go = (nxt != above) & (at[nxt] <= at + delta)
        if not go.any():
            break
        above = np.where(go, nxt, above)
    growth = (area[above] - area) / area
    below = np.full(len(n), np.inf)
    child = n[parent != n]
    np.minimum.at(below, parent[child], growth[child])
    good = (growth <= most) & (area >= least_area) & (area <= most_area * level.size) & (growth < below) & ((parent == n) | (growth <= growth[parent]))
    return moments[good], growth[good]


def mser(v: np.ndarray, least: float = 0.0, levels: int = 256, delta: int = 5, most: float = 0.25, least_area: int = 5, most_area: float = 0.5) -> Points:
    """Centres of stable dark and bright regions, scored by 1 / (1 + growth); the size is that of the circle of its area, the descriptor SURF's sums around it."""
    low, high = v.min(), v.max()
    if high <= low:
        return Points.of([], [], [])
    grey = np.minimum(((v - low) / (high - low) * levels).astype(int), levels - 1)
    gy, gx = (g[0] for g in gradients(v[None]))
    rows = []
    for u in (grey, levels - 1 - grey):
        for m, g in zip(*stable(u, delta, most, least_area, most_area), strict=True):
            score = 1 / (1 + g)
            if score > least:
                y, x, radius = m[1] / m[0], m[2] / m[0], float(np.sqrt(m[0] / np.pi))
                angle = directions(gy, gx, y, x, 1.5 * radius, 1.0)[0]
                rows.append((x, y, score, radius, angle, sums(gy, gx, y, x, angle, max(radius / 2, 0.5))))
    if not rows:
        return Points.of([], [], [])
    x, y, score, size, angle, f = zip(*rows, strict=True)
    return Points.of(x, y, score, size, angle, np.array(f))
