"""Robust fits of any plane model: shift, similarity, affine, projective, or one of your own, by one RANSAC for all keys at once.

A model says how many matches fix it, fits many samples at once, refits from weighted matches, and gives residuals. All samples of a group are tried where there
are no more than `trials` of them, so small groups have the exact answer; beyond that, `trials` samples are drawn by a seed. Trials are scored together
and read in their order, so rules that stop early give what a loop would.

A group's matches meet in one row, which a quota of keypoints bounds.

Nulls, ties and odd rows: matches with a null coordinate are left out, null weights count as 1; a group with fewer matches than the model needs has status 1,
one without a valid sample or with too few inliers status 2, both with nulls; ties go to fewer residuals, then to the first sample in the order of match numbers; samples that fix nothing
(points that coincide or lie on a line) are invalid; repeated matches count each; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.parts import parts
from tessera.operators.robust import FEW_INLIERS, FEW_MATCHES, FITTED, chance


@dataclass(frozen=True)
class Model:
    """samples: matches that fix it. fit: (p, q, weights; each with samples in the first axis and matches in the second) to 3 x 3 matrices, NaN where nothing is
    fixed. valid: which matrices are allowed."""

    samples: int
    fit: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
    valid: Callable[[np.ndarray], np.ndarray] = lambda m: np.isfinite(m).all(axis=(1, 2)) & (np.abs(np.linalg.det(np.nan_to_num(m))) > 1e-12)


def matrices(a: np.ndarray, b: np.ndarray, tx: np.ndarray, c: np.ndarray, d: np.ndarray, ty: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), 3, 3))
    for (i, j), v in zip(((0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2)), (a, b, tx, c, d, ty), strict=True):
        out[:, i, j] = v
    out[:, 2, 2] = 1
    return out


def centred(p: np.ndarray, q: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, ...]:
    """(means of p and q by weight, what is left of each)"""
    total = w.sum(axis=1, keepdims=True)[..., None]
    mp, mq = ((w[..., None] * x).sum(axis=1, keepdims=True) / total for x in (p, q))
    return mp[:, 0], mq[:, 0], p - mp, q - mq


def shift(p: np.ndarray, q: np.ndarray, w: np.ndarray) -> np.ndarray:
    mp, mq, _, _ = centred(p, q, w)
    one, none = np.ones(len(p)), np.zeros(len(p))
    return matrices(one, none, mq[:, 0] - mp[:, 0], none, one, mq[:, 1] - mp[:, 1])


def similarity(p: np.ndarray, q: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Least squares of q = s R p + t."""
    mp, mq, x, y = centred(p, q, w)
    spread = (w * (x * x).sum(axis=2)).sum(axis=1)
    spread = np.where(spread > 1e-12, spread, np.nan)
    a = (w * (x * y).sum(axis=2)).sum(axis=1) / spread
    b = (w * (x[..., 0] * y[..., 1] - x[..., 1] * y[..., 0])).sum(axis=1) / spread
    return matrices(a, -b, mq[:, 0] - a * mp[:, 0] + b * mp[:, 1], b, a, mq[:, 1] - b * mp[:, 0] - a * mp[:, 1])


def affine(p: np.ndarray, q: np.ndarray, w: np.ndarray) -> np.ndarray:
    mp, mq, x, y = centred(p, q, w)
    xx, xy = np.einsum("sn,sni,snj->sij", w, x, x), np.einsum("sn,sni,snj->sij", w, x, y)
    det, size = np.linalg.det(xx), np.trace(xx, axis1=1, axis2=2)
    sound = det > 1e-10 * size * size
    m = np.full((len(p), 2, 2), np.nan)
    m[sound] = np.linalg.solve(xx[sound], xy[sound]).transpose(0, 2, 1)
    t = mq - np.einsum("sij,sj->si", m, mp)
    return matrices(m[:, 0, 0], m[:, 0, 1], t[:, 0], m[:, 1, 0], m[:, 1, 1], t[:, 1])


def projective(p: np.ndarray, q: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Direct linear transform of points that are moved and scaled first; the last entry is 1."""
    def scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mean = x.mean(axis=1, keepdims=True)
        far = np.sqrt(((x - mean) ** 2).sum(axis=2)).mean(axis=1)
        s = np.sqrt(2) / np.where(far > 1e-12, far, np.nan)
        return (x - mean) * s[:, None, None], matrices(s, 0 * s, -s * mean[:, 0, 0], 0 * s, s, -s * mean[:, 0, 1])

    (a, ta), (b, tb) = scaled(p), scaled(q)
    one, none = np.ones(a.shape[:2]), np.zeros(a.shape[:2])
    x, y, u, v = a[..., 0], a[..., 1], b[..., 0], b[..., 1]
    rows = np.concatenate([np.stack([-x, -y, -one, none, none, none, u * x, u * y, u], axis=2), np.stack([none, none, none, -x, -y, -one, v * x, v * y, v], axis=2)], axis=1)
    rows = rows * np.sqrt(np.concatenate((w, w), axis=1))[..., None]
    sound = np.isfinite(rows).all(axis=(1, 2))
    out = np.full((len(p), 3, 3), np.nan)
    if sound.any():
        _, s, vt = np.linalg.svd(rows[sound], full_matrices=rows.shape[1] < 9)
        h = np.linalg.inv(tb[sound]) @ vt[:, -1].reshape(-1, 3, 3) @ ta[sound]
        last = h[:, 2, 2]
        good = (s[:, 7] > 1e-9 * s[:, 0]) & (np.abs(last) > 1e-12)
        out[sound] = np.where(good[:, None, None], h / np.where(good, last, 1)[:, None, None], np.nan)
    return out


MODELS = {"shift": Model(1, shift), "similarity": Model(2, similarity), "affine": Model(3, affine), "projective": Model(4, projective)}


def residuals(m: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances of each map's image of p to q; infinite where a point goes to infinity."""
    h = np.column_stack((p, np.ones(len(p)))) @ np.nan_to_num(m).transpose(0, 2, 1)
    below = np.where(np.abs(h[..., 2]) > 1e-12, h[..., 2], np.nan)
    d = np.hypot(h[..., 0] / below - q[:, 0], h[..., 1] / below - q[:, 1])
    return np.where(np.isfinite(d), d, np.inf)


def drawn(n: int, samples: int, trials: int | None, seed: int) -> np.ndarray:
    """All samples of n matches in order, or `trials` of them by a seed."""
    if trials is None or math.comb(n, samples) <= trials:
        return np.array(list(itertools.combinations(range(n), samples)), int).reshape(-1, samples)
    draw = np.random.default_rng(seed)
    return np.sort(np.array([draw.choice(n, samples, replace=False) for _ in range(trials)]), axis=1)


def fitted(p: np.ndarray, q: np.ndarray, w: np.ndarray, model: Model, *, threshold: float, trials: int | None, least: int, start: np.ndarray | None, stop_inliers: float, stop_residual: float, probability: float, seed: int) -> tuple[int, np.ndarray | None, np.ndarray]:
    """(status, matrix, inliers) of one group."""
    none = np.zeros(len(p), bool)
    if len(p) < model.samples:
        return FEW_MATCHES, None, none
    rows = drawn(len(p), model.samples, trials, seed)
    one = np.ones(rows.shape)
    maps = model.fit(p[rows], q[rows], one)
    if start is not None and start.sum() >= model.samples:  # known inliers are tried before any sample
        maps = np.concatenate((model.fit(p[start][None], q[start][None], w[start][None]), maps))
    sound = model.valid(maps)
    # so many maps at once that their table has some millions of cells
    step = max(1, (1 << 21) // len(p))
    votes, cost = np.zeros(len(maps), int), np.full(len(maps), np.inf)
    for at in range(0, len(maps), step):
        d = residuals(maps[at : at + step], p, q)
        near = (d < threshold) & sound[at : at + step, None]
        votes[at : at + step] = near.sum(axis=1)
        cost[at : at + step] = np.where(near, d * d, 0).sum(axis=1)
    best = -1
    for i in np.flatnonzero(sound).tolist():
        if best < 0 or (-votes[i], round(cost[i], 9)) < (-votes[best], round(cost[best], 9)):
            best = i
            if votes[i] >= stop_inliers or (votes[i] >= model.samples and cost[i] <= stop_residual):
                break
        if probability < 1 and i + 1 >= chance(int(votes[best]), len(p), model.samples, probability):
            break
    if best < 0 or votes[best] < max(least, model.samples):
        return FEW_INLIERS, None, none
    inside = residuals(maps[best : best + 1], p, q)[0] < threshold
    final = model.fit(p[inside][None], q[inside][None], w[inside][None])
    return (FITTED, final[0], inside) if model.valid(final)[0] else (FEW_INLIERS, None, none)


def ransac(
    matches: DataFrame, keys: list[str], model: str | Model, *, threshold: float = 1.0, trials: int | None = 2000, least: int = 1, weight_col: str | None = None, start_col: str | None = None, stop_inliers: float = math.inf, stop_residual: float = -1.0, probability: float = 1.0, seed: int = 0
) -> DataFrame:
    """(keys, n_match, n_inlier, status, error: root of the mean squared residual of the inliers, m: the map's nine entries row by row, members: the inliers' match numbers)
    of matches (keys, m, x1, y1, x2, y2) from (x1, y1) to (x2, y2).

    trials: None tries all samples of every group. weight_col weighs matches in the last fit; start_col marks inliers that are known before. The search
    stops at a map with stop_inliers inliers, or with squared residuals of stop_residual or less in all, or when a sample without outliers has been
    drawn with this probability."""
    kind = MODELS[model] if isinstance(model, str) else model
    if threshold <= 0 or (trials is not None and trials < 1) or not 0 < probability <= 1:
        raise ValueError("threshold and trials must be positive, the probability between 0 and 1")
    number = matches.schema["m"].dataType.simpleString()
    some = matches.dropna(subset=["m", "x1", "y1", "x2", "y2"])
    row = F.struct("m", *(F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")), (F.coalesce(F.col(weight_col).cast("double"), F.lit(1.0)) if weight_col else F.lit(1.0)).alias("w"), (F.coalesce(F.col(start_col), F.lit(False)) if start_col else F.lit(False)).alias("s"))
    groups = some.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("r")).select(*keys, *(F.col(f"r.{c}").alias(f"__{c}") for c in ("m", "x1", "y1", "x2", "y2", "w", "s")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in parts(batches):
            out = []
            for m, x1, y1, x2, y2, w, s in zip(*(batch[f"__{c}"] for c in ("m", "x1", "y1", "x2", "y2", "w", "s")), strict=True):
                p, q, w = np.column_stack((x1, y1)), np.column_stack((x2, y2)), np.asarray(w, float)
                start = np.asarray(s, bool) if start_col else None
                status, h, inside = fitted(p, q, w, kind, threshold=threshold, trials=trials, least=least, start=start, stop_inliers=stop_inliers, stop_residual=stop_residual, probability=probability, seed=seed)
                error = None if h is None else float(np.sqrt((residuals(h[None], p[inside], q[inside])[0] ** 2).mean()))
                out.append((len(p), int(inside.sum()), status, error, None if h is None else h.ravel().tolist(), np.asarray(m)[inside].tolist()))
            yield pd.concat([batch[keys].reset_index(drop=True), pd.DataFrame(out, columns=["n_match", "n_inlier", "status", "error", "m", "members"])], axis=1)

    kinds = ", ".join(f"`{c}` {matches.schema[c].dataType.simpleString()}" for c in keys)
    return groups.mapInPandas(run, f"{kinds}, n_match bigint, n_inlier bigint, status int, error double, m array<double>, members array<{number}>")
