"""Translations and affine maps from matches (keys, m, x1, y1, x2, y2), robustly and without chance.

A group's matches become one array, and all hypotheses are scored inside its row: one shuffle, and no row for a pair of matches. Groups are meant to
be the matches of a pair of tiles, which a quota of keypoints bounds.

Nulls, ties and odd rows: matches with a null coordinate are left out; a group without any match left has no row; ties go to the smaller match number m,
then the smaller shift; repeated matches count each; an empty table gives no rows. Failures have a status and nulls, never NaN.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Statuses of a fit.
FITTED, FEW_MATCHES, FEW_INLIERS = 0, 1, 2
#: Distances of maps and matches that are taken at once.
NEAR = 1 << 14


def shifts(matches: DataFrame) -> DataFrame:
    return matches.withColumn("dx", F.col("x2") - F.col("x1")).withColumn("dy", F.col("y2") - F.col("y1"))


def least_squares_shift(matches: DataFrame, keys: list[str]) -> DataFrame:
    return shifts(matches).groupBy(*keys).agg(F.avg("dx").alias("tx"), F.avg("dy").alias("ty"), F.count(F.lit(1)).alias("n_match"))


def gathered(matches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, __s): the shifts (m, dx, dy) of each group, sorted; a table that has them already goes on as it is."""
    if "__s" in matches.columns:
        return matches
    some = shifts(matches).where("dx is not null and dy is not null")
    return some.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("m", F.col("dx").cast("double").alias("dx"), F.col("dy").cast("double").alias("dy")))).alias("__s"))


def squared(s: Column, hx: Column, hy: Column) -> Column:
    return (s["dx"] - hx) * (s["dx"] - hx) + (s["dy"] - hy) * (s["dy"] - hy)


def mean(values: Column, of: Callable[[Column], Column]) -> Column:
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda t, x: t + of(x)), F.size(values).cast("double"))


def refit(groups: DataFrame, keys: list[str], inlier: Callable[[Column, Column, Column], Column], least: int) -> DataFrame:
    """Shift refitted from the inliers of the best hypothesis __b (hx, hy): tx, ty, counts, status and the inliers' error (root of the mean squared residual)."""
    inside = F.filter("__s", lambda x: inlier(x, F.col("__b.hx"), F.col("__b.hy")))
    out = groups.withColumn("__i", F.when(F.col("__b").isNull(), F.slice("__s", F.lit(1), F.lit(0))).otherwise(inside))
    out = out.withColumn("tx", mean(F.col("__i"), lambda x: x["dx"])).withColumn("ty", mean(F.col("__i"), lambda x: x["dy"]))
    status = F.when(F.size("__s") < least, FEW_MATCHES).when(F.size("__i") < 1, FEW_INLIERS).otherwise(FITTED)
    out = out.withColumn("status", status).withColumn("error", F.sqrt(mean(F.col("__i"), lambda x: squared(x, F.col("tx"), F.col("ty")))))
    ok = lambda c: F.when(F.col("status") == FITTED, F.col(c)).alias(c)
    n = F.when(F.col("status") == FITTED, F.size("__i")).otherwise(0).cast("bigint").alias("n_inlier")
    return out.select(*keys, ok("tx"), ok("ty"), F.size("__s").cast("bigint").alias("n_match"), n, "status", ok("error"))


def msac_shift(matches: DataFrame, keys: list[str], *, max_distance: float = 1.5, least: int = 1) -> DataFrame:
    """Each match is a hypothesis; the least sum of squared distances capped at max_distance wins. Fewer than `least` matches are too few."""
    if max_distance <= 0 or least < 1:
        raise ValueError("max_distance and least must be positive")
    cap = F.lit(float(max_distance) ** 2)
    cost = lambda h: F.aggregate("__s", F.lit(0.0), lambda t, x: t + F.least(squared(x, h["dx"], h["dy"]), cap))
    tried = F.transform("__s", lambda h: F.struct(F.round(cost(h), 9).alias("cost"), h["m"].alias("m"), h["dx"].alias("hx"), h["dy"].alias("hy")))
    best = gathered(matches, keys).withColumn("__b", F.array_min(tried))
    return refit(best, keys, lambda x, hx, hy: squared(x, hx, hy) <= cap, least)


def all_pairs(m: pa.Array, dx: pa.Array, dy: pa.Array, most: float, pairs: int) -> pa.Array:
    """Of each group's sorted shifts the best hypothesis of two matches, as ransac_shift() takes it: struct(n: less the inliers, ssr, m1, m2, hx, hy). Null for fewer than two matches and for
    more than `pairs` pairs of them. Groups of one size are scored together."""
    size = np.asarray(pc.fill_null(m.value_lengths(), 0))
    first = np.cumsum(size) - size
    number, x, y = m.flatten(), dx.flatten().to_numpy(zero_copy_only=False), dy.flatten().to_numpy(zero_copy_only=False)
    rank = np.cumsum(np.concatenate(([0], np.asarray(pc.fill_null(pc.not_equal(number[1:], number[:-1]), True), int)))) if len(number) else np.empty(0, int)
    votes, ssr, hx, hy, a, b = np.zeros(len(size), np.int32), np.zeros(len(size)), np.zeros(len(size)), np.zeros(len(size)), np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
    whole = (size >= 2) & (size * (size - 1) // 2 <= pairs)
    for n in np.unique(size[whole]):
        rows, (i, j) = np.flatnonzero(size == n), np.triu_indices(n, 1)
        step = max(1, NEAR // (n * len(i)))
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            place = first[some, None] + np.arange(n)
            u, v, r = x[place], y[place], rank[place]
            cx, cy = (u[:, i] + u[:, j]) / 2, (v[:, i] + v[:, j]) / 2
            d = (u[:, None] - cx[..., None]) ** 2 + (v[:, None] - cy[..., None]) ** 2
            near = d < most
            count, total = -near.sum(axis=2), np.round(np.where(near, d, 0).sum(axis=2), 9)
            best = np.lexsort((cy, cx, r[:, j], r[:, i], total, count), axis=1)[:, 0]
            row = np.arange(len(some))
            votes[some], ssr[some], hx[some], hy[some] = count[row, best], total[row, best], cx[row, best], cy[row, best]
            a[some], b[some] = place[row, i[best]], place[row, j[best]]
    one, two = (number.take(pa.array(k, mask=~whole)) for k in (a, b))
    return pa.StructArray.from_arrays([pa.array(votes), pa.array(ssr), one, two, pa.array(hx), pa.array(hy)], names=["n", "ssr", "m1", "m2", "hx", "hy"], mask=pa.array(~whole))


def ransac_shift(matches: DataFrame, keys: list[str], *, threshold: float = 1.0, least: int = 2, trials: int = 2000, valid: Callable[[Column], Column] | None = None) -> DataFrame:
    """Each two matches are a hypothesis (their mean shift); most inliers wins, then least squared residuals, then the first.

    A group with more than `trials` pairs tries as many of them, picked by hash: that is the method's bound, and all matches vote on each.
    valid: a condition on a hypothesis (m1, m2, hx, hy), for maps that can't be."""
    if threshold <= 0 or least < 2 or trials < 1:
        raise ValueError("threshold, trials must be positive and least 2 or more")
    n = F.size("__s")
    at = lambda i: F.get("__s", i)
    both = lambda a, b: F.struct(a["m"].alias("m1"), b["m"].alias("m2"), ((a["dx"] + b["dx"]) / 2).alias("hx"), ((a["dy"] + b["dy"]) / 2).alias("hy"))
    every = F.flatten(F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.transform(F.sequence(i + 1, n - 1), lambda j: both(at(i), at(j)))))

    def picked(t: Column) -> Column:
        i = F.pmod(F.xxhash64(t), n).cast("int")
        j = F.pmod(i + 1 + F.pmod(F.xxhash64(t, F.lit(1)), n - 1), n).cast("int")
        return both(at(F.least(i, j)), at(F.greatest(i, j)))

    some = F.transform(F.sequence(F.lit(1), F.lit(trials)), picked)
    groups = gathered(matches, keys)
    # small groups are scored by the batch; conditions on a hypothesis are columns, and so are the trials of large ones
    kind = groups.schema["__s"].dataType.elementType["m"].dataType.simpleString()
    small = F.arrow_udf(lambda m, dx, dy: all_pairs(m, dx, dy, float(threshold) ** 2, trials), f"struct<n: int, ssr: double, m1: {kind}, m2: {kind}, hx: double, hy: double>")
    none = F.slice(F.transform("__s", lambda x: both(x, x)), F.lit(1), F.lit(0))
    pairs = F.when(n < 2, none).when(n * (n - 1) / 2 <= trials, none if valid is None else every).otherwise(some)
    groups = groups.withColumn("__h", pairs)
    if valid is not None:
        groups = groups.withColumn("__h", F.filter("__h", valid))
    most = F.lit(float(threshold) ** 2)

    def score(h: Column) -> Column:
        def vote(t: Column, x: Column) -> Column:
            r = squared(x, h["hx"], h["hy"])
            return F.struct((t["n"] - F.when(r < most, 1).otherwise(0)).alias("n"), (t["ssr"] + F.when(r < most, r).otherwise(0.0)).alias("ssr"))

        total = F.aggregate("__s", F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("ssr")), vote)
        return F.struct(total["n"].alias("n"), F.round(total["ssr"], 9).alias("ssr"), h["m1"].alias("m1"), h["m2"].alias("m2"), h["hx"].alias("hx"), h["hy"].alias("hy"))

    best = F.array_min(F.transform("__h", score))
    best = groups.withColumn("__b", best if valid is not None else F.coalesce(small(F.col("__s.m"), F.col("__s.dx"), F.col("__s.dy")), best))
    return refit(best, keys, lambda x, hx, hy: squared(x, hx, hy) < most, least)


def needed_trials(inliers: Column, total: Column, samples: int, probability: float) -> Column:
    """Trials after which a sample without outliers has been drawn with this probability: none if there are no inliers (null: no number is
    enough), one if all are."""
    eps = np.finfo(float).eps
    share = inliers.cast("double") / total
    miss = F.greatest(F.lit(1 - probability), F.lit(eps))
    bad = F.greatest(F.lit(eps), F.least(1 - F.pow(share, F.lit(float(samples))), F.lit(1 - eps)))
    return F.when(inliers > 0, F.ceil(F.log(miss) / F.log(bad)))


def affine_fit(points: DataFrame, keys: list[str]) -> DataFrame:
    """Least squares u = a x + b y + c per key, from sums (normal equations by Cramer's rule); NULL where they are singular."""
    x, y, u = F.col("x"), F.col("y"), F.col("u")
    s = points.groupBy(*keys).agg(F.avg(x).alias("mx"), F.avg(y).alias("my"), F.avg(u).alias("mu"), F.var_pop(x).alias("xx"), F.var_pop(y).alias("yy"), F.covar_pop(x, y).alias("xy"), F.covar_pop(x, u).alias("xu"), F.covar_pop(y, u).alias("yu"), F.count(F.lit(1)).alias("n"))
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    ok = (F.col("n") >= 3) & (F.abs(det) > 1e-9)
    s = s.withColumn("a", F.when(ok, (F.col("xu") * F.col("yy") - F.col("yu") * F.col("xy")) / det)).withColumn("b", F.when(ok, (F.col("yu") * F.col("xx") - F.col("xu") * F.col("xy")) / det))
    return s.select(*keys, "a", "b", (F.col("mu") - F.col("a") * F.col("mx") - F.col("b") * F.col("my")).alias("c"), "n")


def fitted_affine(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """2 x 3 map of p to q by the pseudo-inverse."""
    return (np.linalg.pinv(np.column_stack((p, np.ones(len(p))))) @ q).T


@lru_cache(1024)
def drawn_triples(n: int, trials: int, seed: int) -> np.ndarray:
    """`trials` triples of n points: the first three of as many random orders. Groups of one size have the same, so they are kept."""
    return np.argpartition(np.random.default_rng(seed).random((trials, n)), (0, 1, 2), axis=1)[:, :3].copy()


def affine_inliers(p: np.ndarray, q: np.ndarray, *, threshold: float = 3.0, trials: int = 512, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(map, inliers): the best of `trials` triples, all tried at once, then refitted from its inliers while their number grows. Fewer than three
    points: no motion, all inliers."""
    if len(p) < 3:
        return np.eye(2, 3), np.ones(len(p), bool)
    triples = drawn_triples(len(p), trials, seed) if len(p) > 3 else np.array([[0, 1, 2]])
    h = np.column_stack((p, np.ones(len(p))))
    maps = np.linalg.pinv(h[triples]) @ q[triples]
    # some maps at a time, so that their distances stay in the processor's cache
    sides, some = [np.column_stack((h, q[:, k])).T for k in (0, 1)], max(1, NEAR // len(p))
    votes, inliers = -1, None
    for at in range(0, len(maps), some):
        part = maps[at : at + some]
        d, e = (np.column_stack((part[:, :, k], np.full(len(part), -1.0))) @ sides[k] for k in (0, 1))
        d *= d
        e *= e
        d += e
        near = np.sqrt(d, out=d) < threshold
        counts = np.count_nonzero(near, axis=1)
        best = int(counts.argmax())
        if counts[best] > votes:
            votes, inliers = int(counts[best]), near[best]
    count = -1
    while inliers.sum() > max(count, 2):
        count = int(inliers.sum())
        m = fitted_affine(p[inliers], q[inliers])
        grown = np.linalg.norm(h @ m.T - q, axis=1) < threshold
        if grown.sum() <= count:
            return m, grown
        inliers = grown
    return fitted_affine(p[inliers], q[inliers]) if inliers.sum() >= 3 else np.eye(2, 3), inliers


def affine_clusters(matches: DataFrame, keys: list[str], *, clusters: int = 1, threshold: float = 3.0, trials: int = 512, least: int = 3) -> DataFrame:
    """(keys, cluster, n_match, n_inlier, m00 to m12, members: match numbers): affine maps found one after the other, each without the inliers of those before, until
    fewer than `least` matches or inliers are left. Triples are picked by a seed, after sorting by m. A group's matches meet in one task."""
    names = ["m00", "m01", "m02", "m10", "m11", "m12"]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        v, number = rows[["x1", "y1", "x2", "y2"]].to_numpy(float), rows["m"].to_numpy()
        whole = ~np.isnan(v).any(axis=1)
        v, number = v[whole], number[whole]
        place = number
        if number.dtype.kind not in "iuf":
            place = pd.factorize(number, sort=True)[0]
            place = np.where(place < 0, len(place), place)
        order = np.lexsort((*v.T[::-1], place))
        v, number = v[order], number[order]
        total, out = len(v), []
        for k in range(clusters):
            if len(v) < least:
                break
            m, inside = affine_inliers(v[:, :2], v[:, 2:], threshold=threshold, trials=trials)
            if inside.sum() < least:
                break
            out.append([*rows[keys].iloc[0], k, total, int(inside.sum()), *m.ravel().tolist(), number[inside].tolist()])
            v, number = v[~inside], number[~inside]
        return pd.DataFrame(out, columns=[*keys, "cluster", "n_match", "n_inlier", *names, "members"])

    kinds = ", ".join(f"`{k}` {matches.schema[k].dataType.simpleString()}" for k in keys)
    kind = matches.schema["m"].dataType.simpleString()
    return matches.groupBy(*keys).applyInPandas(run, f"{kinds}, cluster int, n_match bigint, n_inlier bigint, " + ", ".join(f"{n} double" for n in names) + f", members array<{kind}>")


def kept_clusters(clusters: DataFrame, *, least: int = 10, percent: float = 2.0) -> DataFrame:
    """Clusters with enough inliers, in number and as a share of their matches."""
    return clusters.where((F.col("n_inlier") >= least) & (100.0 * F.col("n_inlier") >= percent * F.col("n_match")))


def chance(inliers: int, total: int, samples: int, probability: float) -> float:
    """needed_trials() of plain numbers."""
    if not inliers:
        return math.inf
    eps = np.finfo(float).eps
    return math.ceil(math.log(max(1 - probability, eps)) / math.log(max(eps, min(1 - (inliers / total) ** samples, 1 - eps))))
