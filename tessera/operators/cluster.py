"""Clusters of matches and the weights that they give to pixels.

Pixels go in blocks of 64 x 64 to the points of their tile, which are one row; distances are taken there, and only the results become rows: a block of pixels costs
its results, never pixels times points. All points of a tile meet each of its blocks, which a quota of keypoints bounds.

Nulls, ties and odd sizes: rows with a null coordinate or cluster take no part; equal distances go to the smaller id; clusters of fewer than k points give
no k-th distance and no weight; a pixel that no cluster weighs has no rows; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ways import UNREACHABLE, steps

#: Side of a block of pixels, and cells of a table of distances that is held at once.
SIDE, CELLS = 64, 1 << 21
#: Rows of results that are handed on at once.
ROWS = 1 << 14


def distance() -> Column:
    """Of a pixel (r, c) and a keypoint (x, y)."""
    return F.hypot(F.col("c") - F.col("x"), F.col("r") - F.col("y"))


def shares(kth: DataFrame, k: int) -> DataFrame:
    """(tile_id, r, c, cluster, weight) of (tile_id, r, c, cluster, n, nearest): densities as shares of all clusters."""
    kth = kth.withColumn("w", (k / F.col("n")) / (F.col("nearest") * F.col("nearest") + 1e-30))
    total = F.sum("w").over(Window.partitionBy("tile_id", "r", "c"))
    return kth.select("tile_id", "r", "c", "cluster", (F.col("w") / (total + 1e-30)).alias("weight"))


def by_blocks(pixels: DataFrame, points: DataFrame, of: Callable, columns: str, *, extra: DataFrame | None = None, whole: bool = False) -> DataFrame:
    """(tile_id, r, c, cluster, columns) by a function of (rows r, columns c, clusters, their points' numbers as a list of arrays, x, y, what the tile has in `extra`), which gives
    (numbers of pixels, numbers of clusters, values ...). Points come in the order of their ids. extra: a row a tile, or without tile_id one row for all. whole: of is given each
    member's cluster in place of the points' numbers of clusters, and gives values of pixels alone."""
    block = pixels.select("tile_id", "r", "c").groupBy("tile_id", F.floor(F.col("r") / SIDE).alias("br"), F.floor(F.col("c") / SIDE).alias("bc")).agg(F.collect_list("r").alias("r"), F.collect_list("c").alias("c"))
    some = points.dropna(subset=["cluster", "x", "y"]).groupBy("tile_id").agg(F.array_sort(F.collect_list(F.struct("kp", "cluster", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))).alias("p"))
    both = block.join(some, "tile_id").select("tile_id", "r", "c", F.col("p.cluster").alias("k"), F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    both = both.withColumn("extra", F.lit(None).cast("array<double>")) if extra is None else both.join(extra, "tile_id", "left") if "tile_id" in extra.columns else both.crossJoin(F.broadcast(extra))
    names = ["tile_id", "r", "c", *([] if whole else ["cluster"]), *(c.split()[0] for c in columns.split(", "))]

    def table(batch: pd.DataFrame, held: list[list]) -> pd.DataFrame:
        n, *rest = (pd.concat([pd.Series(h[i]) for h in held], ignore_index=True) for i in range(len(names)))
        return pd.DataFrame(dict(zip(names, (batch["tile_id"].to_numpy()[n], *rest), strict=True)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held = []
            for n, r, c, k, x, y, more in zip(range(len(batch)), *(batch[n] for n in ("r", "c", "k", "x", "y", "extra")), strict=True):
                r, c, x, y = (np.asarray(v, float) for v in (r, c, x, y))
                kinds, at = np.unique(np.asarray(k), return_inverse=True)
                members = [np.flatnonzero(at == i) for i in range(len(kinds))]
                step = max(1, CELLS // max(len(x), 1))
                for start in range(0, len(r), step):
                    some_r, some_c = r[start : start + step], c[start : start + step]
                    pixel, *values = of(some_r, some_c, members, kinds if whole else at, x, y, more)
                    values = values if whole else [kinds[values[0]], *values[1:]]
                    held.append([np.full(len(pixel), n), some_r[pixel].astype(int), some_c[pixel].astype(int), *values])
                    if sum(len(h[0]) for h in held) >= ROWS:
                        yield table(batch, held)
                        held = []
            if held:
                yield table(batch, held)

    kind = lambda df, n: df.schema[n].dataType.simpleString()
    return both.mapInPandas(run, f"tile_id {kind(pixels, 'tile_id')}, r {kind(pixels, 'r')}, c {kind(pixels, 'c')}, {'' if whole else f"cluster {kind(points, 'cluster')}, "}{columns}")


def kth_distances(pixels: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """(tile_id, r, c, cluster, nearest, farthest): the k-th smallest and k-th largest distance from each pixel to a cluster's points, null for fewer of them."""

    def of(r, c, members, at, x, y, _):
        d = np.hypot(c[:, None] - x, r[:, None] - y)
        near, far = np.full((len(r), len(members)), np.nan), np.full((len(r), len(members)), np.nan)
        for i, m in enumerate(members):
            if len(m) >= k:
                order = np.partition(d[:, m], [k - 1, len(m) - k], axis=1)
                near[:, i], far[:, i] = order[:, k - 1], order[:, len(m) - k]
        pixel, cluster = (v.ravel() for v in np.indices(near.shape))
        return pixel, cluster, *(pd.array(np.where(np.isnan(v), None, v).ravel(), "Float64") for v in (near, far))

    return by_blocks(pixels, points, of, "nearest double, farthest double")


def density_weights(pixels: DataFrame, points: DataFrame, k: int = 5) -> DataFrame:
    """(tile_id, r, c, cluster, weight): how dense the cluster's points (tile_id, cluster, kp, x, y) lie around a pixel, (k / n) / (d_k**2 + 1e-30) with the k-th nearest
    of its n points, as a share of all clusters."""

    def of(r, c, members, at, x, y, _):
        d = np.hypot(c[:, None] - x, r[:, None] - y)
        whole = [i for i, m in enumerate(members) if len(m) >= k]
        w = np.array([(k / len(members[i])) / (np.partition(d[:, members[i]], k - 1, axis=1)[:, k - 1] ** 2 + 1e-30) for i in whole]).reshape(len(whole), len(r)).T
        w = w / (w.sum(axis=1, keepdims=True) + 1e-30)
        pixel, cluster = (v.ravel() for v in np.indices(w.shape))
        return pixel, np.array(whole, int)[cluster], w.ravel()

    return by_blocks(pixels, points, of, "weight double")


def density_field(pixels: DataFrame, points: DataFrame, maps: DataFrame, k: int = 5) -> DataFrame:
    """(tile_id, r, c, x, y): warp.field() of density_weights() and the clusters' maps (maybe tile_id; cluster, m00 to m12), taken where a pixel's weights are, so that no row for a
    pixel and a cluster is dealt out again. Clusters without a map count nothing; pixels that no cluster with a map weighs have no rows."""
    names = [f"m{i}{j}" for i in range(2) for j in range(3)]
    keys = [c for c in ("tile_id",) if c in maps.columns]
    extra = maps.groupBy(*keys).agg(F.collect_list(F.struct("cluster", F.array(*(F.col(n).cast("double") for n in names)).alias("m"))).alias("extra"))

    def of(r, c, members, kinds, x, y, some):
        d = np.hypot(c[:, None] - x, r[:, None] - y)
        w = {kinds[i]: (k / len(m)) / (np.partition(d[:, m], k - 1, axis=1)[:, k - 1] ** 2 + 1e-30) for i, m in enumerate(members) if len(m) >= k}
        total = sum(w.values()) + 1e-30
        moved = [[w[a["cluster"]] / total * (m[0] * (c + 0.5) + m[1] * (r + 0.5) + m[2]) for m in np.array(a["m"], float).reshape(2, 3)] for a in (() if some is None else some) if a["cluster"] in w]
        if not moved:
            return np.empty(0, int), np.empty(0), np.empty(0)
        # what a map doesn't say is left out, as a sum leaves out nulls
        place = [sum(np.nan_to_num(p) for p in parts) + np.where(np.all([np.isnan(p) for p in parts], axis=0), np.nan, 0.0) for parts in zip(*moved, strict=True)]
        return np.arange(len(r)), *(pd.array(np.where(np.isnan(p), None, p), "Float64") if np.isnan(p).any() else p for p in place)

    return by_blocks(pixels, points, of, "x double, y double", extra=extra, whole=True)


def vote_weights(pixels: DataFrame, points: DataFrame, width: float, k: int = 5) -> DataFrame:
    """The same by votes: each of the k points nearest to a pixel votes for its cluster with exp(-d**2 / width**2)."""

    def of(r, c, members, at, x, y, _):
        d = np.hypot(c[:, None] - x, r[:, None] - y)
        near = np.argsort(d, axis=1, kind="stable")[:, :k]
        votes, said = np.zeros((len(r), len(members))), np.zeros((len(r), len(members)), bool)
        rows = np.arange(len(r))
        for column in near.T:
            votes[rows, at[column]] += np.exp(-(d[rows, column] ** 2) / width**2)
            said[rows, at[column]] = True
        total = votes.sum(axis=1)
        pixel, cluster = np.nonzero(said & (total > 0)[:, None])
        return pixel, cluster, votes[pixel, cluster] / total[pixel]

    return by_blocks(pixels, points, of, "weight double")


def visible(pixels: DataFrame, points: DataFrame, cuts: DataFrame, angle: float = 0.2) -> DataFrame:
    """(tile_id, r, c, cluster, visible): false where a place (r, c) of the cuts lies nearer than the cluster's nearest point and within this angle (radians) of its direction."""
    places = cuts.groupBy("tile_id").agg(F.flatten(F.collect_list(F.array(F.col("r").cast("double"), F.col("c").cast("double")))).alias("extra"))

    def of(r, c, members, at, x, y, cut):
        spots = np.asarray([] if cut is None else cut, float).reshape(-1, 2)
        out = np.ones((len(r), len(members)), bool)
        for i, m in enumerate(members):
            d = np.hypot(c[:, None] - x[m], r[:, None] - y[m])
            best = d.argmin(axis=1)
            near, kx, ky = d[np.arange(len(r)), best], x[m][best] - c, y[m][best] - r
            step = max(1, CELLS // max(len(spots), 1))
            for s in range(0, len(r), step):
                part = slice(s, s + step)
                tx, ty = spots[:, 1] - c[part, None], spots[:, 0] - r[part, None]
                far = np.hypot(tx, ty)
                cosine = (kx[part, None] * tx + ky[part, None] * ty) / ((near[part, None] + 1e-30) * (far + 1e-30))
                out[part, i] = ~((np.arccos(np.clip(cosine, -1, 1)) < angle) & (far < near[part, None])).any(axis=1)
        pixel, cluster = (v.ravel() for v in np.indices(out.shape))
        return pixel, cluster, out.ravel()

    return by_blocks(pixels, points, of, "visible boolean", extra=places)


def nearest_clusters(centres: DataFrame) -> DataFrame:
    """(tile_id, cluster, nearest): for each centre (tile_id, cluster, x, y) the other one nearest to it, those at its own place left out."""
    other = centres.select("tile_id", F.col("cluster").alias("nearest"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    # a plain root, as hypot() rounds otherwise and would part what is equally far
    dx, dy = F.col("x") - F.col("x2"), F.col("y") - F.col("y2")
    d = F.sqrt(dx * dx + dy * dy)
    both = centres.join(other, "tile_id").where(F.col("cluster") != F.col("nearest")).withColumn("d", d).where("d > 0")
    return both.groupBy("tile_id", "cluster").agg(F.min(F.struct("d", "nearest")).alias("x")).select("tile_id", "cluster", F.col("x.nearest").alias("nearest"))


def medoids_of(f: np.ndarray, k: int, first: np.ndarray, wall: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(labels, numbers of the centres) of samples f by rounds of k-means whose centres are samples.

    Centres start as the first k of `first`; each cluster's mean (its sum by its size + 1) moves its centre to the sample nearest to it, until nothing changes or k + 1 rounds are
    done; a cluster without samples has its mean at 0. With walls, distances are ways over pixels around them, between the first two features (x, y), and a sample that no
    centre reaches has the label -1."""
    k = min(k, len(f))
    centres = first[:k]

    def apart(to: np.ndarray) -> np.ndarray:
        if wall is None:
            return ((f[:, None] - to) ** 2).sum(axis=2)
        x, y = (np.clip(np.trunc(f[:, i]).astype(int), 0, wall.shape[1 - i] - 1) for i in (0, 1))
        ways = [steps(wall, int(t[1]), int(t[0])) for t in to]
        return np.stack([w[y, x] for w in ways], axis=1).astype(float)

    for _ in range(k + 1):
        d = apart(f[centres])
        label = d.argmin(axis=1)
        if wall is not None:
            label = np.where(d.min(axis=1) >= UNREACHABLE, -1, label)
        means = np.array([f[label == i].sum(axis=0) / ((label == i).sum() + 1) for i in range(k)])
        new = apart(means).argmin(axis=0)
        if (new == centres).all():
            break
        centres = new
    d = apart(f[centres])
    label = d.argmin(axis=1)
    return (label if wall is None else np.where(d.min(axis=1) >= UNREACHABLE, -1, label)), centres


def k_medoids(samples: DataFrame, keys: list[str], features: list[str], k: int, *, id_col: str = "m", walls: DataFrame | None = None, height: int = 0, width: int = 0) -> DataFrame:
    """Samples with their cluster (0 to k - 1; -1 for what no centre reaches) and whether they are its centre, for all keys at once.

    walls: (keys, walls: row-major booleans) of images of height x width, around which distances go; a key without walls takes straight distances. Centres start as the first k by
    hash of the id. Rows with a null id or feature are left out; a key with fewer samples than k has fewer clusters. The samples of one key, the matches of a
    pair of images, meet in one task, with all rounds: no round is a job."""
    kinds = {c: samples.schema[c].dataType.simpleString() for c in samples.columns}
    some = samples.dropna(subset=[id_col, *features])
    row = F.struct(F.xxhash64(id_col).alias("__h"), F.col(id_col).alias("__id"), *(F.col(f).cast("double").alias(f"__f{i}") for i, f in enumerate(features)), F.struct(*samples.columns).alias("__row"))
    groups = some.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("__s"))
    groups = groups.join(walls.select(*keys, F.col("walls").alias("__w")), keys, "left") if walls is not None else groups.withColumn("__w", F.lit(None).cast("array<boolean>"))
    matrix = F.transform("__s", lambda x: F.array(*(x[f"__f{i}"] for i in range(len(features)))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for f, w in zip(batch["__f"], batch["__w"], strict=True):
                wall = np.asarray(w, bool).reshape(height, width) if w is not None and len(w) == height * width else None
                f = np.array([list(x) for x in f], float)
                label, centres = medoids_of(f, k, np.arange(len(f)), wall)
                out.append([(int(c), bool((centres == i).any())) for i, c in enumerate(label)])
            yield batch.drop(columns=["__f", "__w"]).assign(__l=[[{"cluster": c, "centre": t} for c, t in x] for x in out])

    # rows travel beside their labels and are put together again by place
    numbered = groups.select(*keys, "__w", matrix.alias("__f"))
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", __l array<struct<cluster: int, centre: boolean>>"
    labels = numbered.mapInPandas(run, schema)
    back = groups.select(*keys, "__s").join(labels, keys).select(F.explode(F.arrays_zip(F.col("__s.__row").alias("row"), F.col("__l").alias("l"))).alias("z"))
    return back.select("z.row.*", "z.l.cluster", "z.l.centre")


def k_means(samples: DataFrame, features: list[str], k: int, *, id_col: str = "id", keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, list]:
    """(samples with their cluster, ids of the centres), for one set of samples.

    Centres are samples: the first k by hash of the id; then each cluster's mean (its sum by its size + 1) moves its centre to the sample nearest to
    it, until nothing changes or k + 1 rounds are done. Only the k centres come to the driver; each round is one pass with partial sums. keep: writes
    a round's result to a shared folder, where lineage should be cut. Rows with a null feature are left out; fewer samples than k give fewer clusters."""
    some = keep(samples.dropna(subset=[id_col, *features]))
    row = F.struct(F.xxhash64(id_col).alias("h"), F.col(id_col).alias("id"), F.array(*(F.col(f).cast("double") for f in features)).alias("f"))
    centres = [(r.id, list(r.f)) for r in some.select(row.alias("x")).orderBy("x.h", "x.id").limit(k).select("x.*").collect()]

    def apart(to: list[list[float]]) -> list[Column]:
        return [sum(((F.col(f) - v) * (F.col(f) - v) for f, v in zip(features, c, strict=True)), F.lit(0.0)) for c in to]

    def labelled() -> DataFrame:
        best = F.array_min(F.array(*(F.struct(d.alias("d"), F.lit(i).alias("i")) for i, d in enumerate(apart([f for _, f in centres])))))
        return some.withColumn("cluster", best["i"])

    for _ in range(k + 1 if centres else 0):
        means = labelled().groupBy("cluster").agg(*((F.sum(f) / (F.count(F.lit(1)) + 1)).alias(f) for f in features)).collect()
        means = {m.cluster: [m[f] for f in features] for m in means}
        spots = [means.get(i, [0.0] * len(features)) for i in range(len(centres))]
        nearest = some.agg(*(F.min(F.struct(d.alias("d"), row.alias("x"))).alias(str(i)) for i, d in enumerate(apart(spots)))).first()
        new = [(nearest[str(i)].x.id, list(nearest[str(i)].x.f)) for i in range(len(centres))]
        if [c[0] for c in new] == [c[0] for c in centres]:
            break
        centres = new
    return (labelled() if centres else some.withColumn("cluster", F.lit(None).cast("int"))), [c[0] for c in centres]
