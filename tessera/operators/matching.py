"""Descriptor matching within pairs: equi-joins on the pair.

Exhaustive matching brings each pair's descriptors to one row a side and takes one product of matrices there (or counts of differing bits), so a pair of K
points a side costs K rows, never K * K. All keypoints of a pair of tiles meet, which a quota of keypoints bounds. Nulls and ties: a null descriptor or a null within it gives no distance, and
that candidate is left out; descriptors of different lengths too; equal distances go to the smaller id; a pair without candidates has no matches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.parts import parts


def squared_distance(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, v: t + v)


def unit_distance(x: Column, y: Column) -> Column:
    """The same for vectors of length 1: 2 - 2 x.y"""
    return 2 - 2 * F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v)


def normal(x: Column) -> Column:
    """The vector at length 1; null if it has none."""
    length = F.sqrt(F.aggregate(x, F.lit(0.0), lambda t, v: t + v * v))
    return F.transform(x, lambda v: F.try_divide(v, length))


def distances(left: DataFrame, right: DataFrame, on: list[str], *, normalised: bool = False) -> DataFrame:
    """(on, kp1, kp2, d2) of left (on, kp1, f1) and right (on, kp2, f2): every pair of points, for small sets."""
    d2 = (unit_distance if normalised else squared_distance)(F.col("f1"), F.col("f2"))
    return left.join(right, on).select(*on, "kp1", "kp2", d2.alias("d2")).where("d2 is not null")


def table(rows: list, binary: bool) -> tuple[np.ndarray, np.ndarray]:
    """(places of the whole descriptors among rows, those as a matrix). The first length that occurs is the length."""
    kind = np.int64 if binary else float
    good = [i for i, x in enumerate(rows) if x is not None and not any(v is None for v in x)]
    size = len(rows[good[0]]) if good else 0
    good = [i for i in good if len(rows[i]) == size]
    return np.array(good, int), np.array([np.asarray(rows[i], kind) for i in good], kind).reshape(len(good), size)


def gaps(f: np.ndarray, g: np.ndarray, metric: str) -> np.ndarray:
    """Distances of each row of f to each of g: squared, unit (2 - 2 f.g) or hamming (bits that differ)."""
    if f.shape[1] != g.shape[1]:
        return np.full((len(f), len(g)), np.inf)
    if metric == "hamming":
        f, g = f.view(np.uint64), g.view(np.uint64)  # of a negative number only the bits of its size would be counted
        return sum((np.bitwise_count(f[:, None, w] ^ g[None, :, w]).astype(np.int64) for w in range(f.shape[1])), np.zeros((len(f), len(g)), np.int64)).astype(float)
    dot = f @ g.T
    if metric == "unit":
        return 2 - 2 * dot
    near = np.maximum((f * f).sum(axis=1)[:, None] + (g * g).sum(axis=1) - 2 * dot, 0)
    # a product loses places where both are almost alike: those are taken again, entry by entry
    scale = np.maximum((f * f).sum(axis=1)[:, None], (g * g).sum(axis=1))
    for i, j in zip(*np.nonzero(near < 1e-6 * scale), strict=True):
        near[i, j] = ((f[i] - g[j]) ** 2).sum()
    return near


def best_matches(f: np.ndarray, g: np.ndarray, *, metric: str = "squared", max_ratio: float | None = None, threshold: float | None = None, mutual: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of f, rows of g, distances) that match; rows must stand in the order of their ids, as the first of equals wins."""
    none = np.empty(0, int), np.empty(0, int), np.empty(0)
    if not len(f) or not len(g):
        return none
    d = gaps(f, g, metric)
    one = np.arange(len(f))
    two = d.argmin(axis=1)
    near = d[one, two]
    good = np.isfinite(near)
    if mutual:
        good &= d.argmin(axis=0)[two] == one
    if max_ratio is not None and len(g) > 1:
        second = np.partition(d, 1, axis=1)[:, 1]
        good &= near <= max_ratio * np.maximum(second, 1e-3)
    if threshold is not None:
        good &= near <= threshold
    return one[good], two[good], near[good]


def nearest(left: DataFrame, right: DataFrame, on: list[str], *, metric: str = "squared", max_ratio: float | None = None, threshold: float | None = None, mutual: bool = True) -> DataFrame:
    """(on, kp1, kp2, d2) of left (on, kp1, f1) and right (on, kp2, f2): matches that are each other's nearest (ties: smaller ids); max_ratio bounds d2 of the
    nearest against the second nearest of kp1, threshold d2 itself. Without mutual, each kp1 has its nearest. metric: squared, unit or hamming."""
    if metric not in ("squared", "unit", "hamming"):
        raise ValueError("metric is squared, unit or hamming")

    def gathered(side: DataFrame, n: int) -> DataFrame:
        return side.groupBy(*on).agg(F.array_sort(F.collect_list(F.struct(F.col(f"kp{n}").alias("kp"), F.col(f"f{n}").alias("f")))).alias(f"s{n}")).select(*on, F.col(f"s{n}.kp").alias(f"k{n}"), F.col(f"s{n}.f").alias(f"d{n}"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in parts(batches):
            pair, kp1, kp2, gap = [], [], [], []
            for n, (k1, d1, k2, d2) in enumerate(zip(batch["k1"], batch["d1"], batch["k2"], batch["d2"], strict=True)):
                (i, f), (j, g) = table(list(d1), metric == "hamming"), table(list(d2), metric == "hamming")
                one, two, near = best_matches(f, g, metric=metric, max_ratio=max_ratio, threshold=threshold, mutual=mutual)
                pair += [n] * len(one)
                kp1 += [k1[a] for a in i[one]]
                kp2 += [k2[a] for a in j[two]]
                gap.append(near)
            yield batch[on].iloc[pair].reset_index(drop=True).assign(kp1=kp1, kp2=kp2, d2=np.concatenate(gap))

    kinds = ", ".join(f"`{c}` {left.schema[c].dataType.simpleString()}" for c in on)
    ids = f"kp1 {left.schema['kp1'].dataType.simpleString()}, kp2 {right.schema['kp2'].dataType.simpleString()}"
    return gathered(left, 1).join(gathered(right, 2), on).mapInPandas(run, f"{kinds}, {ids}, d2 double")


def mutual_nearest(dist: DataFrame, on: list[str], *, max_ratio: float | None = None, threshold: float | None = None, mutual: bool = True) -> DataFrame:
    """The same from a table of distances (on, kp1, kp2, d2), such as those of a few candidates a point."""
    ahead = Window.partitionBy(*on, "kp1").orderBy("d2", "kp2")
    back = Window.partitionBy(*on, "kp2").orderBy("d2", "kp1")
    out = dist.withColumn("r1", F.row_number().over(ahead)).withColumn("second", F.lead("d2").over(ahead)).withColumn("r2", F.row_number().over(back))
    out = out.where("r1 = 1 and r2 = 1" if mutual else "r1 = 1")
    if max_ratio is not None:
        out = out.where(F.col("second").isNull() | (F.col("d2") <= max_ratio * F.greatest("second", F.lit(1e-3))))
    if threshold is not None:
        out = out.where(F.col("d2") <= threshold)
    return out.select(*on, "kp1", "kp2", "d2")


def within_radius(left: DataFrame, right: DataFrame, on: list[str], radius: float) -> DataFrame:
    """Pairs of points (x1, y1), (x2, y2) no further apart than radius: a join on grid cells, not a nested loop."""
    near = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    one = left.withColumn("cx", F.floor(F.col("x1") / radius)).withColumn("cy", F.floor(F.col("y1") / radius))
    two = right.withColumn("o", near).withColumn("cx", F.floor(F.col("x2") / radius) + F.col("o.i")).withColumn("cy", F.floor(F.col("y2") / radius) + F.col("o.j")).drop("o")
    gap = F.pow(F.col("x1") - F.col("x2"), 2) + F.pow(F.col("y1") - F.col("y2"), 2)
    return one.join(two, [*on, "cx", "cy"]).where(gap <= radius * radius).drop("cx", "cy")


#: What stands for the second nearest where there is none.
FAR = 1e30


def radius_matches(left: DataFrame, right: DataFrame, on: list[str], radius: float, *, mutual: bool = True) -> DataFrame:
    """(on, kp1, kp2, ratio): of points (kp1, x1, y1, f1) and (kp2, x2, y2, f2) within the radius, the nearest by descriptor; ratio is its squared
    distance by the second nearest's, that one at least 1e-3. Points without any other in reach have no match."""
    d = within_radius(left, right, on, radius).select(*on, "kp1", "kp2", squared_distance(F.col("f1"), F.col("f2")).alias("d2")).where("d2 is not null")
    ahead = Window.partitionBy(*on, "kp1").orderBy("d2", "kp2")
    back = Window.partitionBy(*on, "kp2").orderBy("d2", "kp1")
    out = d.withColumn("r1", F.row_number().over(ahead)).withColumn("second", F.coalesce(F.lead("d2").over(ahead), F.lit(FAR))).withColumn("r2", F.row_number().over(back))
    out = out.where("r1 = 1 and r2 = 1" if mutual else "r1 = 1")
    return out.select(*on, "kp1", "kp2", (F.col("d2") / F.greatest("second", F.lit(1e-3))).alias("ratio"))


def gathered_points(matches: DataFrame, left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """(on, m, x1, y1, x2, y2) of matches (on, kp1, kp2) and points (on, kp1, x1, y1), (on, kp2, x2, y2); m is kp1."""
    both = matches.join(left.select(*on, "kp1", "x1", "y1"), [*on, "kp1"]).join(right.select(*on, "kp2", "x2", "y2"), [*on, "kp2"])
    return both.select(*on, F.col("kp1").alias("m"), "x1", "y1", "x2", "y2")
