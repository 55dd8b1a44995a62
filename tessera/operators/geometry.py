"""Plane transforms as struct columns m00 to m22 (column vectors: x' = m00 x + m01 y + m02), and their fits from matches (keys, x1, y1, x2, y2).

Nulls and odd rows: a transform or point with a null gives null; a matrix whose determinant is 0 or not finite has no inverse (null); matches with a
null coordinate are left out of fits; groups of too few or collinear points give null parameters, never NaN; repeated matches count each; equal
results don't depend on row order but for rounding; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS = [f"m{i}{j}" for i in range(3) for j in range(3)]


def matrix(*cells: Column | float) -> Column:
    """Nine cells row by row, or six of an affine map."""
    cells = [*cells, 0.0, 0.0, 1.0] if len(cells) == 6 else cells
    return F.struct(*((c if isinstance(c, Column) else F.lit(float(c))).cast("double").alias(n) for n, c in zip(CELLS, cells, strict=True)))


def translation(tx: Column, ty: Column) -> Column:
    return matrix(1, 0, tx, 0, 1, ty)


def rotation(angle: Column) -> Column:
    """Counter-clockwise for an upward y axis, in radians."""
    return matrix(F.cos(angle), -F.sin(angle), 0, F.sin(angle), F.cos(angle), 0)


def scaling(sx: Column, sy: Column) -> Column:
    return matrix(sx, 0, 0, 0, sy, 0)


def bound(of: Callable[..., Column], *values: Column) -> Column:
    """of(values) with each value computed once, as a lambda's variable: plans of plain nested expressions would repeat them where they are used."""
    one = F.struct(*(v.alias(f"v{i}") for i, v in enumerate(values)))
    return F.transform(F.array(one), lambda x: of(*(x[f"v{i}"] for i in range(len(values)))))[0]


def composed(first: Column, then: Column) -> Column:
    """The transform that applies `first`, then `then`."""

    def product(a: Column, b: Column) -> Column:
        dot = lambda i, j: b[f"m{i}0"] * a[f"m0{j}"] + b[f"m{i}1"] * a[f"m1{j}"] + b[f"m{i}2"] * a[f"m2{j}"]
        return matrix(*(dot(i, j) for i in range(3) for j in range(3)))

    return bound(product, first, then)


def determinant(m: Column) -> Column:
    def of(m: Column) -> Column:
        a = lambda i, j: m[f"m{i}{j}"]
        return a(0, 0) * (a(1, 1) * a(2, 2) - a(1, 2) * a(2, 1)) - a(0, 1) * (a(1, 0) * a(2, 2) - a(1, 2) * a(2, 0)) + a(0, 2) * (a(1, 0) * a(2, 1) - a(1, 1) * a(2, 0))

    return bound(of, m)


def valid(m: Column) -> Column:
    """All cells finite and a determinant other than 0."""

    def of(m: Column, det: Column) -> Column:
        out = det != 0
        for c in (m[n] for n in CELLS):
            out = out & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < math.inf)
        return F.coalesce(out, F.lit(False))

    return bound(of, m, determinant(m))


def inverse(m: Column) -> Column:
    def of(m: Column, det: Column, good: Column) -> Column:
        a = lambda i, j: m[f"m{i % 3}{j % 3}"]
        cofactor = lambda i, j: a(i + 1, j + 1) * a(i + 2, j + 2) - a(i + 1, j + 2) * a(i + 2, j + 1)
        return F.when(good, matrix(*(F.try_divide(cofactor(j, i), det) for i in range(3) for j in range(3))))

    return bound(lambda m: bound(of, m, determinant(m), valid(m)), m)


def applied(m: Column, x: Column, y: Column) -> Column:
    """struct(x, y); null where the point goes to infinity."""

    def of(m: Column, x: Column, y: Column) -> Column:
        row = lambda i: m[f"m{i}0"] * x + m[f"m{i}1"] * y + m[f"m{i}2"]
        w = F.when(F.abs(row(2)) >= np.finfo(float).eps, row(2))
        return F.struct((row(0) / w).alias("x"), (row(1) / w).alias("y"))

    return bound(of, m, x, y)


def residual(m: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of the moved first point from the second; infinite where it goes to infinity."""
    far = lambda p, x2, y2: F.coalesce(F.hypot(p["x"] - x2, p["y"] - y2), F.lit(math.inf))
    return F.when(x1.isNotNull() & y1.isNotNull() & x2.isNotNull() & y2.isNotNull(), bound(far, applied(m, x1, y1), x2, y2))


def angle(m: Column) -> Column:
    return F.atan2(m["m10"], m["m00"])


def shift(m: Column) -> Column:
    return F.struct(m["m02"].alias("x"), m["m12"].alias("y"))


def normalised(width: Column, height: Column) -> Column:
    """Pixels to coordinates from -1 to 1."""
    return matrix(2.0 / width, 0, -1, 0, 2.0 / height, -1)


def theta(m: Column, width: Column, height: Column) -> Column:
    """The map between normalised coordinates that draws an image moved by m: from places of the result to places of the source."""
    return bound(lambda m, n: inverse(composed(composed(inverse(n), m), n)), m, normalised(width, height))


SUMS = ("x1", "y1", "x2", "y2")


def moments(matches: DataFrame, keys: list[str]) -> DataFrame:
    """Means, and covariances of all coordinates as c_<first>_<second>."""
    some = matches.dropna(subset=list(SUMS))
    pairs = [(a, b) for i, a in enumerate(SUMS) for b in SUMS[i:]]
    return some.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(F.avg(a).alias(f"m_{a}") for a in SUMS), *(F.covar_pop(a, b).alias(f"c_{a}_{b}") for a, b in pairs))


def similarity_fit(matches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, a, b, tx, ty): least squares of x2 = a x1 - b y1 + tx, y2 = b x1 + a y1 + ty; null with fewer than two different points."""
    s = moments(matches, keys)
    spread = F.col("c_x1_x1") + F.col("c_y1_y1")
    ok = (F.col("n") >= 2) & (spread > 1e-9)
    s = s.withColumn("a", F.when(ok, (F.col("c_x1_x2") + F.col("c_y1_y2")) / spread)).withColumn("b", F.when(ok, (F.col("c_x1_y2") - F.col("c_y1_x2")) / spread))
    return s.select(*keys, "n", "a", "b", (F.col("m_x2") - F.col("a") * F.col("m_x1") + F.col("b") * F.col("m_y1")).alias("tx"), (F.col("m_y2") - F.col("b") * F.col("m_x1") - F.col("a") * F.col("m_y1")).alias("ty"))


def affine_map_fit(matches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, m00 to m12): least squares of both coordinates; null with fewer than three points or when they lie on a line."""
    s = moments(matches, keys)
    xx, yy, xy = (F.col(f"c_{c}") for c in ("x1_x1", "y1_y1", "x1_y1"))
    det = xx * yy - xy * xy
    ok = (F.col("n") >= 3) & (det > 1e-9)
    out = s
    for i, u in enumerate(("x2", "y2")):
        xu, yu = F.col(f"c_x1_{u}"), F.col(f"c_y1_{u}")
        out = out.withColumn(f"m{i}0", F.when(ok, (xu * yy - yu * xy) / det)).withColumn(f"m{i}1", F.when(ok, (yu * xx - xu * xy) / det))
        out = out.withColumn(f"m{i}2", F.col(f"m_{u}") - F.col(f"m{i}0") * F.col("m_x1") - F.col(f"m{i}1") * F.col("m_y1"))
    return out.select(*keys, "n", "m00", "m01", "m02", "m10", "m11", "m12")


def normaliser(points: DataFrame, keys: list[str], x: str = "x1", y: str = "y1") -> DataFrame:
    """(keys, scale, ox, oy): x * scale + ox and y * scale + oy have mean 0 and a mean distance of sqrt(2) from it; null if all points are one."""
    centre = points.dropna(subset=[x, y]).groupBy(*keys).agg(F.avg(x).alias("mx"), F.avg(y).alias("my"))
    far = points.dropna(subset=[x, y]).join(centre, keys).groupBy(*keys, "mx", "my").agg(F.avg(F.hypot(F.col(x) - F.col("mx"), F.col(y) - F.col("my"))).alias("d"))
    scale = F.try_divide(F.lit(math.sqrt(2)), F.when(F.col("d") > 1e-12, F.col("d")))
    return far.select(*keys, scale.alias("scale"), (-F.col("mx") * scale).alias("ox"), (-F.col("my") * scale).alias("oy"))


def projective(p: np.ndarray, q: np.ndarray) -> np.ndarray | None:
    """3 x 3 map of points p to q by the normalised direct linear transform, or None."""

    def centred(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        far = np.hypot(*(x - x.mean(axis=0)).T).mean()
        s = math.sqrt(2) / far if far > 1e-12 else 1.0
        t = np.array([[s, 0, -s * x[:, 0].mean()], [0, s, -s * x[:, 1].mean()], [0, 0, 1]])
        return x * s + t[:2, 2], t

    if len(p) < 4:
        return None
    (a, ta), (b, tb) = centred(p), centred(q)
    one, none = np.ones(len(a)), np.zeros((len(a), 3))
    h = np.column_stack((a, one))
    rows = np.concatenate((np.column_stack((h, none, -b[:, :1] * h)), np.column_stack((none, h, -b[:, 1:] * h))))
    # beyond nine rows the whole left side would be a matrix of rows times rows, which nothing needs
    _, s, v = np.linalg.svd(rows, full_matrices=len(rows) < 9)
    if s[7] < 1e-9 * s[0]:
        return None
    m = np.linalg.inv(tb) @ v[-1].reshape(3, 3) @ ta
    return m / m[2, 2] if abs(m[2, 2]) > 1e-12 else None


def projective_fit(matches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, m00 to m22): the projective map of each group's matches, null with fewer than four points in general position. A group's matches
    meet in one task: they are meant to be bounded by a quota of points for a pair of tiles."""

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        some = rows.dropna(subset=list(SUMS))
        m = projective(some[["x1", "y1"]].to_numpy(float), some[["x2", "y2"]].to_numpy(float))
        out = rows[keys].head(1).copy()
        out["n"] = len(some)
        for name, value in zip(CELLS, [None] * 9 if m is None else m.ravel().tolist(), strict=True):
            out[name] = pd.Series([value], index=out.index, dtype="float64")
        return out

    kinds = ", ".join(f"`{k}` {matches.schema[k].dataType.simpleString()}" for k in keys)
    return matches.groupBy(*keys).applyInPandas(fit, f"{kinds}, n bigint, " + ", ".join(f"{n} double" for n in CELLS))
