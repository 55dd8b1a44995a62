"""Registration of neighbouring tiles end to end: a shift for each pair by one of several methods, with counts, status, error and measures of the overlap.

Any number of data sets go through at once, and their tiles may be numbered alike: pairs, keypoints and measures are told apart by data set. Tiles may differ in
size: a table of tiles has columns `height` and `width`, or one size is given for all.

By features, a tile travels once to be looked at: with it go the regions (at most four, of the pairs it is part of) in which keypoints are looked for, and what
comes back are arrays of points, a row for each pair and side. They meet once a pair, in one product of matrices. By correlation, a pair's pixels
meet once, and shift and measures are taken in that task.

Nulls, ties and odd sizes: as in the parts; a pair whose tiles have no pixels, or whose method fails, has a row with a status other than 0 and nulls, never
NaN; shifts are rounded to whole pixels for the overlap (half away from zero); an overlap of fewer than two pixels has no measures; a tile whose array has
another length than height * width has no pixels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import detect, matching, metrics, robust, spectral
from tessera.operators.parts import parts as in_parts
from tessera.plans import overlap as O

KEYS = ["dataset", "i", "j", "direction"]
COLUMNS = ["n_kp_prev", "n_kp", "n_match", "n_inlier"]


def sized(tiles: DataFrame, height: int | None, width: int | None) -> DataFrame:
    """tiles with height and width, those given where the table has none."""
    for name, given in (("height", height), ("width", width)):
        if name not in tiles.columns:
            if given is None:
                raise ValueError(f"tiles have no column {name}, and none is given")
            tiles = tiles.withColumn(name, F.lit(given))
    return tiles


def neighbours(tiles: DataFrame, height: int | None = None, width: int | None = None) -> DataFrame:
    """(dataset, i, j, direction, prev, cur, pa, ha, wa, pb, hb, wb): each pair with both pixel arrays and their sizes."""
    tiles = sized(tiles, height, width)
    pairs = O.neighbour_pairs(tiles, ("dataset",))
    side = lambda name, n: tiles.select("dataset", F.col("tile_id").alias(name), F.col("pixels").alias(f"p{n}"), F.col("height").alias(f"h{n}"), F.col("width").alias(f"w{n}"))
    return pairs.join(side("prev", "a"), ["dataset", "prev"]).join(side("cur", "b"), ["dataset", "cur"])


def image(pixels: object, height: int, width: int) -> np.ndarray | None:
    """A tile's pixels as a matrix; None if they aren't whole."""
    if pixels is None or height is None or width is None or len(pixels) != height * width:
        return None
    v = np.asarray(pixels, float)
    return v.reshape(int(height), int(width)) if np.isfinite(v).all() else None


def overlap_measures(a: np.ndarray | None, b: np.ndarray | None, tx: float | None, ty: float | None) -> tuple[float | None, float | None]:
    """(rmse, ssim) of what a shares with b moved by (tx, ty), rounded half away from zero; None where they are undefined."""
    if a is None or b is None or tx is None or ty is None or not (np.isfinite(tx) and np.isfinite(ty)):
        return None, None
    p, q = spectral.shared(a, b, *(int(np.sign(t) * np.floor(abs(t) + 0.5)) for t in (tx, ty)))
    if p.size < 2:
        return None, None
    rmse = float(np.sqrt(((q - p) ** 2).mean()))
    ma, mb = p.max(), q.max()
    if not ma or not mb:
        return rmse, None
    ua, ub, va, vb = p.mean() / ma, q.mean() / mb, p.var(ddof=1) / ma**2, q.var(ddof=1) / mb**2
    below = (ua * ua + ub * ub) * (va + vb)
    cov = ((p - p.mean()) * (q - q.mean())).sum() / (p.size - 1) / (ma * mb)
    return rmse, float(4 * ua * ub * cov / below) if below else None


def key_kinds(tiles: DataFrame) -> str:
    return f"dataset {tiles.schema['dataset'].dataType.simpleString()}, i int, j int, direction string"


def by_correlation(tiles: DataFrame, method: str, overlap: float) -> DataFrame:
    """(keys, tx, ty, ncc, status, rmse, ssim) by method ncc or phase."""
    pairs = neighbours(tiles).select(*KEYS, "pa", "ha", "wa", "pb", "hb", "wb")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in in_parts(batches):
            sides = [(image(pa, ha, wa), image(pb, hb, wb)) for pa, ha, wa, pb, hb, wb in zip(*(x[c] for c in ("pa", "ha", "wa", "pb", "hb", "wb")), strict=True)]
            got = spectral.shifts(sides, x["direction"].tolist(), method, overlap)
            rows = [(None, None, None, 1) if g is None else (float(g[0]), float(g[1]), round(g[2], 6), 0) for g in got]
            rows = [(*r, *overlap_measures(a, b, r[0], r[1])) for r, (a, b) in zip(rows, sides, strict=True)]
            yield pd.concat([x[KEYS].reset_index(drop=True), pd.DataFrame(rows, columns=["tx", "ty", "ncc", "status", "rmse", "ssim"])], axis=1)

    return pairs.mapInPandas(run, f"{key_kinds(tiles)}, tx double, ty double, ncc double, status int, rmse double, ssim double")


def regions(tiles: DataFrame, overlap: float | None) -> DataFrame:
    """(dataset, tile_id, regions: i, j, direction, side (1 prev, 2 cur)) of each tile that is part of a pair."""
    pairs = O.neighbour_pairs(tiles, ("dataset",))
    side = lambda name, n: pairs.select("dataset", F.col(name).alias("tile_id"), F.struct("i", "j", "direction", F.lit(n).alias("side")).alias("region"))
    return side("prev", 1).unionByName(side("cur", 2)).groupBy("dataset", "tile_id").agg(F.collect_list("region").alias("regions"))


def window(height: int, width: int, direction: str, side: int, overlap: float | None) -> tuple[int, int, int, int]:
    """(first row, row after the last, first column, column after the last) of the strip that neighbours share: north, the current tile's top rows and the
    upper tile's bottom rows; west, the same with columns; floor(size * overlap) of them, all without overlap."""
    if overlap is None:
        return 0, height, 0, width
    n = int((height if direction == "north" else width) * overlap)
    if direction == "north":
        return (height - n, height, 0, width) if side == 1 else (0, n, 0, width)
    return (0, height, width - n, width) if side == 1 else (0, height, 0, n)


def region_points(tiles: DataFrame, method: str, overlap: float | None, *, least: float = 0.0, most: int | None = None, blocks: int = 1, masked: bool = False, radius: int = 1) -> DataFrame:
    """(keys, side, n, x, y, f: descriptors or, from methods with bits, b: their words) of the keypoints of each pair and side, in the strip that overlaps.

    The strip is cut out before detection; masked, the whole tile is looked at and points outside the strip are dropped. `least` is the least score, or a column
    `least` of the tiles, so that each data set may have its own; `most` the best of a strip, or with blocks, most // blocks**2 of each of blocks x blocks parts."""
    where = tiles.select("dataset", "tile_id", "pixels", "height", "width", (F.col("least") if "least" in tiles.columns else F.lit(float(least))).cast("double").alias("least"))
    rows = where.join(regions(tiles, overlap), ["dataset", "tile_id"])
    kind = tiles.schema["dataset"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in in_parts(batches):
            out = []
            for dataset, pixels, h, w, bound, parts in zip(*(batch[c] for c in ("dataset", "pixels", "height", "width", "least", "regions")), strict=True):
                v = image(pixels, h, w)
                seen: dict[tuple[int, int, int, int], detect.Points] = {}
                whole = detect.points_of(v, method, least=bound, radius=radius) if v is not None and masked else None
                for part in parts:
                    cut = window(h, w, part["direction"], part["side"], overlap)
                    if v is None or pd.isna(bound):
                        out.append((dataset, part["i"], part["j"], part["direction"], part["side"], 0, [], [], [], []))
                        continue
                    if cut not in seen:
                        r0, r1, c0, c1 = cut
                        found = whole.inside(*cut) if masked else detect.points_of(v[r0:r1, c0:c1], method, least=bound, radius=radius).moved(c0, r0)
                        seen[cut] = found.quota(cut, most, blocks)
                    p = seen[cut]
                    out.append((dataset, part["i"], part["j"], part["direction"], part["side"], len(p.x), p.x, p.y, list(p.f), list(p.bits)))
            yield pd.DataFrame(out, columns=[*KEYS, "side", "n", "x", "y", "f", "b"])

    return rows.mapInPandas(run, f"dataset {kind}, i int, j int, direction string, side int, n bigint, x array<double>, y array<double>, f array<array<double>>, b array<array<bigint>>")


def by_features(tiles: DataFrame, method: str, overlap: float | None, *, max_ratio: float | None = None, threshold: float | None = None, max_distance: float = 1.5, least_matches: int = 1, **how) -> DataFrame:
    """(keys, tx, ty, counts, status, error) by keypoints of a detector, in the strips that overlap or, without overlap, in whole tiles."""
    points = region_points(tiles, method, overlap, **how)
    side = lambda n: points.where(F.col("side") == n).select(*KEYS, *(F.col(c).alias(f"{c}{n}") for c in ("n", "x", "y", "f", "b")))
    metric = "hamming" if method in detect.BINARY else "squared"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in in_parts(batches):
            rows = []
            for f1, f2, x1, y1, x2, y2 in zip(*(x[c] for c in (("b1", "b2") if metric == "hamming" else ("f1", "f2"))), x["x1"], x["y1"], x["x2"], x["y2"], strict=True):
                (_, f), (_, g) = matching.table(list(f1), metric == "hamming"), matching.table(list(f2), metric == "hamming")
                one, two, _ = matching.best_matches(f, g, metric=metric, max_ratio=max_ratio, threshold=threshold)
                # the current tile's place in the upper or left one
                rows.append([{"m": int(a), "dx": float(x1[a] - x2[b]), "dy": float(y1[a] - y2[b])} for a, b in zip(one.tolist(), two.tolist(), strict=True)])
            yield x[[*KEYS, "n1", "n2"]].assign(s=rows)

    both = side(1).join(side(2), KEYS).mapInPandas(run, f"{key_kinds(tiles)}, n1 bigint, n2 bigint, s array<struct<m: int, dx: double, dy: double>>")
    fit = robust.msac_shift(both.withColumnRenamed("s", "__s"), [*KEYS, "n1", "n2"], max_distance=max_distance, least=least_matches)
    out = fit.withColumnsRenamed({"n1": "n_kp_prev", "n2": "n_kp"})
    return out.select(*KEYS, "tx", "ty", *COLUMNS, F.when(F.col("n_match") == 0, robust.FEW_MATCHES).otherwise(F.col("status")).alias("status"), "error")


def measured(found: DataFrame, tiles: DataFrame, height: int | None = None, width: int | None = None) -> DataFrame:
    """Adds rmse and ssim of the pixels that the tiles of each pair share under its shift (tx, ty), rounded to whole pixels; found is read once."""
    both = found.join(neighbours(tiles, height, width).select(*KEYS, "pa", "ha", "wa", "pb", "hb", "wb"), KEYS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sides = ["pa", "ha", "wa", "pb", "hb", "wb"]
        for x in in_parts(batches):
            got = [overlap_measures(image(pa, ha, wa), image(pb, hb, wb), tx, ty) for pa, ha, wa, pb, hb, wb, tx, ty in zip(*(x[c] for c in sides), x["tx"], x["ty"], strict=True)]
            yield x.drop(columns=sides).assign(rmse=pd.Series([r for r, _ in got], x.index, dtype=float), ssim=pd.Series([s for _, s in got], x.index, dtype=float))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema)
    return both.select(*found.columns, "pa", "ha", "wa", "pb", "hb", "wb").mapInPandas(run, f"{kinds}, rmse double, ssim double")


def register(tiles: DataFrame, height: int | None = None, width: int | None = None, method: str = "phase", *, overlap: float | None = 0.25, **how) -> DataFrame:
    """A row for each pair of tiles (dataset, tile_id, i, j, pixels, maybe height, width, least): keys, method, tx, ty, ncc, n_kp_prev, n_kp, n_match, n_inlier,
    status, error, rmse, ssim.

    method is phase, ncc or a detector's name; overlap is the share that neighbours share, None for whole tiles (detectors only); the rest goes to by_features()
    and region_points(). The robust fit compares all matches of a pair with each other: give `most` where tiles have many thousands of keypoints."""
    tiles = sized(tiles, height, width)
    if method in ("phase", "ncc"):
        out = by_correlation(tiles, method, 0.5 if overlap is None else overlap).withColumns({c: F.lit(None).cast("bigint") for c in COLUMNS} | {"error": F.lit(None).cast("double")})
    elif method in detect.NAMES():
        out = measured(by_features(tiles, method, overlap, **how), tiles).withColumn("ncc", F.lit(None).cast("double"))
    else:
        raise ValueError(f"unknown method {method!r}; there are phase, ncc, {', '.join(detect.NAMES())}")
    return out.select(*KEYS, F.lit(method).alias("method"), "tx", "ty", "ncc", *COLUMNS, "status", "error", "rmse", "ssim")


def summary(results: DataFrame) -> DataFrame:
    """(dataset, method, n_pairs, n_failed, average_rmse, average_ssim): unweighted means of the two directions' means, failures left out."""
    means = metrics.mean_of_means(results, ["dataset", "method"], "direction", ["rmse", "ssim"])
    counts = results.groupBy("dataset", "method").agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.col("status") != 0).alias("n_failed"))
    return counts.join(means, ["dataset", "method"])
