"""Keypoint detectors by name, as vectorised functions over tiles.

Corner detectors (harris, min_eigen, hessian, fast) map a stack (n, height, width) to scores of the same shape; their points are what suppression leaves, their descriptor is the
normalised patch around a point. register() adds one. The others find points of an image themselves, at places between pixels, with size, direction and a
descriptor of their own: sift, surf and kaze (scale_space), orb and brisk (binary: words of bits), mser (extremal).

Nulls, ties and odd sizes: a tile whose pixel array is null, of another length or holds a null has no keypoints; tiles may differ in size where the table has
columns height and width; equal scores go by y, then x; a constant tile has no keypoints above 0; `most` is None unless points are to be limited to the best of a tile; an
empty table gives no rows. Tiles are told apart by the key columns given, of any types; other columns are not kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import binary, extremal, scale_space
from tessera.operators.corners import RING, blurred, box, fast, gradients, harris, hessian, hessian_of, min_eigen, padded, structure  # noqa: F401
from tessera.operators.parts import parts
from tessera.operators.points import Points, suppress
from tessera.operators.spectral import stacked

DETECTORS: dict[str, Callable[[np.ndarray], np.ndarray]] = {"harris": harris, "min_eigen": min_eigen, "hessian": hessian, "fast": fast}
#: Methods that give points with their own descriptors, and those of them whose descriptors are bits.
FEATURES: dict[str, Callable[..., Points]] = {"sift": scale_space.sift, "surf": scale_space.surf, "kaze": scale_space.kaze, "orb": binary.orb, "brisk": binary.brisk, "mser": extremal.mser}
BINARY = ("orb", "brisk")


def NAMES() -> list[str]:  # noqa: N802
    return [*DETECTORS, *FEATURES]


def register(name: str, response: Callable[[np.ndarray], np.ndarray]) -> None:
    """Add a detector: a function from a stack of tiles to scores."""
    if not callable(response):
        raise TypeError("a detector is a function")
    DETECTORS[name] = response


def points_of(v: np.ndarray, method: str, *, least: float = 0.0, radius: int = 1, patch: int = 3) -> Points:
    """Keypoints of one image by name, best first."""
    if not v.size:
        return Points.of([], [], [])
    if method in FEATURES:
        return FEATURES[method](v, least)
    s = DETECTORS[method](v[None])[0]
    y, x = np.nonzero(s > least)
    points, score = np.stack((x, y), axis=1), s[y, x]
    stay = suppress(points, score, radius)
    points, score = points[stay], score[stay]
    pad = padded(v[None], patch)[0]
    f = np.array([pad[py : py + 2 * patch + 1, px : px + 2 * patch + 1].ravel() for px, py in points]).reshape(len(stay), (2 * patch + 1) ** 2)
    f = f - f.mean(axis=1, keepdims=True) if len(f) else f
    length = np.sqrt((f * f).sum(axis=1, keepdims=True))
    one = np.ones(len(stay))
    return Points(points[:, 0].astype(float), points[:, 1].astype(float), score, one, 0 * one, f / np.where(length > 0, length, 1), np.empty((len(stay), 0), np.int64))


def responses(tiles: DataFrame, height: int, width: int, methods: list[str]) -> DataFrame:
    """(tile_id, r, c, a column of scores for each corner method)."""
    found = {m: DETECTORS[m] for m in methods}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in parts(batches):
            good, v = stacked(batch["pixels"].tolist(), height, width)
            p = np.arange(height * width)
            out = {"tile_id": np.repeat(batch["tile_id"].to_numpy()[good], len(p)), "r": np.tile(p // width, len(v)), "c": np.tile(p % width, len(v))}
            yield pd.DataFrame(out | {m: (f(v) if len(v) else v).ravel() for m, f in found.items()})

    kind = tiles.schema["tile_id"].dataType.simpleString()
    return tiles.select("tile_id", "pixels").mapInPandas(run, f"tile_id {kind}, r int, c int, " + ", ".join(f"{m} double" for m in methods))


def scale_responses(tiles: DataFrame, height: int, width: int, sigmas: tuple[float, float]) -> DataFrame:
    """(tile_id, r, c, dog): the tile smoothed by the second sigma less the tile smoothed by the first, the response of which SIFT takes the peaks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in parts(batches):
            good, v = stacked(batch["pixels"].tolist(), height, width)
            p = np.arange(height * width)
            dog = blurred(v, sigmas[1]) - blurred(v, sigmas[0]) if len(v) else v
            yield pd.DataFrame({"tile_id": np.repeat(batch["tile_id"].to_numpy()[good], len(p)), "r": np.tile(p // width, len(v)), "c": np.tile(p % width, len(v)), "dog": dog.ravel()})

    return tiles.select("tile_id", "pixels").mapInPandas(run, f"tile_id {tiles.schema['tile_id'].dataType.simpleString()}, r int, c int, dog double")


def detect(tiles: DataFrame, height: int | None, width: int | None, method: str, *, keys: tuple[str, ...] = ("tile_id",), least: float = 0.0, radius: int = 1, most: int | None = None, blocks: int = 1, patch: int = 3) -> DataFrame:
    """(keys, kp_id, x, y, score, size, angle, descriptor, bits) of each tile's points above `least`, best first. most and blocks: see Points.quota()."""
    if method not in NAMES():
        raise ValueError(f"unknown method {method!r}; there are {', '.join(NAMES())}")
    for name, given in (("height", height), ("width", width)):
        if name not in tiles.columns:
            tiles = tiles.withColumn(name, F.lit(given).cast("int"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in parts(batches):
            rows = []
            for *tile, pixels, h, w in zip(*(batch[c] for c in (*keys, "pixels", "height", "width")), strict=True):
                good, v = stacked([pixels], int(h), int(w)) if pd.notna(h) and pd.notna(w) else (np.zeros(1, bool), None)
                if not good[0]:
                    continue
                p = points_of(v[0], method, least=least, radius=radius, patch=patch).quota((0, int(h), 0, int(w)), most, blocks)
                numbers = (np.round(c, 6).tolist() for c in (p.score, p.size, p.angle))
                rows += [(*tile, n, *r) for n, r in enumerate(zip(p.x.tolist(), p.y.tolist(), *numbers, p.f, p.bits, strict=True))]
            yield pd.DataFrame(rows, columns=[*keys, "kp_id", "x", "y", "score", "size", "angle", "descriptor", "bits"])

    kinds = ", ".join(f"`{c}` {tiles.schema[c].dataType.simpleString()}" for c in keys)
    return tiles.select(*keys, "pixels", "height", "width").mapInPandas(run, f"{kinds}, kp_id int, x double, y double, score double, size double, angle double, descriptor array<double>, bits array<bigint>")
