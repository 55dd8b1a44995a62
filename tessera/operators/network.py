"""Convolutional networks over tiles and over images larger than a row: layers as data, weights from any file of arrays, broadcast once.

An image that is too large for a row comes in blocks. Each block sends its neighbours the edges they need (the halo), and is computed with its own; as a frame ends where the image ends and
nowhere else, results are the same to the last place as those of the whole image, seams included, as soon as the halo covers what a result depends on (`reach`).

The detector with two heads (65 values and a descriptor for each cell of 8 x 8 pixels) follows its paper (DeTone et al. 2018); its published weights are not here, any others
will do.

Nulls and odd sizes: a tile whose pixel array is null or of another length than height * width has no rows; sides that 8 doesn't divide lose the rest, as pooling does; a
descriptor of length 0 stays 0; missing blocks are beyond the image's edge; an empty table gives no rows.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import heads, rank

CELL = 8
#: Channels of the encoder's pairs of convolutions, of the heads' first ones, and of their ends, as published. Fixed values.
ENCODER, HEAD, ENDS = (64, 64, 128, 128), 256, {"detector": 65, "descriptor": 256}


@dataclass(frozen=True)
class Layer:
    """conv (weights: out, in, height, width; bias), relu or pool (maximum of 2 x 2)."""

    kind: str
    weights: np.ndarray | None = None
    bias: np.ndarray | None = None


def convolved(x: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """(height, width, out) of an image (height, width, in), with zeros beyond its edges."""
    kh, kw = weights.shape[2:]
    p = np.pad(x, ((kh // 2, kh // 2), (kw // 2, kw // 2), (0, 0)))
    out = np.zeros((*x.shape[:2], weights.shape[0]))
    for a in range(kh):
        for b in range(kw):
            out += p[a : a + x.shape[0], b : b + x.shape[1]] @ weights[:, :, a, b].T
    return out + bias


def applied(x: np.ndarray, layers: Sequence[Layer]) -> np.ndarray:
    for layer in layers:
        if layer.kind == "conv":
            x = convolved(x, layer.weights, layer.bias)
        elif layer.kind == "relu":
            x = np.maximum(x, 0)
        elif layer.kind == "pool":
            h, w = x.shape[0] // 2 * 2, x.shape[1] // 2 * 2
            x = x[:h, :w].reshape(h // 2, 2, w // 2, 2, -1).max(axis=(1, 3))
        else:
            raise ValueError(f"unknown layer {layer.kind!r}")
    return x


def reach(layers: Sequence[Layer]) -> int:
    """Pixels on each side that a result depends on."""
    far, scale = 0, 1
    for layer in layers:
        if layer.kind == "conv":
            far += scale * (max(layer.weights.shape[2:]) // 2)
        elif layer.kind == "pool":
            far, scale = far + scale, scale * 2
    return far


@dataclass(frozen=True)
class TwoHeads:
    """An encoder and the heads on it."""

    encoder: tuple[Layer, ...]
    detector: tuple[Layer, ...]
    descriptor: tuple[Layer, ...]

    def __call__(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(65 values, descriptor of length 1) of each cell of a grey image."""
        x = applied(v[..., None], self.encoder)
        d = applied(x, self.descriptor)
        length = np.sqrt((d * d).sum(axis=2, keepdims=True))
        return applied(x, self.detector), d / np.where(length > 0, length, 1)

    @property
    def reach(self) -> int:
        """In whole cells."""
        far = max(reach((*self.encoder, *head)) for head in (self.detector, self.descriptor))
        return -(-far // CELL) * CELL


def two_heads(arrays: dict[str, np.ndarray]) -> TwoHeads:
    """The network of arrays conv1a.weight, conv1a.bias, ... conv4b, convPa, convPb, convDa, convDb."""
    conv = lambda name: Layer("conv", np.asarray(arrays[f"{name}.weight"], float), np.asarray(arrays[f"{name}.bias"], float))
    encoder: list[Layer] = []
    for n in range(1, len(ENCODER) + 1):
        encoder += [Layer("pool")] if n > 1 else []
        for part in "ab":
            encoder += [conv(f"conv{n}{part}"), Layer("relu")]
    return TwoHeads(tuple(encoder), (conv("convPa"), Layer("relu"), conv("convPb")), (conv("convDa"), Layer("relu"), conv("convDb")))


def seeded(seed: int, share: float = 1.0) -> dict[str, np.ndarray]:
    """Arrays of chance for two_heads(), with this share of the published channels: for tests and trials of speed."""
    draw, out, before = np.random.default_rng(seed), {}, 1
    n = lambda c: max(1, round(c * share))

    def add(name: str, size: int, side: int, given: int) -> None:
        out[f"{name}.weight"] = draw.normal(0, np.sqrt(2 / (given * side * side)), (size, given, side, side))
        out[f"{name}.bias"] = draw.normal(0, 0.1, size)

    for k, c in enumerate(ENCODER, 1):
        for part in "ab":
            add(f"conv{k}{part}", n(c), 3, before)
            before = n(c)
    for name, end in (("P", ENDS["detector"]), ("D", n(ENDS["descriptor"]))):
        add(f"conv{name}a", n(HEAD), 3, before)
        add(f"conv{name}b", end, 1, n(HEAD))
    return out


def load(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    """Arrays by name of an .npz file in any store that Spark reads."""
    content = spark.read.format("binaryFile").load(path).select("content").first()["content"]
    with np.load(io.BytesIO(bytes(content)), allow_pickle=False) as found:
        return {name: found[name] for name in found.files}


def cell_rows(tile: object, semi: np.ndarray, vectors: np.ndarray, top: int, left: int) -> pd.DataFrame:
    i, j = (n.ravel() for n in np.indices(semi.shape[:2]))
    return pd.DataFrame({"tile_id": [tile] * len(i), "i": i + top, "j": j + left, "semi": list(semi.reshape(len(i), -1)), "vector": list(vectors.reshape(len(i), -1))})


def cells(tiles: DataFrame, network: TwoHeads, height: int | None = None, width: int | None = None) -> DataFrame:
    """(tile_id, i, j, semi, vector) of each cell of tiles (tile_id, pixels, maybe height, width)."""
    shared = tiles.sparkSession.sparkContext.broadcast(network)
    for name, given in (("height", height), ("width", width)):
        tiles = tiles if name in tiles.columns else tiles.withColumn(name, F.lit(given).cast("int"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for tile, pixels, h, w in zip(*(batch[c] for c in ("tile_id", "pixels", "height", "width")), strict=True):
                if pixels is not None and pd.notna(h) and pd.notna(w) and len(pixels) == h * w and min(h, w) >= CELL:
                    yield cell_rows(tile, *shared.value(np.asarray(pixels, float).reshape(int(h), int(w))), 0, 0)

    return tiles.select("tile_id", "pixels", "height", "width").mapInPandas(run, f"tile_id {tiles.schema['tile_id'].dataType.simpleString()}, i int, j int, semi array<double>, vector array<double>")


def with_halo(blocks: DataFrame, block: int, halo: int, of: Callable[[object, np.ndarray, int, int, int, int], pd.DataFrame], schema: str) -> DataFrame:
    """Of each block (image, row, col, height, width, pixels; all of `block` pixels a side but the last of a row or column) what `of` makes of (image, frame, row
    and column of the frame's first pixel, row and column of the block's first pixel). A frame is the block with `halo` pixels around it, as far as the image goes."""
    if halo > block:
        raise ValueError("a halo reaches into the next block at most")
    kind = blocks.schema["image"].dataType.simpleString()

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, row, col, h, w, pixels in zip(*(batch[c] for c in ("image", "row", "col", "height", "width", "pixels")), strict=True):
                v = np.asarray(pixels, float).reshape(h, w)
                for dr in (-1, 0, 1):
                    for dc in (-1, 0, 1):
                        # of the block (row, col) the block (row + dr, col + dc) sees this
                        r0, r1 = (0, min(h, halo)) if dr < 0 else (max(0, block - halo), h) if dr > 0 else (0, h)
                        c0, c1 = (0, min(w, halo)) if dc < 0 else (max(0, block - halo), w) if dc > 0 else (0, w)
                        if row + dr >= 0 and col + dc >= 0 and r0 < r1 and c0 < c1:
                            out.append((name, row + dr, col + dc, row * block + r0, col * block + c0, r1 - r0, c1 - c0, dr == dc == 0, v[r0:r1, c0:c1].ravel()))
            yield pd.DataFrame(out, columns=["image", "row", "col", "y", "x", "height", "width", "own", "pixels"])

    def compute(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        if not parts["own"].any():  # beyond the image's edge
            return pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")}, dtype=object)
        top, left = int(parts["y"].min()), int(parts["x"].min())
        frame = np.zeros((int((parts["y"] + parts["height"]).max()) - top, int((parts["x"] + parts["width"]).max()) - left))
        for y, x, h, w, pixels in zip(*(parts[c] for c in ("y", "x", "height", "width", "pixels")), strict=True):
            frame[y - top : y - top + h, x - left : x - left + w] = np.asarray(pixels, float).reshape(h, w)
        return of(key[0], frame, top, left, int(key[1]) * block, int(key[2]) * block)

    whole = blocks.where((F.size("pixels") == F.col("height") * F.col("width")) & (F.col("height") > 0))
    sent = whole.select("image", "row", "col", "height", "width", "pixels").mapInPandas(edges, f"image {kind}, row int, col int, y int, x int, height int, width int, own boolean, pixels array<double>")
    return sent.groupBy("image", "row", "col").applyInPandas(compute, schema)


def cells_of_blocks(blocks: DataFrame, network: TwoHeads, block: int) -> DataFrame:
    """cells() of images in blocks: (tile_id: the image, i, j, semi, vector), as of the whole image. block: a multiple of 8 that the network's reach fits into."""
    halo = network.reach
    if block % CELL or halo > block:
        raise ValueError(f"a block must be a multiple of {CELL} and at least {halo}")
    shared = blocks.sparkSession.sparkContext.broadcast(network)

    def of(name: object, frame: np.ndarray, top: int, left: int, own_top: int, own_left: int) -> pd.DataFrame:
        semi, vectors = shared.value(frame)
        r, c = (own_top - top) // CELL, (own_left - left) // CELL
        n = block // CELL
        return cell_rows(name, semi[r : r + n, c : c + n], vectors[r : r + n, c : c + n], own_top // CELL, own_left // CELL)

    return with_halo(blocks, block, halo, of, f"tile_id {blocks.schema['image'].dataType.simpleString()}, i int, j int, semi array<double>, vector array<double>")


def keypoints(cells_: DataFrame, height: int, width: int, *, least: float = 0.015, radius: int = 4, border: int = 4, blocks: int | None = None, most: int = 1000) -> DataFrame:
    """(tile_id, kp_id, x, y, score, descriptor) of the heat map of cells, with descriptors sampled from theirs; with blocks, only the best most // blocks**2 of each of blocks x blocks
    parts of a tile."""
    points = heads.heat_keypoints(cells_.select("tile_id", "i", "j", "semi"), height, width, least=least, radius=radius, border=border)
    if blocks is not None:
        few = rank.quota(points.select("tile_id", F.col("y").alias("r"), F.col("x").alias("c"), "score"), height, width, blocks=blocks, most=most)
        points = points.join(few.select("tile_id", "x", "y"), ["tile_id", "x", "y"], "left_semi")
    coarse = cells_.select("tile_id", "i", "j", "vector")
    found = heads.sampled_descriptors(points.select("tile_id", "kp_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), coarse, width, height, width // CELL, height // CELL)
    return points.join(found, ["tile_id", "kp_id"])
