"""Mosaics of tiles in layers, at any places and of any sizes, as partitioned files that a region finds by itself.

A tile lies in the cell of its first corner; cells are at least as large as the largest tile, so what covers a region starts in the region's cells or the
ones just before. Layer and cell are folders, so a region is read by a filter on folders alone, before any file is opened. Beside the tiles lie
the index (name, x, y, layer, height, width) as CSV and one row about the whole.

Nulls, ties and odd sizes: tiles without a place, a layer, a size or whole pixels are left out of the files and keep their line of the index; where tiles overlap, the
one whose name comes last lies on top (of equal names the one further down, then right); a region that nothing covers has no rows; places may be negative; an
empty mosaic has a size of null. Sinks refuse a path that exists unless a mode says otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import images, tiff

TILE = "name string, layer int, x int, y int, height int, width int"


def placed(tiles: DataFrame, cell: int) -> DataFrame:
    """Tiles (name, layer, x, y, height, width, pixels) that can be drawn, with their cell (cell_row, cell_col)."""
    whole = tiles.dropna(subset=["layer", "x", "y", "height", "width"]).where((F.size("pixels") == F.col("height") * F.col("width")) & (F.col("height") > 0) & (F.col("width") > 0))
    return whole.select("name", *(F.col(c).cast("int").alias(c) for c in ("layer", "x", "y", "height", "width")), F.col("pixels").cast("array<double>").alias("pixels"), F.floor(F.col("y") / cell).cast("int").alias("cell_row"), F.floor(F.col("x") / cell).cast("int").alias("cell_col"))


def extents(tiles: DataFrame) -> DataFrame:
    """(layer, x_left, y_top, x_right, y_bottom, largest: the longest side of a tile) of each layer's tiles."""
    return tiles.groupBy("layer").agg(
        F.min("x").alias("x_left"), F.min("y").alias("y_top"), F.max(F.col("x") + F.col("width")).alias("x_right"), F.max(F.col("y") + F.col("height")).alias("y_bottom"), F.max(F.greatest("height", "width")).alias("largest"),
    )


def within(tiles: DataFrame, cell: int, layer: int, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    """Of placed() tiles those that cover pixels of columns x0 to x1 - 1 and rows y0 to y1 - 1 of a layer: by folder first, then by their own sides."""
    near = tiles.where((F.col("layer") == layer) & F.col("cell_row").between(y0 // cell - 1, (y1 - 1) // cell) & F.col("cell_col").between(x0 // cell - 1, (x1 - 1) // cell))
    return near.where((F.col("x") < x1) & (F.col("x") + F.col("width") > x0) & (F.col("y") < y1) & (F.col("y") + F.col("height") > y0))


def assembled(tiles: DataFrame, block: int, *, region: tuple[int, int, int, int] | None = None) -> DataFrame:
    """(layer, row, col, x, y, height, width, pixels) of placed() tiles: the image in blocks of `block` x `block` pixels counted from place (0, 0), or from a region's
    first corner (x0, y0, x1, y1) and no further than it; what no tile covers is null. Blocks that nothing covers are left out.

    A tile goes to the blocks that it covers; a block is drawn in one task, from its own tiles."""
    x0, y0, x1, y1 = region or (0, 0, None, None)

    def span(at: Column, size: Column, start: int, end: int | None) -> Column:
        first, last = (at, at + size) if end is None else (F.greatest(at, F.lit(start)), F.least(at + size, F.lit(end)))
        return F.sequence(F.floor((first - start) / block).cast("int"), F.floor((last - 1 - start) / block).cast("int"))

    dealt = tiles.withColumn("row", F.explode(span(F.col("y"), F.col("height"), y0, y1))).withColumn("col", F.explode(span(F.col("x"), F.col("width"), x0, x1)))

    def draw(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        layer, row, col = (int(k) for k in key)
        left, top = x0 + col * block, y0 + row * block
        h, w = (block if end is None else min(block, end - start) for start, end in ((top, y1), (left, x1)))
        out = np.full((h, w), np.nan)
        for _, t in parts.sort_values(["name", "y", "x"], na_position="first").iterrows():
            v = np.array([np.nan if p is None else p for p in t["pixels"]], float).reshape(t["height"], t["width"])
            r0, r1, c0, c1 = max(top, t["y"]), min(top + h, t["y"] + t["height"]), max(left, t["x"]), min(left + w, t["x"] + t["width"])
            out[r0 - top : r1 - top, c0 - left : c1 - left] = v[r0 - t["y"] : r1 - t["y"], c0 - t["x"] : c1 - t["x"]]
        pixels = [None if np.isnan(p) else p for p in out.ravel().tolist()]
        return pd.DataFrame({"layer": [layer], "row": [row], "col": [col], "x": [left], "y": [top], "height": [h], "width": [w], "pixels": [pixels]})

    return dealt.groupBy("layer", "row", "col").applyInPandas(draw, "layer int, row int, col int, x int, y int, height int, width int, pixels array<double>")


def write(tiles: DataFrame, path: str, *, cell: int | None = None, mode: str = "errorifexists") -> None:
    """A mosaic of tiles (name, layer, x, y, height, width, pixels). cell: at least the longest side of a tile, which is the default."""
    spark = tiles.sparkSession
    largest = tiles.agg(F.max(F.greatest("height", "width"))).first()[0] or 1
    cell = cell or largest
    if cell < largest:
        raise ValueError(f"cells of {cell} are smaller than a tile of {largest}")
    placed(tiles, cell).repartition("layer", "cell_row", "cell_col").write.mode(mode).partitionBy("layer", "cell_row", "cell_col").parquet(f"{path}/tiles")
    tiles.select("name", "x", "y", "layer", "height", "width").write.mode(mode).option("header", True).csv(f"{path}/index")
    spark.createDataFrame([("layers", cell)], "kind string, cell int").coalesce(1).write.mode(mode).json(f"{path}/about")


class Mosaic:
    """A mosaic's files: what it is, its index, its tiles and regions."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.cell = spark.read.schema("kind string, cell int").json(f"{path}/about").first()["cell"]
        self.index = spark.read.option("header", True).schema("name string, x int, y int, layer int, height int, width int").csv(f"{path}/index")
        self.tiles = spark.read.schema(f"{TILE}, pixels array<double>, cell_row int, cell_col int").parquet(f"{path}/tiles")

    def layer(self, layer: int, block: int) -> DataFrame:
        """The layer's image in blocks."""
        return assembled(self.tiles.where(F.col("layer") == layer), block)

    def region(self, layer: int, x0: int, y0: int, x1: int, y1: int, block: int | None = None) -> DataFrame:
        """Part of a layer's image in blocks (by default one), from the files that it touches alone."""
        if x1 <= x0 or y1 <= y0:
            raise ValueError("a region has a width and a height")
        return assembled(within(self.tiles, self.cell, layer, x0, y0, x1, y1), block or max(x1 - x0, y1 - y0), region=(x0, y0, x1, y1))

    def size(self) -> DataFrame:
        """(layer, x_left, y_top, x_right, y_bottom, largest), from the index alone."""
        return extents(self.index)


def read(spark: SparkSession, path: str) -> Mosaic | DataFrame:
    """By what lies at the path: a mosaic in layers, or the pages or images of one file or of a pattern of them."""
    name = path.lower()
    if name.endswith((".tif", ".tiff")):
        return tiff.decoded(spark.read.format("binaryFile").load(path).select("path", "content"))
    if name.endswith(".png"):
        return images.decoded(spark.read.format("binaryFile").load(path).select("path", "content"))
    if name.endswith((".jpg", ".jpeg", ".bmp", ".gif")):
        return images.read_images(spark, path)
    return Mosaic(spark, path)


def size(spark: SparkSession, path: str) -> DataFrame:
    """(layer, height, width) of whatever read() finds; of a mosaic from its index alone."""
    found = read(spark, path)
    if isinstance(found, Mosaic):
        return found.size().select("layer", (F.col("y_bottom") - F.col("y_top")).alias("height"), (F.col("x_right") - F.col("x_left")).alias("width"))
    return found.select((F.col("page") if "page" in found.columns else F.lit(0)).alias("layer"), "height", "width")


def patches(images_: DataFrame, patch: int, step: int) -> DataFrame:
    """(image, n, x, y, height, width, pixels): a batch of overlapping patches of each of several images (image, height, width, pixels), numbered row by row, their
    values divided by 255 and nulls null; at the far edges patches lie against the edge, and images smaller than a patch are one patch."""

    def starts(n: int) -> list[int]:
        return [*range(0, max(n - patch, 0), step), max(n - patch, 0)]

    kind = images_.schema["image"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, h, w, pixels in zip(*(batch[c] for c in ("image", "height", "width", "pixels")), strict=True):
                if pixels is None or pd.isna(h) or pd.isna(w) or len(pixels) != h * w:
                    continue
                v = np.asarray(pixels, float).reshape(int(h), int(w)) / 255
                spots = [(y, x) for y in starts(int(h)) for x in starts(int(w))]
                rows = [(name, n, x, y, *(p := v[y : y + patch, x : x + patch]).shape, [None if q != q else q for q in p.ravel().tolist()]) for n, (y, x) in enumerate(spots)]
                yield pd.DataFrame(rows, columns=["image", "n", "x", "y", "height", "width", "pixels"])

    return images_.select("image", "height", "width", "pixels").mapInPandas(run, f"image {kind}, n int, x int, y int, height int, width int, pixels array<double>")
