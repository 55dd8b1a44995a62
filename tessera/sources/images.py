"""Tiles from image files, and results to files.

Nulls and odd files: a file that can't be decoded has null pixels and the status "unreadable"; images may differ in size; an empty folder is Spark's error
(path not found); names are sorted naturally, and equal names by folder. Files are read by Spark's readers alone, so any store they know will do.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.natural import natural_key


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(dataset: the folder, path, name, seq): the folder's files in natural order of their names, numbered from 0. Contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path")
    parts = F.split("path", "/")
    named = files.select(F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/").alias("dataset"), "path", F.element_at(parts, -1).alias("name"))
    order = Window.partitionBy("dataset").orderBy(natural_key(F.col("name")), "path")
    return named.withColumn("seq", (F.row_number().over(order) - 1).cast("int"))


def png_pixels(data: bytes) -> np.ndarray | None:
    """(height, width, channels) of an 8- or 16-bit PNG without palette or interlace; None for others."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        return None
    f, body, size = io.BytesIO(data[8:]), [], None
    while len(head := f.read(8)) == 8:
        n, kind = struct.unpack(">I4s", head)
        chunk = f.read(n)
        f.read(4)
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"IDAT":
            body.append(chunk)
    if size is None or size[2] not in (8, 16) or size[3] not in (0, 2, 4, 6) or size[6]:
        return None
    width, height, depth, kind = size[:4]
    channels = {0: 1, 2: 3, 4: 2, 6: 4}[kind]
    step = channels * depth // 8
    raw, line = zlib.decompress(b"".join(body)), width * step
    if len(raw) < height * (1 + line):
        raise ValueError("the image is cut off")
    above, out = bytearray(line), bytearray()
    for r in range(height):
        kind, row = raw[r * (1 + line)], raw[r * (1 + line) + 1 : (r + 1) * (1 + line)]
        if kind in (0, 2):
            this = bytearray(row) if kind == 0 else bytearray((np.frombuffer(row, np.uint8) + np.frombuffer(above, np.uint8)).tobytes())
        elif kind == 1:
            this = bytearray(np.cumsum(np.frombuffer(row, np.uint8).reshape(width, step), axis=0, dtype=np.uint8).tobytes())
        else:
            # a byte needs the one before it, so this goes byte by byte, over plain integers
            this = bytearray(line)
            for i, x in enumerate(row):
                left, up, corner = (this[i - step], above[i], above[i - step]) if i >= step else (0, above[i], 0)
                if kind == 3:
                    guess = (left + up) >> 1
                else:
                    a, b, c = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
                    guess = left if a <= b and a <= c else up if b <= c else corner
                this[i] = (x + guess) & 255
        out += this
        above = this
    pixels = np.frombuffer(bytes(out), np.uint8).astype(np.int64).reshape(height, width, step)
    return pixels.reshape(height, width, channels) if depth == 8 else pixels.reshape(height, width, channels, 2) @ np.array([256, 1])


def decoded(files: DataFrame) -> DataFrame:
    """(path, height, width, n_channels, pixels: grey values from 0 to 1, row-major, status) of (path, content): PNG of 8 or 16 bits here, so that 16 bits
    are kept; other formats go through Spark's own image reader, see read_images()."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    v = png_pixels(content)
                except (zlib.error, struct.error, ValueError, KeyError, TypeError):
                    v = None
                if v is None:
                    rows.append((path, None, None, None, None, "unreadable"))
                    continue
                most = 65535 if len(content) > 24 and content[24] == 16 else 255
                grey = (299 * v[..., 0] + 587 * v[..., 1] + 114 * v[..., 2] + 500) // 1000 if v.shape[2] >= 3 else v[..., 0]
                rows.append((path, v.shape[0], v.shape[1], v.shape[2], (grey / most).ravel().tolist(), "ok"))
            yield pd.DataFrame(rows, columns=["path", "height", "width", "n_channels", "pixels", "status"]).astype({c: "Int32" for c in ("height", "width", "n_channels")})

    return files.select("path", "content").mapInPandas(run, "path string, height int, width int, n_channels int, pixels array<double>, status string")


def read_images(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """The same for all formats that Spark's image reader knows (jpg, png, tif, bmp; 8 bits a channel, blue first)."""
    images = spark.read.format("image").option("dropInvalid", False).option("pathGlobFilter", pattern).load(folder).select("image.*")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, h, w, n, data in zip(batch["origin"], batch["height"], batch["width"], batch["nChannels"], batch["data"], strict=True):
                if h <= 0 or w <= 0 or n not in (1, 3, 4):
                    rows.append((path, None, None, None, None, "unreadable"))
                    continue
                v = np.frombuffer(data, np.uint8).reshape(h, w, n).astype(np.int64)
                grey = (114 * v[..., 0] + 587 * v[..., 1] + 299 * v[..., 2] + 500) // 1000 if n >= 3 else v[..., 0]
                rows.append((path, h, w, n, (grey / 255).ravel().tolist(), "ok"))
            yield pd.DataFrame(rows, columns=["path", "height", "width", "n_channels", "pixels", "status"]).astype({c: "Int32" for c in ("height", "width", "n_channels")})

    return images.select("origin", "height", "width", "nChannels", "data").mapInPandas(run, "path string, height int, width int, n_channels int, pixels array<double>, status string")


def with_parameters(rows: DataFrame, catalogue: DataFrame) -> DataFrame:
    """rows with the parameters of their data set, null where the catalogue has none. A catalogue has a row a data set."""
    return rows.join(catalogue, "dataset", "left")


def detector_threshold(kind: Column) -> Column:
    """The least response by kind of image: 1000 for bright field, 1 for phase contrast, 0.1 for fluorescence; null for others."""
    return F.when(kind == "bright", 1000.0).when(kind == "phase", 1.0).when(kind == "fluorescence", 0.1)


def grid_counts(catalogue: DataFrame) -> DataFrame:
    """Adds n_tiles and n_pairs of data sets with a grid of htile columns and vtile rows."""
    w, h = F.col("htile"), F.col("vtile")
    return catalogue.withColumn("n_tiles", w * h).withColumn("n_pairs", F.greatest(h - 1, F.lit(0)) * w + h * F.greatest(w - 1, F.lit(0)))


def write_results(results: DataFrame, path: str, *, by: tuple[str, ...] = ("dataset",), mode: str = "errorifexists", names: dict[str, str] | None = None) -> None:
    """Results as Parquet, a folder for each data set, so that a reader of one reads no other. names: what data sets are called in the files, where that differs."""
    if names:
        called = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
        results = results.withColumn("dataset", F.coalesce(F.try_element_at(called, F.col("dataset")), F.col("dataset")))
    results.write.mode(mode).partitionBy(*by).parquet(path)


def write_mosaic(blocks: DataFrame, index: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A mosaic's pixels (row, col, r, c, v) in folders by block, beside its index as CSV."""
    blocks.write.mode(mode).partitionBy("row", "col").parquet(f"{path}/pixels")
    index.write.mode(mode).option("header", True).csv(f"{path}/index")


def read_mosaic(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(pixels, index) of write_mosaic(); filters on row and col prune folders."""
    index = spark.read.option("header", True).schema("row int, col int, x_left int, y_top int, height int, width int").csv(f"{path}/index")
    return spark.read.parquet(f"{path}/pixels"), index


def mosaic_size(index: DataFrame) -> DataFrame:
    """(height, width) of a mosaic, from its index alone."""
    return index.agg(F.max(F.col("y_top") + F.col("height")).alias("height"), F.max(F.col("x_left") + F.col("width")).alias("width"))
