"""Pixels in long form (tile_id, r, c, v), 0-based: preparation, regions, patches, mosaics, pictures.

Nulls, ties and odd sizes: a null value stays null and is left out of sums, extremes and merges; a tile without pixels has no rows and gives
none; tiles may differ in size unless a size is given; pixels outside a given size are cut off; repeated (tile_id, r, c) are repeated rows;
columns that are not named are kept where rows are kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grey(red: Column, green: Column, blue: Column) -> Column:
    """Luma of whole numbers 0 to 255 with the weights of ITU-R BT.601, rounded half up; null if a channel is."""
    return F.floor((299 * red + 587 * green + 114 * blue + 500) / 1000).cast("int")


def unit(v: Column, most: int = 255) -> Column:
    """Whole numbers as doubles from 0 to 1."""
    return v.cast("double") / most


def stretched(pixels: DataFrame, v: str = "v") -> DataFrame:
    """v moved and scaled to 0 to 1 within each tile; null in a flat tile."""
    tile = Window.partitionBy("tile_id")
    low, high = F.min(v).over(tile), F.max(v).over(tile)
    return pixels.withColumn(v, F.try_divide(F.col(v) - low, high - low))


def strip(row: Column, column: Column, height: Column, width: Column, overlap: float, direction: Column, current: bool) -> Column:
    """Whether a place lies in the strip that neighbours share: north, the current tile's top rows and the upper tile's bottom
    rows; west, the same with columns. floor(size * overlap) of them."""
    north = row < F.floor(height * overlap) if current else row >= height - F.floor(height * overlap)
    west = column < F.floor(width * overlap) if current else column >= width - F.floor(width * overlap)
    return F.when(direction == "north", north).otherwise(west)


def padded(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """Every tile with height x width pixels: cut off, or filled with 0."""
    tiles = pixels.select("tile_id").distinct()
    full = tiles.select("tile_id", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("r")).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    return full.join(pixels.select("tile_id", "r", "c", "v"), ["tile_id", "r", "c"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))


def downsampled(pixels: DataFrame, factor: int) -> DataFrame:
    """Means of factor x factor blocks, fewer pixels at the edge."""
    return pixels.groupBy("tile_id", F.floor(F.col("r") / factor).cast("int").alias("r"), F.floor(F.col("c") / factor).cast("int").alias("c")).agg(F.avg("v").alias("v"))


def resized(tiles: DataFrame, size: tuple[int, int], to: tuple[int, int], bilinear: bool = True) -> DataFrame:
    """(tile_id, r, c, v) of tiles (tile_id, pixels: row-major array) of size (h, w), sampled at size `to`.

    Nearest takes the place floor(x * scale); bilinear takes pixel centres, and the edge's value beyond the edge. A short or null array gives null."""
    (h, w), (nh, nw) = size, to
    out = tiles.select("tile_id", "pixels", F.explode(F.sequence(F.lit(0), F.lit(nh - 1))).alias("r")).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(nw - 1))))
    at = lambda r, c: F.get("pixels", (F.least(F.greatest(r, F.lit(0)), F.lit(h - 1)) * w + F.least(F.greatest(c, F.lit(0)), F.lit(w - 1))).cast("int")).cast("double")
    if not bilinear:
        return out.select("tile_id", "r", "c", at(F.floor(F.col("r") * h / nh), F.floor(F.col("c") * w / nw)).alias("v"))
    y, x = (F.col("r") + 0.5) * h / nh - 0.5, (F.col("c") + 0.5) * w / nw - 0.5
    r0, c0 = F.floor(y), F.floor(x)
    dy, dx = y - r0, x - c0
    v = (1 - dy) * ((1 - dx) * at(r0, c0) + dx * at(r0, c0 + 1)) + dy * ((1 - dx) * at(r0 + 1, c0) + dx * at(r0 + 1, c0 + 1))
    return out.select("tile_id", "r", "c", v.alias("v"))


def patch_starts(length: int, patch: int, overlap: int) -> list[int]:
    """Starts of the patches along a side: equal steps, the last one flush with the end."""
    patch = min(patch, length)
    overlap = min(overlap, patch - 1)
    step = patch - overlap
    n = max(1, math.ceil((length - overlap) / step))
    return [i * step for i in range(n - 1)] + [length - patch]


def patches(pixels: DataFrame, height: int, width: int, patch: int, overlap: int) -> DataFrame:
    """(tile_id, patch: its number, pr, pc: its first row and column, r, c: places in the tile, v): an equi-join on rows and columns, as each of
    them lies in few patches. overlap is cut to patch - 1."""
    sizes = min(patch, height), min(patch, width)
    rows, columns = patch_starts(height, patch, overlap), patch_starts(width, patch, overlap)
    hold = lambda starts, size, x: F.filter(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(s).alias("s")) for i, s in enumerate(starts))), lambda p: (p["s"] <= x) & (x < p["s"] + size))
    out = pixels.select("tile_id", "r", "c", "v", F.explode(hold(rows, sizes[0], F.col("r"))).alias("p")).select("*", F.explode(hold(columns, sizes[1], F.col("c"))).alias("q"))
    return out.select("tile_id", (F.col("p.i") * len(columns) + F.col("q.i")).alias("patch"), F.col("p.s").alias("pr"), F.col("q.s").alias("pc"), "r", "c", "v")


def masked_patches(patched: DataFrame, mask: Column) -> DataFrame:
    """Patches in which the mask holds for a pixel at least."""
    return patched.withColumn("__in", F.max(mask.cast("int")).over(Window.partitionBy("tile_id", "patch"))).where("__in = 1").drop("__in")


TINY = 1e-6


def merged(patched: DataFrame) -> DataFrame:
    """Patches laid over each other in their order: where what lies there and what comes are both above 1e-6 in size they are averaged, else added."""
    steps = F.array_sort(F.collect_list(F.struct("patch", "v")))
    lay = lambda acc, x: F.when((F.abs(acc) > TINY) & (F.abs(x["v"]) > TINY), 0.5 * acc + 0.5 * x["v"]).otherwise(acc + x["v"])
    return patched.where("v is not null").groupBy("tile_id", "r", "c").agg(F.aggregate(steps, F.lit(0.0), lay).alias("v"))


def merged_mean(patched: DataFrame) -> DataFrame:
    """Mean over patches of what is above 1e-6 in size; null where nothing is."""
    return patched.groupBy("tile_id", "r", "c").agg(F.avg(F.when(F.abs("v") > TINY, F.col("v"))).alias("v"))


def placed(pixels: DataFrame, grid: DataFrame, height: int, width: int) -> DataFrame:
    """(r, c, v) of one mosaic: tiles (tile_id, i, j) of one size laid out by row and column."""
    return pixels.join(grid.select("tile_id", "i", "j"), "tile_id").select((F.col("i") * height + F.col("r")).alias("r"), (F.col("j") * width + F.col("c")).alias("c"), "v")


def blocked(mosaic: DataFrame, size: int) -> DataFrame:
    """Adds the block (row, col) of size x size pixels that a pixel lies in: the columns by which a mosaic is partitioned on disk."""
    return mosaic.withColumn("row", F.floor(F.col("r") / size).cast("int")).withColumn("col", F.floor(F.col("c") / size).cast("int"))


def block_index(blocks: DataFrame, size: int) -> DataFrame:
    """(row, col, x_left, y_top, height, width) of each block that has pixels."""
    found = blocks.groupBy("row", "col").agg(F.max("r").alias("r"), F.max("c").alias("c"))
    left, top = F.col("col") * size, F.col("row") * size
    return found.select("row", "col", left.alias("x_left"), top.alias("y_top"), (F.col("r") - top + 1).cast("int").alias("height"), (F.col("c") - left + 1).cast("int").alias("width"))


def region(blocks: DataFrame, size: int, top: int, left: int, height: int, width: int) -> DataFrame:
    """The pixels of a rectangle, places counted from its corner. The bounds on row and col let Spark read the touched blocks only."""
    near = F.col("row").between(top // size, (top + height - 1) // size) & F.col("col").between(left // size, (left + width - 1) // size)
    inside = F.col("r").between(top, top + height - 1) & F.col("c").between(left, left + width - 1)
    return blocks.where(near & inside).select((F.col("r") - top).alias("r"), (F.col("c") - left).alias("c"), "v")


def overlay(a: Column, b: Column) -> Column:
    """Half of each, in whole numbers."""
    return F.floor(a / 2).cast("int") + F.floor(b / 2).cast("int")


def red_cyan(a: Column, b: Column) -> Column:
    """The first image in red, the second in green and blue."""
    return F.struct(a.alias("red"), b.alias("green"), b.alias("blue"))


def hsv(h: Column, s: Column, v: Column) -> Column:
    """struct(red, green, blue) from 0 to 255 of hue, saturation and value from 0 to 1."""
    sector = F.floor(h * 6)
    f = h * 6 - sector
    p, q, t = v * (1 - s), v * (1 - s * f), v * (1 - s * (1 - f))
    at = F.pmod(sector, F.lit(6))
    pick = lambda *x: F.element_at(F.array(*x), (at + 1).cast("int"))
    whole = lambda x: F.floor(x * 255 + 1e-9).cast("int")
    return F.struct(whole(pick(v, q, p, p, t, v)).alias("red"), whole(pick(t, v, v, q, p, p)).alias("green"), whole(pick(p, p, t, v, v, q)).alias("blue"))


def label_colour(label: Column, alpha: float = 1.0) -> Column:
    """A colour for each label, black for 0: hues go round by a step without common factor with 256, so that near labels differ."""
    hue = F.pmod(label * 97, F.lit(256)) / 255.0
    some = (label > 0).cast("double")
    return hsv(hue, some, some * alpha)


def painted(pixels: DataFrame, labels: DataFrame, scale: float, alpha: float) -> DataFrame:
    """(tile_id, r, c, red, green, blue): grey values 0 to 255 under the colours of labels (tile_id, r, c, label), which are `scale` times smaller."""
    at = pixels.withColumn("lr", F.floor(F.col("r") / scale).cast("int")).withColumn("lc", F.floor(F.col("c") / scale).cast("int"))
    small = labels.select("tile_id", F.col("r").alias("lr"), F.col("c").alias("lc"), "label")
    both = at.join(small, ["tile_id", "lr", "lc"], "left").withColumn("label", F.coalesce("label", F.lit(0)))
    both = both.withColumn("x", label_colour(F.col("label"), alpha)).withColumn("under", F.when(F.col("label") > 0, F.floor(F.col("v") * (1 - alpha) + 1e-9)).otherwise(F.col("v")).cast("int"))
    return both.select("tile_id", "r", "c", *((F.col("under") + F.col(f"x.{k}")).alias(k) for k in ("red", "green", "blue")))


def cross_section(stack: DataFrame, *, row: int | None = None, column: int | None = None, times: int = 1) -> DataFrame:
    """(z, x, v): a cut through a stack (z, r, c, v) at one row or, failing that, one column, each layer `times` pixels high."""
    cut = stack.where(F.col("r") == row).withColumn("x", F.col("c")) if row is not None else stack.where(F.col("c") == column).withColumn("x", F.col("r"))
    return cut.select(F.explode(F.sequence(F.col("z") * times, F.col("z") * times + times - 1)).alias("z"), "x", "v")
