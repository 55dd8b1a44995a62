"""Deformation fields and warped images. Places are pixels with centres at half integers: pixel (r, c) lies at (c + 0.5, r + 0.5).

Nulls and odd sizes: a pixel whose source is null is null; beyond the image's edge, padding "zero" gives 0 and "bound" the edge's value; a tile whose pixel
array is null or too short gives null where it has none; a source that no way reaches has the distance 99999; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import pixels as P
from tessera.operators.ways import UNREACHABLE, filled, steps  # noqa: F401


def affine_source(a: Column, r: Column, c: Column) -> Column:
    """struct(x, y): where pixel (r, c) of the result comes from under a map with fields m00 to m12 from places of the result to places of the source."""
    x, y = c + 0.5, r + 0.5
    return F.struct((a["m00"] * x + a["m01"] * y + a["m02"]).alias("x"), (a["m10"] * x + a["m11"] * y + a["m12"]).alias("y"))


def field(weights: DataFrame, maps: DataFrame) -> DataFrame:
    """(tile_id, r, c, x, y): each pixel's source, the maps (cluster, m00 to m12) of all clusters averaged by their weights (tile_id, r, c, cluster, weight).

    weights without rows for a pixel leave it out."""
    names = [f"m{i}{j}" for i in range(2) for j in range(3)]
    keys = [k for k in ("tile_id", "cluster") if k in maps.columns]
    some = maps.select(*keys, F.struct(*names).alias("a"))
    # maps for all tiles are a few rows: weights dealt out by cluster would meet in as few tasks
    both = weights.join(some if "tile_id" in keys else F.broadcast(some), keys)
    both = both.withColumn("p", affine_source(F.col("a"), F.col("r"), F.col("c")))
    return both.groupBy("tile_id", "r", "c").agg(F.sum(F.col("weight") * F.col("p.x")).alias("x"), F.sum(F.col("weight") * F.col("p.y")).alias("y"))


def affine_field(tiles: DataFrame, maps: Column, height: int, width: int) -> DataFrame:
    """The field of one map for each tile."""
    spots = tiles.select("tile_id", maps.alias("a"), F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("r")).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    return spots.withColumn("p", affine_source(F.col("a"), F.col("r"), F.col("c"))).select("tile_id", "r", "c", F.col("p.x").alias("x"), F.col("p.y").alias("y"))


def sampled(tiles: DataFrame, sources: DataFrame, height: int, width: int, padding: str = "zero") -> DataFrame:
    """(tile_id, r, c, v) of tiles (tile_id, pixels) at the places (tile_id, r, c, x, y), bilinear."""
    if padding not in ("zero", "bound"):
        raise ValueError("padding is zero or bound")
    both = sources.join(tiles.select("tile_id", "pixels"), "tile_id").withColumn("u", F.col("x") - 0.5).withColumn("w", F.col("y") - 0.5)
    both = both.withColumn("c0", F.floor("u").cast("int")).withColumn("r0", F.floor("w").cast("int"))

    def at(r: Column, c: Column) -> Column:
        inside = r.between(0, height - 1) & c.between(0, width - 1)
        place = F.least(F.greatest(r, F.lit(0)), F.lit(height - 1)) * width + F.least(F.greatest(c, F.lit(0)), F.lit(width - 1))
        v = F.get("pixels", place.cast("int")).cast("double")
        return v if padding == "bound" else F.when(inside, v).otherwise(F.when(r.isNotNull() & c.isNotNull(), F.lit(0.0)))

    r0, c0 = F.col("r0"), F.col("c0")
    dy, dx = F.col("w") - r0, F.col("u") - c0
    v = (1 - dy) * ((1 - dx) * at(r0, c0) + dx * at(r0, c0 + 1)) + dy * ((1 - dx) * at(r0 + 1, c0) + dx * at(r0 + 1, c0 + 1))
    return both.select("tile_id", "r", "c", v.alias("v"))


def flow(sources: DataFrame) -> DataFrame:
    """Adds dx and dy: how far each pixel's source lies from it."""
    return sources.withColumn("dx", F.col("x") - (F.col("c") + 0.5)).withColumn("dy", F.col("y") - (F.col("r") + 0.5))


def flow_colours(flows: DataFrame, alpha: float | None = None) -> DataFrame:
    """(tile_id, r, c, red, green, blue): the direction as hue and the size as saturation, alpha * size, by default such that a tile's longest is full."""
    size = F.hypot("dx", "dy")
    sizes = flows.withColumn("s", size)
    if alpha is None:
        most = flows.groupBy("tile_id").agg(F.max(size).alias("most"))
        sizes = sizes.join(most, "tile_id").withColumn("s", F.coalesce(F.try_divide("s", F.col("most")), F.lit(0.0)))
    else:
        sizes = sizes.withColumn("s", F.least(alpha * F.col("s"), F.lit(1.0)))
    hue = F.atan2("dy", "dx") / (2 * np.pi) + F.when(F.col("dy") < 0, 1.0).otherwise(0.0)
    return sizes.select("tile_id", "r", "c", P.hsv(hue, F.col("s"), F.lit(1.0)).alias("x")).select("tile_id", "r", "c", "x.*")


def wavefront(sources: DataFrame, height: int, width: int, alpha: float = 1.0, fill: bool = False) -> DataFrame:
    """(tile_id, kp, r, c, dist) of sources (tile_id, kp, row, column, walls: row-major array of booleans): the way around the walls, or, below 1, a blend of
    it (alpha) with the way through them. A wall, and what no way reaches, has 99999. With fill, the pixels of
    walls take the value of the one above them to the left. A tile whose walls are null or of another length has no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[[x is not None and len(x) == height * width for x in batch["walls"]]]
            ways = []
            for walls, r, c in zip(batch["walls"], batch["row"], batch["column"], strict=True):
                wall = np.asarray(walls, bool).reshape(height, width)
                d = steps(wall, int(r), int(c)).astype(float)
                if alpha != 1:
                    free = steps(np.zeros_like(wall), int(r), int(c))
                    d = (d - free) * alpha + free
                d = filled(d, wall) if fill else d
                ways.append(d.ravel())
            p = np.arange(height * width)
            yield pd.DataFrame({
                "tile_id": np.repeat(batch["tile_id"].to_numpy(), len(p)), "kp": np.repeat(batch["kp"].to_numpy(), len(p)), "r": np.tile(p // width, len(batch)), "c": np.tile(p % width, len(batch)),
                "dist": np.concatenate(ways) if ways else np.empty(0),
            })

    return sources.select("tile_id", "kp", "row", "column", "walls").mapInPandas(run, f"tile_id {sources.schema['tile_id'].dataType.simpleString()}, kp {sources.schema['kp'].dataType.simpleString()}, r int, c int, dist double")


def inverse_field(sources: DataFrame, height: int, width: int) -> DataFrame:
    """(tile_id, r, c, x, y): the field that undoes another, in an image of height x width.

    The places (x, y) of four neighbouring pixels make two triangles; a pixel of the result that lies in one gets the linear interpolation of its corners. Where triangles
    overlap, the one of the smaller row, column and number counts; pixels that none covers have no row, and flat triangles cover none."""
    v = sources.select("tile_id", "r", "c", F.struct("x", "y", (F.col("c") + 0.5).alias("u"), (F.col("r") + 0.5).alias("w")).alias("p"))
    corner = lambda name, dr, dc: v.select("tile_id", (F.col("r") - dr).alias("r"), (F.col("c") - dc).alias("c"), F.col("p").alias(name))
    on = ["tile_id", "r", "c"]
    quads = v.withColumnRenamed("p", "a").join(corner("b", 0, 1), on).join(corner("d", 1, 0), on).join(corner("e", 1, 1), on)
    halves = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(o).alias("o"), F.col("b").alias("p"), F.col("d").alias("q")) for k, o in ((0, "a"), (1, "e")))))
    t = quads.select("tile_id", F.struct("r", "c").alias("cell"), halves.alias("t")).select("tile_id", F.struct("cell.r", "cell.c", "t.k").alias("id"), "t.o", "t.p", "t.q")
    ends = lambda f, most: (F.greatest(F.ceil(F.least(*(F.col(f"{k}.{f}") for k in "opq")) - 0.5), F.lit(0)), F.least(F.floor(F.greatest(*(F.col(f"{k}.{f}") for k in "opq")) - 0.5), F.lit(most - 1)))
    (x0, x1), (y0, y1) = ends("x", width), ends("y", height)
    spots = t.withColumn("j", F.explode(F.when(x0 <= x1, F.sequence(x0, x1)))).withColumn("i", F.explode(F.when(y0 <= y1, F.sequence(y0, y1))))
    g = lambda k, f: F.col(f"{k}.{f}")
    area = (g("p", "x") - g("o", "x")) * (g("q", "y") - g("o", "y")) - (g("q", "x") - g("o", "x")) * (g("p", "y") - g("o", "y"))
    px, py = F.col("j") + 0.5 - g("o", "x"), F.col("i") + 0.5 - g("o", "y")
    area = F.when(F.abs(area) > 1e-9, area)
    spots = spots.withColumn("s", (px * (g("q", "y") - g("o", "y")) - (g("q", "x") - g("o", "x")) * py) / area).withColumn("z", ((g("p", "x") - g("o", "x")) * py - px * (g("p", "y") - g("o", "y"))) / area)
    spots = spots.where((F.col("s") >= -1e-9) & (F.col("z") >= -1e-9) & (F.col("s") + F.col("z") <= 1 + 1e-9))
    value = lambda f: g("o", f) + F.col("s") * (g("p", f) - g("o", f)) + F.col("z") * (g("q", f) - g("o", f))
    best = spots.groupBy("tile_id", F.col("i").cast("int").alias("r"), F.col("j").cast("int").alias("c")).agg(F.min(F.struct("id", value("u").alias("x"), value("w").alias("y"))).alias("m"))
    return best.select("tile_id", "r", "c", "m.x", "m.y")
