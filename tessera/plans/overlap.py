"""Neighbouring pairs of tiles and the pixels that they share under a shift.

Nulls, ties and odd sizes: a tile without a place in the grid has no neighbours; two tiles at one place are both neighbours; a pixel array that is null
or too short gives null values where it has none; an empty table gives no rows; other columns of tiles are kept by grid() alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grid(tiles: DataFrame, width: int, *, height: int | None = None, flipped: bool = False) -> DataFrame:
    """Adds row i and column j of each tile by its 0-based seq, row-major; flipped counts rows from the bottom (height needed)."""
    i = F.floor(F.col("seq") / width).cast("int")
    return tiles.withColumn("i", F.lit(height - 1) - i if flipped else i).withColumn("j", (F.col("seq") % width).cast("int"))


def numbered(tiles: DataFrame, height: int, width: int) -> DataFrame:
    """Adds index_im (1-based, row-major), row_major and column_major (0-based) of tiles with row i and column j."""
    row_major = F.col("i") * width + F.col("j")
    return tiles.withColumn("index_im", row_major + 1).withColumn("row_major", row_major).withColumn("column_major", F.col("j") * height + F.col("i"))


def sliced(files: DataFrame, key: Column, *, start: int = 1, hop: int = 1, end: int | None = None) -> DataFrame:
    """(dataset, name, seq): of each data set's files in the order of the key, those at places start, start + hop, ... up to end (1-based), numbered from 0."""
    place = F.row_number().over(Window.partitionBy("dataset").orderBy(key, "name"))
    some = files.withColumn("place", place).where((F.col("place") >= start) & ((F.col("place") - start) % hop == 0))
    some = some if end is None else some.where(F.col("place") <= end)
    return some.select("dataset", "name", F.floor((F.col("place") - start) / hop).cast("int").alias("seq"))


def natural_ranks(rows: DataFrame, keys: list[str], key: Column, *, descending: bool = False) -> DataFrame:
    """Adds place: the dense rank by the key within each group, equal keys alike."""
    return rows.withColumn("place", F.dense_rank().over(Window.partitionBy(*keys).orderBy(key.desc() if descending else key)))


def neighbour_pairs(tiles: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, i, j, direction, prev, cur): each tile with the one above it (north) and the one left of it (west), by equi-joins."""
    cur = tiles.select(*keys, "i", "j", F.col("tile_id").alias("cur"))
    north = tiles.select(*keys, (F.col("i") + 1).alias("i"), "j", F.col("tile_id").alias("prev"))
    west = tiles.select(*keys, "i", (F.col("j") + 1).alias("j"), F.col("tile_id").alias("prev"))
    on = [*keys, "i", "j"]
    return (
        cur.join(north, on).withColumn("direction", F.lit("north")).unionByName(cur.join(west, on).withColumn("direction", F.lit("west")))
        .select(*keys, "i", "j", "direction", "prev", "cur")
    )


def pixels(tiles: DataFrame, width: int) -> DataFrame:
    """Long form (tile_id, r, c, v) of tiles held as arrays of row-major pixels."""
    return tiles.select("tile_id", F.posexplode("pixels").alias("p", "v")).select("tile_id", F.floor(F.col("p") / width).cast("int").alias("r"), (F.col("p") % width).cast("int").alias("c"), F.col("v").cast("double").alias("v"))


def shared_pixels(pairs: DataFrame, tiles: DataFrame, size: int, dx: Column, dy: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds values a (of prev) and b (of cur) where cur, shifted right by dx and down by dy, covers prev; empty if they miss each other. keys: columns that
    both have, such as the data set, where numbers of tiles are told apart by them.

    Both arrays travel once with their pair and the overlap is made by exploding indexes, so no pixel table is shuffled."""
    one = tiles.select(*keys, F.col("tile_id").alias("prev"), F.col("pixels").alias("pa"))
    two = tiles.select(*keys, F.col("tile_id").alias("cur"), F.col("pixels").alias("pb"))
    both = pairs.join(one, [*keys, "prev"]).join(two, [*keys, "cur"]).withColumn("dx", dx.cast("int")).withColumn("dy", dy.cast("int"))
    both = both.where((F.abs("dx") < size) & (F.abs("dy") < size))
    both = both.withColumn("r", F.explode(F.sequence(F.greatest(F.lit(0), F.col("dy")), F.least(F.lit(size - 1), size - 1 + F.col("dy")))))
    both = both.withColumn("c", F.explode(F.sequence(F.greatest(F.lit(0), F.col("dx")), F.least(F.lit(size - 1), size - 1 + F.col("dx")))))
    a = F.get("pa", F.col("r") * size + F.col("c"))
    b = F.get("pb", (F.col("r") - F.col("dy")) * size + F.col("c") - F.col("dx"))
    return both.withColumn("a", a.cast("double")).withColumn("b", b.cast("double")).drop("pa", "pb")
