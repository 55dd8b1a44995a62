"""Best points and nearest members within groups, by windows over the group.

Nulls and ties: rows without a score or distance are left out; equal scores go by row, then column, equal distances by id; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confident(points: DataFrame, least: float) -> DataFrame:
    return points.where(F.col("score") >= least)


def inside(points: DataFrame, height: int, width: int, border: int) -> DataFrame:
    """Points (r, c) at least `border` pixels off every edge."""
    return points.where(F.col("r").between(border, height - border - 1) & F.col("c").between(border, width - border - 1))


def best_first(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, x, y, score, place): points of each group numbered by falling score."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "r", "c")
    return points.where("score is not null").select(*keys, F.col("c").alias("x"), F.col("r").alias("y"), "score", F.row_number().over(order).alias("place"))


def quota(points: DataFrame, height: int, width: int, *, blocks: int = 10, most: int = 1000) -> DataFrame:
    """(tile_id, x, y, score): the best most // blocks**2 points of each of blocks x blocks parts of a tile. What is left over at the far edges by
    division belongs to no block, as its sides are height // blocks and width // blocks; this quota is the operator's feature."""
    h, w = height // blocks, width // blocks
    near = points.where((F.col("r") < h * blocks) & (F.col("c") < w * blocks) & F.col("score").isNotNull())
    order = Window.partitionBy("tile_id", F.floor(F.col("r") / h), F.floor(F.col("c") / w)).orderBy(F.desc("score"), "r", "c")
    return near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most // blocks**2).select("tile_id", F.col("c").alias("x"), F.col("r").alias("y"), "score")


def kth_nearest(distances: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(keys, nearest, farthest): the k-th smallest and the k-th largest of `d` in each group, null in groups of fewer."""
    up, down = Window.partitionBy(*keys).orderBy("d"), Window.partitionBy(*keys).orderBy(F.desc("d"))
    some = distances.where("d is not null").withColumn("u", F.row_number().over(up)).withColumn("v", F.row_number().over(down))
    return some.groupBy(*keys).agg(F.max(F.when(F.col("u") == k, F.col("d"))).alias("nearest"), F.max(F.when(F.col("v") == k, F.col("d"))).alias("farthest"))


def medoids(samples: DataFrame, centres: DataFrame, group: str, id_col: str, distance) -> DataFrame:
    """(group, id): of each group's samples the one nearest to its centre; distance is a Column of the joined rows. Equal ones: the smallest id."""
    both = samples.join(centres, group).select(group, F.struct(distance.alias("d"), F.col(id_col).alias("id")).alias("x")).where("x.d is not null")
    return both.groupBy(group).agg(F.min("x").alias("x")).select(group, F.col("x.id").alias(id_col))
