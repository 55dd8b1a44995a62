"""Elastic registration: matches fall into clusters that move alike, each with an affine map, and the maps make one field.

Nulls, ties and odd sizes: as in the parts; fewer matches than clusters give fewer of them; clusters of too few inliers are left out, and with none left the
field has no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import cluster, matching, rank, robust, warp

MAP = ["m00", "m01", "m02", "m10", "m11", "m12"]


def motion_features(matches: DataFrame, alpha: float = 5.0) -> DataFrame:
    """Adds fx and fy: how far a match moves, alpha times, as features beside its two places."""
    return matches.withColumn("fx", alpha * (F.col("x2") - F.col("x1"))).withColumn("fy", alpha * (F.col("y2") - F.col("y1")))


def clusters(matches: DataFrame, k: int, *, alpha: float = 5.0, least: int = 10, percent: float = 2.0, threshold: float = 3.0, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame]:
    """(matches with their cluster, maps: cluster, n_match, n_inlier, m00 to m12, members) of matches (m, x1, y1, x2, y2) of one pair of images."""
    some, _ = cluster.k_means(motion_features(matches, alpha), ["x1", "y1", "x2", "y2", "fx", "fy"], k, id_col="m", keep=keep)
    some = some.withColumnRenamed("cluster", "group")
    maps = robust.affine_clusters(some, ["group"], threshold=threshold)
    maps = robust.kept_clusters(maps, least=least, percent=percent).drop("cluster").withColumnRenamed("group", "cluster")
    return some.withColumnRenamed("group", "cluster"), maps


def clusters_of(matches: DataFrame, keys: list[str], k: int, *, alpha: float = 5.0, least: int = 10, percent: float = 2.0, threshold: float = 3.0, walls: DataFrame | None = None, height: int = 0, width: int = 0) -> tuple[DataFrame, DataFrame]:
    """clusters() of all pairs of images at once: (matches with their cluster, maps: keys, cluster, ...). walls: (keys, walls) of the moving images, around which matches are near
    or far; what no centre reaches is in no cluster."""
    features = ["x1", "y1", "x2", "y2", "fx", "fy"]
    some = cluster.k_medoids(motion_features(matches, alpha), keys, features, k, walls=walls, height=height, width=width)
    some = some.where("cluster >= 0").drop("centre", "fx", "fy")
    maps = robust.affine_clusters(some.withColumnRenamed("cluster", "group"), [*keys, "group"], threshold=threshold)
    return some, robust.kept_clusters(maps, least=least, percent=percent).drop("cluster").withColumnRenamed("group", "cluster")


def planted(left: DataFrame, right: DataFrame, keys: list[str], k: int, *, radius: float = 300.0, mutual: bool = True, **how) -> tuple[DataFrame, DataFrame]:
    """The same from keypoints (keys, kp1, x1, y1, f1) and (keys, kp2, x2, y2, f2): matches within a radius first."""
    found = matching.radius_matches(left, right, keys, radius, mutual=mutual).drop("ratio")
    return clusters_of(matching.gathered_points(found, left, right, keys), keys, k, **how)


def cluster_points(matches: DataFrame, maps: DataFrame, keys: list[str], fixed: bool = False) -> DataFrame:
    """The matches that their cluster's map explains, as keypoints (keys, cluster, kp, x, y) of the moving image or of the fixed one."""
    members = maps.select(*keys, "cluster", F.explode("members").alias("m"))
    x, y = ("x2", "y2") if fixed else ("x1", "y1")
    return matches.join(members, [*keys, "cluster", "m"]).select(*keys, "cluster", F.col("m").alias("kp"), F.col(x).alias("x"), F.col(y).alias("y"))


def field_in_two_passes(matches: DataFrame, maps: DataFrame, walls: DataFrame, height: int, width: int, *, k: int = 5) -> DataFrame:
    """(tile_id, r, c, x, y): the fields of all tiles (of matches, maps and walls by tile_id), around their walls, each in two passes: the first field, around the walls of the moving image,
    moves the walls themselves; the second goes around the moved walls, from the points of the fixed image, with the pixels of the walls filled."""
    spots = walls.select("tile_id", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("r")).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    first = generated_field_around_walls(spots, cluster_points(matches, maps, ["tile_id"]), maps, walls, height, width, k=k, fill=True)
    image = walls.select("tile_id", F.transform("walls", lambda w: F.when(w, 255.0).otherwise(0.0)).alias("pixels"))
    moved = warp.sampled(image, first, height, width, "bound").groupBy("tile_id").agg(F.array_sort(F.collect_list(F.struct("r", "c", (F.col("v") > 0).alias("wall")))).alias("w"))
    # a pixel without a source is no wall
    at = F.map_from_arrays(F.transform("w", lambda x: x["r"] * width + x["c"]), F.col("w.wall"))
    moved = moved.select("tile_id", F.transform(F.sequence(F.lit(0), F.lit(height * width - 1)), lambda p: F.coalesce(F.try_element_at(at, p), F.lit(False))).alias("walls"))
    return generated_field_around_walls(spots, cluster_points(matches, maps, ["tile_id"], fixed=True), maps, moved, height, width, k=k, fill=True)


def inliers(matches: DataFrame, maps: DataFrame) -> DataFrame:
    """The matches that their cluster's map explains, as keypoints (cluster, kp, x, y) of the moving image."""
    members = maps.select("cluster", F.explode("members").alias("m"))
    return matches.join(members, ["cluster", "m"]).select("cluster", F.col("m").alias("kp"), F.col("x1").alias("x"), F.col("y1").alias("y"))


def generated_field(pixels: DataFrame, points: DataFrame, maps: DataFrame, *, k: int = 5) -> DataFrame:
    """(tile_id, r, c, x, y): the maps (cluster, m00 to m12) averaged at each pixel by how dense the clusters' points (tile_id, cluster, kp, x, y) lie around it."""
    return cluster.density_field(pixels, points, maps.select(*[c for c in ("tile_id",) if c in maps.columns], "cluster", *MAP), k)


def generated_field_around_walls(pixels: DataFrame, points: DataFrame, maps: DataFrame, walls: DataFrame, height: int, width: int, *, k: int = 5, alpha: float = 1.0, fill: bool = False) -> DataFrame:
    """The same with ways around the walls (tile_id, walls: row-major booleans) in place of straight distances, for images with cuts."""
    at = points.withColumn("row", F.round("y").cast("int")).withColumn("column", F.round("x").cast("int"))
    ways = warp.wavefront(at.select("tile_id", F.col("kp").cast("bigint").alias("kp"), "row", "column").join(walls.select("tile_id", "walls"), "tile_id"), height, width, alpha, fill)
    sizes = points.dropna(subset=["cluster", "x", "y"]).groupBy("tile_id", "cluster").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    near = ways.where(F.col("dist") < cluster.UNREACHABLE).join(points.select("tile_id", "cluster", F.col("kp").cast("bigint").alias("kp")), ["tile_id", "kp"]).withColumnRenamed("dist", "d")
    kth = rank.kth_nearest(near, ["tile_id", "r", "c", "cluster"], k).where("nearest is not null").join(sizes, ["tile_id", "cluster"])
    return warp.field(cluster.shares(kth, k).join(pixels.select("tile_id", "r", "c"), ["tile_id", "r", "c"]), maps.select(*[c for c in ("tile_id",) if c in maps.columns], "cluster", *MAP))
