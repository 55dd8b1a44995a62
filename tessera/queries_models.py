"""Queries of robust fits by model and of clusters by medoids. Matches are those of the rows of pixels of neighbouring tiles (see queries_features)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import queries_warp
from tessera.operators import cluster, matching, models
from tessera.queries_features import ON, PAIRS, PLAIN, RANKS, TILES, sides


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = sides(spark, sf_dir)
    return matching.gathered_points(matching.nearest(left, right, ON), left, right, ON)


def ransac(model: str, threshold: float) -> Callable[[SparkSession, str], DataFrame]:
    """All samples of every pair are tried."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = models.ransac(matches(spark, sf_dir), ON, model, threshold=threshold, trials=None)
        entries = {f"h{k}": F.round(F.get("m", F.lit(k)), 5) + 0.0 for k in range(9)}
        return out.withColumns(entries | {"error": F.round("error", 6) + 0.0, "members": F.array_join("members", ",")}).drop("m")

    return run


def keypoint_medoids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points of each tile in three clusters, by straight distance and by ways around pixels under -0.2."""
    points = queries_warp.points(spark, sf_dir).select("tile_id", F.col("kp").alias("m"), "x", "y")
    walls = queries_warp.arrays(spark, sf_dir).select("tile_id", F.transform("pixels", lambda v: v < -0.2).alias("walls"))
    straight = cluster.k_medoids(points, ["tile_id"], ["x", "y"], 3)
    around = cluster.k_medoids(points, ["tile_id"], ["x", "y"], 3, walls=walls, height=8, width=8)
    return straight.withColumn("ways", F.lit("straight")).unionByName(around.withColumn("ways", F.lit("around")))


THRESHOLDS = {"shift": 3.0, "similarity": 2.0, "affine": 1.0, "projective": 1.0}
QUERIES = {f"ransac_{m}_model": ransac(m, t) for m, t in THRESHOLDS.items()} | {"keypoint_medoids": keypoint_medoids}

SQL: dict[str, str] = {}
SQL["ransac_shift_model"] = f"""
WITH {TILES}, {PAIRS}, d AS (SELECT i, j, direction, pa, pb, kp1::INT AS kp1, kp2::INT AS kp2, {PLAIN} AS d2 FROM pairs, range(8) x(kp1), range(8) y(kp2)), {RANKS},
s AS (SELECT i, j, direction, kp1 AS m, 10 * pb[kp2 * 8 + 1] - 10 * pa[kp1 * 8 + 1] AS dx, (kp2 - kp1)::DOUBLE AS dy FROM r WHERE r1 = 1 AND r2 = 1),
v AS (SELECT h.i, h.j, h.direction, h.m AS hm, h.dx AS hx, h.dy AS hy, (s.dx - h.dx) ** 2 + (s.dy - h.dy) ** 2 AS r2, s.m, s.dx, s.dy FROM s h JOIN s USING (i, j, direction)),
b AS (SELECT i, j, direction, hm, count(*) AS n_match, count(*) FILTER (r2 < 9) AS votes, round(coalesce(sum(r2) FILTER (r2 < 9), 0), 9) AS ssr FROM v GROUP BY ALL),
w AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY i, j, direction ORDER BY votes DESC, ssr, hm) = 1),
f AS (SELECT w.i, w.j, w.direction, n_match, v.m, v.dx, v.dy FROM w JOIN v ON v.i = w.i AND v.j = w.j AND v.direction = w.direction AND v.hm = w.hm WHERE r2 < 9),
z AS (SELECT i, j, direction, n_match, count(*) AS n_inlier, avg(dx) AS tx, avg(dy) AS ty, var_pop(dx) + var_pop(dy) AS spread, string_agg(m::VARCHAR, ',' ORDER BY m) AS members FROM f GROUP BY ALL)
SELECT i, j, direction, n_match, n_inlier, 0::INT AS status, round(sqrt(spread), 6) + 0.0 AS error, members, 1.0::DOUBLE AS h0, 0.0::DOUBLE AS h1, round(tx, 5) + 0.0 AS h2, 0.0::DOUBLE AS h3, 1.0::DOUBLE AS h4, round(ty, 5) + 0.0 AS h5, 0.0::DOUBLE AS h6, 0.0::DOUBLE AS h7, 1.0::DOUBLE AS h8 FROM z
"""
