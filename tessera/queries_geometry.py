"""Queries of transforms and their fits, with SQL for each. Lines of orders are points: (quantity, discount in percent), moved by maps made of whole numbers of the line."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import geometry as G
from tessera.operators import robust


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) + 0.0 for c in columns})


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, m, s: the supplier, x1, y1, x2, y2): turned by s degrees, enlarged by 1 + line / 10 and moved by (s % 5, line)."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    t = F.col("l_suppkey") * (math.pi / 180)
    k = 1 + F.col("l_linenumber") / 10
    rows = rows.select("l_orderkey", F.col("l_linenumber").alias("m"), F.col("l_suppkey").alias("s"), F.col("l_quantity").alias("x1"), (F.col("l_discount") * 100).alias("y1"), t.alias("t"), k.alias("k"))
    x2 = F.col("k") * (F.cos("t") * F.col("x1") - F.sin("t") * F.col("y1")) + F.col("s") % 5
    y2 = F.col("k") * (F.sin("t") * F.col("x1") + F.cos("t") * F.col("y1")) + F.col("m")
    return rows.withColumn("x2", x2).withColumn("y2", y2)


def maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, m): enlarged by the size, turned by the key in degrees, moved by (size, key % 7), slightly tilted."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size")
    size, angle = F.col("p_size").cast("double"), F.col("p_partkey") * (math.pi / 180)
    affine = G.composed(G.composed(G.scaling(size / 10, size / 20), G.rotation(angle)), G.translation(size, F.col("p_partkey") % 7))
    tilt = G.matrix(1, 0, 0, 0, 1, 0, 0.001, 0.002, 1)
    return part.select("p_partkey", "p_size", affine.alias("a")).select("p_partkey", "p_size", "a", G.composed(F.col("a"), tilt).alias("m"))


def transform_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = maps(spark, sf_dir)
    p = G.applied(F.col("m"), F.lit(3.0), F.lit(-2.0))
    return rounded(m.select("p_partkey", p["x"].alias("x"), p["y"].alias("y"), G.residual(F.col("m"), F.lit(3.0), F.lit(-2.0), F.lit(1.0), F.lit(1.0)).alias("residual")), "x", "y", "residual")


def transform_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point there and back, the determinant and whether the map is valid; a map of size 0 is not."""
    flat = F.when(F.col("p_size") % 5 == 0, G.composed(F.col("a"), G.scaling(F.lit(0.0), F.lit(1.0)))).otherwise(F.col("a"))
    m = maps(spark, sf_dir).select("p_partkey", flat.alias("m"))
    there = G.applied(F.col("m"), F.lit(5.0), F.lit(7.0))
    back = m.select("p_partkey", G.determinant(F.col("m")).alias("det"), G.valid(F.col("m")).alias("valid"), there.alias("p"), G.inverse(F.col("m")).alias("i"))
    q = G.applied(F.col("i"), F.col("p.x"), F.col("p.y"))
    return rounded(back.select("p_partkey", "det", "valid", q["x"].alias("x"), q["y"].alias("y")), "det", "x", "y", places=5)


def transform_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size")
    m = G.composed(G.rotation((F.col("p_partkey") % 170) * (math.pi / 180)), G.translation(F.col("p_size"), F.col("p_partkey") % 7))
    out = part.select("p_partkey", m.alias("m")).select("p_partkey", G.angle(F.col("m")).alias("angle"), G.shift(F.col("m")).alias("t"))
    return rounded(out.select("p_partkey", "angle", F.col("t.x").alias("tx"), F.col("t.y").alias("ty")), "angle", "tx", "ty")


def transform_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = G.theta(F.col("a"), F.lit(640.0), F.lit(480.0))
    out = maps(spark, sf_dir).select("p_partkey", t.alias("t")).select("p_partkey", *(F.col(f"t.{n}").alias(n) for n in G.CELLS[:6]))
    return rounded(out, *G.CELLS[:6], places=5)


def fit_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.similarity_fit(points(spark, sf_dir), ["s"]), "a", "b", "tx", "ty", places=5)


def fit_affine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.affine_map_fit(points(spark, sf_dir), ["s"]), *G.CELLS[:6], places=5)


def fit_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.normaliser(points(spark, sf_dir), ["s"]), "scale", "ox", "oy")


def fit_projective(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.projective_fit(points(spark, sf_dir), ["s"]), *G.CELLS, places=5)


def ransac_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As if lines of returned goods were inliers."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("inliers"), F.count(F.lit(1)).alias("total"))
    return rows.select("l_suppkey", robust.needed_trials(F.col("inliers"), F.col("total"), 3, 0.99).cast("bigint").alias("trials"))


def affine_ransac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two affine maps a supplier, one after the other."""
    out = robust.affine_clusters(points(spark, sf_dir).withColumn("m", F.col("m").cast("int")), ["s"], clusters=2)
    return robust.kept_clusters(out, least=3).drop("members")


QUERIES = {f.__name__: f for f in (transform_points, transform_inverse, transform_parts, transform_theta, fit_similarity, fit_affine, fit_normaliser, fit_projective, ransac_trials, affine_ransac)}

MAPS = """b AS (SELECT p_partkey, p_size, p_size::DOUBLE AS z, cos(p_partkey * (pi() / 180)) AS co, sin(p_partkey * (pi() / 180)) AS si FROM part),
a AS (SELECT p_partkey, p_size, co * z / 10 AS m00, -si * z / 20 AS m01, z AS m02, si * z / 10 AS m10, co * z / 20 AS m11, (p_partkey % 7)::DOUBLE AS m12 FROM b)"""
POINTS = """q AS (SELECT l_suppkey AS s, l_linenumber AS m, l_quantity AS x1, l_discount * 100 AS y1, l_suppkey * (pi() / 180) AS t, 1 + l_linenumber / 10 AS k FROM lineitem),
p AS (SELECT *, k * (cos(t) * x1 - sin(t) * y1) + s % 5 AS x2, k * (sin(t) * x1 + cos(t) * y1) + m AS y2 FROM q)"""
SQL: dict[str, str] = {}
SQL["transform_points"] = f"""
WITH {MAPS}, h AS (SELECT p_partkey, m00 * 3 - m01 * 2 + m02 AS u, m10 * 3 - m11 * 2 + m12 AS v FROM a), g AS (SELECT *, 0.001::DOUBLE * u + 0.002::DOUBLE * v + 1 AS w FROM h),
r AS (SELECT p_partkey, CASE WHEN abs(w) >= 2.220446049250313e-16 THEN u / w END AS x, CASE WHEN abs(w) >= 2.220446049250313e-16 THEN v / w END AS y FROM g)
SELECT p_partkey, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(coalesce(sqrt((x - 1) ** 2 + (y - 1) ** 2), 'Infinity'::DOUBLE), 6) + 0.0 AS residual FROM r
"""
SQL["transform_inverse"] = f"""
WITH {MAPS}, d AS (SELECT p_partkey, p_size % 5 = 0 AS flat, m00 * m11 - m01 * m10 AS det FROM a)
SELECT p_partkey, CASE WHEN flat THEN 0.0::DOUBLE ELSE round(det, 5) + 0.0 END AS det, NOT flat AND det <> 0 AS valid,
  CASE WHEN NOT flat AND det <> 0 THEN 5.0::DOUBLE END AS x, CASE WHEN NOT flat AND det <> 0 THEN 7.0::DOUBLE END AS y FROM d
"""
SQL["transform_parts"] = "SELECT p_partkey, round((p_partkey % 170) * (pi() / 180), 6) + 0.0 AS angle, p_size::DOUBLE AS tx, (p_partkey % 7)::DOUBLE AS ty FROM part"
SQL["transform_theta"] = f"""
WITH {MAPS},
i AS (SELECT *, m00 * m11 - m01 * m10 AS det FROM a),
v AS (SELECT p_partkey, m11 / det AS i00, -m01 / det AS i01, (m01 * m12 - m02 * m11) / det AS i02, -m10 / det AS i10, m00 / det AS i11, (m02 * m10 - m00 * m12) / det AS i12 FROM i WHERE det <> 0)
SELECT a.p_partkey, round(i00, 5) + 0.0 AS m00, round(i01 * 480 / 640, 5) + 0.0 AS m01, round(i00 + i01 * 480 / 640 + i02 * 2 / 640 - 1, 5) + 0.0 AS m02,
  round(i10 * 640 / 480, 5) + 0.0 AS m10, round(i11, 5) + 0.0 AS m11, round(i10 * 640 / 480 + i11 + i12 * 2 / 480 - 1, 5) + 0.0 AS m12 FROM a LEFT JOIN v USING (p_partkey)
"""
SQL["fit_similarity"] = f"""
WITH {POINTS},
c AS (SELECT s, count(*) AS n, avg(x1) AS mx, avg(y1) AS my, avg(x2) AS mu, avg(y2) AS mv, var_pop(x1) + var_pop(y1) AS w, covar_pop(x1, x2) + covar_pop(y1, y2) AS ca, covar_pop(x1, y2) - covar_pop(y1, x2) AS cb FROM p GROUP BY s),
f AS (SELECT *, CASE WHEN n >= 2 AND w > 1e-9 THEN ca / w END AS a, CASE WHEN n >= 2 AND w > 1e-9 THEN cb / w END AS b FROM c)
SELECT s, n, round(a, 5) + 0.0 AS a, round(b, 5) + 0.0 AS b, round(mu - a * mx + b * my, 5) + 0.0 AS tx, round(mv - b * mx - a * my, 5) + 0.0 AS ty FROM f
"""
SQL["fit_affine"] = f"""
WITH {POINTS},
c AS (SELECT s, count(*) AS n, avg(x1) AS mx, avg(y1) AS my, avg(x2) AS mu, avg(y2) AS mv, var_pop(x1) AS xx, var_pop(y1) AS yy, covar_pop(x1, y1) AS xy,
  covar_pop(x1, x2) AS xu, covar_pop(y1, x2) AS yu, covar_pop(x1, y2) AS xv, covar_pop(y1, y2) AS yv FROM p GROUP BY s),
d AS (SELECT *, CASE WHEN n >= 3 AND xx * yy - xy * xy > 1e-9 THEN xx * yy - xy * xy END AS det FROM c),
f AS (SELECT *, (xu * yy - yu * xy) / det AS m00, (yu * xx - xu * xy) / det AS m01, (xv * yy - yv * xy) / det AS m10, (yv * xx - xv * xy) / det AS m11 FROM d)
SELECT s, n, round(m00, 5) + 0.0 AS m00, round(m01, 5) + 0.0 AS m01, round(mu - m00 * mx - m01 * my, 5) + 0.0 AS m02, round(m10, 5) + 0.0 AS m10, round(m11, 5) + 0.0 AS m11, round(mv - m10 * mx - m11 * my, 5) + 0.0 AS m12 FROM f
"""
SQL["fit_normaliser"] = f"""
WITH {POINTS}, c AS (SELECT s, avg(x1) AS mx, avg(y1) AS my FROM p GROUP BY s),
d AS (SELECT s, mx, my, avg(sqrt((x1 - mx) ** 2 + (y1 - my) ** 2)) AS d FROM p JOIN c USING (s) GROUP BY s, mx, my), e AS (SELECT *, CASE WHEN d > 1e-12 THEN sqrt(2) / d END AS scale FROM d)
SELECT s, round(scale, 6) + 0.0 AS scale, round(-mx * scale, 6) + 0.0 AS ox, round(-my * scale, 6) + 0.0 AS oy FROM e
"""
SQL["ransac_trials"] = """
WITH c AS (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R') AS inliers, count(*) AS total FROM lineitem GROUP BY 1)
SELECT l_suppkey, CASE WHEN inliers > 0 THEN ceil(ln(1 - 0.99::DOUBLE) / ln(greatest(2.220446049250313e-16, least(1 - (inliers::DOUBLE / total) ** 3, 1 - 2.220446049250313e-16))))::BIGINT END AS trials FROM c
"""
