"""Queries of clusters, weights, fields and warps, with SQL for each. Tiles are the 64 numbers of `embeddings` as 8 x 8 pixels; keypoints are pixels of 0.1 or more, in two clusters: the
left and the right half."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import cluster, rank, warp
from tessera.plans import overlap as O

SIZE = 8


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) + 0.0 for c in columns})


def arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("tile_id"), F.col("embedding").cast("array<double>").alias("pixels"))


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.pixels(arrays(spark, sf_dir), SIZE)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = values(spark, sf_dir).where("v >= 0.1")
    return v.select("tile_id", F.when(F.col("c") < 4, 0).otherwise(1).alias("cluster"), (F.col("r") * SIZE + F.col("c")).alias("kp"), F.col("c").cast("double").alias("x"), F.col("r").cast("double").alias("y"))


def density_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cluster.density_weights(values(spark, sf_dir), points(spark, sf_dir).withColumn("x", F.col("x") + 0.25), k=3), "weight")


def vote_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cluster.vote_weights(values(spark, sf_dir), points(spark, sf_dir), 8.0), "weight")


def visible_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = values(spark, sf_dir)
    return cluster.visible(v, points(spark, sf_dir), v.where("v < -0.2"))


def kth_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cluster.kth_distances(values(spark, sf_dir), points(spark, sf_dir), 3), "nearest", "farthest")


def centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the points of each row of a tile."""
    return points(spark, sf_dir).groupBy("tile_id", F.col("y").cast("int").alias("cluster")).agg(F.avg("x").alias("x"), F.avg(F.col("y")).alias("y"))


def nearest_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.nearest_clusters(centres(spark, sf_dir))


def cluster_medoids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each tile the keypoint nearest to the mean of its keypoints."""
    p = points(spark, sf_dir)
    mean = p.groupBy("tile_id").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    d = F.round(F.pow(F.col("x") - F.col("mx"), 2) + F.pow(F.col("y") - F.col("my"), 2), 9)
    return rank.medoids(p, mean, "tile_id", "kp", d)


def maps(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, 1.0237182213, 0.1173204417, 0.5120377131, -0.1092831127, 0.9871720943, 0.2519273301), (1, 0.9017263719, 0.0182716329, 1.0281736217, 0.0512837163, 1.0918273163, -0.5192837713)], "cluster int, m00 double, m01 double, m02 double, m10 double, m11 double, m12 double")


def whole_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.density_field(values(spark, sf_dir), points(spark, sf_dir).withColumn("x", F.col("x") + 0.25), maps(spark), k=3)


def weighted_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(whole_field(spark, sf_dir), "x", "y", places=7)


def turned(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.struct(*(F.lit(v).alias(n) for n, v in (("m00", 0.8), ("m01", 0.3), ("m02", -0.7), ("m10", -0.3), ("m11", 0.8), ("m12", 2.1))))
    return warp.affine_field(arrays(spark, sf_dir), one, SIZE, SIZE)


def affine_warp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(warp.sampled(arrays(spark, sf_dir), turned(spark, sf_dir), SIZE, SIZE), "v")


def affine_warp_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(warp.sampled(arrays(spark, sf_dir), turned(spark, sf_dir), SIZE, SIZE, "bound"), "v")


def field_warp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(warp.sampled(arrays(spark, sf_dir), whole_field(spark, sf_dir), SIZE, SIZE), "v", places=5)


def flow_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(warp.flow(turned(spark, sf_dir)).select("tile_id", "r", "c", "dx", "dy"), "dx", "dy")


def flow_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warp.flow_colours(warp.flow(turned(spark, sf_dir)))


def inverse_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a turn with a bend that grows with the row."""
    bent = turned(spark, sf_dir).withColumn("x", F.col("x") + 0.013 * F.col("r") * F.col("r") + F.col("tile_id") / 977)
    return rounded(warp.inverse_field(bent, SIZE, SIZE), "x", "y")


def wavefronts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the corner (0, 0) and from (7, 3), around pixels of 0.1 or more; a source in a wall reaches nothing."""
    t = arrays(spark, sf_dir).withColumn("walls", F.transform("pixels", lambda v: v >= 0.1))
    ends = F.array(*(F.struct(F.lit(k).cast("bigint").alias("kp"), F.lit(r).alias("row"), F.lit(c).alias("column")) for k, r, c in ((0, 0, 0), (1, 7, 3))))
    return warp.wavefront(t.select("tile_id", "walls", F.inline(ends)), SIZE, SIZE).withColumn("dist", F.col("dist").cast("int"))


QUERIES = {f.__name__: f for f in (density_weights, vote_weights, visible_pixels, kth_distances, nearest_clusters, cluster_medoids, weighted_field, affine_warp, affine_warp_bound, field_warp, flow_vectors, flow_colours, inverse_fields, wavefronts)}

PX = "px AS (SELECT vec_id AS tile_id, (p // 8)::INT AS r, (p % 8)::INT AS c, embedding[p + 1]::DOUBLE AS v FROM embeddings, range(64) x(p))"
POINTS = f"{PX}, pt AS (SELECT tile_id, (c >= 4)::INT AS cluster, r * 8 + c AS kp, c::DOUBLE AS x, r::DOUBLE AS y FROM px WHERE v >= 0.1)"
NEAR = "d AS (SELECT px.tile_id, px.r, px.c, pt.cluster, kp, x, y, sqrt((px.c - x{off}) ** 2 + (px.r - y) ** 2) AS d FROM px JOIN pt USING (tile_id))"
DENSITY = f"""{POINTS}, {NEAR.format(off=" - 0.25")},
k AS (SELECT tile_id, r, c, cluster, d FROM d QUALIFY row_number() OVER (PARTITION BY tile_id, r, c, cluster ORDER BY d) = 3),
n AS (SELECT tile_id, cluster, count(*) AS n FROM pt GROUP BY 1, 2), w AS (SELECT k.*, (3 / n) / (d * d + 1e-30) AS w FROM k JOIN n USING (tile_id, cluster)),
dw AS (SELECT tile_id, r, c, cluster, w / (sum(w) OVER (PARTITION BY tile_id, r, c) + 1e-30) AS weight FROM w)"""
SQL: dict[str, str] = {}
SQL["density_weights"] = f"WITH {DENSITY} SELECT tile_id, r, c, cluster, round(weight, 6) + 0.0 AS weight FROM dw"
SQL["vote_weights"] = f"""
WITH {POINTS}, {NEAR.format(off="")}, k AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY tile_id, r, c ORDER BY d, kp) <= 5),
w AS (SELECT tile_id, r, c, cluster, sum(exp(-d * d / 64)) AS w FROM k GROUP BY ALL) SELECT tile_id, r, c, cluster, round(w / sum(w) OVER (PARTITION BY tile_id, r, c), 6) + 0.0 AS weight FROM w
"""
SQL["visible_pixels"] = f"""
WITH {POINTS}, {NEAR.format(off="")}, k AS (SELECT tile_id, r, c, cluster, d, x - c AS kx, y - r AS ky FROM d QUALIFY row_number() OVER (PARTITION BY tile_id, r, c, cluster ORDER BY d, kp) = 1),
b AS (SELECT k.*, t.c - k.c AS tx, t.r - k.r AS ty FROM k LEFT JOIN (SELECT * FROM px WHERE v < -0.2) t ON t.tile_id = k.tile_id),
f AS (SELECT *, sqrt(tx * tx + ty * ty) AS far FROM b)
SELECT tile_id, r, c, cluster, NOT bool_or(coalesce(acos(greatest(-1, least(1, (kx * tx + ky * ty) / ((d + 1e-30) * (far + 1e-30))))) < 0.2 AND far < d, false)) AS visible FROM f GROUP BY tile_id, r, c, cluster
"""
SQL["kth_distances"] = f"""
WITH {POINTS}, {NEAR.format(off="")}, k AS (SELECT *, row_number() OVER (PARTITION BY tile_id, r, c, cluster ORDER BY d) AS u, row_number() OVER (PARTITION BY tile_id, r, c, cluster ORDER BY d DESC) AS w FROM d)
SELECT tile_id, r, c, cluster, round(max(d) FILTER (u = 3), 6) + 0.0 AS nearest, round(max(d) FILTER (w = 3), 6) + 0.0 AS farthest FROM k GROUP BY tile_id, r, c, cluster
"""
SQL["nearest_clusters"] = f"""
WITH {POINTS}, m AS (SELECT tile_id, y::INT AS cluster, avg(x) AS x, avg(y) AS y FROM pt GROUP BY 1, 2),
b AS (SELECT a.tile_id, a.cluster, b.cluster AS nearest, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM m a JOIN m b ON a.tile_id = b.tile_id AND a.cluster <> b.cluster)
SELECT tile_id, cluster, nearest FROM b WHERE d > 0 QUALIFY row_number() OVER (PARTITION BY tile_id, cluster ORDER BY d, nearest) = 1
"""
SQL["cluster_medoids"] = f"""
WITH {POINTS}, m AS (SELECT tile_id, avg(x) AS mx, avg(y) AS my FROM pt GROUP BY 1)
SELECT tile_id, kp FROM pt JOIN m USING (tile_id) QUALIFY row_number() OVER (PARTITION BY tile_id ORDER BY round((x - mx) ** 2 + (y - my) ** 2, 9), kp) = 1
"""
FIELD = f"""{DENSITY}, mp AS (SELECT * FROM (VALUES (0, 1.0237182213::DOUBLE, 0.1173204417::DOUBLE, 0.5120377131::DOUBLE, -0.1092831127::DOUBLE, 0.9871720943::DOUBLE, 0.2519273301::DOUBLE), (1, 0.9017263719, 0.0182716329, 1.0281736217, 0.0512837163, 1.0918273163, -0.5192837713)) x(cluster, m00, m01, m02, m10, m11, m12)),
fl AS (SELECT tile_id, r, c, sum(weight * (m00 * (c + 0.5) + m01 * (r + 0.5) + m02)) AS x, sum(weight * (m10 * (c + 0.5) + m11 * (r + 0.5) + m12)) AS y FROM dw JOIN mp USING (cluster) GROUP BY tile_id, r, c)"""
TURN = f"{PX}, fl AS (SELECT tile_id, r, c, 0.8::DOUBLE * (c + 0.5) + 0.3::DOUBLE * (r + 0.5) - 0.7 AS x, -0.3::DOUBLE * (c + 0.5) + 0.8::DOUBLE * (r + 0.5) + 2.1 AS y FROM px)"


def sampled(bound: bool, places: int) -> str:
    """SQL that samples the tiles at the places fl."""
    inside = "1" if bound else "CASE WHEN r0 + b BETWEEN 0 AND 7 AND c0 + a BETWEEN 0 AND 7 THEN 1 ELSE 0 END"
    return f"""
q AS (SELECT tile_id, r, c, x - 0.5 AS u, y - 0.5 AS w, floor(x - 0.5)::INT AS c0, floor(y - 0.5)::INT AS r0 FROM fl),
cn AS (SELECT q.*, (CASE WHEN a = 0 THEN 1 - (u - c0) ELSE u - c0 END) * (CASE WHEN b = 0 THEN 1 - (w - r0) ELSE w - r0 END) * {inside} AS k, least(greatest(r0 + b, 0), 7) AS rr, least(greatest(c0 + a, 0), 7) AS cc FROM q, range(2) m(a), range(2) n(b))
SELECT cn.tile_id, cn.r, cn.c, round(sum(k * px.v), {places}) + 0.0 AS v FROM cn JOIN px ON px.tile_id = cn.tile_id AND px.r = rr AND px.c = cc GROUP BY cn.tile_id, cn.r, cn.c"""


SQL["weighted_field"] = f"WITH {FIELD} SELECT tile_id, r, c, round(x, 7) + 0.0 AS x, round(y, 7) + 0.0 AS y FROM fl"
SQL["affine_warp"] = f"WITH {TURN}, {sampled(False, 6)}"
SQL["affine_warp_bound"] = f"WITH {TURN}, {sampled(True, 6)}"
SQL["field_warp"] = f"WITH {FIELD}, {sampled(False, 5)}"
SQL["flow_vectors"] = f"WITH {TURN} SELECT tile_id, r, c, round(x - (c + 0.5), 6) + 0.0 AS dx, round(y - (r + 0.5), 6) + 0.0 AS dy FROM fl"
SQL["flow_colours"] = f"""
WITH {TURN}, fv AS (SELECT tile_id, r, c, x - (c + 0.5) AS dx, y - (r + 0.5) AS dy FROM fl), sz AS (SELECT *, sqrt(dx * dx + dy * dy) AS s0 FROM fv),
hs AS (SELECT *, (atan2(dy, dx) / (2 * pi()) + CASE WHEN dy < 0 THEN 1 ELSE 0 END) * 6 AS h6, s0 / max(s0) OVER (PARTITION BY tile_id) AS s FROM sz),
hq AS (SELECT *, floor(h6)::INT % 6 AS k, 1 - s AS p, 1 - s * (h6 - floor(h6)) AS q, 1 - s * (1 - (h6 - floor(h6))) AS t FROM hs)
SELECT tile_id, r, c, floor([1, q, p, p, t, 1][k + 1] * 255 + 1e-9)::INT AS red, floor([t, 1, 1, q, p, p][k + 1] * 255 + 1e-9)::INT AS green, floor([p, p, t, 1, 1, q][k + 1] * 255 + 1e-9)::INT AS blue FROM hq
"""
SQL["wavefronts"] = f"""
WITH RECURSIVE {PX}, free AS (SELECT tile_id, r, c FROM px WHERE v < 0.1),
go(tile_id, kp, r, c, d) AS (
  SELECT tile_id, 0, r, c, 0 FROM free WHERE r = 0 AND c = 0 UNION SELECT tile_id, 1, r, c, 0 FROM free WHERE r = 7 AND c = 3
  UNION SELECT go.tile_id, go.kp, f.r, f.c, d + 1 FROM go JOIN free f ON f.tile_id = go.tile_id AND abs(f.r - go.r) + abs(f.c - go.c) = 1 WHERE d < 40),
best AS (SELECT tile_id, kp, r, c, min(d) AS d FROM go GROUP BY ALL)
SELECT px.tile_id, k.kp::BIGINT AS kp, px.r, px.c, coalesce(d, 99999)::INT AS dist FROM px CROSS JOIN range(2) k(kp) LEFT JOIN best ON best.tile_id = px.tile_id AND best.kp = k.kp AND best.r = px.r AND best.c = px.c
"""
SQL["inverse_fields"] = f"""
WITH {TURN}, v AS (SELECT tile_id, r, c, x + 0.013::DOUBLE * r * r + tile_id / 977 AS x, y, c + 0.5::DOUBLE AS u, r + 0.5::DOUBLE AS w FROM fl),
t AS (SELECT o.tile_id, p.r AS tr, d.c AS tc, k, o.x AS ox, o.y AS oy, o.u AS ou, o.w AS ow, p.x AS px, p.y AS py, p.u AS pu, p.w AS pw, d.x AS qx, d.y AS qy, d.u AS qu, d.w AS qw
  FROM v p JOIN v d ON d.tile_id = p.tile_id AND d.r = p.r + 1 AND d.c = p.c - 1, range(2) z(k) JOIN v o ON o.tile_id = p.tile_id AND o.r = p.r + k AND o.c = d.c + k),
s AS (SELECT t.*, i, j, (px - ox) * (qy - oy) - (qx - ox) * (py - oy) AS area, j + 0.5 - ox AS dx, i + 0.5 - oy AS dy FROM t, range(8) a(i), range(8) b(j)),
b AS (SELECT *, (dx * (qy - oy) - (qx - ox) * dy) / area AS s, ((px - ox) * dy - dx * (py - oy)) / area AS z FROM s WHERE abs(area) > 1e-9),
m AS (SELECT * FROM b WHERE s >= -1e-9 AND z >= -1e-9 AND s + z <= 1 + 1e-9 QUALIFY row_number() OVER (PARTITION BY tile_id, i, j ORDER BY tr, tc, k) = 1)
SELECT tile_id, i::INT AS r, j::INT AS c, round(ou + s * (pu - ou) + z * (qu - ou), 6) + 0.0 AS x, round(ow + s * (pw - ow) + z * (qw - ow), 6) + 0.0 AS y FROM m
"""
