"""Queries of matching, similarity, heat maps and natural order, with SQL for each. Tiles are the 64 numbers of `embeddings` as 8 x 8 pixels, in grids 25 wide; the keypoints of
a tile are its rows of pixels."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import natural
from tessera.operators import heads, matching, metrics, ssim
from tessera.plans import overlap as O

WIDTH, SIZE = 25, 8
ON = ["i", "j", "direction"]


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) + 0.0 for c in columns})


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return O.grid(e.select(F.col("vec_id").alias("tile_id"), F.col("vec_id").alias("seq"), F.col("embedding").cast("array<double>").alias("pixels")), WIDTH)


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Keypoints of the two tiles of each pair: row k of the pixels at (10 times its first pixel, k)."""
    t = tiles(spark, sf_dir)
    rows = t.select("tile_id", F.explode(F.sequence(F.lit(0), F.lit(SIZE - 1))).alias("kp"), "pixels").withColumn("f", F.slice("pixels", F.col("kp") * SIZE + 1, F.lit(SIZE))).drop("pixels")
    rows = rows.withColumn("x", 10 * F.get("f", F.lit(0))).withColumn("y", F.col("kp").cast("double"))
    pairs = O.neighbour_pairs(t)
    out = []
    for n, side in ((1, "prev"), (2, "cur")):
        named = rows.select(F.col("tile_id").alias(side), *(F.col(c).alias(f"{c}{n}") for c in ("kp", "f", "x", "y")))
        out.append(pairs.join(named, side).select(*ON, f"kp{n}", f"f{n}", f"x{n}", f"y{n}"))
    return out[0], out[1]


def unit_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit descriptors, the nearest against the second nearest by 0.8 at most, and no further than 1.5."""
    left, right = sides(spark, sf_dir)
    left, right = left.withColumn("f1", matching.normal(F.col("f1"))), right.withColumn("f2", matching.normal(F.col("f2")))
    return rounded(matching.nearest(left, right, ON, metric="unit", max_ratio=0.8, threshold=1.5), "d2")


def radius_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = sides(spark, sf_dir)
    return rounded(matching.radius_matches(left, right, ON, 3.0), "ratio")


def matched_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = sides(spark, sf_dir)
    pairs = matching.nearest(left, right, ON)
    return rounded(matching.gathered_points(pairs, left, right, ON), "x1", "x2")


def windowed_ssim(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tiles(spark, sf_dir)
    pairs = O.neighbour_pairs(t).join(t.select(F.col("tile_id").alias("prev"), F.col("pixels").alias("pa")), "prev").join(t.select(F.col("tile_id").alias("cur"), F.col("pixels").alias("pb")), "cur")
    return rounded(ssim.windowed_ssim(pairs, SIZE, SIZE, ON, window=5), "ssim", "cs")


def average_ssim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the directions' means, of similarity and of a made-up time."""
    t = tiles(spark, sf_dir)
    px = O.shared_pixels(O.neighbour_pairs(t), t, SIZE, F.lit(1), F.lit(2))
    rows = metrics.global_ssim(px, ON).withColumn("time", (F.col("i") + 2 * F.col("j")) / 10).withColumn("dataset", F.lit("embeddings"))
    return rounded(metrics.mean_of_means(rows, ["dataset"], "direction", ["ssim", "time"]), "average_ssim", "average_time")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as a cell's 64 logits and a dustbin of 0.5, in one map 25 cells wide."""
    t = tiles(spark, sf_dir)
    return t.select(F.lit(0).alias("tile_id"), "i", "j", F.concat("pixels", F.array(F.lit(0.5))).alias("semi"), F.col("pixels").alias("vector"))


def heat_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(heads.heat_map(cells(spark, sf_dir)).drop("tile_id"), "score", places=8)


def heat_keypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as a tile of its own: one cell of 8 x 8 pixels."""
    own = cells(spark, sf_dir).select((F.col("i") * WIDTH + F.col("j")).cast("bigint").alias("tile_id"), F.lit(0).alias("i"), F.lit(0).alias("j"), "semi")
    return rounded(heads.heat_keypoints(own, SIZE, SIZE, least=0.0158, radius=2, border=1), "score", places=8)


def sampled_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptors at places made from part keys, in a map of 25 vectors a row and as many rows as there are, at 8 pixels a vector."""
    rows = math.ceil(spark.read.parquet(f"{sf_dir}/embeddings.parquet").count() / WIDTH)
    points = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.lit(0).alias("tile_id"), F.col("p_partkey").alias("kp_id"), (F.col("p_partkey") * 7 % 200 + 0.25).alias("x"), (F.col("p_partkey") * 11 % (8 * rows) + 0.5).alias("y"))
    out = heads.sampled_descriptors(points, cells(spark, sf_dir), 8 * WIDTH, 8 * rows, WIDTH, rows)
    return rounded(out.select("kp_id", F.posexplode("descriptor").alias("k", "v")).where("k % 16 = 0"), "v")


def natural_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs with signed decimals, numbers after characters, by case."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    key = natural.natural_key(F.col("url"), match_case=True, form="decimal", numbers_first=False)
    return pages.select("page_id", F.array_join(F.transform(key, lambda x: F.concat_ws(":", F.rtrim(F.translate(x["t"], natural.LAST, " ")), x["has"], F.round(x["n"], 6).cast("decimal(30,6)").cast("string"))), "|").alias("key"))


def sliced_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each host's URLs in natural order, every second from the second on: numbered as files of a data set."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.regexp_extract("url", "://([^/]*)", 1).alias("dataset"), F.col("url").alias("name")).distinct()
    return O.sliced(pages, natural.natural_key(F.col("name")), start=2, hop=2)


def name_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense ranks of the numbers in customers' names, within a nation."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return O.natural_ranks(c.select("c_custkey", "c_nationkey", F.concat_ws("", F.lit("x"), (F.col("c_custkey") % 13).cast("string"), F.lit("y")).alias("name")), ["c_nationkey"], natural.natural_key(F.col("name")), descending=True)


QUERIES = {f.__name__: f for f in (unit_matches, radius_matches, matched_points, windowed_ssim, average_ssim, heat_map, heat_keypoints, sampled_descriptors, natural_options, sliced_files, name_ranks)}

TILES = "t AS (SELECT vec_id AS tile_id, (vec_id // 25)::INT AS i, (vec_id % 25)::INT AS j, embedding::DOUBLE[] AS px FROM embeddings)"
PAIRS = (
    "pairs AS (SELECT a.i, a.j, 'north' AS direction, b.tile_id AS prev, a.tile_id AS cur, b.px AS pa, a.px AS pb FROM t a JOIN t b ON a.i = b.i + 1 AND a.j = b.j "
    "UNION ALL SELECT a.i, a.j, 'west', b.tile_id, a.tile_id, b.px, a.px FROM t a JOIN t b ON a.i = b.i AND a.j = b.j + 1)"
)
KEYS = "i, j, direction"
RANKS = f"r AS (SELECT *, row_number() OVER (PARTITION BY {KEYS}, kp1 ORDER BY d2, kp2) AS r1, lead(d2) OVER (PARTITION BY {KEYS}, kp1 ORDER BY d2, kp2) AS second, row_number() OVER (PARTITION BY {KEYS}, kp2 ORDER BY d2, kp1) AS r2 FROM d)"
PLAIN = "list_sum(list_transform(range(1, 9), lambda q: (pa[kp1 * 8 + q] - pb[kp2 * 8 + q]) ** 2))"
SQL: dict[str, str] = {}
SQL["unit_matches"] = f"""
WITH {TILES}, {PAIRS}, l AS (SELECT {KEYS}, kp1::INT AS kp1, kp2::INT AS kp2, pa[kp1 * 8 + 1:kp1 * 8 + 8] AS f, pb[kp2 * 8 + 1:kp2 * 8 + 8] AS g FROM pairs, range(8) x(kp1), range(8) y(kp2)),
d AS (SELECT {KEYS}, kp1, kp2, 2 - 2 * list_inner_product(f, g) / (sqrt(list_inner_product(f, f)) * sqrt(list_inner_product(g, g))) AS d2 FROM l), {RANKS}
SELECT {KEYS}, kp1, kp2, round(d2, 6) + 0.0 AS d2 FROM r WHERE r1 = 1 AND r2 = 1 AND (second IS NULL OR d2 <= 0.8::DOUBLE * greatest(second, 0.001)) AND d2 <= 1.5
"""
SQL["radius_matches"] = f"""
WITH {TILES}, {PAIRS}, l AS (SELECT *, (10 * pa[kp1 * 8 + 1] - 10 * pb[kp2 * 8 + 1]) ** 2 + (kp1 - kp2) ** 2 AS gap FROM pairs, range(8) x(kp1), range(8) y(kp2)),
d AS (SELECT {KEYS}, kp1::INT AS kp1, kp2::INT AS kp2, {PLAIN} AS d2 FROM l WHERE gap <= 9), {RANKS}
SELECT {KEYS}, kp1, kp2, round(d2 / greatest(coalesce(second, 1e30), 0.001), 6) + 0.0 AS ratio FROM r WHERE r1 = 1 AND r2 = 1
"""
SQL["matched_points"] = f"""
WITH {TILES}, {PAIRS}, d AS (SELECT {KEYS}, pa, pb, kp1::INT AS kp1, kp2::INT AS kp2, {PLAIN} AS d2 FROM pairs, range(8) x(kp1), range(8) y(kp2)), {RANKS}
SELECT {KEYS}, kp1 AS m, round(10 * pa[kp1 * 8 + 1], 6) + 0.0 AS x1, kp1::DOUBLE AS y1, round(10 * pb[kp2 * 8 + 1], 6) + 0.0 AS x2, kp2::DOUBLE AS y2 FROM r WHERE r1 = 1 AND r2 = 1
"""
G = ssim.window_weights(5)
SQL["windowed_ssim"] = f"""
WITH {TILES}, {PAIRS}, g AS (SELECT * FROM (VALUES {", ".join(f"({k}, {w!r}::DOUBLE)" for k, w in enumerate(G))}) x(k, w)),
x AS (SELECT {KEYS}, r0, c0, CASE WHEN list_max(pa) > 128 THEN 255 ELSE 1 END - CASE WHEN list_min(pa) < -0.5 THEN -1 ELSE 0 END AS span, a.w * b.w AS w, pa[(r0 + a.k) * 8 + c0 + b.k + 1] AS a, pb[(r0 + a.k) * 8 + c0 + b.k + 1] AS b
  FROM pairs, range(4) y(r0), range(4) z(c0), g a, g b),
m AS (SELECT {KEYS}, r0, c0, span, sum(w * a) AS ma, sum(w * b) AS mb, sum(w * a * a) AS aa, sum(w * b * b) AS bb, sum(w * a * b) AS ab FROM x GROUP BY ALL),
v AS (SELECT *, (0.01 * span) ** 2 AS c1, 2 * (ab - ma * mb) + (0.03 * span) ** 2 AS v1, aa - ma * ma + bb - mb * mb + (0.03 * span) ** 2 AS v2 FROM m)
SELECT {KEYS}, round(avg((2 * ma * mb + c1) * v1 / ((ma * ma + mb * mb + c1) * v2)), 6) + 0.0 AS ssim, round(avg(v1 / v2), 6) + 0.0 AS cs FROM v GROUP BY {KEYS}
"""
SQL["average_ssim"] = f"""
WITH {TILES}, {PAIRS}, px AS (SELECT {KEYS}, pa[r * 8 + c + 1] AS a, pb[(r - 2) * 8 + c - 1 + 1] AS b FROM pairs, range(2, 8) y(r), range(1, 8) x(c)),
m AS (SELECT {KEYS}, max(a) AS ma, max(b) AS mb, avg(a) AS ua, avg(b) AS ub, var_samp(a) AS va, var_samp(b) AS vb, covar_samp(a, b) AS cab FROM px GROUP BY {KEYS}),
s AS (SELECT *, ua / ma AS x, ub / mb AS y, va / ma ** 2 AS vx, vb / mb ** 2 AS vy, cab / (ma * mb) AS cxy FROM m),
e AS (SELECT direction, (i + 2 * j) / 10 AS time, CASE WHEN ma <> 0 AND mb <> 0 AND (x * x + y * y) * (vx + vy) <> 0 THEN 4 * x * y * cxy / ((x * x + y * y) * (vx + vy)) END AS ssim FROM s),
d AS (SELECT direction, avg(ssim) AS ssim, avg(time) AS time FROM e GROUP BY direction)
SELECT 'embeddings' AS dataset, round(avg(ssim), 6) + 0.0 AS average_ssim, round(avg(time), 6) + 0.0 AS average_time FROM d HAVING count(*) > 0
"""
SQL["heat_map"] = f"""
WITH {TILES}, s AS (SELECT *, list_sum(list_transform(px, lambda v: exp(v))) + exp(0.5::DOUBLE) + 0.00001::DOUBLE AS total FROM t)
SELECT (i * 8 + k // 8)::INT AS r, (j * 8 + k % 8)::INT AS c, round(exp(px[k + 1]) / total, 8) + 0.0 AS score FROM s, range(64) x(k)
"""
SQL["heat_keypoints"] = f"""
WITH {TILES}, s AS (SELECT *, list_sum(list_transform(px, lambda v: exp(v))) + exp(0.5::DOUBLE) + 0.00001::DOUBLE AS total FROM t),
h AS (SELECT tile_id, (k // 8)::INT AS r, (k % 8)::INT AS c, exp(px[k + 1]) / total AS s FROM s, range(64) x(k)),
p AS (SELECT tile_id, list([{{'x': c, 'y': r, 's': s}}] ORDER BY s DESC, r, c) AS pts FROM h WHERE s >= 0.0158 GROUP BY tile_id),
f AS (SELECT tile_id, list_reduce(pts, lambda acc, q: CASE WHEN len(list_filter(acc, lambda z: abs(z.x - q[1].x) <= 2 AND abs(z.y - q[1].y) <= 2)) > 0 THEN acc ELSE acc || q END) AS kept FROM p),
k AS (SELECT tile_id, n::INT AS kp_id, kept[n + 1] AS z FROM (SELECT tile_id, kept, unnest(range(len(kept))) AS n FROM f))
SELECT tile_id, kp_id, z.x AS x, z.y AS y, round(z.s, 8) + 0.0 AS score FROM k WHERE z.x BETWEEN 1 AND 6 AND z.y BETWEEN 1 AND 6
"""
SQL["sampled_descriptors"] = f"""
WITH {TILES}, h AS (SELECT ceil(count(*) / 25)::BIGINT AS h FROM embeddings),
p AS (SELECT p_partkey AS kp_id, (p_partkey * 7 % 200 + 0.25::DOUBLE) * 25 / 200 - 0.5 AS px, (p_partkey * 11 % (8 * h) + 0.5::DOUBLE) * h / (8 * h) - 0.5 AS py FROM part, h),
o AS (SELECT kp_id, floor(px)::INT + a AS j, floor(py)::INT + b AS i, (1 - abs(px - floor(px) - a)) * (1 - abs(py - floor(py) - b)) AS w FROM p, range(2) x(a), range(2) y(b)),
s AS (SELECT kp_id, k::INT AS k, sum(w * px[k + 1]) AS v FROM o JOIN t USING (i, j), range(64) z(k) WHERE w > 0 GROUP BY kp_id, k), n AS (SELECT kp_id, sqrt(sum(v * v)) AS len FROM s GROUP BY kp_id)
SELECT kp_id, k, round(v / nullif(len, 0), 6) + 0.0 AS v FROM s JOIN n USING (kp_id) WHERE k % 16 = 0
"""
SQL["natural_options"] = r"""
WITH r AS (SELECT page_id, url, regexp_extract_all(url, '(?s).*?(?:[-+]?[0-9]*\.?[0-9]+)|.+$') AS runs FROM pages),
l AS (SELECT page_id, url, list_transform(runs, lambda x: CASE WHEN regexp_matches(x, '(?:[-+]?[0-9]*\.?[0-9]+)$')
  THEN regexp_extract(x, '^((?s:.*?))([-+]?[0-9]*\.?[0-9]+)$', 1) || ':1:' || regexp_extract(x, '^((?s:.*?))([-+]?[0-9]*\.?[0-9]+)$', 2)::DOUBLE::DECIMAL(30, 6)::VARCHAR ELSE x || ':0:0.000000' END) AS k FROM r)
SELECT page_id, CASE WHEN url IS NOT NULL THEN array_to_string(k, '|') END AS key FROM l
"""
SQL["sliced_files"] = r"""
WITH p AS (SELECT DISTINCT regexp_extract(url, '://([^/]*)', 1) AS dataset, url AS name FROM pages),
k AS (SELECT *, list_transform(regexp_extract_all(lower(name), '(?s).*?[0-9]+|.+$'), lambda x: {'t': regexp_replace(x, '[0-9]+$', ''), 'n': CASE WHEN regexp_matches(x, '[0-9]+$') THEN regexp_extract(x, '[0-9]+$')::HUGEINT ELSE -1 END}) AS key FROM p),
n AS (SELECT dataset, name, row_number() OVER (PARTITION BY dataset ORDER BY key, name) AS place FROM k)
SELECT dataset, name, ((place - 2) // 2)::INT AS seq FROM n WHERE place >= 2 AND (place - 2) % 2 = 0
"""
SQL["name_ranks"] = "SELECT c_custkey, c_nationkey, 'x' || c_custkey % 13 || 'y' AS name, (dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_custkey % 13 DESC))::INT AS place FROM customer"
