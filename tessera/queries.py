"""The registration operators as queries over the tables of a folder, with SQL for each.

Tiles are the 64 numbers of `embeddings` as 8 x 8 pixels, in grids 25 wide."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import queries_detect, queries_features, queries_geometry, queries_models, queries_pixels, queries_register, queries_sources, queries_warp
from tessera.functions.natural import natural_key
from tessera.operators import detect, matching, metrics, robust, spectral
from tessera.plans import overlap as O

WIDTH, SIZE = 25, 8


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return O.grid(e.select(F.col("vec_id").alias("tile_id"), F.col("vec_id").alias("seq"), F.col("embedding").cast("array<double>").alias("pixels")), WIDTH)


def a01_overlap_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tiles(spark, sf_dir)
    px = O.shared_pixels(O.neighbour_pairs(t), t, SIZE, F.lit(1), F.lit(2))
    return px.groupBy("i", "j", "direction").agg(F.count(F.lit(1)).alias("n"), F.round(metrics.rmse(), 6).alias("rmse"), F.round(metrics.ncc(), 6).alias("ncc"))


def pixels_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tiles(spark, sf_dir)
    return O.shared_pixels(O.neighbour_pairs(t), t, SIZE, F.lit(1), F.lit(2))


def overlap_ssim(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.global_ssim(pixels_shared(spark, sf_dir), ["i", "j", "direction"])
    return out.withColumn("ssim", F.round("ssim", 6))


def overlap_nmi(spark: SparkSession, sf_dir: str) -> DataFrame:
    grey = pixels_shared(spark, sf_dir).withColumn("a", F.floor((F.col("a") + 1) * 127.5).cast("int")).withColumn("b", F.floor((F.col("b") + 1) * 127.5).cast("int"))
    return metrics.nmi(grey, ["i", "j", "direction"]).withColumn("nmi", F.round("nmi", 6) + 0.0)


def average_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels_shared(spark, sf_dir).groupBy("i", "j", "direction").agg(metrics.rmse().alias("rmse"))
    out = metrics.mean_of_means(px.withColumn("dataset", F.lit("embeddings")), ["dataset"], "direction", ["rmse"])
    return out.withColumn("average_rmse", F.round("average_rmse", 6))


def mutual_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of pixels of each tile are its descriptors."""
    t = tiles(spark, sf_dir)
    rows = t.select("tile_id", F.explode(F.sequence(F.lit(0), F.lit(SIZE - 1))).alias("kp"), "pixels").withColumn("f", F.slice("pixels", F.col("kp") * SIZE + 1, F.lit(SIZE))).drop("pixels")
    pairs = O.neighbour_pairs(t)
    on = ["i", "j", "direction"]
    left = pairs.join(rows.select(F.col("tile_id").alias("prev"), F.col("kp").alias("kp1"), F.col("f").alias("f1")), "prev").select(*on, "kp1", "f1")
    right = pairs.join(rows.select(F.col("tile_id").alias("cur"), F.col("kp").alias("kp2"), F.col("f").alias("f2")), "cur").select(*on, "kp2", "f2")
    return matching.nearest(left, right, on).withColumn("d2", F.round("d2", 6))


def order_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as matches: whole numbers as places, moved by (0 to 2, 0 or 1)."""
    n = lambda c: F.round(F.expr(c)).cast("double")
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.select("l_orderkey", F.col("l_linenumber").alias("m"), n("l_quantity").alias("x1"), n("l_discount * 100").alias("y1"), n("l_quantity + l_suppkey % 3").alias("x2"), (n("l_discount * 100") + n("l_linenumber % 2")).alias("y2"))


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def shift_least_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(robust.least_squares_shift(order_matches(spark, sf_dir), ["l_orderkey"]), "tx", "ty")


def shift_msac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(robust.msac_shift(order_matches(spark, sf_dir), ["l_orderkey"]), "tx", "ty", "error")


def shift_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fewer than five matches are too few."""
    return rounded(robust.msac_shift(order_matches(spark, sf_dir), ["l_orderkey"], least=5), "tx", "ty", "error")


def shift_ransac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(robust.ransac_shift(order_matches(spark, sf_dir), ["l_orderkey"]), "tx", "ty", "error")


def affine_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    points = rows.select("l_returnflag", F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), F.col("l_extendedprice").alias("u"))
    return rounded(robust.affine_fit(points, ["l_returnflag"]), "a", "b", "c", places=3)


def natural_sort_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    runs = F.transform(natural_key(F.col("url")), lambda x: F.concat_ws(":", x["t"], F.when(x["has"] == 1, x["digits"]).otherwise("-1")))
    return pages.select("page_id", F.array_join(runs, "|").alias("key"))


def aligned(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    t = tiles(spark, sf_dir)
    pairs = O.neighbour_pairs(t).join(t.select(F.col("tile_id").alias("prev"), F.col("pixels").alias("pa")), "prev").join(t.select(F.col("tile_id").alias("cur"), F.col("pixels").alias("pb")), "cur")
    return spectral.align(pairs, SIZE, SIZE, "i int, j int, direction string", method)


def align_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(spark, sf_dir, "phase")


def align_ncc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(spark, sf_dir, "ncc")


def detector_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    methods = ["harris", "min_eigen", "hessian", "fast"]
    out = detect.responses(tiles(spark, sf_dir), SIZE, SIZE, methods)
    return out.withColumns({m: F.round(m, 6) + 0.0 for m in methods})


def keypoints(method: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = detect.detect(tiles(spark, sf_dir), SIZE, SIZE, method)
        corner = {n: F.round(F.get("descriptor", F.lit(i)), 6) + 0.0 for n, i in (("d_first", 0), ("d_centre", 24), ("d_last", 48))}
        return out.withColumn("score", F.col("score") + 0.0).withColumns(corner).drop("descriptor", "size", "angle", "bits")

    return run


QUERIES = {
    f.__name__: f
    for f in (a01_overlap_rmse, overlap_ssim, overlap_nmi, average_rmse, mutual_matches, shift_least_squares, shift_msac, shift_guarded, shift_ransac, affine_rows, natural_sort_keys, align_phase, align_ncc, detector_responses)
} | {f"keypoints_{m}": keypoints(m) for m in detect.DETECTORS}

TILES = "t AS (SELECT vec_id AS tile_id, (vec_id // 25)::INT AS i, (vec_id % 25)::INT AS j, embedding::DOUBLE[] AS px FROM embeddings)"
PAIRS = (
    "pairs AS (SELECT a.i, a.j, 'north' AS direction, b.tile_id AS prev, a.tile_id AS cur, b.px AS pa, a.px AS pb FROM t a JOIN t b ON a.i = b.i + 1 AND a.j = b.j "
    "UNION ALL SELECT a.i, a.j, 'west', b.tile_id, a.tile_id, b.px, a.px FROM t a JOIN t b ON a.i = b.i AND a.j = b.j + 1)"
)
SHARED = "px AS (SELECT pairs.*, r, c, pa[r * 8 + c + 1] AS a, pb[(r - 2) * 8 + c - 1 + 1] AS b FROM pairs, range(2, 8) y(r), range(1, 8) x(c))"
SQL = {
    "a01_overlap_rmse": f"WITH {TILES}, {PAIRS}, {SHARED} SELECT i, j, direction, count(*) AS n, round(sqrt(avg((b - a) ** 2)), 6) AS rmse, round(CASE WHEN isfinite(corr(a, b)) THEN corr(a, b) ELSE -1 END, 6) AS ncc FROM px GROUP BY i, j, direction",
}

KEYS = "i, j, direction"
SQL["overlap_ssim"] = f"""
WITH {TILES}, {PAIRS}, {SHARED},
m AS (SELECT {KEYS}, max(a) AS ma, max(b) AS mb, avg(a) AS ua, avg(b) AS ub, var_samp(a) AS va, var_samp(b) AS vb, covar_samp(a, b) AS cab FROM px GROUP BY {KEYS}),
s AS (SELECT {KEYS}, ma, mb, ua / ma AS x, ub / mb AS y, va / ma ** 2 AS vx, vb / mb ** 2 AS vy, cab / (ma * mb) AS cxy FROM m)
SELECT {KEYS}, round(CASE WHEN ma <> 0 AND mb <> 0 AND (x * x + y * y) * (vx + vy) <> 0 THEN 4 * x * y * cxy / ((x * x + y * y) * (vx + vy)) END, 6) AS ssim FROM s
"""
SQL["overlap_nmi"] = f"""
WITH {TILES}, {PAIRS}, {SHARED},
g AS (SELECT {KEYS}, floor((a + 1) * 127.5)::INT AS a, floor((b + 1) * 127.5)::INT AS b FROM px),
h AS (
  SELECT {KEYS}, 'ab' AS what, count(*) AS n FROM g GROUP BY {KEYS}, a, b UNION ALL
  SELECT {KEYS}, 'a', count(*) FROM g GROUP BY {KEYS}, a UNION ALL SELECT {KEYS}, 'b', count(*) FROM g GROUP BY {KEYS}, b),
e AS (SELECT {KEYS}, what, n / sum(n) OVER (PARTITION BY {KEYS}, what) AS p FROM h),
s AS (SELECT {KEYS}, -sum(p * log2(p)) FILTER (what = 'ab') AS hab, -sum(p * log2(p)) FILTER (what = 'a') AS ha, -sum(p * log2(p)) FILTER (what = 'b') AS hb FROM e GROUP BY {KEYS})
SELECT {KEYS}, round(CASE WHEN ha + hb <> 0 THEN 2 * (ha + hb - hab) / (ha + hb) END, 6) + 0.0 AS nmi FROM s
"""
SQL["average_rmse"] = f"""
WITH {TILES}, {PAIRS}, {SHARED},
r AS (SELECT {KEYS}, sqrt(avg((b - a) ** 2)) AS rmse FROM px GROUP BY {KEYS}),
d AS (SELECT direction, avg(rmse) AS rmse FROM r GROUP BY direction)
SELECT 'embeddings' AS dataset, round(avg(rmse), 6) AS average_rmse FROM d HAVING count(*) > 0
"""
SQL["mutual_matches"] = f"""
WITH {TILES}, {PAIRS},
d AS (SELECT {KEYS}, kp1, kp2, list_sum(list_transform(range(1, 9), lambda q: (pa[kp1 * 8 + q] - pb[kp2 * 8 + q]) ** 2)) AS d2 FROM pairs, range(8) x(kp1), range(8) y(kp2)),
r AS (SELECT *, row_number() OVER (PARTITION BY {KEYS}, kp1 ORDER BY d2, kp2) AS r1, row_number() OVER (PARTITION BY {KEYS}, kp2 ORDER BY d2, kp1) AS r2 FROM d)
SELECT {KEYS}, kp1::INT AS kp1, kp2::INT AS kp2, round(d2, 6) AS d2 FROM r WHERE r1 = 1 AND r2 = 1
"""
MOVES = (
    "m AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY m, dx, dy) AS k FROM "
    "(SELECT l_orderkey, l_linenumber AS m, round(l_quantity + l_suppkey % 3) - round(l_quantity) AS dx, (l_linenumber % 2)::DOUBLE AS dy FROM lineitem))"
)
SQL["shift_least_squares"] = f"WITH {MOVES} SELECT l_orderkey, round(avg(dx), 6) AS tx, round(avg(dy), 6) AS ty, count(*) AS n_match FROM m GROUP BY l_orderkey"
REFIT = """
f AS (
  SELECT l_orderkey, count(*) AS n_match, count(*) FILTER ({inside}) AS n_in, avg(dx) FILTER ({inside}) AS tx, avg(dy) FILTER ({inside}) AS ty
  FROM m LEFT JOIN best USING (l_orderkey) GROUP BY l_orderkey),
e AS (SELECT l_orderkey, sqrt(avg((dx - tx) ** 2 + (dy - ty) ** 2)) AS error FROM m JOIN best USING (l_orderkey) JOIN f USING (l_orderkey) WHERE {inside} GROUP BY l_orderkey),
g AS (SELECT f.*, error, CASE WHEN n_match < {least} THEN 1 WHEN n_in < 1 THEN 2 ELSE 0 END AS status FROM f LEFT JOIN e USING (l_orderkey))
SELECT l_orderkey, CASE WHEN status = 0 THEN round(tx, 6) END AS tx, CASE WHEN status = 0 THEN round(ty, 6) END AS ty, n_match,
  CASE WHEN status = 0 THEN n_in ELSE 0 END AS n_inlier, status, CASE WHEN status = 0 THEN round(error, 6) END AS error FROM g
"""
MSAC = f"""
WITH {MOVES},
cost AS (SELECT m.l_orderkey, h.k, h.m AS h, h.dx AS hx, h.dy AS hy, sum(least((m.dx - h.dx) ** 2 + (m.dy - h.dy) ** 2, 2.25)) AS cost FROM m JOIN m h ON m.l_orderkey = h.l_orderkey GROUP BY ALL),
best AS (SELECT l_orderkey, hx, hy FROM cost QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY round(cost, 9), h, hx, hy) = 1),
"""
SQL["shift_msac"] = MSAC + REFIT.format(inside="(dx - hx) ** 2 + (dy - hy) ** 2 <= 2.25", least=1)
SQL["shift_guarded"] = MSAC + REFIT.format(inside="(dx - hx) ** 2 + (dy - hy) ** 2 <= 2.25", least=5)
SQL["shift_ransac"] = f"""
WITH {MOVES},
hyp AS (SELECT a.l_orderkey, a.k AS k1, b.k AS k2, a.m AS m1, b.m AS m2, (a.dx + b.dx) / 2 AS hx, (a.dy + b.dy) / 2 AS hy FROM m a JOIN m b ON a.l_orderkey = b.l_orderkey AND a.k < b.k),
res AS (SELECT hyp.*, (dx - hx) ** 2 + (dy - hy) ** 2 AS r FROM m JOIN hyp USING (l_orderkey)),
score AS (SELECT l_orderkey, k1, k2, m1, m2, hx, hy, count(*) FILTER (r < 1) AS n, sum(CASE WHEN r < 1 THEN r ELSE 0 END) AS ssr FROM res GROUP BY ALL),
best AS (SELECT l_orderkey, hx, hy FROM score QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, round(ssr, 9), m1, m2, hx, hy) = 1),
{REFIT.format(inside="(dx - hx) ** 2 + (dy - hy) ** 2 < 1", least=2)}
"""
SQL["affine_rows"] = """
WITH p AS (SELECT l_returnflag, l_quantity AS x, l_discount * 100 AS y, l_extendedprice AS u FROM lineitem),
s AS (SELECT l_returnflag, avg(x) AS mx, avg(y) AS my, avg(u) AS mu, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy, covar_pop(x, u) AS xu, covar_pop(y, u) AS yu, count(*) AS n FROM p GROUP BY 1),
f AS (SELECT *, n >= 3 AND abs(xx * yy - xy * xy) > 1e-9 AS ok, xx * yy - xy * xy AS det FROM s),
g AS (SELECT *, CASE WHEN ok THEN (xu * yy - yu * xy) / det END AS a, CASE WHEN ok THEN (yu * xx - xu * xy) / det END AS b FROM f)
SELECT l_returnflag, round(a, 3) AS a, round(b, 3) AS b, round(mu - a * mx - b * my, 3) AS c, n FROM g
"""
SQL["natural_sort_keys"] = r"""
WITH r AS (SELECT page_id, url, regexp_extract_all(lower(url), '(?s).*?[0-9]+|.+$') AS runs FROM pages)
SELECT page_id, CASE WHEN url IS NOT NULL THEN array_to_string(list_transform(runs, lambda x: regexp_replace(x, '[0-9]+$', '') || ':' ||
  CASE WHEN regexp_matches(x, '[0-9]+$') THEN regexp_extract(x, '[0-9]+$')::DECIMAL(38, 0)::VARCHAR ELSE '-1' END), '|') END AS key FROM r
"""

SQL["align_ncc"] = f"""
WITH {TILES}, {PAIRS},
pl AS (SELECT {KEYS}, d, CASE WHEN direction = 'north' THEN pb[r * 8 + c + 1] ELSE pb[c * 8 + r + 1] END AS t, CASE WHEN direction = 'north' THEN pa[(3 + d + r) * 8 + c + 1] ELSE pa[c * 8 + 3 + d + r + 1] END AS s
  FROM pairs, range(2) x(d), range(4) y(r), range(8) z(c)),
k AS (SELECT {KEYS}, d, CASE WHEN isfinite(corr(t, s)) THEN corr(t, s) ELSE 0 END AS ncc FROM pl GROUP BY {KEYS}, d),
b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY {KEYS} ORDER BY round(ncc, 9) DESC, d) = 1)
SELECT {KEYS}, CASE WHEN direction = 'north' THEN 0 ELSE (3 + d)::INT END AS tx, CASE WHEN direction = 'north' THEN (3 + d)::INT ELSE 0 END AS ty, round(ncc, 6) AS ncc FROM b
"""
SQL["align_phase"] = f"""
WITH {TILES}, {PAIRS},
w AS (SELECT u, x, cos(pi() * u * x / 4) AS co, -sin(pi() * u * x / 4) AS si FROM range(8) a(u), range(8) b(x)),
px AS (SELECT tile_id, p // 8 AS r, p % 8 AS c, px[p + 1] AS v FROM t, range(64) x(p)),
f1 AS (SELECT tile_id, r, u AS q, sum(v * co) AS re, sum(v * si) AS im FROM px JOIN w ON x = c GROUP BY ALL),
f2 AS (SELECT tile_id, u AS p, q, sum(re * co - im * si) AS re, sum(re * si + im * co) AS im FROM f1 JOIN w ON x = r GROUP BY ALL),
cr AS (SELECT {KEYS}, a.p, a.q, a.re * b.re + a.im * b.im AS re, a.im * b.re - a.re * b.im AS im FROM pairs JOIN f2 a ON a.tile_id = prev JOIN f2 b ON b.tile_id = cur AND a.p = b.p AND a.q = b.q),
un AS (SELECT {KEYS}, p, q, CASE WHEN re = 0 AND im = 0 THEN 1 ELSE re / sqrt(re * re + im * im) END AS re, CASE WHEN re = 0 AND im = 0 THEN 0 ELSE im / sqrt(re * re + im * im) END AS im FROM cr),
g1 AS (SELECT {KEYS}, p, x AS c, sum(re * co + im * si) AS re, sum(im * co - re * si) AS im FROM un JOIN w ON u = q GROUP BY ALL),
g2 AS (SELECT {KEYS}, x AS r, c, round(sum(re * co + im * si) / 64, 9) AS v FROM g1 JOIN w ON u = p GROUP BY ALL),
pk AS (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY v DESC, c, r) AS peak FROM g2 QUALIFY peak <= 2),
b4 AS (SELECT {KEYS}, peak, o, CASE WHEN o % 2 = 0 THEN c ELSE 8 - c END AS x, CASE WHEN o < 2 THEN r ELSE 8 - r END AS y FROM pk, range(4) z(o)),
b8 AS (SELECT * FROM b4 UNION ALL SELECT {KEYS}, peak, o + 4, CASE WHEN direction = 'north' THEN -x ELSE x END, CASE WHEN direction = 'north' THEN y ELSE -y END FROM b4),
ov AS (SELECT {KEYS}, peak, o, x, y, pa[r * 8 + c + 1] AS a, pb[(r - y) * 8 + c - x + 1] AS b FROM b8 JOIN pairs USING ({KEYS}), range(8) m(r), range(8) n(c)
  WHERE r - y BETWEEN 0 AND 7 AND c - x BETWEEN 0 AND 7),
cc AS (SELECT {KEYS}, peak, o, count(*) AS n, corr(a, b) AS k, stddev_pop(a) * stddev_pop(b) * count(*) AS spread FROM ov GROUP BY ALL),
al AS (SELECT b8.*, CASE WHEN n >= 2 AND spread > 1e-12 THEN round(k, 9) ELSE -1 END AS ncc FROM b8 LEFT JOIN cc USING ({KEYS}, peak, o)),
be AS (SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY {KEYS} ORDER BY ncc DESC, peak, o) = 1)
SELECT {KEYS}, x::INT AS tx, y::INT AS ty, round(ncc, 6) AS ncc FROM be
"""
AROUND = "range(-1, 2) dy(y), range(-1, 2) dx(x)"
CLAMP = "least(greatest(r + y, 0), 7) * 8 + least(greatest(c + x, 0), 7) + 1"
GRAD_X = "(v[r * 8 + least(c + 1, 7) + 1] - v[r * 8 + greatest(c - 1, 0) + 1]) / (least(c + 1, 7) - greatest(c - 1, 0))"
GRAD_Y = "(v[least(r + 1, 7) * 8 + c + 1] - v[greatest(r - 1, 0) * 8 + c + 1]) / (least(r + 1, 7) - greatest(r - 1, 0))"


def grown(name: str, source: str, column: str, formula: str) -> str:
    """SQL of a CTE that adds to tiles an array made of a formula at each place (r, c) of the array v = column."""
    return f"{name} AS (SELECT {source}.*, q.x AS {column} FROM {source} JOIN (SELECT tile_id, list({formula} ORDER BY r, c) AS x FROM {source}, range(8) a(r), range(8) b(c) GROUP BY tile_id) q USING (tile_id))"


box = lambda v: f"list_sum([{', '.join(f'{v}[least(greatest(r + {y}, 0), 7) * 8 + least(greatest(c + {x}, 0), 7) + 1]' for y in (-1, 0, 1) for x in (-1, 0, 1))}])"
along = lambda formula, v: formula.replace("v[", f"{v}[")
at = lambda v: f"{v}[r * 8 + c + 1]"
ring = ", ".join(f"px[least(greatest(r + {y}, 0), 7) * 8 + least(greatest(c + {x}, 0), 7) + 1] - {at('px')}" for x, y in detect.RING)
side = lambda sign: f"CASE WHEN len(list_filter(range(16), lambda i: len(list_filter(range(9), lambda k: {sign} * d[(i + k) % 16 + 1] > 0.1)) = 9)) > 0 THEN coalesce(list_sum(list_transform(list_filter(d, lambda z: {sign} * z > 0.1), lambda z: abs(z) - 0.1::DOUBLE)), 0) ELSE 0 END"
RESPONSES = f"""
WITH {TILES},
{grown('s1', 't', 'gx', along(GRAD_X, 'px'))}, {grown('s2', 's1', 'gy', along(GRAD_Y, 'px'))}, {grown('s3', 's2', 'sm', box('px') + ' / 9')},
{grown('s4', 's3', 'sx', along(GRAD_X, 'sm'))}, {grown('s5', 's4', 'sy', along(GRAD_Y, 'sm'))},
l AS (SELECT tile_id, r::INT AS r, c::INT AS c, {box('list_transform(gx, lambda z: z * z)')} AS xx, {box('list_transform(gy, lambda z: z * z)')} AS yy, {box('list_transform(list_zip(gx, gy), lambda z: z[1] * z[2])')} AS xy,
  {along(GRAD_X, 'sx')} AS hxx, {along(GRAD_Y, 'sy')} AS hyy, {along(GRAD_X, 'sy')} AS hxy, [{ring}] AS d FROM s5, range(8) a(r), range(8) b(c)),
rs AS (SELECT tile_id, r, c, xx * yy - xy * xy - 0.04::DOUBLE * (xx + yy) ** 2 AS harris, (xx + yy) / 2 - sqrt(((xx - yy) / 2) ** 2 + xy * xy) AS min_eigen,
  hxx * hyy - (0.9::DOUBLE * hxy) ** 2 AS hessian, greatest({side('1')}, {side('-1')}) AS fast FROM l)
"""
SQL["detector_responses"] = RESPONSES + "SELECT tile_id, r, c, round(harris, 6) + 0.0 AS harris, round(min_eigen, 6) + 0.0 AS min_eigen, round(hessian, 6) + 0.0 AS hessian, round(fast, 6) + 0.0 AS fast FROM rs"
# points are taken best first, each unless one within a pixel stands already: a fold over the tile's sorted points
for m in ("harris", "min_eigen", "hessian", "fast"):
    SQL[f"keypoints_{m}"] = RESPONSES + f""",
pt AS (SELECT tile_id, list([{{'x': c, 'y': r, 's': {m}}}] ORDER BY {m} DESC, r, c) AS pts FROM rs WHERE {m} > 0 GROUP BY tile_id),
kp AS (SELECT tile_id, list_reduce(pts, lambda acc, q: CASE WHEN len(list_filter(acc, lambda z: abs(z.x - q[1].x) <= 1 AND abs(z.y - q[1].y) <= 1)) > 0 THEN acc ELSE acc || q END) AS kept FROM pt),
k AS (SELECT tile_id, n::INT AS kp_id, kept[n + 1].x AS x, kept[n + 1].y AS y, kept[n + 1].s AS s FROM (SELECT tile_id, kept, unnest(range(len(kept))) AS n FROM kp)),
w AS (SELECT k.*, list_transform(range(49), lambda i: px[least(greatest(y + i // 7 - 3, 0), 7) * 8 + least(greatest(x + i % 7 - 3, 0), 7) + 1]) AS v FROM k JOIN t USING (tile_id)),
u AS (SELECT *, list_transform(v, lambda z: z - list_avg(v)) AS d FROM w), f AS (SELECT *, sqrt(list_inner_product(d, d)) AS len FROM u)
SELECT tile_id, kp_id, x::DOUBLE AS x, y::DOUBLE AS y, round(s, 6) + 0.0 AS score, round(d[1] / len, 6) + 0.0 AS d_first, round(d[25] / len, 6) + 0.0 AS d_centre, round(d[49] / len, 6) + 0.0 AS d_last FROM f"""
queries_register.add_sql(SQL)
for part in (queries_pixels, queries_geometry, queries_features, queries_warp, queries_register, queries_detect, queries_sources, queries_models):
    QUERIES |= part.QUERIES
    SQL |= part.SQL
# the same points by a table function
SQL["lateral_keypoints"] = f"SELECT tile_id, kp_id, x, y, score FROM ({SQL['keypoints_harris']})"
