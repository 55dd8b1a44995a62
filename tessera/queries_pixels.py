"""Queries of pixels, patches, mosaics and pictures, with SQL for each. Tiles are the 64 numbers of `embeddings` as 8 x 8 pixels; their grey values are floor((v + 1) * 127.5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import pixels as P
from tessera.operators import rank
from tessera.plans import overlap as O

WIDTH, SIZE = 25, 8


def arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("tile_id"), F.col("embedding").cast("array<double>").alias("pixels"))


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.pixels(arrays(spark, sf_dir), SIZE)


def greys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values(spark, sf_dir).withColumn("v", F.floor((F.col("v") + 1) * 127.5).cast("int"))


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) + 0.0 for c in columns})


def pixel_greys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three channels (the grey value, its square's remainder and a gradient) as grey and as doubles from 0 to 1."""
    g = greys(spark, sf_dir)
    luma = P.grey(F.col("v"), F.pmod(F.col("v") * F.col("v"), F.lit(256)), (F.col("r") * 16 + F.col("c")))
    return rounded(g.withColumn("grey", luma).select("tile_id", "r", "c", "grey", P.unit(F.col("grey")).alias("unit")), "unit")


def pixel_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.stretched(values(spark, sf_dir)), "v")


def overlap_strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and mean of the strips that neighbours share, on either side."""
    a = arrays(spark, sf_dir)
    pairs = O.neighbour_pairs(O.grid(a.withColumn("seq", F.col("tile_id")), WIDTH)).select("i", "j", "direction", "prev", "cur")
    v, n = values(spark, sf_dir), F.lit(SIZE)
    parts = []
    for side, current in (("prev", False), ("cur", True)):
        rows = pairs.join(v.withColumnRenamed("tile_id", side), side).where(P.strip(F.col("r"), F.col("c"), n, n, 0.3, F.col("direction"), current))
        parts.append(rows.groupBy("i", "j", "direction").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean")).withColumn("side", F.lit(side)))
    return rounded(parts[0].unionByName(parts[1]), "mean")


def confident_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of 0.1 or more, a pixel off the border, best first within the tile."""
    v = values(spark, sf_dir).withColumnRenamed("v", "score")
    kept = rank.inside(rank.confident(v, 0.1), SIZE, SIZE, 1)
    return rounded(rank.best_first(kept, ["tile_id"]), "score")


def quota_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best three pixels of each quarter of a tile."""
    v = values(spark, sf_dir).withColumnRenamed("v", "score")
    return rounded(rank.quota(v, SIZE, SIZE, blocks=2, most=12), "score")


def resize_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.resized(arrays(spark, sf_dir), (SIZE, SIZE), (5, 11)), "v")


def resize_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.resized(arrays(spark, sf_dir), (SIZE, SIZE), (5, 11), bilinear=False), "v")


def downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.downsampled(values(spark, sf_dir), 3), "v")


def pad_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of odd number lose two rows first; all get 9 x 7 pixels."""
    v = values(spark, sf_dir).where("tile_id % 2 = 0 or r < 6")
    return rounded(P.padded(v, 9, 7), "v")


def divided(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P.patches(values(spark, sf_dir), SIZE, SIZE, 4, 1)
    return P.masked_patches(p, F.col("v") > 0.2)


def divide_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(divided(spark, sf_dir), "v")


def merge_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each patch is its pixels times (1 + its number); laid over each other in order."""
    return rounded(P.merged(divided(spark, sf_dir).withColumn("v", F.col("v") * (1 + F.col("patch")))), "v")


def merge_patches_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.merged_mean(divided(spark, sf_dir).withColumn("v", F.col("v") * (1 + F.col("patch")))), "v")


def mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = arrays(spark, sf_dir)
    return P.blocked(P.placed(values(spark, sf_dir), O.grid(a.withColumn("seq", F.col("tile_id")), WIDTH), SIZE, SIZE), 12)


def mosaic_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.block_index(mosaic(spark, sf_dir), 12)


def mosaic_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.region(mosaic(spark, sf_dir), 12, 30, 50, 40, 70), "v")


def neighbours_laid_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = greys(spark, sf_dir)
    return g.join(g.select((F.col("tile_id") + 1).alias("tile_id"), "r", "c", F.col("v").alias("w")), ["tile_id", "r", "c"])


def overlay_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours_laid_over(spark, sf_dir).select("tile_id", "r", "c", P.overlay(F.col("v"), F.col("w")).alias("v"))


def red_cyan_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours_laid_over(spark, sf_dir).select("tile_id", "r", "c", P.red_cyan(F.col("v"), F.col("w")).alias("x")).select("tile_id", "r", "c", "x.*")


def label_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grey values as labels."""
    labels = greys(spark, sf_dir).select(F.col("v").alias("label")).distinct()
    return labels.select("label", P.label_colour(F.col("label")).alias("x")).select("label", "x.*")


def paint_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of half the size are the grey values' remainders by 4."""
    g = greys(spark, sf_dir)
    labels = g.where("r < 4 and c < 4").select("tile_id", "r", "c", F.pmod("v", F.lit(4)).alias("label"))
    return P.painted(g, labels, 2.0, 0.25)


def cross_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    stack = values(spark, sf_dir).withColumn("z", F.col("tile_id").cast("int"))
    a = P.cross_section(stack, row=3, times=2).withColumn("cut", F.lit("row"))
    return rounded(a.unionByName(P.cross_section(stack, column=5).withColumn("cut", F.lit("column"))), "v")


def unique_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return greys(spark, sf_dir).select(F.col("v").alias("label")).distinct()


QUERIES = {
    f.__name__: f
    for f in (
        pixel_greys, pixel_stretch, overlap_strips, confident_points, quota_points, resize_bilinear, resize_nearest, downsample, pad_tiles, divide_patches, merge_patches, merge_patches_mean,
        mosaic_index, mosaic_region, overlay_pixels, red_cyan_pixels, label_colours, paint_labels, cross_sections, unique_labels,
    )
}

PX = "px AS (SELECT vec_id AS tile_id, (p // 8)::INT AS r, (p % 8)::INT AS c, embedding[p + 1]::DOUBLE AS v FROM embeddings, range(64) x(p))"
GREY = f"{PX}, g AS (SELECT tile_id, r, c, floor((v + 1) * 127.5)::INT AS v FROM px)"
GRID = "t AS (SELECT vec_id AS tile_id, (vec_id // 25)::INT AS i, (vec_id % 25)::INT AS j FROM embeddings)"
PAIRS = "pairs AS (SELECT a.i, a.j, 'north' AS direction, b.tile_id AS prev, a.tile_id AS cur FROM t a JOIN t b ON a.i = b.i + 1 AND a.j = b.j UNION ALL SELECT a.i, a.j, 'west', b.tile_id, a.tile_id FROM t a JOIN t b ON a.i = b.i AND a.j = b.j + 1)"
SQL: dict[str, str] = {}
SQL["pixel_greys"] = f"WITH {GREY}, l AS (SELECT tile_id, r, c, ((299 * v + 587 * ((v * v) % 256) + 114 * (r * 16 + c) + 500) // 1000)::INT AS grey FROM g) SELECT tile_id, r, c, grey, round(grey / 255, 6) + 0.0 AS unit FROM l"
SQL["pixel_stretch"] = f"WITH {PX} SELECT tile_id, r, c, round((v - min(v) OVER w) / nullif(max(v) OVER w - min(v) OVER w, 0), 6) + 0.0 AS v FROM px WINDOW w AS (PARTITION BY tile_id)"
SQL["overlap_strips"] = f"""
WITH {PX}, {GRID}, {PAIRS},
s AS (SELECT i, j, direction, 'prev' AS side, v FROM pairs JOIN px ON tile_id = prev WHERE CASE WHEN direction = 'north' THEN r >= 6 ELSE c >= 6 END
  UNION ALL SELECT i, j, direction, 'cur', v FROM pairs JOIN px ON tile_id = cur WHERE CASE WHEN direction = 'north' THEN r < 2 ELSE c < 2 END)
SELECT i, j, direction, side, count(*) AS n, round(avg(v), 6) + 0.0 AS mean FROM s GROUP BY i, j, direction, side
"""
SQL["confident_points"] = f"WITH {PX} SELECT tile_id, c AS x, r AS y, round(v, 6) + 0.0 AS score, row_number() OVER (PARTITION BY tile_id ORDER BY v DESC, r, c)::INT AS place FROM px WHERE v >= 0.1 AND r BETWEEN 1 AND 6 AND c BETWEEN 1 AND 6"
SQL["quota_points"] = f"WITH {PX} SELECT tile_id, c AS x, r AS y, round(v, 6) + 0.0 AS score FROM px QUALIFY row_number() OVER (PARTITION BY tile_id, r // 4, c // 4 ORDER BY v DESC, r, c) <= 3"
PLACES = "SELECT vec_id AS tile_id, embedding::DOUBLE[] AS px, r::INT AS r, c::INT AS c FROM embeddings, range(5) y(r), range(11) x(c)"
SQL["resize_nearest"] = f"SELECT tile_id, r, c, round(px[((r * 8) // 5) * 8 + (c * 8) // 11 + 1], 6) + 0.0 AS v FROM ({PLACES})"
SQL["resize_bilinear"] = f"""
WITH p AS ({PLACES}), q AS (SELECT *, (r + 0.5::DOUBLE) * 8 / 5 - 0.5 AS y, (c + 0.5::DOUBLE) * 8 / 11 - 0.5 AS x FROM p),
w AS (SELECT *, y - floor(y) AS dy, x - floor(x) AS dx, greatest(floor(y), 0)::INT AS r0, least(floor(y) + 1, 7)::INT AS r1, greatest(floor(x), 0)::INT AS c0, least(floor(x) + 1, 7)::INT AS c1 FROM q)
SELECT tile_id, r, c, round((1 - dy) * ((1 - dx) * px[r0 * 8 + c0 + 1] + dx * px[r0 * 8 + c1 + 1]) + dy * ((1 - dx) * px[r1 * 8 + c0 + 1] + dx * px[r1 * 8 + c1 + 1]), 6) + 0.0 AS v FROM w
"""
SQL["downsample"] = f"WITH {PX} SELECT tile_id, r // 3 AS r, c // 3 AS c, round(avg(v), 6) + 0.0 AS v FROM px GROUP BY 1, 2, 3"
SQL["pad_tiles"] = f"""
WITH {PX}, cut AS (SELECT * FROM px WHERE tile_id % 2 = 0 OR r < 6), f AS (SELECT vec_id AS tile_id, r::INT AS r, c::INT AS c FROM embeddings, range(9) y(r), range(7) x(c))
SELECT f.tile_id, f.r, f.c, round(coalesce(v, 0), 6) + 0.0 AS v FROM f LEFT JOIN cut USING (tile_id, r, c)
"""
PATCHES = f"""{PX}, s AS (SELECT * FROM (VALUES (0, 0), (1, 3), (2, 4)) x(i, s)),
pt AS (SELECT tile_id, a.i * 3 + b.i AS patch, a.s AS pr, b.s AS pc, r, c, v, max((v > 0.2)::INT) OVER (PARTITION BY tile_id, a.i, b.i) AS inside
  FROM px JOIN s a ON r >= a.s AND r < a.s + 4 JOIN s b ON c >= b.s AND c < b.s + 4)"""
SQL["divide_patches"] = f"WITH {PATCHES} SELECT tile_id, patch, pr, pc, r, c, round(v, 6) + 0.0 AS v FROM pt WHERE inside = 1"
SQL["merge_patches"] = f"""
WITH {PATCHES}, l AS (SELECT tile_id, r, c, list(v * (1 + patch) ORDER BY patch) AS x FROM pt WHERE inside = 1 GROUP BY ALL)
SELECT tile_id, r, c, round(list_reduce(list_prepend(0::DOUBLE, x), lambda a, b: CASE WHEN abs(a) > 1e-6 AND abs(b) > 1e-6 THEN 0.5::DOUBLE * a + 0.5::DOUBLE * b ELSE a + b END), 6) + 0.0 AS v FROM l
"""
SQL["merge_patches_mean"] = f"WITH {PATCHES} SELECT tile_id, r, c, round(avg(v * (1 + patch)) FILTER (abs(v * (1 + patch)) > 1e-6), 6) + 0.0 AS v FROM pt WHERE inside = 1 GROUP BY tile_id, r, c"
MOSAIC = f"{PX}, {GRID}, m AS (SELECT i * 8 + r AS r, j * 8 + c AS c, v FROM px JOIN t USING (tile_id)), b AS (SELECT *, r // 12 AS row, c // 12 AS col FROM m)"
SQL["mosaic_index"] = f"WITH {MOSAIC} SELECT row, col, col * 12 AS x_left, row * 12 AS y_top, max(r) - row * 12 + 1 AS height, max(c) - col * 12 + 1 AS width FROM b GROUP BY row, col"
SQL["mosaic_region"] = f"WITH {MOSAIC} SELECT r - 30 AS r, c - 50 AS c, round(v, 6) + 0.0 AS v FROM m WHERE r BETWEEN 30 AND 69 AND c BETWEEN 50 AND 119"
OVER = f"{GREY}, o AS (SELECT a.tile_id, a.r, a.c, a.v, b.v AS w FROM g a JOIN g b ON b.tile_id = a.tile_id - 1 AND b.r = a.r AND b.c = a.c)"
SQL["overlay_pixels"] = f"WITH {OVER} SELECT tile_id, r, c, v // 2 + w // 2 AS v FROM o"
SQL["red_cyan_pixels"] = f"WITH {OVER} SELECT tile_id, r, c, v AS red, w AS green, w AS blue FROM o"


def colours(source: str, alpha: str) -> str:
    """SQL that adds red, green and blue to rows with a label."""
    return f"""
hs AS (SELECT *, (label * 97) % 256 / 255.0::DOUBLE * 6 AS h6, (label > 0)::INT::DOUBLE AS s, (label > 0)::INT * {alpha}::DOUBLE AS val FROM {source}),
hq AS (SELECT *, floor(h6)::INT % 6 AS k, val * (1 - s) AS p, val * (1 - s * (h6 - floor(h6))) AS q, val * (1 - s * (1 - (h6 - floor(h6)))) AS u FROM hs),
hc AS (SELECT *, floor([val, q, p, p, u, val][k + 1] * 255 + 1e-9)::INT AS cr, floor([u, val, val, q, p, p][k + 1] * 255 + 1e-9)::INT AS cg, floor([p, p, u, val, val, q][k + 1] * 255 + 1e-9)::INT AS cb FROM hq)"""


SQL["label_colours"] = f"WITH {GREY}, d AS (SELECT DISTINCT v AS label FROM g), {colours('d', '1')} SELECT label, cr AS red, cg AS green, cb AS blue FROM hc"
SQL["paint_labels"] = f"""
WITH {GREY}, d AS (SELECT a.tile_id, a.r, a.c, a.v, b.v % 4 AS label FROM g a JOIN g b ON a.tile_id = b.tile_id AND b.r = a.r // 2 AND b.c = a.c // 2), {colours('d', '0.25')},
e AS (SELECT *, CASE WHEN label > 0 THEN floor(v * 0.75::DOUBLE + 1e-9)::INT ELSE v END AS under FROM hc)
SELECT tile_id, r, c, under + cr AS red, under + cg AS green, under + cb AS blue FROM e
"""
SQL["cross_sections"] = f"WITH {PX} SELECT 'row' AS cut, (tile_id * 2 + k)::INT AS z, c AS x, round(v, 6) + 0.0 AS v FROM px, range(2) y(k) WHERE r = 3 UNION ALL SELECT 'column', tile_id::INT, r, round(v, 6) + 0.0 FROM px WHERE c = 5"
SQL["unique_labels"] = f"WITH {GREY} SELECT DISTINCT v AS label FROM g"
