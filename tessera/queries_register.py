"""Queries of grids, catalogues and registration end to end, with SQL for each. Tiles are the 64 numbers of `embeddings` as 8 x 8 pixels, in grids 25 wide."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import register as R
from tessera.plans import overlap as O
from tessera.queries_features import KEYS, PAIRS, SQL as FEATURES, TILES  # noqa: F401
from tessera.sources import images

WIDTH, SIZE = 25, 8


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) + 0.0 for c in columns})


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    named = e.select(F.lit("embeddings").alias("dataset"), F.col("vec_id").alias("tile_id"), F.col("vec_id").alias("seq"), F.col("embedding").cast("array<double>").alias("pixels"))
    return O.grid(named, WIDTH)


def grid_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of a flipped grid, as many rows high as there are, and their numbers either way round."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("tile_id"), F.col("vec_id").alias("seq"))
    height = math.ceil(e.count() / WIDTH)
    return O.numbered(O.grid(e, WIDTH, height=height, flipped=True), height, WIDTH).select("tile_id", "i", "j", "index_im", "row_major", "column_major")


def catalogue_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as data sets: grids, thresholds by kind of image, tiles and pairs."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    kinds = F.array(*map(F.lit, ("bright", "phase", "fluorescence", "other")))
    catalogue = part.select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("dataset"), (F.col("p_size") % 7).alias("htile"), (F.col("p_size") % 5).alias("vtile"), F.get(kinds, (F.col("p_partkey") % 4).cast("int")).alias("kind"))
    catalogue = images.grid_counts(catalogue).withColumn("threshold", images.detector_threshold(F.col("kind")))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_partkey").alias("dataset")).agg(F.count(F.lit(1)).alias("n_lines"))
    return images.with_parameters(lines, catalogue.drop("brand"))


def registered(spark: SparkSession, sf_dir: str, method: str, **how) -> DataFrame:
    return R.register(tiles(spark, sf_dir), SIZE, SIZE, method, **how)


def register_ncc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = registered(spark, sf_dir, "ncc", overlap=0.5)
    return rounded(out.select(*R.KEYS, "method", "tx", "ty", "ncc", "status", "rmse", "ssim"), "rmse", "ssim")


def register_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = registered(spark, sf_dir, "phase")
    return rounded(out.select(*R.KEYS, "method", "tx", "ty", "ncc", "status", "rmse", "ssim"), "rmse", "ssim")


def register_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners of whole tiles, and of the halves that neighbours share, as two data sets whose tiles are numbered alike."""
    whole = registered(spark, sf_dir, "min_eigen", overlap=None, least=1e-4).drop("ncc")
    both = tiles(spark, sf_dir).withColumn("dataset", F.explode(F.array(F.lit("embeddings"), F.lit("turned"))))
    both = both.withColumn("pixels", F.when(F.col("dataset") == "turned", F.reverse("pixels")).otherwise(F.col("pixels")))
    halves = R.register(both, SIZE, SIZE, "min_eigen", overlap=0.5, least=1e-4).drop("ncc")
    out = whole.withColumn("region", F.lit("whole")).unionByName(halves.withColumn("region", F.lit("half")))
    return rounded(out, "tx", "ty", "error", "rmse", "ssim")


def register_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.summary(registered(spark, sf_dir, "ncc", overlap=0.5)), "average_rmse", "average_ssim")


QUERIES = {f.__name__: f for f in (grid_indexes, catalogue_parameters, register_ncc, register_phase, register_features, register_summary)}


def measured(shifts: str) -> str:
    """SQL of a CTE chain ending in `ms`: rmse and ssim of the overlap under the shifts (tx, ty) of a query of pairs."""
    return f"""
sh AS ({shifts}),
ox AS (SELECT {KEYS}, pa[r * 8 + c + 1] AS a, pb[(r - ty) * 8 + c - tx + 1] AS b FROM sh JOIN pairs USING ({KEYS}), range(8) y(r), range(8) z(c) WHERE r - ty BETWEEN 0 AND 7 AND c - tx BETWEEN 0 AND 7),
om AS (SELECT {KEYS}, count(*) AS n, sqrt(avg((b - a) ** 2)) AS rmse, max(a) AS ma, max(b) AS mb, avg(a) AS ua, avg(b) AS ub, var_samp(a) AS va, var_samp(b) AS vb, covar_samp(a, b) AS cab FROM ox GROUP BY {KEYS}),
os AS (SELECT *, ua / ma AS x, ub / mb AS y, va / ma ** 2 AS vx, vb / mb ** 2 AS vy, cab / (ma * mb) AS cxy FROM om WHERE n > 1),
ms AS (SELECT {KEYS}, rmse, CASE WHEN ma <> 0 AND mb <> 0 AND (x * x + y * y) * (vx + vy) <> 0 THEN 4 * x * y * cxy / ((x * x + y * y) * (vx + vy)) END AS ssim FROM os)"""


SQL: dict[str, str] = {}
SQL["grid_indexes"] = """
WITH h AS (SELECT ceil(count(*) / 25)::INT AS h FROM embeddings), g AS (SELECT vec_id AS tile_id, (h - 1 - vec_id // 25)::INT AS i, (vec_id % 25)::INT AS j, h FROM embeddings, h)
SELECT tile_id, i, j, i * 25 + j + 1 AS index_im, i * 25 + j AS row_major, j * h + i AS column_major FROM g
"""
SQL["catalogue_parameters"] = """
WITH l AS (SELECT l_partkey AS dataset, count(*) AS n_lines FROM lineitem GROUP BY 1), c AS (SELECT p_partkey AS dataset, p_size % 7 AS htile, p_size % 5 AS vtile, ['bright', 'phase', 'fluorescence', 'other'][p_partkey % 4 + 1] AS kind FROM part)
SELECT dataset, n_lines, htile, vtile, kind, htile * vtile AS n_tiles, greatest(vtile - 1, 0) * htile + vtile * greatest(htile - 1, 0) AS n_pairs,
  CASE kind WHEN 'bright' THEN 1000 WHEN 'phase' THEN 1 WHEN 'fluorescence' THEN 0.1 END::DOUBLE AS threshold FROM l LEFT JOIN c USING (dataset)
"""


def correlation_sql(name: str, aligned: str) -> str:
    return f"""
WITH {TILES}, {PAIRS}, {measured(f"SELECT * FROM ({aligned})")}
SELECT 'embeddings' AS dataset, {KEYS}, '{name}' AS method, tx::DOUBLE AS tx, ty::DOUBLE AS ty, ncc, 0 AS status, round(rmse, 6) + 0.0 AS rmse, round(ssim, 6) + 0.0 AS ssim FROM sh LEFT JOIN ms USING ({KEYS})"""


def add_sql(aligned: dict[str, str]) -> None:
    """The SQL that builds on that of the alignments."""
    for name in ("ncc", "phase"):
        SQL[f"register_{name}"] = correlation_sql(name, aligned[f"align_{name}"])
    SQL["register_summary"] = f"""
WITH r AS ({SQL['register_ncc'].replace("round(rmse, 6) + 0.0 AS rmse, round(ssim, 6) + 0.0 AS ssim", "rmse, ssim")}),
d AS (SELECT dataset, method, direction, avg(rmse) AS rmse, avg(ssim) AS ssim FROM r GROUP BY ALL), a AS (SELECT dataset, method, avg(rmse) AS rmse, avg(ssim) AS ssim FROM d GROUP BY ALL),
n AS (SELECT dataset, method, count(*) AS n_pairs, count(*) FILTER (status <> 0) AS n_failed FROM r GROUP BY ALL)
SELECT dataset, method, n_pairs, n_failed, round(rmse, 6) + 0.0 AS average_rmse, round(ssim, 6) + 0.0 AS average_ssim FROM n JOIN a USING (dataset, method)"""
