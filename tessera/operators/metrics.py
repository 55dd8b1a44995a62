"""Measures of two overlapping regions, as aggregates of rows with values a and b.

Nulls and ties: failures are NULL or the stated value, never NaN; rows with a null value count in no measure of it; an empty region has no row; repeated rows count each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rmse() -> Column:
    return F.sqrt(F.avg(F.pow(F.col("b") - F.col("a"), 2)))


def ncc() -> Column:
    """Correlation; -1 where it is undefined."""
    return F.coalesce(F.try_divide(F.covar_pop("a", "b"), F.stddev_pop("a") * F.stddev_pop("b")), F.lit(-1.0))


def ssim_moments() -> list[Column]:
    """The aggregates of rows with values a and b that ssim_of() needs."""
    return [F.max("a").alias("ma"), F.max("b").alias("mb"), F.avg("a").alias("ua"), F.avg("b").alias("ub"), F.var_samp("a").alias("va"), F.var_samp("b").alias("vb"), F.covar_samp("a", "b").alias("cab")]


def ssim_of() -> Column:
    """Similarity without constants, each region divided by its own maximum, sample moments; null where it is undefined."""
    part = lambda x, y: F.try_divide(F.col(x), y)
    a, b = part("ua", F.col("ma")), part("ub", F.col("mb"))
    va, vb, cab = part("va", F.col("ma") ** 2), part("vb", F.col("mb") ** 2), part("cab", F.col("ma") * F.col("mb"))
    return F.try_divide(4 * a * b * cab, (a * a + b * b) * (va + vb))


def global_ssim(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ssim)"""
    return rows.groupBy(*keys).agg(*ssim_moments()).select(*keys, ssim_of().alias("ssim"))


def nmi(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, nmi) of integer grey values a and b: 2 I / (H(a) + H(b)), from the joint counts; marginals are windows over them."""
    joint = rows.groupBy(*keys, "a", "b").agg(F.count(F.lit(1)).alias("n"))
    every, by_a, by_b = (Window.partitionBy(*keys, *x) for x in ([], ["a"], ["b"]))
    joint = joint.withColumn("t", F.sum("n").over(every)).withColumn("na", F.sum("n").over(by_a)).withColumn("nb", F.sum("n").over(by_b))
    p, pa, pb = (F.col(x) / F.col("t") for x in ("n", "na", "nb"))
    share = F.col("n") / F.col("na") * F.log2(pa)
    other = F.col("n") / F.col("nb") * F.log2(pb)
    sums = joint.groupBy(*keys).agg(F.sum(p * F.log2(p)).alias("hab"), F.sum(F.col("na") / F.col("t") * share).alias("ha"), F.sum(F.col("nb") / F.col("t") * other).alias("hb"))
    return sums.select(*keys, F.try_divide(2 * (F.col("ha") + F.col("hb") - F.col("hab")), F.col("ha") + F.col("hb")).alias("nmi"))


def mean_of_means(rows: DataFrame, keys: list[str], direction: str, values: list[str]) -> DataFrame:
    """Unweighted mean of the directions' means; NULLs are left out."""
    per = rows.groupBy(*keys, direction).agg(*(F.avg(v).alias(v) for v in values))
    return per.groupBy(*keys).agg(*(F.avg(v).alias(f"average_{v}") for v in values))
