"""Structural similarity in Gaussian windows, as sums over arrays within each pair's row.

Nulls and odd sizes: a pair whose pixel array is null, shorter than height * width or holds a null has null similarity; windows lie wholly inside; a
window larger than the tile is cut to its smaller side; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def window_weights(size: int, sigma: float = 1.5) -> list[float]:
    g = [math.exp(-((x - size // 2) ** 2) / (2 * sigma * sigma)) for x in range(size)]
    return [x / sum(g) for x in g]


def value_range(px: Column) -> Column:
    """255 or 1 for the top, by whether any value is over 128; -1 or 0 for the bottom, by whether any is under -0.5."""
    return F.when(F.array_max(px) > 128, 255.0).otherwise(1.0) - F.when(F.array_min(px) < -0.5, -1.0).otherwise(0.0)


def windowed_ssim(pairs: DataFrame, height: int, width: int, keys: list[str], *, window: int = 11, span: float | None = None) -> DataFrame:
    """(keys, ssim, cs): means over all windows of the similarity and of its contrast part, of pixel arrays pa and pb. span: the range of values, else told from pa."""
    size = min(window, height, width)
    g = window_weights(size)
    weights = F.array(*(F.lit(a * b) for a in g for b in g))
    places = F.sequence(F.lit(0), F.lit(size * size - 1))
    across = width - size + 1
    spots = F.explode(F.sequence(F.lit(0), F.lit((height - size + 1) * across - 1))).alias("at")
    span_of = F.lit(float(span)) if span is not None else value_range(F.col("pa"))
    whole = (F.size("pa") == height * width) & (F.size("pb") == height * width)
    rows = pairs.select(*keys, F.when(whole, F.col("pa")).alias("pa"), F.when(whole, F.col("pb")).alias("pb")).select("*", span_of.alias("span"), weights.alias("w"), spots)
    start = F.floor(F.col("at") / across) * width + F.col("at") % across
    pick = lambda px, k: F.get(px, (start + F.floor(k / size) * width + k % size).cast("int"))
    cut = F.transform(places, lambda k: F.struct(F.get("w", k).alias("w"), pick("pa", k).alias("a"), pick("pb", k).alias("b")))
    rows = rows.select(*keys, "span", cut.alias("x"))
    total = lambda of: F.aggregate("x", F.lit(0.0), lambda t, x: t + x["w"] * of(x))
    rows = rows.select(*keys, "span", total(lambda x: x["a"]).alias("ma"), total(lambda x: x["b"]).alias("mb"), total(lambda x: x["a"] * x["a"]).alias("aa"), total(lambda x: x["b"] * x["b"]).alias("bb"), total(lambda x: x["a"] * x["b"]).alias("ab"))
    ma, mb = F.col("ma"), F.col("mb")
    c1, c2 = F.pow(0.01 * F.col("span"), F.lit(2.0)), F.pow(0.03 * F.col("span"), F.lit(2.0))
    v1, v2 = 2 * (F.col("ab") - ma * mb) + c2, F.col("aa") - ma * ma + F.col("bb") - mb * mb + c2
    one = ((2 * ma * mb + c1) * v1) / ((ma * ma + mb * mb + c1) * v2)
    return rows.groupBy(*keys).agg(F.avg(one).alias("ssim"), F.avg(v1 / v2).alias("cs"))
