"""From a network's output to keypoints: heat maps, their points, and descriptors sampled from a coarse map. The network itself is not here: its weights
are not published with it.

Nulls and odd sizes: a cell whose array is null or of another length than 65 has no pixels; points outside the map sample zeros; a descriptor of length
0 is null; an empty table gives no rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import rank
from tessera.operators.detect import suppress
from tessera.operators.geometry import bound

CELL = 8


def heat_map(cells: DataFrame) -> DataFrame:
    """(tile_id, r, c, score) from (tile_id, i, j, semi: 64 places of the cell and a dustbin): a softmax over the 65 without the dustbin, each value at its own pixel."""
    total = F.aggregate("semi", F.lit(0.0), lambda t, v: t + F.exp(v)) + 1e-5
    some = cells.where(F.size("semi") == CELL * CELL + 1).select("tile_id", "i", "j", total.alias("total"), F.posexplode(F.slice("semi", 1, CELL * CELL)).alias("k", "v"))
    return some.select("tile_id", (F.col("i") * CELL + F.floor(F.col("k") / CELL)).cast("int").alias("r"), (F.col("j") * CELL + F.col("k") % CELL).cast("int").alias("c"), (F.exp("v") / F.col("total")).alias("score"))


def sampled_descriptors(points: DataFrame, coarse: DataFrame, width: int, height: int, columns: int, rows: int) -> DataFrame:
    """(tile_id, kp_id, descriptor) of points (tile_id, kp_id, x, y) in a width x height image: bilinear between the four nearest vectors of the coarse
    map (tile_id, i, j, vector) of rows x columns, zeros beyond its edge, then length 1."""
    px, py = F.col("x") * (columns / width) - 0.5, F.col("y") * (rows / height) - 0.5
    p = points.select("tile_id", "kp_id", px.alias("px"), py.alias("py")).withColumn("x0", F.floor("px").cast("int")).withColumn("y0", F.floor("py").cast("int"))
    corner = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1))))
    # a cell goes to the four places between cells that it is a corner of, where a point finds its vectors in one row; vectors travel with cells, never with points
    cells = coarse.where(F.col("i").between(0, rows - 1) & F.col("j").between(0, columns - 1)).select("tile_id", "i", "j", "vector").withColumn("o", corner)
    four = cells.groupBy("tile_id", (F.col("i") - F.col("o.b")).alias("y0"), (F.col("j") - F.col("o.a")).alias("x0")).agg(F.array_sort(F.collect_list(F.struct("i", "j", "vector"))).alias("four"))
    share = lambda x: (1 - F.abs(F.col("px") - x["j"])) * (1 - F.abs(F.col("py") - x["i"]))
    near = F.filter(F.transform("four", lambda x: F.struct(share(x).alias("w"), x["vector"].alias("vector"))), lambda x: x["w"] > 0)
    met = p.join(four, ["tile_id", "y0", "x0"]).select("tile_id", "kp_id", near.alias("near")).where(F.size("near") > 0)
    weighed = lambda x: F.transform(x["vector"], lambda v: x["w"] * v)
    total = F.aggregate(F.slice("near", F.lit(2), F.lit(3)), weighed(F.get("near", F.lit(0))), lambda t, x: F.zip_with(t, weighed(x), lambda a, b: a + b))
    length = lambda d: F.sqrt(F.aggregate(d, F.lit(0.0), lambda t, v: t + v * v))
    unit = bound(lambda d: bound(lambda d, n: F.transform(d, lambda v: F.try_divide(v, n)), d, length(d)), total)
    return met.select("tile_id", "kp_id", unit.alias("descriptor"))


def suppressed(points: DataFrame, radius: int = 4) -> DataFrame:
    """(tile_id, kp_id, x, y, score) of points (tile_id, r, c, score): best first, each unless a better one stands within radius in both axes. A tile's points meet
    in one task."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        spots, score = rows[["c", "r"]].to_numpy(int), rows["score"].to_numpy(float)
        stay = suppress(spots, score, radius)
        return pd.DataFrame({"tile_id": rows["tile_id"].iloc[0], "kp_id": range(len(stay)), "x": spots[stay, 0], "y": spots[stay, 1], "score": score[stay]})

    kind = points.schema["tile_id"].dataType.simpleString()
    return points.dropna(subset=["r", "c", "score"]).select("tile_id", "r", "c", "score").groupBy("tile_id").applyInPandas(run, f"tile_id {kind}, kp_id int, x int, y int, score double")


def heat_keypoints(cells: DataFrame, height: int, width: int, *, least: float = 0.015, radius: int = 4, border: int = 4) -> DataFrame:
    """(tile_id, kp_id, x, y, score): the points of the heat map of cells that are confident, not suppressed and off the border."""
    points = suppressed(rank.confident(heat_map(cells), least), radius)
    return points.where(F.col("x").between(border, width - border - 1) & F.col("y").between(border, height - border - 1))
