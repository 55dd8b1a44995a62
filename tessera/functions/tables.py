"""Table functions that SQL text can call beside a table, with LATERAL: a row of pixels in, a row for each keypoint out.

Nulls: null or broken pixels, sizes or bounds give no rows; an unknown method is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from tessera.operators import detect


@udtf(returnType="kp_id int, x double, y double, score double, size double, angle double, descriptor array<double>, bits array<bigint>")
class DetectPoints:
    """detect_points(pixels, height, width, method, least): keypoints of one image, best first."""

    def eval(self, pixels: list, height: int, width: int, method: str, least: float) -> Iterator[tuple]:
        if method not in detect.NAMES():
            raise ValueError(f"unknown method {method!r}; there are {', '.join(detect.NAMES())}")
        if pixels is None or height is None or width is None or least is None or len(pixels) != height * width or any(v is None for v in pixels):
            return
        p = detect.points_of(np.asarray(pixels, float).reshape(height, width), method, least=float(least))
        numbers = (np.round(c, 6).tolist() for c in (p.score, p.size, p.angle))
        for n, row in enumerate(zip(p.x.tolist(), p.y.tolist(), *numbers, p.f.tolist(), p.bits.tolist(), strict=True)):
            yield n, *row


def register(spark: SparkSession) -> None:
    """Make the table functions known to SQL in this session."""
    spark.udtf.register("detect_points", DetectPoints)
