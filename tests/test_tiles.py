import glob
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import queries
from tessera.functions.natural import natural_key, path_key
from tessera.operators import detect, matching, metrics, robust, spectral
from tessera.plans import overlap

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    mine, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.SQL[name]).df()
    columns = sorted(mine.columns)
    assert columns == sorted(want.columns)

    def rows(df):
        df = df[columns].astype(object)
        return sorted("|".join(map(str, x)) for x in df.where(df.notna(), None).itertuples(index=False, name=None))

    assert [x for x in zip(rows(mine), rows(want), strict=True) if x[0] != x[1]] == []


def plane(h, w):
    r, c = np.mgrid[:h, :w]
    return (r * r * 31 + c * c * 17 + r * c * 7) % 251 / 251


def test_natural_order(spark):
    given = ["x2", "x10", "x1", "X3b", "x", None, "12", "a1.5"]
    df = spark.createDataFrame([(x,) for x in given], "s string")
    assert [r.s for r in df.orderBy(natural_key(F.col("s"))).collect()] == [None, "12", "a1.5", "x", "x1", "x2", "X3b", "x10"]
    paths = ["d10/a2.tif", "d2/a10.tif", "d2/a2.tif", "d2/a1.jpg"]
    df = spark.createDataFrame([(x,) for x in paths], "s string")
    assert [r.s for r in df.orderBy(path_key(F.col("s"))).collect()] == ["d2/a1.jpg", "d2/a2.tif", "d10/a2.tif", "d2/a10.tif"]


@pytest.mark.parametrize(("direction", "dx", "dy"), [("west", 20, 1), ("west", 18, 0), ("north", 0, 22), ("north", 2, 19)])
def test_phase_finds_a_known_shift(direction, dx, dy):
    image = np.random.default_rng(1).random((70, 70))
    a, b = image[:32, :32], image[dy : dy + 32, dx : dx + 32]
    assert spectral.pciam(a, b, direction, peaks=4)[:2] == (dx, dy)


def test_normxcorr_against_loops():
    r = np.random.default_rng(2)
    t, s = r.random((3, 4)), r.random((6, 9))
    s[0:3, 0:4] = 0.5
    got = spectral.normxcorr2(t, s)
    for i in range(4):
        for j in range(6):
            v = s[i : i + 3, j : j + 4]
            want = 0.0 if v.std() < 1e-9 else np.corrcoef(t.ravel(), v.ravel())[0, 1]
            assert got[i, j] == pytest.approx(want, abs=1e-9)
    assert np.allclose(spectral.normxcorr2(t, 3 * s + 2), got, atol=1e-9)


def test_undefined_correlation():
    flat = np.full((4, 4), 0.5)
    assert spectral.overlap_ncc(flat, flat, 1, 1) == -1.0 and spectral.overlap_ncc(flat, flat, 4, 0) == -1.0


def test_suppression_keeps_the_best():
    points, scores = np.array([[0, 0], [1, 1], [9, 9], [10, 9]]), np.array([1.0, 2.0, 5.0, 5.0])
    assert detect.suppress(points, scores, 4).tolist() == [2, 1]


def test_detectors_find_corners(spark):
    v = np.zeros((16, 16))
    v[5:11, 5:11] = 1.0
    tile = spark.createDataFrame([(1, v.ravel().tolist()), (2, [0.5] * 256)], "tile_id bigint, pixels array<double>")
    for method in ("harris", "min_eigen"):
        found = detect.detect(tile, 16, 16, method, least=1e-6, radius=2, most=4).collect()
        assert {r.tile_id for r in found} == {1}
        for corner in ((5, 5), (5, 10), (10, 5), (10, 10)):
            assert min(max(abs(r.x - corner[0]), abs(r.y - corner[1])) for r in found) <= 1


def test_robust_shift_with_outliers(spark):
    rows = [(1, m, float(m), 0.0, float(m + 7), 3.0) for m in range(6)] + [(1, 6 + m, 0.0, 0.0, 50.0 * (m + 1), -9.0 * m) for m in range(3)] + [(2, 0, 0.0, 0.0, 1.0, 1.0)]
    matches = spark.createDataFrame(rows, "k int, m int, x1 double, y1 double, x2 double, y2 double")
    for fit in (robust.msac_shift, robust.ransac_shift):
        r = fit(matches, ["k"]).where("k = 1").first()
        assert (r.tx, r.ty, r.n_match, r.n_inlier, r.status, r.error) == (7.0, 3.0, 9, 6, 0, 0.0)


def test_radius_join_against_loops(spark):
    r = np.random.default_rng(3)
    p, q = r.random((40, 2)) * 10 - 5, r.random((40, 2)) * 10 - 5
    left = spark.createDataFrame([(1, i, *map(float, x)) for i, x in enumerate(p)], "k int, a int, x1 double, y1 double")
    right = spark.createDataFrame([(1, i, *map(float, x)) for i, x in enumerate(q)], "k int, b int, x2 double, y2 double")
    got = sorted((x.a, x.b) for x in matching.within_radius(left, right, ["k"], 1.5).collect())
    assert got == [(i, j) for i in range(40) for j in range(40) if ((p[i] - q[j]) ** 2).sum() <= 1.5**2]


def test_constant_region_has_no_similarity(spark):
    rows = spark.createDataFrame([(1, 0.5, 0.5)] * 4, "k int, a double, b double")
    assert metrics.global_ssim(rows, ["k"]).first().ssim is None
    assert rows.groupBy("k").agg(metrics.ncc().alias("x")).first().x == -1.0


def test_flipped_grid(spark):
    t = spark.createDataFrame([(i, i) for i in range(6)], "tile_id int, seq int")
    got = {r.tile_id: (r.i, r.j) for r in overlap.grid(t, 3, height=2, flipped=True).collect()}
    assert got[0] == (1, 0) and got[5] == (0, 2)
