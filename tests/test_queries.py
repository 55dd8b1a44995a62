"""Queries beside their SQL on tables of odd sizes."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.operators import cluster, geometry, heads, matching, parts, robust, warp
from tessera.sources import tiff


def rows(found) -> list[tuple]:
    return sorted(tuple(None if v is None else round(v, 7) if isinstance(v, float) else v for v in row) for row in found)


def beside_sql(spark, folder, name: str) -> None:
    df = entry.queries()[name](spark, str(folder))
    db = duckdb.connect()
    for f in folder.iterdir():
        db.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}/*.parquet')")
    db.execute(entry.oracle_sql()[name])
    wanted = db.fetchall()
    names = [c[0] for c in db.description]
    assert rows(map(tuple, df.select(*names).collect())) == rows(wanted) != []


@pytest.fixture
def torn(spark, tmp_path):
    """Tiles whose last row of the grid ends within a block."""
    values = "transform(sequence(0, 63), q -> CAST(pmod(xxhash64(id, q), 2001) / 2000 - 0.5 AS FLOAT))"
    spark.range(256).selectExpr("id AS vec_id", f"{values} AS embedding", "CAST(id % 3 AS INT) AS label").write.parquet(f"{tmp_path}/embeddings.parquet")
    return tmp_path


@pytest.mark.parametrize("name", ["composed_tiles", "batch_patches"])
def test_blocks_that_a_row_of_tiles_ends_in(spark, torn, name):
    beside_sql(spark, torn, name)


def test_nearest_clusters_measure_as_sql_does(spark):
    """Centres that are 85 / 9 away by either square, which a plain root and hypot() round to different orders."""
    centres = spark.createDataFrame([(0, 0, 3.6666666666666665, 0.0), (0, 2, 6.0, 2.0), (0, 3, 3.0, 3.0)], "tile_id long, cluster int, x double, y double")
    wanted = duckdb.sql("SELECT arg_min(b, sqrt((3.6666666666666665::DOUBLE - x) ** 2 + (0.0::DOUBLE - y) ** 2)) FROM (VALUES (2, 6.0::DOUBLE, 2.0::DOUBLE), (3, 3.0, 3.0)) v(b, x, y)").fetchall()
    found = {r.cluster: r.nearest for r in cluster.nearest_clusters(centres).collect()}
    assert found[0] == wanted[0][0] == 3


def test_a_kernel_holds_few_tiles_at_once():
    """The largest frame that the detectors hand on doesn't grow with the batch."""
    batch = pd.DataFrame({"tile_id": range(3000), "pixels": [np.arange(64.0) % 7] * 3000})
    sizes = [len(p) for p in parts.parts(iter([batch, batch.iloc[:0], batch.iloc[:10]]))]
    assert sum(sizes) == 3010 and max(sizes) == parts.ROWS


def test_matches_are_handed_on_in_parts(spark):
    """Pairs beyond one part keep their keys, ids and distances."""
    side = lambda n: spark.range(700).selectExpr("id AS i", "explode(sequence(0, 3)) AS k").selectExpr("i", f"k AS kp{n}", f"array(CAST(i + 10 * k + {n} / 8 AS DOUBLE), 1.0D) AS f{n}")
    found = matching.nearest(side(1), side(2), ["i"]).collect()
    assert sorted((r.i, r.kp1, r.kp2, r.d2) for r in found) == [(i, k, k, 0.015625) for i in range(700) for k in range(4)]


def test_a_projective_fit_makes_no_matrix_of_all_matches(monkeypatch):
    p = np.random.default_rng(1).random((20000, 2)) * 50
    shapes, svd = [], np.linalg.svd

    def seen(a, full_matrices=True):
        if full_matrices and len(a) > 9:
            raise MemoryError("rows times rows")
        shapes.append(a.shape)
        return svd(a, full_matrices=full_matrices)

    monkeypatch.setattr(np.linalg, "svd", seen)
    assert np.allclose(geometry.projective(p, p * 2 + 1), [[2, 0, 1], [0, 2, 1], [0, 0, 1]], atol=1e-9) and shapes
    assert np.allclose(geometry.projective(p[:4], p[:4] * 2 + 1), [[2, 0, 1], [0, 2, 1], [0, 0, 1]], atol=1e-6)


def test_triples_are_drawn_once_for_groups_of_a_size():
    robust.drawn_triples.cache_clear()
    p = np.random.default_rng(2).random((50, 2)) * 50
    for _ in range(3):
        m, inside = robust.affine_inliers(p, p + [3.0, 4.0])
        assert inside.all() and np.allclose(m, [[1, 0, 3], [0, 1, 4]])
    wanted = np.argsort(np.random.default_rng(0).random((512, 50)), axis=1)[:, :3]
    assert robust.drawn_triples.cache_info().misses == 1 and (robust.drawn_triples(50, 512, 0) == wanted).all()


def test_points_carry_no_vectors(spark):
    """The vectors of the map travel with its cells: no shuffle or grouping by points."""
    points = spark.createDataFrame([(0, 1, 8.0, 8.0), (0, 2, 0.0, 0.0), (0, 3, 99.0, 99.0)], "tile_id int, kp_id int, x double, y double")
    coarse = spark.createDataFrame([(0, i, j, [float(i + 1), float(j)]) for i in (0, 1) for j in (0, 1)], "tile_id int, i int, j int, vector array<double>")
    out = heads.sampled_descriptors(points, coarse, 16, 16, 2, 2)
    assert "kp_id" not in "".join(line for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Aggregate" in line or "hashpartitioning" in line and "kp_id" in line.split("hashpartitioning")[1])
    found = {r.kp_id: r.descriptor for r in out.collect()}
    assert found.keys() == {1, 2} and np.allclose(found[1], np.array([1.5, 0.5]) / np.hypot(1.5, 0.5)) and np.allclose(found[2], [1, 0])


def test_a_field_groups_no_pixels(spark):
    """density_field() is what field() makes of density_weights(), without a grouping by pixels; maps for a tile, for all, with nulls and for clusters that aren't there."""
    pixels = spark.range(3).selectExpr("id AS tile_id", "explode(sequence(0, 5)) AS r").selectExpr("tile_id", "r", "explode(sequence(0, 6)) AS c")
    points = spark.range(3).selectExpr("id AS tile_id", "explode(sequence(0, 11)) AS kp").selectExpr("tile_id", "kp", "kp % 3 AS cluster", "CAST(kp * 7 % 6 AS DOUBLE) AS x", "CAST(kp * 5 % 7 + tile_id AS DOUBLE) AS y")
    names = "m00 double, m01 double, m02 double, m10 double, m11 double, m12 double"
    for_all = spark.createDataFrame([(0, 1.1, 0.1, 2.0, 0.2, 0.9, 1.0), (2, 0.8, 0.0, 1.0, None, 1.2, 0.0), (9, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)], f"cluster int, {names}")
    of_tiles = for_all.selectExpr("CAST(cluster AS BIGINT) % 2 AS tile_id", "*")
    for maps in (for_all, of_tiles):
        wanted = warp.field(cluster.density_weights(pixels, points, 3), maps).collect()
        out = cluster.density_field(pixels, points, maps, 3)
        assert rows(map(tuple, out.collect())) == rows(map(tuple, wanted)) != []
        assert "keys=[tile_id" not in out._jdf.queryExecution().executedPlan().toString().split("MapInPandas")[0]


def test_pages_are_handed_on_together(spark):
    tiles = spark.range(300).selectExpr("CAST(id AS STRING) AS path", "4 AS height", "5 AS width", "transform(sequence(1, 20), q -> (q + id) % 3 / 2D) AS pixels").coalesce(1)
    files = tiff.encoded(tiles).coalesce(1)
    sizes = tiff.decoded(files).selectExpr("path", "size(pixels) AS n", "status").collect()
    assert len(sizes) == 300 and {(r.n, r.status) for r in sizes} == {(20, "ok")} and tiff.HELD > 0


def test_small_groups_of_shifts_against_columns(spark):
    """What all_pairs() finds is what the hypotheses as columns give, with repeated numbers and equal shifts; groups of one and beyond the trials keep their way."""
    matches = spark.range(60).selectExpr("id AS g", "explode(sequence(0, CAST(id % 9 AS INT))) AS q").selectExpr("g", "CAST(q - q % 2 AS INT) AS m", "CAST(q AS DOUBLE) AS x1", "0D AS y1", "q + CAST(pmod(xxhash64(g, q), 4) AS DOUBLE) / 3 AS x2", "CAST(pmod(xxhash64(q, g), 3) AS DOUBLE) AS y2")
    for trials in (2000, 10):
        fast = robust.ransac_shift(matches, ["g"], trials=trials)
        slow = robust.ransac_shift(matches, ["g"], trials=trials, valid=lambda h: F.lit(True))
        assert rows(map(tuple, fast.collect())) == rows(map(tuple, slow.collect())) != []
        assert "ArrowEvalPython" in fast._jdf.queryExecution().executedPlan().toString()
