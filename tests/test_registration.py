import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.natural import natural_key
from tessera.operators import cluster, detect, elastic, geometry, pixels, register, robust, spectral, warp
from tessera.plans import overlap
from tessera.sources import images


def png(v, depth=8, filter_kind=0):
    """A grey or coloured PNG, rows with one filter."""
    v = np.asarray(v)
    v = v[..., None] if v.ndim == 2 else v
    h, w, n = v.shape
    raw = v.astype(">u2" if depth == 16 else np.uint8).tobytes()
    step, line = n * depth // 8, w * n * depth // 8
    rows, body = [np.frombuffer(raw[i * line : (i + 1) * line], np.uint8).astype(int) for i in range(h)], b""
    for r, x in enumerate(rows):
        left = np.concatenate((np.zeros(step, int), x[:-step]))
        up = rows[r - 1] if r else np.zeros(line, int)
        corner = np.concatenate((np.zeros(step, int), up[:-step]))
        p = left + up - corner
        pa, pb, pc = abs(p - left), abs(p - up), abs(p - corner)
        guess = [0 * x, left, up, (left + up) // 2, np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, up, corner))][filter_kind]
        body += bytes([filter_kind]) + ((x - guess) & 255).astype(np.uint8).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, depth, {1: 0, 3: 2}[n], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def test_files_are_listed_and_decoded(spark, tmp_path):
    r = np.random.default_rng(1)
    given = {"t10.png": r.integers(0, 256, (5, 7)), "t2.png": r.integers(0, 256, (4, 6, 3)), "t1.png": r.integers(0, 65536, (3, 3))}
    for k, (name, v) in enumerate(given.items()):
        (tmp_path / name).write_bytes(png(v, 16 if name == "t1.png" else 8, 4 - k))
    (tmp_path / "t3.png").write_bytes(b"no image")
    listed = images.list_files(spark, str(tmp_path), "*.png").collect()
    assert [x.name for x in sorted(listed, key=lambda x: x.seq)] == ["t1.png", "t2.png", "t3.png", "t10.png"]
    out = {x.path.rsplit("/", 1)[1]: x for x in images.decoded(spark.read.format("binaryFile").load(f"{tmp_path}/*.png")).collect()}
    assert out["t3.png"].status == "unreadable" and out["t3.png"].pixels is None
    assert np.allclose(out["t10.png"].pixels, given["t10.png"].ravel() / 255) and np.allclose(out["t1.png"].pixels, given["t1.png"].ravel() / 65535)
    rgb = given["t2.png"]
    want = ((299 * rgb[..., 0] + 587 * rgb[..., 1] + 114 * rgb[..., 2] + 500) // 1000).ravel() / 255
    assert (out["t2.png"].height, out["t2.png"].width, out["t2.png"].n_channels) == (4, 6, 3) and np.allclose(out["t2.png"].pixels, want)
    again = {x.path.rsplit("/", 1)[1]: x for x in images.read_images(spark, str(tmp_path), "t2.png").collect()}
    assert np.allclose(again["t2.png"].pixels, want)


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 0.5), ("b", 2, None)], "dataset string, i int, rmse double")
    images.write_results(rows, f"{tmp_path}/results")
    assert spark.read.parquet(f"{tmp_path}/results").where("dataset = 'a'").select("i", "rmse").collect() == [(1, 0.5)]
    v = spark.range(30 * 20).select(F.floor(F.col("id") / 20).cast("int").alias("r"), (F.col("id") % 20).cast("int").alias("c"), F.col("id").cast("double").alias("v"))
    blocks = pixels.blocked(v, 8)
    images.write_mosaic(blocks, pixels.block_index(blocks, 8), f"{tmp_path}/mosaic")
    stored, index = images.read_mosaic(spark, f"{tmp_path}/mosaic")
    assert images.mosaic_size(index).first() == (30, 20) and index.count() == 12
    part = pixels.region(stored, 8, 5, 6, 10, 4)
    assert {(x.r, x.c): x.v for x in part.collect()} == {(r, c): (r + 5) * 20.0 + c + 6 for r in range(10) for c in range(4)}
    assert "PartitionFilters: [" in (plan := part._jdf.queryExecution().toString()) and "row#" in plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]


@pytest.mark.parametrize(("form", "given", "want"), [
    ("digits", ["a" + "9" * 45, "a1" + "0" * 45, "a0002", "a10", None, ""], [None, "", "a0002", "a10", "a" + "9" * 45, "a1" + "0" * 45]),
    ("signed", ["x5", "x-10", "x+1", "x"], ["x", "x-10", "x+1", "x5"]),
    ("decimal", ["x1.5", "x1.25", "x.5", "x-3"], ["x-3", "x.5", "x1.25", "x1.5"]),
    ("exponent", ["1e3", "2.5e-1", "NaN", "-Inf", "Inf", "7"], ["-Inf", "2.5e-1", "7", "1e3", "Inf", "NaN"]),
    ("hex", ["0xFF", "0xe", "0x0010"], ["0xe", "0x0010", "0xFF"]),
    ("binary", ["0b101", "0b11", "0B1"], ["0B1", "0b11", "0b101"]),
])
def test_natural_forms(spark, form, given, want):
    df = spark.createDataFrame([(x,) for x in given], "s string")
    assert [x.s for x in df.orderBy(natural_key(F.col("s"), form=form)).collect()] == want
    assert [x.s for x in df.orderBy(natural_key(F.col("s"), form=form).desc()).collect()] == want[::-1]


def test_natural_options(spark):
    df = spark.createDataFrame([(x,) for x in ("a1", "ab", "a", "B")], "s string")
    names = lambda **how: [x.s for x in df.orderBy(natural_key(F.col("s"), **how)).collect()]
    assert names() == ["a", "a1", "ab", "B"] and names(numbers_first=False) == ["a", "ab", "a1", "B"] and names(match_case=True) == ["B", "a", "a1", "ab"]
    nan = spark.createDataFrame([("NaN",), ("-5",)], "s string")
    assert nan.orderBy(natural_key(F.col("s"), form="exponent", nan_first=True)).first().s == "NaN"
    for bad in ({"form": "octal"}, {"form": "hex", "pattern": "[0-7]+"}):
        with pytest.raises(ValueError):
            natural_key(F.col("s"), **bad)


def test_odd_tiles(spark):
    whole = [float(x) for x in range(16)]
    rows = [(1, whole), (2, None), (3, [1.0, 2.0]), (4, [None] * 16), (5, [0.5] * 16)]
    tiles = spark.createDataFrame(rows, "tile_id bigint, pixels array<double>")
    assert {x.tile_id for x in detect.responses(tiles, 4, 4, ["harris"]).collect()} == {1, 5}
    assert {x.tile_id for x in detect.detect(tiles, 4, 4, "min_eigen").collect()} <= {1}
    pairs = spark.createDataFrame([(i, "north", p, whole) for i, p in rows], "k bigint, direction string, pa array<double>, pb array<double>")
    for method in ("phase", "ncc"):
        out = {x.k: x for x in spectral.align(pairs, 4, 4, "k bigint", method).collect()}
        assert len(out) == 5 and all(out[i].tx is None and out[i].ncc is None for i in (2, 3, 4)) and out[1].tx is not None
    grid = overlap.grid(tiles.withColumn("seq", F.col("tile_id") - 1), 5)
    assert overlap.shared_pixels(overlap.neighbour_pairs(grid), grid, 4, F.lit(0), F.lit(0)).count() == 4 * 16
    none = tiles.where("false")
    assert detect.detect(none, 4, 4, "fast").count() == 0 and spectral.align(pairs.where("false"), 4, 4, "k bigint").count() == 0


def test_flat_tiles_correlate_at_the_origin():
    flat = np.full((4, 4), 0.5)
    assert spectral.phase_correlation(flat, flat)[0, 0] == pytest.approx(1) and spectral.phase_correlation(0 * flat, flat)[0, 0] == pytest.approx(1)


def test_every_corner_detector_has_points_on_a_blob(spark):
    y, x = np.mgrid[:24, :24]
    v = np.exp(-((y - 11.0) ** 2 + (x - 12.0) ** 2) / 8)
    tile = spark.createDataFrame([(1, v.ravel().tolist()), (2, np.where((y > 8) & (x > 8), 1.0, 0.0).ravel().tolist())], "tile_id bigint, pixels array<double>")
    for name in detect.DETECTORS:
        found = detect.detect(tile, 24, 24, name, least=1e-9).collect()
        assert found, name
        assert all(len(p.descriptor) == 49 for p in found)
    detect.register("bright", lambda v: v)
    assert detect.detect(tile.where("tile_id = 1"), 24, 24, "bright", most=1).first()[2:4] == (12.0, 11.0)
    del detect.DETECTORS["bright"]


def test_inlier_error_of_large_shifts(spark):
    rows = [(1, m, 0.0, 0.0, 1e8 + (0.3 if m % 2 else -0.3), 1e8) for m in range(10)]
    got = robust.msac_shift(spark.createDataFrame(rows, "i int, m int, x1 double, y1 double, x2 double, y2 double"), ["i"]).first()
    assert got.error == pytest.approx(0.3, rel=1e-6) and got.n_inlier == 10


def test_ransac_of_more_pairs_than_trials(spark):
    rows = [(1, m, float(m), 0.0, m + 5.0, 2.0) for m in range(60)] + [(1, 60 + m, 0.0, 0.0, 40.0 * m, 30.0) for m in range(40)] + [(2, 0, 0.0, 0.0, None, 1.0), (3, 0, 0.0, 0.0, 1.0, 1.0)]
    matches = spark.createDataFrame(rows, "k int, m int, x1 double, y1 double, x2 double, y2 double")
    got = {x.k: x for x in robust.ransac_shift(matches, ["k"], trials=200).collect()}
    assert (got[1].tx, got[1].ty, got[1].n_inlier) == (5.0, 2.0, 60) and got[3].status == 1 and got[3].tx is None and 2 not in got
    barred = robust.ransac_shift(matches, ["k"], valid=lambda h: h["hx"] > 1e6).where("k = 1").first()
    assert barred.status == 2 and barred.tx is None
    with pytest.raises(ValueError):
        robust.ransac_shift(matches, ["k"], threshold=0)


def test_projective_fit(spark):
    m = np.array([[1.1, 0.2, 3.0], [-0.1, 0.9, -2.0], [1e-3, 2e-3, 1.0]])
    p = np.random.default_rng(4).random((12, 2)) * 50
    q = np.column_stack((p, np.ones(12))) @ m.T
    q = q[:, :2] / q[:, 2:]
    rows = [(1, *map(float, x), *map(float, y)) for x, y in zip(p, q, strict=True)] + [(2, float(i), float(i), 1.0, 1.0) for i in range(6)] + [(3, 1.0, 2.0, 3.0, 4.0)]
    got = {x.k: x for x in geometry.projective_fit(spark.createDataFrame(rows, "k int, x1 double, y1 double, x2 double, y2 double"), ["k"]).collect()}
    assert np.allclose([got[1][n] for n in geometry.CELLS], m.ravel(), atol=1e-8) and got[2].m00 is None and got[3].m00 is None


def test_affine_clusters(spark):
    r = np.random.default_rng(5)
    maps = [np.array([[1.0, 0.1, 5.0], [-0.1, 1.0, -3.0]]), np.array([[0.8, 0.0, -20.0], [0.0, 1.2, 30.0]])]
    rows = []
    for k, n in ((0, 40), (1, 25)):
        p = r.random((n, 2)) * 100
        rows += [(1, len(rows) + i, *map(float, x), *map(float, maps[k] @ [*x, 1])) for i, x in enumerate(p)]
    rows += [(1, 100 + i, *map(float, r.random(4) * 1000)) for i in range(5)] + [(2, 0, 0.0, 0.0, 1.0, 1.0)]
    out = robust.affine_clusters(spark.createDataFrame(rows, "k int, m int, x1 double, y1 double, x2 double, y2 double"), ["k"], clusters=3)
    got = {(x.k, x.cluster): x for x in robust.kept_clusters(out).collect()}
    assert set(got) == {(1, 0), (1, 1)}
    for c in (0, 1):
        assert np.allclose([got[1, c][n] for n in ("m00", "m01", "m02", "m10", "m11", "m12")], maps[c].ravel(), atol=1e-6)
    assert set(got[1, 0].members) == set(range(40)) and robust.chance(0, 5, 3, 0.99) == math.inf


def test_k_means_against_loops(spark):
    r = np.random.default_rng(6)
    spots = np.concatenate([r.normal(c, 0.5, (30, 2)) for c in ((10, 10), (30, 10), (20, 40))])
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(spots)] + [(1000, None, 1.0)], "id bigint, x double, y double")
    out, centres = cluster.k_means(df, ["x", "y"], 3)
    start = [x.id for x in df.where("x is not null").orderBy(F.xxhash64("id"), "id").limit(3).collect()]
    for _ in range(4):
        label = ((spots[:, None] - spots[start]) ** 2).sum(axis=2).argmin(axis=1)
        mean = np.array([spots[label == i].sum(axis=0) / ((label == i).sum() + 1) for i in range(3)])
        new = ((spots[:, None] - mean) ** 2).sum(axis=2).argmin(axis=0).tolist()
        if new == start:
            break
        start = new
    label = ((spots[:, None] - spots[start]) ** 2).sum(axis=2).argmin(axis=1)
    assert centres == start and {x.id: x.cluster for x in out.collect()} == dict(enumerate(label.tolist()))
    assert cluster.k_means(df.where("false"), ["x", "y"], 3)[1] == []


def test_wavefront_of_a_wall(spark):
    wall = np.zeros((8, 8), bool)
    wall[3, :6] = True
    out = warp.steps(wall, 1, 1)
    assert out[1, 1] == 0 and out[2, 1] == 1 and out[3, 0] == cluster.UNREACHABLE and out[4, 1] == 13 and out[7, 7] == 12
    rows = spark.createDataFrame([(1, 0, 1, 1, wall.ravel().tolist()), (2, 0, 0, 0, None)], "tile_id bigint, kp bigint, row int, column int, walls array<boolean>")
    got = {(x.r, x.c): x.dist for x in warp.wavefront(rows, 8, 8, alpha=0.5).collect()}
    assert got[4, 1] == (13 + 3) / 2 and len(got) == 64


def test_png_filters_of_large_rows():
    """Filters 3 and 4 of every depth come back to the bit, and quickly enough for real tiles."""
    import time

    v = np.random.default_rng(3).integers(0, 65536, (300, 400)).astype(np.uint16)
    start = time.perf_counter()
    for kind in range(5):
        assert (images.png_pixels(png(v, 16, kind))[..., 0] == v).all()
        assert (images.png_pixels(png((v >> 8).astype(np.uint8), 8, kind))[..., 0] == v >> 8).all()
    assert time.perf_counter() - start < 30
    assert images.png_pixels(b"none") is None


@pytest.mark.parametrize("method", ["phase", "ncc", "harris", "hessian", "sift", "surf", "kaze", "orb", "brisk"])
def test_registration_recovers_known_shifts(spark, method):
    image = np.random.default_rng(8).random((240, 240))
    image = sum(np.roll(image, (a, b), (0, 1)) for a in range(3) for b in range(3)) / 9
    size, step = (40, 30) if method in ("phase", "ncc", "harris", "hessian") else (100, 60)
    rows = [("d", 2 * i + j, 2 * i + j, image[i * step : i * step + size, j * step : j * step + size].ravel().tolist()) for i in range(2) for j in range(2)]
    tiles = overlap.grid(spark.createDataFrame(rows, "dataset string, tile_id bigint, seq bigint, pixels array<double>"), 2)
    how = {} if method in ("phase", "ncc") else {"least": 1e-9}
    out = register.register(tiles, size, size, method, overlap=(size - step) / size, **how)
    for x in out.collect():
        assert (round(x.tx), round(x.ty), x.status) == ((0, step, 0) if x.direction == "north" else (step, 0, 0)), x
        assert x.rmse < 1e-9 and x.ssim == pytest.approx(1)
        assert x.n_match is None or x.n_inlier >= (5 if method in detect.DETECTORS else 2)
    total = register.summary(out).first()
    assert (total.n_pairs, total.n_failed) == (4, 0) and total.average_rmse < 1e-9


def scene(size, seed):
    image = np.random.default_rng(seed).random((size, size))
    return sum(np.roll(image, (a, b), (0, 1)) for a in range(3) for b in range(3)) / 9


def cut(image, size, steps):
    """Four tiles of an image, each step (y, x) from the one before."""
    dy, dx = steps
    return [(2 * i + j, image[i * dy : i * dy + size, j * dx : j * dx + size]) for i in range(2) for j in range(2)]


@pytest.mark.parametrize("method", ["phase", "ncc", "harris", "orb"])
def test_data_sets_whose_tiles_are_numbered_alike(spark, method):
    """Each data set beside others has the rows that it has alone."""
    sets = {"a": cut(scene(200, 1), 60, (40, 42)), "b": cut(scene(200, 2), 60, (38, 40)), "c": cut(scene(200, 1), 60, (40, 42))}
    rows = [(d, k, k, v.ravel().tolist()) for d, tiles in sets.items() for k, v in tiles]
    every = overlap.grid(spark.createDataFrame(rows, "dataset string, tile_id bigint, seq bigint, pixels array<double>"), 2)
    together = {(x.dataset, x.i, x.j, x.direction): x for x in register.register(every, 60, 60, method, overlap=0.3).collect()}
    assert len(together) == 12
    for name, (dy, dx) in (("a", (40, 42)), ("b", (38, 40)), ("c", (40, 42))):
        for x in register.register(every.where(f"dataset = '{name}'"), 60, 60, method, overlap=0.3).collect():
            assert x == together[name, x.i, x.j, x.direction]
            assert (round(x.tx), round(x.ty)) == ((0, dy) if x.direction == "north" else (dx, 0)) and x.rmse < 1e-9
    assert all(together["a", i, j, d][5:] == together["c", i, j, d][5:] for _, i, j, d in together)


def test_counts_of_a_pair_against_one_tile_at_a_time(spark):
    """Keypoints of strips that are cut out first, and of whole tiles masked; matches and inliers by loops."""
    tiles_ = cut(scene(120, 5), 48, (32, 30))
    rows = [("d", k, k, v.ravel().tolist(), 48, 48) for k, v in tiles_]
    every = overlap.grid(spark.createDataFrame(rows, "dataset string, tile_id bigint, seq bigint, pixels array<double>, height int, width int"), 2)
    for masked in (False, True):
        for x in register.register(every, method="harris", overlap=0.3, least=1e-5, masked=masked).collect():
            cur, prev = tiles_[2 * x.i + x.j][1], tiles_[2 * x.i + x.j - (2 if x.direction == "north" else 1)][1]
            n = int(48 * 0.3)
            one, two = ((48 - n, 48, 0, 48), (0, n, 0, 48)) if x.direction == "north" else ((0, 48, 48 - n, 48), (0, 48, 0, n))
            p, q = (detect.points_of(v, "harris", least=1e-5).inside(*c) if masked else detect.points_of(v[c[0] : c[1], c[2] : c[3]], "harris", least=1e-5).moved(c[2], c[0]) for v, c in ((prev, one), (cur, two)))
            d = [[sum((a - b) ** 2) for b in q.f] for a in p.f]
            pairs = []
            for i, line in enumerate(d):
                j = int(np.argmin(line))
                if int(np.argmin([row[j] for row in d])) == i:
                    pairs.append((p.x[i] - q.x[j], p.y[i] - q.y[j]))
            cost = [sum(min((a - hx) ** 2 + (b - hy) ** 2, 2.25) for a, b in pairs) for hx, hy in pairs]
            hx, hy = pairs[int(np.argmin(np.round(cost, 9)))]
            assert (x.n_kp_prev, x.n_kp, x.n_match) == (len(p.x), len(q.x), len(pairs))
            assert x.n_inlier == sum((a - hx) ** 2 + (b - hy) ** 2 <= 2.25 for a, b in pairs)


def test_tiles_of_different_sizes(spark):
    """The lower row is higher and the right column narrower: no pair is lost."""
    image = scene(200, 7)
    rows = [("d", 2 * i + j, 2 * i + j, h, w, image[60 * i : 60 * i + h, 62 * j : 62 * j + w].ravel().tolist()) for i, h in ((0, 80), (1, 90)) for j, w in ((0, 84), (1, 70))]
    tiles_ = overlap.grid(spark.createDataFrame(rows, "dataset string, tile_id bigint, seq bigint, height int, width int, pixels array<double>"), 2)
    for method, share in (("phase", 0.25), ("ncc", 0.2), ("min_eigen", 0.25), ("orb", None)):
        for x in register.register(tiles_, method=method, overlap=share).collect():
            assert (round(x.tx), round(x.ty), x.status) == ((0, 60, 0) if x.direction == "north" else (62, 0, 0)), (method, x)
            assert x.rmse < 1e-9
    with pytest.raises(ValueError):
        register.register(tiles_.drop("height"), method="phase")


def test_thresholds_and_quotas_of_data_sets(spark):
    """Each data set has its own least response, and none without one."""
    v = scene(60, 9).ravel().tolist()
    rows = [(d, k, k, v, least) for d, least in (("low", 0.0), ("high", 1e-3), ("none", None)) for k in range(2)]
    tiles_ = overlap.grid(spark.createDataFrame(rows, "dataset string, tile_id bigint, seq bigint, pixels array<double>, least double"), 2)
    n = {x.dataset: x.n_kp for x in register.register(tiles_, 60, 60, "harris", overlap=None).collect()}
    assert n["low"] > n["high"] > n["none"] == 0
    few = {x.dataset: x.n_kp for x in register.register(tiles_, 60, 60, "harris", overlap=None, most=40, blocks=2).collect()}
    assert few["low"] == 40


def test_a_failed_pair_has_a_row(spark):
    rows = [("d", 0, 0, [0.0] * 64), ("d", 1, 1, None)]
    tiles = overlap.grid(spark.createDataFrame(rows, "dataset string, tile_id bigint, seq bigint, pixels array<double>"), 2)
    for method in ("phase", "fast"):
        x = register.register(tiles, 8, 8, method).first()
        assert x.status == 1 and x.tx is None and x.rmse is None
    with pytest.raises(ValueError):
        register.register(tiles, 8, 8, "unknown")


def test_elastic_clusters_and_fields(spark):
    r = np.random.default_rng(9)
    rows = []
    for k, (centre, move) in enumerate((((15, 15), (4.0, 1.0)), ((80, 80), (-6.0, 3.0)))):
        for _ in range(25):
            x, y = r.normal(centre, 5)
            rows.append((len(rows), float(x), float(y), float(x + move[0]), float(y + move[1])))
    matches = spark.createDataFrame([*rows, (99, None, 1.0, 1.0, 1.0)], "m int, x1 double, y1 double, x2 double, y2 double")
    labelled, maps = elastic.clusters(matches, 2)
    found = {x.cluster: x for x in maps.collect()}
    assert len(found) == 2 and sorted(round(x.m02) for x in found.values()) == [-6, 4] and all(x.n_inlier == 25 for x in found.values())
    points = elastic.inliers(labelled, maps).withColumn("tile_id", F.lit(1).cast("bigint"))
    assert points.count() == 50
    pixels_ = spark.createDataFrame([(1, 15, 15), (1, 80, 80)], "tile_id bigint, r int, c int")
    field = {(x.r, x.c): (x.x, x.y) for x in elastic.generated_field(pixels_, points, maps).collect()}
    assert field[15, 15] == pytest.approx((19.5, 16.5), abs=0.2) and field[80, 80] == pytest.approx((74.5, 83.5), abs=0.2)


def test_fields_around_walls(spark):
    """A wall cuts the left half off: beyond it only the right cluster counts."""
    wall = np.zeros((6, 9), bool)
    wall[:, 4] = True
    points = spark.createDataFrame([(1, c, 10 * c + i, float(x), float(y)) for c, x in ((0, 1), (1, 7)) for i, y in enumerate((1, 3, 5))], "tile_id bigint, cluster int, kp int, x double, y double")
    maps = spark.createDataFrame([(0, 1.0, 0.0, 2.0, 0.0, 1.0, 0.0), (1, 1.0, 0.0, -2.0, 0.0, 1.0, 0.0)], "cluster int, m00 double, m01 double, m02 double, m10 double, m11 double, m12 double")
    spots = spark.createDataFrame([(1, r, c) for r in range(6) for c in range(9)], "tile_id bigint, r int, c int")
    walls = spark.createDataFrame([(1, wall.ravel().tolist())], "tile_id bigint, walls array<boolean>")
    out = {(x.r, x.c): x.x - x.c - 0.5 for x in elastic.generated_field_around_walls(spots, points, maps, walls, 6, 9, k=2).collect()}
    assert set(out) == {(r, c) for r in range(6) for c in range(9) if c != 4}
    assert all(v == pytest.approx(2.0 if c < 4 else -2.0) for (_, c), v in out.items())
    straight = {(x.r, x.c): x.x - x.c - 0.5 for x in elastic.generated_field(spots, points, maps, k=2).collect()}
    assert 0 < straight[3, 3] < 2


def test_an_inverse_undoes_a_field(spark):
    tiles = spark.createDataFrame([(1, [0.0] * 400)], "tile_id bigint, pixels array<double>")
    one = F.struct(*(F.lit(v).alias(n) for n, v in (("m00", 0.9), ("m01", 0.1), ("m02", 0.6), ("m10", -0.1), ("m11", 1.0), ("m12", 0.7))))
    there = warp.affine_field(tiles, one, 20, 20)
    for x in warp.inverse_field(there, 20, 20).collect():
        assert (0.9 * x.x + 0.1 * x.y + 0.6, -0.1 * x.x + x.y + 0.7) == pytest.approx((x.c + 0.5, x.r + 0.5), abs=1e-9)
