import math

import numpy as np
import pytest

from tessera.operators import binary, detect, extremal, matching, scale_space
from tessera.operators.corners import blurred


def blobs(size, spots):
    y, x = np.mgrid[:size, :size]
    return 0.1 + sum(a * np.exp(-((y - cy) ** 2 + (x - cx) ** 2) / (2 * s * s)) for cy, cx, s, a in spots)


def texture(size=120, seed=3):
    v = blurred(np.random.default_rng(seed).random((1, size, size)), 2.0)[0]
    return (v - v.min()) / (v.max() - v.min())


@pytest.mark.parametrize("method", ["sift", "surf"])
def test_blobs_at_their_place_and_scale(method):
    spots = [(30.3, 40.6, 3.0, 0.7), (64.7, 61.2, 5.0, 0.5)]
    p = detect.points_of(blobs(96, spots), method, least=1e-3)
    for cy, cx, s, _ in spots:
        near = [k for k in range(len(p.x)) if math.hypot(p.x[k] - cx, p.y[k] - cy) < 0.5]
        assert near, (method, cy, cx)
    ratio = [np.median([p.size[k] for k in range(len(p.x)) if math.hypot(p.x[k] - cx, p.y[k] - cy) < 0.5]) for cy, cx, _, _ in spots]
    assert ratio[1] / ratio[0] == pytest.approx(5 / 3, rel=0.15)


@pytest.mark.parametrize("method", ["sift", "surf"])
def test_an_enlarged_blob_has_its_enlarged_size(method):
    one, two = (detect.points_of(blobs(80 * k, [(39.5 * k + (k - 1) / 2, 39.5 * k + (k - 1) / 2, 3.0 * k, 0.8)]), method, least=1e-3) for k in (1, 2))
    assert two.size[0] / one.size[0] == pytest.approx(2, rel=0.1)
    assert (one.x[0], one.y[0]) == pytest.approx((39.5, 39.5), abs=0.1) and (two.x[0], two.y[0]) == pytest.approx((79.5, 79.5), abs=0.2)


@pytest.mark.parametrize("method", list(detect.FEATURES))
def test_a_turned_image_has_the_turned_points(method):
    v = texture()
    least = 0.01 if method == "sift" else 0.0
    p, q = detect.points_of(v, method, least=least), detect.points_of(np.rot90(v).copy(), method, least=least)
    bits = method in detect.BINARY
    i, j, _ = matching.best_matches(p.bits if bits else p.f, q.bits if bits else q.f, metric="hamming" if bits else "squared")
    there = np.hypot(p.y[i] - q.x[j], (v.shape[1] - 1) - p.x[i] - q.y[j]) < 2
    assert len(i) > 20 and there.mean() > 0.95
    turn = (q.angle[j] - p.angle[i] + 1.5 * np.pi) % (2 * np.pi) - np.pi
    assert np.abs(turn[there]).mean() < 0.05


def test_descriptors_of_any_turn():
    """The same blob pattern seen under other angles: descriptors stay near, those of other places don't."""
    def seen(angle):
        y, x = np.mgrid[:81, :81] - 40.0
        u, w = np.cos(angle) * x + np.sin(angle) * y, -np.sin(angle) * x + np.cos(angle) * y
        return np.exp(-(u**2 / 60 + w**2 / 20)) + 0.6 * np.exp(-((u - 9) ** 2 + (w - 5) ** 2) / 8) + 0.4 * np.exp(-((u + 4) ** 2 + (w - 11) ** 2) / 14)

    from tessera.operators.corners import gradients

    for describe, scale in ((scale_space.histograms, 2.0), (scale_space.sums, 1.5)):
        out = []
        for angle in (0.0, 0.4, 1.3, 2.9):
            gy, gx = (g[0] for g in gradients(seen(angle)[None]))
            out.append(describe(gy, gx, 40.0, 40.0, angle, scale))
        other = describe(*(g[0] for g in gradients(seen(0.0)[None])), 46.0, 52.0, 0.0, scale)
        assert max(np.linalg.norm(out[0] - d) for d in out[1:]) < 0.25 < np.linalg.norm(out[0] - other)


def test_peaks_against_loops():
    cube = np.random.default_rng(5).random((5, 9, 8)).round(1)
    want = [(s, r, c) for s in range(1, 4) for r in range(1, 8) for c in range(1, 7) if cube[s, r, c] > 0.5 and cube[s, r, c] >= cube[s - 1 : s + 2, r - 1 : r + 2, c - 1 : c + 2].max()]
    assert list(map(tuple, scale_space.peaks(cube, 0.5))) == want


def test_a_paraboloid_is_fitted_exactly():
    s, r, c = np.mgrid[:5, :7, :7]
    cube = 3 - (s - 2.3) ** 2 - 0.5 * (r - 3.2) ** 2 - 2 * (c - 2.7) ** 2 + 0.2 * (s - 2.3) * (c - 2.7)
    at, off, value, _ = scale_space.refined(cube, scale_space.peaks(cube, 0.0))
    assert len(at) == 1 and at[0] + off[0] == pytest.approx([2.3, 3.2, 2.7]) and value[0] == pytest.approx(3)


def test_box_hessian_against_loops():
    v = np.random.default_rng(6).random((17, 16))
    got = scale_space.box_hessian(v, 9)
    box = lambda r, c, top, left, h, w: v[r + top : r + top + h, c + left : c + left + w].sum()
    for r in range(4, 13):
        for c in range(4, 12):
            yy = box(r, c, -4, -2, 9, 5) - 3 * box(r, c, -1, -2, 3, 5)
            xx = box(r, c, -2, -4, 5, 9) - 3 * box(r, c, -2, -1, 5, 3)
            xy = box(r, c, -3, 1, 3, 3) + box(r, c, 1, -3, 3, 3) - box(r, c, -3, -3, 3, 3) - box(r, c, 1, 1, 3, 3)
            assert got[r, c] == pytest.approx((xx * yy - (0.9 * xy) ** 2) / 81**2)
    assert not got[:4].any() and not got[:, -4:].any()


def regions_by_level(level):
    """{(level, pixels)} of all components of {pixels of a level or less}, at levels where they gain pixels."""
    h, w = level.shape
    out = set()
    for t in sorted(set(level.ravel().tolist())):
        left = {(r, c) for r in range(h) for c in range(w) if level[r, c] <= t}
        while left:
            front = [left.pop()]
            part = set(front)
            while front:
                r, c = front.pop()
                for q in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)):
                    if q in left:
                        left.remove(q)
                        part.add(q)
                        front.append(q)
            if any(level[q] == t for q in part):
                out.add((t, frozenset(part)))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_component_tree_against_all_levels(seed):
    level = np.random.default_rng(seed).integers(0, 5 + 3 * seed, (9, 11))
    want = regions_by_level(level)
    parent, at, area, moments = extremal.component_tree(level)
    sums = lambda p: (len(p), sum(r for r, _ in p), sum(c for _, c in p), sum(r * r for r, _ in p), sum(r * c for r, c in p), sum(c * c for _, c in p))
    assert sorted((int(t), *map(int, m)) for t, m in zip(at, moments, strict=True)) == sorted((t, *sums(p)) for t, p in want)
    for n, m in enumerate(parent):
        assert m == n or (at[m] > at[n] and area[m] > area[n])
    # stable ones, from the regions themselves
    delta, most = 2, 0.6
    grown = {}
    for t, p in want:
        above = max((q for u, q in want if p <= q and u <= t + delta), key=len)
        grown[t, p] = (len(above) - len(p)) / len(p)
    best = []
    for (t, p), g in grown.items():
        ups = sorted(((u, q) for u, q in want if p < q), key=lambda x: len(x[1]))
        downs = [(u, q) for u, q in want if q < p and not any(q < z < p for _, z in want)]
        if g <= most and 2 <= len(p) <= 0.9 * level.size and all(g < grown[d] for d in downs) and (not ups or g <= grown[ups[0]]):
            best.append((round(g, 9), *sums(p)))
    got = [(round(float(g), 9), *map(int, m)) for m, g in zip(*extremal.stable(level, delta, most, 2, 0.9), strict=True)]
    assert sorted(got) == sorted(best)


def test_a_disc_is_a_stable_region():
    y, x = np.mgrid[:60, :60]
    v = np.where((y - 25) ** 2 + (x - 33) ** 2 <= 64, 0.9, 0.2) + 0.01 * np.random.default_rng(1).random((60, 60))
    p = detect.points_of(v, "mser", least=0.9)
    assert any(math.hypot(p.x[k] - 33, p.y[k] - 25) < 0.3 and p.size[k] == pytest.approx(8, abs=0.3) for k in range(len(p.x)))


def test_words_of_bits_and_their_distance():
    r = np.random.default_rng(2)
    one, two = r.random((5, 100)) < 0.5, r.random((7, 100)) < 0.5
    a, b = binary.packed(one), binary.packed(two)
    assert a.shape == (5, 2) and a.dtype == np.int64
    assert (matching.gaps(a, b, "hamming") == (one[:, None] != two).sum(axis=2)).all()


def test_matches_against_loops():
    r = np.random.default_rng(4)
    f, g = r.integers(0, 4, (30, 3)).astype(float), r.integers(0, 4, (25, 3)).astype(float)
    d = ((f[:, None] - g) ** 2).sum(axis=2)
    for ratio, mutual in ((None, True), (0.7, True), (None, False)):
        want = []
        for i in range(30):
            j = min(range(25), key=lambda k: (d[i, k], k))
            back = min(range(30), key=lambda k: (d[k, j], k))
            second = sorted(d[i])[1]
            if (back == i or not mutual) and (ratio is None or d[i, j] <= ratio * max(second, 1e-3)):
                want.append((i, j, d[i, j]))
        got = matching.best_matches(f, g, max_ratio=ratio, mutual=mutual)
        assert list(zip(*map(np.ndarray.tolist, got), strict=True)) == want


def test_tiles_of_two_sizes_and_odd_ones(spark):
    small, large = blobs(40, [(20, 18, 3.0, 0.8)]), blobs(64, [(30, 33, 4.0, 0.8)])
    rows = [("a", "x", 40, 40, small.ravel().tolist()), ("a", "y", 64, 64, large.ravel().tolist()), ("b", "x", 40, 40, [0.5] * 1600), ("b", "y", 64, 64, None), ("b", "z", 8, 8, [1.0]), ("b", "w", None, 8, [1.0])]
    tiles = spark.createDataFrame(rows, "dataset string, tile_id string, height int, width int, pixels array<double>")
    for method in detect.NAMES():
        found = detect.detect(tiles, None, None, method, keys=("dataset", "tile_id"), least=1e-6 if method != "sift" else 1e-3).collect()
        assert all(p.dataset == "a" for p in found)
        for (tile, at) in (("x", (18, 20)), ("y", (33, 30))) if method in ("sift", "surf", "harris", "hessian", "mser") else ():
            assert any(math.hypot(p.x - at[0], p.y - at[1]) < 6 for p in found if p.tile_id == tile), method
    with pytest.raises(ValueError):
        detect.detect(tiles, None, None, "nothing")
    assert detect.detect(tiles.where("false"), None, None, "sift").count() == 0


def test_quota():
    p = detect.points_of(texture(80), "min_eigen", least=1e-9)
    few = p.quota((0, 80, 0, 80), 12, 2)
    assert len(few.x) == 12
    for by in (0, 1):
        for bx in (0, 1):
            mine = [s for x, y, s in zip(p.x, p.y, p.score, strict=True) if (y >= 40) == by and (x >= 40) == bx]
            kept = [s for x, y, s in zip(few.x, few.y, few.score, strict=True) if (y >= 40) == by and (x >= 40) == bx]
            assert kept == mine[:3]
    assert p.quota((0, 80, 0, 80), 5).score.tolist() == p.score[:5].tolist() and p.quota((0, 80, 0, 80), None) is p
