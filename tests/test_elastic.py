import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import cluster, elastic, warp
from tessera.operators.ways import UNREACHABLE, filled, steps

RNG = np.random.default_rng(17)


def plain_medoids(f, k, order, wall=None):
    """Rounds by loops: labels and centres."""
    def apart(a, to):
        if wall is None:
            return sum((p - q) ** 2 for p, q in zip(a, to, strict=True))
        h, w = wall.shape
        x, y = (min(max(int(a[i]), 0), (w, h)[i] - 1) for i in (0, 1))
        return steps(wall, int(to[1]), int(to[0]))[y, x]

    k = min(k, len(f))
    centres = [f[i] for i in order[:k]]
    at = list(order[:k])
    for _ in range(k + 1):
        label = [min(range(k), key=lambda i: (apart(a, centres[i]), i)) for a in f]
        if wall is not None:
            label = [-1 if min(apart(a, c) for c in centres) >= UNREACHABLE else x for a, x in zip(f, label, strict=True)]
        means = []
        for i in range(k):
            mine = [a for a, x in zip(f, label, strict=True) if x == i]
            means.append([sum(a[d] for a in mine) / (len(mine) + 1) for d in range(len(f[0]))])
        new = [min(range(len(f)), key=lambda n: (apart(f[n], m), n)) for m in means]
        if new == at:
            break
        at, centres = new, [f[n] for n in new]
    centres = [f[n] for n in at]
    label = [min(range(k), key=lambda i: (apart(a, centres[i]), i)) for a in f]
    if wall is not None:
        label = [-1 if min(apart(a, c) for c in centres) >= UNREACHABLE else x for a, x in zip(f, label, strict=True)]
    return label, at


def test_medoids_of_many_keys_against_loops(spark):
    rows, wall = [], np.zeros((30, 40), bool)
    wall[:, 20] = True
    wall[5, :20] = True
    for key in range(5):
        for m in range(7 * key + 2):
            rows.append((f"pair{key}", key % 2, m, float(RNG.integers(0, 40)), float(RNG.integers(0, 30)), float(RNG.normal()), "x"))
    rows += [("pair9", 0, 1, None, 1.0, 1.0, "x"), ("pair9", 0, None, 1.0, 1.0, 1.0, "x")]
    samples = spark.createDataFrame(rows, "pair string, part int, m int, x double, y double, z double, other string")
    walls = spark.createDataFrame([(f"pair{k}", k % 2, wall.ravel().tolist()) for k in (3, 4)], "pair string, part int, walls array<boolean>")
    for given in (None, walls):
        got = cluster.k_medoids(samples, ["pair", "part"], ["x", "y", "z"], 3, walls=given, height=30, width=40).collect()
        assert len(got) == len(rows) - 2 and all(r.other == "x" for r in got)
        hashes = {r.m: r.h for r in samples.where("m is not null").select("m", F.xxhash64("m").alias("h")).distinct().collect()}
        for key in range(5):
            mine = sorted((r for r in rows if r[0] == f"pair{key}"), key=lambda r: hashes[r[2]])
            label, centres = plain_medoids([list(r[3:6]) for r in mine], 3, list(range(len(mine))), wall if given is not None and key > 2 else None)
            found = {r.m: (r.cluster, r.centre) for r in got if r.pair == f"pair{key}"}
            assert found == {r[2]: (x, n in centres and any(c == n and i == x for i, c in enumerate(centres)) or n in centres) for n, (r, x) in enumerate(zip(mine, label, strict=True))}


def matches_of(tile, parts):
    rows, n = [], 0
    for x0, x1, (dx, dy) in parts:
        for x in np.linspace(x0, x1, 6):
            for y in np.linspace(3, 21, 5):
                rows.append((tile, n, float(x), float(y), float(x + dx), float(y + dy)))
                n += 1
    return rows


def test_two_cut_images_are_unfolded(spark):
    """Left and right of a cut images move differently; fields follow each side up to the moved cut, for all images at once."""
    wall = np.zeros((24, 40), bool)
    wall[:, 20] = True
    moves = {1: ((3.0, 0.0), (-2.0, 1.0)), 2: ((1.0, 2.0), (2.0, -1.0))}
    rows = [r for tile, (a, b) in moves.items() for r in matches_of(tile, ((2, 12, a), (26, 36, b)))]
    matches = spark.createDataFrame([*rows, (1, 99, 30.0, 10.0, 3.0, 20.0)], "tile_id int, m int, x1 double, y1 double, x2 double, y2 double")
    walls = spark.createDataFrame([(t, wall.ravel().tolist()) for t in moves], "tile_id int, walls array<boolean>")
    some, maps = elastic.clusters_of(matches, ["tile_id"], 2)
    maps = maps.cache()
    assert {(r.tile_id, round(r.m02), round(r.m12), r.n_inlier) for r in maps.collect()} == {(t, *map(round, m), 30) for t, both in moves.items() for m in both}
    field = elastic.field_in_two_passes(some, maps, walls, 24, 40).collect()
    for tile, (a, b) in moves.items():
        # the cut lies where its side's field reads it from
        ends = 20 - a[0], 20 + max(-b[0], 0)
        left, right = [r for r in field if r.tile_id == tile and r.c < ends[0]], [r for r in field if r.tile_id == tile and r.c > ends[1]]
        assert len(left) >= 24 * ends[0] - 24 and len(right) >= 24 * (39 - ends[1]) - 24
        for side, move in ((left, a), (right, b)):
            assert max(abs(r.x - r.c - 0.5 - move[0]) + abs(r.y - r.r - 0.5 - move[1]) for r in side) < 1


def test_planted_clusters(spark):
    """From keypoints with descriptors: matches within a radius, clusters and their maps, for two pairs of images at once."""
    left, right = [], []
    for pair, move in (("a", (4.0, -3.0)), ("b", (-6.0, 5.0))):
        for n in range(40):
            x, y, f = float(RNG.uniform(0, 100)), float(RNG.uniform(0, 100)), [float(v) for v in RNG.normal(size=6)]
            left.append((pair, n, x, y, f))
            right.append((pair, 100 + n, x + move[0], y + move[1], [v + 0.001 for v in f]))
    one = spark.createDataFrame(left, "pair string, kp1 int, x1 double, y1 double, f1 array<double>")
    two = spark.createDataFrame(right, "pair string, kp2 int, x2 double, y2 double, f2 array<double>")
    _, maps = elastic.planted(one, two, ["pair"], 1, radius=20.0)
    assert {(r.pair, round(r.m02), round(r.m12), r.n_inlier) for r in maps.collect()} == {("a", 4, -3, 40), ("b", -6, 5, 40)}


def test_filled_walls():
    wall = RNG.random((9, 11)) < 0.4
    ways = RNG.random((3, 9, 11))
    want = ways.copy()
    for r in range(9):
        for c in range(11):
            if wall[r, c]:
                want[:, r, c] = want[:, max(r - 1, 0), max(c - 1, 0)]
    assert (filled(ways, wall) == want).all()


def test_weights_against_loops(spark):
    """More pixels than a block, points of two tiles, ties, small clusters and a cut."""
    spots = [(t, r, c) for t in (1, 2) for r in range(0, 140, 23) for c in range(0, 150, 29)]
    points = [(t, int(k), n, float(RNG.integers(0, 150)), float(RNG.integers(0, 140))) for t in (1, 2) for n, k in enumerate(RNG.integers(0, 3, 14))] + [(1, 7, 90, 3.0, 4.0), (2, None, 91, 1.0, 1.0), (2, 1, 92, None, 1.0)]
    cuts = [(1, int(RNG.integers(0, 140)), int(RNG.integers(0, 150))) for _ in range(25)]
    px, pt, ct = spark.createDataFrame(spots, "tile_id int, r int, c int"), spark.createDataFrame(points, "tile_id int, cluster int, kp int, x double, y double"), spark.createDataFrame(cuts, "tile_id int, r int, c int")
    dens = {(r.tile_id, r.r, r.c, r.cluster): r.weight for r in cluster.density_weights(px, pt, k=3).collect()}
    votes = {(r.tile_id, r.r, r.c, r.cluster): r.weight for r in cluster.vote_weights(px, pt, 60.0, k=5).collect()}
    kth = {(r.tile_id, r.r, r.c, r.cluster): (r.nearest, r.farthest) for r in cluster.kth_distances(px, pt, 3).collect()}
    seen = {(r.tile_id, r.r, r.c, r.cluster): r.visible for r in cluster.visible(px, pt, ct).collect()}
    for t, r, c in spots:
        mine = sorted((np.hypot(c - x, r - y), n, k, x, y) for tile, k, n, x, y in points if tile == t and k is not None and x is not None)
        kinds = sorted({p[2] for p in mine})
        d = {k: [p[0] for p in mine if p[2] == k] for k in kinds}
        w = {k: (3 / len(v)) / (v[2] ** 2 + 1e-30) for k, v in d.items() if len(v) >= 3}
        for k in kinds:
            assert kth[t, r, c, k] == (pytest.approx((d[k][2], d[k][-3])) if len(d[k]) >= 3 else (None, None))
            assert dens.get((t, r, c, k)) == (pytest.approx(w[k] / sum(w.values())) if k in w else None)
            best = next(p for p in mine if p[2] == k)
            blocked = False
            for tile, cr, cc in cuts:
                far = np.hypot(cc - c, cr - r)
                cosine = ((best[3] - c) * (cc - c) + (best[4] - r) * (cr - r)) / ((best[0] + 1e-30) * (far + 1e-30))
                blocked |= tile == t and far < best[0] and np.arccos(np.clip(cosine, -1, 1)) < 0.2
            assert seen[t, r, c, k] == (not blocked)
        five = mine[:5]
        total = sum(np.exp(-p[0] ** 2 / 3600) for p in five)
        for k in {p[2] for p in five}:
            assert votes[t, r, c, k] == pytest.approx(sum(np.exp(-p[0] ** 2 / 3600) for p in five if p[2] == k) / total)
    assert warp.UNREACHABLE == UNREACHABLE
