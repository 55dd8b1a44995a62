import itertools

import numpy as np
import pytest

from tessera.operators import models

TRUE = {
    "shift": [[1, 0, 4.0], [0, 1, -3.0], [0, 0, 1]],
    "similarity": [[0.9, -0.3, 5.0], [0.3, 0.9, 1.0], [0, 0, 1]],
    "affine": [[1.1, 0.2, -4.0], [-0.3, 0.8, 7.0], [0, 0, 1]],
    "projective": [[1.0, 0.1, 3.0], [-0.1, 1.2, 2.0], [0.001, -0.002, 1]],
}


def matches(kind, n, wrong, seed, noise=0.05):
    r = np.random.default_rng(seed)
    p = r.uniform(0, 60, (n, 2))
    h = np.column_stack((p, np.ones(n))) @ np.array(TRUE[kind]).T
    q = h[:, :2] / h[:, 2:] + r.normal(0, noise, (n, 2))
    q[:wrong] += r.uniform(10, 40, (wrong, 2))
    return p, q


def plain(p, q, model, threshold):
    """All samples one after the other; the last fit by numpy's own least squares."""
    best = None
    for rows in itertools.combinations(range(len(p)), model.samples):
        m = model.fit(p[list(rows)][None], q[list(rows)][None], np.ones((1, model.samples)))
        if not model.valid(m)[0]:
            continue
        d = []
        for a, b in zip(p, q, strict=True):
            h = m[0] @ [a[0], a[1], 1.0]
            d.append(np.hypot(h[0] / h[2] - b[0], h[1] / h[2] - b[1]))
        inside = [x < threshold for x in d]
        key = (-sum(inside), round(sum(x * x for x in d if x < threshold), 9))
        if best is None or key < best[0]:
            best = key, inside
    return best[1]


@pytest.mark.parametrize("kind", list(TRUE))
def test_every_model_against_loops(spark, kind):
    rows, want = [], {}
    for g, (n, wrong) in enumerate(((9, 3), (8, 2), (6, 0), (2, 0), (3, 0))):
        p, q = matches(kind, n, wrong, 10 * g + len(kind))
        rows += [(f"g{g}", g, m, *map(float, p[m]), *map(float, q[m])) for m in range(n)]
        want[g] = (p, q)
    rows += [("g0", 0, 99, None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "pair string, part int, m int, x1 double, y1 double, x2 double, y2 double")
    model = models.MODELS[kind]
    got = {r.part: r for r in models.ransac(df, ["pair", "part"], kind, threshold=0.5, trials=None).collect()}
    assert set(got) == set(want)
    for g, (p, q) in want.items():
        r = got[g]
        assert r.n_match == len(p)
        if len(p) < model.samples:
            assert (r.status, r.m, r.n_inlier) == (1, None, 0)
            continue
        inside = plain(p, q, model, 0.5)
        assert r.members == [m for m in range(len(p)) if inside[m]] and r.n_inlier == sum(inside)
        if len(p) > 5:
            assert r.status == 0 and np.abs(np.array(r.m).reshape(3, 3) - TRUE[kind]).max() < 1.5 and r.error < 0.3


def test_fits_are_least_squares():
    p, q = matches("affine", 12, 0, 3, noise=0.5)
    w = np.random.default_rng(1).uniform(0.2, 2, 12)
    a = np.column_stack((p, np.ones(12))) * np.sqrt(w)[:, None]
    want = np.linalg.lstsq(a, q * np.sqrt(w)[:, None], rcond=None)[0].T
    assert models.affine(p[None], q[None], w[None])[0, :2] == pytest.approx(want)
    full = np.zeros((24, 4))
    full[0::2], full[1::2] = np.column_stack((p[:, 0], -p[:, 1], np.ones(12), np.zeros(12))), np.column_stack((p[:, 1], p[:, 0], np.zeros(12), np.ones(12)))
    s = np.sqrt(np.repeat(w, 2))
    x = np.linalg.lstsq(full * s[:, None], q.ravel() * s, rcond=None)[0]
    m = models.similarity(p[None], q[None], w[None])[0]
    assert (m[0, 0], m[1, 0], m[0, 2], m[1, 2]) == pytest.approx((x[0], x[1], x[2], x[3]))
    p, q = matches("projective", 7, 0, 4, noise=0.0)
    assert models.projective(p[None], q[None], np.ones((1, 7)))[0] == pytest.approx(np.array(TRUE["projective"]))


def test_samples_that_fix_nothing():
    line = np.array([[0.0, 0], [1, 1], [2, 2], [3, 3]])
    one = np.ones((1, 4))
    assert not models.MODELS["affine"].valid(models.affine(line[None], line[None], one))[0]
    assert not models.MODELS["projective"].valid(models.projective(line[None], line[None], one))[0]
    same = np.zeros((1, 2, 2))
    assert not models.MODELS["similarity"].valid(models.similarity(same, same, np.ones((1, 2))))[0]


def test_known_inliers_weights_and_stops(spark):
    p, q = matches("similarity", 40, 15, 8)
    rows = [(1, m, *map(float, p[m]), *map(float, q[m]), m in (20, 21, 22, 23), 0.0 if m == 39 else 1.0) for m in range(40)]
    df = spark.createDataFrame(rows, "k int, m int, x1 double, y1 double, x2 double, y2 double, known boolean, weight double")
    all_ = models.ransac(df, ["k"], "similarity", threshold=0.5, trials=None).first()
    assert all_.members == list(range(15, 40))
    few = models.ransac(df, ["k"], "similarity", threshold=0.5, trials=1, start_col="known", seed=3).first()
    assert set(few.members) >= set(range(20, 24)) and few.n_inlier > 20
    early = models.ransac(df, ["k"], "similarity", threshold=0.5, trials=None, stop_inliers=2).first()
    assert early.n_inlier < all_.n_inlier
    sure = models.ransac(df, ["k"], "similarity", threshold=0.5, trials=2000, probability=0.99).first()
    assert sure.n_inlier >= 20
    light = models.ransac(df, ["k"], "similarity", threshold=0.5, trials=None, weight_col="weight").first()
    assert light.members == all_.members and light.m != all_.m
    own = models.Model(1, lambda a, b, w: models.shift(a, b, w))
    assert models.ransac(df, ["k"], own, threshold=0.5).first().status in (0, 2)
    assert models.ransac(df, ["k"], "similarity", threshold=0.5, least=30).first().status == 2
    with pytest.raises(ValueError):
        models.ransac(df, ["k"], "shift", threshold=0)
    assert models.ransac(df.where("false"), ["k"], "affine").count() == 0
