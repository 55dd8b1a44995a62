import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import heads, network
from tessera.sources import mosaic

RNG = np.random.default_rng(23)


def plain(x, layers):
    """Layers by loops over places and channels."""
    for layer in layers:
        h, w, n = x.shape
        if layer.kind == "relu":
            x = np.array([[[max(v, 0.0) for v in p] for p in r] for r in x])
        elif layer.kind == "pool":
            x = np.array([[[max(x[2 * r + a, 2 * c + b, k] for a in (0, 1) for b in (0, 1)) for k in range(n)] for c in range(w // 2)] for r in range(h // 2)])
        else:
            m, _, kh, kw = layer.weights.shape
            out = np.zeros((h, w, m))
            for r in range(h):
                for c in range(w):
                    for a in range(kh):
                        for b in range(kw):
                            y, z = r + a - kh // 2, c + b - kw // 2
                            if 0 <= y < h and 0 <= z < w:
                                out[r, c] += layer.weights[:, :, a, b] @ x[y, z]
            x = out + layer.bias
    return x


def small(seed=1, share=0.05):
    return network.two_heads(network.seeded(seed, share))


def test_layers_against_loops():
    net = small()
    v = RNG.random((24, 16))
    semi, vectors = net(v)
    x = plain(v[..., None], net.encoder)
    assert semi.shape == (3, 2, 65) and semi == pytest.approx(plain(x, net.detector))
    d = plain(x, net.descriptor)
    assert vectors == pytest.approx(d / np.linalg.norm(d, axis=2, keepdims=True))
    with pytest.raises(ValueError):
        network.applied(v[..., None], [network.Layer("other")])


def test_published_sizes():
    arrays = network.seeded(0)
    assert sum(a.size for a in arrays.values()) == 1_300_865 and arrays["convDb.weight"].shape == (256, 256, 1, 1)
    assert network.two_heads(arrays).reach % 8 == 0


def blocks_of(v, name, block):
    return [(name, r // block, c // block, *(p := v[r : r + block, c : c + block]).shape, p.ravel().tolist()) for r in range(0, v.shape[0], block) for c in range(0, v.shape[1], block)]


@pytest.mark.parametrize("block", [48, 56, 80])
def test_blocks_give_what_the_whole_image_gives(spark, block):
    net = small()
    images = {"a": RNG.random((136, 120)), "b": RNG.random((48, 200)), "c": RNG.random((40, 40))}
    rows = [r for name, v in images.items() for r in blocks_of(v, name, block)]
    blocks = spark.createDataFrame(rows, "image string, row int, col int, height int, width int, pixels array<double>")
    got = {(r.tile_id, r.i, r.j): r for r in network.cells_of_blocks(blocks, net, block).collect()}
    assert len(got) == sum((v.shape[0] // 8) * (v.shape[1] // 8) for v in images.values())
    for name, v in images.items():
        semi, vectors = net(v)
        for i in range(semi.shape[0]):
            for j in range(semi.shape[1]):
                r = got[name, i, j]
                assert np.abs(np.array(r.semi) - semi[i, j]).max() < 1e-9 and np.abs(np.array(r.vector) - vectors[i, j]).max() < 1e-9
    with pytest.raises(ValueError):
        network.cells_of_blocks(blocks, net, 12)


def test_a_stencil_over_a_mosaic(spark):
    """Any function of a neighbourhood: sums of 5 x 5 pixels over an image drawn from tiles."""
    v = RNG.random((37, 50))
    tiles = spark.createDataFrame([(f"t{r}{c}", 0, c, r, *(p := v[r : r + 13, c : c + 17]).shape, p.ravel().tolist()) for r in range(0, 37, 13) for c in range(0, 50, 17)], f"{mosaic.TILE}, pixels array<double>")
    blocks = mosaic.assembled(mosaic.placed(tiles, 17), 16, region=(0, 0, 50, 37)).withColumn("image", F.lit("m"))

    def of(name, frame, top, left, own_top, own_left):
        import pandas as pd

        p = np.pad(frame, 2)
        s = sum(p[a : a + frame.shape[0], b : b + frame.shape[1]] for a in range(5) for b in range(5))
        part = s[own_top - top : own_top - top + 16, own_left - left : own_left - left + 16]
        r, c = (n.ravel() for n in np.indices(part.shape))
        return pd.DataFrame({"image": name, "r": r + own_top, "c": c + own_left, "v": part.ravel()})

    got = {(x.r, x.c): x.v for x in network.with_halo(blocks, 16, 2, of, "image string, r int, c int, v double").collect()}
    p = np.pad(v, 2)
    # frames end at the block's own end as well as the image's: what lies beyond a halo is not asked for
    want = sum(p[a : a + 37, b : b + 50] for a in range(5) for b in range(5))
    assert len(got) == v.size and all(got[r, c] == pytest.approx(want[r, c]) for r, c in np.ndindex(*v.shape))


def test_weights_of_a_file(spark, tmp_path):
    arrays = network.seeded(3, 0.05)
    body = io.BytesIO()
    np.savez(body, **arrays)
    (tmp_path / "w.npz").write_bytes(body.getvalue())
    found = network.load(spark, str(tmp_path / "w.npz"))
    assert set(found) == set(arrays) and all((found[k] == arrays[k]).all() for k in arrays)


def test_keypoints_and_descriptors(spark):
    """Points of the heat map of tiles, each with the descriptor at its place, by plain numpy; quotas keep the best of each part."""
    net = small(5)
    tiles = {n: RNG.random((48, 64)) for n in (1, 2)}
    df = spark.createDataFrame([(n, v.ravel().tolist()) for n, v in tiles.items()] + [(3, None), (4, [1.0])], "tile_id int, pixels array<double>")
    found = network.cells(df, net, 48, 64).cache()
    assert {r.tile_id for r in found.select("tile_id").distinct().collect()} == {1, 2}
    points = network.keypoints(found, 48, 64, least=0.02, border=4).collect()
    assert points
    heat = {(r.tile_id, r.r, r.c): r.score for r in heads.heat_map(found.select("tile_id", "i", "j", "semi")).collect()}
    for n, v in tiles.items():
        semi, vectors = net(v)
        e = np.exp(semi)
        share = e[..., :64] / (e.sum(axis=2, keepdims=True) + 1e-5)
        flat = share.reshape(6, 8, 8, 8).transpose(0, 2, 1, 3).reshape(48, 64)
        assert all(heat[n, r, c] == pytest.approx(flat[r, c]) for r, c in np.ndindex(48, 64))
        mine = [p for p in points if p.tile_id == n]
        for p in mine:
            assert p.score == pytest.approx(flat[p.y, p.x]) and 4 <= p.x < 60 and 4 <= p.y < 44
            px, py = p.x * 8 / 64 - 0.5, p.y * 6 / 48 - 0.5
            d = np.zeros(vectors.shape[2])
            for i in (int(np.floor(py)), int(np.floor(py)) + 1):
                for j in (int(np.floor(px)), int(np.floor(px)) + 1):
                    if 0 <= i < 6 and 0 <= j < 8:
                        d += (1 - abs(py - i)) * (1 - abs(px - j)) * vectors[i, j]
            assert np.array(p.descriptor) == pytest.approx(d / np.linalg.norm(d))
    few = network.keypoints(found, 48, 64, least=0.02, border=4, blocks=2, most=8).collect()
    assert 0 < len(few) <= 16 and {(p.tile_id, p.x, p.y) for p in few} <= {(p.tile_id, p.x, p.y) for p in points}
