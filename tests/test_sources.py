import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.sources import mosaic, tiff


def lzw(data):
    """Codes of a table that grows as it goes, the highest bit first."""
    table, size, out, bits, word = {bytes([i]): i for i in range(256)}, 9, 256, 9, b""
    n = 258

    def put(code):
        nonlocal out, bits
        out, bits = out << size | code, bits + size

    for b in data:
        one = word + bytes([b])
        if one in table:
            word = one
            continue
        put(table[word])
        table[one] = n
        n += 1
        if n == 512 or n == 1024 or n == 2048:
            size += 1
        elif n == 4094:
            put(256)
            table, n, size = {bytes([i]): i for i in range(256)}, 258, 9
        word = bytes([b])
    if word:
        put(table[word])
        n += 1
        if n in (512, 1024, 2048):
            size += 1
    put(257)
    return (out << (-bits % 8)).to_bytes((bits + 7) // 8, "big")


def packbits(data):
    return b"".join(bytes([len(data[i : i + 100]) - 1]) + data[i : i + 100] for i in range(0, len(data), 100)) + b"\x80"


def made(v, *, order="<", big=False, packing=1, predictor=1, tile=None, planes=1, strip=5, photometric=None, fmt=1, cut=0):
    """A TIFF of an array (h, w, channels), written the plain way."""
    h, w, n = v.shape
    kind = v.dtype.newbyteorder(order)
    th, tw = tile or (strip, w)
    blocks = []
    for plane in range(n if planes == 2 else 1):
        u = v[..., plane : plane + 1] if planes == 2 else v
        for top in range(0, h, th):
            for left in range(0, w, tw):
                b = u[top : top + th, left : left + tw]
                if tile:
                    b = np.pad(b, ((0, th - b.shape[0]), (0, tw - b.shape[1]), (0, 0)))
                if predictor == 2:
                    b = np.concatenate((b[:, :1], np.diff(b, axis=1)), axis=1)
                raw = b.astype(kind).tobytes()
                blocks.append({1: lambda x: x, 5: lzw, 8: zlib.compress, 32773: packbits}[packing](raw))
    word = "Q" if big else "I"
    head = 16 if big else 8
    starts = [head + sum(map(len, blocks[:i])) for i in range(len(blocks))]
    fields = [(256, 3, [w]), (257, 3, [h]), (258, 3, [8 * v.dtype.itemsize] * n), (259, 3, [packing]), (262, 3, [photometric if photometric is not None else 2 if n > 2 else 1]), (277, 3, [n]), (284, 3, [planes]), (317, 3, [predictor]), (339, 3, [fmt] * n)]
    fields += [(322, 3, [tw]), (323, 3, [th]), (324, 16 if big else 4, starts), (325, 4, [len(b) for b in blocks])] if tile else [(273, 16 if big else 4, starts), (278, 3, [strip]), (279, 4, [len(b) for b in blocks])]
    body = b"".join(blocks)
    at, tables, entries = head + len(body), b"", b""
    for tag, kind_, values in sorted(fields):
        raw = struct.pack(f"{order}{len(values)}{ {3: 'H', 4: 'I', 16: 'Q'}[kind_] }", *values)
        entry = struct.pack(order + "HH" + word, tag, kind_, len(values))
        if len(raw) > struct.calcsize(word):
            entry += struct.pack(order + word, at + len(tables))
            tables += raw
        else:
            entry += raw.ljust(struct.calcsize(word), b"\0")
        entries += entry
    where = at + len(tables)
    start = {"<": b"II", ">": b"MM"}[order] + (struct.pack(order + "HHHQ", 43, 8, 0, where) if big else struct.pack(order + "HI", 42, where))
    whole = start + body + tables + struct.pack(order + ("Q" if big else "H"), len(fields)) + entries + struct.pack(order + word, 0)
    return whole[: len(whole) - cut] if cut else whole


RNG = np.random.default_rng(11)
GREY = RNG.integers(0, 65536, (13, 17, 1)).astype(np.uint16)
SMOOTH = (np.arange(40)[:, None] * 300 + np.arange(50) * 7)[..., None].astype(np.uint16)
COLOUR = RNG.integers(0, 65536, (13, 17, 3)).astype(np.uint16)


@pytest.mark.parametrize("how", [{}, {"order": ">"}, {"big": True}, {"big": True, "order": ">", "packing": 8}, {"packing": 5}, {"packing": 5, "predictor": 2, "order": ">"}, {"packing": 8, "predictor": 2}, {"packing": 32773}, {"tile": (16, 16), "packing": 8}, {"tile": (8, 4), "packing": 5, "predictor": 2}])
def test_sixteen_bits_come_back_to_the_bit(how):
    for v in (GREY, SMOOTH, COLOUR, (GREY >> 8).astype(np.uint8), GREY.astype(np.uint32) * 65537):
        for planes in (1, 2):
            ((order, fields),) = tiff.directories(made(v, planes=planes, **how))
            assert (tiff.page(made(v, planes=planes, **how), order, fields) == v).all()


def test_floating_numbers_and_white_as_zero():
    v = RNG.random((9, 7, 1)).astype(np.float32)
    ((order, fields),) = tiff.directories(made(v, fmt=3, packing=8))
    assert (tiff.page(made(v, fmt=3, packing=8), order, fields) == v).all()
    ((order, fields),) = tiff.directories(made(GREY, photometric=0))
    assert (tiff.page(made(GREY, photometric=0), order, fields) == 65535 - GREY).all()


def test_lzw_of_long_runs():
    for data in (b"", b"a", b"ab" * 3000, bytes(RNG.integers(0, 256, 30_000).astype(np.uint8)), b"\0" * 50_000):
        assert tiff.unlzw(lzw(data)) == data


def test_files_of_a_folder(spark, tmp_path):
    files = {"a.tif": made(GREY), "b.tiff": made(COLOUR, packing=5), "c.tif": b"no image", "d.tif": made(GREY, packing=8)[:200], "e.tif": b"", "f.tif": made(GREY, fmt=3), "g.png": b"x"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: r for r in tiff.read(spark, str(tmp_path)).collect()}
    assert set(got) == set(files) - {"g.png", "e.tif"}
    a, b = got["a.tif"], got["b.tiff"]
    assert (a.height, a.width, a.n_channels, a.bits, a.status) == (13, 17, 1, 16, "ok") and a.pixels == (GREY[..., 0] / 65535.0).ravel().tolist()
    wide = COLOUR.astype(int)
    assert b.pixels == (((299 * wide[..., 0] + 587 * wide[..., 1] + 114 * wide[..., 2] + 500) // 1000) / 65535.0).ravel().tolist()
    assert all(got[n].pixels is None and got[n].status != "ok" for n in ("c.tif", "d.tif", "f.tif"))
    none = spark.createDataFrame([("x", None)], "path string, content binary")
    assert tiff.decoded(none).first().status == "no content" and tiff.decoded(none.where("false")).count() == 0


def test_several_pages_and_a_circle():
    one = made(GREY)
    where = struct.unpack_from("<I", one, 4)[0]
    n = struct.unpack_from("<H", one, where)[0]
    link = where + 2 + 12 * n
    two = one[:link] + struct.pack("<I", len(one)) + one[link + 4 :] + one[where : link + 4]
    assert len(list(tiff.directories(two))) == 2
    with pytest.raises(tiff.Unreadable):
        list(tiff.directories(one[:link] + struct.pack("<I", where)))


def test_written_files_are_read(spark):
    v = RNG.random((70, 31))
    tiles = spark.createDataFrame([("a", 70, 31, v.ravel().tolist()), ("b", 2, 2, [0.5]), ("c", None, 2, None)], "path string, height int, width int, pixels array<double>")
    for bits, most in ((8, 255), (16, 65535)):
        for compress in (True, False):
            got = {r.path: r for r in tiff.decoded(tiff.encoded(tiles, bits=bits, compress=compress)).collect()}
            assert got["a"].pixels == (np.floor(v * most + 0.5) / most).ravel().tolist() and got["a"].bits == bits
            assert got["b"].status == got["c"].status == "no content"


def drawn(tiles, layer):
    """{(y, x): value}, later names over earlier ones."""
    out = {}
    for name, la, x, y, h, w, v in sorted((t for t in tiles if t[1] == layer and t[6] is not None and t[2] is not None and len(t[6]) == t[4] * t[5]), key=lambda t: (t[0], t[3], t[2])):
        out |= {(y + k // w, x + k % w): v[k] for k in range(h * w)}
    return out


def spots(blocks):
    return {(b.y + k // b.width, b.x + k % b.width): v for b in blocks for k, v in enumerate(b.pixels) if v is not None}


@pytest.fixture(scope="module")
def laid(spark, tmp_path_factory):
    tiles = []
    for n in range(60):
        h, w = int(RNG.integers(3, 12)), int(RNG.integers(3, 12))
        tiles.append((f"t{n}", n % 3, int(RNG.integers(-20, 90)), int(RNG.integers(-20, 90)), h, w, [float(v) for v in RNG.random(h * w)]))
    tiles += [("short", 0, 5, 5, 4, 4, [1.0]), ("nowhere", 0, None, 5, 2, 2, [1.0] * 4), ("empty", 1, 5, 5, 4, 4, None)]
    df = spark.createDataFrame(tiles, f"{mosaic.TILE}, pixels array<double>")
    path = str(tmp_path_factory.mktemp("mosaic") / "m")
    mosaic.write(df, path)
    return tiles, df, path


def test_layers_come_back(spark, laid):
    tiles, _, path = laid
    m = mosaic.read(spark, path)
    for layer in range(3):
        for block in (7, 64):
            blocks = m.layer(layer, block).collect()
            assert len({(b.row, b.col) for b in blocks}) == len(blocks) and all(b.x == b.col * block and b.y == b.row * block for b in blocks)
            assert spots(blocks) == drawn(tiles, layer)
    assert m.layer(9, 10).count() == 0 and m.index.count() == len(tiles)


@pytest.mark.parametrize("region", [(0, 0, 30, 20), (-25, -25, 120, 120), (40, 41, 47, 43), (-13, 12, 1, 13)])
def test_regions_come_back(spark, laid, region):
    tiles, _, path = laid
    x0, y0, x1, y1 = region
    m = mosaic.read(spark, path)
    for block in (None, 9):
        got = m.region(1, *region, block).collect()
        want = {(y, x): v for (y, x), v in drawn(tiles, 1).items() if x0 <= x < x1 and y0 <= y < y1}
        assert spots(got) == want
        assert all(b.x >= x0 and b.y >= y0 and b.x + b.width <= x1 and b.y + b.height <= y1 for b in got)


def test_a_region_plans_its_own_files_only(spark, laid):
    _, _, path = laid
    m = mosaic.read(spark, path)
    near = mosaic.within(m.tiles, m.cell, 1, 30, 30, 40, 40)
    plan = near._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "cell_row" in plan.split("PartitionFilters: [")[1].split("]")[0]
    layer, rows, columns = 1, range(30 // m.cell - 1, 39 // m.cell + 1), range(30 // m.cell - 1, 39 // m.cell + 1)
    read = {r.f for r in near.select(F.input_file_name().alias("f")).distinct().collect()}
    every = set(m.tiles.inputFiles())
    mine = {f for f in every if f"layer={layer}/" in f and any(f"cell_row={r}/" in f for r in rows) and any(f"cell_col={c}/" in f for c in columns)}
    assert read <= mine and 0 < len(mine) < len(every) / 4


def test_sinks_keep_what_lies_there(spark, laid):
    tiles, df, path = laid
    with pytest.raises(Exception, match="(?i)exist"):
        mosaic.write(df, path)
    with pytest.raises(ValueError):
        mosaic.write(df, path + "2", cell=3)
    size = {r.layer: (r.height, r.width) for r in mosaic.size(spark, path).collect()}
    some = [t for t in tiles if t[1] == 2 and t[2] is not None]
    assert size[2] == (max(t[3] + t[4] for t in some) - min(t[3] for t in some), max(t[2] + t[5] for t in some) - min(t[2] for t in some))


def test_reading_by_what_lies_there(spark, tmp_path):
    (tmp_path / "a.tif").write_bytes(made(GREY))
    page = mosaic.read(spark, str(tmp_path / "a.tif")).first()
    assert (page.height, page.width, page.bits) == (13, 17, 16)
    assert tuple(mosaic.size(spark, str(tmp_path / "a.tif")).first()) == (0, 13, 17)


def test_patches(spark):
    v = RNG.integers(0, 256, (20, 26)).astype(float)
    images = spark.createDataFrame([("a", 20, 26, v.ravel().tolist()), ("b", 3, 4, [float(k) for k in range(12)]), ("c", 2, 2, None)], "image string, height int, width int, pixels array<double>")
    got = {}
    for r in mosaic.patches(images, 8, 5).collect():
        got.setdefault(r.image, []).append((r.n, r.x, r.y, np.array(r.pixels).reshape(r.height, r.width)))
    assert set(got) == {"a", "b"} and got["b"][0][3].shape == (3, 4)
    want = [(y, x) for y in (0, 5, 10, 12) for x in (0, 5, 10, 15, 18)]
    assert [(y, x) for _, x, y, _ in sorted(got["a"], key=lambda t: t[0])] == want
    assert all((p * 255 == pytest.approx(v[y : y + 8, x : x + 8])) for _, x, y, p in got["a"])
