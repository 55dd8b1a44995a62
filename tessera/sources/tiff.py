"""TIFF files with all their bits: a reader of the format's directories, strips and tiles over (path, content) rows, one row a page.

Read are grey and colour images of 8, 16 or 32 bits unsigned or 32 or 64 bits floating, little- and big-endian, classic and big files, in strips or tiles, samples together or in planes,
without compression or by LZW, deflate or PackBits, with the horizontal predictor. Files come through Spark's binary reader (or any table of contents), so any store it
knows will do, and each file is decoded where it is read. A writer makes contents of 8 or 16 bits for sinks.

Nulls and odd files: a file that isn't such a TIFF, is cut off, or says impossible sizes has one row with null pixels and a status that says why; a null content is "no content"; files of no bytes have no row, as Spark's reader passes over them; a
page that fails leaves the other pages; an empty table gives no rows; other columns are not kept.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Numbers of fields, of their types (bytes and code of each) and of compressions, as the format defines them. Fixed values.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, STRIP_ROWS, STRIP_BYTES, PLANES, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325, 339
TYPES = {1: "B", 3: "H", 4: "I", 16: "Q"}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
#: Pixels that a page may have at most, so that a broken header can't ask for all memory.
MOST = 1 << 30
#: Pixels that are held at once before their pages are handed on.
HELD = 1 << 18

SCHEMA = "path string, page int, height int, width int, n_channels int, bits int, pixels array<double>, status string"


class Unreadable(ValueError):
    pass


def unlzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, the highest bit first; 256 starts anew, 257 ends."""
    out, table, size, held, bits, last = bytearray(), [], 9, 0, 0, b""
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFFFF, bits + 8
        if bits < size:
            continue
        bits -= size
        code = held >> bits & (1 << size) - 1
        if code == 257:
            break
        if code == 256:
            table, size, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        if not table or code > len(table) or code == len(table) and not last:
            raise Unreadable("broken LZW codes")
        word = table[code] if code < len(table) else last + last[:1]
        out += word
        if last:
            table.append(last + word[:1])
        last = word
        size = 12 if len(table) >= 2047 else 11 if len(table) >= 1023 else 10 if len(table) >= 511 else 9
    return bytes(out)


def unpacked(data: bytes) -> bytes:
    """PackBits: a count of bytes as they are, or of one repeated."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


def directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    """(byte order, fields) of each page."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8:
        raise Unreadable("not a TIFF")
    kind = struct.unpack(order + "H", data[2:4])[0]
    if kind not in (42, 43):
        raise Unreadable("not a TIFF")
    big = kind == 43
    count, step, word = ("Q", 20, "Q") if big else ("H", 12, "I")
    at, seen = struct.unpack_from(order + word, data, 8 if big else 4)[0], set()
    while at:
        if at in seen or at >= len(data):
            raise Unreadable("directories run in a circle or out of the file")
        seen.add(at)
        n = struct.unpack_from(order + count, data, at)[0]
        first = at + struct.calcsize(order + count)
        fields: dict[int, tuple] = {}
        for i in range(n):
            tag, kind_, m = struct.unpack_from(order + "HH" + word, data, first + i * step)
            if kind_ not in TYPES:
                continue
            code, place = f"{order}{m}{TYPES[kind_]}", first + i * step + 4 + struct.calcsize(order + word)
            if struct.calcsize(code) > struct.calcsize(order + word):
                place = struct.unpack_from(order + word, data, place)[0]
            fields[tag] = struct.unpack_from(code, data, place)
        yield order, fields
        at = struct.unpack_from(order + word, data, first + n * step)[0]


def page(data: bytes, order: str, fields: dict[int, tuple]) -> np.ndarray:
    """(height, width, channels) of a page, in the numbers that the file holds."""
    one = lambda tag, default: fields.get(tag, (default,))[0]
    height, width, samples, bits = one(HEIGHT, 0), one(WIDTH, 0), one(SAMPLES, 1), fields.get(BITS, (1,))
    if not 0 < height * width * samples <= MOST:
        raise Unreadable("impossible size")
    kind = {(8, 1): "u1", (16, 1): "u2", (32, 1): "u4", (32, 3): "f4", (64, 3): "f8"}.get((bits[0], one(FORMAT, 1)))
    if kind is None or len(set(bits)) > 1:
        raise Unreadable(f"{bits[0]} bits of format {one(FORMAT, 1)}")
    kind, packing, predictor, planes = np.dtype(order + kind), one(COMPRESSION, 1), one(PREDICTOR, 1), one(PLANES, 1)
    if packing not in (NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS) or predictor not in (1, 2) or one(PHOTOMETRIC, 1) not in (0, 1, 2):
        raise Unreadable(f"compression {packing}, predictor {predictor}, colours {one(PHOTOMETRIC, 1)}")
    if predictor == 2 and kind.kind == "f":
        raise Unreadable("a predictor of floating numbers")
    tiled = TILES in fields
    th, tw = (one(TILE_HEIGHT, 0), one(TILE_WIDTH, 0)) if tiled else (min(one(STRIP_ROWS, height), height), width)
    offsets, counts = fields.get(TILES if tiled else STRIPS, ()), fields.get(TILE_BYTES if tiled else STRIP_BYTES, ())
    if th < 1 or tw < 1:
        raise Unreadable("impossible strips")
    down, across = -(-height // th), -(-width // tw)
    depth, rounds = (1, samples) if planes == 2 else (samples, 1)
    if len(offsets) != down * across * rounds or len(counts) != len(offsets):
        raise Unreadable("strips are missing")
    out = np.zeros((height, width, samples), kind.newbyteorder("="))
    for i, (start, n) in enumerate(zip(offsets, counts, strict=True)):
        plane, at = divmod(i, down * across)
        top, left = at // across * th, at % across * tw
        rows = th if tiled else min(th, height - top)
        raw = data[start : start + n]
        if len(raw) < n:
            raise Unreadable("the file is cut off")
        raw = raw if packing == NONE else unlzw(raw) if packing == LZW else unpacked(raw) if packing == PACKBITS else zlib.decompress(raw)
        if len(raw) < rows * tw * depth * kind.itemsize:
            raise Unreadable("a strip is too short")
        block = np.frombuffer(raw, kind, rows * tw * depth).reshape(rows, tw, depth).astype(kind.newbyteorder("="))
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=block.dtype)
        part = block[: height - top, : width - left]
        if planes == 2:
            out[top : top + part.shape[0], left : left + part.shape[1], plane] = part[..., 0]
        else:
            out[top : top + part.shape[0], left : left + part.shape[1]] = part
    if one(PHOTOMETRIC, 1) == 0 and kind.kind == "u":  # white is zero
        out = np.iinfo(out.dtype).max - out
    return out


def grey(v: np.ndarray) -> np.ndarray:
    """From 0 to 1 (floating numbers as they are), colours by their weights in whole thousandths."""
    if v.dtype.kind == "f":
        return v[..., :3].astype(float) @ np.array([0.299, 0.587, 0.114]) if v.shape[2] >= 3 else v[..., 0].astype(float)
    wide = v.astype(np.int64)
    one = (299 * wide[..., 0] + 587 * wide[..., 1] + 114 * wide[..., 2] + 500) // 1000 if v.shape[2] >= 3 else wide[..., 0]
    return one / float(np.iinfo(v.dtype).max)


def decoded(files: DataFrame) -> DataFrame:
    """(path, page, height, width, n_channels, bits, pixels: grey values, row-major, status) of (path, content), a row for each page."""

    def rows(path: str, data: bytes | None) -> Iterator[tuple]:
        number = 0
        try:
            if data is None:
                raise Unreadable("no content")
            for order, fields in directories(data):
                try:
                    v = page(data, order, fields)
                    yield path, number, *v.shape, 8 * v.dtype.itemsize, grey(v).ravel(), "ok"
                except (Unreadable, zlib.error, struct.error, ValueError) as error:
                    yield path, number, None, None, None, None, None, str(error) or "unreadable"
                number += 1
            if not number:
                raise Unreadable("no pages")
        except (Unreadable, struct.error) as error:
            yield path, number, None, None, None, None, None, str(error)

    def table(found: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(found, columns=["path", "page", "height", "width", "n_channels", "bits", "pixels", "status"])
        return out.astype({c: "Int32" for c in ("height", "width", "n_channels", "bits")})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found, held = [], 0
            for path, content in zip(batch["path"], batch["content"], strict=True):
                for row in rows(path, content):
                    found.append(row)
                    held += 0 if row[6] is None else len(row[6])
                    if held >= HELD:
                        yield table(found)
                        found, held = [], 0
            if found:
                yield table(found)

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def read(spark: SparkSession, folder: str, pattern: str = "*.tif*") -> DataFrame:
    """decoded() of a folder's files."""
    return decoded(spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content"))


def written(v: np.ndarray, *, strip: int = 64, compress: bool = True) -> bytes:
    """A grey image of 8 or 16 bits as a little-endian file: strips by deflate with the horizontal predictor, or as they are."""
    if v.dtype not in (np.uint8, np.uint16) or v.ndim != 2 or not v.size:
        raise ValueError("a grey image of 8 or 16 bits is wanted")
    h, w = v.shape
    bits = 8 * v.dtype.itemsize
    parts = []
    for top in range(0, h, strip):
        block = v[top : top + strip]
        raw = np.diff(block, axis=1, prepend=np.zeros((len(block), 1), v.dtype)) if compress else block
        raw = raw.astype(v.dtype.newbyteorder("<")).tobytes()
        parts.append(zlib.compress(raw, 6) if compress else raw)
    sizes = [len(p) for p in parts]
    starts = np.cumsum([8, *sizes])[:-1].tolist()
    body = b"".join(parts)
    body += b"\0" * (len(body) % 2)
    tables, at = b"", 8 + len(body)
    fields = [(WIDTH, 4, (w,)), (HEIGHT, 4, (h,)), (BITS, 3, (bits,)), (COMPRESSION, 3, (DEFLATE if compress else NONE,)), (PHOTOMETRIC, 3, (1,)), (STRIPS, 4, starts), (SAMPLES, 3, (1,)), (STRIP_ROWS, 4, (strip,)), (STRIP_BYTES, 4, sizes), (PREDICTOR, 3, (2 if compress else 1,)), (FORMAT, 3, (1,))]
    entries = b""
    for tag, kind, values in fields:
        raw = struct.pack(f"<{len(values)}{TYPES[kind]}", *values)
        if len(raw) > 4:
            entries += struct.pack("<HHII", tag, kind, len(values), at + len(tables))
            tables += raw
        else:
            entries += struct.pack("<HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
    return b"II" + struct.pack("<HI", 42, at + len(tables)) + body + tables + struct.pack("<H", len(fields)) + entries + struct.pack("<I", 0)


def encoded(tiles: DataFrame, *, bits: int = 16, strip: int = 64, compress: bool = True) -> DataFrame:
    """(path, content) of (path, height, width, pixels: grey values, cut off to 0 and 1); null content where pixels aren't whole."""
    if bits not in (8, 16):
        raise ValueError("bits are 8 or 16")
    kind = np.uint16 if bits == 16 else np.uint8

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, h, w, pixels in zip(*(batch[c] for c in ("path", "height", "width", "pixels")), strict=True):
                v = None if pixels is None or pd.isna(h) or pd.isna(w) or len(pixels) != h * w or not h * w else np.asarray(pixels, float)
                whole = v is not None and np.isfinite(v).all()
                out.append((path, written(np.floor(np.clip(v, 0, 1) * np.iinfo(kind).max + 0.5).astype(kind).reshape(int(h), int(w)), strip=strip, compress=compress) if whole else None))
            yield pd.DataFrame(out, columns=["path", "content"])

    return tiles.select("path", "height", "width", "pixels").mapInPandas(run, "path string, content binary")
