import zlib

from tessera.llm import manifest
from tests.llm.brute import lower, sha

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, id int, leaf string, tree string, pos int, `group` string, path string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y", 2, "z", "p") for r in rows], SCHEMA)


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climbed(start, hashes, fan):
    """For each start: (hash at the top, siblings on the way), the start's own hash replaced by `start`; hashes: the true lowest level."""
    out = []
    for at, own in enumerate(start):
        level, sides, p = hashes, "", at
        while len(level) > 1:
            runs = [level[i : i + fan] for i in range(0, len(level), fan)]
            run, j = runs[p // fan], p % fan
            sides += "".join(run[:j] + run[j + 1 :])
            own = sha("".join([*run[:j], own, *run[j + 1 :]]))
            level, p = [sha("".join(r)) for r in runs], p // fan
        out.append((own, sides))
    return out


def plain(rows, fan=8):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = [sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in langs]
    leaves = [[leaf(r) for r in t] for t in trees]
    subroots = [climbed(t[:1], t, fan)[0][0] for t in leaves]
    root = climbed(subroots[:1], subroots, fan)[0][0]
    out = []
    for i, (t, hashes) in enumerate(zip(trees, leaves, strict=True)):
        changed = [(*r[:4], lower(r[4]) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None else r[4]) for r in t]
        for r, h, (own, sides) in zip(t, hashes, climbed([leaf(c) for c in changed], hashes, fan), strict=True):
            folded, above = climbed([own if j == i else s for j, s in enumerate(subroots)], subroots, fan)[i]
            out.append((r[0], h, subroots[i], root, sha(sides + above), folded, folded == root))
    return sorted(out, key=repr)


def got(spark, rows, parts=3, fan=8):
    docs = frame(spark, rows).repartition(parts)
    out = manifest.manifest(docs, fan=fan, changed={"text": manifest.lowered("doc_id", "text")})
    out = out.select("doc_id", "leaf", "subroot", "root", manifest.proof(out["path"]).alias("proof"), "folded_root", (out["folded_root"] == out["root"]).alias("verified"))
    return sorted(map(tuple, out.collect()), key=repr)


def test_manifest(spark):
    rows = [(i, "s", "en", 5, f"Text {i}") for i in range(130)] + [(i, None, "de", None, "ÜBER Abc") for i in range(64)] + [(i, "s", "fr", 1, None) for i in range(9)]
    rows += [(None, "s", "en", 1, "A"), (None, "s", "en", 1, "B"), (None, "s", "en", 1, "B"), (3, "s", "en", 5, "Text 3"), (3, "s", "en", 5, "Other"), (7, "s", None, 2, ""), (8, "", "", 3, "Z" * 30_000), (9, "s", "é", 1, "x"), (10, "s", "z", 1, "x")]
    want = plain(rows)
    assert got(spark, rows) == want
    assert any(not r[-1] for r in want) and any(r[-1] for r in want)


def test_shapes(spark):
    """One row, one language, a last run of one, more languages than a run holds."""
    for rows in ([(1, "s", "en", 1, "A")], [(i, "s", None, 1, "A") for i in range(65)], [(i, "s", f"l{i % 11}", i, "Ab") for i in range(40)], [(5, "s", "en", 1, "A")] * 20):
        assert got(spark, rows, 2) == plain(rows)
    rows = [(i, "s", "en", 1, "A") for i in range(9)]
    assert got(spark, rows, 4, fan=2) == plain(rows, 2)


def test_nothing(spark):
    assert got(spark, []) == []


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r[c] for c in COLUMNS) for r in docs.collect()]
    assert got(spark, rows) == plain(rows)
