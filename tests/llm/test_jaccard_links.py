import random

from tessera.llm import common as C
from tessera.llm import jaccard
from tests.llm import brute


def test_every_link_counts(spark):
    r = random.Random(9)
    base = [f"w{r.randrange(10**6)}" for _ in range(60)]
    rows = [(None, "a b c d e"), (100, None), (101, ""), (102, None), (103, "alone in the world today")]
    for i in range(25):
        w = list(base)
        for _ in range(r.randrange(3)):
            w[r.randrange(60)] = f"n{r.randrange(3)}"
        rows.append((i, " ".join(w)))
    rows += [(200, " ".join(base)), (200, " ".join(base).upper()), (None, "A b c d e")]
    sets = [brute.shingles(t, 4) for _, t in rows]
    links = [sum(i != j and 100 * len(s & z) >= 85 * len(s | z) for j, z in enumerate(sets)) if s else 0 for i, s in enumerate(sets)]
    want = sorted(((i, *c, n) for (i, _), c, n in zip(rows, brute.classes(rows, 4, 85), links, strict=True)), key=repr)
    for how in ({}, {"hot": 2, "block": 4}, {"hot": 5, "block": 512}, {"hot": 1000}):
        out = jaccard.join(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), **how)
        assert sorted(((x.doc_id, x.n_shingles, x.component_id, x.n_links) for x in out.collect()), key=repr) == want


def test_one_shingle_in_many_unlike_texts(spark):
    r = random.Random(10)
    word = lambda: f"w{r.randrange(10**6)}"
    rows = [(i, f"one very common line {word()} {word()}") for i in range(2000)]
    rows += [(5000 + i, f"one very common line of a family of texts with a different end {i % 4}") for i in range(40)]
    sets = [brute.shingles(t, 4) for _, t in rows]
    links = [sum(i != j and 100 * len(s & z) >= 85 * len(s | z) for j, z in enumerate(sets)) if i >= 2000 else 0 for i, s in enumerate(sets)]
    out = {x.doc_id: (x.component_id, x.n_links) for x in jaccard.join(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()}
    assert all(out[i] == (i, 0) for i in range(2000))
    assert [out[5000 + i][1] for i in range(40)] == links[2000:]
    for rounds in ((1, 16), ()):
        few = jaccard.components(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), rounds=rounds, block=100)
        assert {x.doc_id: x.component_id for x in few.collect()} == {i: c for i, (c, _) in out.items()}


def chain(r, length, step):
    """Texts that drift: each is linked with its next ones only."""
    words = [f"c{r.randrange(10**6)}" for _ in range(length + 200)]
    return [" ".join(words[i * step : i * step + 200]) for i in range(length // step)]


def test_leaders_find_all_components(spark):
    """Families that hot shingles share, drifting texts, stragglers that are linked with a few members only; by leaders, by blocks, by both."""
    r = random.Random(12)
    line = [f"l{i}" for i in range(40)]
    texts = chain(r, 300, 5) + chain(r, 100, 40)
    for f in range(3):
        base = line[:30] + [f"b{f}-{i}" for i in range(90)]
        for i in range(45):
            w = list(base)
            for _ in range(r.randrange(1 + i // 8)):
                w[r.randrange(len(w))] = f"n{r.randrange(50)}"
            texts.append(" ".join(w))
    texts += [" ".join(line + [f"u{r.randrange(10**6)}" for _ in range(6)]) for _ in range(60)]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    want = sorted((i, *c) for (i, _), c in zip(rows, brute.classes(rows, 4, 85), strict=True))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).cache()
    for how in ({"hot": 2}, {"hot": 2, "rounds": (), "block": 3}, {"hot": 1, "rounds": (2, 40)}):
        got = sorted((x.doc_id, x.n_shingles, x.component_id) for x in jaccard.components(docs, **how).collect())
        assert got == want, how


def test_work_grows_with_a_family(spark):
    """A few rows of work a near copy, whatever their number: no family is compared with itself."""
    r = random.Random(13)
    base = [f"w{r.randrange(10**6)}" for _ in range(120)]

    def work(size):
        rows = []
        for i in range(size):
            w = list(base)
            w[r.randrange(120)] = f"n{i}"
            rows.append((i, " ".join(w)))
        docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
        scratch = C.Scratch(spark)
        nodes, cells = jaccard.measure(docs.withColumnRenamed("doc_id", "id"), 4)
        lists = jaccard.prefixes(docs.select("text"), cells, 4, 85, scratch)
        entries = jaccard.shared_entries(lists, 32, scratch)
        hot = jaccard.hot_nodes(entries, lists)
        _, apart = jaccard.known_components(hot, spark.createDataFrame([], "a bigint, b bigint"), scratch)
        led = jaccard.led_pairs(apart, 1, 85)
        n = led.count()
        _, apart = jaccard.known_components(hot, led.select("a", "b"), scratch)
        return n, apart.count()

    for size in (300, 3000):
        pairs, left = work(size)
        assert left == 0 and size - 1 <= pairs <= 4 * size
