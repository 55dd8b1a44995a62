import math
import random

import numpy as np

from pyspark.sql import functions as F
from tessera.llm import languages

SCHEMA = "doc_id bigint, text string, lang string, id int, label string, share int, score string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "l", 2, "s") for r in rows], SCHEMA)


def corpus(n=240):
    r = random.Random(5)
    sounds = {"aa": ["ka", "ro", "mi", "tu"], "bb": ["sch", "ei", "nd", "ung"], "cc": ["é", "eau", "oi", "qu"]}
    out = []
    for i in range(n):
        lang = r.choice(list(sounds))
        out.append((i, " ".join("".join(r.choice(sounds[lang]) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(3, 40))), lang))
    return out


def judged(spark, rows):
    table = frame(spark, rows).repartition(3)
    out = languages.identify(table, languages.learn(table)).select("doc_id", languages.held_out("doc_id").alias("held_out"), "lang_pred", "score")
    return out.collect()


def test_held_out_rows(spark):
    rows = corpus() + [(1000, None, "aa"), (1001, " 12 ,. \n", "bb"), (1002, "", None), (None, "karo mitu karo", "cc"), (1003, "kakaro tumi karo", None), (1003, "kakaro tumi karo", None)]
    rows += [(1004, "eau qué " * 20_000, None)]
    got = judged(spark, rows)
    assert len(got) == len(rows)
    lang = {i: x for i, _, x in rows}
    tested = [r for r in got if r["held_out"] and r["doc_id"] < 1000]
    assert tested and sum(r["lang_pred"] == lang[r["doc_id"]] for r in tested) >= 0.97 * len(tested)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["lang_pred"], r["score"]))
        assert 0 <= r["score"] <= 1 and r["held_out"] is not None
    assert by[1000] == by[1001] == by[1002] == [("und", 0.0)]
    assert by[None][0][0] == "aa" and by[1003][0] == by[1003][1] and by[1003][0][0] == "aa" and by[1004][0][0] == "cc"


def test_held_out_labels_and_other_columns_are_not_read(spark):
    """Wrong languages of held-out rows change nothing, nor does the order of rows."""
    rows = corpus()
    out = {r["doc_id"]: r["held_out"] for r in frame(spark, rows).select("doc_id", languages.held_out("doc_id").alias("held_out")).collect()}
    changed = [(i, t, "aa" if out[i] else x) for i, t, x in reversed(rows)]
    assert sorted(map(tuple, judged(spark, rows))) == sorted(map(tuple, judged(spark, changed)))


def test_few_labels(spark):
    none = [(i, "abc def", None) for i in range(5)]
    assert {(r["lang_pred"], r["score"]) for r in judged(spark, none)} == {("und", 0.0)}
    one = [(i, "abc def", "xx") for i in range(20)] + [(50, "12", "xx")]
    assert {(r["lang_pred"], r["score"]) for r in judged(spark, one)} == {("xx", 1.0), ("und", 0.0)}
    assert judged(spark, []) == []


def test_letters_and_cells():
    text = "Ab1-Ü中  x"
    plain = " ab ü中 x "
    assert "".join(map(chr, languages.letters(text))) == plain
    found, counts = languages.cells(text)
    assert counts.sum() == sum(len(plain) - k + 1 for k in languages.ORDERS) and list(found) == sorted(set(found))
    assert len(languages.cells("!? 12")[0]) == len(languages.cells(None)[0]) == 0


def test_frequencies(spark):
    texts = [t for _, t, _ in corpus(50)] + [None, "1"]
    df, n = languages.frequencies(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    want = np.zeros(languages.CELLS, int)
    for t in texts:
        want[languages.cells(t)[0]] += 1
    assert n == 50 and (df == want).all()


def test_fit_equals_plain_loops():
    """The vectorised learner against one coordinate at a time, as the method is published."""
    r = np.random.default_rng(1)
    rows = [(np.sort(r.choice(12, 4, replace=False)).astype(np.uint16), r.random(4)) for _ in range(30)]
    labels = r.integers(0, 3, 30)
    rate, smooth, l1, l2 = 0.7, 0.3, 0.15, 0.4
    z, n = {}, {}

    def weight(i, c):
        a, b = (l1, l2) if i != languages.CELLS else (0.0, 0.0)
        x = z.get((i, c), 0.0)
        return 0.0 if abs(x) <= a else -(x - math.copysign(a, x)) / ((smooth + math.sqrt(n.get((i, c), 0.0))) / rate + b)

    order = np.random.default_rng(7)
    for _ in range(2):
        for k in order.permutation(30):
            x = [*zip(map(int, rows[k][0]), rows[k][1], strict=True), (languages.CELLS, 1.0)]
            w = {(i, c): weight(i, c) for i, _ in x for c in range(3)}
            e = [math.exp(sum(v * w[i, c] for i, v in x)) for c in range(3)]
            for c in range(3):
                for i, v in x:
                    g = v * (e[c] / sum(e) - (c == labels[k]))
                    old = n.get((i, c), 0.0)
                    z[i, c] = z.get((i, c), 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / rate * w[i, c]
                    n[i, c] = old + g * g
    got = languages.fit(rows, labels, 3, rate=rate, smooth=smooth, l1=l1, l2=l2, epochs=2)
    for i in [*range(12), languages.CELLS]:
        for c in range(3):
            assert math.isclose(got[i, c], weight(i, c), abs_tol=1e-9)
    assert (got[:12] == 0).any() and not got[12 : languages.CELLS].any()


def test_temperature():
    """Logits three times too large come back by a divisor near three."""
    r = np.random.default_rng(2)
    z = r.normal(0, 1.5, (20_000, 4))
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    labels = (p.cumsum(axis=1) > r.random((len(z), 1))).argmax(axis=1)
    assert abs(languages.temperature(3 * z, labels) - 3) < 0.15
    assert languages.temperature(np.empty((0, 3)), np.empty(0, int)) == 1.0
    sure = np.array([[5.0, 0], [0, 5.0]] * 10)
    assert 0.9 < 1 / (1 + math.exp(-5 / languages.temperature(sure, np.array([0, 1] * 10)))) < 0.99


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = languages.identify(docs, languages.learn(docs)).join(docs.select("doc_id", "lang"), "doc_id").where(languages.held_out("doc_id"))
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.99
