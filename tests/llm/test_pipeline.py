import os
import random

import pytest

import corpus_pipeline
from tessera.llm import secrets
from tessera.llm.queries import MODEL
from tests.llm import brute

KIND = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def text(r, n=40):
    return " ".join(f"w{r.randrange(10**7)}" for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], KIND).repartition(3)


def test_near_duplicates_keeps_rows_not_ids(spark):
    r = random.Random(6)
    a, b, c, d, e, f, g, h = (text(r) for _ in range(8))
    rows = [(None, a, "x"), (None, b, "x"), (1, c, "x"), (1, d, "x"), (None, None, "x"), (None, None, "x"), (2, " ", "x")]  # no copies
    rows += [(5, e, "x"), (7, e + " more", "x"), (7, f, "x")]  # 7 is a copy of 5 in one row only
    rows += [(None, g, "x"), (None, g, "x"), (None, g + " more", "x")]  # copies, all of null ids
    rows += [(None, h, "x"), (9, h, "z"), (9, h, "y"), (9, h, "y")]  # the id goes before the null
    out = [(x.doc_id, x.text) for x in corpus_pipeline.near_duplicates(spark, frame(spark, rows), "").collect()]
    free = [(i, t) for i, t, _ in rows[:7]] + [(5, e), (7, f), (9, h)]
    one = [x for x in out if x[0] is None and x[1] is not None and x[1].startswith(g)]
    assert len(one) == 1
    assert sorted((x for x in out if x not in one), key=repr) == sorted(free, key=repr)


def test_secrets_of_null_ids_are_redacted(spark):
    real = "q7Zk29XwLm41TbVr83NcYd60"
    docs = frame(spark, [(None, f"set api_key={real} now", "x"), (None, "plain words", "x"), (1, f"token: {real}", "x")])
    for out in (secrets.redact(docs, secrets.scan(docs)), corpus_pipeline.secret_scans(spark, docs, "")):
        texts = [x.text for x in out.collect()]
        assert len(texts) == 3 and real not in "".join(texts) and "plain words" in texts


def write_tables(spark, path, docs, bench):
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], KIND).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")


@pytest.mark.skipif(not os.path.exists(MODEL), reason="no public tokenizer here")
def test_whole_run_against_brute_force(spark, tmp_path):
    """Quality by the base rule (no labels), near copies, benchmark passages, one secret and pieces, in plain Python and the public library."""
    import sentencepiece

    r = random.Random(13)
    bench = [(1, text(r, 30)), (2, "short item here"), (3, None)]
    base, secret = text(r, 60), "q7Zk29XwLm41TbVr83NcYd60"
    near = base.split()
    near[5] = "other"
    docs = [(i, text(r, 40)) for i in range(10)] + [(20, base), (21, base), (22, " ".join(near)), (None, base), (None, text(r, 50)), (None, text(r, 50)), (None, None), (30, None), (31, ""), (32, "too short")]
    docs += [(40, text(r, 30)), (40, text(r, 30)), (41, f"{text(r, 30)} {bench[0][1][:120]} {text(r, 5)}"), (42, f"{text(r, 25)} Short, item HERE {text(r, 5)}"), (43, f"{text(r, 25)} api_key={secret} {text(r, 5)}")]
    docs += [(44, "a b c d e f g h " * 9), (45, text(r, 40)), (45, docs[0][1] + " more")]
    write_tables(spark, str(tmp_path), docs, bench)

    counts = [brute.quality_counts(t) for _, t in docs]
    left = [d for d, c in zip(docs, counts, strict=True) if c[0] >= 20 and 100 * c[4] <= 30 * c[0]]
    sets = [brute.shingles(t, 5) for _, t in left]
    order = sorted(range(len(left)), key=lambda i: (left[i][0] is None, left[i][0] or 0))
    group = list(range(len(left)))
    for _ in left:  # labels settle in as many rounds as there are rows at most
        for i in range(len(left)):
            for j in range(len(left)):
                if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    group[i] = group[j] = min(group[i], group[j])
    left = [left[next(i for i in order if group[i] == g)] for g in sorted(set(group))]
    left = [(i, t) for i, t in left if not brute.contaminated(t, [b for b in bench if b[1]])[1]]
    left = [(i, t.replace(secret, "[SECRET]")) for i, t in left]
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = sorted(((i, library.encode(t)) for i, t in left), key=repr)
    got = sorted(((x.doc_id, x.ids) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()), key=repr)
    assert got == want and {43, 45, 40, 20, None} <= {i for i, _ in got} and not {21, 22, 41, 42, 44, 30} & {i for i, _ in got}


@pytest.mark.skipif(not os.path.exists(MODEL), reason="no public tokenizer here")
def test_run_of_empty_tables(spark, tmp_path):
    write_tables(spark, str(tmp_path), [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_stages_keep_columns_of_any_name_and_type(spark):
    """Columns named like those that stages use, a map, and no n_chars: none is lost or changed."""
    r = random.Random(8)
    base, other = text(r), text(r)
    kind = "doc_id bigint, text string, lang string, `__key` string, `key` int, `row` string, `d` double, `__id` int, tags map<string,int>, `a.b` string, component_id int"
    rows = [(i, t, "en", f"k{i}", i, "r", 0.5, 7, {"x": i}, "dot", 3) for i, t in ((1, base), (2, base), (3, other), (None, None))]
    docs = spark.createDataFrame(rows, kind)
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert out.columns == docs.columns and sorted(map(tuple, out.collect()), key=repr) == sorted((rows[i] for i in (0, 2, 3)), key=repr)
    out = corpus_pipeline.secret_scans(spark, docs, "")
    assert out.columns == docs.columns and sorted(map(tuple, out.collect()), key=repr) == sorted(rows, key=repr)
