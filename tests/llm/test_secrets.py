import random

import pytest

from tessera.llm import secrets

FORMS = [
    "password={}", "password = {}", "password: {}", "password : {}", "password ={}", "password := {}", "password1={}", "password_2: {}",
    '{{"password":"{}"}}', '"password": "{}"', '"password" : "{}"', "{{'password': '{}'}}", '{{"user":"bob","password":"{}"}}',
    '{{"password":"{}","user":"bob"}}', "DB_PASSWORD={}", "http://h.org/?user=bob&password={}", "config['password']={}", "password => {}",
]


@pytest.mark.parametrize("value", ["Tr0ub4dor9", "x9Kq2m"])
def test_short_values_in_common_forms(spark, value):
    rows = [(i, f"see {f.format(value)} here") for i, f in enumerate(FORMS)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = secrets.scan(docs, path_col=None)
    values = {(r.doc_id, r.value): r.secret for r in found.collect()}
    assert [FORMS[i] for i, _ in rows if (i, value) not in values] == []
    assert [FORMS[i] for i, _ in rows if not values[i, value]] == []
    assert all(value not in r.text for r in secrets.redact(docs, found).collect())


def test_two_credentials_in_a_word(spark):
    docs = spark.createDataFrame([(1, '{"password":"Tr0ub4dor9","token":"x9Kq2mZ7pw"}')], "doc_id bigint, text string")
    found = secrets.scan(docs, path_col=None).collect()
    assert {(r.name, r.value, r.secret) for r in found} == {("password", "Tr0ub4dor9", True), ("token", "x9Kq2mZ7pw", True)}


def test_plain_words_after_a_name_are_left(spark):
    texts = ["author: Johnson", "password: required", "keyword: science", "secret: nobody", "token: string", "the key: understanding", "Authors: Matthews"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert [r.value for r in secrets.scan(docs, path_col=None).where("secret").collect()] == []


def test_held_out_findings(spark):
    """Secrets and decoys in contexts that the labelled findings don't hold: other names, other places."""
    r = random.Random(21)
    words = ["".join(r.choice("bdklmnprst") + r.choice("aeiou") for _ in range(3)) for _ in range(200)]
    key = lambda n, a: "".join(r.choice(a) for _ in range(n))
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    rows, secret = [], {}
    for i in range(400):
        w = [r.choice(words) for _ in range(40)]
        kind = i % 8
        value = [key(32, letters), key(40, "0123456789abcdef"), key(10, letters) + "7", key(40, "0123456789abcdef"), f"{r.choice(words)}_{r.choice(words)}_2", "/" + "/".join(r.sample(words, 3)) + "/x1.html", r.choice(words).title(), key(24, letters) + "9"][kind]
        w[20:20] = [[f"svc_token={value}"], ["dbSecret:", value], [f"login_pwd={value}"], ["commit", value], ["see", value], ["at", value], ["password:", value], [f"bearer={value}"]][kind]
        rows.append((i, "  " + " ".join(w), "notes"))
        secret[i, value] = kind in (0, 1, 2, 7)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    said = {(x.doc_id, x.value): (x.secret, x.word_no) for x in secrets.scan(docs).collect()}
    hit = [k for k, yes in secret.items() if yes and said.get(k, (False,))[0]]
    wrong = [k for k, yes in secret.items() if not yes and said.get(k, (False,))[0]]
    assert len(hit) >= 0.9 * sum(secret.values()) and len(wrong) <= 0.1 * len(hit)
    assert all(said[k][1] in (20, 21) for k in hit)


def test_a_value_inside_a_longer_word_stays(spark):
    docs = spark.createDataFrame([(1, "password=Zx81qp and aZx81qpb Zx81qp.", 1, 2)], "doc_id bigint, text string, __id int, __values int")
    found = spark.createDataFrame([(1, "Zx81qp", True)], "doc_id bigint, value string, secret boolean")
    assert secrets.redact(docs, found).collect() == [(1, "password=[SECRET] and aZx81qpb [SECRET].", 1, 2)]


def test_rows_of_one_id_have_their_own_secrets(spark):
    """Repeated and null ids: each row is searched for the secrets of its own text only."""
    rows = [(1, "password=Tr0ub4dor9 stays x9Kq2mZ7pw"), (1, "token=x9Kq2mZ7pw stays Tr0ub4dor9"), (None, "password=Zx81qpTTa"), (None, "see Zx81qpTTa"), (None, None), (1, "password=Tr0ub4dor9 stays x9Kq2mZ7pw")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = [(r.doc_id, r.text) for r in secrets.redact(docs, secrets.scan(docs, path_col=None)).collect()]
    one = (1, "password=[SECRET] stays x9Kq2mZ7pw")
    assert sorted(out, key=repr) == sorted([one, one, (1, "token=[SECRET] stays Tr0ub4dor9"), (None, "password=[SECRET]"), (None, "see Zx81qpTTa"), (None, None)], key=repr)


def test_recall_of_the_gate(spark):
    """Every form of key is a candidate, letters alone too; most are found to be secrets, and long words are not."""
    r = random.Random(4)
    upper, both = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    make = {
        "capitals": lambda: "AKIA" + "".join(r.choice(upper) for _ in range(16)), "letters": lambda: "".join(r.choice(both) for _ in range(40)),
        "hex": lambda: "".join(r.choice("0123456789abcdef") for _ in range(40)), "mixed": lambda: "".join(r.choice(both + "0123456789") for _ in range(32)),
        "small": lambda: "".join(r.choice(both[:26]) for _ in range(32)),
    }
    rows, want = [], {}
    for i in range(200):
        form = list(make)[i % len(make)]
        value = make[form]()
        rows.append((i, f"some words before the key {value} and after"))
        want[i] = (form, value)
    words = ["Donaudampfschifffahrtsgesellschaft", "internationalization", "misunderstandings", "INTERNATIONALIZATION", "getElementByName"]
    rows += [(1000 + i, f"some words such as {w} in a text") for i, w in enumerate(words)]
    found = {(x.doc_id, x.value): x.secret for x in secrets.scan(spark.createDataFrame(rows, "doc_id bigint, text string"), path_col=None).collect()}
    share = {f: [(i, v) in found for i, (g, v) in want.items() if g == f] for f in make}
    assert {f: sum(x) / len(x) for f, x in share.items()} == dict.fromkeys(make, 1.0)
    assert sum(found[i, v] for i, (_, v) in want.items()) >= 0.8 * len(want)
    assert not any(yes for (i, _), yes in found.items() if i >= 1000)


def plain_forest(model, x):
    """Mean of the trees' shares of secrets, by walking their printed nodes."""
    shares = []
    for tree in model.trees:
        node = tree._call_java("rootNode")
        while node.subtreeDepth() > 0:
            split = node.split()
            node = node.leftChild() if x[split.featureIndex()] <= split.threshold() else node.rightChild()
        stats = list(node.impurityStats().stats())
        shares.append(stats[1] / sum(stats))
    return sum(shares) / len(shares)


def plain_features(v, covered):
    """Length, transitions, digits and distinct of a value, by loops."""
    kind = ["a" if "a" <= c <= "z" else "B" if "A" <= c <= "Z" else "0" if "0" <= c <= "9" else "-" for c in v]
    changes = sum(a != b for a, b in zip(kind, kind[1:]))
    pairs = sum(f" {v[i : i + 2].lower()} " in secrets.COMMON_PAIRS for i in range(len(v) - 1))
    return [len(v), changes / len(v), kind.count("0") / len(v), len(set(v)) / len(v), pairs / len(v), covered / len(v)]


def test_scores_by_walking_the_trees(spark):
    """Features by loops and a walk over the fitted trees give each candidate's score."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    words = secrets.dictionary(docs)
    known = {r.word for r in words.collect()}
    model = secrets.train(secrets.findings(spark, words=sorted(known)[:100]), words)
    found = secrets.measured(secrets.covered(secrets.candidates(docs, id_col="doc_id", text_col="text", path_col="source"), words)).collect()
    assert found
    from pyspark.ml.linalg import Vectors
    import re

    for r in found:
        covered = sum(len(w) for w in re.findall(secrets.RUNS, r.value) if w.lower() in known)
        mine = plain_features(r.value, covered)
        assert [round(r[f], 9) for f in secrets.FEATURES[:6]] == [round(x, 9) for x in mine]
        x = [r[f] for f in secrets.FEATURES]
        assert abs(model.predictProbability(Vectors.dense(x))[1] - plain_forest(model, x)) < 1e-9
