import math
import random
from collections import Counter

import pytest

from tessera.llm import urls


def scores(train, given):
    """Plain Witten-Bell models of (url, side), with no bound on what they hold: the score of each given URL."""
    raw = lambda u: b"\0" * 4 + u.lower().encode() + b"\1"
    count, total, kinds = Counter(), Counter(), Counter()
    for u, side in train:
        b = raw(u)
        count.update((side, b[i - o : i + 1]) for i in range(4, len(b)) for o in range(5))
    for (side, gram), n in count.items():
        total[side, gram[:-1]] += n
        kinds[side, gram[:-1]] += 1
    out = {}
    for u in given:
        b, log = raw(u), [0.0, 0.0]
        for side in (0, 1):
            for i in range(4, len(b)):
                p = 1 / 257
                for o in range(5):
                    n, t = total[side, b[i - o : i]], kinds[side, b[i - o : i]]
                    p = (count[side, b[i - o : i + 1]] + t * p) / (n + t) if n else p
                log[side] += math.log(p)
        out[u] = (log[1] - log[0]) / (len(b) - 4)
    return out


def test_url_models_hold_all_grams(spark, monkeypatch):
    # a bound on the models' cells, here a small one, must not touch the scores
    monkeypatch.setattr(urls, "CELLS", 1 << 8, raising=False)
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(8))
    rows = [(i, f"http://{word()}.{('org/fr', 'net')[i % 2]}/{word()}") for i in range(400)] + [(i, f"http://{word()}.com/{word()}") for i in range(400, 500)]
    rows += [rows[0], rows[450], (None, rows[451][1])]
    pages = spark.createDataFrame(rows, "page_id bigint, url string").repartition(3)
    out = urls.judge(pages)
    from pyspark.sql import functions as F

    later = {x.url for x in pages.where(F.pmod(F.xxhash64("url"), F.lit(5)) == 0).collect()}
    want = scores([(u, int(".org/" in u)) for _, u in rows if ".com/" not in u and u not in later], {u for _, u in rows})
    got = sorted(((x.page_id, x.score) for x in out.collect()), key=repr)
    assert len(got) == len(rows)
    for (i, score), (j, u) in zip(got, sorted(rows, key=repr), strict=True):
        assert i == j and score == pytest.approx(want[u], rel=1e-9, abs=1e-12)


def test_url_models_and_keys_are_not_broadcast(spark):
    # the keys of a block are many times its URLs, so the driver must hold neither them nor the models, whatever Spark estimates
    rows = [(i, f"http://h{i}.{('org/fr', 'net', 'com')[i % 3]}/{i * 7919}") for i in range(300)]
    store = spark._jsparkSession.sharedState().statusStore()
    begun = {x.executionId() for x in (store.executionsList().apply(i) for i in range(store.executionsList().size()))}
    assert len(urls.judge(spark.createDataFrame(rows, "page_id bigint, url string")).collect()) == 300
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    plans = [x.physicalPlanDescription() for x in (store.executionsList().apply(i) for i in range(store.executionsList().size())) if x.executionId() not in begun]
    assert not any("Broadcast" in x for x in plans)
    assert any("SortMergeJoin" in x for x in plans)
