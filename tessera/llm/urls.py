"""URL filters: rules by host and path, and a ratio of character language models for what no rule decides.

URLs that a rule allows or blocks train two variable-order Markov models (contexts of 0 to 4 bytes, Witten-Bell smoothing:
each order falls back on the next lower one by its number of distinct continuations). A URL's score is the difference of its
log-likelihoods under both, divided by its length; the threshold is the one that best separates a fifth of the rule-decided
URLs that the models have not seen; all others of them are counted. The models are tables of exact counts by 64-bit hash that grow
with the input. URLs are scored in blocks: the distinct grams and contexts of a block are joined with the tables, and what
is found goes to the block. No model is broadcast or sent to the driver.

Nulls, ties and odd rows: a null URL or one without `://` has empty host and path and fits no rule; of rules of equal length
that fit, the first wins; without URLs of both kinds the method allows; URLs are judged row by row; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from tessera.llm import common as C

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
ORDERS = 5
#: URLs of a block, and base-2 logarithm of the most rows that a partition's numbers leave room for.
BLOCK, ROOM = 4096, 33
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BINS, REACH = 2048, 8.0


def parts(urls: DataFrame, url_col: str) -> DataFrame:
    """Adds host and path."""
    rest = F.when(F.instr(url_col, "://") > 0, F.expr(f"substring(`{url_col}`, instr(`{url_col}`, '://') + 3)")).otherwise("")
    return (
        urls.withColumn("__rest", F.coalesce(rest, F.lit("")))
        .withColumn("host", F.translate(F.regexp_extract("__rest", r"^([^/?#]*)", 1), UPPER, LOWER))
        .withColumn("path", F.regexp_extract("__rest", r"^[^/?#]*([^?#]*)", 1))
        .drop("__rest")
    )


def with_rule(urls: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Adds rule (host and path of the longest that fits) and its verdict."""
    out, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # of conditions tried in this order the last fitting one in the chain is the longest
    for kind, host, path in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        out, verdict = F.when(fits, F.lit(host + path)).otherwise(out), F.when(fits, F.lit(kind)).otherwise(verdict)
    return urls.withColumn("rule", out).withColumn("__said", verdict)


def grams(url: str | None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order: hashes of (context and byte) and of the context, for each byte and the end."""
    raw = np.frombuffer(b"\0" * (ORDERS - 1) + (url or "").encode("utf-8", "surrogatepass").translate(C.LOWER) + b"\1", np.uint8).astype(np.uint64) + np.uint64(3)
    n = len(raw) - ORDERS + 1
    out = []
    for o in range(ORDERS):
        whole = C.gram_hashes(raw[ORDERS - 1 - o :], o + 1)[:n] ^ np.uint64(o + 1)
        context = C.gram_hashes(raw[ORDERS - 1 - o : len(raw) - 1], o)[:n] ^ np.uint64(o + 101) if o else np.full(n, 100, np.uint64)
        out.append((whole, context))
    return out


def count_grams(urls: DataFrame) -> DataFrame:
    """(side, gram, context, n) over (url, side), summed within batches first."""

    def rows(batch: pa.RecordBatch) -> dict:
        out: list[list[np.ndarray]] = [[], [], [], []]
        sides = np.array(batch.column(1).to_pylist())
        every = [grams(u) for u in batch.column(0).to_pylist()]
        for side in (0, 1):
            some = [g for g, s in zip(every, sides, strict=True) if s == side]
            for o in range(ORDERS if some else 0):
                gram, first, n = np.unique(np.concatenate([g[o][0] for g in some]), return_index=True, return_counts=True)
                for column, value in zip(out, (np.full(len(gram), side), gram.view(np.int64), np.concatenate([g[o][1] for g in some])[first].view(np.int64), n), strict=True):
                    column.append(value)
        joined = [np.concatenate(x) if x else np.empty(0, np.int64) for x in out]
        return {"side": pa.array(joined[0].astype(np.int32)), "gram": pa.array(joined[1]), "context": pa.array(joined[2]), "n": pa.array(joined[3].astype(np.int64))}

    counted = C.map_batches(urls, rows, "side int, gram bigint, context bigint, n bigint")
    return counted.groupBy("side", "gram", "context").agg(F.sum("n").alias("n"))


def models(counts: DataFrame) -> DataFrame:
    """(key, what, m0, n0, m1, n1) for the sides 0 and 1: of a gram (what = 0) its count as m; of a context (1) its count as m and its distinct continuations as n."""
    of = lambda side, x: F.sum(F.when(F.col("side") == side, x).otherwise(0))
    one, n = F.lit(1).cast("bigint"), F.col("n")
    whole = counts.groupBy(F.col("gram").alias("key")).agg(F.lit(0).alias("what"), of(0, n).alias("m0"), F.lit(0).cast("bigint").alias("n0"), of(1, n).alias("m1"), F.lit(0).cast("bigint").alias("n1"))
    context = counts.groupBy(F.col("context").alias("key")).agg(F.lit(1).alias("what"), of(0, n).alias("m0"), of(0, one).alias("n0"), of(1, n).alias("m1"), of(1, one).alias("n1"))
    return whole.unionByName(context)


def block_keys(urls: DataFrame) -> DataFrame:
    """(block, key, what) of (block, url): the distinct grams (what = 0) and contexts (1), within batches first."""

    def rows(batch: pa.RecordBatch) -> dict:
        out: list[list[np.ndarray]] = [[], [], []]
        blocks = batch.column(0).to_numpy(zero_copy_only=False)
        every = [grams(u) for u in batch.column(1).to_pylist()]
        for block in np.unique(blocks):
            some = [every[i] for i in np.flatnonzero(blocks == block)]
            for what in (0, 1):
                keys = np.unique(np.concatenate([np.unique(np.concatenate([g[o][what] for g in some])) for o in range(ORDERS)]))
                for column, value in zip(out, (np.full(len(keys), block), keys.view(np.int64), np.full(len(keys), what, np.int32)), strict=True):
                    column.append(value)
        return {name: pa.array(np.concatenate(x)) for name, x in zip(("block", "key", "what"), out, strict=True)}

    return C.map_batches(urls, rows, "block bigint, key bigint, what int").distinct()


class Found:
    """What the models hold of the grams and contexts of a block."""

    def __init__(self, rows: pa.Table):
        self.keys, self.values = [], []
        what = rows["what"].to_numpy()
        for w in (0, 1):
            keys = rows["key"].to_numpy()[what == w].view(np.uint64)
            order = np.argsort(keys)
            values = np.stack([rows[c].to_numpy()[what == w][order] for c in ("m0", "n0", "m1", "n1")]).astype(np.float64)
            # the last column stands for what is missing
            self.keys.append(keys[order])
            self.values.append(np.concatenate((values, np.zeros((4, 1))), axis=1))

    def get(self, what: int, keys: np.ndarray) -> np.ndarray:
        have = self.keys[what]
        at = np.searchsorted(have, keys)
        some = at < len(have)
        some[some] = have[at[some]] == keys[some]
        return self.values[what][:, np.where(some, at, len(have))]

    def score(self, url: str | None) -> float:
        every = grams(url)
        p = [np.full(len(every[0][0]), 1 / 257)] * 2
        for gram, context in every:
            count, (n0, t0, n1, t1) = self.get(0, gram), self.get(1, context)
            for side, c, n, t in ((0, count[0], n0, t0), (1, count[2], n1, t1)):
                p[side] = np.where(n > 0, (c + t * p[side]) / np.maximum(n + t, 1), p[side])
        return float(np.log(p[1]).mean()) - float(np.log(p[0]).mean())


def scored(urls: DataFrame, model: DataFrame) -> DataFrame:
    """urls (block, url and others) with score."""
    # Spark takes the keys for about as large as the URLs that they are made of, and so would broadcast millions of them
    found = block_keys(urls.select("block", "url")).hint("merge").join(model, ["key", "what"])
    out = pa.schema([*to_arrow_schema(urls.schema), pa.field("score", pa.float64())])

    def score(rows: pa.Table, held: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return out.empty_table()
        have = Found(held)
        every = {u: have.score(u) for u in set(rows["url"].to_pylist())}
        return pa.Table.from_arrays([*rows.columns, pa.array([every[u] for u in rows["url"].to_pylist()], pa.float64())], schema=out)

    schema = StructType([*urls.schema, StructField("score", DoubleType())])
    return urls.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(score, schema)


def threshold(scores: DataFrame) -> float:
    """Of (score, side): the bin's edge that gives both sides the best mean share of right answers; the lowest of equals."""
    bins = scores.groupBy(F.least(F.greatest(F.floor((F.col("score") + REACH) * (BINS / 2 / REACH)), F.lit(0)), F.lit(BINS - 1)).cast("int").alias("bin"), "side").count().collect()
    sides = np.zeros((2, BINS))
    for b, side, n in bins:
        sides[side, b] = n
    if not sides.sum(axis=1).all():
        return 0.0
    below = np.concatenate((np.zeros((2, 1)), np.cumsum(sides, axis=1)), axis=1) / sides.sum(axis=1, keepdims=True)
    good = below[0] + 1 - below[1]
    best = np.flatnonzero(good >= good.max() - 1e-12)
    return float(best[len(best) // 2] * (2 * REACH / BINS) - REACH)


def judge(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """One row per page: id, host, path, rule, score (allowed against blocked) and verdict."""
    urls = with_rule(parts(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")), "url"), rules)
    # rows are numbered within their partition, and so many in a row make a block; written, so that they stay in it
    no = F.monotonically_increasing_id()
    block = F.shiftright(no, ROOM) * (1 << 21) + F.floor((no % (1 << ROOM)) / BLOCK)
    urls = urls.withColumn("side", (F.col("__said") == "allow").cast("int")).withColumn("later", F.pmod(F.xxhash64("url"), F.lit(5)) == 0)
    urls = C.materialise(urls.withColumn("block", block.cast("bigint")), "url-rows")
    counts = C.materialise(count_grams(urls.where("side is not null and not later").select("url", "side")), "url-grams")
    out = C.materialise(scored(urls, models(counts)), "url-scores")
    both = counts.select("side").distinct().count() == 2
    cut = threshold(out.where("side is not null and later").select("score", "side")) if both else None
    method = F.lit("allow") if cut is None else F.when(F.col("score") >= cut, "allow").otherwise("block")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("__said", method).alias("verdict"), "score")
