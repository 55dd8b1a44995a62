"""Benchmark decontamination by winnowing.

Of every `window - k + 1` consecutive k-word hashes the smallest is kept as a fingerprint, so any shared span of
`window` words shares a fingerprint; hits are extended word by word to the whole shared span. Items shorter than
the window are looked up as one sequence of their own length.

A benchmark of at most `block_bytes` is broadcast as an index of its fingerprints. A larger one is never held in one place: fingerprints of documents
and items are joined by shuffles, documents being read once whatever the benchmark's size.

Nulls, ties and odd rows: a null or empty text has no words (n_words 0, no hits); a null item text is no item; items
of equal text all count; a null item id marks words but is never listed; repeated item ids are listed once;
documents are never merged, each row is judged alone; other columns of both tables are ignored; an empty table gives no rows, an empty
benchmark no hits; texts of any length are judged whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import common as C


class Index:
    """Fingerprints of one block of benchmark items."""

    BITS = np.uint64((1 << 20) - 1)

    def __init__(self, items: list[tuple[str | None, str]], window: int, k: int):
        self.window, self.k = window, k
        hashes = [(i, C.word_hashes(t.encode().translate(C.ALNUM).split())) for i, t in items]
        long = [(i, h) for i, h in hashes if len(h) >= window]
        self.ids = [i for i, _ in long]
        self.starts = np.cumsum([0, *(len(h) for _, h in long)])
        self.words = np.concatenate([h for _, h in long]) if long else np.empty(0, np.uint64)
        prints, at = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for s, (_, h) in zip(self.starts, long, strict=False):
            g = C.gram_hashes(h, k)
            p = np.unique(self.places(g, np.arange(len(g) - self.span + 1)))
            prints.append(g[p])
            at.append(p + s)
        prints, at = np.concatenate(prints), np.concatenate(at)
        order = np.argsort(prints, kind="stable")
        self.prints, self.at = prints[order], at[order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.prints & self.BITS] = True
        #: length: {hash of the whole item: its ids}
        self.short: dict[int, dict[int, list]] = {}
        for i, h in hashes:
            if 0 < len(h) < window:
                self.short.setdefault(len(h), {}).setdefault(int(C.gram_hashes(h, len(h))[0]), []).append(i)

    @property
    def span(self) -> int:
        return self.window - self.k + 1

    def places(self, g: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """Place of the first smallest hash in each of these windows."""
        return windows + np.lib.stride_tricks.sliding_window_view(g, self.span)[windows].argmin(axis=1)

    def hits(self, h: np.ndarray) -> tuple[list[tuple[int, int]], set]:
        """Spans of words in occurrences of a window, and the items."""
        spans: list[tuple[int, int]] = []
        found: set = set()
        if len(h) >= self.window and len(self.prints):
            g = C.gram_hashes(h, self.k)
            low = C.sliding_min(g, self.span)
            maybe = np.flatnonzero(self.seen[low & self.BITS])
            if len(maybe):
                maybe = maybe[np.isin(low[maybe], self.prints)]
            if len(maybe):
                reached: dict[tuple[int, int], int] = {}
                for p in np.unique(self.places(g, maybe)).tolist():
                    lo, hi = np.searchsorted(self.prints, g[p], "left"), np.searchsorted(self.prints, g[p], "right")
                    for q in self.at[lo:hi].tolist():
                        self.extend(h, p, q, reached, spans, found)
        for n, whole in self.short.items():
            g = C.gram_hashes(h, n)
            for p in np.flatnonzero(np.isin(g, np.fromiter(whole, np.uint64, len(whole)))).tolist():
                spans.append((p, p + n))
                found.update(whole[int(g[p])])
        return spans, found

    def extend(self, h: np.ndarray, p: int, q: int, reached: dict, spans: list, found: set) -> None:
        """Grow a shared fingerprint at word p of the document and q of the items to the whole shared span."""
        item = int(np.searchsorted(self.starts, q, "right")) - 1
        first, last = int(self.starts[item]), int(self.starts[item + 1])
        if p < reached.get((item, p - q), -1):
            return
        left = right = 0
        while p - left > 0 and q - left > first and h[p - left - 1] == self.words[q - left - 1]:
            left += 1
        while p + right < len(h) and q + right < last and h[p + right] == self.words[q + right]:
            right += 1
        reached[(item, p - q)] = p + right
        if left + right >= self.window:
            spans.append((p - left, p + right))
            found.add(self.ids[item])


def items_of(benchmark: DataFrame, item_col: str, item_text_col: str, block_bytes: int) -> tuple[DataFrame, bool]:
    """The items as (i, t), and whether they are few enough for one index."""
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(item_text_col).alias("t")).where("t is not null")
    total = items.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    return items, total <= block_bytes


def index_of(items: DataFrame, window: int, k: int) -> C.Shared:
    return C.Shared(items.sparkSession, Index([(r.i, r.t) for r in items.collect()], window, k))


def words_of(text: bytes | None) -> np.ndarray:
    return C.word_hashes((text or b"").translate(C.ALNUM).split())


def prints(h: np.ndarray, sizes: list[int], window: int, k: int, seen: C.Bitmap | None) -> list[dict]:
    """Windows of these sizes by their fingerprint (the smallest k-word hash; of what is shorter than a window a hash of the whole), where it may be known."""
    out = []
    for n in sizes:
        if len(h) < n:
            continue
        whole = C.gram_hashes(h, n)
        low = C.sliding_min(C.gram_hashes(h, k), window - k + 1) if n == window else C.mix(whole ^ np.uint64(n))
        at = np.arange(len(low)) if seen is None else np.flatnonzero(seen.holds(low))
        at = at[np.argsort(low[at], kind="stable")]
        for part in np.split(at, np.flatnonzero(low[at][1:] != low[at][:-1]) + 1) if len(at) else []:
            out.append({"size": n, "print": int(low[part[0]].view(np.int64)), "starts": part.tolist(), "windows": whole[part].view(np.int64).tolist()})
    return out


def fingerprints(texts: DataFrame, window: int, k: int, sizes: list[int] | None = None, seen: C.Shared | None = None) -> DataFrame:
    """(id, n_words, prints) of each (id, text). Without sizes a text is an item: its windows are all of full length, or it is one."""
    kind = texts.schema.fields[0].dataType.simpleString()

    def rows(batch: pa.RecordBatch) -> dict:
        hashed = [words_of(t) for t in C.text_bytes(batch.column(1))]
        known = seen and seen.value
        found = [prints(h, sizes or [min(window, len(h))] * (len(h) > 0), window, k, known) for h in hashed]
        return {"id": batch.column(0), "n_words": [len(h) for h in hashed], "prints": found}

    return C.map_batches(texts, rows, f"id {kind}, n_words bigint, prints array<struct<size: int, print: bigint, starts: array<int>, windows: array<bigint>>>", at_once=256)


#: Parts of a key that many documents share; the other side of a join is repeated for each.
SALTS = 16


def salted(table: DataFrame) -> DataFrame:
    return table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def merged_spans(hits: DataFrame) -> DataFrame:
    """(row, n_hit, hit_spans) of (row, start, end): spans that overlap or touch are one."""
    earlier = Window.partitionBy("row").orderBy("start", "end")
    reach = F.max("end").over(earlier.rowsBetween(Window.unboundedPreceding, -1))
    fresh = hits.withColumn("fresh", F.when(F.col("start") <= reach, 0).otherwise(1))
    spans = fresh.withColumn("span", F.sum("fresh").over(earlier.rowsBetween(Window.unboundedPreceding, 0))).groupBy("row", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return spans.groupBy("row").agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("hit_spans"))


def joined(docs: DataFrame, items: DataFrame, window: int, k: int) -> DataFrame:
    """(id, n_words, n_hit, item_ids, hit_spans) of each (id, text), for benchmarks of any size.

    Documents are read once. Their fingerprints that a bitmap of the items' lets through are joined with the items' fingerprints; the windows of those
    that are found are then joined with the items' windows, so that a common phrase of k words costs a row for each place and not for each pair."""
    bench = C.materialise(fingerprints(items, window, k), "item-prints").select(F.col("id").alias("item"), F.explode("prints").alias("x")).select("item", "x.*")
    known = bench.select("size", "print").distinct()
    seen = C.Shared(docs.sparkSession, C.Bitmap(known, "print"))
    sizes = sorted(r.size for r in bench.select("size").distinct().collect())  # `window` of them at most
    if not sizes:
        sizes = [window]
    found = C.materialise(fingerprints(docs, window, k, sizes, seen).withColumn("row", F.monotonically_increasing_id()), "document-prints")
    seen.unpersist()
    salt = F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int").alias("salt")
    shared = found.select("row", salt, F.explode("prints").alias("x")).select("row", "salt", "x.*").join(salted(known), ["size", "print", "salt"], "left_semi")
    key = ["size", "print", "window"]
    places = shared.select("row", "salt", "size", "print", F.explode(F.arrays_zip("starts", "windows")).alias("w")).select("row", "salt", "size", "print", F.col("w.windows").alias("window"), F.col("w.starts").alias("start"))
    whole = bench.select("item", "size", "print", F.explode("windows").alias("window")).distinct()
    hits = C.materialise(places.join(salted(whole.select(key).distinct()), [*key, "salt"], "left_semi"), "shared-windows")
    spans = merged_spans(hits.select("row", F.col("start").cast("bigint").alias("start"), (F.col("start") + F.col("size")).cast("bigint").alias("end")))
    named = hits.select("row", "salt", *key).distinct().join(salted(whole.where("item is not null")), [*key, "salt"])
    ids = named.select("row", "item").distinct().groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("item_ids"))
    none = lambda name, kind: F.coalesce(name, F.expr(f"cast(array() as {kind})")).alias(name)
    return found.select("row", "id", "n_words").join(spans, "row", "left").join(ids, "row", "left").select(
        "id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), none("item_ids", "array<string>"), none("hit_spans", "array<struct<start: bigint, end: bigint>>")
    )


def clean(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, k: int = 5, block_bytes: int = 16 << 20) -> DataFrame:
    """The rows of docs without any hit, with all their columns."""
    items, few = items_of(benchmark, item_col, item_text_col, block_bytes)
    if not few:
        row = "row"
        while row in map(str.lower, docs.columns):
            row += "_"
        numbered = C.materialise(docs.withColumn(row, F.monotonically_increasing_id()), "decontaminate")
        hit = joined(numbered.select(row, text_col), items, window, k).where("n_hit > 0").select(F.col("id").alias(row))
        return numbered.join(hit, row, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
    at, index = docs.columns.index(text_col), index_of(items, window, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not index.value.hits(words_of(t))[0] for t in C.text_bytes(batch.column(at))], pa.bool_()))

    C.small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    k: int = 5,
    block_bytes: int = 16 << 20,
) -> DataFrame:
    """One row per document: its id, n_words, n_hit, item_ids (sorted strings) and hit_spans ([start, end) in words)."""
    items, few = items_of(benchmark, item_col, item_text_col, block_bytes)
    if not few:
        return joined(docs.select(id_col, text_col), items, window, k).withColumnRenamed("id", id_col)
    index = index_of(items, window, k)

    def rows(batch: pa.RecordBatch) -> dict:
        out: dict = {"id": batch.column(0), "n_words": [], "n_hit": [], "item_ids": [], "hit_spans": []}
        for text in C.text_bytes(batch.column(1)):
            h = words_of(text)
            spans, found = index.value.hits(h)
            merged: list[list[int]] = []
            for s, e in sorted(spans):
                if merged and s <= merged[-1][1]:
                    merged[-1][1] = max(e, merged[-1][1])
                else:
                    merged.append([s, e])
            out["n_words"].append(len(h))
            out["n_hit"].append(sum(e - s for s, e in merged))
            out["item_ids"].append(sorted({i for i in found if i is not None}))
            out["hit_spans"].append([{"start": s, "end": e} for s, e in merged])
        return out

    kind = docs.schema[id_col].dataType.simpleString()
    return C.map_batches(docs.select(id_col, text_col), rows, f"id {kind}, n_words bigint, n_hit bigint, item_ids array<string>, hit_spans array<struct<start: bigint, end: bigint>>").withColumnRenamed("id", id_col)
