"""Exact removal of passages that repeat, by suffix automata of reference shards.

Every window of `window` words belongs to one shard: that of its smallest k-word hash, so equal windows meet. Consecutive
windows with the same smallest hash form a run, and a shard's reference is its distinct runs. Runs whose shard has but one
run are unique and go no further. For each shard, a suffix automaton of the reference (with weighted occurrence counts)
is built where the shard lies and the runs are streamed through it: the matching statistic of a word is the length of the
longest suffix that occurs twice or more, and a window that it spans is a repeat. Each word under such a window goes.

The reference goes to its shard without the places where it occurs, equal runs joined within a batch; the places meet what was found
in a join on the run, whose hot keys Spark splits. A shard of more than `hot_runs` runs is split by the leading bits of its windows' hashes,
8 bits for each factor of 256 above that, and takes windows one by one: equal windows still meet, and each part has an automaton of its own.

Nulls, ties and odd rows: a null or empty text has no words and loses none; every occurrence of a repeat goes, the first
too; repeated rows repeat each other; rows are told apart by id and text; other columns are never read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C

#: How often a shard can be split by 256: up to hot_runs * 256**3 runs a shard, parts hold about hot_runs windows.
LEVELS = 3


class Automaton:
    """Suffix automaton of several weighted sequences."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def state(self, length: int, link: int, step: dict[int, int]) -> int:
        self.next.append(step)
        self.link.append(link)
        self.length.append(length)
        self.count.append(0)
        return len(self.link) - 1

    def split(self, p: int, q: int, c: int) -> int:
        """The part of state q that p reaches with one more symbol."""
        if self.length[q] == self.length[p] + 1:
            return q
        part = self.state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = part
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = part
            p = self.link[p]
        return part

    def add(self, sequence: list[int], weight: int) -> None:
        last = 0
        for c in sequence:
            p, known = last, self.next[last].get(c)
            if known is not None:
                last = self.split(p, known, c)
            else:
                last = self.state(self.length[p] + 1, 0, {})
                while p != -1 and c not in self.next[p]:
                    self.next[p][c] = last
                    p = self.link[p]
                if p != -1:
                    self.link[last] = self.split(p, self.next[p][c], c)
            self.count[last] += weight

    def finish(self) -> None:
        """Carry the counts to all suffixes."""
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[v]] += self.count[v]

    def statistics(self, sequence: list[int], least: int = 2) -> Iterator[int]:
        """For each symbol of a sequence of the reference: length of the longest suffix there that occurs `least` times or more."""
        v = 0
        for i, c in enumerate(sequence):
            v = u = self.next[v][c]
            while u and self.count[u] < least:
                u = self.link[u]
            yield i + 1 if u == v else self.length[u]


def runs(h: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one smallest k-word hash, at most `window` windows each: starts, numbers of windows, hashes."""
    if len(h) < window:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    low = C.sliding_min(C.gram_hashes(h, k), window - k + 1)
    edges = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1], [True])))
    if (np.diff(edges) > window).any():
        edges = np.array([x for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True) for x in range(a, b, window)] + [len(low)])
    return edges[:-1], np.diff(edges), low[edges[:-1]]


def repeated_grams(h: np.ndarray, k: int) -> np.ndarray:
    g = np.sort(C.gram_hashes(h, k))
    return np.unique(g[1:][g[1:] == g[:-1]])


def repeats(sequences: list[tuple[list[int], int]], window: int) -> list[list[tuple[int, int]]]:
    """For each (distinct sequence, weight): runs (first window, number of windows) of windows that occur twice or more in all."""
    if len(sequences) == 1 and sequences[0][1] > 1:
        return [[(0, len(sequences[0][0]) - window + 1)]]
    automaton = Automaton()
    for s, weight in sequences:
        automaton.add(s, weight)
    automaton.finish()
    out = []
    for s, _ in sequences:
        found: list[tuple[int, int]] = []
        for end, n in enumerate(automaton.statistics(s)):
            if n >= window:
                start = end - window + 1
                if found and found[-1][0] + found[-1][1] == start:
                    found[-1] = (found[-1][0], found[-1][1] + 1)
                else:
                    found.append((start, 1))
        out.append(found)
    return out


def find_repeats(docs: DataFrame, *, id_col: str, text_col: str, window: int, k: int, hot_runs: int) -> DataFrame:
    """(id, text_key, spans): runs of words under repeated windows, for the rows that have any."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text")).where("text is not null")

    def shards(batch: pa.RecordBatch) -> dict:
        shard, weight = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for text in C.text_bytes(batch.column(0)):
            h = C.word_hashes(text.split())
            low = runs(h, window, k)[2]
            if len(low):
                shard.append(low)
                weight.append(1 + np.isin(low, repeated_grams(h, k)))
        return {"shard": pa.array(np.concatenate(shard).view(np.int64)), "weight": pa.array(np.concatenate(weight))}

    counted = C.map_batches(keyed.select("text"), shards, "shard bigint, weight bigint").groupBy("shard").agg(F.sum("weight").alias("n")).where("n > 1")
    counted, counted_path = C.materialise_at(counted, "substring-shards")
    levels = C.Shared(spark, [C.Bitmap(counted.where(F.col("n") > hot_runs * 256**i), "shard") for i in range(LEVELS)])
    shared = C.Shared(spark, C.Bitmap(counted, "shard"))
    C.discard(spark, counted_path)

    def pieces(text: bytes) -> Iterator[tuple[int, int, int, bytes]]:
        """(shard, hash, first word, words as 64-bit hashes) of the text's runs in shared shards, and of each window in split ones."""
        h = C.word_hashes(text.split())
        starts, sizes, low = runs(h, window, k)
        some = shared.value.holds(low) if len(low) else np.empty(0, bool)
        starts, sizes, low = starts[some], sizes[some], low[some]
        if not len(low):
            return
        bits = np.sum([level.holds(low) for level in levels.value], axis=0).astype(np.uint64) * np.uint64(8)
        if bits.any():
            # windows one by one: each run repeated as often as it has windows
            times = np.where(bits > 0, sizes, 1)
            nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            starts, sizes, low, bits = np.repeat(starts, times) + nth, np.repeat(np.where(bits > 0, 1, sizes), times), np.repeat(low, times), np.repeat(bits, times)
            part = C.gram_hashes(h, window)[starts] >> (np.uint64(63) - np.maximum(bits, np.uint64(1)) + np.uint64(1))
            low = np.where(bits > 0, C.mix(low + (part + np.uint64(1)) * C.MULT), low)
        for shard, start, n in zip(low.view(np.int64).tolist(), starts.tolist(), sizes.tolist(), strict=True):
            words = h[start : start + n + window - 1].tobytes()
            yield shard, xxhash.xxh3_64_intdigest(words), start, words

    def references(batch: pa.RecordBatch) -> dict:
        held: dict[tuple[int, int], list] = {}
        for text in C.text_bytes(batch.column(0)):
            for shard, run, _, words in pieces(text):
                held.setdefault((shard, run), [words, 0])[1] += 1
        return {
            "shard": pa.array([x for x, _ in held], pa.int64()), "run": pa.array(np.fromiter((x for _, x in held), np.uint64, len(held)).view(np.int64)),
            "words": [x for x, _ in held.values()], "weight": [n for _, n in held.values()],
        }

    def places(batch: pa.RecordBatch) -> dict:
        row, runs_, start = [], [], []
        for i, text in enumerate(C.text_bytes(batch.column(2))):
            for _, run, first, _ in pieces(text):
                row.append(i)
                runs_.append(run)
                start.append(first)
        row = pa.array(row, pa.int64())
        return {"id": batch.column(0).take(row), "text_key": batch.column(1).take(row), "run": pa.array(np.array(runs_, np.uint64).view(np.int64)), "start": pa.array(start, pa.int64())}

    spans = "array<struct<first: bigint, n: bigint>>"
    target = pa.schema([("run", pa.int64()), ("found", pa.list_(pa.struct([("first", pa.int64()), ("n", pa.int64())])))])

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, out = None, {}, ([], [])

        def flush() -> None:
            if held:
                for run, found in zip(held, repeats([(np.frombuffer(words, np.uint64).tolist(), weight) for words, weight in held.values()], window), strict=True):
                    if found:
                        out[0].append(run)
                        out[1].append([{"first": start, "n": n} for start, n in found])
            held.clear()

        def ready() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, target, strict=True)], schema=target)
            for x in out:
                x.clear()
            return rows

        for batch in batches:
            for x, run, words, weight in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if x != shard:
                    flush()
                    shard = x
                held[run] = (words, held[run][1] + weight if run in held else weight)
                if len(out[0]) > 20_000:
                    yield ready()
        flush()
        yield ready()

    sent = C.map_batches(keyed.select("text"), references, "shard bigint, run bigint, words binary, weight bigint").repartition("shard").sortWithinPartitions("shard", "run")
    found = C.materialise(sent.mapInArrow(resolve, f"run bigint, found {spans}"), "substrings")
    # a window of a split shard may be resolved in one part only, so a run has one row
    where = C.map_batches(keyed, places, f"id {kind}, text_key bigint, run bigint, start bigint")
    hits = where.join(found, "run").select("id", "text_key", F.transform("found", lambda x: F.struct((F.col("start") + x["first"]).alias("start"), (F.col("start") + x["first"] + x["n"] + window - 1).alias("end"))).alias("spans"))
    # a set: rows that are repeated bring the same spans
    return hits.groupBy("id", "text_key").agg(F.flatten(F.collect_set("spans")).alias("spans"))


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 35, k: int = 8, hot_runs: int = 10_000) -> DataFrame:
    """One row per document: id, n_words, n_removed and kept (the words that stay, joined by one space)."""
    kind = docs.schema[id_col].dataType.simpleString()
    spans = find_repeats(docs, id_col=id_col, text_col=text_col, window=window, k=k, hot_runs=hot_runs)
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    both = texts.alias("t").join(spans.alias("s"), F.col("t.id").eqNullSafe(F.col("s.id")) & (F.col("t.text_key") == F.col("s.text_key")), "left").select("t.id", "t.text", "s.spans")

    def cut(batch: pa.RecordBatch) -> dict:
        out: dict = {"id": batch.column(0), "n_words": [], "n_removed": [], "kept": []}
        for text, gone in zip(C.text_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            words = (text or b"").split()
            stay = words
            if gone:
                mask = np.zeros(len(words), bool)
                for x in gone:
                    mask[x["start"] : x["end"]] = True
                stay = [w for w, g in zip(words, mask.tolist(), strict=True) if not g]
            out["n_words"].append(len(words))
            out["n_removed"].append(len(words) - len(stay))
            out["kept"].append(b" ".join(stay).decode())
        return out

    return C.map_batches(both, cut, f"id {kind}, n_words bigint, n_removed bigint, kept string").withColumnRenamed("id", id_col)

