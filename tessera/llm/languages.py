"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

A text's letters, lower-cased, with one space for whatever lies between them, give n-grams of 1 to 4 characters, hashed into 2**16 cells. Document
frequencies are counted over all rows that may be learned from. The regression is fitted by follow-the-regularised-leader (proximal, a learning rate
for each weight) with elastic-net penalties on at most about `most_rows` of those rows and `most_bytes` of their text, equal shares for each
language, by hash of id and text (each text whole); a fifth of them is left out and sets the temperature, the divisor of the logits that
makes them likeliest. The model is 2**16 weights a language; every text is scored whole, where it lies.

Nulls, ties and odd rows: a text that is null or has no letter is `und` with score 0; a null language is no label and a null id is neither learned from
nor held out; of languages with equal scores the first in order wins; a single language to learn is always the answer, with score 1, and without any all
are `und`; repeated rows are each scored; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C

BITS = 16
CELLS = 1 << BITS
ORDERS = (1, 2, 3, 4)
FACTOR = np.uint32(0x9E3779B1)


@functools.cache
def folding() -> np.ndarray:
    """For each code point: that of its lower case if it is a letter, else a space."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def letters(text: str | None) -> np.ndarray:
    """Code points of a text's words with single spaces around them; empty without letters."""
    raw = folding()[np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)]
    raw = np.concatenate((np.array([32], np.uint32), raw, np.array([32], np.uint32)))
    kept = raw[np.concatenate(([True], (raw[1:] != 32) | (raw[:-1] != 32)))]
    return kept if len(kept) > 1 else kept[:0]


def cells(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Cells of a text's n-grams, ascending, and how often each occurs."""
    x = letters(text)
    if not len(x):
        return np.empty(0, np.uint16), np.empty(0, np.int64)
    total, h = np.zeros(CELLS, np.int64), np.zeros(len(x), np.uint32)
    for k in range(1, max(ORDERS) + 1):
        if len(x) < k:
            break
        h = (h[: len(x) - k + 1] + x[k - 1 :]) * FACTOR
        h ^= h >> np.uint32(15)
        if k in ORDERS:
            total += np.bincount(((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)).astype(np.int64), minlength=CELLS)
    found = np.flatnonzero(total)
    return found.astype(np.uint16), total[found]


def weighed(found: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF by the logarithm of counts, of length 1."""
    x = (1 + np.log(counts)) * idf[found]
    return x / max(float(np.sqrt(x @ x)), 1e-12)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: Sequence[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n_labels: int, *, rate: float, smooth: float, l1: float, l2: float, epochs: int, seed: int = 7) -> np.ndarray:
    """Weights (cells and, last, a bias without penalties, by label) of FTRL-proximal over rows of (cells, values) in a fixed order a pass."""
    z, n = np.zeros((CELLS + 1, n_labels)), np.zeros((CELLS + 1, n_labels))
    one, two = np.full(CELLS + 1, l1), np.full(CELLS + 1, l2)
    one[CELLS] = two[CELLS] = 0.0

    def solved(at: np.ndarray | slice) -> np.ndarray:
        far = np.abs(z[at]) > one[at, None]
        return np.where(far, -(z[at] - np.sign(z[at]) * one[at, None]) / ((smooth + np.sqrt(n[at])) / rate + two[at, None]), 0.0)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            found, values = rows[i]
            at, x = np.append(found.astype(np.int64), CELLS), np.append(values, 1.0)
            w = solved(at)
            error = softmax(x @ w)
            error[labels[i]] -= 1
            g = x[:, None] * error
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / rate * w
            n[at] += g * g
    return solved(slice(None))


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """Divisor of the logits under which the labels are likeliest, between 1/20 and 20, by golden section over its logarithm. Each label counts as if
    one in n + 2 were wrong, so that rows without an error don't make every later answer certain."""
    if not len(labels) or logits.shape[1] < 2:
        return 1.0
    wrong = 1 / (len(labels) + 2)
    want = np.full(logits.shape, wrong / (logits.shape[1] - 1))
    want[np.arange(len(labels)), labels] = 1 - wrong

    def cost(t: float) -> float:
        z = logits / np.exp(t)
        top = z.max(axis=1)
        return float((top + np.log(np.exp(z - top[:, None]).sum(axis=1)) - (z * want).sum(axis=1)).mean())

    low, high, part = -np.log(20.0), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - part * (high - low), low + part * (high - low)
        low, high = (low, b) if cost(a) <= cost(b) else (a, high)
    return float(np.exp((low + high) / 2))


def held_out(id_col: str) -> Column:
    """Whether the id is kept for testing; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3)) == 1, F.lit(False))


def frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Of how many texts each cell is, and how many texts have any; each task sends a row for each cell at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS + 1, np.int64)
        for batch in batches:
            for x in batch.column(0):
                found, _ = cells(x.as_py())
                total[found] += 1
                total[CELLS] += len(found) > 0
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["cell", "n"])

    got = texts.mapInArrow(run, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CELLS + 1, np.int64)
    out[got["cell"].to_numpy()] = got["n"].to_numpy()
    return out[:CELLS], int(out[CELLS])


class Model:
    """Languages, weights with the idf and the temperature in them."""

    def __init__(self, langs: list[str], weights: np.ndarray, idf: np.ndarray, heat: float):
        self.langs, self.weights, self.idf, self.heat = langs, weights, idf, heat

    def logits(self, text: str | None) -> np.ndarray | None:
        found, counts = cells(text)
        if not len(found) or not self.langs:
            return None
        return weighed(found, counts, self.idf) @ self.weights[found] + self.weights[CELLS]

    def judge(self, text: str | None) -> tuple[str, float]:
        z = self.logits(text)
        if z is None:
            return "und", 0.0
        p = softmax(z / self.heat)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def learn(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_rows: int = 6000, most_bytes: int = 24 << 20, rate: float = 2.0, smooth: float = 0.1, l1: float = 0.02, l2: float = 0.02, epochs: int = 3
) -> Model:
    """The model of the rows that are not held out and have an id, a language and a letter."""
    spark = docs.sparkSession
    base = docs.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    base = base.where(F.col("text").rlike(r"\p{L}"))
    df, n = frequencies(base.select("text"))
    idf = np.log((1 + n) / (1 + df)) + 1
    sizes = sorted((r["lang"], r["n"], r["size"]) for r in base.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("size")).collect())
    langs = [x for x, _, _ in sizes]
    if not langs:
        return Model([], np.zeros((CELLS + 1, 0)), idf, 1.0)
    shares = [(x, int((1 << 30) * min(1.0, most_rows / len(langs) / n, most_bytes / len(langs) / size)), i) for i, (x, n, size) in enumerate(sizes)]
    shares = spark.createDataFrame(shares, "lang string, share bigint, label int")
    sample = base.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) < F.col("share"))

    def rows(batch: pa.RecordBatch) -> dict:
        got = [cells(x.as_py()) for x in batch.column(0)]
        return {"cells": [a.tobytes() for a, _ in got], "counts": [b.astype(np.int32).tobytes() for _, b in got], "label": batch.column(1), "tested": batch.column(2)}

    tested = (F.pmod(F.xxhash64("text", "id"), F.lit(5)) == 0).alias("tested")
    table = C.map_batches(sample.select("text", "label", tested), rows, "cells binary, counts binary, label int, tested boolean").toArrow()
    # the order in which rows arrive must not change the model
    got = sorted(zip(*(table[c].to_pylist() for c in table.column_names), strict=True), key=lambda r: (xxhash.xxh3_64_intdigest(r[0] + r[1]), r[2]))
    got = [(np.frombuffer(a, np.uint16), np.frombuffer(b, np.int32), y, t) for a, b, y, t in got if a]
    data = [((a, weighed(a, b, idf)), y, t) for a, b, y, t in got]
    train = [r for r in data if not r[2]] or data
    weights = fit([r[0] for r in train], np.array([r[1] for r in train], int), len(langs), rate=rate, smooth=smooth, l1=l1, l2=l2, epochs=epochs)
    check = [r for r in data if r[2]]
    logits = np.array([x @ weights[a] + weights[CELLS] for (a, x), _, _ in check]).reshape(len(check), len(langs))
    return Model(langs, weights.astype(np.float32), idf, temperature(logits, np.array([r[1] for r in check], int)))


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of docs: id, lang_pred, score (0 to 1)."""
    shared = C.Shared(docs.sparkSession, model)
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(batch: pa.RecordBatch) -> dict:
        got = [shared.value.judge(x.as_py()) for x in batch.column(1)]
        return {"id": batch.column(0), "lang_pred": [x for x, _ in got], "score": [p for _, p in got]}

    return C.map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), rows, f"id {kind}, lang_pred string, score double", at_once=500).withColumnRenamed("id", id_col)
