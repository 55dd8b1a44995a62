"""Toxicity: a counterfactual-regularised classifier.

Logistic regression on the presence of hashed words and word beginnings. In labelled texts identity terms are swapped for
other terms of their kind, and the squared change of the logit is penalised, so a neutral mention of a group carries no weight.
The classifier is fitted on at most about `most_rows` labelled rows of about `most_bytes` of text (by hash of the id, so the choice is stable; each text
whole) that are not held out; its weights are 2**18 numbers, whatever the input.

Nulls, ties and odd rows: a null or empty text is scored by the bias alone; labels repeated for one id count once, as toxic if any
says so; null labels are none; without both classes in the labels every score is the share of toxic ones (0 without any);
rows of one id are each scored by their own text; a null id is not held out and has no label; other columns are never read; texts of any length
are scored whole; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C

CELLS = 1 << 18
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Kinds of identity terms; each is swapped for the next of its kind. Fixed values.
KINDS = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("she", "he"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "natives", "refugees", "foreigners"),
    ("old", "young"),
    ("disabled", "deaf", "blind"),
    ("frauen", "männer"),
    ("femmes", "hommes"),
    ("mujeres", "hombres"),
)
SWAP = {a.encode(): kind[(i + 1) % len(kind)].encode() for kind in KINDS for i, a in enumerate(kind)}


class Features:
    """Cells of a text's words; cells of a word are kept for the next time."""

    def __init__(self) -> None:
        self.known: dict[bytes, tuple[int, ...]] = {}

    def word(self, w: bytes) -> tuple[int, ...]:
        cells = self.known.get(w)
        if cells is None:
            if len(self.known) > 300_000:
                self.known = {}
            core = w.strip(PUNCTUATION)
            parts = {b"=" + core, *(b"%d" % n + core[:n] for n in (4, 5, 6) if len(core) >= n)} if core else set()
            cells = self.known[w] = tuple(sorted(xxhash.xxh3_64_intdigest(p) % CELLS for p in parts))
        return cells

    def text(self, words: set[bytes]) -> np.ndarray:
        return np.array(sorted({c for w in words for c in self.word(w)}), np.int32)

    def swapped(self, words: set[bytes]) -> np.ndarray | None:
        if not any(w.strip(PUNCTUATION) in SWAP for w in words):
            return None
        return self.text({SWAP.get(w.strip(PUNCTUATION), w) for w in words})


def fit(rows: list[np.ndarray], labels: np.ndarray, swaps: list[tuple[int, np.ndarray]], *, penalty: float, ridge: float, steps: int, rate: float = 0.1, least_z: float = 4.0, most_cells: int = 4096) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on all rows at once. The cells with weights are those whose share of toxic rows is more than
    `least_z` standard errors off the mean share, the furthest `most_cells` of them."""
    weights = np.zeros(CELLS, np.float64)
    if not len(labels) or labels.min() == labels.max():
        share = float(labels.mean()) if len(labels) else 0.0
        return weights.astype(np.float32), float(np.log((share + 1e-9) / (1 - share + 1e-9)))
    size = np.bincount(np.concatenate(rows), minlength=CELLS)
    toxic = np.bincount(np.concatenate(rows), np.repeat(labels, [len(x) for x in rows]), CELLS)
    share = labels.mean()
    z = np.abs(toxic - size * share) / np.sqrt(np.maximum(size, 1) * share * (1 - share))
    z[size < 3] = 0
    order = np.argsort(-z, kind="stable")[:most_cells]
    keep = np.sort(order[z[order] > least_z])
    place = np.full(CELLS, -1)
    place[keep] = np.arange(len(keep))

    def table(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        at = [place[x] for x in lists]
        at = [x[x >= 0] for x in at]
        return np.concatenate(at) if at else np.empty(0, int), np.repeat(np.arange(len(at)), [len(x) for x in at])

    col, row = table(rows)
    first, first_row = table([rows[i] for i, _ in swaps])
    second, second_row = table([x for _, x in swaps])
    n, k, m = len(rows), len(swaps), len(keep)
    w, bias = np.zeros(m), float(np.log(labels.mean() / (1 - labels.mean())))
    moment, square, bias_m, bias_s = np.zeros(m), np.zeros(m), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.bincount(row, w[col], n) + bias
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels
        grad = np.bincount(col, error[row], m) / n + ridge * w
        if k:
            change = np.bincount(first_row, w[first], k) - np.bincount(second_row, w[second], k)
            grad += 2 * penalty / k * (np.bincount(first, change[first_row], m) - np.bincount(second, change[second_row], m))
        moment, square = 0.9 * moment + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        w -= rate * (moment / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-6)
        bias_m, bias_s = 0.9 * bias_m + 0.1 * error.mean(), 0.99 * bias_s + 0.01 * error.mean() ** 2
        bias -= rate * (bias_m / (1 - 0.9**t)) / (bias_s / (1 - 0.99**t)) ** 0.5 if bias_s else 0
    weights[keep] = w
    return weights.astype(np.float32), bias


def held_out(id_col: str) -> F.Column:
    """Whether the id is kept for testing; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, most_rows: int, most_bytes: int, penalty: float, ridge: float, steps: int) -> tuple[np.ndarray, float]:
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("__id")).agg((F.max(label_col) > 0).cast("int").alias("__label"))
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"))
    known = C.if_small(known, 2 * most_rows)
    there, size = texts.select("__id", F.octet_length("text").alias("size")).join(known, "__id").agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    if there > most_rows or size > most_bytes:
        known = known.where(F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) < int((1 << 30) * min(most_rows / there, most_bytes / size)))
    texts = texts.join(known, "__id").select("text", "__label")

    def rows(batch: pa.RecordBatch) -> dict:
        features, out = Features(), {"cells": [], "swapped": [], "label": batch.column(1)}
        for t in C.text_bytes(batch.column(0)):
            words = set((t or b"").translate(C.LOWER).split())
            x = features.swapped(words)
            out["cells"].append(features.text(words).tobytes())
            out["swapped"].append(None if x is None else x.tobytes())
        return out

    got = C.map_batches(texts, rows, "cells binary, swapped binary, label int").toArrow()
    # the order in which rows arrive must not change the sums
    got = sorted(zip(got["cells"].to_pylist(), got["swapped"].to_pylist(), got["label"].to_pylist(), strict=True), key=lambda x: (xxhash.xxh3_64_intdigest(x[0]), x[2]))
    cells = [np.frombuffer(x, np.int32) for x, _, _ in got]
    swaps = [(i, np.frombuffer(x, np.int32)) for i, (_, x, _) in enumerate(got) if x is not None]
    return fit(cells, np.array([y for _, _, y in got], np.float64), swaps, penalty=penalty, ridge=ridge, steps=steps)


def score(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_rows: int = 10_000, most_bytes: int = 64 << 20, penalty: float = 1.0, ridge: float = 1e-5, steps: int = 120) -> DataFrame:
    """One row per document: id, score (0 to 1)."""
    weights, bias = learn(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, most_rows=most_rows, most_bytes=most_bytes, penalty=penalty, ridge=ridge, steps=steps)
    model = C.Shared(docs.sparkSession, (weights, bias, Features()))
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(batch: pa.RecordBatch) -> dict:
        weights, bias, features = model.value
        z = [bias + float(weights[features.text(set((t or b"").translate(C.LOWER).split()))].sum(dtype=np.float64)) for t in C.text_bytes(batch.column(1))]
        return {"id": batch.column(0), "score": (1 / (1 + np.exp(-np.clip(z, -30, 30)))).tolist()}

    return C.map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), rows, f"id {kind}, score double", at_once=1000).withColumnRenamed("id", id_col)
