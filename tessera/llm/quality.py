"""Quality rules with risk-controlled thresholds.

Each rule is a ratio of counts (symbols, repeated lines, repeated words, capitals), cut into fixed bins. One in four labelled rows
of a stratum orders joint cutoffs of all rules, from mild to strict; the others are the holdout. There these steps are tried
as a fixed sequence (so they need no correction among themselves), and a step stands while the exact binomial bound says that at most
`risk` of good rows are lost by all rules together, at a level of `delta / strata` (Bonferroni). Of the steps that stand, the one with
the best balance of bad rows found against good rows lost is used, or none: a stratum of fewer than log(delta / strata) / log(1 - risk)
good rows can show nothing. A row is rejected if any rule's ratio lies above its stratum's cutoff.

Nulls, ties and odd rows: a null text has no words and fails the base rule; a null stratum is a stratum of its own; a stratum
without labels rejects by the base rule only; rows with a null id take part but have no label; labels repeated for one
id count once, as bad if any of them says so; a null label is no label; other columns are kept apart and never read; empty tables
give no rows; texts of any length are counted whole.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessera.llm import common as C

#: rule: (count, of which count)
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "capitals": ("n_capitals", "word_chars"),
}
BINS = 256
#: Bad rows that must be found for a good one that is lost.
WEIGHT = 10
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")


def repeat_words(h: np.ndarray, window: int = 8) -> int:
    """Words inside windows that occur twice or more."""
    g = C.gram_hashes(h, window)
    if len(g) < 2:
        return 0
    order = np.argsort(g, kind="stable")
    same = g[order][1:] == g[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(g), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(h) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def count_text(text: bytes) -> tuple[int, ...]:
    words = text.split()
    body = b"".join(words)
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\v\f\r")]
    continued = len(body) - len(body.translate(None, bytes(range(128, 192))))
    return (
        len(words),
        len(body) - continued,
        len(text) - len(text.translate(None, b"#*$%&|<>")),
        len(lines) - len(set(lines)),
        repeat_words(C.word_hashes(words)) if len(words) > 8 else 0,
        len(lines),
        len(body) - len(body.translate(None, bytes(range(65, 91)))),
    )


def text_counts(docs: DataFrame, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in `keep` and the counts of each text; the text may be one of them and then crosses over once."""
    sent = docs.select(*keep, *([text_col] if text_col not in keep else []))
    at = sent.columns.index(text_col)

    def rows(batch: pa.RecordBatch) -> dict:
        counts = [count_text(t or b"") for t in C.text_bytes(batch.column(at))]
        return {c: batch.column(i) for i, c in enumerate(keep)} | dict(zip(COUNTS, (list(x) for x in zip(*counts, strict=True)), strict=True))

    return C.map_batches(sent, rows, StructType([*(docs.schema[c] for c in keep), *(StructField(c, LongType()) for c in COUNTS)]), at_once=1000)


def base_failed() -> F.Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def rule_bin(rule: str) -> F.Column:
    """floor(BINS * ratio), in whole numbers; 0 where there is nothing to count."""
    part, whole = RULES[rule]
    return F.when(F.col(whole) > 0, F.expr(f"({BINS} * `{part}`) div `{whole}`")).otherwise(0).cast("int")


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of X ~ Binomial(n, p), exactly summed."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def ladder(cells: dict[str, np.ndarray]) -> list[tuple[str, int]]:
    """Steps (rule, cut) from the mildest joint cutoffs to the strictest: each lowers one rule's cut to where it finds most bad rows for a
    good row that it loses, by the counts (rule, bin, good, bad) of rows that are not in the holdout."""
    counts = {}
    for rule in RULES:
        some = cells["rule"] == rule
        good, bad = (np.bincount(np.clip(cells["bin"][some], 0, BINS + 1), cells[c][some], BINS + 2) for c in ("good", "bad"))
        counts[rule] = [good, bad, BINS + 1]
    steps: list[tuple[str, int]] = []
    while True:
        best = (0.0, 0.0, "", 0)
        for rule, (good, bad, cut) in counts.items():
            found, lost = np.cumsum(bad[1 : cut + 1][::-1]), np.cumsum(good[1 : cut + 1][::-1])
            if len(found) and found[-1]:
                ratio = found / (1 + WEIGHT * lost)
                at = int(np.flatnonzero(ratio == ratio.max())[-1])
                best = max(best, (float(ratio[at]), float(found[at]), rule, cut - 1 - at))
        if not best[0]:
            return steps
        steps.append(best[2:])
        counts[best[2]][2] = best[3]


def step_arrays(steps: list[tuple[str, int]]) -> dict[str, list[int]]:
    """For each rule and bin, the number of the first step (from 1) that rejects it; len(steps) + 1 if none does."""
    out = {rule: np.full(BINS + 2, len(steps) + 1, np.int32) for rule in RULES}
    for i, (rule, cut) in reversed(list(enumerate(steps, 1))):
        out[rule][cut + 1 :] = i
    return {rule: x.tolist() for rule, x in out.items()}


def choose_step(good: np.ndarray, bad: np.ndarray, risk: float, level: float) -> int:
    """How many steps stand, of the holdout's good and bad rows by first step that rejects them (from 1; the last is for those that none does).

    A fixed sequence: steps are tried from the mildest on, each at the whole level, until one fails. The bound is the exact
    (Clopper-Pearson) one: upper(k, n) <= risk just if P(X <= k | n, risk) <= level. Of those that stand, the one with the best balance
    of bad rows found against good rows lost is taken, the strictest of equals."""
    n_good, n_bad = int(good.sum()), int(bad.sum())
    if not n_good or not n_bad:
        return 0
    lost, found, best, chosen = 0, 0, 0.0, 0
    for i in range(len(good) - 1):
        lost, found = lost + int(good[i]), found + int(bad[i])
        if lost > risk * n_good or binomial_tail(lost, n_good, risk) > level:
            break
        gain = found / n_bad - WEIGHT * lost / n_good
        if gain >= best and found:
            best, chosen = gain, i + 1
    return chosen


def learn_cutoffs(counts: DataFrame, labels: DataFrame, *, stratum_col: str = "lang", id_col: str = "doc_id", label_col: str = "quality", risk: float = 0.02, delta: float = 0.05, tune: int = 4) -> DataFrame:
    """(stratum, a cutoff for each rule or null, and of the holdout: n_good, lost_good, n_bad, found_bad), from all labelled rows that pass the
    base rule. One in `tune`, by hash of the id, orders the steps; the others are the holdout."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).alias("__label"))
    rows = counts.where(~base_failed()).join(known, counts[id_col] == known["__id"])
    rows = rows.select(F.col(stratum_col).alias("stratum"), (F.col("__label") > 0).alias("good"), (F.pmod(F.xxhash64("__id"), F.lit(tune)) == 0).alias("tuning"), *(rule_bin(r).alias(f"bin_{r}") for r in RULES))
    rows = C.materialise(rows, "quality-labelled")
    many = [F.sum(F.col("good").cast("bigint")).alias("good"), F.sum((~F.col("good")).cast("bigint")).alias("bad")]
    pairs = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(f"bin_{r}").alias("bin")) for r in RULES)))
    cells = rows.where("tuning").select("stratum", "good", pairs.alias("x")).groupBy("stratum", "x.rule", "x.bin").agg(*many)
    kind = counts.schema[stratum_col].dataType.simpleString()

    def ladders(cells: pa.Table) -> pa.Table:
        steps = ladder({n: cells[n].to_numpy() for n in ("rule", "bin", "good", "bad")})
        found = {"stratum": cells["stratum"].slice(0, 1), "rules": [[r for r, _ in steps]], "cuts": [[c for _, c in steps]]}
        found |= {f"steps_{r}": [x] for r, x in step_arrays(steps).items()}
        return pa.table({n: x if n == "stratum" else pa.array(x, pa.list_(pa.string() if n == "rules" else pa.int32())) for n, x in found.items()})

    lists = ", ".join(f"steps_{r} array<int>" for r in RULES)
    steps = C.materialise(cells.groupBy("stratum").applyInArrow(ladders, f"stratum {kind}, rules array<string>, cuts array<int>, {lists}"), "quality-ladders")
    held = rows.where("not tuning").alias("h").join(C.if_small(steps, 100_000).alias("s"), F.col("h.stratum").eqNullSafe(F.col("s.stratum")))
    first = F.least(*(F.element_at(f"steps_{r}", F.least(F.col(f"bin_{r}"), F.lit(BINS + 1)) + 1) for r in RULES))
    tried = held.select("s.stratum", "good", first.alias("step")).groupBy("stratum", "step").agg(*many)
    tried = tried.groupBy("stratum").agg(F.collect_list(F.struct("step", "good", "bad")).alias("tried"))
    tried = steps.select("stratum", "rules", "cuts").alias("s").join(tried.alias("t"), F.col("s.stratum").eqNullSafe(F.col("t.stratum"))).select("s.*", "t.tried")
    tried = C.materialise(tried, "quality-steps")
    level = delta / max(1, C.count_rows(tried))

    def choose(batch: pa.RecordBatch) -> dict:
        out: dict = {"stratum": batch.column(0)} | {x: [] for x in (*(f"cut_{r}" for r in RULES), "n_good", "lost_good", "n_bad", "found_bad")}
        for rules, cuts, tried in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            good, bad = np.zeros(len(cuts) + 1, np.int64), np.zeros(len(cuts) + 1, np.int64)
            for x in tried:
                good[x["step"] - 1], bad[x["step"] - 1] = x["good"], x["bad"]
            n = choose_step(good, bad, risk, level)
            last = dict(zip(rules[:n], cuts[:n], strict=True))
            for r in RULES:
                out[f"cut_{r}"].append(last.get(r))
            for name, x, part in (("n_good", good, len(good)), ("lost_good", good, n), ("n_bad", bad, len(bad)), ("found_bad", bad, n)):
                out[name].append(int(x[:part].sum()))
        return out

    columns = ", ".join([*(f"cut_{r} int" for r in RULES), "n_good bigint, lost_good bigint, n_bad bigint, found_bad bigint"])
    return C.map_batches(tried.select("stratum", "rules", "cuts", "tried"), choose, f"stratum {kind}, {columns}")


def judge(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", label_col: str = "quality", risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """One row per document: id, stratum, counts, base_failed, the rules that reject it (array), kept."""
    counts = C.materialise(text_counts(docs, text_col=text_col, keep=(id_col, stratum_col)), "quality-counts")
    cuts = known_cutoffs(counts, labels, stratum_col=stratum_col, id_col=id_col, label_col=label_col, risk=risk, delta=delta)
    out = verdicts(counts.join(cuts, counts[stratum_col].eqNullSafe(cuts["stratum"]), "left"))
    return out.select(id_col, stratum_col, *COUNTS, "base_failed", "rejected_by", "kept")


def known_cutoffs(counts: DataFrame, labels: DataFrame, **how) -> DataFrame:
    return C.if_small(C.materialise(learn_cutoffs(counts, labels, **how), "quality-cutoffs"), 100_000)


def verdicts(rows: DataFrame) -> DataFrame:
    """Adds base_failed, rejected_by and kept to rows of counts and cutoffs."""
    against = F.array_compact(F.array(*(F.when(rule_bin(r) > F.col(f"cut_{r}"), F.lit(r)) for r in RULES)))
    out = rows.withColumn("rejected_by", against).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))


def keep(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", label_col: str = "quality", risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns."""
    counts = C.materialise(text_counts(docs, text_col=text_col, keep=(id_col, stratum_col)), "quality-counts")
    cuts = known_cutoffs(counts, labels, stratum_col=stratum_col, id_col=id_col, label_col=label_col, risk=risk, delta=delta)
    # columns by number, so that no name clashes with a count's
    names = [f"__{i}" for i in range(len(docs.columns))]
    rows = text_counts(docs.toDF(*names), text_col=names[docs.columns.index(text_col)], keep=tuple(names))
    kept = verdicts(rows.join(cuts, rows[names[docs.columns.index(stratum_col)]].eqNullSafe(cuts["stratum"]), "left")).where("kept")
    return kept.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)))
