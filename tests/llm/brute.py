"""Plain Python versions of the corpus operators, for small inputs."""

import hashlib
import re
from collections import Counter

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return BLANK.findall(text or "")


def shingles(text, k):
    w = words(lower(text))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def classes(rows, k, percent):
    """{(row number): (set size, smallest id of its class)} of rows (id, text)."""
    sets = [shingles(t, k) for _, t in rows]
    top = list(range(len(rows)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if same and 100 * same >= percent * len(sets[i] | sets[j]):
                top[root(i)] = root(j)
    names = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            names[root(i)] = min(names.get(root(i), key), key)
    return [(len(sets[i]), names.get(root(i)) if sets[i] else rows[i][0]) for i in range(len(rows))]


def contaminated(text, items, window=10):
    """(n_words, n_hit, sorted item ids)"""
    w, hit, found = ALNUM.findall(lower(text)), set(), set()
    for item, t in items:
        b = ALNUM.findall(lower(t))
        n = min(window, len(b))
        grams = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
        for i in range(len(w) - n + 1) if n else ():
            if tuple(w[i : i + n]) in grams:
                hit.update(range(i, i + n))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


def repeats_removed(texts, window=35):
    """[(n_words, n_removed, kept)]"""
    all_words = [words(t) for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in all_words for i in range(len(w) - window + 1))
    out = []
    for w in all_words:
        gone = {p for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for p in range(i, i + window)}
        kept = [x for p, x in enumerate(w) if p not in gone]
        out.append((len(w), len(gone), " ".join(kept)))
    return out


def quality_counts(text):
    text = text or ""
    w = words(text)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    repeated = {p for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
