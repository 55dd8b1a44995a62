"""SentencePiece encoding and decoding in batched numpy.

A text is cut into words (a run of ▁ and what follows up to the next ▁; no piece reaches across, which is checked when a
model is read). Distinct words of equal length advance together: rolling hashes of their substrings probe the sorted
hashes of the pieces. For models of type unigram this is Viterbi: for each end, the vectorised maximum over starts stores score and
backpointer. For models of type BPE, whose scores are ranks of merges and not log-probabilities, Viterbi gives other ids
than the model means; there each step merges, in all words at once, the adjacent pair whose piece has the vectorised maximum.
Characters without a piece become byte pieces, or the unknown id where a model has none.

Nulls and odd rows: a null text has null ids, an empty text none; words of any length are whole words; decoding is exact
but for ▁ itself, which SentencePiece reads as a space; repeated rows are encoded alike; of ways of equal score within a word
the one whose last piece starts first is taken, as are the leftmost of equal merges; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C

SPACE = "▁"
BASE = np.uint64(0x9E3779B97F4A7C55)
#: Types of pieces and of models, as in the public sentencepiece_model.proto.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
UNKNOWN_PENALTY = 10.0


def fields(data: bytes):
    """(number, value) of each field of a protobuf message."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            b = data[i]
            i += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while i < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, data[i : i + n]
            i += n


class Model:
    def __init__(self, proto: bytes):
        self.pieces, self.scores, self.types = [], [], []
        self.kind, self.dummy_prefix, self.extra_spaces, charsmap = UNIGRAM, True, True, b""
        for number, value in fields(proto):
            if number == 1:
                piece = dict(fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(float(np.frombuffer(piece[2], np.float32)[0]) if 2 in piece else 0.0)
                self.types.append(piece.get(3, NORMAL))
            elif number == 2:
                self.kind = dict(fields(value)).get(3, UNIGRAM)
            elif number == 3:
                norm = dict(fields(value))
                self.dummy_prefix, self.extra_spaces, charsmap = bool(norm.get(3, 1)), bool(norm.get(4, 1)), norm.get(2, b"")
        if charsmap or self.extra_spaces:
            raise ValueError("only models that leave the text as it is (identity, no removal of spaces) can be read")
        usable = [i for i, t in enumerate(self.types) if t in (NORMAL, USER)]
        if any(re.search(f"[^{SPACE}]{SPACE}", self.pieces[i]) for i in usable):
            raise ValueError("a piece reaches across words")
        if any(self.types[i] == USER for i in usable):
            raise ValueError("user-defined pieces are not supported")
        self.longest = max(len(self.pieces[i]) for i in usable)
        self.power = self.powers(64)
        keys = np.array([self.key(self.pieces[i]) for i in usable], np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ids = keys[order], np.array(usable, np.int32)[order]
        assert (self.keys[1:] != self.keys[:-1]).all(), "two pieces of one hash"
        #: by the first 20 bits of a hash: whether a piece may have it
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.keys >> np.uint64(44)] = True
        self.score = np.array(self.scores, np.float32)
        self.unknown = self.types.index(UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == BYTE}
        self.low = np.float32(min(self.scores[i] for i in usable) - UNKNOWN_PENALTY)
        self.plain = [bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else p.replace(SPACE, " ").encode() for p, t in zip(self.pieces, self.types, strict=True)]
        #: ids of words, as bytes
        self.known: dict[str, bytes] = {}
        self.split = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall

    @staticmethod
    def powers(n: int) -> np.ndarray:
        return np.concatenate(([np.uint64(1)], np.multiply.accumulate(np.full(n, BASE, np.uint64))))

    def key(self, piece: str) -> int:
        return int(self.rolling(np.array([[ord(c) for c in piece]], np.uint64))[0, -1])

    def rolling(self, chars: np.ndarray) -> np.ndarray:
        """Hashes of all prefixes, a row for each word."""
        out = np.zeros((chars.shape[0], chars.shape[1] + 1), np.uint64)
        mixed = C.mix(chars + np.uint64(1))
        for j in range(chars.shape[1]):
            out[:, j + 1] = out[:, j] * BASE + mixed[:, j]
        return out

    def find(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray | None = None) -> np.ndarray:
        """Ids of the pieces that equal the substrings of each row, or -1."""
        row = np.arange(len(prefix))[:, None] if row is None else row
        if (most := int((end - start).max(initial=0))) >= len(self.power):
            self.power = self.powers(2 * most)
        keys = prefix[row, end] - prefix[row, start] * self.power[end - start]
        ids = np.full(keys.shape, -1, np.int32)
        maybe = self.seen[keys >> np.uint64(44)]
        probe = keys[maybe]
        at = np.minimum(np.searchsorted(self.keys, probe), len(self.keys) - 1)
        ids[maybe] = np.where(self.keys[at] == probe, self.ids[at], -1)
        return ids

    def viterbi(self, prefix: np.ndarray) -> list[np.ndarray]:
        """Starts of the best pieces of each word, first to last, and the word's end."""
        words, n = prefix.shape[0], prefix.shape[1] - 1
        best = np.full((words, n + 1), -np.inf, np.float32)
        back = np.zeros((words, n + 1), np.int32)
        best[:, 0] = 0
        for end in range(1, n + 1):
            starts = np.arange(max(0, end - self.longest), end)
            ids = self.find(prefix, np.broadcast_to(starts, (words, len(starts))), np.full((words, len(starts)), end))
            step = np.where(ids >= 0, self.score[ids], -np.inf).astype(np.float32)
            step[:, -1] = np.where(ids[:, -1] >= 0, step[:, -1], self.low)
            total = best[:, starts] + step
            at = total.argmax(axis=1)
            best[:, end] = total[np.arange(words), at]
            back[:, end] = starts[at]
        out = []
        for w in range(words):
            cuts = [n]
            while cuts[-1]:
                cuts.append(int(back[w, cuts[-1]]))
            out.append(np.array(cuts[::-1]))
        return out

    def merge(self, prefix: np.ndarray) -> list[np.ndarray]:
        """The same, by merging in each word the adjacent pair of the best piece, the leftmost of equals, until none is left."""
        words, n = prefix.shape[0], prefix.shape[1] - 1
        out: list = [None] * words
        left = np.arange(words)
        cuts = np.tile(np.arange(n + 1), (words, 1))
        score = self.pair_score(prefix, cuts[:, :-2], cuts[:, 2:]) if n > 1 else np.empty((words, 0), np.float32)
        while len(left):
            if score.shape[1]:
                at = score.argmax(axis=1)
                more = score[np.arange(len(left)), at] > -np.inf
            else:
                more = np.zeros(len(left), bool)
            if not more.all():
                for w, c in zip(left[~more].tolist(), cuts[~more], strict=True):
                    out[w] = c
                left, cuts, score, prefix = left[more], cuts[more], score[more], prefix[more]
                at = at[more] if score.shape[1] else None
            if len(left):
                row = np.arange(len(left))
                stay = np.ones(cuts.shape, bool)
                stay[row, at + 1] = False
                cuts = cuts[stay].reshape(len(left), -1)
                score = score[stay[:, 1:-1]].reshape(len(left), -1)
                m = score.shape[1]
                for near in (at - 1, at):  # only the pairs beside the new piece change
                    ok = (near >= 0) & (near < m)
                    r, c = row[ok], near[ok]
                    score[r, c] = self.pair_score(prefix, cuts[r, c], cuts[r, c + 2], r)
        return out

    def pair_score(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray | None = None) -> np.ndarray:
        ids = self.find(prefix, start, end, row)
        return np.where(ids >= 0, self.score[ids], np.float32(-np.inf))

    def merge_long(self, prefix: np.ndarray) -> np.ndarray:
        """merge() of one long word, with a queue of pairs."""
        n = prefix.shape[1] - 1
        after, before, queue = list(range(1, n + 2)), list(range(-1, n)), []

        def pairs(starts: list[int]) -> None:
            starts = [s for s in starts if s >= 0 and after[s] < n]
            ends = [after[after[s]] for s in starts]
            if starts:
                ids = self.find(prefix, np.array([starts]), np.array([ends]))[0]
                for s, e, i in zip(starts, ends, ids.tolist(), strict=True):
                    if i >= 0:
                        heapq.heappush(queue, (-float(self.score[i]), s, e))

        pairs(list(range(n)))
        alive = [True] * n
        while queue:
            _, s, e = heapq.heappop(queue)
            mid = after[s]
            if alive[s] and mid < n and after[mid] == e:
                alive[mid] = False
                after[s] = e
                if e < n:
                    before[e] = s
                pairs([before[s], s])
        return np.array([*(i for i in range(n) if alive[i]), n])

    def learn(self, words: list[str]) -> None:
        """Encode new words, those of one length together."""
        by_length: dict[int, list[str]] = {}
        for w in words:
            w = w[1:] if w[0] == SPACE else SPACE + w
            by_length.setdefault(len(w), []).append(w)
        for n, same in by_length.items():
            block = max(1, 400_000 // n)
            for i in range(0, len(same), block):
                part = same[i : i + block]
                chars = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), n).astype(np.uint64)
                prefix = self.rolling(chars)
                if self.kind == UNIGRAM:
                    cuts = self.viterbi(prefix)
                else:
                    cuts = self.merge(prefix) if n <= 64 else [self.merge_long(prefix[j : j + 1]) for j in range(len(part))]
                sizes = np.array([len(c) - 1 for c in cuts])
                start, end = np.concatenate([c[:-1] for c in cuts]), np.concatenate([c[1:] for c in cuts])
                found = self.find(prefix, start, end, np.repeat(np.arange(len(part)), sizes))
                plain = np.minimum.reduceat(found, np.cumsum([0, *sizes[:-1]])) >= 0
                raw, at = found.astype(np.int32).tobytes(), 0
                for word, size, whole in zip(part, sizes.tolist(), plain.tolist(), strict=True):
                    key = word[1:] if word[0] == SPACE and len(word) > 1 and word[1] != SPACE else SPACE + word
                    if whole:
                        self.known[key] = raw[4 * at : 4 * (at + size)]
                    else:
                        self.known[key] = np.array(self.fall_back(word, start[at : at + size].tolist(), found[at : at + size].tolist()), np.int32).tobytes()
                    at += size

    def fall_back(self, word: str, starts: list[int], found: list[int]) -> list[int]:
        ids: list[int] = []
        for s, i in zip(starts, found, strict=True):
            if i >= 0:
                ids.append(i)
            elif self.bytes:
                ids.extend(self.bytes[b] for b in word[s].encode("utf-8", "surrogatepass"))
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
        return ids

    def words(self, text: str) -> list[str]:
        """The text's words. Where every ▁ is a single space before a word, they go without it."""
        if self.dummy_prefix and text and SPACE not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [w[1:] if w[0] == SPACE and len(w) > 1 and w[1] != SPACE else SPACE + w for w in self.split((SPACE if self.dummy_prefix and text else "") + text.replace(" ", SPACE))]

    def encode_arrays(self, texts: list[str | None]) -> list[np.ndarray | None]:
        cut = [None if t is None else self.words(t) for t in texts]
        if len(self.known) > 400_000:
            self.known = {}
        self.learn(sorted(set().union(*(c for c in cut if c)) - self.known.keys()))
        known = self.known.__getitem__
        return [None if c is None else np.frombuffer(b"".join(map(known, c)), np.int32) for c in cut]

    def encode(self, texts: list[str | None]) -> list[list[int] | None]:
        return [None if x is None else x.tolist() for x in self.encode_arrays(texts)]

    def decode(self, ids: list[list[int] | np.ndarray | None]) -> list[str | None]:
        out, plain = [], self.plain.__getitem__
        for x in ids:
            if x is None:
                out.append(None)
                continue
            text = b"".join(map(plain, x.tolist() if isinstance(x, np.ndarray) else x)).decode("utf-8", "replace")
            out.append(text[1:] if self.dummy_prefix and text.startswith(" ") else text)
        return out


def encode(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """One row per document: id, ids (array), decoded (the text that the ids give back) and, if asked for, text."""
    with open(model_path, "rb") as f:
        model = C.Shared(docs.sparkSession, Model(f.read()))
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(batch: pa.RecordBatch) -> dict:
        texts = batch.column(1).to_pylist()
        ids, decoded = [], []
        for i in range(0, len(texts), 1000):
            part = model.value.encode_arrays(texts[i : i + 1000])
            ids += part
            decoded += model.value.decode(part)
        ends = np.cumsum([0, *(0 if x is None else len(x) for x in ids)]).astype(np.int32)
        flat = np.concatenate([x for x in ids if x is not None] or [np.empty(0, np.int32)])
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=pa.array([x is None for x in ids]))
        return {"id": batch.column(0), "ids": lists, "decoded": decoded} | ({"text": batch.column(1)} if keep_text else {})

    return C.map_batches(docs.select(F.col(id_col), F.col(text_col).cast("string")), rows, f"id {kind}, ids array<int>, decoded string" + ", text string" * keep_text).withColumnRenamed("id", id_col)
