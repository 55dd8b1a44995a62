"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters, each pair verified once.

1. One pass gives each text its set of k-word shingles (64-bit hashes) and the set's fingerprint; texts of equal sets are
   one node. The same pass counts all shingles of the corpus in 2**22 cells (16 MB whatever the input).
2. A set's shingles are ordered by (count of their cell, hash), rare first: one order for all. Two sets of Jaccard
   similarity t share a shingle in their first n - ceil(t n) + 1, so only prefixes are joined, and only shingles that are in
   the prefix of two nodes go on.
3. A shingle of at most `hot` nodes is joined with itself. A pair is passed over where both nodes have the same shingle just
   before, as it is listed there or earlier; the others meet the length, positional and suffix filter, and each that is left is
   verified once, from the sets themselves. Pairs are dealt to homes, so that a family of near copies brings each set once.
4. The nodes of a shingle of more nodes (a hot one) meet leaders. Where they lie in several components, a few leaders from outside its largest one
   (nodes of most hot shingles first) meet all its nodes of other components: first one leader a shingle, then 16. A family of near copies is one component
   after the first round, for a row a node and shingle. What is left apart is compared in blocks: the nodes outside the largest component with all nodes of the
   shingle, by their signs only (64 bytes a node). Every pair of two components that has a hot shingle in common and passes the filters is verified,
   so no link between components is lost; links within a component change nothing.
5. Links make the components.

With numbers of links (`count`) all pairs of hot shingles have to be judged: step 4 cuts a hot shingle's nodes by length into bands (linked sets lie
in one band or in neighbouring ones) and by hash into blocks; each two blocks are one piece of work, in which the shared shingles of all
pairs are counted at once. A pair is judged at the first such shingle that it shares, and never in step 3. The rows of work grow with nodes times blocks
for each hot shingle, each with the node's set: ask for numbers only where families have thousands of members, not millions.

Nulls, ties and odd rows: a null or wordless text has the empty set and links with nothing; a text of fewer than k words
is one shingle; equal sets always link; rows of one id stay separate rows; a null id takes part, but a class is named
by its smallest id that isn't null; other columns are never read; an empty table gives no rows; a text of any length is one set.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from tessera.llm import common as C
from tessera.llm.components import connect

CELLS, SLICES = 1 << 22, 1024
#: The suffix filter parts the hashes of a set into 64 * SIGNS classes and keeps the parity of each class.
SIGNS = 8
#: Shingles of the sets that one piece of work holds, about, and columns of the tables in which shared ones are counted.
PIECE, COLUMNS = 1 << 21, 8192
#: Rows of a table of numbers that may be broadcast.
SMALL = 200_000


def shingles(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of k-word shingles of the text, A-Z lower-cased."""
    words = (text or b"").translate(C.LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(C.gram_hashes(C.word_hashes(words), min(k, len(words))) ^ np.uint64(min(k, len(words))))


def node_of(s: np.ndarray) -> int | None:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64))) if len(s) else None


def signs(s: np.ndarray) -> np.ndarray:
    """Parities of the set's classes, as SIGNS 64-bit words. Two sets differ in at least as many shingles as parities."""
    at = C.mix(s) >> np.uint64(55)
    bits = np.bincount(at.astype(np.int64), minlength=64 * SIGNS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def near_size(percent: int) -> str:
    """Length filter of two rows of sizes n and n2."""
    return f"100 * least(n, n2) >= {percent} * greatest(n, n2)"


def near_place(percent: int) -> str:
    """Positional filter: at the first shingle that two sets share (one row of the pair is that), they share it and what follows at most."""
    most = "least(n - at, n2 - at2)"
    return f"100 * ({most}) >= {percent} * (n + n2 - ({most}))"


def near_sign(percent: int) -> str:
    """Suffix filter: linked sets differ in (100 - t)/(100 + t) of n + n2 at most."""
    apart = " + ".join(f"bit_count(sign[{i}] ^ sign2[{i}])" for i in range(SIGNS))
    return f"{100 + percent} * ({apart}) <= {100 - percent} * (n + n2)"


def need(n: int, percent: int) -> int:
    """ceil(percent / 100 * n)"""
    return (percent * n + 99) // 100


def band(percent: int) -> Column:
    """Sizes of linked sets lie in one band or in two next to each other; a little wider, so that rounding can't part them."""
    return F.floor(F.log(F.col("n").cast("double")) / (math.log(100 / percent) * (1 + 1e-9))).cast("int") if percent < 100 else F.col("n").cast("int")


def batched(schema: str):
    target = to_arrow_schema(_parse_datatype_string(schema))
    return lambda columns: pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for f, x in zip(target, columns, strict=True)], schema=target)


def measure(docs: DataFrame, k: int) -> tuple[DataFrame, np.ndarray]:
    """(id, n, node) of each row of (id, text), and the corpus's counts of shingles by cell."""
    kind = docs.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n bigint, node bigint, slice int, counts binary"
    record = batched(schema)
    C.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, held, size = np.zeros(CELLS, np.uint32), [], 0
        for batch in batches:
            sets = [shingles(t, k) for t in C.text_bytes(batch.column(1))]
            for s in sets:
                held.append((s % np.uint64(CELLS)).astype(np.int32))
                size += len(s)
            if size > CELLS:
                cells += np.bincount(np.concatenate(held), minlength=CELLS).astype(np.uint32)
                held, size = [], 0
            none = [None] * len(sets)
            yield record([batch.column(0), [len(s) for s in sets], [node_of(s) for s in sets], none, none])
        if size:
            cells += np.bincount(np.concatenate(held), minlength=CELLS).astype(np.uint32)
        for i, part in enumerate(np.split(cells, SLICES)):
            if part.any():
                yield record([[None], [None], [None], [i], [zlib.compress(part.tobytes(), 1)]])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[i] = total.get(i, 0) + np.frombuffer(zlib.decompress(x), np.uint32).astype(np.uint64)
        for i, x in total.items():
            yield pa.RecordBatch.from_pydict({"slice": pa.array([i], pa.int32()), "counts": pa.array([zlib.compress(np.minimum(x, 0xFFFFFFFF).astype(np.uint32).tobytes(), 1)], pa.binary())})

    both = C.materialise(docs.mapInArrow(run, schema), "jaccard-nodes")
    cells = np.zeros(CELLS, np.uint32)
    parts = both.where("slice is not null").select("slice", "counts").repartition("slice").mapInArrow(add, "slice int, counts binary").collect()
    for i, x in parts:
        cells[i * CELLS // SLICES : (i + 1) * CELLS // SLICES] = np.frombuffer(zlib.decompress(x), np.uint32)
    return both.where("slice is null").select("id", "n", "node"), cells


def prefixes(texts: DataFrame, cells: np.ndarray, k: int, percent: int, scratch: C.Scratch) -> DataFrame:
    """(node, n, sign, tokens: prefix shingles in order) of each node, maybe more than once."""
    shared_cells = C.Shared(texts.sparkSession, cells)
    schema = "node bigint, n int, sign array<bigint>, tokens array<bigint>"
    record = batched(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            nodes, sizes, sign, tokens = [], [], [], []
            for t in C.text_bytes(batch.column(0)):
                s = shingles(t, k)
                node = node_of(s)
                if node is None or node in seen:
                    continue
                seen.add(node)
                n = len(s)
                first = n - need(n, percent) + 1
                sign.append(signs(s))
                count = shared_cells.value[(s % np.uint64(CELLS)).astype(np.int64)]
                if first < n:
                    some = np.flatnonzero(count <= np.partition(count, first - 1)[first - 1])
                    s, count = s[some], count[some]
                nodes.append(node)
                sizes.append(n)
                tokens.append(s[np.lexsort((s, count))[:first]].view(np.int64))
            if len(seen) > 1_000_000:
                seen.clear()
            flat = np.concatenate(tokens) if tokens else np.empty(0, np.int64)
            offsets = np.cumsum([0, *map(len, tokens)]).astype(np.int32)
            yield record([nodes, sizes, sign, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))])

    return scratch.table(texts.mapInArrow(run, schema), "jaccard-prefixes")


def shared_entries(lists: DataFrame, hot: int, scratch: C.Scratch) -> DataFrame:
    """(token, node, n, at, prev, hot) of each prefix shingle that several nodes have; prev is the shingle before it, or the node itself at
    the first place; hot if more than `hot` nodes have it."""
    before = F.concat(F.array("node"), F.slice("tokens", F.lit(1), F.greatest(F.size("tokens") - 1, F.lit(0))))
    entries = lists.select("node", "n", F.posexplode(F.arrays_zip(F.col("tokens").alias("token"), before.alias("prev"))).alias("at", "x")).select("node", "n", "at", "x.token", "x.prev")
    common = entries.groupBy("token").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most").select("token")
    entries, path = C.materialise_at(entries.join(common, "token").dropDuplicates(["token", "node"]), "jaccard-shared")
    many = entries.groupBy("token").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > hot).select("token", F.lit(True).alias("hot"))
    marked = scratch.table(entries.join(many, "token", "left").withColumn("hot", F.coalesce("hot", F.lit(False))), "jaccard-entries")
    C.discard(lists.sparkSession, path)
    return marked


def listed_pairs(entries: DataFrame, lists: DataFrame, percent: int, scratch: C.Scratch) -> DataFrame:
    """(a, b, home, part): the pairs of nodes that share a shingle of few nodes and pass the filters, dealt out by home and part."""
    few = entries.where("not hot").select("token", "node", "n", "at", "prev")
    other = few.select("token", F.col("node").alias("node2"), F.col("n").alias("n2"), F.col("at").alias("at2"), F.col("prev").alias("prev2"))
    pairs = few.join(other, "token").where(f"node < node2 and prev <> prev2 and {near_size(percent)} and {near_place(percent)}")
    pairs = pairs.select(F.col("node").alias("a"), F.col("node2").alias("b")).distinct()
    sign = lists.select("node", "n", "sign").dropDuplicates(["node"])
    pairs = pairs.join(sign.withColumnRenamed("node", "a"), "a").join(sign.select(F.col("node").alias("b"), F.col("n").alias("n2"), F.col("sign").alias("sign2")), "b")
    return at_home(pairs.where(near_sign(percent)).select("a", "b", (F.col("n") + F.col("n2")).alias("size")), scratch)


def at_home(pairs: DataFrame, scratch: C.Scratch) -> DataFrame:
    """(a, b, home, part) of pairs (a, b, size: shingles of both)."""
    pairs = scratch.table(pairs, "jaccard-pairs")
    # the least neighbour's home: in a family of near copies that is one home for all
    ends = pairs.select("a", "b").union(pairs.select("b", "a"))
    homes = ends.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("home"))
    pairs = pairs.join(homes, "a")
    parts = pairs.groupBy("home").agg(F.ceil(F.sum("size") / PIECE).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("a", "b"), F.col("parts")).cast("int").alias("part")
    return scratch.table(pairs.join(parts, "home").select("a", "b", "home", part), "jaccard-homes")


def block_pieces(entries: DataFrame, percent: int, block: int) -> DataFrame:
    """(node, token, band, i, j, low, own): each node of a hot shingle in every piece of work that needs it; low: it lies in the piece's own
    band, else in the next; own: its block, i or j."""
    rows = entries.where("hot").select("token", "node", "n", band(percent).alias("own_band"))
    rows = rows.withColumn("low", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("band", F.col("own_band") - F.when(F.col("low"), 0).otherwise(1))
    groups = rows.groupBy("token", "band").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("size"), F.max("low").alias("any"))
    # a band that has no nodes of its own has no work
    groups = groups.where("any and m > 1").select("token", "band", F.ceil(F.greatest(F.col("m") / block, F.col("size") / PIECE)).cast("int").alias("blocks"))
    rows = rows.join(groups, ["token", "band"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select("node", "token", "band", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), "low", "own")


def node_sets(texts: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(node, s: shingles), for these nodes and maybe a few more."""
    some = C.Shared(texts.sparkSession, C.Bitmap(nodes, "node"))
    record = batched("node bigint, s binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            sets = [s for s in (shingles(t, k) for t in C.text_bytes(batch.column(0))) if len(s)]
            nodes = [node_of(s) for s in sets]
            wanted = some.value.holds(np.array(nodes, np.int64).view(np.uint64)).tolist()
            out: list[list] = [[], []]
            for node, s, w in zip(nodes, sets, wanted, strict=True):
                if w and node not in seen:
                    seen.add(node)
                    out[0].append(node)
                    out[1].append(s.tobytes())
            if len(seen) > 1_000_000:
                seen.clear()
            yield record(out)

    return texts.mapInArrow(run, "node bigint, s binary").dropDuplicates(["node"])


class Piece:
    """Sets of nodes that meet in one place: the pairs to verify, or two blocks of a hot shingle."""

    def __init__(self) -> None:
        self.pairs: list[tuple[int, int]] = []
        self.nodes: dict[int, int] = {}
        self.sets: list[np.ndarray] = []
        self.size: list[int] = []
        self.hot: list[np.ndarray] = []
        self.low: list[bool] = []
        self.own: list[int] = []

    def add(self, node: int, s: bytes, size: int, hot: list[int], low: bool, own: int) -> None:
        if node not in self.nodes:
            self.nodes[node] = len(self.sets)
            self.sets.append(np.frombuffer(s, np.uint64))
            self.size.append(size)
            self.hot.append(np.array(hot or [], np.int64))
            self.low.append(low)
            self.own.append(own)

    def verified(self, percent: int) -> Iterator[tuple[int, int | None, int]]:
        """(node, None, rows it is linked with) and (node, node, 0) of each link."""
        count: dict[int, int] = {}
        for a, b in self.pairs:
            i, j = self.nodes[a], self.nodes[b]
            if len(np.intersect1d(self.hot[i], self.hot[j], True)):
                continue  # judged with the hot shingle's blocks
            both = np.concatenate((self.sets[i], self.sets[j]))
            both.sort(kind="stable")
            same = int((both[1:] == both[:-1]).sum())
            if 100 * same >= percent * (len(both) - same):
                count[a] = count.get(a, 0) + self.size[j]
                count[b] = count.get(b, 0) + self.size[i]
                yield a, b, 0
        for a, n in count.items():
            yield a, None, n

    def blocks(self, token: int, i: int, j: int, percent: int) -> Iterator[tuple[int, int | None, int]]:
        """The same for all pairs of block i with block j whose first hot shingle in common is this token; a spanning forest in place of all links."""
        own, low, n = np.array(self.own), np.array(self.low), np.array([len(s) for s in self.sets])
        x, y = np.flatnonzero(own == i), np.flatnonzero(own == j)
        if not len(x) or not len(y):
            return
        may = (low[x][:, None] | low[y]) & (100 * np.minimum(n[x][:, None], n[y]) >= percent * np.maximum(n[x][:, None], n[y]))
        if i == j:
            may &= x[:, None] < y
        ahead = [h[: int(np.flatnonzero(h == token)[0])] for h in self.hot]
        may &= shared(ahead, x, y) == 0
        x, y, may = x[rows := may.any(axis=1)], y[columns := may.any(axis=0)], may[rows][:, columns]
        if not may.any():
            return
        same = shared(self.sets, x, y)
        linked = may & (100 * same >= percent * (n[x][:, None] + n[y] - same))
        size, nodes = np.array(self.size, np.int64), list(self.nodes)
        total = np.zeros(len(n), np.int64)
        total[x] += linked @ size[y]
        total[y] += size[x] @ linked
        root = np.arange(len(n))
        while True:
            old = root.copy()
            root[x] = np.minimum(root[x], np.where(linked, root[y], len(n)).min(axis=1))
            root[y] = np.minimum(root[y], np.where(linked, root[x][:, None], len(n)).min(axis=0))
            if (old == root).all():
                break
        for v in np.flatnonzero(total).tolist():
            yield nodes[v], None, int(total[v])
            if root[v] != v:
                yield nodes[v], nodes[root[v]], 0


def shared(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many members each set of x has in common with each of y: products of 0/1 tables, some columns at a time."""
    out = np.zeros((len(x), len(y)), np.float32)
    members, inside = np.concatenate([sets[i] for i in x]), np.concatenate([sets[i] for i in y])
    both = np.intersect1d(members, inside)
    if not len(both):
        return out.astype(np.int64)

    def cells(flat: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(both, flat), len(both) - 1)
        row = np.repeat(np.arange(len(which)), [len(sets[i]) for i in which])
        there = both[at] == flat
        at, row = at[there], row[there]
        order = np.argsort(at, kind="stable")
        return at[order], row[order]

    (ax, rx), (ay, ry) = cells(members, x), cells(inside, y)
    for start in range(0, len(both), COLUMNS):
        tables = []
        for at, row, m in ((ax, rx, len(x)), (ay, ry, len(y))):
            lo, hi = np.searchsorted(at, (start, start + COLUMNS))
            table = np.zeros((m, min(COLUMNS, len(both) - start)), np.float32)
            table[row[lo:hi], at[lo:hi] - start] = 1
            tables.append(table)
        out += tables[0] @ tables[1].T
    return np.rint(out).astype(np.int64)


def homeward(pairs: DataFrame) -> DataFrame:
    """(node, key, band, i, j, low, own): both nodes of each pair where the pair is verified."""
    return  pairs.select(F.explode(F.array("a", "b")).alias("node"), F.col("home").alias("key"), F.lit(-1).alias("band"), F.col("part").alias("i"), F.lit(0).alias("j"), F.lit(True).alias("low"), F.lit(0).alias("own")).distinct()


def judged(work: DataFrame, sets: DataFrame, pairs: DataFrame, nodes: DataFrame, percent: int, scratch: C.Scratch) -> DataFrame:
    """(a, b, n): of each node a the numbers of rows n that it is linked with, to be added up (b null), and links (a, b) that join what is linked."""
    rows = work.join(nodes, "node").join(sets, "node").withColumn("b", F.lit(None).cast("bigint"))
    listed = pairs.select(F.col("a").alias("node"), "b", F.col("home").alias("key"), F.lit(-1).alias("band"), F.col("part").alias("i"), F.lit(0).alias("j"))
    key = ["key", "band", "i", "j"]
    columns = [*key, "node", "b", "s", "size", "hot", "low", "own"]
    rows = rows.select(columns).unionByName(listed, allowMissingColumns=True).repartition(*key).sortWithinPartitions(*key)
    record = batched("a bigint, b bigint, n bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, piece, out = None, Piece(), []

        def judge() -> None:
            if at is not None:
                out.extend(piece.verified(percent) if at[1] < 0 else piece.blocks(at[0], at[2], at[3], percent))

        for batch in batches:
            for *this, node, b, s, size, hot, low, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if this != at:
                    judge()
                    at, piece = this, Piece()
                    if len(out) > 20_000:
                        yield record(list(zip(*out, strict=True)))
                        out.clear()
                if s is None:
                    piece.pairs.append((node, b))
                else:
                    piece.add(node, s, size, hot, low, own)
        judge()
        if out:
            yield record(list(zip(*out, strict=True)))

    return scratch.table(rows.mapInArrow(run, "a bigint, b bigint, n bigint"), "jaccard-judged")


def known_components(hot: DataFrame, links: DataFrame, scratch: C.Scratch) -> tuple[DataFrame, DataFrame]:
    """Components (node, comp) of links, and the rows of those hot shingles whose nodes lie in several, with comp and whether they lie outside
    the shingle's largest component (rest)."""
    comps = connect(links)
    placed = scratch.table(hot.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "jaccard-placed")
    sizes = placed.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("m"))
    parts = sizes.groupBy("token").agg(F.max(F.struct("m", "comp")).alias("top"), F.sum("m").alias("all")).where(F.col("top.m") < F.col("all"))
    parts = C.if_small(parts.select("token", F.col("top.comp").alias("main"), "all", (F.col("all") - F.col("top.m")).alias("others")), SMALL)
    return comps, scratch.table(placed.join(parts, "token").withColumn("rest", F.col("comp") != F.col("main")).drop("main"), "jaccard-apart")


def led_pairs(apart: DataFrame, leaders: int, percent: int) -> DataFrame:
    """(a, b, size): up to `leaders` nodes of each hot shingle from outside its largest component, with its nodes of other components, filtered."""
    # those of most hot shingles first: of a family's members the one that the others were made from shares most with them, and leads at each shingle
    nth = F.row_number().over(Window.partitionBy("token").orderBy(F.desc("degree"), F.xxhash64("node"), "node"))
    first = apart.where("rest").withColumn("nth", nth).where(F.col("nth") <= leaders)
    first = first.select("token", F.col("node").alias("lead"), F.col("comp").alias("comp2"), F.col("n").alias("n2"), F.col("sign").alias("sign2"))
    met = apart.join(C.if_small(first, SMALL // 16), "token").where(f"comp <> comp2 and {near_size(percent)} and {near_sign(percent)}")
    return met.select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b"), (F.col("n") + F.col("n2")).alias("size")).distinct()


def crossed_pairs(apart: DataFrame, percent: int, block: int) -> DataFrame:
    """The same for all nodes from outside the largest component: blocks of them with blocks of all, by signs in tasks."""
    wide = 8 * block
    rows = apart.withColumn("bits", F.ceil(F.col("others") / block).cast("int")).withColumn("whole", F.ceil(F.col("all") / wide).cast("int"))
    hash_ = F.xxhash64("node")
    left = rows.where("rest").withColumn("x", F.pmod(hash_, F.col("bits")).cast("int")).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("whole") - 1))).withColumn("left", F.lit(True))
    right = rows.withColumn("y", F.pmod(hash_, F.col("whole")).cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("bits") - 1))).withColumn("left", F.lit(False))
    key = ["token", "x", "y"]
    work = left.select(*key, "left", "node", "comp", "n", "sign").unionByName(right.select(*key, "left", "node", "comp", "n", "sign"))
    record = batched("a bigint, b bigint, size bigint")

    def pairs(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        side = [np.array([r[4] for r in held if r[0] == want], np.int64).view(np.uint64).reshape(-1, SIGNS) for want in (True, False)]
        (node, comp, n), (node2, comp2, n2) = ([np.array([r[c] for r in held if r[0] == want], np.int64) for c in (1, 2, 3)] for want in (True, False))
        # so many nodes at once that their table has some millions of cells
        step = max(1, (1 << 21) // max(1, len(node2)))
        for at in range(0, len(node), step):
            some = slice(at, at + step)
            may = (comp[some, None] != comp2) & (100 * np.minimum(n[some, None], n2) >= percent * np.maximum(n[some, None], n2))
            apart_ = np.zeros(may.shape, np.int64)
            for w in range(SIGNS):
                apart_ += np.bitwise_count(side[0][some, w][:, None] ^ side[1][:, w])
            x, y = np.nonzero(may & ((100 + percent) * apart_ <= (100 - percent) * (n[some, None] + n2)))
            if len(x):
                one, two = node[some][x], node2[y]
                yield record([np.minimum(one, two), np.maximum(one, two), n[some][x] + n2[y]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for token, x, y, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (token, x, y) != at:
                    yield from pairs(held) if held else ()
                    at, held = (token, x, y), []
                held.append(row)
        yield from pairs(held) if held else ()

    return work.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "a bigint, b bigint, size bigint").distinct()


def hot_nodes(entries: DataFrame, lists: DataFrame) -> DataFrame:
    """(node, token, n, sign, degree: how many hot shingles the node has) of each hot shingle's nodes."""
    hot = entries.where("hot").select("token", "node", "n")
    degrees = hot.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    return hot.join(degrees, "node").join(lists.select("node", "sign").dropDuplicates(["node"]), "node")


def forest(texts: DataFrame, entries: DataFrame, lists: DataFrame, k: int, percent: int, block: int, rounds: tuple[int, ...], scratch: C.Scratch) -> DataFrame:
    """(node, comp) of each linked node."""
    spark = texts.sparkSession
    hot = scratch.table(hot_nodes(entries, lists), "jaccard-hot")
    pairs = listed_pairs(entries, lists, percent, scratch)
    wanted = scratch.table(hot.select("node").union(pairs.select("a")).union(pairs.select("b")).distinct(), "jaccard-wanted")
    sets = scratch.table(node_sets(texts, wanted, k), "jaccard-sets")
    nodes = wanted.select("node", F.lit(0).cast("bigint").alias("size"), F.lit(None).cast("array<bigint>").alias("hot"))

    def links(pairs: DataFrame) -> DataFrame:
        return judged(homeward(pairs), sets, pairs, nodes, percent, scratch).where("b is not null").select("a", "b")

    found = links(pairs)
    comps, apart = known_components(hot, found, scratch)
    for step in (*rounds, None):
        if not apart.limit(1).count():
            break
        new = crossed_pairs(apart, percent, block) if step is None else led_pairs(apart, step, percent)
        found = found.union(links(at_home(new, scratch)))
        C.release(spark)
        if step is None:
            return connect(found)
        comps, apart = known_components(hot, found, scratch)
    return comps


def join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 85, hot: int = 32, block: int = 512, count: bool = True, rounds: tuple[int, ...] = (1, 16)) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id (smallest id of the class that links make, its own included) and, with `count`,
    n_links, the number of other rows it is linked with."""
    texts, scratch = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), C.Scratch(docs.sparkSession)
    rows, cells = measure(texts, k)
    lists = prefixes(texts.select("text"), cells, k, percent, scratch)
    entries = shared_entries(lists, hot, scratch)
    every = scratch.table(rows.where("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("name")), "jaccard-sizes")
    others = None
    if count:
        several = entries.where("hot").groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "token"))), lambda x: x["token"]).alias("hot"))
        pairs = listed_pairs(entries, lists, percent, scratch)
        work = scratch.table(homeward(pairs).unionByName(block_pieces(entries, percent, block).withColumnRenamed("token", "key")), "jaccard-work")
        found = judged(work, node_sets(texts.select("text"), work.select("node"), k), pairs, every.select("node", "size").join(several, "node", "left"), percent, scratch)
        others = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
        comps = connect(found.where("b is not null").select("a", "b"))
    else:
        comps = forest(texts.select("text"), entries, lists, k, percent, block, rounds, scratch)
    every = every.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    names = every.groupBy("comp").agg(F.min("name").alias("component_id"))
    every = every.join(others, "node", "left") if count else every.withColumn("others", F.lit(None).cast("bigint"))
    every = C.materialise(every.join(names, "comp").select("node", "component_id", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")), "jaccard-classes")
    scratch.clear()
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id")
    out = rows.join(every, "node", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component, F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return out if count else out.drop("n_links")


def components(docs: DataFrame, **how) -> DataFrame:
    """join() without the numbers of links, for which families of near copies cost rows in proportion to their size."""
    return join(docs, **how, count=False)
