"""Merkle manifest of a data set: a leaf for each row, a tree for each language, one over them, and a proof for each leaf.

Bottom-up, each level is written as a table of runs (one row a parent, with the hashes of its at most eight children). Top-down, each level's runs are
joined with the paths of their parents, and each child puts its own siblings before the path it inherits. Leaves come last and are joined
once with the runs above them; their paths, the longest of all, are hashed and folded in that task and never written.

Places of leaves come from sorted range partitions: a row's place is the number of rows in the partitions before plus its place in its own,
so no window holds a language.

Nulls, ties and odd rows: nulls of any column are `-`; a null id or language comes first; rows of one language and id are ordered by their
leaf, and equal rows are leaves of their own, each with its own proof; an empty text is `0:`; a language with one row has that leaf as subroot, and one
language alone has its subroot as root; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Low bits of monotonically_increasing_id: a row's place in its partition.
PLACE = 33


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """`-` for a null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def numbered(rows: DataFrame, keys: list[str], scratch: C.Scratch) -> DataFrame:
    """Adds `place`, from 0 in the order of the keys (nulls first), and writes the rows."""
    # equal rows are told apart by where they were read, or all of them would go to one partition
    dealt = rows.withColumn("__at", F.monotonically_increasing_id()).repartitionByRange(*keys, "__at").sortWithinPartitions(*keys, "__at").drop("__at")
    kept = scratch.table(dealt.withColumn("__row", F.monotonically_increasing_id()), "manifest-rows")
    part = F.shiftright("__row", PLACE)
    # a number for each partition, as Spark's own scheduler holds it
    sizes = sorted((p, n) for p, n in kept.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    ahead, before = 0, []
    for p, n in sizes:
        before.append((p, ahead))
        ahead += n
    before = rows.sparkSession.createDataFrame(before, "__p int, __ahead bigint")
    place = F.col("__ahead") + F.col("__row").bitwiseAND(F.lit((1 << PLACE) - 1))
    return kept.join(F.broadcast(before), part == F.col("__p")).withColumn("place", place).drop("__row", "__p", "__ahead")


def up(n: int, fan: int) -> int:
    return -(-n // fan)


def depth(n: int, fan: int) -> int:
    out = 0
    while n > 1:
        n, out = up(n, fan), out + 1
    return out


def build(nodes: DataFrame, deepest: int, fan: int, scratch: C.Scratch, kept: C.Scratch) -> tuple[list[DataFrame], DataFrame]:
    """Runs (tree, run, hashes, hash, n) of each level above nodes (tree, pos, hash, n: nodes of the tree), and (tree, hash, level) of each root.
    The lowest level lives in `kept`, the rest in `scratch`."""
    levels, roots = [], None
    for level in range(deepest + 1):
        done = nodes.where("n = 1").select("tree", "hash", F.lit(level).alias("level"))
        roots = done if roots is None else roots.unionByName(done)
        if level == deepest:
            break
        runs = nodes.where("n > 1").groupBy("tree", F.expr(f"pos div {fan}").alias("run"), "n").agg(F.array_sort(F.collect_list(F.struct("pos", "hash"))).alias("c"))
        runs = runs.select("tree", "run", F.col("c.hash").alias("hashes"), F.expr(f"(n + {fan - 1}) div {fan}").alias("n"))
        levels.append((scratch if level else kept).table(runs.withColumn("hash", F.sha2(F.concat_ws("", "hashes"), 256)), "manifest-level"))
        nodes = levels[-1].select("tree", F.col("run").alias("pos"), "hash", "n")
    return levels, scratch.table(roots, "manifest-roots")


def beside(hashes: Column, at: Column) -> Column:
    """What lies left and right of child `at` (from 0) in its run."""
    joined = lambda x: F.array_join(x, "")
    return F.struct(joined(F.slice(hashes, F.lit(1), at)).alias("left"), joined(F.slice(hashes, at + 2, F.size(hashes))).alias("right"))


def push(levels: list[DataFrame], roots: DataFrame, deepest: int, fan: int, scratch: C.Scratch, kept: C.Scratch) -> DataFrame:
    """(tree, run, hashes, path): the lowest runs, with the path above each. roots: (tree, level, path). A tree of one node has a run without hashes, whose path is the node's own."""
    paths = roots.where(F.col("level") == deepest).select("tree", F.lit(0).cast("bigint").alias("run"), "path")
    for level in range(deepest - 1, 0, -1):
        met = levels[level].join(paths, ["tree", "run"]).select("tree", "run", "path", "hashes", F.posexplode("hashes").alias("at", "hash"))
        below = met.select("tree", (F.col("run") * fan + F.col("at")).alias("run"), F.concat(F.array(beside(F.col("hashes"), F.col("at"))), "path").alias("path"))
        here = roots.where(F.col("level") == level).select("tree", F.lit(0).cast("bigint").alias("run"), "path")
        paths = (scratch if level > 1 else kept).table(below.unionByName(here), "manifest-paths")
    lone = roots.where("level = 0").select("tree", F.lit(0).cast("bigint").alias("run"), F.array().cast("array<string>").alias("hashes"), "path")
    return levels[0].join(paths, ["tree", "run"]).select("tree", "run", "hashes", "path").unionByName(lone) if deepest else lone


def proven(leaves: DataFrame, runs: DataFrame, fan: int) -> DataFrame:
    """Adds path to leaves (tree, pos, ...)."""
    at = (F.col("pos") % fan).cast("int")
    own = F.when(F.size("hashes") > 0, F.concat(F.array(beside(F.col("hashes"), at)), F.col("path"))).otherwise(F.col("path"))
    return leaves.withColumn("run", F.expr(f"pos div {fan}")).join(runs, ["tree", "run"]).withColumn("path", own).drop("hashes", "run")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda h, x: digest(x["left"], h, x["right"]))


def manifest(
    docs: DataFrame, *, id_col: str = "doc_id", group_col: str = "lang", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), fan: int = 8, changed: dict[str, Column] | None = None
) -> DataFrame:
    """One row a row of docs: id, leaf, subroot, root, path (array of left and right, from the leaf up) and, from leaves with the `changed` columns
    put in place, folded_root."""
    scratch, made = C.Scratch(docs.sparkSession), C.Scratch(docs.sparkSession)
    leaf = digest(*(field(F.col(c)) for c in columns))
    again = digest(*(field((changed or {}).get(c, F.col(c))) for c in columns))
    rows = docs.select(F.col(id_col).alias("id"), F.col(group_col).alias("group"), leaf.alias("leaf"), again.alias("again"))
    placed = numbered(rows, ["group", "id", "leaf"], made)
    # a tree is named by the place of its first leaf, which also orders the trees
    trees = made.table(placed.groupBy("group").agg(F.min("place").alias("tree"), F.count(F.lit(1)).alias("n")), "manifest-trees")
    leaves = placed.join(trees, placed["group"].eqNullSafe(trees["group"])).select("id", "leaf", "again", "tree", "n", (F.col("place") - F.col("tree")).alias("pos"))
    n_trees, most = trees.agg(F.count(F.lit(1)), F.max("n")).first()
    if not n_trees:
        return leaves.select(F.col("id").alias(id_col), "leaf", F.col("leaf").alias("subroot"), F.col("leaf").alias("root"), F.array(F.struct(F.col("leaf").alias("left"), F.col("leaf").alias("right"))).alias("path"), F.col("leaf").alias("folded_root"))
    deepest, top = depth(most, fan), depth(n_trees, fan)

    levels, roots = build(leaves.select("tree", "pos", F.col("leaf").alias("hash"), "n"), deepest, fan, scratch, made)
    over = numbered(roots.select("tree", "hash", "level"), ["tree"], scratch).select("tree", "hash", "level", F.col("place").alias("pos"), F.lit(n_trees).cast("bigint").alias("n"))
    above, root = build(over.select(F.lit(0).cast("bigint").alias("tree"), "pos", "hash", "n"), top, fan, scratch, scratch)
    empty = F.array().cast("array<struct<left:string,right:string>>")
    upper = push(above, root.select("tree", "level", empty.alias("path")), top, fan, scratch, scratch)
    paths = proven(over.select(F.lit(0).cast("bigint").alias("tree"), "pos", F.col("tree").alias("own"), "hash", "level"), upper, fan)
    paths = made.table(paths.select(F.col("own").alias("tree"), F.col("hash").alias("subroot"), "level", "path"), "manifest-subroots")

    lower = push(levels, paths.select("tree", "level", "path"), deepest, fan, scratch, made)
    out = proven(leaves, lower, fan).join(paths.select("tree", "subroot"), "tree")
    out = out.withColumn("root", F.lit(root.first()["hash"]))
    scratch.clear()  # what is in `made` is still to be read
    return out.select(F.col("id").alias(id_col), "leaf", "subroot", "root", "path", folded(F.col("again"), F.col("path")).alias("folded_root"))


def proof(path: Column) -> Column:
    """Hash of all siblings, from the leaf up, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""), 256)


def lowered(id_col: str, text_col: str) -> Column:
    """The text with A-Z lower-cased where 3 divides the checksum of the decimal id."""
    return F.when(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3)) == 0, F.translate(text_col, UPPER, LOWER)).otherwise(F.col(text_col))
