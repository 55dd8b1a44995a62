"""Sharding by balanced label propagation, in DataFrame operations only.

Documents of equal text are linked. They start in shards by the hash of their row (as the table is laid out); in each round every group names the shard that
holds most of it and has room, and its members elsewhere move there under quotas: what two shards ask of each other is
swapped, the rest goes as far as the receiving shard has room. Members of a group in one shard are alike, so rounds work on counts
(group, shard, n): at most `n_shards` rows a group, however large it is. Unlinked documents fill what room is left, so
row counts differ by one at most and slots are gapless (law "rows"). Ranks are sums of two levels (bucket, then row), never a
window over all rows.

Nulls, ties and odd rows: a null text has size 8, a null text_crc32 and no links; empty texts are equal texts; repeated rows
are rows; a null id is placed like any other; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import common as C

SALTS = 256


def before(df: DataFrame, within: list[str], bucket: Column, order: list[Column], amount: Column, name: str) -> DataFrame:
    """Adds the sum of `amount` of the rows before each row in its `within` group: a small table of bucket sums, then a window in each bucket."""
    df = df.withColumn("__b", bucket)
    sums = df.groupBy(*within, "__b").agg(F.sum(amount).alias("__sum"))
    ahead = Window.partitionBy(*within).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__ahead", F.coalesce(F.sum("__sum").over(ahead), F.lit(0))).drop("__sum")
    inside = Window.partitionBy(*within, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("__inside", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    return df.join(sums, [*within, "__b"]).withColumn(name, F.col("__ahead") + F.col("__inside")).drop("__b", "__ahead", "__inside")


def buckets(rows: int) -> int:
    return max(16, rows // 100_000)


def allowed(asked: DataFrame, room: DataFrame, parts: int) -> DataFrame:
    """Of demands (key, g, shard, target, n) how many may go (go > 0): what two shards ask of each other is swapped, the rest goes as far as the receiving shard has room."""
    # demands between shards: at most n_shards squared rows
    ask = asked.groupBy("shard", "target").agg(F.sum("n").alias("m"))
    back = ask.select(F.col("shard").alias("target"), F.col("target").alias("shard"), F.col("m").alias("w"))
    ask = ask.join(back, ["shard", "target"], "left").withColumn("swap", F.least("m", F.coalesce("w", F.lit(0)))).withColumn("more", F.col("m") - F.col("swap"))
    earlier = Window.partitionBy("target").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    ask = ask.withColumn("taken", F.coalesce(F.sum("more").over(earlier), F.lit(0))).join(room.select(F.col("shard").alias("target"), "room"), "target")
    quota = ask.select("shard", "target", (F.col("swap") + F.greatest(F.lit(0), F.least(F.col("more"), F.col("room") - F.col("taken")))).alias("quota"))
    ranked = before(asked, ["shard", "target"], F.pmod(F.xxhash64("key"), F.lit(parts)), [F.col("key")], F.col("n"), "ahead")
    return ranked.join(F.broadcast(quota), ["shard", "target"]).withColumn("go", F.greatest(F.lit(0), F.least(F.col("n"), F.col("quota") - F.col("ahead")))).where("go > 0")


def propagate(cells: DataFrame, shards: DataFrame, parts: int, rounds: int) -> DataFrame:
    """Moves of (key, g, shard, n) cells until none is left or allowed. shards: (shard, cap)."""
    spark = cells.sparkSession
    cells, path = C.materialise_at(cells, "cells")
    for _ in range(rounds):
        room = shards.join(cells.groupBy("shard").agg(F.sum("n").alias("load")), "shard", "left").select("shard", (F.col("cap") - F.coalesce("load", F.lit(0))).alias("room"))
        seen = cells.join(F.broadcast(room), "shard")
        rank = F.struct((F.col("room") >= F.col("g") - F.col("n")).alias("fits"), (F.col("room") > 0).alias("some"), F.col("n").alias("most"), F.xxhash64("key", "shard").alias("tie"), F.col("shard").alias("target"))
        pick = seen.groupBy("key").agg(F.max(rank).alias("p")).select("key", "p.*")
        asked = cells.join(pick, "key").where("shard <> target and (fits or most >= n)").select("key", "g", "shard", "target", "n")
        moves = allowed(asked, room, parts)
        moves, moves_path = C.materialise_at(moves.select("key", "g", "shard", "target", "go"), "moves")
        if not moves.agg(F.sum("go")).first()[0]:
            C.discard(spark, moves_path)
            break
        changes = moves.select("key", "g", "shard", (-F.col("go")).alias("n")).unionByName(moves.select("key", "g", F.col("target").alias("shard"), F.col("go").alias("n")))
        new, new_path = C.materialise_at(cells.unionByName(changes).groupBy("key", "g", "shard").agg(F.sum("n").alias("n")).where("n > 0"), "cells")
        C.discard(spark, path, moves_path)
        cells, path = new, new_path
    return cells


def shard_rows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n_shards: int = 24, rounds: int = 16) -> DataFrame:
    """One row per row of docs: id, size, text_crc32, shard, slot."""
    spark = docs.sparkSession
    base = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 8).cast("bigint").alias("size"),
        F.crc32(F.col(text_col).cast("binary")).alias("crc"),
        F.unhex(F.md5(F.col(text_col).cast("binary"))).alias("key"),
        F.monotonically_increasing_id().alias("row"),
    )
    base = C.materialise(base, "shard-rows")
    total = C.count_rows(base)
    parts = buckets(total)
    shards = spark.range(n_shards).select(F.col("id").cast("int").alias("shard"), (F.lit(total // n_shards) + F.when(F.col("id") < total % n_shards, 1).otherwise(0)).cast("bigint").alias("cap"))

    keyed = base.where("key is not null")
    cells = keyed.groupBy("key", F.pmod(F.xxhash64("row"), F.lit(n_shards)).cast("int").alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    cells = cells.withColumn("g", F.sum("n").over(Window.partitionBy("key"))).where("g > 1").select("key", "g", "shard", "n")
    cells = propagate(cells, shards, parts, rounds)

    # where each group's members lie: of rank lo to hi in shard, at slots from `at` on
    placed = before(cells, ["shard"], F.pmod(F.xxhash64("key"), F.lit(parts)), [F.col("key")], F.col("n"), "at")
    ahead = Window.partitionBy("key").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("lo", F.coalesce(F.sum("n").over(ahead), F.lit(0))).withColumn("hi", F.col("lo") + F.col("n"))
    places = placed.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("hi", "lo", "shard", "at"))).alias("places"))

    salt = F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")
    salted = keyed.withColumn("salt", salt)
    ahead = Window.partitionBy("key").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    per = salted.groupBy("key", "salt").agg(F.count(F.lit(1)).alias("m")).withColumn("ahead", F.coalesce(F.sum("m").over(ahead), F.lit(0)))
    per = per.join(places, "key").select("key", "salt", "ahead", "places")
    nth = F.row_number().over(Window.partitionBy("key", "salt").orderBy("row")) - 1
    ranked = salted.withColumn("nth", nth).join(per, ["key", "salt"], "left").withColumn("rank", F.col("ahead") + F.col("nth"))
    place = F.element_at(F.filter("places", lambda p: F.col("rank") < p["hi"]), 1)
    ranked = ranked.withColumn("place", F.when(F.col("places").isNotNull(), place)).select("id", "size", "crc", "row", F.col("place.shard").alias("shard"), (F.col("place.at") + F.col("rank") - F.col("place.lo")).alias("slot"))
    ranked = ranked.unionByName(base.where("key is null").select("id", "size", "crc", "row", F.lit(None).cast("int").alias("shard"), F.lit(None).cast("bigint").alias("slot")))
    # beyond a shard's share a linked row fills room like an unlinked one
    ranked = C.materialise(ranked.join(F.broadcast(shards), "shard", "left").withColumn("fixed", F.coalesce(F.col("slot") < F.col("cap"), F.lit(False))), "shard-ranks")
    held = ranked.where("fixed").groupBy("shard").agg(F.count(F.lit(1)).alias("held"))
    room = shards.join(held, "shard", "left").select("shard", F.coalesce("held", F.lit(0)).alias("from"), (F.col("cap") - F.coalesce("held", F.lit(0))).alias("free"))
    upto = Window.partitionBy(F.lit(0)).orderBy("shard")
    room = room.withColumn("hi", F.sum("free").over(upto)).select(F.struct("hi", (F.col("hi") - F.col("free")).alias("lo"), "shard", "from").alias("r"))
    room = room.agg(F.array_sort(F.collect_list("r")).alias("rooms"))
    pool = before(ranked.where("not fixed").drop("shard", "slot"), [], F.pmod(F.xxhash64("row"), F.lit(parts)), [F.col("row")], F.lit(1), "rank")
    pool = pool.join(F.broadcast(room)).withColumn("place", F.element_at(F.filter("rooms", lambda p: F.col("rank") < p["hi"]), 1))
    pool = pool.select("id", "size", "crc", F.col("place.shard").alias("shard"), (F.col("place.from") + F.col("rank") - F.col("place.lo")).alias("slot"))
    out = ranked.where("fixed").select("id", "size", "crc", "shard", "slot").unionByName(pool)
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("bigint").alias("slot"))


def shard_linked(nodes: DataFrame, links: DataFrame, *, id_col: str = "id", n_shards: int = 24, slack: float = 0.05, rounds: int = 12) -> DataFrame:
    """(id, shard) of nodes with any links (a, b) between their ids: each node asks for the shard that holds most of its neighbours, half of the nodes in
    a round (by hash, so that neighbours don't swap places for ever), and goes under the same quotas. A shard holds at most (1 + slack) times its share, and a node more.

    Ids count once; links of unknown or null ids, loops and repeated links count nothing; a null id has no neighbours, and all rows of it are one node."""
    spark = nodes.sparkSession
    ids = nodes.select(F.col(id_col).alias("key")).distinct()
    total = C.count_rows(ids)
    parts = buckets(total)
    ranked = before(ids, [], F.pmod(F.xxhash64("key"), F.lit(parts)), [F.xxhash64("key"), F.col("key")], F.lit(1), "rank")
    placed, path = C.materialise_at(ranked.select("key", F.pmod("rank", F.lit(n_shards)).cast("int").alias("shard")), "linked")
    pairs = links.where("a <> b").select("a", "b")
    both, both_path = C.materialise_at(pairs.union(pairs.select("b", "a")).distinct(), "linked-pairs")
    shards = spark.range(n_shards).select(F.col("id").cast("int").alias("shard"), (F.ceil(F.lit(total / n_shards * (1 + slack))) + 1).cast("bigint").alias("cap"))
    for k in range(rounds):
        room = shards.join(placed.groupBy("shard").agg(F.count(F.lit(1)).alias("load")), "shard", "left").select("shard", (F.col("cap") - F.coalesce("load", F.lit(0))).alias("room"))
        votes = both.join(placed.select(F.col("key").alias("b"), "shard"), "b").groupBy(F.col("a").alias("key"), F.col("shard").alias("target")).agg(F.count(F.lit(1)).alias("n"))
        own = F.max(F.when(F.col("target") == F.col("shard"), F.col("n"))).alias("own")
        best = votes.join(placed, "key").groupBy("key", "shard").agg(F.max(F.struct("n", F.xxhash64("key", "target").alias("tie"), "target")).alias("x"), own)
        asked = best.where((F.col("x.n") > F.coalesce("own", F.lit(0))) & (F.pmod(F.xxhash64("key", F.lit(k // 2)), F.lit(2)) == k % 2)).select("key", F.lit(1).alias("g"), "shard", F.col("x.target").alias("target"), F.lit(1).cast("bigint").alias("n"))
        moves, moves_path = C.materialise_at(allowed(asked, room, parts).select("key", F.col("target").alias("new")), "linked-moves")
        new, new_path = C.materialise_at(placed.join(moves, "key", "left").select("key", F.coalesce("new", "shard").alias("shard")), "linked")
        moved = C.count_rows(moves)
        C.discard(spark, path, moves_path)
        placed, path = new, new_path
        if not moved and k % 2:
            break
    C.discard(spark, both_path)
    return placed.withColumnRenamed("key", id_col)


def cut_links(placed: DataFrame, links: DataFrame, *, id_col: str = "id") -> DataFrame:
    """(n_links, n_cut): how many links (a, b) join known ids, and how many of these join two shards."""
    end = lambda c: placed.select(F.col(id_col).alias(c), F.col("shard").alias(f"shard_{c}"))
    both = links.where("a <> b").select("a", "b").distinct().join(end("a"), "a").join(end("b"), "b")
    return both.agg(F.count(F.lit(1)).alias("n_links"), F.count_if(F.col("shard_a") != F.col("shard_b")).alias("n_cut"))
