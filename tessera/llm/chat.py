"""Preference formatting, in DataFrame operations only: the longest common turn prefix of a chosen and a rejected conversation
becomes the prompt, rendered once; what follows on either side becomes a completion with the spans to train on (assistant turns).

Each side is shuffled once, by pair: windows number its turns and sum their lengths, a conversation's turns become one array (they end in
one record anyway), and the two arrays meet in a join that needs no further shuffle.

Nulls, ties and odd rows: turns count by position after sorting by (turn, role, text), repeated rows count once; a null
role or text is rendered as empty and equals only null; a pair that has one side only gets an empty prompt and an empty
other completion; equal sides give two empty completions; rows with a null pair id are left out; other columns are never read;
empty tables give no rows; texts of any length are whole, as far as a record can hold them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the format.
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"


def body(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(role, F.lit("")), F.lit(CLOSE), F.coalesce(text, F.lit("")), F.lit(END))


def turns(table: DataFrame, pair_col: str, turn_col: str, role_col: str, text_col: str, side: str) -> DataFrame:
    """(pair, side): the turns of each pair as an array of (at, role, text, from), from being the characters before it."""
    rows = table.where(F.col(pair_col).isNotNull()).select(F.col(pair_col).alias("pair"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    order, this = Window.partitionBy("pair").orderBy("turn", "role", "text"), F.struct("turn", "role", "text")
    rows = rows.withColumn("again", F.lag(this).over(order).eqNullSafe(this)).where("not again")
    size = F.length(body(F.col("role"), F.col("text"))).cast("bigint")
    ahead = F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.select("pair", F.struct(F.row_number().over(order).alias("at"), "role", "text", ahead.alias("from")).alias("x"))
    return rows.groupBy("pair").agg(F.array_sort(F.collect_list("x")).alias(side))


def format_preferences(chosen: DataFrame, rejected: DataFrame, *, pair_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per pair: pair id, n_prefix, prompt, chosen, rejected, chosen_mask, rejected_mask (arrays of start and length, in
    characters of the completion)."""
    names = pair_col, turn_col, role_col, text_col
    both = turns(chosen, *names, "c").join(turns(rejected, *names, "r"), "pair", "full")
    none = F.expr("cast(array() as array<struct<at: int, role: string, text: string, from: bigint>>)")
    both = both.select("pair", F.coalesce("c", none).alias("c"), F.coalesce("r", none).alias("r"))
    # a missing turn is null on its side
    same = F.transform(F.arrays_zip("c", "r"), lambda z: z["c"].isNotNull() & z["r"].isNotNull() & z["c"]["role"].eqNullSafe(z["r"]["role"]) & z["c"]["text"].eqNullSafe(z["r"]["text"]))
    both = both.withColumn("same", same)
    n = F.when(F.array_position("same", F.lit(False)) > 0, F.array_position("same", F.lit(False)) - 1).otherwise(F.size("same")).cast("int")
    both = both.withColumn("n_prefix", n)

    def rest(side: str) -> Column:
        return F.slice(side, F.col("n_prefix") + 1, F.greatest(F.size(side) - F.col("n_prefix"), F.lit(0)))

    def text(some: Column) -> Column:
        return F.array_join(F.transform(some, lambda x: body(x["role"], x["text"])), "")

    def mask(some: Column) -> Column:
        head = lambda x: F.length(F.concat(F.lit(OPEN), x["role"], F.lit(CLOSE)))
        span = lambda x: F.struct((x["from"] - some[0]["from"] + head(x)).cast("int").alias("start"), (F.length(body(x["role"], x["text"])) - head(x)).cast("int").alias("length"))
        return F.transform(F.filter(some, lambda x: F.coalesce(x["role"] == "assistant", F.lit(False))), span)

    return both.select(
        F.col("pair").alias(pair_col), "n_prefix", text(F.slice("c", F.lit(1), F.col("n_prefix"))).alias("prompt"), text(rest("c")).alias("chosen"), text(rest("r")).alias("rejected"),
        mask(rest("c")).alias("chosen_mask"), mask(rest("r")).alias("rejected_mask"),
    )


def swapped_answers(conversations: DataFrame) -> DataFrame:
    """For each conversation, its turns with the last assistant turn's text taken from the conversation with the next id, or that turn
    left out where there is none: the rejected side when a table holds no preferences of its own."""
    rows = conversations.select("conv_id", "turn", "role", "text")
    last = rows.where("role = 'assistant'").groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("x")).select("conv_id", F.col("x.turn").alias("last"), F.col("x.text").alias("answer"))
    other = last.select((F.col("conv_id") - 1).alias("conv_id"), F.col("answer").alias("other"), F.lit(True).alias("there"))
    mark = rows.join(last.select("conv_id", "last").join(other, "conv_id", "left"), "conv_id", "left")
    swap = F.coalesce((F.col("role") == "assistant") & (F.col("turn") == F.col("last")), F.lit(False))
    return mark.where(~swap | F.col("there")).select("conv_id", "turn", "role", F.when(swap, F.col("other")).otherwise(F.col("text")).alias("text"))
