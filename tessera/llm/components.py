"""Connected components of a link table, as joins of links with labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C


def connect(links: DataFrame) -> DataFrame:
    """(node, comp) for each node of links (a, b): comp is the smallest node of its component.

    Each round takes the smallest label among neighbours, then the label of the label (so paths halve). Labels are
    written to the shared folder each round; only a number goes to the driver. Null ends and loops are ignored.
    """
    spark = links.sparkSession
    links = links.where("a <> b")
    both, both_path = C.materialise_at(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels, path = C.materialise_at(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("comp")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("comp").alias("least"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.least("comp", "least").alias("next"), F.col("comp").alias("old"))
        up = labels.select(F.col("node").alias("top"), F.col("comp").alias("above"))
        jumped = step.join(up, step["next"] == up["top"], "left").select("node", F.least("next", F.coalesce("above", "next")).alias("comp"), "old")
        new, new_path = C.materialise_at(jumped, "labels")
        moved = new.where("comp <> old").limit(1).count()
        C.discard(spark, path)
        labels, path = new.select("node", "comp"), new_path
        if not moved:
            C.discard(spark, both_path)
            return labels
