"""A corpus pipeline of five stages over `documents`, each one of the package's corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, jaccard, pieces, quality, secrets
from tessera.llm.common import materialise
from tessera.llm.queries import MODEL, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the risk-controlled rules keep.

    Each row is judged by its own text: repeated rows and rows of one id have one verdict each, a null or empty text has no words and goes by the base rule,
    a null id has no label; without labels the base rule alone decides; other columns are kept as they are; an empty table gives no rows."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies (five words, similarity 0.8 or more): the one with the smallest id, an id before a null.

    Rows, not ids, are kept or dropped: rows of one id or of a null id are told apart by hashes of their text and of their other
    columns (whatever their types and names), which also decide between rows of one id within a class. Rows of null or wordless texts are in no class
    and all stay; an empty table gives no rows.
    """
    # the columns travel in one, so no name of theirs can meet a name of this stage
    rest = F.to_json(F.struct(F.lit(0).alias("none"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in ("doc_id", "text"))))
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("text"), F.xxhash64(rest).alias("rest"))
    keyed = docs.select(key.alias("key"), "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    classes = jaccard.components(keyed.select("key", "text"), id_col="key", k=5, percent=80)
    gone = classes.where("key <> component_id").select("key")
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    once = keyed.where(worded).dropDuplicates(["key"]).join(gone, "key", "left_anti")
    return once.select("row").unionByName(keyed.where(~worded).select("row")).select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item.

    Each row is judged by its own text, so repeated rows go or stay alike, and a null id changes nothing; null and wordless texts stay; an empty benchmark, or one of null
    texts, lets all stay; other columns are kept as they are; an empty table gives no rows."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their texts and n_chars (where there is one) counted again.

    Rows meet their findings by id and text: repeated rows and null ids have their own secrets replaced; null and empty texts stay as they are; other columns
    are kept; a table without `source` has no paths; an empty table gives no rows."""
    out = secrets.redact(docs, secrets.scan(docs, path_col="source" if "source" in docs.columns else None))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document's pieces, how many, and whether they give the text back.

    A null text has null ids; an empty one none; repeated rows are encoded each; a null id stays null; texts of any length are encoded whole; other columns are left out."""
    out = pieces.encode(docs, MODEL, keep_text=True)
    return out.select("doc_id", "ids", F.size("ids").cast("bigint").alias("n_ids"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scans),
    ("SentencePiece encoding and decoding", sentencepiece),
]

#: SQL can't express the forest, the exact binomial bounds or the pieces; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, f"stage{i}")
    return docs
