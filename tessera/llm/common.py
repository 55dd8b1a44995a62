"""Helpers shared by the corpus operators: words, hashes, shared tables, bounded broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Keeps digits, letters (lower-cased) and every byte of a non-ASCII character; all else separates words.
ALNUM = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
#: Lower-cases A-Z only.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

MULT = np.uint64(0x9E3779B97F4A7C15)

#: Tables in the shared folder that nothing has deleted yet. A result may still read them.
MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, one is made and set in local mode, and it is an error elsewhere."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        given = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", given) if spark.conf.isModifiable("spark.checkpoint.dir") else None
        spark.sparkContext._conf.set("spark.checkpoint.dir", given)
    return given


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again, so that lost executors cost no recomputation."""
    return materialise_at(df, name)[0]


def materialise_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tessera-{name}-{uuid.uuid4().hex}"
    MADE.append(path)
    df.write.option("compression", "zstd").parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete tables made by materialise_at() that nothing reads any more."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        if path in MADE:
            MADE.remove(path)


def tidy(spark: SparkSession) -> int:
    """Delete all tables that operators of this driver have left in the shared folder, for when their results are written; how many."""
    n = len(MADE)
    discard(spark, *list(MADE))
    return n


class Scratch:
    """Tables of the shared folder that live until clear()."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def table(self, df: DataFrame, name: str) -> DataFrame:
        out, path = materialise_at(df, name)
        self.paths.append(path)
        return out

    def clear(self) -> None:
        discard(self.spark, *self.paths)
        self.paths.clear()


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of data frames that are no longer referenced.

    Its cleaner follows the driver's garbage collection, which a small driver heap may not need for a long time: without this, the files of
    all steps so far stay on the executors' disks."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (the public splitmix64 constants)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words, empty if there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    g = h[:n].copy()
    for j in range(1, k):
        g *= MULT
        g += h[j : j + n]
    return mix(g)


def sliding_min(g: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values by doubling."""
    m, have = g, 1
    while have < w:
        step = min(have, w - have)
        m = np.minimum(m[: len(m) - step], m[step:])
        have += step
    return m


def text_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of each text."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


#: Rows that travel to Python together, unless the session says otherwise. Spark's own 10,000 are tens of MB of long texts, held several times over by each task.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_ROWS))


def map_batches(
    df: DataFrame, rows: Callable[[pa.RecordBatch], dict[str, list | pa.Array]], schema: str | StructType, at_once: int = 10_000
) -> DataFrame:
    """mapInArrow with a function from a batch of at most `at_once` rows to columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema) if isinstance(schema, str) else schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, at_once):
                out = rows(whole.slice(i, at_once))
                yield pa.RecordBatch.from_arrays(
                    [x if isinstance(x, pa.Array) and x.type == f.type else pa.array(x, f.type) for f in target for x in [out[f.name]]],
                    schema=target,
                )

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def count_rows(df: DataFrame) -> int:
    return df.agg(F.count(F.lit(1))).first()[0]


def if_small(df: DataFrame, most: int) -> DataFrame:
    """df with a broadcast hint if it has no more than `most` rows; else df, for a shuffled join."""
    return F.broadcast(df) if count_rows(df) <= most else df


class Bitmap:
    """Set of 64-bit hashes as 2**26 bits (8 MB whatever the input): it may hold too much, never too little."""

    WORDS = 1 << 20

    def __init__(self, hashes: DataFrame, column: str):
        h = F.col(column)
        cells = hashes.groupBy((F.shiftrightunsigned(h, 6) % self.WORDS).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(`{column}` & 63 as int))")).alias("b")).toArrow()
        self.cells = np.zeros(self.WORDS, np.uint64)
        self.cells[cells["w"].to_numpy()] = cells["b"].to_numpy().view(np.uint64)

    def __contains__(self, h: int) -> bool:
        return bool(self.holds(np.array([h], np.uint64))[0])

    def holds(self, h: np.ndarray) -> np.ndarray:
        word = self.cells[((h >> np.uint64(6)) % np.uint64(self.WORDS)).astype(np.int64)]
        return (word >> (h & np.uint64(63))) & np.uint64(1) == 1


class Shared:
    """A broadcast of any object of this package, unpacked once in each task that uses it."""

    def __init__(self, spark: SparkSession, value: object):
        self.broadcast, self.held = spark.sparkContext.broadcast(cloudpickle.dumps(value)), None

    def __getstate__(self) -> dict:
        return {"broadcast": self.broadcast, "held": None}

    @property
    def value(self):
        if self.held is None:
            self.held = cloudpickle.loads(self.broadcast.value)
        return self.held

    def unpersist(self) -> None:
        self.broadcast.unpersist()
