"""What several training-data operators share: words, hashes, shared tables, prefix sums."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import partial
from pathlib import Path

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Rows in an Arrow batch handed to Python; keeps a batch of long texts small.
ARROW_ROWS = 512
#: Bytes in one, about: a batch ends with the row that passes them.
ARROW_BYTES = 4 << 20
#: A table may be broadcast only up to this many bytes, as measured by broadcast_if_small(). Beyond it both sides are shuffled.
BROADCAST_BYTES = 16 << 20
#: Words remembered by a Python worker before its cache is emptied.
CACHE_WORDS = 200_000

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one on a local
    master; elsewhere an error, since executors do not see each other's disks."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="spark-corpusmill-")
    return _own[app]


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches; and this package's folder for Python workers that were started elsewhere."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))


def _tidied(batches: Iterator, fn: Callable[[Iterator], Iterator]) -> Iterator:
    """fn's batches; then what they held goes back to the system, since Python workers live on."""
    import ctypes
    import gc

    import pyarrow as pa

    yield from fn(batches)
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def mapped(df: DataFrame, fn: Callable[[Iterator], Iterator], schema: str | T.StructType) -> DataFrame:
    """df.mapInArrow(fn, schema), each task leaving its worker's memory as it was."""
    return df.mapInArrow(partial(_tidied, fn=fn), schema)


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, survives lost executors, runs df once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cm-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.table_path = path  # for drop()
    return back


def drop(*tables: DataFrame) -> None:
    """Removes tables made by table() that no result reads any more. What a result still reads stays with it."""
    for t in tables:
        spark, path = t.sparkSession, getattr(t, "table_path", None)
        if path:
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getParent()
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


@atexit.register
def _forget() -> None:
    import shutil

    for path in _own.values():
        if path.startswith(tempfile.gettempdir()):
            shutil.rmtree(path, ignore_errors=True)


def measured_bytes(df: DataFrame) -> int:
    """Bytes of df's rows in memory: 16 a row, 8 a field, and what strings, binaries and arrays of numbers hold. Runs df."""
    row = F.lit(16 + 8 * len(df.columns)).cast("long")
    for c, kind in df.dtypes:
        if kind in ("string", "binary"):
            row = row + F.coalesce(F.octet_length(c), F.lit(0))
        elif kind.startswith("array"):
            row = row + 8 * F.greatest(F.size(c), F.lit(0))
    return df.agg(F.sum(row)).first()[0] or 0


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df, to be broadcast if its measured bytes are within the limit; beyond it the join is left to shuffles.

    df should be a stored table: it is read once more to be measured.
    """
    return F.broadcast(df) if measured_bytes(df) <= limit else df.hint("merge")


def by_position(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with names of our own (c0, c1, ...), and name -> own name. Names that differ in case only, or not at all, stay
    apart; the first column with exactly the name stands for it, else the first in any case."""
    own = [f"c{i}" for i in range(len(df.columns))]
    of: dict[str, str] = {}
    for key in (str, str.lower):
        for name, mine in zip(df.columns, own):
            of.setdefault(key(name), mine)
    return df.toDF(*own), of


def column_of(of: dict[str, str], name: str) -> str | None:
    return of.get(name, of.get(name.lower()))


def without_ids(docs: DataFrame, gone: DataFrame, nulls: bool = False) -> DataFrame:
    """docs less the rows whose doc_id is in gone's only column; all columns stay as they are. nulls: a null in gone
    takes away the rows with a null doc_id. gone should be a stored table."""
    own, of = by_position(docs)
    there = broadcast_if_small(gone.toDF("gone"))
    mine = F.col(column_of(of, "doc_id"))
    same = mine.eqNullSafe(F.col("gone")) if nulls else mine == F.col("gone")
    return own.join(there, same, "left_anti").toDF(*docs.columns)


class WordHashes(dict):
    """Word (bytes) -> 64-bit hash, remembered; emptied when it holds CACHE_WORDS words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words_lower(text: bytes | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; bytes.split and bytes.lower treat ASCII only."""
    return text.lower().split() if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash for each run of n words, from the words' hashes; empty where there are fewer words."""
    m = len(h) - n + 1
    if m <= 0:
        return h[:0]
    acc = h[:m].copy()
    for j in range(1, n):
        acc *= np.uint64(0x9E3779B97F4A7C15)
        acc += h[j : j + m]
    return mix64(acc)


def shingle_set(h: np.ndarray, n: int) -> np.ndarray:
    """Distinct n-word shingles, sorted; with fewer words the whole sequence as one; none without words."""
    if not len(h):
        return h
    if len(h) < n:
        return ngram_hashes(np.concatenate([h, np.array([len(h)], np.uint64)]), len(h) + 1)
    return np.unique(ngram_hashes(h, n))


def texts(batch, column: str = "text") -> list[bytes | None]:
    """A text column of an Arrow batch as UTF-8 bytes."""
    import pyarrow as pa

    return batch.column(column).cast(pa.binary()).to_pylist()


def running_total(df: DataFrame, groups: list[str], block: str, order: list[str], value: str, out: str) -> DataFrame:
    """Adds out: the sum of value over all earlier rows of the same groups, ordered by block, then order.

    Exclusive and whole-table, yet no task sees more than a block: sums by block are added up first (blocks of
    blocks, 4096 each, so that the top window stays a few thousand rows), then rows inside a block.
    """
    sums = df.groupBy(*groups, block).agg(F.sum(value).alias("__s")).withColumn("__top", F.floor(F.col(block) / 4096))
    tops = sums.groupBy(*groups, "__top").agg(F.sum("__s").alias("__ts"))
    wt = Window.partitionBy(*groups).orderBy("__top").rowsBetween(Window.unboundedPreceding, -1)
    wb = Window.partitionBy(*groups, "__top").orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    wr = Window.partitionBy(*groups, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.withColumn("__t0", F.coalesce(F.sum("__ts").over(wt), F.lit(0))).drop("__ts")
    sums = sums.withColumn("__b0", F.coalesce(F.sum("__s").over(wb), F.lit(0))).join(tops, [*groups, "__top"])
    base = sums.select(*groups, block, (F.col("__t0") + F.col("__b0")).alias("__base"))
    rows = df.withColumn("__r0", F.coalesce(F.sum(value).over(wr), F.lit(0)))
    return rows.join(base, [*groups, block]).withColumn(out, F.col("__base") + F.col("__r0")).drop("__base", "__r0")


def plain(docs: DataFrame, *cols: str) -> DataFrame:
    """Only the named columns; missing ones become null strings. Extra columns never reach an operator."""
    own, of = by_position(docs)
    return own.select(*[(F.lit(None).cast("string") if column_of(of, c) is None else F.col(column_of(of, c))).alias(c) for c in cols])


def empty_like(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def utf8_length(col: Column) -> Column:
    return F.coalesce(F.octet_length(col), F.lit(0)).cast("long")

