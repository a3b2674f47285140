"""Tables that an operator writes on its way: in the folder that driver and executors share, read back from there."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, tempfile.TemporaryDirectory] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder on a local master and an error elsewhere."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.TemporaryDirectory(prefix="spark-corpusmill-")  # goes with this process
    return _own[app].name


def stored(df: DataFrame) -> DataFrame:
    """df as a written table: run once, its lineage cut, whole however many executors are lost."""
    path = f"{shared_folder(df.sparkSession)}/cm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.stored_path = path
    return back


def together(tables: list[DataFrame]) -> DataFrame:
    """Stored tables of the same columns as one table: one scan, however many they are."""
    first = tables[0]
    return first.sparkSession.read.schema(first.schema).parquet(*[t.stored_path for t in tables])


def dealt(files: DataFrame) -> DataFrame:
    """files moved to four times the usual number of parts by path: a part stays small, and files that one task has read are no longer one task's work."""
    return files.repartition(4 * int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")


#: Rows of a bucket, about: what is made of them should fit a task's memory.
BUCKET_ROWS = 10_000


def buckets_for(df: DataFrame) -> int:
    """As many buckets as the rows of df ask for, so a bucket does not grow with the table; the usual number of parts at least."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // BUCKET_ROWS))


def bucketed(df: DataFrame, key: str, n: int, more: DataFrame | None = None) -> DataFrame:
    """df, and more below it, as a written table of n buckets by key: what is grouped by key (and other columns) later stays in its bucket.

    Rows that n parts by key hold are written as they come, unsorted. The table's catalog entry is `table`.
    """
    spark, name, setting = df.sparkSession, "cm_" + uuid.uuid4().hex, "spark.sql.maxConcurrentOutputFileWriters"
    path, before = f"{shared_folder(spark)}/{name}", spark.conf.get(setting, "0")
    spark.conf.set(setting, "2")
    try:
        for part in (df, more):
            if part is not None:
                part.write.bucketBy(n, key).option("path", path).format("parquet").mode("append").saveAsTable(name)
    finally:
        spark.conf.set(setting, before)
    back = spark.table(name)
    back.stored_path, back.table = path, name
    return back


def forget(*tables: DataFrame) -> None:
    """Removes stored tables that no result reads any more."""
    for t in tables:
        if name := getattr(t, "table", None):
            t.sparkSession.sql(f"DROP TABLE {name}")  # an entry with a path of its own: the files stay
        if path := getattr(t, "stored_path", None):
            jvm = t.sparkSession.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
