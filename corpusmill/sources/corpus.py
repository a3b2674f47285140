"""Sources and sinks: file trees, document tables, hash snapshots, context tables, exports."""

from __future__ import annotations

import json
import uuid
from contextlib import suppress
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import filters
from .tree import CorpusTree
from .versions import Conflict, last_version, put_version

SNAPSHOT_VERSION = 1
SNAPSHOT_DDL = "path string, hash string"
CONTEXT_TABLES = ("files", "symbols", "edges", "modules", "summaries", "relationships", "hashes", "metadata")
USAGE_DDL = (
    "id string, source string, agent string, provider string, model string, session_id string, task_id string, task_ref string, occurred_at timestamp, "
    "request_count bigint, latency_ms bigint, exit_code int, timed_out boolean, input_tokens bigint, output_tokens bigint"
)


def scan_corpus(spark: SparkSession, root: str, ignored: list[str] | None = None, max_depth: int | None = None) -> DataFrame:
    """Files below root: path (relative), name, extension, language, size_bytes, modified_at. Bodies are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
    prefix = root.rstrip("/").removeprefix("file://")
    relative = F.regexp_replace(F.col("path"), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:/{0,2})?" + _quoted(prefix) + "/", "")
    files = found.select(relative.alias("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"))
    kept = filters.drop_ignored_dirs(files, ignored, max_depth)
    path = F.col("path")
    return kept.select("path", S.basename(path).alias("name"), S.extension_of(path).alias("extension"), S.detect_language(path).alias("language"), "size_bytes", "modified_at")


def _quoted(text: str) -> str:
    return "".join("\\" + c if c in "\\.[]{}()*+-?^$|" else c for c in text)


def read_corpus(spark: SparkSession, root: str, ignored: list[str] | None = None) -> DataFrame:
    """path, language, content of the files below root, decoded as UTF-8 (bytes that are none become U+FFFD)."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    prefix = root.rstrip("/").removeprefix("file://")
    relative = F.regexp_replace(F.col("path"), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:/{0,2})?" + _quoted(prefix) + "/", "")
    files = filters.drop_ignored_dirs(found.select(relative.alias("path"), "content"), ignored)
    return files.select("path", S.detect_language(F.col("path")).alias("language"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def scan_tree(spark: SparkSession, root: str, ignored: list[str] | None = None, max_depth: int | None = None, rules: str = "", ignore_file: str | None = None, content: bool = False) -> DataFrame:
    """scan_corpus by a source that never enters what is ignored, by name or by ignore rules; with content, as UTF-8 (bytes that are none become U+FFFD), if wanted.

    Hidden files count too. Directories are dealt out to tasks; the driver lists the topmost ones only.
    """
    spark.dataSource.register(CorpusTree)
    options = {"content": str(content).lower(), "rules": rules, "ignored": None if ignored is None else json.dumps(ignored), "max_depth": max_depth, "ignore_file": ignore_file}
    found = spark.read.format("corpus_tree").options(**{k: v for k, v in options.items() if v is not None}).load(root)
    path = F.col("path")
    columns = ["path", S.basename(path).alias("name"), S.extension_of(path).alias("extension"), S.detect_language(path).alias("language"), "size_bytes", "modified_at"]
    return found.select(*columns, *([F.make_valid_utf8(F.col("content").cast("string")).alias("content")] if content else []))


def tree_changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """Two listings (path, size_bytes, modified_at) -> path, deleted, modified_at of files that are new, look different or are gone."""
    b = before.select("path", F.col("size_bytes").alias("__size"), F.col("modified_at").alias("__at"), F.lit(True).alias("__had"))
    n = now.select("path", "size_bytes", "modified_at", F.lit(True).alias("__has"))
    both = n.join(b, "path", "full_outer").where("__has IS NULL OR __had IS NULL OR NOT (size_bytes <=> __size) OR NOT (modified_at <=> __at)")
    return both.select("path", F.col("__has").isNull().alias("deleted"), F.coalesce("modified_at", "__at").alias("modified_at"))


def corpus_from_table(df: DataFrame, path: Column, text: Column, lang: Column | None = None, repo: Column | None = None) -> DataFrame:
    """A document table as files: repo_id, path, language (the path's where lang is null), content, size_bytes."""
    language = S.detect_language(path) if lang is None else F.coalesce(lang, S.detect_language(path))
    return df.select((F.lit("main") if repo is None else repo).alias("repo_id"), path.alias("path"), language.alias("language"), text.alias("content"), F.octet_length(text).cast("long").alias("size_bytes"))


def write_hash_snapshot(hashes: DataFrame, path: str) -> None:
    hashes.select("path", "hash", F.lit(SNAPSHOT_VERSION).alias("version")).write.mode("overwrite").parquet(path)


def read_hash_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """path, hash of a stored snapshot; a missing, unreadable or other version's one is empty."""
    try:
        found = spark.read.parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], SNAPSHOT_DDL)
    if {"path", "hash", "version"} - set(found.columns):
        return spark.createDataFrame([], SNAPSHOT_DDL)
    return found.where(F.col("version") == SNAPSHOT_VERSION).select("path", "hash")


#: A table of so many folders is written anew as one.
MOST_FOLDERS = 16
#: The column by which a table's rows belong to a path.
PATH_OF = {"imports": "from_path", "candidates": "from_path", "links": "from_path"}
_TOUCHED = "_touched"


def _pointer(spark: SparkSession, root: str) -> tuple[int, dict[str, list[str]]]:
    """Number and tables (name -> folders, the oldest first) of the last version; (0, {}) where nothing is stored."""
    number, what = last_version(spark, f"{root}/versions")
    return number, what or {}


def save_context(spark: SparkSession, tables: dict[str, DataFrame], root: str, changes: bool = False, touched: dict[str, DataFrame] | None = None) -> str:
    """Stores a version of the context: tables go to a new folder, then one small file with the next number points to them.

    The tables given are the whole context. With changes, they hold the rows of changed paths only: those of a path replace
    all that it had, and tables that are not given stay as they are. touched: of each table, the paths (path) whose rows are replaced, deleted paths
    among them; by default the paths of files. Of two writers at once the later one's changes are put on top of the earlier one's;
    a whole context that another writer has overtaken raises Conflict instead of hiding what that one stored.
    """
    seq, have = _pointer(spark, root)
    version = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{root}/{version}/{name}")
    if changes:
        paths = touched or dict.fromkeys(tables, tables["files"])
        each = [paths[n].select(F.lit(n).alias("table_name"), "path").distinct() for n in tables if n in paths]
        reduce(DataFrame.unionByName, each).write.parquet(f"{root}/{version}/{_TOUCHED}")
    mine = {name: f"{version}/{name}" for name in tables}
    for _ in range(20):
        now = {name: [f"{seq + 1}:{at}"] for name, at in mine.items()}
        if changes:
            now[_TOUCHED] = [f"{seq + 1}:{version}/{_TOUCHED}"]
            now = have | {name: have.get(name, []) + f for name, f in now.items()}
        try:
            put_version(spark, f"{root}/versions", seq + 1, now)
            break
        except Conflict:
            if not changes:
                raise
            seq, have = _pointer(spark, root)
    else:
        raise Conflict(f"{root} is written to all the time")
    if any(len(f) > MOST_FOLDERS for f in now.values()):
        with suppress(Conflict):  # another writer has come: it will see to that
            return save_context(spark, load_context(spark, root), root)
    return version


def load_context(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of the last version; none where nothing is stored. Of a path in several folders the newest rows count."""
    _, tables = _pointer(spark, root)
    union = lambda parts: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def read(name: str) -> DataFrame:
        cut = [f.split(":", 1) for f in tables[name]]
        return union([spark.read.parquet(f"{root}/{at}").withColumn("__at", F.lit(int(seq))) for seq, at in cut])

    out, last = {}, read(_TOUCHED).groupBy("table_name", "path").agg(F.max("__at").alias("__last")) if _TOUCHED in tables else None
    for name in tables:
        if name == _TOUCHED:
            continue
        df, path = read(name), PATH_OF.get(name, "path")
        if last is not None and path in df.columns:
            newest = last.where(F.col("table_name") == name).select(F.col("path").alias(path), "__last")
            df = df.join(newest, path, "left").where("__last IS NULL OR __at = __last").drop("__last")
        out[name] = df.drop("__at")
    return out


def ordered_symbols(symbols: DataFrame) -> DataFrame:
    return symbols.orderBy("path", "start_line", "start_col")


DAILY_COLUMNS = ["date", "scans", "context_builds", "searches", "summaries", "agent_runs", "errors", "tokens_used", "baseline_tokens", "saved_tokens"]


def export_daily_csv(daily: DataFrame, path: str) -> None:
    """CSV with a header and always the same ten columns; counters a table lacks are 0."""
    have = [F.col(c) if c in daily.columns else F.lit(0).alias(c) for c in DAILY_COLUMNS]
    daily.select(*have).write.mode("overwrite").option("header", True).csv(path)


def export_graph_json(nodes: DataFrame, edges: DataFrame, path: str, version: int = 1) -> None:
    """One JSON line for each node and edge, told apart by record_type."""
    both = nodes.withColumn("record_type", F.lit("node")).unionByName(edges.withColumn("record_type", F.lit("edge")), allowMissingColumns=True)
    both.withColumn("version", F.lit(version)).write.mode("overwrite").json(path)


def usage_source(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    return reader.schema(USAGE_DDL).json(path)


def append_usage(usage: DataFrame, path: str) -> None:
    usage.withColumn("day", F.to_date("occurred_at")).write.mode("append").partitionBy("day").parquet(path)
