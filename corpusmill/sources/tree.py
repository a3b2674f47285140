"""A directory tree as a data source that prunes while it lists: what is ignored is never entered."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import fixed as X
from ..operators.filters import rule_rows

TREE_DDL = "path string, size_bytes bigint, modified_at timestamp"
#: A batch of rows ends at so many files or bytes of their contents.
BATCH_FILES, BATCH_BYTES = 1000, 8 << 20


class CorpusTree(DataSource):
    """spark.read.format("corpus_tree").load(root): path (relative), size_bytes, modified_at and, with content=true, content.

    Options: ignored (JSON list of directory names, any case; the usual ones by default), max_depth, rules (text of ignore rules for the
    root), ignore_file (name of files that hold such rules for their directory; none by default), spread (tasks to deal directories out to).
    Roots are local paths or what pyarrow's file systems open (hdfs://, s3://, gs://). Links to directories are not followed.
    """

    @classmethod
    def name(cls) -> str:
        return "corpus_tree"

    def schema(self) -> str:
        return TREE_DDL + (", content binary" if self.options.get("content", "false").lower() == "true" else "")

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


class TreeReader(DataSourceReader):
    """The driver lists from the root down, directory by directory, until there are enough to deal out (`spread` listings at most), and
    hands out names of directories only: files are listed by the task that has their directory."""

    def __init__(self, options):
        root = options["path"]
        local = "://" not in root or root.startswith("file:")
        self.root = re.sub(r"^file:(//)?(?=/)", "", root).rstrip("/") if local else root.rstrip("/")
        self.local = local
        self.ignored = {n.lower() for n in (json.loads(options["ignored"]) if "ignored" in options else X.IGNORED_DIRECTORIES)}
        self.max_depth = int(options["max_depth"]) if "max_depth" in options else None
        self.rules = rule_rows({"": options.get("rules", "")})
        self.ignore_file = options.get("ignore_file")
        self.spread = int(options.get("spread", 256))
        self.content = options.get("content", "false").lower() == "true"

    def _open(self) -> tuple[fs.FileSystem, str]:
        return (fs.LocalFileSystem(), self.root) if self.local else fs.FileSystem.from_uri(self.root)

    def look(self, system: fs.FileSystem, base: str, at: str, rules: list) -> tuple[list, list]:
        """One listing: directories below `at` to enter, with the rules in force there, and files to keep (path, what is known of it)."""
        here = system.get_file_info(fs.FileSelector(f"{base}/{at}" if at else base))
        own = next((f for f in here if f.base_name == self.ignore_file and f.type == fs.FileType.File), None)
        if own is not None:
            with system.open_input_stream(own.path) as f:
                rules = rules + rule_rows({at: f.read().decode("utf-8", "replace")})
        dirs, files, depth = [], [], at.count("/") + 1 if at else 0
        for f in here:
            path, is_dir = f"{at}/{f.base_name}" if at else f.base_name, f.type == fs.FileType.Directory
            if is_dir and (f.base_name.lower() in self.ignored or depth == self.max_depth or self.local and os.path.islink(f.path)) or not _kept(rules, path, is_dir):
                continue
            if is_dir:
                dirs.append((path, rules))
            elif f.type == fs.FileType.File and (self.max_depth is None or depth <= self.max_depth):
                files.append((path, f))
        return dirs, files

    def partitions(self) -> list[InputPartition]:
        system, base = self._open()
        todo, flat, calls = [("", self.rules)], [], 0
        while todo and len(todo) < self.spread and calls < self.spread:
            at, rules = todo.pop(0)
            dirs, files = self.look(system, base, at, rules)
            calls += 1
            if files:
                flat.append((at, rules, False))
            todo += dirs
        pieces = flat + [(at, rules, True) for at, rules in todo]
        return [InputPartition(pieces[k :: self.spread]) for k in range(min(self.spread, len(pieces)))] or [InputPartition([])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        system, base = self._open()
        rows, size = [], 0
        for at, rules, deep in partition.value:
            todo = [(at, rules)]
            while todo:
                dirs, files = self.look(system, base, *todo.pop())
                todo += dirs if deep else []
                for path, f in files:
                    row = {"path": path, "size_bytes": f.size, "modified_at": f.mtime}
                    if self.content:
                        with system.open_input_stream(f.path) as s:
                            row["content"] = s.read()
                        size += f.size
                    rows.append(row)
                    if len(rows) >= BATCH_FILES or size >= BATCH_BYTES:
                        yield self._batch(rows)
                        rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        fields = [("path", pa.string()), ("size_bytes", pa.int64()), ("modified_at", pa.timestamp("us", "UTC"))] + [("content", pa.binary())] * self.content
        return pa.RecordBatch.from_pylist(rows, schema=pa.schema(fields))


def _kept(rules: list, entry: str, is_dir: bool) -> bool:
    """Whether the last rule that matches, if any, is a negated one."""
    for scope, _, negated, dir_only, regex, inside in reversed(rules):
        if scope and not entry.startswith(scope + "/"):
            continue
        path = entry[len(scope) + 1 :] if scope else entry
        own = re.search(regex, path)
        if (own if is_dir else None) or (not own and re.search(inside, path)) if dir_only else own:
            return negated
    return True
