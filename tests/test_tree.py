"""The pruning source lists what filters keep, and lists nothing else."""

import datetime
import json

from pyspark.sql import functions as F

from corpusmill.operators import filters
from corpusmill.sources import corpus, tree

RULES = {"": "*.log\n/build/\nsrc/**/gen\n# none\n", "src": "!keep.log\ntmp/\n", "src/a": "*.ts\n!main.ts\n"}
FILES = ["README.md", ".hidden", "x.log", "build/out.js", "lib/build/out.js", "src/keep.log", "src/a/main.ts", "src/a/b.ts", "src/a/deep/gen/c.js", "src/a/tmp/t.js", "src/b/d.ts", "src/é/ü.md"]
FILES += [f"Node_Modules/p{k}/deep/er/i.js" for k in range(50)] + [f"pk/p{k}/f{k}.py" for k in range(30)]


def made(root):
    for p in FILES:
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(f"body of {p}")
    for scope, text in RULES.items():
        (root / scope / ".ignore").write_text(text)
    return str(root)


def test_what_filters_keep(spark, tmp_path):
    root = made(tmp_path / "r")
    every = spark.createDataFrame([(p,) for p in [*FILES, *((f"{s}/.ignore" if s else ".ignore") for s in RULES)]], "path string")
    for depth in (None, 0, 2):
        want = filters.apply_ignore_rules(filters.drop_ignored_dirs(every, None, depth), filters.parse_rules(spark, RULES))
        got = corpus.scan_tree(spark, root, max_depth=depth, ignore_file=".ignore", content=True)
        assert sorted(r.path for r in got.collect()) == sorted(r.path for r in want.collect())
    body = got.where("path = 'src/é/ü.md'").first()
    assert (body.name, body.language, body.content, body.size_bytes) == ("ü.md", "markdown", "body of src/é/ü.md", len("body of src/é/ü.md".encode()))
    assert corpus.scan_tree(spark, "file://" + root, ignored=[]).where("path like 'Node%'").count() == 50
    (tmp_path / "none").mkdir()
    assert corpus.scan_tree(spark, str(tmp_path / "none")).count() == 0


def test_ignored_folders_are_not_listed(tmp_path, monkeypatch):
    root, listed = made(tmp_path / "r"), []
    real = tree.TreeReader.look
    monkeypatch.setattr(tree.TreeReader, "look", lambda self, system, base, at, rules: listed.append(at) or real(self, system, base, at, rules))
    reader = tree.TreeReader({"path": root, "ignored": json.dumps(["node_modules"]), "rules": "/build/", "spread": "8"})
    parts = reader.partitions()
    assert len(parts) == 8 and len(listed) <= 8
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert sorted(r["path"] for r in rows) == sorted({*(p for p in FILES if not p.startswith(("Node", "build/"))), ".ignore", "src/.ignore", "src/a/.ignore"})
    assert not [at for at in listed if at.lower().startswith(("node_modules", "build"))] and len(listed) < 60


def test_changes_with_deletions(spark):
    t0, ddl = datetime.datetime(2024, 1, 1), "path string, size_bytes long, modified_at timestamp"
    t1 = t0 + datetime.timedelta(days=1)
    before = spark.createDataFrame([("same", 1, t0), ("size", 1, t0), ("time", 1, t0), ("gone", 1, t0), ("null", None, None)], ddl)
    now = spark.createDataFrame([("same", 1, t0), ("size", 2, t0), ("time", 1, t1), ("new", 1, t1), ("null", None, None)], ddl)
    got = corpus.tree_changes(now, before).select("path", "deleted", F.col("modified_at") == t1).collect()
    assert sorted(map(tuple, got)) == [("gone", True, False), ("new", False, True), ("size", False, False), ("time", False, True)]


def test_bytes_that_are_no_text(spark, tmp_path):
    (tmp_path / "a.ts").write_bytes(b"class A\xff {}")
    assert [r.content for r in corpus.scan_tree(spark, str(tmp_path), content=True).collect()] == [r.content for r in corpus.read_corpus(spark, str(tmp_path)).collect()] == ["class A� {}"]
