"""Changes: index tables against a rebuild in batch and stream, upserts, writers at once, scope keys, spans in quoted text."""

import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import extract as E
from corpusmill.operators import snapshots as N
from corpusmill.operators.stored import stored
from corpusmill.sources import corpus
from corpusmill.sources.versions import Conflict
from corpusmill.streaming import streams

SCHEMA = "path string, content string"
TABLES = {"files": ["path", "content"], "hashes": ["path", "hash"], "symbols": ["path", "name", "kind", "start_line", "end_line"], "imports": ["from_path", "name", "specifier"], "candidates": ["from_path", "pos", "path"], "links": ["from_path", "target"], "modules": ["path", "files"]}


def source(rnd, n):
    specs = rnd.sample(["./a1", "./a2", "../b/a3", "../b/a4", "./sub/index", "react", "../c/gone", "./sub", "../../x"], n % 4)
    return "".join(f"import {{ n{i} }} from '{s}';\n" for i, s in enumerate(specs)) + f"export class K{n} {{\n  go() {{\n  }}\n}}\n"


def tree(seed, n=40):
    rnd = random.Random(seed)
    names = ["a1.ts", "a2.ts", "a3.tsx", "a4.ts", "sub/index.ts", "sub/a1.ts", "gone.ts", "x.ts"]
    return {f"{d}/{f}": source(rnd, rnd.randrange(n)) for d in ("src/a", "src/b", "src/c", "lib") for f in names if rnd.random() < 0.7}


def contents(tables):
    return {n: sorted(map(str, tables[n].select(*cols).collect())) for n, cols in TABLES.items()}


def df(spark, files):
    return spark.createDataFrame(list(files.items()), SCHEMA)


def test_index_tables_follow_changes(spark):
    now = tree(1)
    tables, _ = N.apply_changes(None, df(spark, now), None, E.extract_symbols)
    for seed in (2, 3):
        after = dict(list(tree(seed).items())[:14]) | dict(list(now.items())[3:20])
        done = N.incremental_index(tables, df(spark, after), E.extract_symbols)
        rebuilt, _ = N.apply_changes(None, df(spark, after), None, E.extract_symbols)
        assert contents(done) == contents(rebuilt)
        counters = {r.status: r.n for r in done["counters"].collect()}
        assert counters.get("added", 0) == len(after.keys() - now.keys()) and counters.get("deleted", 0) == len(now.keys() - after.keys())
        tables, now = {n: stored(t) for n, t in done.items() if n in TABLES}, after


def test_only_imports_whose_targets_moved_are_resolved_again(spark):
    files = {f"src/f{i}.ts": f"import {{ x }} from './f{i + 1}';\n" for i in range(50)} | {"src/f50.ts": "x\n"}
    tables, _ = N.apply_changes(None, df(spark, files), None, E.extract_symbols)
    ids = {r.import_id: r.from_path for r in tables["imports"].collect()}
    moved = lambda fresh, gone: {ids[r.import_id] for r in N.apply_changes(tables, df(spark, fresh) if fresh else df(spark, files).limit(0), spark.createDataFrame([(g,) for g in gone], "path string"), E.extract_symbols)[1]["resolved"].collect() if r.import_id in ids}
    assert moved({"src/f50.ts": "changed\n"}, []) == set()  # a changed file keeps the links into it
    assert moved({}, ["src/f7.ts", "src/none.ts"]) == {"src/f6.ts"}
    assert moved({"src/f7.tsx": "new\n"}, []) == {"src/f6.ts"}


def test_stream_with_deletions_gives_a_rebuild(spark, tmp_path):
    src, root, step = tmp_path / "in", str(tmp_path / "store"), 0
    schema = "path string, content string, modified_at timestamp, deleted boolean"
    now = {}
    for seed, gone in ((4, []), (5, ["src/a/a1.ts", "src/b/a4.ts", "lib/none.ts"]), (6, ["src/c/x.ts"])):
        step += 1
        fresh = dict(list(tree(seed).items())[: 20 if seed == 4 else 6])
        at = f"2024-01-01 00:{step:02d}:00"
        rows = [(p, c, at, False) for p, c in fresh.items() if p not in gone] + [(p, None, at, True) for p in gone]
        rows += [(p, "stale content", "2023-01-01 00:00:00", False) for p in list(fresh)[:2]]
        spark.createDataFrame(rows, "path string, content string, m string, deleted boolean").select("path", "content", F.col("m").cast("timestamp").alias("modified_at"), "deleted").write.mode("append").parquet(str(src))
        now |= {p: c for p, c in fresh.items() if p not in gone}
        now = {p: c for p, c in now.items() if p not in gone}
        streams.stream_incremental_index(spark.readStream.schema(schema).parquet(str(src)), E.extract_symbols, root, str(tmp_path / "ck")).awaitTermination(200)
        assert contents(corpus.load_context(spark, root)) == contents(N.apply_changes(None, df(spark, now), None, E.extract_symbols)[0])


def test_inserted_rows_take_every_column_of_the_update(spark):
    base = spark.createDataFrame([(1, "a", "KEPT", "first")], "k int, v string, extra string, made string")
    updates = spark.createDataFrame([(1, "x", "LOST", "second"), (2, "b", "NEW", "second")], "k int, v string, extra string, made string")
    assert sorted(map(tuple, N.merge_upsert(base, updates, ["k"], ["v"], ["made"]).collect())) == [(1, "x", "KEPT", "first"), (2, "b", "NEW", "second")]
    assert sorted(map(tuple, N.merge_upsert(base, updates.drop("extra"), ["k"], ["v"], ["made"]).collect())) == [(1, "x", "KEPT", "first"), (2, "b", None, "second")]


def test_two_writers_lose_nothing(spark, tmp_path, monkeypatch):
    one = lambda *paths: {"files": spark.createDataFrame([(p,) for p in paths], "path string")}
    root = str(tmp_path)
    corpus.save_context(spark, one("a"), root)
    real, other = corpus._pointer, [True]

    def overtaken(spark, root):
        seen = real(spark, root)
        if other.pop() if other else False:
            corpus.save_context(spark, one("theirs"), root, changes=True)
        return seen

    monkeypatch.setattr(corpus, "_pointer", overtaken)
    corpus.save_context(spark, one("mine"), root, changes=True)
    assert sorted(r.path for r in corpus.load_context(spark, root)["files"].collect()) == ["a", "mine", "theirs"]
    other.append(True)
    with pytest.raises(Conflict):
        corpus.save_context(spark, one("all"), root)


CODE = """function f() {
  const s = '}';
  const t = "}}" + `a } ${'`'}
  } in a template `; // } comment
  /* } and
     ' } */
  if (s) { g('{'); } else {
    g("\\"}");
  }
}
class A {
  m(x: string) {
    return '// {';
  }
  // class Quoted {
  b() {
  } }
const last = 1;
"""


def test_braces_in_quotes_and_comments_change_nothing(spark):
    rows = {r.name: (r.kind, r.start_line, r.end_line) for r in E.extract_symbols(spark.createDataFrame([("f.ts", CODE)], SCHEMA)).collect()}
    assert rows["f"] == ("function", 1, 10) and rows["A"] == ("class", 11, 17) and rows["m"] == ("method", 12, 14) and rows["b"][1:] == (16, 17)
    assert "Quoted" not in rows and rows["last"][1:] == (18, 18)


def test_one_file_of_200000_lines(spark):
    n = 66_000
    long = "class Big {\n" + "".join(f"  m{i}() {{\n    return '}}';\n  }}\n" for i in range(n)) + "}\n"
    began = time.time()
    out = E.extract_symbols(spark.createDataFrame([("big.ts", long), ("string.ts", "const s = `" + "}\n" * 200_000 + "`;\nfunction f() {\n}\n")], SCHEMA))
    r = out.groupBy("path").agg(F.count("*").alias("n"), F.count_if(F.col("end_line") == F.col("start_line") + 2).alias("three"), F.count("parent_id").alias("inside"), F.max("end_line").alias("last")).collect()
    assert {(x.path, x.n, x.three, x.inside, x["last"]) for x in r} == {("big.ts", n + 1, n, n, 3 * n + 2), ("string.ts", 2, 0, 0, 200_003)}
    assert time.time() - began < 120


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_scope_keys_are_merkle_hashes(spark):
    files = {"a/b/x": "1", "a/b/y": "2", "a/z": "3", "top": "4", "c/d/e/w": "5"}

    def keys(files):
        return {r.target: r.key for r in E.scope_keys(spark.createDataFrame(list(files.items()), "path string, hash string")).where("kind = 'folder'").collect()}

    k = {p: sha(f"{p}|{h}") for p, h in files.items()}
    ab = sha("a/b|" + "".join(sorted([k["a/b/x"], k["a/b/y"]])))
    a = sha("a|" + "".join(sorted([ab, k["a/z"]])))
    c = sha("c|" + sha("c/d|" + sha("c/d/e|" + k["c/d/e/w"])))
    before = keys(files)
    assert before["a/b"] == ab and before["a"] == a and before["c"] == c and before[""] == sha("|" + "".join(sorted([a, c, k["top"]])))
    after = keys(files | {"a/b/y": "changed"})
    assert {t for t in before if before[t] != after[t]} == {"", "a", "a/b"}


def test_roll_up_computes_changed_branches_only(spark):
    import datetime

    files = lambda h: spark.createDataFrame([("a/x", "1"), ("a/b/y", h), ("c/z", "3")], "path string, hash string")
    contents = spark.createDataFrame([(t, t) for t in ("", "a", "a/b", "c")], "target string, content string")
    empty = spark.createDataFrame([], "key string, value string, expires_at timestamp")
    now = datetime.datetime(2024, 1, 1)
    first = E.roll_up(files("2"), contents, empty, lambda t: f"about {t}", now)
    cache = stored(first.select("key", "value", F.lit(None).cast("timestamp").alias("expires_at")))
    second = {r.id: (r.value, r.cache_hit) for r in E.roll_up(files("changed"), contents, cache, lambda t: f"new {t}", now).collect()}
    assert second == {"": ("new ", False), "a": ("new a", False), "a/b": ("new a/b", False), "c": ("about c", True)}
