"""How much an operator moves and does, read from its plan, and rows that the cheaper way must keep."""

import contextlib
import io

from pyspark.sql import functions as F

from corpusmill.functions import scalars as S
from corpusmill.operators import extract, graph, search, snapshots, stored


def plan(df):
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        df.explain("simple")
    return said.getvalue()


def test_symbols_move_files_once(spark):
    code = "class A {\n  m() {\n    class B {\n      get x() {\n      }\n    }\n  }\n}\n}\nclass C {\n  interface D {}} {{\n  const y = 1\n}\n"
    found = extract.extract_symbols(spark.createDataFrame([("a.ts", code), ("none.ts", None), ("empty.ts", "")], "path string, content string"))
    assert plan(found).count("Exchange") == 1
    rows = {r.name: (r.start_line, r.end_line, r.parent_id and r.parent_id.split("#")[1]) for r in found.collect()}
    assert rows == {"A": (1, 8, None), "m": (2, 7, "A@1:0"), "B": (3, 6, "A@1:0"), "x": (4, 5, "B@3:4"), "C": (10, 11, None), "D": (11, 13, "C@10:0"), "y": (12, 12, "D@11:2")}


def test_one_tasks_entities_are_dealt_out(spark):
    files = spark.createDataFrame([(f"a/f{i}.ts", f"word{i % 3} common") for i in range(200)], "path string, content string").coalesce(1)
    for made in (search.build_postings, search.search_postings):
        cut = made(search.build_search_entities(files))
        parts = cut.select("key").rdd.mapPartitions(lambda rows: [len({r.key for r in rows})]).collect()
        assert max(parts) < 150 and sum(n > 0 for n in parts) > 1, made
    assert {(r.token, r.in_name) for r in search.build_postings(search.build_search_entities(files)).where("key = 'a/f4.ts'").collect()} == {("word1", False), ("common", False), ("a", False), ("f4", True), ("ts", True)}


def test_duplicate_names_in_small_parts(spark):
    symbols = spark.createDataFrame([("a", "f"), ("a", "g"), ("a", "g"), ("b", "f"), ("b", None), (None, "f"), (None, "g"), ("c", "f"), ("c", "f")], "name string, path string")
    found = graph.duplicate_names(symbols)
    assert sorted(map(tuple, found.collect()), key=str) == [("a", 2, 3), (None, 2, 2)]
    text = plan(found)  # names and paths are put together once, after they have moved to a fixed number of parts
    assert "REPARTITION_BY_NUM" in text and text.index("partial_count") < text.index("REPARTITION_BY_NUM")


def test_uses_of_a_word_are_not_sorted(spark):
    code = "class A {\n  size() {\n  }\n}\nconst b = new A();\nb.size();\nother.size\n"
    files = spark.createDataFrame([("a.ts", code), ("b.ts", "import A\nx = A"), ("none.ts", None)], "path string, content string")
    found = extract.extract_references(files, extract.extract_symbols(files))
    rows = sorted(tuple(r) for r in found.select("path", "name", "kind", "line").collect())
    assert rows == [("a.ts", "A", "construct", 5), ("a.ts", "b", "read", 6), ("a.ts", "size", "call", 6), ("a.ts", "size", "property", 7), ("b.ts", "A", "read", 1), ("b.ts", "A", "read", 2)]
    text = plan(found)
    assert text.count("ShuffledHashJoin") == 2 and "Sort " not in text and text.count("REPARTITION_BY_NUM") == 1


def test_index_tables_are_made_by_many_tasks_and_once(spark):
    files = spark.createDataFrame([(f"src/f{i}.ts", f"import {{ a }} from './f{i + 1}';\nfunction g{i}() {{\n}}\n") for i in range(60)], "path string, content string").coalesce(1)
    tables, _ = snapshots.apply_changes(None, files, None, extract.extract_symbols)
    parts = tables["files"].groupBy(F.input_file_name()).count().collect()
    assert len(parts) > 8 and max(r["count"] for r in parts) < 20
    assert "explode" not in plan(tables["links"]).lower()  # candidates are read back, not worked out again
    assert tables["links"].count() == 59 and tables["candidates"].count() == 300


def test_candidates_work_the_path_out_once(spark):
    where = spark.createDataFrame([("src/a/b.ts", "../c")], "f string, s string").select(S.module_candidates(S.resolve_relative(F.col("f"), F.col("s"))).alias("c"))
    assert plan(where).count("regexp_extract") == 1
    assert where.first().c == ["src/c", "src/c.ts", "src/c.tsx", "src/c/index.ts", "src/c/index.tsx"]


def test_search_moves_only_the_best_of_a_bucket(spark, monkeypatch):
    files = spark.createDataFrame([(f"a/f{i}.ts", f"shared words small{i} and smaller things" if i % 2 else "shared words") for i in range(300)], "path string, content string")
    entities = search.build_search_entities(files)
    queries = spark.createDataFrame([(1, "shared small"), (2, "f17"), (3, "thinks"), (4, "f17.ts")], "query_id long, q string")
    monkeypatch.setattr(stored, "BUCKET_ROWS", 50)
    plans = []
    monkeypatch.setattr(search, "stored", lambda df: plans.append(plan(df)) or stored.stored(df))
    found = search.search(entities, queries, limit=5)
    best = plans[-1]  # scores of terms, their sums and a bucket's best stay in one of six buckets
    assert best.count("Exchange hashpartitioning") == 1 and "SelectedBucketsCount: 6 out of 6" in best
    rows = {}
    for r in found.orderBy("query_id", "rank").collect():
        rows.setdefault(r.query_id, []).append((r.rank, r.key, r.score))
    odd = sorted(f"a/f{i}.ts" for i in range(1, 300, 2))
    assert rows[1] == [(n + 1, k, 0.25) for n, k in enumerate(odd[:5])]
    assert rows[2][0] == (1, "a/f17.ts", 0.8) and [k for _, k, _ in rows[2][1:]] == sorted(k for k in (f"a/f17{i}.ts" for i in range(10)))[:4]
    assert 3 not in rows and rows[4] == [(1, "a/f17.ts", 1.0)] + rows[4][1:]
    exact = search.search(entities, queries.where("query_id = 2"), fuzzy=False, scorer=lambda term, name, text, sim, word: F.when(word, 1.0).otherwise(0.0))
    assert [(r.key, r.score) for r in exact.collect()] == [("a/f17.ts", 1.0)]


def test_parts_of_a_graph_follow_its_symbols(spark, monkeypatch):
    symbols = [(f"f{i}#C", f"f{i}", "C", "class", None, 1, 9, 0, True) for i in range(40)] + [(f"f{i}#m{k}", f"f{i}", f"m{k}", "method", f"f{i}#C", k, k + 1, 2, False) for i in range(40) for k in (2, 5)]
    symbols = spark.createDataFrame(symbols, "id string, path string, name string, kind string, parent_id string, start_line int, end_line int, start_col int, exported boolean")
    refs = spark.createDataFrame([(f"f{i}-{k}", f"f{i}", name, line, "calls") for i in range(40) for k, (name, line) in enumerate([("m2", 6), ("m2", 6), ("C", 20), ("none", 3)])], "ref_id string, path string, name string, line int, kind string")
    imports = spark.createDataFrame([("1", "f1", "./f2", "C")], "import_id string, from_path string, specifier string, name string")
    made = lambda: graph.build_graph(symbols, refs, imports, symbols.select("path").distinct())[1]
    few = made()
    monkeypatch.setattr(graph, "PART_ROWS", 10)
    many, before = made(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # large tables are not broadcast
    text = plan(many)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # references and their spans; with members, members, with tops, tops; edges: 120 symbols, 10 a part
    assert len([line for line in text.splitlines() if "Exchange hashpartitioning(" in line and ", 12), " in line]) == 7
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect())) and many.count() == 120 + 40 + 1 + 80
    assert sorted(map(tuple, graph.resolve_references(refs, symbols).collect())) == sorted((f"f{i}-{k}", t) for i in range(40) for k, t in ((0, f"f{i}#m2"), (1, f"f{i}#m2"), (2, f"f{i}#C")))
