"""Operators against literal fixtures, sequential loops and brute force."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import activity, context, extract, filters, graph, policy, scan, search, snapshots, usage
from corpusmill.sources import corpus


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_diff_snapshots(spark):
    prev = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, hash string")
    cur = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "path string, hash string")
    assert rows(snapshots.diff_snapshots(prev, cur), "path", "status") == [("a", "unchanged"), ("b", "changed"), ("c", "deleted"), ("d", "added")]
    assert rows(snapshots.changed_files(prev, cur)) == [("b",), ("d",)]


def test_incremental_equals_rebuild(spark):
    def files(d):
        return spark.createDataFrame(sorted(d.items()), "path string, content string")

    def symbols(f):
        return f.select("path", F.explode(F.split("content", " ")).alias("name"))

    old, new = {"a": "x y", "b": "z", "c": "w"}, {"a": "x y", "b": "z q", "d": "n"}
    prev = {"hashes": snapshots.hash_snapshot(files(old)), "symbols": symbols(files(old))}
    out = snapshots.incremental_index(prev, files(new), symbols)
    assert rows(out["symbols"], "path", "name") == rows(symbols(files(new)), "path", "name")
    assert dict(out["counters"].collect()) == {"unchanged": 1, "changed": 1, "deleted": 1, "added": 1}


def test_snapshot_files(spark, tmp_path):
    h = spark.createDataFrame([("a", "1")], "path string, hash string")
    corpus.write_hash_snapshot(h, str(tmp_path / "s"))
    assert rows(corpus.read_hash_snapshot(spark, str(tmp_path / "s"))) == [("a", "1")]
    assert rows(corpus.read_hash_snapshot(spark, str(tmp_path / "none"))) == []


def test_context_store(spark, tmp_path):
    one = spark.createDataFrame([("a",)], "path string")
    corpus.save_context(spark, {"files": one}, str(tmp_path))
    corpus.save_context(spark, {"files": one.union(one)}, str(tmp_path))
    assert corpus.load_context(spark, str(tmp_path))["files"].count() == 2


def test_scan(spark, tmp_path):
    for p in ("src/a.ts", "src/deep/b.json", "node_modules/x.js", "README.md", "Dist/y.js"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("body")
    found = corpus.scan_corpus(spark, str(tmp_path))
    assert rows(found, "path", "language") == [("README.md", "markdown"), ("src/a.ts", "typescript"), ("src/deep/b.json", "json")]
    assert rows(corpus.read_corpus(spark, str(tmp_path)), "path", "content")[0] == ("README.md", "body")
    totals = scan.scan_totals(found.withColumn("repo_id", F.lit("r"))).first()
    assert (totals.total_files, totals.total_folders, totals.has_readme, totals.has_package_json) == (3, 2, True, False)


def test_ignore_rules(spark):
    rules = filters.parse_rules(spark, {"": "*.log\n!keep.log\nbuild/\n/top.txt\ndocs/*.md\n**/tmp/*\n", "sub": "!b.log\nx?.c\n[!a]z\n"})
    paths = ["a.log", "keep.log", "sub/b.log", "build/x", "src/build/y/z", "build", "top.txt", "src/top.txt", "docs/a.md", "docs/x/a.md", "q/tmp/a", "sub/x1.c", "sub/az", "sub/bz", "x1.c"]
    kept = filters.apply_ignore_rules(spark.createDataFrame([(p,) for p in paths], "path string"), rules)
    assert [r[0] for r in rows(kept)] == sorted(["keep.log", "sub/b.log", "build", "src/top.txt", "docs/x/a.md", "sub/az", "x1.c"])


def test_secrets(spark):
    key = "AK" + "IA" + "Q" * 16
    items = spark.createDataFrame([("a/.env", "x"), ("b.txt", f"k {key}"), ("c.txt", "password = your-password-here"), ("d.txt", "token: Zq81mLw0Rt55"), ("e.txt", None)], "path string, content string")
    assert rows(filters.deny_filter(items), "path", "accepted") == [("a/.env", False), ("b.txt", False), ("c.txt", True), ("d.txt", False), ("e.txt", True)]


def loop_budget(items, per, cap, most):
    """items (kind, tokens) in order: what a plain loop keeps."""
    kept = [(k, min(t, per)) for k, t in items]
    while sum(t for _, t in kept) > cap and kept and kept[-1][0] != "instructions":
        kept.pop()
    while len(kept) > most and kept[-1][0] not in ("instructions", "dependency-chain"):
        kept.pop()
    return len(kept)


def test_budget_is_the_loop(spark):
    rnd = random.Random(1)
    data, want = [], {}
    for task in range(150):
        items = [(rnd.choice(["instructions", "dependency-chain", "search", "search"]), rnd.randrange(1, 40)) for _ in range(rnd.randrange(1, 12))]
        data += [(task, i, k, "x" * (4 * t)) for i, (k, t) in enumerate(items)]
        want[task] = loop_budget(items, 10**6, 80, 4)
    out = context.apply_budget(spark.createDataFrame(data, "task_id int, ord int, kind string, content string"), 10**6, 80, 4)
    assert dict(out.groupBy("task_id").agg(F.count_if("kept")).collect()) == want


def test_latency_ema(spark):
    t = datetime.datetime(2024, 1, 1)
    e = spark.createDataFrame([("a", 15.0, t), ("a", 25.0, t + datetime.timedelta(seconds=1)), ("b", 7.0, t)], "kind string, v double, ts timestamp")
    assert rows(activity.latency_ema(e, "kind", "v", ["ts"]), "kind", "ema") == [("a", 15.0), ("a", 18.0), ("b", 7.0)]


def test_p95_is_the_ninth_of_ten(spark):
    e = spark.createDataFrame([("a", float(i)) for i in range(1, 11)], "k string, v double")
    r = usage.latency_stats(e, "k", "v").first()
    assert (r.samples, r.avg, r.max, r.p95) == (10, 6, 10.0, 9.0)


def test_usage_costs(spark):
    u = spark.createDataFrame([(1, "openai", "gpt-4o", 1000.0, 2000.0, None, None), (2, "openai", "gpt-4o", None, None, None, None), (3, "x", "y", None, None, 5.0, 6.0)], "id int, provider string, model string, reported_input double, reported_output double, estimated_input double, estimated_output double")
    u = u.withColumns({"agent": F.lit(None).cast("string"), "request_count": F.lit(None).cast("long"), "latency_ms": F.lit(float("nan"))})
    out = {r.id: r for r in usage.compute_cost(usage.price_usage(usage.normalize_usage(u), usage.prices(spark))).collect()}
    assert (out[1].total_tokens, out[1].total_src, out[1].cost, out[1].cost_src) == (3000.0, 0, 0.0225, 1)
    assert (out[2].total_tokens, out[2].cost, out[2].cost_note) == (None, None, "token total unknown")
    assert (out[3].total_src, out[3].cost_note, out[3].agent, out[3].latency_ms) == (1, "no price for this model", "x", None)


def test_mixed_currencies_have_no_sum(spark):
    c = spark.createDataFrame([(1.0, 1, "USD"), (2.0, 1, "EUR"), (None, 2, None)], "cost double, cost_src int, currency string")
    assert tuple(c.agg(*usage.sum_cost()).first()) == (None, 2, None)


def test_cycles_and_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 5), (6, 7), (7, 6), (7, 8)], "src long, dst long")
    assert rows(graph.scc(e)) == [(1, 3), (2, 3), (3, 3), (6, 7), (7, 7)]
    found = {}
    for r in graph.cycles(e).orderBy("cycle_id", "step").collect():
        found.setdefault(r.cycle_id, []).append(r.node)
    assert found == {"1": ["1", "2", "3", "1"], "5": ["5", "5"], "6": ["6", "7", "6"]}
    assert graph.scc(e.where("src > 7")).count() == 0


def test_shortest_paths(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "d"), ("a", "c"), ("c", "d"), ("d", "e")], "src string, dst string")
    pairs = spark.createDataFrame([(1, "a", "e"), (2, "e", "a"), (3, "c", "c")], "pair_id int, src string, dst string")
    out = rows(graph.shortest_paths(e, pairs).na.fill("-").na.fill(-1))
    assert out == [(1, 3, 0, "a"), (1, 3, 1, "b"), (1, 3, 2, "d"), (1, 3, 3, "e"), (2, -1, -1, "-"), (3, 0, 0, "c")]


def test_fuzzy_join_is_complete(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 12)))
    terms, tokens = sorted({word() for _ in range(60)}), sorted({word() for _ in range(200)})

    def dist(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = _step(row, x, b, i)
        return row[-1]

    def _step(row, x, b, i):
        out = [i]
        for j, y in enumerate(b, 1):
            out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
        return out

    limit = lambda n: 0 if n <= 1 else 1 if n <= 4 else 2 if n <= 8 else -(-n // 4)
    want = sorted((a, b, dist(a, b)) for a in terms for b in tokens if dist(a, b) <= limit(len(a)))
    got = rows(search.fuzzy_join(spark.createDataFrame([(t,) for t in terms], "term string"), spark.createDataFrame([(t,) for t in tokens], "token string")))
    assert got == want


def test_extraction(spark):
    text = "import d, { a as b } from './x';\n/** Doc. */\nexport class C {\n  private run(x) {\n    return helper(x);\n  }\n}\nexport default function helper() {\n  const c = new C();\n}\n"
    f = spark.createDataFrame([("m.ts", "typescript", text)], "path string, language string, content string")
    s = extract.extract_symbols(f)
    assert rows(s, "name", "kind", "start_line", "end_line", "exported") == [("C", "class", 3, 7, True), ("c", "constant", 9, 9, False), ("helper", "function", 8, 10, True), ("run", "method", 4, 6, False)]
    assert {r.name: r.parent_id for r in s.collect()}["run"] == "m.ts#C@3:0"
    assert {r.name: (r.documentation, r.visibility) for r in s.collect()}["C"] == ("Doc.", "public")
    assert rows(extract.extract_imports(f), "name", "imported_name") == [("b", "a"), ("d", "default")]
    assert rows(extract.extract_references(f, s), "name", "kind", "line") == [("C", "construct", 9), ("helper", "call", 5)]


def test_package_policy(spark):
    base = {"license": "MIT", "repository": "https://x", "package_source": "npm", "dependencies_declared": True, "install_binary": "npx", "install_args": ["a"], "permissions": [], "maintainer": "m", "release_provenance": "p", "declared_status": None, "declared_trust": None, "community_reported": False, "review_passed": False, "review_verified": False, "review_checklist": []}
    cases = {"plain": {}, "shell": {"install_args": ["a; b"]}, "secret": {"permissions": ["secrets"]}, "declared": {"declared_status": "blocked"}, "seen": {"review_passed": True, "review_verified": True, "review_checklist": ["x"]}}
    schema = "license string, repository string, package_source string, dependencies_declared boolean, install_binary string, install_args array<string>, permissions array<string>, maintainer string, release_provenance string, declared_status string, declared_trust string, community_reported boolean, review_passed boolean, review_verified boolean, review_checklist array<string>, tool_name string"
    df = spark.createDataFrame([tuple({**base, **c, "tool_name": n}[k.split()[0]] for k in schema.split(", ")) for n, c in cases.items()], schema)
    assert {r.tool_name: (r.status, r.risk) for r in policy.assess_packages(df).collect()} == {"plain": ("unverified", "medium"), "shell": ("blocked", "critical"), "secret": ("blocked", "critical"), "declared": ("blocked", "medium"), "seen": ("verified", "medium")}


def test_no_cartesian_product_in_search(spark, capsys):
    f = spark.createDataFrame([("r", "a/auth.ts", "typescript", "login code"), ("r", "b/util.ts", "typescript", "helper")], "repo_id string, path string, language string, content string")
    q = spark.createDataFrame([(1, "where is the logn"), (2, "  "), (3, "auth.ts")], "query_id int, q string")
    hits = search.search(search.build_search_entities(f), q)
    assert rows(hits, "query_id", "path") == [(3, "a/auth.ts")]
    hits.explain()
    plan = capsys.readouterr().out
    assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan


def test_scorer_is_told_whole_words(spark):
    f = spark.createDataFrame([("r", "a/auth.ts", "ts", "login code, log in"), ("r", "b/login.ts", "ts", "helper_login x"), ("r", "c/c.ts", "ts", None)], "repo_id string, path string, language string, content string")
    q = spark.createDataFrame([(1, "where is the logn"), (2, "login auth.ts"), (3, "code log help")], "query_id int, q string")
    e = search.build_search_entities(f)
    told = lambda term, name, text, sim, word: search.lexical_score(term, name, text, sim, word)
    split = lambda term, name, text, sim: search.lexical_score(term, name, text, sim)
    want = rows(search.search(e, q), "query_id", "rank", "score", "key")
    assert want == rows(search.search(e, q, scorer=told), "query_id", "rank", "score", "key") == rows(search.search(e, q, scorer=split), "query_id", "rank", "score", "key")
    whole = lambda term, name, text, sim, word: F.when(word, 1.0).otherwise(0.0)
    assert rows(search.search(e, q, fuzzy=False, scorer=whole), "query_id", "path", "score") == [(2, "a/auth.ts", 0.5), (2, "b/login.ts", 0.5), (3, "a/auth.ts", 0.666667)]


def test_exports(spark, tmp_path):
    daily = spark.createDataFrame([("2024-01-01", 2, 5)], "date string, scans int, tokens_used int")
    corpus.export_daily_csv(daily, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.columns == corpus.DAILY_COLUMNS and tuple(back.select("scans", "errors", "tokens_used").first()) == ("2", "0", "5")
    nodes, edges = spark.createDataFrame([("n:a", "file")], "id string, kind string"), spark.createDataFrame([("n:a", "n:b", "calls")], "src string, dst string, kind string")
    corpus.export_graph_json(nodes, edges, str(tmp_path / "json"))
    assert sorted(r.record_type for r in spark.read.json(str(tmp_path / "json")).collect()) == ["edge", "node"]
    u = spark.createDataFrame([("1", datetime.datetime(2024, 1, 2))], "id string, occurred_at timestamp")
    corpus.append_usage(u, str(tmp_path / "usage"))
    assert spark.read.parquet(str(tmp_path / "usage")).where("day = date'2024-01-02'").count() == 1


def test_parser_table_function(spark):
    from corpusmill.operators import extract as E

    def words(path, content):
        return [{"path": path, "n": len(w)} for w in content.split()]

    E.register_parsers(spark, {"words": ("path string, n int", {"text": words, "broken": lambda p, c: [{}["x"]]}), "sizes": ("size long", {"text": lambda p, c: [{"size": len(c)}]})}, "parse_test")
    files = spark.createDataFrame([("a", "text", "one three"), ("b", "broken", "x"), ("c", "other", "y"), ("d", "text", "")], "path string, language string, content string")
    rows = lambda kind: spark.sql(f"SELECT f.path AS file, p.* FROM {{f}} f, LATERAL parse_test('{kind}', f.path, f.language, f.content) p", f=files)
    assert sorted(map(str, map(tuple, rows("words").collect()))) == ["('a', 'a', 3, None)", "('a', 'a', 5, None)", "('b', None, None, \"KeyError: 'x'\")", "('c', None, None, 'unsupported language: other')"]
    assert rows("sizes").columns == ["file", "size", "skipped"] and {(r.file, r.size) for r in rows("sizes").collect()} == {("a", 9), ("b", None), ("c", None), ("d", 0)}
    with pytest.raises(Exception):
        rows("nothing").collect()


def test_answer_totals_and_run_details(spark):
    import datetime

    from corpusmill.operators import activity as A

    answers = spark.createDataFrame([(1, "a", "x y"), (1, "b", "x"), (2, "a", None), (2, "b", "none"), (3, "a", "p"), (3, "b", "p")], "task_id long, mode string, text string")
    expected = spark.createDataFrame([(1, "x"), (1, "y"), (2, "q"), (3, "p")], "task_id long, term string")
    out = {r.task_id: (r.a_points, r.b_points, r.winner) for r in A.answer_totals(A.score_answers(answers, expected), ["a", "b"]).collect()}
    assert out == {1: (2, 1, "a"), 2: (-1, 0, "b"), 3: (2, 2, "tie"), None: (3, 3, "all")}
    t = datetime.datetime(2024, 1, 1)
    steps = spark.createDataFrame([(1, "a", t, '{"input": 5, "reasoning": 2, "cost": 0.5}'), (1, "a", t + datetime.timedelta(seconds=4), '{"input": 1, "cache_read": 7}'), (1, "a", t + datetime.timedelta(seconds=10), "broken")], "task_id long, mode string, at timestamp, event string")
    r = A.run_step_details(steps).first()
    assert (r.input, r.output, r.reasoning, r.cache_read, r.cost, r.steps, r.mean_seconds, r.longest_seconds) == (6, 0, 2, 7, 0.5, 3, 5.0, 6.0)


def test_references_move_once_for_their_spans_and_once_for_each_table_of_names(spark):
    symbols = spark.createDataFrame([("c", "f", "C", "class", None, 1, 9, 0, True), ("m", "f", "go", "method", "c", 2, 4, 0, False), ("t", "f", "go", "function", None, 300, 300, 0, False), ("u", "f", "up", "function", None, 10, 12, 0, False)], "id string, path string, name string, kind string, parent_id string, start_line int, end_line int, start_col int, exported boolean")
    refs = spark.createDataFrame([("1", "f", "go", "calls", 3), ("1", "f", "go", "calls", 3), ("2", "f", "go", "calls", 11), ("3", "f", "up", "reads", 11), ("4", "f", "no", "reads", 3), ("5", "f", "up", "reads", 600), ("6", None, "up", "reads", 3), ("7", "f", "go", "calls", 12), ("7", "f", "up", "reads", 3)], "ref_id string, path string, name string, kind string, line int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = graph.resolve_references(refs, symbols)
        assert sorted(map(tuple, got.collect())) == [("1", "m"), ("1", "m"), ("2", "t"), ("3", "u"), ("5", "u"), ("7", "t"), ("7", "u")]
        assert got._jdf.queryExecution().sparkPlan().toString().count("Join") == 3
        assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") <= 6
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    imports = spark.createDataFrame([], "import_id string, from_path string, specifier string")
    edges = graph.build_graph(symbols, refs, imports, spark.createDataFrame([("f",)], "path string"))[1]
    used = sorted((r.src, r.dst, r.kind) for r in edges.where("kind in ('calls', 'reads')").collect())
    # rows of one ref_id are references of their own: the seventh gives no edge that crosses its two rows
    assert used == [("n:file:f", "n:u", "reads"), ("n:m", "n:m", "calls"), ("n:m", "n:u", "reads"), ("n:u", "n:t", "calls"), ("n:u", "n:u", "reads")]
