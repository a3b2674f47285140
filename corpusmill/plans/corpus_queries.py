"""Queries of scans, snapshots, usage and activity over the given tables."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import scalars as S
from ..operators import activity as A
from ..operators import filters as P
from ..operators import scan as C
from ..operators import snapshots as N
from ..operators import usage as U
from ..operators.stored import shared_folder
from ..sources import corpus
from .tables import ACTIVITY, EDGES, FILES, SNAPSHOTS, SYMBOLS, USAGE, activity, edges, files, raw_usage, read, snapshots, symbols

Q, SQL = {}, {}
_COUNTERS = ", ".join(f"count(*) FILTER (kind = '{k}') AS {c}" for k, c in A.COUNTERS.items())
_SAVED = "sum(greatest(0, baseline_tokens - used_tokens))::BIGINT"


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_EXT = "nullif(lower(regexp_extract(regexp_extract(path, '[^/\\\\]*$'), '^.+\\.([^.]+)$', 1)), '')"


@query(f"WITH {FILES} SELECT language, count(*) AS files, round(count(*) * 100.0 / (SELECT count(*) FROM files WHERE language IS NOT NULL), 2)::DOUBLE AS share, list_sort(list(DISTINCT {_EXT})) AS extensions FROM files WHERE language IS NOT NULL GROUP BY language")
def a1_language_counts(spark, d):
    return C.language_counts(files(spark, d))


@query(f"WITH {FILES} SELECT {_EXT} AS extension, count(*) AS files, min(language) AS language FROM files GROUP BY 1")
def a2_file_type_counts(spark, d):
    return C.file_type_counts(files(spark, d))


_DIRS = "dirs AS (SELECT repo_id, path, array_to_string(list_slice(string_split(path, '/'), 1, n), '/') AS d FROM (SELECT repo_id, path, unnest(range(1, len(string_split(path, '/')))) AS n FROM files))"


@query(f"WITH {FILES}, {_DIRS} SELECT f.repo_id, f.total_files, false AS has_package_json, false AS has_tsconfig, false AS has_readme, false AS has_git, g.total_folders FROM (SELECT repo_id, count(*) AS total_files FROM files GROUP BY 1) f JOIN (SELECT repo_id, count(DISTINCT d) AS total_folders FROM dirs GROUP BY 1) g USING (repo_id)")
def a3_scan_totals(spark, d):
    return C.scan_totals(files(spark, d))


def _signals(spark, d):
    c = read(spark, d, "customer")
    k = F.col("c_custkey") % 8
    pkg = F.when(k == 0, F.lit('{"dependencies": {"react": "1", "next": "2"}}')).when(k == 1, F.lit('{"devDependencies": {"vue": "3"}}')).when(k == 2, F.lit('{"name": "x"}')).when(k == 7, F.lit('{"dependencies": {"express": "4"}, "devDependencies": {"react": "5"}}'))
    no = F.lit(False)
    return c.select(F.col("c_custkey").alias("repo_id"), pkg.alias("package_json"), (k == 3).alias("has_next_folder"), no.alias("has_requirements"), (k == 4).alias("has_pyproject"), (k == 5).alias("has_go_mod"), no.alias("has_cargo_toml"), no.alias("has_pom_xml"), no.alias("has_gemfile"))


@query("SELECT c_custkey AS repo_id, ['next.js', 'vue', 'node.js', 'next.js', 'python', 'go', NULL, 'react'][c_custkey % 8 + 1] AS framework FROM customer")
def a4_detect_framework(spark, d):
    return C.detect_framework(_signals(spark, d))


@query("SELECT o_custkey AS repo_id, CASE WHEN min(k) < 6 THEN ['pnpm', 'yarn', 'npm', 'bun', 'deno', 'npm'][min(k) + 1] END AS package_manager FROM (SELECT o_custkey, o_orderkey % 9 AS k FROM orders) GROUP BY 1")
def a5_detect_package_manager(spark, d):
    names = F.array(*[F.lit(n) for n, _ in X.PACKAGE_MANAGERS], *[F.lit(n) for n in ("go.mod", "src/a.py", "x.md")])
    f = read(spark, d, "orders").select(F.col("o_custkey").alias("repo_id"), F.element_at(names, (F.col("o_orderkey") % 9 + 1).cast("int")).alias("path"))
    return C.detect_package_manager(f)


_TREE = f"""WITH {FILES}, {_DIRS}, e AS (
  SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent, regexp_extract(path, '[^/]*$') AS name, 'file' AS type, path AS full_path FROM files
  UNION ALL SELECT DISTINCT CASE WHEN d LIKE '%/%' THEN regexp_extract(d, '^(.*)/[^/]*$', 1) ELSE '' END, regexp_extract(d, '[^/]*$'), 'folder', d FROM dirs
) SELECT e.parent, e.name, e.type, coalesce(c.n, 0) AS children FROM e LEFT JOIN (SELECT parent, count(*) AS n FROM e GROUP BY 1) c ON c.parent = e.full_path"""


@query(_TREE)
def a6_file_tree(spark, d):
    return C.file_tree(files(spark, d))


@query(f"WITH {FILES} SELECT repo_id, count(*) AS n_files, count(language) AS n_known, count(DISTINCT language) AS n_languages FROM files GROUP BY 1")
def a7_project_overview(spark, d):
    f = files(spark, d)
    return C.project_overview({"files": f, "known": f.where("language is not null"), "languages": f.where("language is not null").select("repo_id", "language").distinct()}).drop("languages")


def _links(spark, d):
    """Documents of a source lead to the next document of all."""
    f = files(spark, d).select("path", F.regexp_extract("path", r"/f(\d+)", 1).cast("long").alias("i"))
    return f.select(F.col("path").alias("src_path"), (F.col("i") + 1).alias("i")).join(f.select(F.col("path").alias("dst_path"), "i"), "i").select("src_path", "dst_path")


@query(f"""WITH {FILES}, {_DIRS}, links AS (SELECT a.path AS s, b.path AS t FROM files a JOIN files b ON b.doc_id = a.doc_id + 1
), o AS (SELECT x.d, count(*) AS n FROM links JOIN dirs x ON x.path = s WHERE NOT starts_with(t, x.d || '/') GROUP BY 1
), i AS (SELECT x.d, count(*) AS n FROM links JOIN dirs x ON x.path = t WHERE NOT starts_with(s, x.d || '/') GROUP BY 1
) SELECT d AS dir, count(*) AS files, sum(length(path) % 3)::BIGINT AS symbols, coalesce(any_value(o.n), 0) AS dependencies_out, coalesce(any_value(i.n), 0) AS dependencies_in
FROM dirs LEFT JOIN o USING (d) LEFT JOIN i USING (d) GROUP BY d""")
def a8_explain_modules(spark, d):
    f = files(spark, d)
    sym = f.select("path", F.explode(F.sequence(F.lit(1), F.length("path") % 3 + 1)).alias("n")).where(F.col("n") <= F.length("path") % 3)
    return C.explain_modules(f, sym, _links(spark, d), C.folder_modules(f).select(F.col("path").alias("dir")))


@query(f"WITH {SYMBOLS} SELECT kind, count(*) AS n FROM symbols GROUP BY 1")
def a9_symbol_kind_counts(spark, d):
    return C.group_counts(symbols(spark, d), "kind")


@query(f"WITH {FILES}, {_DIRS} SELECT d AS path, regexp_extract(d, '[^/]*$') AS name, 'folder' AS module_type, count(DISTINCT path) AS files FROM dirs GROUP BY d")
def e7_folder_modules(spark, d):
    return C.folder_modules(files(spark, d))


@query(f"WITH {FILES}, {_DIRS} SELECT DISTINCT path, d AS dir FROM dirs")
def j10_join_ancestors(spark, d):
    f = files(spark, d)
    dirs = C.folder_modules(f).select(F.col("path").alias("dir"))
    return C.join_ancestors(f.select("path").distinct(), dirs).select("path", "dir")


@query(f"WITH {FILES} SELECT language, count(*) AS files FROM files WHERE language IS NOT NULL GROUP BY 1 ORDER BY files DESC, language LIMIT 6")
def t2_top_languages(spark, d):
    return C.top_languages(files(spark, d))


_NOW = datetime.datetime(2024, 6, 1)


@query(f"""WITH {FILES}, {_DIRS} SELECT repo_id, list_sort(list(DISTINCT language) FILTER (language IS NOT NULL)) AS languages, NULL::VARCHAR AS framework, NULL::VARCHAR AS package_manager,
count(*) AS total_files, (SELECT count(DISTINCT d) FROM dirs WHERE dirs.repo_id = files.repo_id) AS total_folders, CASE WHEN repo_id = 'r1' THEN TIMESTAMP '2020-01-01' ELSE TIMESTAMP '2024-06-01' END AS created_at, TIMESTAMP '2024-06-01' AS updated_at FROM files GROUP BY repo_id""")
def s11_project_manifest(spark, d):
    f = files(spark, d)
    none = f.select("repo_id").distinct()
    previous = none.where("repo_id = 'r1'").withColumn("created_at", F.lit(datetime.datetime(2020, 1, 1)).cast("timestamp_ntz"))
    out = C.project_manifest(f, none.withColumn("framework", F.lit(None).cast("string")), C.detect_package_manager(f), previous, _NOW)
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("created_at", "updated_at")})


_DIFF = "full_diff AS (SELECT coalesce(prev.path, cur.path) AS path, CASE WHEN prev.hash IS NULL THEN 'added' WHEN cur.hash IS NULL THEN 'deleted' WHEN prev.hash = cur.hash THEN 'unchanged' ELSE 'changed' END AS status, prev.hash AS prev_hash, cur.hash AS cur_hash FROM prev FULL JOIN cur USING (path))"


@query(f"WITH {SNAPSHOTS}, {_DIFF} SELECT * FROM full_diff")
def j1_diff_snapshots(spark, d):
    return N.diff_snapshots(*snapshots(spark, d))


@query(f"WITH {SNAPSHOTS}, {_DIFF} SELECT path FROM full_diff WHERE status IN ('added', 'changed')")
def j2_changed_files(spark, d):
    return N.changed_files(*snapshots(spark, d))


@query(f"WITH {SNAPSHOTS} SELECT path FROM prev UNION SELECT path FROM cur")
def u2_snapshot_key_union(spark, d):
    return N.snapshot_key_union(*snapshots(spark, d))


@query(f"""WITH {SNAPSHOTS}, {_DIFF} SELECT coalesce(prev.path, cur.path) AS path, coalesce(cur.hash, prev.hash) AS hash, CASE WHEN prev.path IS NOT NULL THEN 1 ELSE 2 END AS created_at, CASE WHEN cur.path IS NOT NULL THEN 2 ELSE 1 END AS updated_at FROM prev FULL JOIN cur ON prev.path = cur.path""")
def s6_merge_upsert(spark, d):
    prev, cur = snapshots(spark, d)
    mark = lambda df, n: df.select("path", "hash", F.lit(n).alias("created_at"), F.lit(n).alias("updated_at"))
    return N.merge_upsert(mark(prev, 1), mark(cur, 2), ["path"], ["hash", "updated_at"], ["created_at"])


@query(f"WITH {SYMBOLS} SELECT s.path, s.name, s.kind FROM symbols s JOIN orders ON s.path = 'src/o' || o_orderkey || '.ts' WHERE o_orderstatus <> 'P'")
def s7_delete_files(spark, d):
    o = read(spark, d, "orders")
    path = F.concat(F.lit("src/o"), F.col("o_orderkey").cast("string"), F.lit(".ts")).alias("path")
    tables = {"files": o.select(path), "symbols": symbols(spark, d)}
    return N.delete_files(tables, o.where("o_orderstatus = 'P'").select(path))["symbols"].select("path", "name", "kind")


@query(f"WITH {SYMBOLS} SELECT id, path, name, start_line, o_orderpriority AS language FROM symbols JOIN orders ON path = 'src/o' || o_orderkey || '.ts'")
def s8_j3_symbols_with_files(spark, d):
    from ..operators import graph as G

    o = read(spark, d, "orders").select(F.concat(F.lit("src/o"), F.col("o_orderkey").cast("string"), F.lit(".ts")).alias("path"), F.col("o_orderpriority").alias("language"))
    return G.symbols_with_files(symbols(spark, d), o).select("id", "path", "name", "start_line", "language")


@query("""SELECT 'lineitem' AS table_name, 'unique' AS rule, l_orderkey || '|' || l_linenumber AS detail, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT 'events', 'not_null', 'flag', count(*) FROM events WHERE event_type = 'view' HAVING count(*) > 0
UNION ALL SELECT 'lineitem', 'foreign_key', l_partkey::VARCHAR, count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <> 5) GROUP BY l_partkey""")
def s13_validate_context(spark, d):
    ev = read(spark, d, "events").withColumn("flag", F.when(F.col("event_type") != "view", F.lit(1)))
    tables = {"lineitem": read(spark, d, "lineitem"), "events": ev, "part": read(spark, d, "part").where("p_size <> 5")}
    return N.validate_context(tables, {"lineitem": ["l_orderkey", "l_linenumber"]}, {"events": ["flag", "event_id"]}, [("lineitem", "l_partkey", "part", "p_partkey")])


@query(f"""WITH {SNAPSHOTS}, b AS (SELECT coalesce(prev.repo_id, cur.repo_id) AS repo_id, prev.hash AS p, cur.hash AS c FROM prev FULL JOIN cur USING (repo_id, path)
), n AS (SELECT repo_id, count(*) FILTER (p <> c) AS changed, count(*) FILTER (p IS NULL) AS added, count(*) FILTER (c IS NULL) AS deleted FROM b WHERE repo_id <> 'r2' GROUP BY 1
) SELECT repo_id, 'stale' AS state, changed, added, deleted FROM n WHERE repo_id <> 'r3' UNION ALL SELECT 'r3', 'unavailable', 0, 0, 0 UNION ALL SELECT 'r2', 'unknown', 0, 0, 0""")
def d1_detect_freshness(spark, d):
    prev, cur = snapshots(spark, d)
    repos = files(spark, d).select("repo_id").distinct().withColumn("available", F.col("repo_id") != "r3")
    return N.detect_freshness(prev.where("repo_id <> 'r2'"), cur, repos)


@query(f"WITH {SNAPSHOTS}, n AS (SELECT count(*) FILTER (cur.path IS NULL) AS deleted, count(*) FILTER (prev.path IS NOT NULL AND cur.path IS NOT NULL AND length(cur.path) % 2 = 1) AS modified, count(*) FILTER (prev.path IS NULL) AS added FROM prev FULL JOIN cur USING (path)) SELECT deleted, modified, added, deleted + modified + added AS changes FROM n")
def d2_probe_changes(spark, d):
    prev, cur = snapshots(spark, d)
    listing = cur.select("path", (F.length("path") % 2).alias("modified_at"))
    return N.probe_changes(prev, listing, 0)


def _line_symbols(f):
    """A stand-in extractor for tables: one symbol a line of a file, named by its hash."""
    return f.select("path", F.posexplode(F.split("content", "\n")).alias("line", "t")).select("path", "line", S.content_hash(F.col("t")).alias("name"))


@query(f"WITH {FILES} SELECT path, unnest(range(0, len(string_split(content, chr(10)))))::INTEGER AS line, sha256(unnest(string_split(content, chr(10)))) AS name FROM files WHERE doc_id % 13 <> 0")
def e6_incremental_index(spark, d):
    docs = read(spark, d, "documents")
    f = docs.select(path_of(), F.col("text").alias("content"), "doc_id")
    old = f.where("doc_id % 11 <> 0").withColumn("content", F.when(F.col("doc_id") % 7 == 0, F.concat("content", F.lit("\nold"))).otherwise(F.col("content"))).drop("doc_id")
    prev = {"hashes": N.hash_snapshot(old), "symbols": _line_symbols(old)}
    return N.incremental_index(prev, f.where("doc_id % 13 <> 0").drop("doc_id"), _line_symbols)["symbols"]


def path_of():
    from .tables import path_expr

    return path_expr().alias("path")


# --- sources and sinks: what is written is read back ---


def _scratch(spark) -> str:
    return f"{shared_folder(spark)}/cm-{uuid.uuid4().hex}"


def _tree(spark, d) -> str:
    """The documents as text files in twenty folders."""
    root = _scratch(spark)
    read(spark, d, "documents").select(F.concat(F.lit("d"), (F.col("doc_id") % 20).cast("string")).alias("dir"), "text").write.partitionBy("dir").text(root)
    return root


@query("SELECT 'dir=d' || (doc_id % 20) AS dir, 'txt' AS extension, NULL::VARCHAR AS language, sum(strlen(text) + 1)::BIGINT AS size_bytes FROM documents GROUP BY 1")
def s1_scan_corpus(spark, d):
    found = corpus.scan_corpus(spark, _tree(spark, d))
    return found.groupBy(F.regexp_extract("path", "^([^/]*)/", 1).alias("dir"), "extension", "language").agg(F.sum("size_bytes").alias("size_bytes"))


@query("SELECT 'dir=d' || (doc_id % 20) AS dir, 'txt' AS extension, sum(strlen(text) + 1)::BIGINT AS size_bytes, sum(length(text) + 1)::BIGINT AS characters FROM documents WHERE doc_id % 20 NOT IN (3, 5) GROUP BY 1")
def s1_pruned_tree(spark, d):
    """Two of the twenty folders are never entered: one by its name, one by a rule (that of a third is taken back)."""
    found = corpus.scan_tree(spark, _tree(spark, d), ignored=["DIR=d3"], rules="dir=d[57]/\n!dir=d7/\n_SUCCESS\n.*\n", content=True)
    return found.groupBy(F.regexp_extract("path", "^([^/]*)/", 1).alias("dir"), "extension").agg(F.sum("size_bytes").alias("size_bytes"), F.sum(F.length("content")).alias("characters"))


@query("SELECT 'dir=d' || (doc_id % 20) AS dir, sum(length(text) + 1)::BIGINT AS characters, sum(len(string_split(text, chr(10))))::BIGINT AS lines FROM documents GROUP BY 1")
def s2_read_corpus(spark, d):
    found = corpus.read_corpus(spark, _tree(spark, d))
    return found.groupBy(F.regexp_extract("path", "^([^/]*)/", 1).alias("dir")).agg(F.sum(F.length("content")).alias("characters"), F.sum(F.size(F.split("content", "\n", -1)) - 1).alias("lines"))


@query(f"WITH {SNAPSHOTS} SELECT path, hash FROM cur")
def s4_hash_snapshot(spark, d):
    root = _scratch(spark)
    corpus.write_hash_snapshot(snapshots(spark, d)[1], root)
    return corpus.read_hash_snapshot(spark, root)


@query(f"WITH {SYMBOLS} SELECT s.path, s.name, s.start_line, o_orderstatus = 'O' AS changed FROM symbols s JOIN orders ON s.path = 'src/o' || o_orderkey || '.ts' WHERE o_orderstatus <> 'P'")
def s5_s8_stored_context(spark, d):
    """A version of everything; then changes: files of status O are written again, files of status P lose their symbols."""
    root, o = _scratch(spark), read(spark, d, "orders")
    f = o.select(F.concat(F.lit("src/o"), F.col("o_orderkey").cast("string"), F.lit(".ts")).alias("path"), "o_orderstatus")
    sym = symbols(spark, d).select("path", "name", "start_line", "start_col").withColumn("changed", F.lit(False))
    corpus.save_context(spark, {"files": f, "symbols": sym}, root)
    again = sym.join(f.where("o_orderstatus = 'O'").select("path"), "path", "left_semi").withColumn("changed", F.lit(True))
    corpus.save_context(spark, {"files": f.where("o_orderstatus in ('O', 'P')"), "symbols": again}, root, changes=True)
    return corpus.ordered_symbols(corpus.load_context(spark, root)["symbols"]).select("path", "name", "start_line", "changed")


@query(f"WITH {ACTIVITY} SELECT ts::DATE AS date, {_COUNTERS}, sum(used_tokens)::BIGINT AS tokens_used, sum(baseline_tokens)::BIGINT AS baseline_tokens, {_SAVED} AS saved_tokens FROM activity GROUP BY 1 ORDER BY 1 DESC LIMIT 90")
def s9_export_daily_csv(spark, d):
    root = _scratch(spark)
    corpus.export_daily_csv(A.daily_activity(activity(spark, d)), root)
    return spark.read.option("header", True).schema("date date, " + ", ".join(f"{c} long" for c in corpus.DAILY_COLUMNS[1:])).csv(root)


@query(f"WITH {EDGES} SELECT 'edge' AS record_type, kind, count(*) AS n, count(DISTINCT src) AS ids FROM edges GROUP BY kind UNION ALL SELECT 'node', p_brand, count(*), count(DISTINCT p_partkey) FROM part GROUP BY p_brand")
def s10_export_graph_json(spark, d):
    root = _scratch(spark)
    corpus.export_graph_json(read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("kind")), edges(spark, d), root)
    back = spark.read.schema("record_type string, kind string, id long, src long, dst long, version int").json(root).where("version = 1")
    return back.groupBy("record_type", "kind").agg(F.count("*").alias("n"), F.count_distinct(F.coalesce("id", "src")).alias("ids"))


@query("SELECT event_id::VARCHAR AS id, event_type AS provider, ts AS occurred_at, event_id % 100 AS input_tokens, strftime(ts, '%Y-%m-%d') AS day FROM events")
def s12_usage_source(spark, d):
    """Events as JSON lines, read with the source's schema and appended to a table by day."""
    raw, kept = _scratch(spark), _scratch(spark)
    e = read(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("provider"), F.col("ts").cast("timestamp").alias("occurred_at"), (F.col("event_id") % 100).alias("input_tokens"))
    e.write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(raw)
    corpus.append_usage(corpus.usage_source(spark, raw), kept)
    back = spark.read.parquet(kept)
    return back.select("id", "provider", F.col("occurred_at").cast("timestamp_ntz").alias("occurred_at"), "input_tokens", F.col("day").cast("string").alias("day"))


# --- usage ---


def _usage(spark, d):
    return U.normalize_usage(raw_usage(spark, d))


def _priced(spark, d):
    return U.compute_cost(U.price_usage(_usage(spark, d), U.prices(spark)))


@query(f"WITH {USAGE} SELECT id, agent, request_count, latency_ms, input_tokens, output_tokens, total_tokens, in_src, out_src, total_src FROM usage")
def a15_normalize_usage(spark, d):
    return _usage(spark, d).select("id", "agent", "request_count", "latency_ms", "input_tokens", "output_tokens", "total_tokens", "in_src", "out_src", "total_src")


@query(f"WITH {USAGE} SELECT id, currency, cost, cost_src, cost_note FROM priced")
def j8_a12_price_and_cost(spark, d):
    return _priced(spark, d).select("id", "currency", "cost", "cost_src", "cost_note")


def _sums(where: str = "") -> str:
    q = lambda v, s: f"sum({v}) AS {v}, coalesce(max(CASE WHEN {v} IS NOT NULL THEN {s} END), 2) AS {v}_src"
    cost = "CASE WHEN min(currency) FILTER (cost IS NOT NULL) = max(currency) FILTER (cost IS NOT NULL) THEN {} END"
    return ", ".join([q("input_tokens", "in_src"), q("output_tokens", "out_src"), q("total_tokens", "total_src"), cost.format("floor(sum(cost) * 1e6 + 0.5) / 1e6") + " AS cost", "coalesce(" + cost.format("max(cost_src) FILTER (cost IS NOT NULL)") + ", 2) AS cost_src", cost.format("min(currency) FILTER (cost IS NOT NULL)") + " AS currency"])


@query(f"WITH {USAGE} SELECT provider, {_sums()} FROM priced GROUP BY provider")
def a10_a11_sum_quantities(spark, d):
    aggs = [a for c, s in (("input_tokens", "in_src"), ("output_tokens", "out_src"), ("total_tokens", "total_src")) for a in U.sum_quantity(c, s, c)]
    return _priced(spark, d).groupBy("provider").agg(*aggs, *U.sum_cost())


@query(f"""WITH {USAGE}, p AS (SELECT *, occurred_at::DATE AS day FROM priced) SELECT provider, day, count(*) AS events, sum(request_count)::BIGINT AS requests, {_sums()},
count(latency_ms) AS latency_samples, floor(avg(latency_ms) + 0.5)::BIGINT AS latency_avg, max(latency_ms) AS latency_max, CASE grouping(provider, day) WHEN 3 THEN 'all' WHEN 1 THEN 'provider' ELSE 'day' END AS scope
FROM p GROUP BY GROUPING SETS ((), (provider), (day))""")
def a13_usage_statistics(spark, d):
    return U.usage_statistics(_priced(spark, d))


@query("""WITH v AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, max(n) AS samples, floor(avg(value) + 0.5)::BIGINT AS avg, max(value) AS max, max(value) FILTER (i = floor((n - 1) * 0.95)) AS p95 FROM v GROUP BY event_type""")
def a14_latency_stats(spark, d):
    return U.latency_stats(read(spark, d, "events"), "event_type", "value")


def _scopes(spark, d, cap):
    u = _usage(spark, d).select("session_id").distinct()
    p = spark.createDataFrame([("provider", "openai"), ("provider", "claude"), ("provider", "local")], "scope_kind string, scope_value string")
    both = u.select(F.lit("session").alias("scope_kind"), F.col("session_id").alias("scope_value")).unionByName(p)
    return both.select("scope_kind", "scope_value", F.lit(cap).cast("double").alias("token_limit"), F.lit(0.05).alias("cost_limit"))


_BUDGET = f"""{USAGE}, scopes AS (SELECT DISTINCT 'session' AS scope_kind, session_id AS scope_value FROM usage UNION ALL SELECT * FROM (VALUES ('provider', 'openai'), ('provider', 'claude'), ('provider', 'local'))
), used AS (SELECT scope_kind, scope_value, sum(total_tokens) AS tokens, floor(sum(cost) * 1e6 + 0.5) / 1e6 AS cost FROM (SELECT 'session' AS scope_kind, session_id AS scope_value, total_tokens, cost FROM priced UNION ALL SELECT 'provider', provider, total_tokens, cost FROM priced) GROUP BY 1, 2
), status AS (SELECT scope_kind, scope_value, 20000::DOUBLE AS token_limit, 0.05::DOUBLE AS cost_limit, coalesce(tokens, 0) AS tokens, coalesce(cost, 0) AS cost, round(coalesce(tokens, 0) / 20000 * 100, 2) AS token_percent, round(coalesce(cost, 0) / 0.05::DOUBLE * 100, 2) AS cost_percent FROM scopes LEFT JOIN used USING (scope_kind, scope_value))"""


@query(f"WITH {_BUDGET} SELECT * FROM status")
def j9_budget_status(spark, d):
    return U.budget_status(_priced(spark, d), _scopes(spark, d, 20000))


@query(f"WITH {_BUDGET} SELECT u.id AS request_id, NOT (coalesce(tokens + 100 > token_limit, false) OR coalesce(cost + 0.01::DOUBLE > cost_limit, false)) AS allowed, CASE WHEN tokens + 100 > token_limit THEN 'tokens' WHEN cost + 0.01::DOUBLE > cost_limit THEN 'cost' END AS reason FROM usage u LEFT JOIN status s ON s.scope_kind = 'session' AND s.scope_value = u.session_id")
def j9_check_limits(spark, d):
    r = _usage(spark, d).select(F.col("id").alias("request_id"), F.lit("session").alias("scope_kind"), F.col("session_id").alias("scope_value"), F.lit(100.0).alias("projected_tokens"), F.lit(0.01).alias("projected_cost"))
    return U.check_limits(_priced(spark, d), _scopes(spark, d, 20000), r)


@query(f"WITH {USAGE} SELECT id, provider, occurred_at FROM usage WHERE provider = 'openai' AND occurred_at >= TIMESTAMP '2024-01-05' AND occurred_at <= TIMESTAMP '2024-01-20' ORDER BY occurred_at, id LIMIT 50")
def p6_usage_query(spark, d):
    t = lambda day: F.lit(datetime.datetime(2024, 1, day)).cast("timestamp_ntz")
    return P.usage_query(_usage(spark, d), t(5), t(20), 50, provider="openai", agent=None).select("id", "provider", "occurred_at")


@query(f"WITH {USAGE} SELECT id, occurred_at FROM usage")
def t1_order_usage(spark, d):
    return U.order_usage(_usage(spark, d)).select("id", "occurred_at")


@query("""SELECT event_id AS id, 'hi ' || event_type AS content, CASE WHEN event_id % 4 = 3 THEN NULL WHEN event_id % 4 = 1 THEN 0 ELSE event_id % 100 END AS input_tokens, CASE WHEN event_id % 4 = 3 THEN NULL WHEN event_id % 4 = 2 THEN 0 ELSE event_id % 50 END AS output_tokens,
CASE WHEN event_id % 4 = 3 THEN NULL ELSE (CASE WHEN event_id % 4 = 1 THEN 0 ELSE event_id % 100 END) + (CASE WHEN event_id % 4 = 2 THEN 0 ELSE event_id % 50 END) END AS total_tokens FROM events""")
def e10_extract_usage(spark, d):
    i = F.col("event_id")
    p, c = F.concat(F.lit('"prompt_tokens": '), (i % 100).cast("string")), F.concat(F.lit('"completion_tokens": '), (i % 50).cast("string"))
    usage = F.when(i % 4 == 0, F.concat(p, F.lit(", "), c)).when(i % 4 == 1, c).when(i % 4 == 2, p).otherwise("")
    body = F.concat(F.lit('{"choices": [{"message": {"content": "hi '), "event_type", F.lit('"}}], "usage": {'), usage, F.lit("}}"))
    return U.extract_usage(read(spark, d, "events").select(i.alias("id"), body.alias("body")))


# --- activity ---


@query(f"WITH {ACTIVITY} SELECT ts::DATE AS date, {_COUNTERS}, sum(used_tokens)::BIGINT AS tokens_used, sum(baseline_tokens)::BIGINT AS baseline_tokens, {_SAVED} AS saved_tokens FROM activity GROUP BY 1 ORDER BY 1 DESC LIMIT 90")
def a16_daily_activity(spark, d):
    return A.daily_activity(activity(spark, d))


@query(f"WITH {ACTIVITY}, b AS (SELECT {_COUNTERS}, min(ts) FILTER (kind = 'scan') AS first_scan, max(ts) FILTER (kind = 'scan') AS latest_scan, arg_max(files, (ts, event_id)) FILTER (kind = 'scan') AS last_files, sum(baseline_tokens)::BIGINT AS baseline, sum(used_tokens)::BIGINT AS used FROM activity) SELECT *, greatest(0, baseline - used) AS saved, round(greatest(0, baseline - used)::DOUBLE / baseline * 100, 2) AS percent FROM b")
def a19_activity_snapshot(spark, d):
    return A.activity_snapshot(activity(spark, d))


@query(f"WITH {ACTIVITY}, s AS (SELECT kind, row_number() OVER (PARTITION BY kind ORDER BY ts DESC, event_id DESC) - 1 AS back, count(*) OVER (PARTITION BY kind) AS n, latency_ms FROM activity WHERE latency_ms IS NOT NULL) SELECT kind, sum(pow(0.7, back) * (CASE WHEN back = n - 1 THEN 1.0 ELSE 0.3 END)::DOUBLE * latency_ms) AS ema FROM s GROUP BY kind")
def w5_latency_ema_unrounded(spark, d):
    return A.latency_ema_unrounded(activity(spark, d), "kind", "latency_ms", ["ts", "event_id"])


@query(f"""WITH RECURSIVE {ACTIVITY}, r AS (SELECT kind, row_number() OVER (PARTITION BY kind ORDER BY ts, event_id) AS ord, latency_ms FROM activity WHERE latency_ms IS NOT NULL
), e AS (SELECT kind, ord, latency_ms, latency_ms::DOUBLE AS ema FROM r WHERE ord = 1
UNION ALL SELECT r.kind, r.ord, r.latency_ms, CASE WHEN e.ema = 0 THEN r.latency_ms ELSE floor(0.7::DOUBLE * e.ema + 0.3::DOUBLE * r.latency_ms + 0.5::DOUBLE) END FROM e JOIN r ON r.kind = e.kind AND r.ord = e.ord + 1) SELECT * FROM e""")
def w5_latency_ema(spark, d):
    return A.latency_ema(activity(spark, d), "kind", "latency_ms", ["ts", "event_id"])


@query(f"WITH {ACTIVITY}, g AS (SELECT user_id, ts::DATE AS date, sum(used_tokens)::BIGINT AS used FROM activity GROUP BY 1, 2) SELECT *, (sum(used) OVER (PARTITION BY user_id ORDER BY date RANGE BETWEEN INTERVAL 89 DAY PRECEDING AND CURRENT ROW))::BIGINT AS used_rolling FROM g")
def w6_rolling_activity(spark, d):
    g = activity(spark, d).groupBy("user_id", F.to_date("ts").alias("date")).agg(F.sum("used_tokens").alias("used"))
    return A.rolling_activity(g, "user_id", "used")


@query(f"WITH {ACTIVITY}, g AS (SELECT ts::DATE AS date, sum(baseline_tokens)::BIGINT AS baseline, sum(used_tokens)::BIGINT AS used, {_SAVED} AS saved FROM activity GROUP BY 1) SELECT *, " + ", ".join(f"(sum({c}) OVER (ORDER BY date))::BIGINT AS {c}_running" for c in ("baseline", "used", "saved")) + " FROM g")
def w7_cumulative_savings(spark, d):
    return A.cumulative_savings(activity(spark, d))


@query("WITH c AS (SELECT conv_id AS task_id, 'r' || (conv_id % 5) AS repo_id, sum(ceil(length(text) / 4.0))::BIGINT AS used FROM conversations GROUP BY 1, 2), r AS (SELECT 'r' || (doc_id % 5) AS repo_id, ceil(sum(len(string_split(text, chr(10)))) * 40 / 4.0)::BIGINT AS baseline FROM documents GROUP BY 1) SELECT task_id, repo_id, baseline, used, greatest(0, baseline - used) AS saved, round(greatest(0, baseline - used)::DOUBLE / baseline * 100, 2) AS percent FROM c JOIN r USING (repo_id)")
def a22_savings_report(spark, d):
    c = read(spark, d, "conversations").select(F.col("conv_id").alias("task_id"), F.concat(F.lit("r"), (F.col("conv_id") % 5).cast("string")).alias("repo_id"), S.estimate_tokens(F.col("text")).alias("used_tokens"))
    r = read(spark, d, "documents").groupBy(F.concat(F.lit("r"), (F.col("doc_id") % 5).cast("string")).alias("repo_id")).agg(F.sum(F.size(F.split("text", "\n", -1))).alias("lines"))
    return A.savings_report(c, r)


@query("SELECT item_id AS task_id, 'm' AS mode, avg(contains(lower(text), term)::INTEGER) AS coverage, CASE WHEN avg(contains(lower(text), term)::INTEGER) = 1 THEN 2 WHEN avg(contains(lower(text), term)::INTEGER) > 0 THEN 1 ELSE 0 END AS points FROM benchmark, (VALUES ('the'), ('que'), ('en'), ('wh')) AS t(term) GROUP BY item_id")
def a23_score_answers(spark, d):
    b = read(spark, d, "benchmark")
    expected = b.select(F.col("item_id").alias("task_id"), F.explode(F.array(*[F.lit(t) for t in ("the", "que", "en", "wh")])).alias("term"))
    return A.score_answers(b.select(F.col("item_id").alias("task_id"), F.lit("m").alias("mode"), "text"), expected)


@query("""WITH s AS (SELECT o_custkey AS task_id, CASE WHEN o_orderkey % 2 = 0 THEN 'baseline' ELSE 'treatment' END AS mode, o_orderkey % 1000 AS i, o_orderkey % 300 AS o, (o_orderkey % 7) / 100.0 AS c FROM orders
), r AS (SELECT task_id, mode, sum(i + o)::BIGINT AS total, round(sum(c)::DOUBLE, 6) AS cost, count(*) AS steps FROM s GROUP BY 1, 2
) SELECT task_id, b.total AS base_total, u.total AS used_total, b.cost AS base_cost, u.cost AS used_cost, b.steps AS base_steps, u.steps AS used_steps, greatest(0, b.total - u.total) AS saved, CASE WHEN b.total = 0 THEN 0 ELSE round(greatest(0, b.total - u.total)::DOUBLE / b.total * 100, 2) END::DOUBLE AS percent
FROM (SELECT * FROM r WHERE mode = 'baseline') b JOIN (SELECT * FROM r WHERE mode = 'treatment') u USING (task_id)""")
def a24_rollup_run_steps(spark, d):
    k = F.col("o_orderkey")
    event = F.to_json(F.struct((k % 1000).alias("input"), (k % 300).alias("output"), ((k % 7) / 100).alias("cost")))
    return A.rollup_run_steps(read(spark, d, "orders").select(F.col("o_custkey").alias("task_id"), F.when(k % 2 == 0, "baseline").otherwise("treatment").alias("mode"), event.alias("event")))


@query(f"""WITH {FILES}, l AS (SELECT repo_id, language, count(*) AS n FROM files WHERE language IS NOT NULL GROUP BY 1, 2
) SELECT repo_id, count(*) AS n_files, (SELECT string_agg(language || ' ' || n, ', ' ORDER BY language) FROM l WHERE l.repo_id = f.repo_id) AS languages, max(doc_id % 1000) AS saved_at, 'about ' || repo_id AS overview FROM files f GROUP BY repo_id""")
def a7_overview_details(spark, d):
    f = files(spark, d)
    saved = read(spark, d, "documents").select(F.concat(F.lit("r"), (F.col("doc_id") % 4).cast("string")).alias("repo_id"), (F.col("doc_id") % 1000).alias("saved_at"))
    about = f.select("repo_id").distinct().withColumn("overview", F.concat(F.lit("about "), "repo_id"))
    out = C.project_overview({"files": f}, saved, about)
    return out.withColumn("languages", F.array_join(F.transform(F.map_entries("languages"), lambda x: F.concat_ws(" ", x["key"], x["value"].cast("string"))), ", "))


@query(f"""WITH {FILES}, {_DIRS}, sym AS (SELECT path, 'w' || (doc_id % 7 + k) AS name FROM files, range(0, 3) r(k) WHERE k < doc_id % 4
), c AS (SELECT d, x.path, count(name) AS n FROM dirs x LEFT JOIN sym USING (path) GROUP BY 1, 2
), t AS (SELECT d, string_agg(path, ',' ORDER BY n DESC, path) AS top_files FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY d ORDER BY n DESC, path) <= 3) GROUP BY 1
), m AS (SELECT d, name, count(*) AS n FROM dirs JOIN sym USING (path) GROUP BY 1, 2
), w AS (SELECT d, string_agg(name, ',' ORDER BY n DESC, name) AS top_names FROM (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY d ORDER BY n DESC, name) <= 3) GROUP BY 1)
SELECT d AS dir, top_files, top_names, CASE WHEN contains(d, '/') THEN 'folder ' || d END AS overview FROM t LEFT JOIN w USING (d)""")
def a8_module_tops(spark, d):
    f = files(spark, d)
    i = F.regexp_extract("path", r"/f(\d+)", 1).cast("long")
    sym = f.select("path", i.alias("i"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")).where("k < i % 4").select("path", F.concat(F.lit("w"), (F.col("i") % 7 + F.col("k")).cast("string")).alias("name"))
    mods = C.folder_modules(f).select(F.col("path").alias("dir"))
    about = mods.where(F.contains("dir", F.lit("/"))).select(F.col("dir").alias("target"), F.concat(F.lit("folder "), "dir").alias("overview"))
    return C.top_of_modules(f, sym, mods, about).select("dir", F.array_join("top_files", ",").alias("top_files"), F.array_join("top_names", ",").alias("top_names"), "overview")


@query("""WITH w AS (SELECT item_id AS task_id, string_split(text, ' ') AS w FROM benchmark), e AS (SELECT DISTINCT task_id, unnest(w[1:4]) AS term FROM w
), a AS (SELECT task_id, 'baseline' AS mode, array_to_string(w[1:2], ' ') AS text FROM w UNION ALL SELECT task_id, 'treatment', CASE WHEN task_id % 3 <> 0 THEN array_to_string(w, ' ') END FROM w
), s AS (SELECT task_id, mode, avg(coalesce(contains(lower(text), lower(term)), false)::INTEGER) AS coverage, bool_and(text IS NULL) AS failed FROM a JOIN e USING (task_id) GROUP BY 1, 2
), p AS (SELECT task_id, mode, coverage, CASE WHEN failed THEN -1 WHEN coverage = 1 THEN 2 WHEN coverage > 0 THEN 1 ELSE 0 END AS points FROM s
), r AS (SELECT task_id, max(points) FILTER (mode = 'baseline') AS bp, max(coverage) FILTER (mode = 'baseline') AS bc, max(points) FILTER (mode = 'treatment') AS tp, max(coverage) FILTER (mode = 'treatment') AS tc FROM p GROUP BY 1)
SELECT task_id::VARCHAR AS task_id, bp AS baseline_points, round(bc, 6) AS baseline_coverage, tp AS treatment_points, round(tc, 6) AS treatment_coverage, CASE WHEN bp > tp THEN 'baseline' WHEN tp > bp THEN 'treatment' ELSE 'tie' END AS winner FROM r
UNION ALL SELECT 'all', sum(bp)::INTEGER, round(avg(bc), 6), sum(tp)::INTEGER, round(avg(tc), 6), 'all' FROM r""")
def a23_answer_totals(spark, d):
    """Expected terms are each item's first words; one mode answers with half of them, the other with all or fails."""
    w = read(spark, d, "benchmark").select(F.col("item_id").alias("task_id"), F.split("text", " ").alias("w"))
    expected = w.select("task_id", F.explode(F.slice("w", 1, 4)).alias("term")).distinct()
    base = w.select("task_id", F.lit("baseline").alias("mode"), F.array_join(F.slice("w", 1, 2), " ").alias("text"))
    other = w.select("task_id", F.lit("treatment").alias("mode"), F.when(F.col("task_id") % 3 != 0, F.array_join("w", " ")).alias("text"))
    out = A.answer_totals(A.score_answers(base.unionByName(other), expected), ["baseline", "treatment"])
    return out.select(F.coalesce(F.col("task_id").cast("string"), F.lit("all")).alias("task_id"), "baseline_points", F.round("baseline_coverage", 6).alias("baseline_coverage"), "treatment_points", F.round("treatment_coverage", 6).alias("treatment_coverage"), "winner")


@query("""WITH s AS (SELECT o_custkey AS task_id, CASE WHEN o_orderkey % 2 = 0 THEN 'baseline' ELSE 'treatment' END AS mode, o_orderkey AS k, o_orderdate::TIMESTAMP + to_seconds(o_orderkey % 3600) AS moment FROM orders
), t AS (SELECT *, epoch(lead(moment) OVER (PARTITION BY task_id, mode ORDER BY moment, k)) - epoch(moment) AS took FROM s)
SELECT task_id, mode, sum(k % 1000)::BIGINT AS input, sum(k % 300)::BIGINT AS output, sum(CASE WHEN k % 3 = 0 THEN k % 50 ELSE 0 END)::BIGINT AS reasoning, sum(k % 70)::BIGINT AS cache_read, 0::BIGINT AS cache_write,
round(sum((k % 7) / 100.0)::DOUBLE, 6) AS cost, count(*) AS steps, round(avg(took), 3) AS mean_seconds, max(took)::DOUBLE AS longest_seconds FROM t GROUP BY 1, 2""")
def a24_run_step_details(spark, d):
    k = F.col("o_orderkey")
    event = F.to_json(F.struct((k % 1000).alias("input"), (k % 300).alias("output"), F.when(k % 3 == 0, k % 50).alias("reasoning"), (k % 70).alias("cache_read"), ((k % 7) / 100).alias("cost"), k.alias("k")))
    at = F.timestamp_seconds(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + k % 3600)
    steps = read(spark, d, "orders").select(F.col("o_custkey").alias("task_id"), F.when(k % 2 == 0, "baseline").otherwise("treatment").alias("mode"), at.alias("at"), event.alias("event"))
    return A.run_step_details(steps)
