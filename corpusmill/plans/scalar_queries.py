"""Queries of the column functions and filters over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import scalars as S
from ..operators import filters as P
from .tables import FILES, files, path_expr, read

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_NAME = "regexp_extract(path, '[^/\\\\]*$')"


@query(f"WITH {FILES} SELECT repo_id, path, language, size_bytes FROM files")
def s3_corpus_from_table(spark, d):
    return files(spark, d).select("repo_id", "path", "language", "size_bytes")


@query(f"WITH {FILES} SELECT path, nullif(lower(regexp_extract({_NAME}, '^.+\\.([^.]+)$', 1)), '') AS extension, language, {_NAME} AS name, lower(replace(path, '\\', '/')) AS normal FROM files")
def f1_f4_path_parts(spark, d):
    p = F.col("path")
    return files(spark, d).select("path", S.extension_of(p).alias("extension"), S.detect_language(p).alias("language"), S.basename(p).alias("name"), S.normalize_text(p).alias("normal"))


@query(
    "SELECT doc_id, ['a/b/x.ts', '/root/k.ts', 'm.ts', 'a/b/c/d.ts'][doc_id % 4 + 1] AS from_file, ['./u', '../v/./w', '../../../z', 'q/../r'][(doc_id // 4) % 4 + 1] AS spec, "
    "[['a/b/u', '/root/u', 'u', 'a/b/c/u'], ['a/v/w', '/v/w', 'v/w', 'a/b/v/w'], ['z', '/z', 'z', 'z'], ['a/b/r', '/root/r', 'r', 'a/b/c/r']][(doc_id // 4) % 4 + 1][doc_id % 4 + 1] AS resolved FROM documents"
)
def f5_resolve_relative(spark, d):
    i = F.col("doc_id")
    pick = lambda xs, k: F.element_at(F.array(*[F.lit(x) for x in xs]), (k % 4 + 1).cast("int"))
    df = read(spark, d, "documents").select("doc_id", pick(["a/b/x.ts", "/root/k.ts", "m.ts", "a/b/c/d.ts"], i).alias("from_file"), pick(["./u", "../v/./w", "../../../z", "q/../r"], F.floor(i / 4)).alias("spec"))
    return df.withColumn("resolved", S.resolve_relative(F.col("from_file"), F.col("spec")))


@query(f"WITH {FILES} SELECT path, unnest([0, 1, 2, 3, 4]) AS pos, path || unnest(['', '.ts', '.tsx', '/index.ts', '/index.tsx']) AS candidate FROM files")
def f6_module_candidates(spark, d):
    return files(spark, d).select("path", F.posexplode(S.module_candidates(F.col("path"))).alias("pos", "candidate"))


@query("SELECT doc_id, sha256(text) AS hash, sha256('salt' || text) AS anonymous FROM documents")
def f7_f30_hashes(spark, d):
    return read(spark, d, "documents").select("doc_id", S.content_hash(F.col("text")).alias("hash"), S.anonymize_ref(F.col("text"), "salt").alias("anonymous"))


@query("SELECT conv_id, turn, ceil(length(text) / 4.0)::BIGINT AS tokens, ceil((turn + 1) * 40 / 4.0)::BIGINT AS baseline FROM conversations")
def f8_f9_estimate_tokens(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", S.estimate_tokens(F.col("text")).alias("tokens"), S.estimate_baseline_tokens(F.col("turn") + 1).alias("baseline"))


@query("SELECT event_id, greatest(0, a - b) AS saved, CASE WHEN a = 0 THEN 0 ELSE round(greatest(0, a - b)::DOUBLE / a * 100, 2) END::DOUBLE AS percent FROM (SELECT event_id, event_id % 1000 AS a, event_id % 700 AS b FROM events)")
def f10_calculate_savings(spark, d):
    e = read(spark, d, "events").select("event_id", (F.col("event_id") % 1000).alias("a"), (F.col("event_id") % 700).alias("b"))
    return e.select("event_id", S.calculate_savings(F.col("a"), F.col("b")).alias("s")).select("event_id", "s.saved", "s.percent")


_STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)
TERMS = "list_filter(list_transform(regexp_split_to_array(" + _STRIP.format("lower({})") + ", '\\s+'), lambda w: regexp_replace(w, '^[^\\w]+|[^\\w]+$', '', 'g')), lambda w: length(w) >= 2 AND NOT list_contains([" + _STOP + "], w))"


@query("SELECT item_id, " + TERMS.format("text") + " AS terms FROM benchmark")
def f11_query_terms(spark, d):
    return read(spark, d, "benchmark").select("item_id", S.query_terms(F.col("text")).alias("terms"))


_LIMIT = "CASE WHEN {0} <= 1 THEN 0 WHEN {0} <= 4 THEN 1 WHEN {0} <= 8 THEN 2 ELSE ceil({0} / 4.0) END::INTEGER"


@query(
    "SELECT p_partkey, a, b, dist, " + _LIMIT.format("length(a)") + " AS threshold, 1 - dist::DOUBLE / greatest(length(a), length(b)) AS sim, dist <= " + _LIMIT.format("length(a)") + " AS fuzzy, "
    "list_contains(string_split(b, ' '), 'widget') AS token FROM (SELECT *, levenshtein(a, b)::INTEGER AS dist FROM (SELECT p_partkey, lower(p_name) AS a, lower(coalesce(lead(p_name) OVER (ORDER BY p_partkey), p_name)) AS b FROM part))"
)
def f12_f16_fuzzy_functions(spark, d):
    parts = read(spark, d, "part").select("p_partkey", F.lower("p_name").alias("a"))
    after = read(spark, d, "part").select((F.col("p_partkey") - 1).alias("p_partkey"), F.lower("p_name").alias("b"))
    j = parts.join(after, "p_partkey", "left").withColumn("b", F.coalesce("b", "a"))
    a, b = F.col("a"), F.col("b")
    return j.select("p_partkey", "a", "b", S.edit_distance(a, b).alias("dist"), S.fuzzy_threshold(F.length(a)).alias("threshold"), S.similarity(a, b).alias("sim"), S.is_fuzzy_match(a, b).alias("fuzzy"), S.is_token_match(F.lit("widget"), b).alias("token"))


_CUT = "CASE WHEN length(text) <= 12000 THEN text ELSE substr(text, 1, 12000) || chr(10) || '… (truncated)' END"


@query(
    "SELECT doc_id, CASE WHEN t = '' THEN NULL WHEN length(t) > 140 THEN regexp_replace(substr(t, 1, 139), '\\s+$', '') || '…' ELSE t END AS snippet, " + _CUT + " AS cut, "
    "CASE WHEN long THEN c ELSE text END AS content, ceil(length(CASE WHEN long THEN c ELSE text END) / 4.0)::BIGINT AS tokens, long AS truncated "
    "FROM (SELECT *, " + _STRIP.format("text") + " AS t, ceil(length(text) / 4.0) > 2000 AS long, regexp_replace(substr(text, 1, 8000), '\\s+$', '') || chr(10) || '… [truncated]' AS c FROM documents)"
)
def f17_f19_text_cuts(spark, d):
    t = F.col("text")
    return read(spark, d, "documents").select("doc_id", S.make_snippet(t).alias("snippet"), S.truncate_content(t).alias("cut"), S.truncate_to_tokens(t).alias("x")).select("doc_id", "snippet", "cut", "x.*")


@query("SELECT p_partkey, 'Part ' || p_name || ' of ' || p_brand || ' is {unknown}; ' || p_name || '.' AS text FROM part")
def f20_render_template(spark, d):
    return read(spark, d, "part").select("p_partkey", S.render_template("Part {name} of {brand} is {unknown}; {name}.", {"name": F.col("p_name"), "brand": F.col("p_brand")}).alias("text"))


@query("""SELECT event_id, CASE WHEN event_id % 6 < 2 THEN event_type END AS overview, CASE WHEN event_id % 6 < 2 THEN ['a', event_id::VARCHAR] END AS key_points,
CASE event_id % 6 WHEN 2 THEN 'model output was not valid JSON' WHEN 3 THEN 'model output was not a JSON object' WHEN 4 THEN 'missing string field "overview"' WHEN 5 THEN '"keyPoints" must be an array of strings' END AS error FROM events""")
def f21_parse_summary_json(spark, d):
    """Events as model answers: good ones, fenced ones, and each kind of bad one."""
    i = F.col("event_id")
    name = F.col("event_type")
    good = F.concat(F.lit('{"overview": "'), name, F.lit('", "keyPoints": ["a", "'), i.cast("string"), F.lit('"]}'))
    raw = (
        F.when(i % 6 == 0, good).when(i % 6 == 1, F.concat(F.lit("```json\n"), good, F.lit("\n```"))).when(i % 6 == 2, F.concat(F.lit("{broken "), name))
        .when(i % 6 == 3, F.lit("[1, 2]")).when(i % 6 == 4, F.lit('{"overview": 5}')).otherwise(F.lit('{"overview": "x", "keyPoints": [1]}'))
    )
    return read(spark, d, "events").select("event_id", S.parse_summary_json(raw).alias("s")).select("event_id", "s.*")


@query(
    "SELECT p_partkey, p_size // 10 AS major, p_size % 10 AS minor, 0 AS patch, (p_size // 10 >= 2) AS at_least_2, (p_size // 10 = 3 AND p_size % 10 >= 1) AS caret_31, "
    "(p_size // 10 = 1 AND p_size % 10 = 2) OR p_size // 10 >= 4 AS tilde_or, false AS junk FROM part"
)
def f22_f23_versions(spark, d):
    v = F.concat(F.lit("python v"), F.floor(F.col("p_size") / 10).cast("string"), F.lit("."), (F.col("p_size") % 10).cast("string"))
    sat = lambda r: S.satisfies_range(v, F.lit(r))
    return read(spark, d, "part").select("p_partkey", S.extract_version(v).alias("e"), sat(">=2.0").alias("at_least_2"), sat("^3.1").alias("caret_31"), sat("~1.2 || >=4").alias("tilde_or"), sat(">=1.0.0-alpha").alias("junk")).select("p_partkey", "e.*", "at_least_2", "caret_31", "tilde_or", "junk")


@query(f"WITH {FILES} SELECT path, path = 'src0' OR path LIKE 'src0/%' AS under, path LIKE 'src1/d3/%' AS under_dir, path || '#main@3:7' AS symbol, 'n:' || path || '#main@3:7' AS symbol_node, 'n:file:' || path AS node FROM files")
def f24_f25_identifiers(spark, d):
    p = F.col("path")
    sym = S.symbol_id(p, F.lit("main"), F.lit(3), F.lit(7))
    return files(spark, d).select("path", S.is_under(p, F.lit("src0")).alias("under"), S.is_under(p, F.lit("src1\\d3/")).alias("under_dir"), sym.alias("symbol"), S.symbol_node_id(sym).alias("symbol_node"), S.file_node_id(p).alias("node"))


@query("""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1) || '|\\n+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS s FROM documents)
SELECT doc_id, unnest(range(0, len(s)))::INTEGER AS pos, unnest(s) AS sentence FROM l""")
def f26_split_sentences(spark, d):
    return read(spark, d, "documents").select("doc_id", F.posexplode(S.split_sentences(F.col("text"))).alias("pos", "sentence"))


_NEG, _POS = "|".join(X.NEGATIVE_MARKERS), "|".join(X.POSITIVE_MARKERS)
_STATEMENT_SQL = "SELECT o_orderkey, 'The `' || o_orderpriority || '` of Order' || (o_custkey % 50) || CASE o_orderkey % 4 WHEN 0 THEN ' is broken' WHEN 1 THEN ' works and is Safe' WHEN 2 THEN ' has no issue' ELSE ' was seen' END AS s FROM orders"


def _statements(spark, d):
    k = F.col("o_orderkey") % 4
    tail = F.when(k == 0, " is broken").when(k == 1, " works and is Safe").when(k == 2, " has no issue").otherwise(" was seen")
    return read(spark, d, "orders").select("o_orderkey", "o_custkey", F.concat(F.lit("The `"), "o_orderpriority", F.lit("` of Order"), (F.col("o_custkey") % 50).cast("string"), tail).alias("s"))


@query(
    "SELECT o_orderkey, CASE WHEN neg AND bad THEN 'positive' WHEN bad AND NOT good THEN 'negative' WHEN good AND NOT bad THEN 'positive' ELSE 'neutral' END AS polarity, "
    "list_filter(list_transform(regexp_extract_all(s, '[`\"'']([^`\"''\\n]{1,60})[`\"'']', 1), lambda t: trim(t)), lambda t: t <> '') || regexp_extract_all(s, '\\b[A-Z][A-Za-z0-9_]{1,60}\\b') AS topics "
    f"FROM (SELECT *, regexp_matches(lower(s), '\\b(?:not|no|never|hardly|no longer|isn''?t|doesn''?t|won''?t)\\b') AS neg, regexp_matches(lower(s), '{_NEG}') AS bad, regexp_matches(lower(s), '{_POS}') AS good FROM ({_STATEMENT_SQL}))"
)
def f27_f28_polarity_topics(spark, d):
    # the statement's own words hold no topic twice but for quoted capital words, which both sides keep apart
    s = F.col("s")
    return _statements(spark, d).select("o_orderkey", S.polarity(s).alias("polarity"), S.topics(s).alias("topics"))


@query("SELECT doc_id, array_to_string(list_slice(l, greatest(1, 2 - 1), least(len(l), 3 + 1)), chr(10)) AS lines FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)")
def f29_line_range(spark, d):
    return read(spark, d, "documents").select("doc_id", S.line_range(F.col("text"), F.lit(2), F.lit(3), 1).alias("lines"))


_IGNORED_SQL = "path NOT LIKE 'src3/%' AND path NOT LIKE '%/d7/%'"


@query(f"WITH {FILES} SELECT path FROM files WHERE {_IGNORED_SQL}")
def p1_drop_ignored_dirs(spark, d):
    return P.drop_ignored_dirs(files(spark, d).select("path"), ["SRC3", "d7"], max_depth=2)


@query(f"""WITH {FILES}, n AS (SELECT path, split_part(path, '/', 1) AS a, split_part(path, '/', 2) AS b, split_part(path, '/', 3) AS c FROM files)
SELECT path FROM n WHERE a <> 'src3' AND NOT (a = 'src4' AND starts_with(b, 'd1')) AND NOT (a = 'src5' AND b = 'd2') AND (c NOT LIKE '%.PY') AND NOT (a = 'src5' AND c LIKE '%.ts' AND NOT regexp_matches(c, '^f1.5\\.ts$'))""")
def p2_apply_ignore_rules(spark, d):
    rules = P.parse_rules(spark, {"": "# rules\n*.PY\n!keep.PY\nsrc3/\n/src4/d1*\n", "src5": "d2/\n*.ts\n!f1?5.ts\n"})
    return P.apply_ignore_rules(files(spark, d).select("path"), rules)


_DENY_NAMES = [".env.local", "server.pem", "id_rsa", "notes.txt", "Secrets", "app.KEY", ".ssh"]


def _named(spark, d):
    i = F.col("event_id")
    names = F.element_at(F.array(*[F.lit(n) for n in _DENY_NAMES]), (i % 7 + 1).cast("int"))
    return read(spark, d, "events").select("event_id", F.concat(F.lit("a/"), names).alias("path"), F.concat(F.lit("token = "), F.when(i % 3 == 0, F.lit("your-key-goes-here")).when(i % 3 == 1, F.concat(F.lit("q8Zr31LmW0"), i.cast("string"))).otherwise(F.lit("none"))).alias("content"))


_NAMED_SQL = "named AS (SELECT event_id, [" + ", ".join(f"'{n}'" for n in _DENY_NAMES) + "][event_id % 7 + 1] AS name, 'a/' || name AS path, 'token = ' || CASE event_id % 3 WHEN 0 THEN 'your-key-goes-here' WHEN 1 THEN 'q8Zr31LmW0' || event_id ELSE 'none' END AS content FROM events)"
_DENIED_SQL = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(name, '{p}') THEN '{n}' END" for n, p in X.DENIED_NAMES) + "], lambda x: x IS NOT NULL)"


@query(f"WITH {_NAMED_SQL} SELECT event_id, {_DENIED_SQL} AS patterns FROM named")
def p3_deny_path(spark, d):
    return _named(spark, d).select("event_id", P.deny_path(F.col("path")).alias("patterns"))


_VALUES = "regexp_extract_all({}, '" + X.INLINE_CREDENTIAL.replace("'", "''") + "', 1)"
_CONTENT_SQL = (
    "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({{0}}, '{p}') THEN '{n}' END" for n, p in X.DENIED_CONTENT).replace("{16}", "{{16}}").replace("{35}", "{{35}}").replace("{20,}", "{{20,}}").replace("{36}", "{{36}}").replace("{30,}", "{{30,}}").replace("{10,}", "{{10,}}")
    + f", CASE WHEN len(list_filter({_VALUES.format('{0}')}, lambda v: length(v) >= 12 AND NOT regexp_matches(v, '{X.INLINE_PLACEHOLDER}') AND NOT regexp_matches(v, '{X.INLINE_LITERAL}'))) > 0 THEN '{X.INLINE_NAME}' END], lambda x: x IS NOT NULL)"
)


@query("SELECT doc_id, " + _CONTENT_SQL.format("text") + " AS patterns FROM documents")
def p4_deny_content(spark, d):
    return read(spark, d, "documents").select("doc_id", P.deny_content(F.col("text")).alias("patterns"))


@query(
    f"WITH {_NAMED_SQL}, n AS (SELECT event_id, {_DENIED_SQL} AS path_patterns, content FROM named), c AS (SELECT *, CASE WHEN len(path_patterns) > 0 THEN [] ELSE " + _CONTENT_SQL.format("content") + " END AS content_patterns FROM n) "
    "SELECT event_id, path_patterns, content_patterns, len(path_patterns) = 0 AND len(content_patterns) = 0 AS accepted FROM c"
)
def p5_deny_filter(spark, d):
    return P.deny_filter(_named(spark, d)).select("event_id", "path_patterns", "content_patterns", "accepted")
