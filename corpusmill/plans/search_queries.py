"""Queries of search, context packages, graphs, extraction, policy and streams over the given tables."""

from __future__ import annotations

import datetime
import uuid
from contextlib import contextmanager

from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import scalars as S
from ..operators import context as K
from ..operators import extract as E
from ..operators import filters as P
from ..operators import graph as G
from ..operators import index as I
from ..operators import policy as L
from ..operators import scan as C
from ..operators import search as R
from ..operators import snapshots as N
from ..operators.stored import shared_folder, stored
from ..sources import corpus
from ..streaming import streams as ST
from .scalar_queries import _CONTENT_SQL, _DENIED_SQL, _NEG, _POS, _STATEMENT_SQL, TERMS
from .tables import EDGES, FILES, IMPORTS, REFS, SYMBOLS, edges, files, imports, order_files, read, refs, snapshots, symbols

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- joins of code tables ---


@query(f"WITH {IMPORTS} SELECT import_id, specifier, target FROM resolved")
def j4_resolve_imports(spark, d):
    return G.resolve_imports(imports(spark, d), order_files(spark, d)).select("import_id", "specifier", "target")


@query(f"WITH {SYMBOLS}, {IMPORTS} SELECT import_id, s.id AS symbol_id FROM resolved r JOIN symbols s ON s.path = r.target AND s.name = CASE WHEN o_key % 3 = 0 THEN 'part' || (o_key % 2000) ELSE r.name END, (SELECT 1) WHERE s.exported".replace("resolved r JOIN", "(SELECT *, import_id::BIGINT AS o_key FROM resolved) r JOIN"))
def j5_link_definitions(spark, d):
    r = G.resolve_imports(imports(spark, d), order_files(spark, d))
    k = F.col("import_id").cast("long")
    named = r.withColumn("imported_name", F.when(k % 3 == 0, F.concat(F.lit("part"), (k % 2000).cast("string"))))
    exports = symbols(spark, d).where("exported").select("path", "name", F.expr("cast(array() as array<string>)").alias("modifiers"), F.col("id").alias("symbol_id"))
    return G.link_definitions(named, exports)


_RESOLVE = f"""WITH {SYMBOLS}, {REFS}, box AS (
  SELECT ref_id, arg_min(s.id, (s.start_line, s.start_col, s.id)) AS parent_id FROM refs r JOIN symbols s ON s.path = r.path AND s.kind IN ('class', 'interface', 'enum') AND r.line BETWEEN s.start_line AND s.end_line GROUP BY ref_id
), m AS (SELECT parent_id, name, arg_min(id, (start_line, start_col, id)) AS member FROM symbols WHERE parent_id IS NOT NULL GROUP BY 1, 2
), t AS (SELECT path, name, arg_min(id, (start_line, start_col, id)) AS top_id FROM symbols WHERE parent_id IS NULL GROUP BY 1, 2
) SELECT * FROM (SELECT r.ref_id, coalesce(m.member, t.top_id) AS target FROM refs r LEFT JOIN box USING (ref_id) LEFT JOIN m ON m.parent_id = box.parent_id AND m.name = r.name LEFT JOIN t ON t.path = r.path AND t.name = r.name) WHERE target IS NOT NULL"""


@query(_RESOLVE)
def j6_resolve_references(spark, d):
    return G.resolve_references(refs(spark, d), symbols(spark, d))


def _symbol_edges(spark, d):
    s = symbols(spark, d)
    return s.select(S.file_node_id(F.col("path")).alias("src"), S.symbol_node_id(F.col("id")).alias("dst"), F.lit("contains").alias("kind"))


@query(f"WITH {SYMBOLS} SELECT 'n:file:' || s.path AS src, 'n:' || s.id AS dst, 'contains' AS kind, coalesce(f.path, 'n:file:' || s.path) AS src_label, s.name || ' (' || s.path || ')' AS dst_label FROM symbols s LEFT JOIN (SELECT 'src/o' || o_orderkey || '.ts' AS path FROM orders WHERE o_orderstatus <> 'P') f USING (path)")
def j7_label_edges(spark, d):
    known = read(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.concat(F.lit("src/o"), F.col("o_orderkey").cast("string"), F.lit(".ts")).alias("path"))
    return G.label_edges(_symbol_edges(spark, d), known, symbols(spark, d).dropDuplicates(["id"]))


@query(f"WITH {SYMBOLS} SELECT * EXCLUDE (n) FROM (SELECT path, name, id, row_number() OVER (PARTITION BY path, name ORDER BY start_line, start_col, id) AS n FROM symbols) WHERE n = 1")
def w3_first_symbol_wins(spark, d):
    return G.first_symbol_wins(symbols(spark, d)).select("path", "name", "id")


@query(f"WITH {IMPORTS} SELECT path FROM order_files WHERE path NOT IN (SELECT target FROM resolved WHERE target IS NOT NULL)")
def j13_dead_files(spark, d):
    r = G.resolve_imports(imports(spark, d), order_files(spark, d)).where("target is not null")
    e = r.select(S.file_node_id(F.col("from_path")).alias("src"), S.file_node_id(F.col("target")).alias("dst"), F.lit("imports").alias("kind"))
    return G.dead_files(order_files(spark, d), e)


@query(f"WITH {SYMBOLS} SELECT name, count(DISTINCT path) AS files, count(*) AS symbols FROM symbols GROUP BY name HAVING count(DISTINCT path) > 1")
def j14_duplicate_names(spark, d):
    return G.duplicate_names(symbols(spark, d, small_parts=True))


@query(f"WITH {FILES} SELECT path, sha256(content) AS hash, count(*) OVER (PARTITION BY sha256(content)) AS copies FROM files QUALIFY copies > 1")
def j14_duplicate_content(spark, d):
    return G.duplicate_content(files(spark, d))


@query("SELECT doc_id AS request_id, doc_id % 3 <> 0 AS version_match, doc_id % 3 = 0 AS stale, CASE WHEN doc_id % 3 = 0 THEN 'file changed since it was indexed' END AS message, array_to_string(list_slice(string_split(text, chr(10)), 1, 5), chr(10)) AS lines FROM documents")
def j15_stale_range_reads(spark, d):
    docs = read(spark, d, "documents")
    from .tables import path_expr

    r = docs.select(F.col("doc_id").alias("request_id"), path_expr().alias("path"), F.lit(2).alias("start"), F.lit(3).alias("end"), S.content_hash(F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("expected_hash"))
    return K.stale_range_reads(r, files(spark, d))


@query(f"WITH {SYMBOLS} SELECT p_partkey AS request_id, s.id FROM part JOIN symbols s ON s.name = 'part' || p_partkey AND (p_size % 2 = 0 OR s.kind = 'class')")
def j17_find_symbols(spark, d):
    r = read(spark, d, "part").select(F.col("p_partkey").alias("request_id"), F.concat(F.lit("part"), F.col("p_partkey").cast("string")).alias("name"), F.when(F.col("p_size") % 2 == 1, "class").alias("kind"), F.lit(None).cast("string").alias("path"))
    return R.find_symbols(r, symbols(spark, d)).select("request_id", "id")


@query("SELECT o_orderkey AS request_id, o_custkey::VARCHAR AS target, CASE WHEN c_custkey IS NOT NULL THEN 'file' END AS summary_kind, c_custkey IS NOT NULL AS found, c_mktsegment AS overview FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 4 <> 0) ON c_custkey = o_custkey")
def j18_lookup_summaries(spark, d):
    s = read(spark, d, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").cast("string").alias("target"), F.lit("file").alias("kind"), F.col("c_mktsegment").alias("overview"))
    r = read(spark, d, "orders").select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").cast("string").alias("target"), F.when(F.col("o_orderkey") % 2 == 0, "file").alias("kind"))
    return R.lookup_summaries(r, s)


@query("SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '00012') OR contains(lower(c_mktsegment), '00012')")
def p8_like_search(spark, d):
    return P.like_search(read(spark, d, "customer"), " 00012 ", ["c_name", "c_mktsegment"]).select("c_custkey", "c_name")


# --- search ---

_WORDS = "list_filter(string_split_regex({}, '[^a-z0-9_]+'), lambda t: t <> '')"
ENTITIES = f"""{FILES}, entities AS (
  SELECT 'file' AS kind, path AS key, NULL AS def_kind, regexp_extract(path, '[^/\\\\]*$') AS name, path, content AS body FROM files
  UNION ALL SELECT 'symbol', 'symbol:' || p_partkey, ['class', 'import', 'enum-member', 'type-alias', 'export', 'method'][p_partkey % 6 + 1], replace(p_name, ' ', '_') || '_' || p_partkey, 'parts/' || p_brand, '' FROM part
), ent AS (SELECT *, lower(replace(name || chr(10) || path || chr(10) || body, '\\', '/')) AS search_text FROM entities)"""


def _entities(spark, d):
    part = read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.concat_ws("_", F.translate("p_name", " ", "_"), F.col("p_partkey").cast("string")).alias("name"), F.concat(F.lit("parts/"), "p_brand").alias("path"), F.element_at(F.array(*[F.lit(k) for k in ("class", "import", "enum-member", "type-alias", "export", "method")]), (F.col("p_partkey") % 6 + 1).cast("int")).alias("kind"))
    return R.build_search_entities(files(spark, d), part)


@query(f"WITH {ENTITIES} SELECT kind, key, name, search_text, list_sort(list_distinct(list_transform({_WORDS.format('lower(name)')}, lambda t: length(t)::INTEGER))) AS widths FROM ent")
def u1_build_search_entities(spark, d):
    return _entities(spark, d).select("kind", "key", "name", "search_text", F.sort_array("identifier_lengths").alias("widths"))


@query(f"WITH {ENTITIES} SELECT token, key, list_contains({_WORDS.format('lower(name)')}, token) AS in_name FROM (SELECT key, name, unnest(list_distinct({_WORDS.format('search_text')})) AS token FROM ent)")
def r2_build_postings(spark, d):
    return R.build_postings(_entities(spark, d))


_FUZZY_LIMIT = "CASE WHEN length(term) <= 1 THEN 0 WHEN length(term) <= 4 THEN 1 WHEN length(term) <= 8 THEN 2 ELSE ceil(length(term) / 4.0) END"


@query(f"WITH t AS (SELECT DISTINCT unnest({_WORDS.format('lower(text)')}) AS term FROM benchmark), i AS (SELECT DISTINCT unnest({_WORDS.format('lower(p_name)')}) AS token FROM part UNION SELECT DISTINCT lower(c_mktsegment) FROM customer UNION SELECT DISTINCT unnest({_WORDS.format('lower(text)')}) FROM conversations) SELECT term, token, levenshtein(term, token)::INTEGER AS distance FROM t, i WHERE abs(length(term) - length(token)) <= {_FUZZY_LIMIT} AND levenshtein(term, token) <= {_FUZZY_LIMIT}")
def r3_fuzzy_join(spark, d):
    words = lambda df, c: df.select(F.explode(F.filter(F.split(F.lower(c), "[^a-z0-9_]+"), lambda t: t != "")).alias("token"))
    terms = words(read(spark, d, "benchmark"), "text").distinct().withColumnRenamed("token", "term")
    ids = words(read(spark, d, "part"), "p_name").union(read(spark, d, "customer").select(F.lower("c_mktsegment"))).union(words(read(spark, d, "conversations"), "text")).distinct()
    return R.fuzzy_join(terms, ids)


def _queries(spark, d):
    """By definition, each benchmark item asks for its third to fifth word, as a person would, and for a misspelt part."""
    words = F.split("text", " ")
    return read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat_ws(" ", F.array_join(F.slice(words, 3, 3), " "), F.when(F.col("item_id") % 3 == 0, "widgit").when(F.col("item_id") % 3 == 1, "smal")).alias("q"))


# every term against every entity: a term's words must stand inside words of the text, or a name's word be near it
_SEARCH = f"""WITH {ENTITIES}, q AS (
  SELECT item_id AS query_id, array_to_string(list_slice(string_split(text, ' '), 3, 5), ' ') || CASE item_id % 3 WHEN 0 THEN ' widgit' WHEN 1 THEN ' smal' ELSE '' END AS q FROM benchmark
), terms AS (SELECT query_id, unnest(list_distinct({TERMS.format('q')})) AS term FROM q
), tw AS (SELECT DISTINCT term, list_sort(list_transform({_WORDS.format('term')}, lambda x: [1000 - length(x), 0]))[1] AS o FROM terms
), vocab AS (SELECT DISTINCT unnest({_WORDS.format('search_text')}) AS token FROM ent), named AS (SELECT DISTINCT unnest({_WORDS.format('lower(name)')}) AS token FROM ent
), longest AS (SELECT DISTINCT term, list_filter({_WORDS.format('term')}, lambda x: length(x) = list_max(list_transform({_WORDS.format('term')}, lambda y: length(y))))[1] AS w FROM terms
), near AS (SELECT term, token, 1 - levenshtein(term, token)::DOUBLE / greatest(length(term), length(token)) AS sim FROM (SELECT DISTINCT term FROM terms), named WHERE abs(length(term) - length(token)) <= {_FUZZY_LIMIT} AND levenshtein(term, token) <= {_FUZZY_LIMIT}
), own AS (SELECT key, unnest(list_distinct({_WORDS.format('lower(name)')})) AS token FROM ent
), sims AS (SELECT term, key, max(sim) AS sim FROM near JOIN own USING (token) GROUP BY 1, 2
), holds AS (SELECT l.term, v.token FROM longest l JOIN vocab v ON contains(v.token, l.w)
), post AS (SELECT key, unnest(list_distinct({_WORDS.format('search_text')})) AS token FROM ent
), cand AS (SELECT DISTINCT term, key FROM holds JOIN post USING (token) UNION SELECT term, key FROM sims
), s AS (
  SELECT c.term, c.key, greatest(
    CASE WHEN lower(name) = c.term THEN 1.0 WHEN starts_with(lower(name), c.term) THEN 0.8 WHEN list_contains({_WORDS.format('lower(name)')}, c.term) THEN 0.6 WHEN contains(lower(name), c.term) THEN 0.4 ELSE 0 END::DOUBLE,
    CASE WHEN list_contains({_WORDS.format('search_text')}, c.term) THEN 0.3 WHEN contains(search_text, c.term) THEN 0.2 ELSE 0 END::DOUBLE, coalesce(sim * 0.3::DOUBLE, 0)) AS s
  FROM cand c JOIN ent USING (key) LEFT JOIN sims USING (term, key)
), total AS (SELECT query_id, key, round(sum(s) / any_value(n), 6) AS score FROM terms JOIN s USING (term) JOIN (SELECT query_id, count(*) AS n FROM terms GROUP BY 1) USING (query_id) WHERE s > 0 GROUP BY query_id, key
), hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, coalesce(def_kind NOT IN ('import', 'export'), false) DESC, kind, key)::INTEGER AS rank FROM total JOIN ent USING (key) QUALIFY rank <= 20)"""


_indexes: dict[tuple[str, str], I.Index] = {}


def _index(spark, d) -> I.Index:
    """The tables' entities, indexed once in an application."""
    at = (spark.sparkContext.applicationId, d)
    if at not in _indexes:
        _indexes[at] = I.build_index(_entities(spark, d), f"{shared_folder(spark)}/cm-index-{uuid.uuid4().hex}")
    return _indexes[at]


def _found(spark, d):
    """Entities that are searched once only need no stored index."""
    return R.search(_entities(spark, d), _queries(spark, d))


@query(_SEARCH + " SELECT query_id, rank, score, kind, key, path FROM hits")
def r1_r4_w1_search(spark, d):
    return _found(spark, d).select("query_id", "rank", "score", "kind", "key", "path")


@query(_SEARCH + " SELECT query_id, rank, score, key FROM hits")
def r4_lexical_score(spark, d):
    """The same scores from the texts of all candidates instead of postings."""
    return R.search(_entities(spark, d), _queries(spark, d), scorer=R.lexical_score).select("query_id", "rank", "score", "key")


@query(f"""WITH {ENTITIES}, s AS (SELECT 'part' AS query_id, key, kind, def_kind, length(name) % 5 / 4.0::DOUBLE AS score FROM ent WHERE kind = 'symbol' UNION ALL SELECT 'all', key, kind, def_kind, length(name) % 5 / 4.0::DOUBLE FROM ent)
SELECT query_id, key, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, coalesce(def_kind NOT IN ('import', 'export'), false) DESC, kind, key)::INTEGER AS rank FROM s WHERE score >= 0.5 QUALIFY rank <= 40""")
def w1_rank_hits(spark, d):
    e = _entities(spark, d).select("key", "kind", "def_kind", (F.length("name") % 5 / 4.0).alias("score"))
    scored = P.filter_kinds(e, ["symbol"]).withColumn("query_id", F.lit("part")).unionByName(e.withColumn("query_id", F.lit("all")))
    return R.rank_hits(P.min_score(scored, 0.5), 40).select("query_id", "key", "score", "rank")


@query(_SEARCH + " SELECT query_id, rank, score, kind, key FROM hits")
def r1_indexed_search(spark, d):
    """The same rows from the stored index, which later searches of the application share."""
    return I.search_index(_index(spark, d), _queries(spark, d)).select("query_id", "rank", "score", "kind", "key")


_PHRASES = _SEARCH.replace("), hits AS (", f"""), ph AS (SELECT query_id, {_WORDS.format('lower(trim(q))')} AS w FROM q WHERE query_id IN (SELECT query_id FROM terms)
), full_text AS (SELECT key, array_to_string({_WORDS.format('search_text')}, ' ') || ' ' AS t, array_to_string({_WORDS.format('lower(name)')}, ' ') || ' ' AS n FROM ent
), bonus AS (
  SELECT query_id, key, CASE WHEN n = p THEN 1.0 WHEN starts_with(n, p) THEN 0.8 WHEN contains(' ' || n, ' ' || p) THEN 0.6 ELSE 0.5 END::DOUBLE AS b
  FROM (SELECT query_id, array_to_string(w, ' ') || ' ' AS p FROM ph WHERE len(w) > 1) JOIN full_text ON contains(' ' || t, ' ' || p)
), better AS (SELECT query_id, key, greatest(coalesce(score, 0), coalesce(b, 0)) AS score FROM total FULL JOIN bonus USING (query_id, key)
), hits AS (""").replace("FROM total JOIN ent USING (key) QUALIFY", "FROM better JOIN ent USING (key) QUALIFY").replace(
    # half of the items ask for three words in a row
    "|| CASE item_id % 3 WHEN 0 THEN ' widgit' WHEN 1 THEN ' smal' ELSE '' END AS q", "|| CASE item_id % 4 WHEN 0 THEN ' widgit' WHEN 1 THEN ' smal' ELSE '' END AS q")


@query(_PHRASES + " SELECT query_id, rank, score, key FROM hits")
def r4_phrase_search(spark, d):
    """Words of a query that stand side by side count as a phrase."""
    words = F.split("text", " ")
    q = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat_ws(" ", F.array_join(F.slice(words, 3, 3), " "), F.when(F.col("item_id") % 4 == 0, "widgit").when(F.col("item_id") % 4 == 1, "smal")).alias("q"))
    return I.search_index(_index(spark, d), q, phrase=True).select("query_id", "rank", "score", "key")


_CHANGED = _SEARCH.replace("text AS content, doc_id FROM documents", "CASE WHEN doc_id % 50 = 7 THEN 'smaller widgets ' || text WHEN doc_id % 50 = 8 THEN 'of nothing' ELSE text END AS content, doc_id FROM documents WHERE doc_id % 50 <> 13")


@query(_CHANGED + " SELECT query_id, rank, score, kind, key, path FROM hits")
def r2_changed_index(spark, d):
    """An index of all documents, then changes and deletions; it answers as one built of what is there in the end."""
    docs = read(spark, d, "documents")
    from .tables import path_expr

    def entities(rows, text):
        return R.build_search_entities(corpus.corpus_from_table(rows, path_expr(), text, None, F.lit("r")))

    first = I.build_index(_entities(spark, d), f"{shared_folder(spark)}/cm-index-{uuid.uuid4().hex}")
    second = I.update_index(first, entities(docs.where("doc_id % 50 = 7"), F.concat(F.lit("smaller widgets "), "text")), docs.where("doc_id % 50 = 13").select(path_expr().alias("key")))
    third = I.update_index(second, entities(docs.where("doc_id % 50 = 8"), F.lit("of nothing")))
    return I.search_index(third, _queries(spark, d)).select("query_id", "rank", "score", "kind", "key", "path")


@query(_SEARCH + ", b AS (SELECT query_id, path, max(score) AS score, min(rank) AS first FROM hits GROUP BY 1, 2) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY first, b.path)::INTEGER AS ord, b.path, score FROM b JOIN files f ON f.path = b.path")
def r6_j11_build_context(spark, d):
    hits = _found(spark, d)
    return K.hits_to_context(hits, files(spark, d)).select("query_id", "ord", "path", "score")


_EXACT = _SEARCH[: _SEARCH.index("), s AS (")] + f"""), s AS (SELECT c.term, c.key, 1.0::DOUBLE AS s FROM (SELECT DISTINCT term, key FROM holds JOIN post USING (token)) c JOIN ent USING (key) WHERE list_contains({_WORDS.format('search_text')}, c.term)
""" + _SEARCH[_SEARCH.index("), total AS (") :]


@query(_EXACT + " SELECT query_id, rank, score, key FROM hits")
def r5_scorer_seam(spark, d):
    """The same search under another scorer: exact words of the text only."""
    exact = lambda term, name, text, sim, word: F.when(word, 1.0).otherwise(0.0)
    return R.search(_entities(spark, d), _queries(spark, d), fuzzy=False, scorer=exact).select("query_id", "rank", "score", "key")


@query("WITH e AS (SELECT label, list(embedding ORDER BY vec_id) AS l FROM embeddings GROUP BY label), c AS (SELECT vec_id, label, embedding FROM embeddings) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], l[1]::DOUBLE[]), 5) AS score FROM c JOIN e USING (label)")
def r5_cosine(spark, d):
    e = read(spark, d, "embeddings")
    head = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("head"))
    return e.join(head, "label").select("vec_id", F.round(R.cosine(F.col("embedding"), F.col("head")), 5).alias("score"))


_NEAR = f""", {EDGES}, linked AS (SELECT DISTINCT n, other, kind, direction FROM (SELECT 'n:' || src AS n, 'n:' || dst AS other, kind, 'out' AS direction FROM edges UNION ALL SELECT 'n:' || dst, 'n:' || src, kind, 'in' FROM edges)
), dep AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY kind, other, direction) AS nth FROM linked) WHERE nth <= 3)"""


@query(_SEARCH + _NEAR + """ SELECT query_id, rank, h.key, 'hit' AS part, NULL AS other, NULL AS relation, NULL AS direction, substr(f.content, 1, 30) AS overview FROM hits h LEFT JOIN (SELECT * FROM files WHERE doc_id % 4 <> 0) f ON f.path = h.path
UNION ALL SELECT query_id, rank, h.key, 'dependency', other, dep.kind, direction, NULL FROM hits h JOIN dep ON h.kind = 'symbol' AND dep.n = 'n:' || substr(h.key, 8)""")
def r7_relevant_context(spark, d):
    hits = _found(spark, d)
    known = read(spark, d, "documents").where("doc_id % 4 <> 0")
    from .tables import path_expr

    summaries = known.select(path_expr().alias("target"), F.lit("file").alias("kind"), F.substring("text", 1, 30).alias("overview"))
    e = edges(spark, d).select(S.symbol_node_id(F.col("src").cast("string")).alias("src"), S.symbol_node_id(F.col("dst").cast("string")).alias("dst"), "kind")
    return K.relevant_context(hits, e, summaries, limit=3)


def _targets(spark, d):
    """Parts as names of symbols, orders as files, regions as folders or nothing, and what the queries ask for as concepts."""
    p = read(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("target_id"), F.concat(F.lit("part"), F.col("p_partkey").cast("string")).alias("target"))
    o = order_files(spark, d).select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("target_id"), F.col("path").alias("target"))
    r = read(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("target_id"), F.when(F.col("r_regionkey") == 0, "src").otherwise(F.lit("..")).alias("target"))
    q = _queries(spark, d).select(F.concat(F.lit("q"), F.col("query_id").cast("string")).alias("target_id"), F.col("q").alias("target"))
    return p.unionByName(o).unionByName(r).unionByName(q)


@query(
    _SEARCH + f""", {SYMBOLS}, order_files AS (SELECT 'src/o' || o_orderkey || '.ts' AS path, o_orderkey FROM orders), t AS (SELECT 'p' || p_partkey AS target_id, 'part' || p_partkey AS target FROM part UNION ALL SELECT 'o' || o_orderkey, path FROM order_files UNION ALL SELECT 'r' || r_regionkey, CASE WHEN r_regionkey = 0 THEN 'src' ELSE '..' END FROM region UNION ALL SELECT 'q' || query_id, q.q FROM q
), sy AS (SELECT name, count(*) AS n, arg_min(kind || ' in ' || path || ', lines ' || start_line || ' to ' || end_line, (path, start_line, start_col, id)) AS e, arg_min(path, (path, start_line, start_col, id)) AS p FROM symbols GROUP BY 1
), fi AS (SELECT path, count(id) AS n FROM order_files LEFT JOIN symbols USING (path) GROUP BY 1
), co AS (SELECT 'q' || query_id AS target_id, count(*) AS n, arg_min(key, rank) AS best FROM hits GROUP BY 1)
SELECT t.target_id, CASE WHEN sy.name IS NOT NULL THEN 'symbol' WHEN fi.path IS NOT NULL THEN 'file' WHEN target = 'src' THEN 'module' ELSE 'concept' END AS kind,
  CASE WHEN sy.name IS NOT NULL THEN sy.p || '#' || target WHEN fi.path IS NOT NULL THEN target WHEN target = 'src' THEN 'src' ELSE co.best END AS subject,
  CASE WHEN sy.name IS NOT NULL THEN sy.n WHEN fi.path IS NOT NULL OR target = 'src' THEN 1 ELSE coalesce(co.n, 0) END AS matches,
  CASE WHEN sy.name IS NOT NULL THEN sy.e WHEN fi.path IS NOT NULL THEN 'typescript file with ' || fi.n || ' symbols' WHEN target = 'src' THEN 'folder of ' || (SELECT count(*) FROM order_files) || ' files with ' || (SELECT count(*) FROM symbols) || ' symbols' WHEN co.n IS NULL THEN 'nothing is known' ELSE 'concept found in ' || co.n || ' places, best ' || co.best END AS explanation
FROM t LEFT JOIN sy ON sy.name = target LEFT JOIN fi ON fi.path = target LEFT JOIN co ON co.target_id = t.target_id"""
)
def r10_explain_targets(spark, d):
    f, sym = order_files(spark, d).select("path", F.lit("typescript").alias("language")), symbols(spark, d)
    none = spark.createDataFrame([], "src_path string, dst_path string")
    mods = C.explain_modules(f, sym, none, C.folder_modules(f).select(F.col("path").alias("dir")))
    return K.explain_targets(_targets(spark, d), sym, f, mods, _entities(spark, d))


def _items(spark, d):
    """The context items of each query: what search found, and one instruction."""
    ctx = K.hits_to_context(_found(spark, d), files(spark, d))
    found = ctx.select(F.col("query_id").alias("task_id"), F.col("path").alias("id"), "path", "content", "score")
    rules = _queries(spark, d).select(F.col("query_id").alias("task_id"), F.lit("rules").alias("id"), F.lit("RULES.md").alias("path"), F.concat(F.lit("Answer: "), "q").alias("content"), F.lit(1.0).alias("score"))
    return K.assemble_items({"instructions": rules, "search": found})


def _packages(spark, d):
    """Packages of the queries; each asks in one of four repositories, of which r2 has no hashes and r3 no index."""
    prev, cur = snapshots(spark, d)
    repos = files(spark, d).select("repo_id").distinct().withColumn("available", F.col("repo_id") != "r3")
    tasks = _queries(spark, d).select(F.col("query_id").alias("task_id"), F.concat(F.lit("r"), (F.col("query_id") % 5).cast("string")).alias("repo_id"))
    return K.context_packages(_items(spark, d), K.stale_tasks(tasks, N.detect_freshness(prev.where("repo_id <> 'r2'"), cur, repos)))


_PACKAGED = _SEARCH + f""", b AS (SELECT query_id, path, max(score) AS score, min(rank) AS first FROM hits GROUP BY 1, 2
), it AS (
  SELECT query_id AS task_id, 'rules' AS id, 'RULES.md' AS path, 'Answer: ' || q AS content, 1.0::DOUBLE AS score, 'instructions' AS kind FROM q
  UNION ALL SELECT query_id, b.path, b.path, content, score, 'search' FROM b JOIN files f ON f.path = b.path
), o AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY CASE kind WHEN 'instructions' THEN 0 ELSE 3 END, score DESC, id, kind) AS ord FROM it
), dn AS (SELECT *, regexp_extract(path, '[^/\\\\]*$') AS name FROM o
), dc AS (SELECT *, """ + _DENIED_SQL + """ AS np FROM dn), de AS (SELECT *, CASE WHEN len(np) > 0 THEN np ELSE """ + _CONTENT_SQL.format("content") + """ END AS pats FROM dc
), ac AS (SELECT *, ceil(length(content) / 4.0) > 2000 AS truncated, CASE WHEN ceil(length(content) / 4.0) > 2000 THEN regexp_replace(substr(content, 1, 8000), '\\s+$', '') || chr(10) || '… [truncated]' ELSE content END AS cut FROM de WHERE len(pats) = 0
), tk AS (SELECT *, ceil(length(cut) / 4.0)::BIGINT AS tokens, row_number() OVER (PARTITION BY task_id ORDER BY ord) AS n FROM ac
), cu AS (SELECT *, (sum(tokens) OVER (PARTITION BY task_id ORDER BY ord))::BIGINT AS cum FROM tk
), fi AS (SELECT *, greatest(coalesce(max(n) FILTER (cum <= 12000) OVER (PARTITION BY task_id), 0), coalesce(max(n) FILTER (kind = 'instructions') OVER (PARTITION BY task_id), 0)) AS fits FROM cu
), ke AS (SELECT *, least(fits, greatest(20, coalesce(max(n) FILTER (n <= fits AND kind = 'instructions') OVER (PARTITION BY task_id), 0))) AS keep FROM fi
), pk AS (SELECT *, CASE kind WHEN 'instructions' THEN 'instructions of the project' ELSE 'found by search with score ' || format('{:.3f}', score) END || CASE WHEN truncated THEN ', cut to the token limit' ELSE '' END AS reason FROM ke WHERE n <= keep
), rc AS (SELECT task_id, count(*) FILTER (n <= keep) AS items, coalesce(sum(tokens) FILTER (n <= keep), 0)::BIGINT AS tokens, coalesce(sum(tokens) FILTER (n <= keep), 0) > 12000 AS over FROM ke GROUP BY 1)"""


@query(_PACKAGED + " SELECT task_id, ord, kind, id, path, score, tokens, truncated, cum, reason FROM pk")
def r8_context_packages(spark, d):
    return _packages(spark, d)[0].select("task_id", "ord", "kind", "id", "path", "score", "tokens", "truncated", "cum", "reason")


@query(_PACKAGED + """ SELECT r.task_id, '# Task ' || r.task_id || chr(10) || chr(10) || 'Index: ' || ['stale', 'stale', 'unknown', 'unavailable', 'unavailable'][r.task_id % 5 + 1] || chr(10) || chr(10) || 'Items: ' || r.items || ', tokens: ' || r.tokens || CASE WHEN r.over THEN chr(10) || chr(10) || 'Warning: over budget' ELSE '' END
|| coalesce(chr(10) || chr(10) || p.body, '') || coalesce(chr(10) || chr(10) || x.body, '') AS text FROM rc r
LEFT JOIN (SELECT task_id, string_agg('## ' || path || CASE WHEN truncated THEN ' (truncated)' ELSE '' END || chr(10) || chr(10) || 'Reason: ' || reason || chr(10) || chr(10) || cut, chr(10) || chr(10) ORDER BY ord) AS body FROM pk GROUP BY 1) p USING (task_id)
LEFT JOIN (SELECT task_id, 'Left out: ' || any_value(c) || chr(10) || string_agg('- ' || path || ': ' || array_to_string(pats, ', '), chr(10) ORDER BY n) FILTER (n <= 10) AS body FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY id, path) AS n, count(*) OVER (PARTITION BY task_id) AS c FROM de WHERE len(pats) > 0) GROUP BY 1) x USING (task_id)""")
def r9_render_packages(spark, d):
    return K.render_packages(*_packages(spark, d))


# --- items of conversations: a conversation is a task, its turns are items ---
_ITEMS = """items AS (SELECT conv_id AS task_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS ord, conv_id || '/' || turn AS id, CASE WHEN turn = 0 THEN 'instructions' WHEN turn = 3 THEN 'dependency-chain' ELSE 'search' END AS kind, text AS content FROM conversations)"""


def _turns(spark, d):
    from pyspark.sql.window import Window

    c = read(spark, d, "conversations")
    kind = F.when(F.col("turn") == 0, "instructions").when(F.col("turn") == 3, "dependency-chain").otherwise("search")
    return c.select(F.col("conv_id").alias("task_id"), F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("ord"), F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), kind.alias("kind"), F.col("text").alias("content"), F.lit(None).cast("string").alias("path"), (1 / (F.col("turn") + 1)).alias("score"))


_BUDGET = f"""WITH {_ITEMS}, c AS (
  SELECT *, ceil(length(content) / 4.0) > 100 AS truncated, CASE WHEN ceil(length(content) / 4.0) > 100 THEN regexp_replace(substr(content, 1, 400), '\\s+$', '') || chr(10) || '… [truncated]' ELSE content END AS cut FROM items
), t AS (SELECT *, ceil(length(cut) / 4.0)::BIGINT AS tokens FROM c
), r AS (SELECT *, (sum(tokens) OVER (PARTITION BY task_id ORDER BY ord))::BIGINT AS cum FROM t
), f AS (SELECT *, greatest(coalesce(max(ord) FILTER (cum <= 250) OVER (PARTITION BY task_id), 0), coalesce(max(ord) FILTER (kind = 'instructions') OVER (PARTITION BY task_id), 0)) AS fits FROM r
), k AS (SELECT *, least(fits, greatest(3, coalesce(max(ord) FILTER (ord <= fits AND kind IN ('instructions', 'dependency-chain')) OVER (PARTITION BY task_id), 0))) AS keep FROM f)"""


@query(_BUDGET + " SELECT task_id, ord, kind, tokens, truncated, cum, ord <= keep AS kept FROM k")
def w4_apply_budget(spark, d):
    return K.apply_budget(_turns(spark, d), 100, 250, 3).select("task_id", "ord", "kind", "tokens", "truncated", "cum", "kept")


@query(_BUDGET + " SELECT task_id, count(*) FILTER (ord <= keep) AS items, coalesce(sum(tokens) FILTER (ord <= keep), 0)::BIGINT AS tokens, count(*) FILTER (ord > keep) AS dropped, count(*) FILTER (ord <= keep AND truncated) AS truncated, coalesce(sum(tokens) FILTER (ord <= keep), 0) > 250 AS budget_exceeded FROM k GROUP BY task_id")
def w4_budget_record(spark, d):
    return K.budget_record(K.apply_budget(_turns(spark, d), 100, 250, 3), 250)


@query("SELECT source || '/' || lang AS path, lang AS query_id, arg_min(doc_id, (-n_chars, doc_id)) AS id FROM documents GROUP BY source, lang")
def w2_best_item_per_source(spark, d):
    i = read(spark, d, "documents").select(F.col("lang").alias("query_id"), F.concat_ws("/", "source", "lang").alias("path"), F.col("doc_id").alias("id"), F.col("n_chars").alias("score"))
    return K.best_item_per_source(i).select("path", "query_id", "id")


@query(f"WITH {_ITEMS} SELECT task_id, id, kind, row_number() OVER (PARTITION BY task_id ORDER BY CASE kind WHEN 'instructions' THEN 0 ELSE 3 END, -ord, id, kind)::INTEGER AS ord FROM items WHERE kind <> 'dependency-chain'")
def u3_assemble_items(spark, d):
    t = _turns(spark, d).withColumn("score", F.col("ord").cast("double"))
    return K.assemble_items({k: t.where(F.col("kind") == k) for k in ("instructions", "search")}).select("task_id", "id", "kind", "ord")


@query(f"WITH {_ITEMS}, c AS (SELECT *, " + _CONTENT_SQL.format("content") + " AS p FROM (SELECT task_id, id, CASE WHEN ord % 4 = 0 THEN 'password: Zq81mLw0Rt55' || chr(10) || content ELSE content END AS content FROM items)) SELECT task_id, id, array_to_string(p, ', ') AS reason FROM c WHERE len(p) > 0")
def u4_split_exclusions(spark, d):
    t = _turns(spark, d).withColumn("content", F.when(F.col("ord") % 4 == 0, F.concat(F.lit("password: Zq81mLw0Rt55\n"), "content")).otherwise(F.col("content"))).withColumn("path", F.lit("turn.txt"))
    return K.split_exclusions(P.deny_filter(t))[1].select("task_id", "id", "reason")


@query(f"WITH {FILES} SELECT path, replace(replace('Write a concise summary of the source code in ' || path || '.' || chr(10) || chr(10) || 'Language: ' || coalesce(language, 'unknown'), 'ZZ', ''), 'YY', '') AS head FROM files")
def e9_prompt_table(spark, d):
    return K.file_prompts(files(spark, d)).select("path", F.regexp_extract("prompt", r"(?s)^(Write a concise.*?Language: [^\n]*)", 1).alias("head"))


@query("SELECT c_mktsegment AS scope, count(*)::INTEGER AS lines FROM (SELECT c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_name) AS n FROM customer) WHERE n <= 50 GROUP BY 1")
def e9_scope_prompt_table(spark, d):
    c = read(spark, d, "customer").select(F.col("c_mktsegment").alias("scope"), F.col("c_name").alias("path"), F.lit("a customer").alias("overview"))
    return K.scope_prompts(c, "folder").select("scope", F.size(F.regexp_extract_all("prompt", F.lit(r"(?m)^- Customer#"), 0)).alias("lines"))


# --- graphs ---


@query(f"WITH {EDGES} SELECT DISTINCT node, neighbor FROM (SELECT src AS node, dst AS neighbor FROM edges UNION ALL SELECT dst, src FROM edges) JOIN part ON p_partkey = node")
def g2_neighbors(spark, d):
    return G.neighbors(edges(spark, d), read(spark, d, "part").select(F.col("p_partkey").alias("node")))


@query(f"WITH {EDGES}, b AS (SELECT DISTINCT p_partkey AS request_id, dst AS other, kind, 'out' AS direction FROM part JOIN edges ON src = p_partkey WHERE kind IN ('A', 'N') UNION SELECT p_partkey, src, kind, 'in' FROM part JOIN edges ON dst = p_partkey WHERE kind IN ('A', 'N')) SELECT request_id, other, kind, direction FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY kind, other, direction) AS n FROM b) WHERE n <= 5")
def g3_dependencies(spark, d):
    return G.dependencies(edges(spark, d), read(spark, d, "part").select(F.col("p_partkey").alias("request_id"), F.col("p_partkey").alias("node")), "both", ["A", "N"], 5)


_HOPS = f"WITH RECURSIVE {EDGES}, e AS (SELECT DISTINCT src, dst FROM edges), h AS (SELECT p_partkey AS seed, p_partkey AS node, 0 AS distance FROM part WHERE p_partkey % 50 = 0 UNION SELECT seed, dst, distance + 1 FROM h JOIN e ON src = node WHERE distance < 2) SELECT seed, node, min(distance) AS distance FROM h GROUP BY 1, 2"


@query(_HOPS)
def g4_k_hop(spark, d):
    """Asked for the parts whose key is divisible by 50, over all edges."""
    return G.k_hop(edges(spark, d), read(spark, d, "part").where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("node")), 2)


def _customer_chain(spark, d):
    """Orders of a customer lead to that customer's next order by key."""
    from pyspark.sql.window import Window

    o = read(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("src"), F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("dst")).where("dst is not null")


_CHAIN = "chain AS (SELECT * FROM (SELECT o_orderkey AS src, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS dst FROM orders) WHERE dst IS NOT NULL)"


@query(f"WITH RECURSIVE {_CHAIN}, p AS (SELECT o_custkey AS pair_id, min(o_orderkey) AS src, max(o_orderkey) AS dst FROM orders GROUP BY 1), h AS (SELECT pair_id, src AS node, 0 AS distance FROM p UNION SELECT pair_id, dst, distance + 1 FROM h JOIN chain ON chain.src = node) SELECT p.pair_id, min(distance) AS distance FROM p LEFT JOIN h ON h.pair_id = p.pair_id AND h.node = p.dst GROUP BY 1")
def g5_shortest_path_lengths(spark, d):
    p = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("pair_id")).agg(F.min("o_orderkey").alias("src"), F.max("o_orderkey").alias("dst"))
    return G.shortest_paths(_customer_chain(spark, d), p).select("pair_id", "distance").distinct()


@query("SELECT o_custkey AS pair_id, max(i) OVER (PARTITION BY o_custkey) AS distance, i AS step, o_orderkey::VARCHAR AS node FROM (SELECT o_custkey, o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INTEGER AS i FROM orders)")
def g5_shortest_paths(spark, d):
    p = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("pair_id")).agg(F.min("o_orderkey").alias("src"), F.max("o_orderkey").alias("dst"))
    return G.shortest_paths(_customer_chain(spark, d), p)


def _rings(spark, d):
    """Chains of orders of a customer, closed into a ring for every customer with an even key."""
    o = read(spark, d, "orders").where("o_custkey % 2 = 0").groupBy("o_custkey").agg(F.max("o_orderkey").alias("src"), F.min("o_orderkey").alias("dst")).select("src", "dst")
    return _customer_chain(spark, d).unionByName(o)


@query("SELECT o_orderkey AS node, max(o_orderkey) OVER (PARTITION BY o_custkey) AS component FROM orders WHERE o_custkey % 2 = 0 QUALIFY count(*) OVER (PARTITION BY o_custkey) > 1")
def g6_scc(spark, d):
    return G.scc(_rings(spark, d))


@query("""WITH o AS (SELECT o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INTEGER AS i, count(*) OVER (PARTITION BY o_custkey)::INTEGER AS n, min(o_orderkey) OVER (PARTITION BY o_custkey) AS c FROM orders WHERE o_custkey % 2 = 0)
SELECT c::VARCHAR AS cycle_id, i AS step, o_orderkey::VARCHAR AS node FROM o UNION ALL SELECT c::VARCHAR, n, c::VARCHAR FROM o WHERE i = 0""")
def g6_cycles(spark, d):
    return G.cycles(_rings(spark, d))


@query(f"WITH {EDGES} SELECT coalesce(o.node, i.node) AS node, coalesce(o.kind, i.kind) AS kind, coalesce(n_out, 0) AS n_out, coalesce(n_in, 0) AS n_in FROM (SELECT src AS node, kind, count(*) AS n_out FROM edges GROUP BY 1, 2) o FULL JOIN (SELECT dst AS node, kind, count(*) AS n_in FROM edges GROUP BY 1, 2) i ON o.node = i.node AND o.kind = i.kind")
def g7_degree_stats(spark, d):
    return G.degree_stats(edges(spark, d))


@query(f"WITH {EDGES} SELECT a.p_brand AS module_from, b.p_brand AS module_to, count(*) AS weight FROM edges JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst WHERE a.p_brand <> b.p_brand GROUP BY 1, 2")
def g8_module_graph(spark, d):
    return G.module_graph(edges(spark, d), read(spark, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("module")))


@query(f"WITH RECURSIVE {_CHAIN}, h AS (SELECT min(o_orderkey) AS seed, min(o_orderkey) AS node, 0 AS distance FROM orders GROUP BY o_custkey UNION ALL SELECT seed, dst, distance + 1 FROM h JOIN chain ON src = node) SELECT seed, node, distance FROM h")
def g9_transitive_closure(spark, d):
    return G.transitive_closure(_customer_chain(spark, d), read(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("node")).select("node"))


@query(
    f"WITH {SYMBOLS}, {REFS}, {IMPORTS}, box AS (SELECT ref_id, arg_min(s.id, (s.start_line, s.start_col, s.id)) AS parent_id FROM refs r JOIN symbols s ON s.path = r.path AND s.kind IN ('class', 'interface', 'enum') AND r.line BETWEEN s.start_line AND s.end_line GROUP BY ref_id"
    "), m AS (SELECT parent_id, name, arg_min(id, (start_line, start_col, id)) AS member FROM symbols WHERE parent_id IS NOT NULL GROUP BY 1, 2), t AS (SELECT path, name, arg_min(id, (start_line, start_col, id)) AS top_id FROM symbols WHERE parent_id IS NULL GROUP BY 1, 2"
    "), own AS (SELECT ref_id, arg_min(s.id, (s.end_line - s.start_line, s.id)) AS owner FROM refs r JOIN symbols s ON s.path = r.path AND r.line BETWEEN s.start_line AND s.end_line GROUP BY ref_id"
    "), used AS (SELECT r.*, coalesce(m.member, t.top_id) AS target FROM refs r LEFT JOIN box USING (ref_id) LEFT JOIN m ON m.parent_id = box.parent_id AND m.name = r.name LEFT JOIN t ON t.path = r.path AND t.name = r.name"
    "), g AS (SELECT CASE WHEN parent_id IS NULL THEN 'n:file:' || path ELSE 'n:' || parent_id END AS src, 'n:' || id AS dst, 'contains' AS kind FROM symbols UNION SELECT 'n:file:' || path, 'n:' || id, 'exports' FROM symbols WHERE exported "
    "UNION SELECT 'n:file:' || from_path, 'n:file:' || target, 'imports' FROM resolved WHERE target IS NOT NULL UNION SELECT CASE WHEN owner IS NULL THEN 'n:file:' || path ELSE 'n:' || owner END, 'n:' || target, kind FROM used LEFT JOIN own USING (ref_id) WHERE target IS NOT NULL) SELECT * FROM g"
)
def g1_build_graph(spark, d):
    return G.build_graph(symbols(spark, d), refs(spark, d), imports(spark, d), order_files(spark, d))[1]


# --- extraction ---


@query("""SELECT 'src/p' || p_partkey || '.ts' AS path, 'src/p' || p_partkey || '.ts#' || b.name || '@' || b.l || ':' || b.c AS id, b.name, b.kind, b.l AS start_line, b.e AS end_line, CASE WHEN b.name = 'size' THEN 'src/p' || p_partkey || '.ts#Part' || p_partkey || '@4:0' END AS parent_id,
b.x AS exported, CASE WHEN b.name = 'size' THEN 'private' ELSE 'public' END AS visibility, CASE WHEN b.kind = 'class' THEN 'about ' || p_name END AS documentation
FROM part, LATERAL (VALUES ('Part' || p_partkey, 'class', 4, 8, 0, true), ('size', 'method', 5, 7, 2, false), ('make' || p_partkey, 'function', 10, 13, 0, true), ('x', 'constant', 11, 11, 2, false)) AS b(name, kind, l, e, c, x)""")
def e1_extract_symbols(spark, d):
    return E.extract_symbols(_sources(spark, d)).select("id", "path", "name", "kind", "start_line", "end_line", "parent_id", "exported", "visibility", "documentation")


def _sources(spark, d):
    """A small source file for each part, whose names and sizes come from the table; parts are dealt out before files are made of them."""
    p = read(spark, d, "part").select("p_partkey", "p_name", "p_size").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    n = F.col("p_partkey").cast("string")
    text = F.concat(
        F.lit("import { helper as h, util } from './p"), (F.col("p_partkey") + 1).cast("string"), F.lit("';\nimport base from '../lib';\n// about "), "p_name", F.lit("\nexport class Part"), n,
        F.lit(" extends Base {\n  private size() {\n    return helper("), F.col("p_size").cast("string"), F.lit(");\n  }\n}\n\nexport default function make"), n, F.lit("() {\n  const x = new Part"), n, F.lit("();\n  x.size();\n}\n"),
    )
    return p.select(F.concat(F.lit("src/p"), n, F.lit(".ts")).alias("path"), F.lit("typescript").alias("language"), text.alias("content"))


@query("SELECT 'src/p' || p_partkey || '.ts' AS from_path, b.name, b.imported_name, b.spec AS specifier, b.d AS is_default FROM part, LATERAL (VALUES ('h', 'helper', './p' || (p_partkey + 1), false), ('util', 'util', './p' || (p_partkey + 1), false), ('base', 'default', '../lib', true)) AS b(name, imported_name, spec, d)")
def e2_extract_imports(spark, d):
    return E.extract_imports(_sources(spark, d))


@query("""SELECT 'src/p' || p_partkey || '.ts:' || b.l || ':' || b.n AS ref_id, 'src/p' || p_partkey || '.ts' AS path, b.name, b.kind, b.l AS line
FROM part, LATERAL (VALUES ('Part' || p_partkey, 'construct', 11, 2), ('x', 'read', 12, 0), ('size', 'call', 12, 1)) AS b(name, kind, l, n)""")
def e3_extract_references(spark, d):
    src = _sources(spark, d)
    return E.extract_references(src, E.extract_symbols(src))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, unnest(range(0, len(l)))::INTEGER AS pos, unnest(l) AS href FROM (SELECT page_id, url, regexp_extract_all(html, 'href=\"([^\"]+)\"', 1) AS l FROM pages)")
def e4_extract_links(spark, d):
    return E.extract_links(read(spark, d, "pages"))


@query("""SELECT 'src/q' || p_partkey || '.ts' AS path, b.name, b.kind, b.l AS start_line, b.e AS end_line
FROM part, LATERAL (VALUES ('f' || p_partkey, 'function', 1, 5 + p_size), ('A', 'class', 6 + p_size, 10 + p_size), ('m', 'method', 7 + p_size, 9 + p_size)) AS b(name, kind, l, e)""")
def e1_quoted_braces(spark, d):
    """Braces and declarations in strings, templates and comments, as many lines of them as a part has size, change nothing."""
    p = read(spark, d, "part")
    n = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("function f"), n, F.lit("() {\n  g('}', \"{{\"); // }\n  h(`\n"), F.repeat(F.lit("} class X {\n"), F.col("p_size")), F.lit("`);\n  /* } */ }\nclass A {\n  m() {\n    return '// }';\n  }\n}\n"))
    return E.extract_symbols(p.select(F.concat(F.lit("src/q"), n, F.lit(".ts")).alias("path"), text.alias("content"))).select("path", "name", "kind", "start_line", "end_line")


@query(f"WITH {FILES} SELECT path, CASE WHEN language = 'typescript' THEN NULL WHEN language = 'python' THEN 'ValueError: cannot read' ELSE 'unsupported language: ' || coalesce(language, 'None') END AS reason FROM files")
def e5_extract_with(spark, d):
    def first_line(path, content):
        return [{"path": path, "line": content.split("\n", 1)[0][:80]}]

    def broken(path, content):
        raise ValueError("cannot read")

    rows, skipped = E.extract_with(files(spark, d), {"typescript": first_line, "python": broken}, "path string, line string")
    return rows.select("path", F.lit(None).cast("string").alias("reason")).unionByName(skipped)


@query(f"WITH {FILES} SELECT path, CASE WHEN language = 'typescript' THEN NULL WHEN language = 'python' THEN 'ValueError: cannot read' ELSE 'unsupported language: ' || coalesce(language, 'None') END AS reason FROM files")
def e5_parser_function(spark, d):
    """The same parsers as a table function in SQL, joined laterally; their kind decides the columns."""

    def first_line(path, content):
        return [{"path": path, "line": content.split("\n", 1)[0][:80]}]

    def broken(path, content):
        raise ValueError("cannot read")

    E.register_parsers(spark, {"lines": ("path string, line string", {"typescript": first_line, "python": broken}), "sizes": ("size int", {})})
    return spark.sql("SELECT f.path, p.skipped AS reason FROM {files} f, LATERAL parse_source('lines', f.path, f.language, f.content) p", files=files(spark, d))


@query("""WITH i AS (SELECT conv_id || '/' || turn AS id, turn, 'summary:turn:' || sha256(text) AS key, text FROM conversations), c AS (SELECT DISTINCT key FROM i WHERE turn = 0)
SELECT id, key, CASE WHEN c.key IS NOT NULL THEN 'kept' ELSE length(text) || ' characters' END AS value, c.key IS NOT NULL AS cache_hit, NULL::VARCHAR AS error FROM i LEFT JOIN c USING (key)""")
def e8_enrich_with_cache(spark, d):
    c = read(spark, d, "conversations")
    items = c.select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), E.cache_key(F.lit("turn"), F.col("text")).alias("key"), F.col("text").alias("content"))
    now = datetime.datetime(2024, 1, 2)
    cache = items.where("id like '%/0'").select("key", F.lit("kept").alias("value"), F.lit(datetime.datetime(2024, 1, 3)).alias("expires_at"))
    return E.enrich_with_cache(items, cache, lambda text: f"{len(text)} characters", now)


_TREE = """f AS (SELECT p_partkey AS k, 'src/d' || (p_partkey % 9) || '/p' || p_partkey || '.ts' AS path, p_name AS content, p_partkey % 50 = 7 AS changed FROM part)"""
_SCOPES = _TREE + """, h AS (SELECT *, sha256(path || '|' || sha256(content)) AS old, sha256(path || '|' || sha256(content || CASE WHEN changed AND k % 9 < 3 THEN '!' ELSE '' END)) AS key, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM f
), d1 AS (SELECT dir AS target, sha256(dir || '|' || string_agg(key, '' ORDER BY key)) AS key, sha256(dir || '|' || string_agg(old, '' ORDER BY old)) AS old FROM h GROUP BY dir
), d2 AS (SELECT 'src' AS target, sha256('src|' || string_agg(key, '' ORDER BY key)) AS key, sha256('src|' || string_agg(old, '' ORDER BY old)) AS old FROM d1
), d3 AS (SELECT '' AS target, sha256('|' || key) AS key, sha256('|' || old) AS old FROM d2), scopes AS (SELECT * FROM d1 UNION ALL SELECT * FROM d2 UNION ALL SELECT * FROM d3)"""


@query(f"WITH {_SCOPES} SELECT target AS id, 'scope:' || key AS key, CASE WHEN key = old THEN 'kept' ELSE 'made of ' || target END AS value, key = old AS cache_hit FROM scopes")
def e8_scope_roll_up(spark, d):
    """Folders' values under their scope keys: some files have changed since the cache was filled, only folders above them are computed."""
    p, k = read(spark, d, "part"), F.col("p_partkey")
    f = p.select(F.concat(F.lit("src/d"), (k % 9).cast("string"), F.lit("/p"), k.cast("string"), F.lit(".ts")).alias("path"), S.content_hash(F.col("p_name")).alias("old"), S.content_hash(F.when((k % 50 == 7) & (k % 9 < 3), F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name"))).alias("hash"))
    before = E.scope_keys(f.select("path", F.col("old").alias("hash"))).where("kind = 'folder'")
    cache = before.select(F.concat(F.lit("scope:"), "key").alias("key"), F.lit("kept").alias("value"), F.lit(None).cast("timestamp").alias("expires_at"))
    contents = before.select("target", F.col("target").alias("content"))
    return E.roll_up(f.select("path", "hash"), contents, cache, lambda target: f"made of {target}", datetime.datetime(2024, 1, 2)).select("id", "key", "value", "cache_hit")


@query("""WITH f AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 50 <> 3), t AS (
  SELECT a.k, s.n, CASE WHEN s.n < 2 AND b.k IS NOT NULL THEN 'src/p' || b.k || '.ts' END AS target FROM f a, (VALUES (0), (1), (2)) s(n) LEFT JOIN f b ON b.k = a.k + 1)
SELECT 'link' AS what, 'src/p' || k || '.ts' AS path, target, 1::BIGINT AS n FROM t WHERE target IS NOT NULL
UNION ALL SELECT 'symbols', 'src/p' || k || '.ts', NULL, CASE WHEN k % 50 = 7 THEN 5 ELSE 4 END FROM f
UNION ALL SELECT 'module', 'src', NULL, count(*) FROM f""")
def e6_index_tables(spark, d):
    """Tables of an index after files have come, changed and gone: links between files, symbols and folders as of a rebuild."""
    src = _sources(spark, d).select("path", "content").withColumn("k", F.regexp_extract("path", r"(\d+)", 1).cast("long"))
    old, _ = N.apply_changes(None, src.where("k % 50 <> 11").drop("k"), None, E.extract_symbols)
    old = {n: stored(t) for n, t in old.items()}
    now = src.where("k % 50 <> 3").withColumn("content", F.when(F.col("k") % 50 == 7, F.concat("content", F.lit("enum Late {\n}\n"))).otherwise(F.col("content"))).drop("k")
    t = N.incremental_index(old, now, E.extract_symbols)
    none = F.lit(None).cast("string")
    links = t["links"].select(F.lit("link").alias("what"), F.col("from_path").alias("path"), "target", F.lit(1).cast("long").alias("n"))
    counts = t["symbols"].groupBy("path").agg(F.count("*").alias("n")).select(F.lit("symbols").alias("what"), "path", none.alias("target"), "n")
    return links.unionByName(counts).unionByName(t["modules"].select(F.lit("module").alias("what"), "path", none.alias("target"), F.col("files").alias("n")))


@query("SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY n))::INTEGER AS line, (sum(o) OVER (PARTITION BY doc_id ORDER BY n))::BIGINT AS depth_after FROM (SELECT doc_id, unnest(range(0, len(l))) AS n, (len(unnest(l)) - len(replace(unnest(l), '|', '')))::BIGINT AS o FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))")
def w8_brace_depth(spark, d):
    f = read(spark, d, "documents").select(F.col("doc_id").alias("path"), F.translate("text", "|{}", "{").alias("content"))
    return E.brace_depth(E.source_lines(f)).select(F.col("path").alias("doc_id"), "line", "depth_after")


# --- policy ---


def _policy_packages(spark, d):
    c = read(spark, d, "customer")
    i = F.col("c_custkey")
    return c.select(
        F.when(i % 13 == 0, F.concat("c_name", F.lit("; rm"))).otherwise(F.translate("c_name", "#", "-")).alias("tool_name"), F.when(i % 5 == 0, F.lit(None).cast("string")).otherwise("MIT").alias("license"),
        F.when(i % 7 == 0, "http://x").otherwise("https://x").alias("repository"), F.when(i % 3 == 0, "unknown").otherwise("npm").alias("package_source"), (i % 2 == 0).alias("dependencies_declared"), F.lit("npx").alias("install_binary"),
        F.array(F.when(i % 11 == 0, "a; b").otherwise("install")).alias("install_args"), F.when(i % 17 == 0, F.array(F.lit("secrets"))).otherwise(F.array()).cast("array<string>").alias("permissions"), F.lit("m").alias("maintainer"),
        F.lit("signed").alias("release_provenance"), F.lit(None).cast("string").alias("declared_status"), F.lit(None).cast("string").alias("declared_trust"), (i % 4 == 0).alias("community_reported"), (i % 6 == 0).alias("review_passed"),
        F.lit(True).alias("review_verified"), F.array(F.lit("read")).alias("review_checklist"), i.alias("key"),
    )


_PACKAGES = """pk AS (SELECT c_custkey AS i, CASE WHEN c_custkey % 13 = 0 THEN c_name || '; rm' ELSE replace(c_name, '#', '-') END AS tool_name FROM customer
), v AS (SELECT *, i % 13 = 0 AS bad, i % 7 = 0 OR i % 11 = 0 OR i % 17 = 0 AS f, i % 5 = 0 OR i % 3 = 0 OR i % 2 = 1 AS u FROM pk
), a AS (SELECT tool_name, i, bad, CASE WHEN bad THEN NULL WHEN f THEN 'critical' WHEN u THEN 'high' ELSE 'medium' END AS risk,
  CASE WHEN bad THEN NULL WHEN f THEN 'blocked' WHEN i % 6 = 0 AND NOT u THEN 'verified' WHEN i % 6 = 0 THEN 'reviewed' WHEN i % 4 = 0 THEN 'community' ELSE 'unverified' END AS status FROM v)"""


@query(f"WITH {_PACKAGES} SELECT tool_name, risk, status, status = 'unverified' AS override_required, CASE WHEN bad THEN 'unsafe tool name' END AS error FROM a")
def a17_assess_packages(spark, d):
    return L.assess_packages(_policy_packages(spark, d)).select("tool_name", "risk", "status", "override_required", "error")


@query(f"WITH {_PACKAGES} SELECT tool_name, status <> 'blocked' AND (status <> 'unverified' OR i % 10 = 1) AS allowed, status = 'unverified' AS requires_override, i % 10 = 1 AS override_applied FROM a WHERE NOT bad")
def a18_install_decision(spark, d):
    p = _policy_packages(spark, d)
    o = p.where("key % 5 = 1").select("tool_name", F.lit(True).alias("granted"), F.when(F.col("key") % 10 == 1, "seen").otherwise(" \t").alias("note"))
    return L.install_decision(L.assess_packages(p), o)


def _requirements(spark, d):
    p = read(spark, d, "part")
    i = F.col("p_partkey")
    pick = lambda *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (i % len(xs) + 1).cast("int"))
    return p.select(F.concat(F.lit("t"), (i % 700).cast("string")).alias("tool"), pick("node", "python", "go", "ghc").alias("runtime"), pick("^20", ">=3.9 <4", "1.x.y-", "*").alias("wanted"), (F.col("p_size") % 2 == 0).alias("advisory"))


_STATES = "st AS (SELECT 't' || (p_partkey % 700) AS tool, ['node', 'python', 'go', 'ghc'][p_partkey % 4 + 1] AS runtime, CASE p_partkey % 4 WHEN 0 THEN 'compatible' WHEN 1 THEN CASE WHEN p_size % 2 = 0 THEN 'partial' ELSE 'incompatible' END WHEN 2 THEN CASE WHEN p_size % 2 = 0 THEN 'partial' ELSE 'incompatible' END ELSE 'unknown' END AS state, p_size % 2 = 0 AS advisory FROM part)"


@query(f"WITH {_STATES} SELECT tool, runtime, advisory, state FROM st")
def j16_check_requirements(spark, d):
    inventory = spark.createDataFrame([("node", "v20.11.1"), ("python", "Python 3.8"), ("go", "go1.22")], "runtime string, version string")
    return L.check_requirements(_requirements(spark, d), inventory).select("tool", "runtime", "advisory", "state")


@query(f"WITH {_STATES} SELECT tool, CASE WHEN bool_or(state = 'incompatible') THEN 'incompatible' WHEN bool_or(state = 'unknown') THEN 'unknown' WHEN bool_or(state = 'partial') THEN 'partially-compatible' ELSE 'compatible' END AS verdict, count(*) AS requirements FROM st GROUP BY tool")
def j16_roll_up_requirements(spark, d):
    inventory = spark.createDataFrame([("node", "v20.11.1"), ("python", "Python 3.8"), ("go", "go1.22")], "runtime string, version string")
    return L.roll_up_requirements(L.check_requirements(_requirements(spark, d), inventory))


def _catalog(df, tag):
    return df.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("ord"), F.array("p_brand", "p_type").alias("categories"), F.concat(F.lit(tag), F.col("p_size").cast("string")).alias("note"))


@query("WITH b AS (SELECT p_name AS name, p_partkey AS ord, 'base' || p_size AS note, 0 AS p FROM part UNION ALL SELECT p_name, p_partkey, 'over' || p_size, 1 FROM part WHERE p_size > 45) SELECT name, arg_max(note, (p, ord)) AS note, CASE WHEN max(p) = 1 THEN 'overlay' ELSE 'catalog' END AS source FROM b GROUP BY name")
def j12_overlay_catalog(spark, d):
    p = read(spark, d, "part")
    return L.overlay_catalog(_catalog(p, "base"), _catalog(p.where("p_size > 45"), "over")).select("name", "note", "source")


@query("SELECT DISTINCT unnest([p_brand, p_type]) AS category FROM part")
def a21_distinct_categories(spark, d):
    return L.distinct_categories(_catalog(read(spark, d, "part"), ""))


@query(
    f"WITH s AS (SELECT o_custkey AS group_id, 'r' || (o.o_orderkey % 8) AS role_id, x.s, regexp_matches(lower(x.s), '\\b(?:not|no|never|hardly|no longer|isn''?t|doesn''?t|won''?t)\\b') AS neg, regexp_matches(lower(x.s), '{_NEG}') AS bad, regexp_matches(lower(x.s), '{_POS}') AS good FROM orders o JOIN ({_STATEMENT_SQL}) x USING (o_orderkey) WHERE o_orderkey % 5 <> 0"
    "), p AS (SELECT *, CASE WHEN neg AND bad THEN 'positive' WHEN bad AND NOT good THEN 'negative' WHEN good AND NOT bad THEN 'positive' ELSE 'neutral' END AS polarity, "
    "unnest(list_distinct(regexp_extract_all(s, '`([^`]{1,60})`', 1) || regexp_extract_all(s, '\\b[A-Z][A-Za-z0-9_]{1,60}\\b'))) AS topic FROM s) "
    "SELECT group_id, topic, count(*) FILTER (polarity = 'positive') AS positive, count(*) FILTER (polarity = 'negative') AS negative, list_sort(list(DISTINCT role_id)) AS roles FROM p WHERE polarity <> 'neutral' GROUP BY 1, 2 "
    "HAVING count(*) FILTER (polarity = 'positive') > 0 AND count(*) FILTER (polarity = 'negative') > 0"
)
def a20_detect_conflicts(spark, d):
    from .scalar_queries import _statements

    s, k = _statements(spark, d), F.col("o_orderkey")
    status = F.when(k % 5 == 0, "failed").when(k % 5 == 1, "stopped").otherwise("succeeded")
    reports = s.select(F.col("o_custkey").alias("group_id"), F.concat(F.lit("r"), (k % 8).cast("string")).alias("role_id"), status.alias("status"), F.concat("s", F.lit("!\nThe end. ")).alias("text"))
    return L.detect_conflicts(L.statements(reports)).select("group_id", "topic", "positive", "negative", "roles")


# --- streams, run until all is read; tests hold them against their batch twins ---


def _events(spark, d):
    e = read(spark, d, "events")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"), "value", "user_id", F.floor("value").cast("long").alias("tokens"))


@query("SELECT ts::DATE AS day, event_type AS kind, count(*) AS events, sum(floor(value))::BIGINT AS tokens FROM events GROUP BY 1, 2")
def d4_daily_activity(spark, d):
    return _streamed(spark, _events(spark, d), ST.stream_daily_activity, "complete")


@query("SELECT user_id, count(*) AS sessions, sum(n)::BIGINT AS events FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, ts, sum(gap) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS gap FROM events)) GROUP BY 1, 2) GROUP BY 1")
def d9_activity_sessions(spark, d):
    sessions = _streamed(spark, _events(spark, d), lambda s: ST.activity_sessions(s, late="1 day"), "complete")
    return sessions.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("events").alias("events"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type AS provider, count(*) AS events, sum(floor(value)) AS total_tokens FROM events GROUP BY 1, 2")
def d5_usage_windows(spark, d):
    e = _events(spark, d).select(F.col("ts").alias("occurred_at"), F.col("kind").alias("provider"), F.col("tokens").cast("double").alias("total_tokens"), F.lit(0).alias("total_src"), F.lit(1.0).alias("cost"), F.lit(1).alias("cost_src"), F.lit("USD").alias("currency"))
    return _streamed(spark, e, ST.stream_usage_windows, "complete").select(F.col("start").cast("timestamp_ntz").alias("start"), "provider", "events", "total_tokens")


@query("SELECT event_id, event_type FROM events")
def d6_dedup(spark, d):
    e = _events(spark, d)  # every event is delivered twice
    return _streamed(spark, e.unionByName(e), ST.stream_dedup).select("event_id", F.col("kind").alias("event_type"))


@query("SELECT event_id AS key, ts AS expires_at FROM events WHERE ts > TIMESTAMP '2024-01-10' OR event_id % 5 = 0")
def d10_ttl_filter(spark, d):
    c = read(spark, d, "events").select(F.col("event_id").alias("key"), F.when(F.col("event_id") % 5 == 0, None).otherwise(F.col("ts")).alias("expires_at"), "ts")
    return ST.ttl_filter(c, F.lit(datetime.datetime(2024, 1, 10)).cast("timestamp_ntz")).select("key", F.col("ts").alias("expires_at"))


@query(f"WITH {FILES} SELECT kind, count(*) AS n FROM (SELECT 'file' AS kind FROM files UNION ALL SELECT 'symbol' FROM part) WHERE kind = 'symbol' GROUP BY 1")
def p7_filter_kinds(spark, d):
    return P.filter_kinds(_entities(spark, d), ["symbol"]).groupBy("kind").agg(F.count("*").alias("n"))


@contextmanager
def _rocks(spark):
    """Streams with states of their own keep them in RocksDB."""
    key, rocks = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key, None)
    spark.conf.set(key, rocks)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def _streamed(spark, df, transform, mode="append"):
    """df written to the shared folder, read as a stream through transform in one micro-batch, and what comes out read back.

    Not availableNow: a query whose state has a time to live would run empty micro-batches for ever."""
    root = f"{shared_folder(spark)}/cm-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/in")
    with _rocks(spark):
        out = transform(spark.readStream.schema(df.schema).parquet(f"{root}/in"))
        w = out.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(once=True)
        if mode == "append":
            w.format("parquet").start(f"{root}/out").awaitTermination()
        else:  # all groups so far, each time
            w.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{root}/out")).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{root}/out")


@query("""WITH RECURSIVE r AS (SELECT event_type AS kind, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS ord, value FROM events
), e AS (SELECT kind, event_id, ord, value AS ema FROM r WHERE ord = 1
UNION ALL SELECT r.kind, r.event_id, r.ord, CASE WHEN e.ema = 0 THEN r.value ELSE floor(0.7::DOUBLE * e.ema + 0.3::DOUBLE * r.value + 0.5::DOUBLE) END FROM e JOIN r ON r.kind = e.kind AND r.ord = e.ord + 1) SELECT kind, event_id, ema FROM e""")
def d7_stream_latency_ema(spark, d):
    """Events in four files, dealt out without regard to time, a micro-batch each; an event far in the future then moves the watermark past all."""
    e = _events(spark, d).select("kind", "event_id", "ts", "value")
    root = f"{shared_folder(spark)}/cm-{uuid.uuid4().hex}"
    dealt = e.withColumn("file", F.pmod(F.xxhash64("event_id"), F.lit(4)))
    for k in range(4):
        dealt.where(F.col("file") == k).drop("file").coalesce(1).write.mode("append").parquet(f"{root}/in")
    e.agg(F.lit("end").alias("kind"), F.lit(-1).cast("long").alias("event_id"), (F.max("ts") + F.expr("INTERVAL 730 DAYS")).alias("ts"), F.lit(1.0).alias("value")).coalesce(1).write.mode("append").parquet(f"{root}/in")
    with _rocks(spark):
        source = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
        ST.write_averages(ST.stream_latency_ema(source, late="365 days"), f"{root}/out", f"{root}/state").awaitTermination()
    return spark.read.parquet(f"{root}/out/averages").where("event_id >= 0").select("kind", "event_id", "ema")


@query("SELECT user_id::VARCHAR AS scope, 3000::DOUBLE AS token_limit FROM events GROUP BY user_id HAVING sum(floor(value)) > 3000")
def d8_stream_limit_alerts(spark, d):
    usage = _events(spark, d).select(F.col("user_id").cast("string").alias("scope"), "tokens")
    limits = usage.select("scope").distinct().withColumn("token_limit", F.lit(3000.0))
    return _streamed(spark, usage, lambda s: ST.stream_limit_alerts(s, limits)).select("scope", "token_limit")


@query("SELECT 'src/p' || p_partkey || '.ts' AS path, b.name, b.kind FROM part, LATERAL (VALUES ('Part' || p_partkey, 'class'), ('size', 'method'), ('make' || p_partkey, 'function'), ('x', 'constant')) AS b(name, kind)")
def d3_stream_incremental_index(spark, d):
    """Every file arrives twice; the stored context is what one indexing of all gives."""
    root = f"{shared_folder(spark)}/cm-{uuid.uuid4().hex}"
    src = _sources(spark, d).select("path", "content")
    src.unionByName(src).write.parquet(f"{root}/in")
    ST.stream_incremental_index(spark.readStream.schema(src.schema).parquet(f"{root}/in"), E.extract_symbols, f"{root}/store", f"{root}/state").awaitTermination()
    return corpus.load_context(spark, f"{root}/store")["symbols"].select("path", "name", "kind")
