"""Ranked search for whole tables of queries: postings, candidates by equi joins, tiered scores, top hits."""

from __future__ import annotations

from collections.abc import Callable
from inspect import signature

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed as X
from ..functions import scalars as S
from .stored import bucketed, buckets_for, forget, stored

KIND_ORDER = ["file", "symbol", "module", "summary", "dependency"]
_WORD = r"[^a-z0-9_]+"
#: Pairs of term and word that go to every task.
FEW = 500_000


def build_search_entities(files: DataFrame | None = None, symbols: DataFrame | None = None, modules: DataFrame | None = None, summaries: DataFrame | None = None, dependencies: DataFrame | None = None, clip: int | None = None) -> DataFrame:
    """One table of everything that can be found: kind, key, title, path, def_kind, name (identifier), body, search_text.

    search_text is the lower-cased name, path and body. clip: keep so many characters of a body only (X.CLIP_CHARS); words
    behind them are then not found. Widths of identifiers (identifier_lengths) let fuzzy candidates be cut by length.
    """
    parts = []
    whole = lambda c: F.coalesce(c, F.lit("")) if clip is None else F.substring(F.coalesce(c, F.lit("")), 1, clip)
    null = F.lit(None).cast("string")

    def part(df, kind, key, title, path, def_kind, name, body):
        parts.append(df.select(F.lit(kind).alias("kind"), key.alias("key"), title.alias("title"), path.alias("path"), def_kind.alias("def_kind"), name.alias("name"), whole(body).alias("body")))

    if files is not None:
        part(files, "file", F.col("path"), S.basename(F.col("path")), F.col("path"), null, S.basename(F.col("path")), F.col("content"))
    if symbols is not None:
        part(symbols, "symbol", F.concat(F.lit("symbol:"), "id"), F.col("name"), F.col("path"), F.col("kind"), F.col("name"), null)
    if modules is not None:
        part(modules, "module", F.concat(F.lit("module:"), "path"), F.col("name"), F.col("path"), null, F.col("name"), null)
    if summaries is not None:
        part(summaries, "summary", F.concat(F.lit("summary:"), "kind", F.lit(":"), "target"), F.col("target"), F.col("target"), null, F.col("target"), F.col("overview"))
    if dependencies is not None:
        part(dependencies, "dependency", F.concat(F.lit("dependency:"), "src", F.lit("::"), "kind", F.lit("::"), "dst"), F.concat("src", F.lit(" -> "), "dst"), null, null, F.col("kind"), F.concat_ws(" ", "src", "dst"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    text = S.normalize_text(F.concat_ws("\n", "name", "path", "body"))
    return out.withColumn("search_text", text).withColumn("identifier_lengths", F.array_distinct(F.transform(F.filter(F.split(F.lower("name"), _WORD), lambda t: t != ""), F.length)))


def query_term_table(queries: DataFrame) -> DataFrame:
    """queries (query_id, q) -> query_id, pos, term, phrase; blank queries and those without terms have no row."""
    terms = queries.where(S.strip(F.col("q")) != "").select("query_id", S.strip(F.lower("q")).alias("phrase"), F.posexplode(S.query_terms(F.col("q"))).alias("pos", "term"))
    return terms.dropDuplicates(["query_id", "term"])


def _dealt(entities: DataFrame, n: int | None = None) -> DataFrame:
    """Entities dealt out by key to n parts: a file of them that is read by one task is not cut into words by that one."""
    return entities.repartition(n or int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key")


def build_postings(entities: DataFrame) -> DataFrame:
    """(token, key, in_name) for every different word of an entity's name, path and body."""
    entities = _dealt(entities.select("key", "name", "search_text"))
    name = F.filter(F.split(F.lower(F.coalesce("name", F.lit(""))), _WORD), lambda t: t != "")
    every = F.array_distinct(F.filter(F.split("search_text", _WORD), lambda t: t != ""))
    return entities.select("key", name.alias("__own"), F.explode(every).alias("token")).select("token", "key", F.array_contains("__own", F.col("token")).alias("in_name"))


def grams(c: Column, n: int = 3) -> Column:
    """Different substrings of n characters; a shorter text is its own only gram."""
    return F.when(F.length(c) <= n, F.array(c)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))))


def vocabulary_matches(terms: DataFrame, tokens: DataFrame) -> DataFrame:
    """terms (term) and tokens (token, ...), both distinct -> term and the columns of each token that holds the term.

    The candidates share the term's rarest 3-gram (2-letter terms: their own 2-gram), so no pair is tried without one. The rarest
    grams are stored: where they measure small, as those of few terms do, they go to the tokens and no gram of a token moves.
    """
    short, long = terms.where(F.length("term") < 3), terms.where(F.length("term") >= 3)
    out = None
    for t, n in ((short, 2), (long, 3)):
        posted = tokens.where(F.length("token") >= n).select("*", F.explode(grams(F.col("token"), n)).alias("g"))
        asked = t.select("term", F.explode(grams(F.col("term"), n)).alias("g"))
        freq = posted.join(asked.select("g").distinct(), "g", "left_semi").groupBy("g").agg(F.count("*").alias("df"))
        rarest = stored(asked.join(freq, "g", "left").na.fill(0, ["df"]).groupBy("term").agg(F.min_by("g", F.struct("df", "g")).alias("g")))
        hit = rarest.join(posted, "g").where(F.contains("token", F.col("term"))).select("term", *tokens.columns)
        out = hit if out is None else out.unionByName(hit)
    return out


def fuzzy_join(terms: DataFrame, identifiers: DataFrame) -> DataFrame:
    """terms (term), identifiers (token) -> term, token, distance: all pairs within the term's fuzzy threshold k.

    A term cut into k + 1 pieces keeps one of them whole in any token within distance k. If that piece is moved by d there and
    the token is longer by e, the edits before it are |d| at least and those after it |e - d|, and together they are k at most. So
    pairs are joined on (length of the term, number of the piece, its text), tokens giving only those places; each pair found is
    verified with a bounded edit distance. Terms shorter than k + 1 have threshold 0.
    """
    begin = lambda i: F.floor(i * F.col("n") / (F.col("k") + 1)).cast("int")
    t = terms.where(F.length("term") > 0).select("term", F.length("term").alias("n"), S.fuzzy_threshold(F.length("term")).alias("k"))
    cut = lambda df: df.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k")))).withColumns({"at": begin(F.col("i")), "len": begin(F.col("i") + 1) - begin(F.col("i"))})
    asked = cut(t).select("term", "n", "i", "k", F.expr("substring(term, at + 1, len)").alias("piece"))
    # the lengths of terms that a token of m letters can meet: |m - n| <= k, and k is 1, 2 or a quarter of n, rounded up
    lengths = t.select("n", "k").distinct()
    m = F.length("token")
    ids = identifiers.where(m > 0).select("token", m.alias("m"), F.explode(F.sequence(F.greatest(F.lit(1), (m * 3 / 4).cast("int") - 3), (m * 4 / 3).cast("int") + 3)).alias("n"))
    ids = ids.join(lengths, "n").withColumn("e", F.col("m") - F.col("n")).where(F.abs("e") <= F.col("k"))
    moved = cut(ids).withColumn("d", F.explode(F.sequence(-F.col("k"), F.col("k")))).where("abs(d) + abs(e - d) <= k and at + d >= 0 and at + d + len <= m")
    posted = moved.select("token", "n", "i", F.expr("substring(token, at + d + 1, len)").alias("piece"))
    pairs = asked.join(posted, ["n", "i", "piece"]).select("term", "token", "k").distinct()
    return pairs.withColumn("distance", F.levenshtein("term", "token")).where("distance <= k").select("term", "token", "distance")


def lexical_score(term: Column, name: Column, text: Column, fuzzy: Column, word: Column | None = None) -> Column:
    """Name: exact 1, prefix 0.8, whole token 0.6, part 0.4, fuzzy 0.3 * similarity; other fields count half.

    word: whether the term is a whole word of the text, where that is known; else the text is split for it.
    """
    n = F.lower(name)
    tokens = lambda c: F.array_contains(F.split(c, _WORD), term)
    own = F.when(n == term, 1.0).when(n.startswith(term), 0.8).when(tokens(n), 0.6).when(F.contains(n, term), 0.4).otherwise(0.0)
    other = F.when(tokens(text) if word is None else word, 0.3).when(F.contains(text, term), 0.2).otherwise(0.0)
    return F.greatest(F.coalesce(own, F.lit(0.0)), F.coalesce(other, F.lit(0.0)), F.coalesce(fuzzy * 0.3, F.lit(0.0)))


def _tie(kind: Column, def_kind: Column) -> Column:
    """Order among equal scores: definitions, then kinds in order."""
    is_def = (kind == "symbol") & F.coalesce(def_kind.isin(X.DEFINITION_KINDS), F.lit(False))
    order = F.coalesce(*[F.when(kind == k, F.lit(i)) for i, k in enumerate(KIND_ORDER)])
    return order + F.when(is_def, 0).otherwise(len(KIND_ORDER))


def search_postings(entities: DataFrame, n: int | None = None) -> DataFrame:
    """(word, key, tie, in_name, at_start, whole): all that scoring needs of an entity, a row for each different word of its
    name and for each of its whole text that the name lacks; those of a key are in one of n parts.

    Words are those of build_postings and, for terms like auth.ts or déjà, the pieces between white space. in_name: from the
    name; at_start: the name begins with it; whole: it is the name.
    """
    entities = _dealt(entities.select("key", "kind", "def_kind", "name", "search_text"), n)
    words = lambda c: F.array_distinct(F.concat(F.split(c, _WORD), F.split(c, r"\s+")))
    cut = entities.select("key", _tie(F.col("kind"), F.col("def_kind")).alias("tie"), F.lower(F.coalesce("name", F.lit(""))).alias("n"), "search_text").withColumn("own", words(F.col("n")))
    each = cut.select("key", "tie", "n", F.size("own").alias("named"), F.posexplode(F.concat("own", F.array_except(words(F.col("search_text")), "own"))).alias("i", "word")).where("word <> ''")
    in_name = F.col("i") < F.col("named")
    return each.select("word", "key", "tie", in_name.alias("in_name"), (in_name & F.startswith("n", F.col("word"))).alias("at_start"), (in_name & (F.col("n") == F.col("word"))).alias("whole"))


def search(entities: DataFrame, queries: DataFrame, limit: int = 20, kinds: list[str] | None = None, fuzzy: bool = True, least: float = 0.0, scorer: Callable[..., Column] | None = None) -> DataFrame:
    """queries (query_id, q) over entities -> query_id, rank, score, kind, key, title, path, snippet.

    A term matches words that hold it or, by edit distance, words of a name. Scores of a query are the mean
    over its terms; ties go to definitions, then kinds in order, then keys. Terms meet the vocabulary and the vocabulary
    meets postings, both by equi joins; lexical_score() follows from the word that matched and its place, so no text is read
    until the best hits are known. scorer(term, name, text, similarity): another score, which reads the texts of all candidates. One with
    a parameter `word` also gets whether the term is a whole word of the text: a text is split once for all of its terms, not once a pair.

    Postings are stored in buckets by key, as many as there are entities to hold, and so are matches: an entity is scored, summed and compared with the
    others of its bucket where it lies, and only a bucket's best of each query move. Of the words that one entity alone has, as most names are,
    only the names' postings move to meet them.
    """
    entities = entities.where(F.col("kind").isin(kinds)) if kinds else entities
    n = buckets_for(entities)
    terms = stored(query_term_table(queries).select("query_id", "term"))
    words = terms.select("term").distinct()
    postings = bucketed(search_postings(entities, n), "key", n)
    vocabulary = postings.groupBy("word").agg(F.bool_or("in_name").alias("named"), F.count("*").alias("n"))
    vocabulary = stored(vocabulary.select(F.col("word").alias("token"), "named", F.col("word").rlike(r"[^a-z0-9_]").alias("odd"), (F.col("named") & (F.col("n") == 1)).alias("alone")))
    odd = F.col("term").rlike(r"[^a-z0-9_]")
    found = None
    for mine, theirs in ((words.where(~odd), vocabulary.where("not odd")), (words.where(odd), vocabulary.where("odd"))):
        part = vocabulary_matches(mine, theirs.select("token", "alone")).select("term", F.col("token").alias("word"), "alone", F.lit(None).cast("double").alias("sim"))
        found = part if found is None else found.unionByName(part)
    if fuzzy:
        near = stored(fuzzy_join(words, vocabulary.where("named and not odd").select("token")))
        sim = 1 - F.col("distance") / F.greatest(F.length("term"), F.length("token"))
        found = found.unionByName(near.join(vocabulary.select("token", "alone"), "token").select("term", F.col("token").alias("word"), "alone", sim.alias("sim")))
    found = stored(found.withColumns({"same": F.col("term") == F.col("word"), "ahead": F.startswith("word", F.col("term")), "odd": odd}))
    held = F.when(F.col("sim").isNotNull(), F.when(F.col("in_name"), F.col("sim") * 0.3).otherwise(0.0)).otherwise(
        F.when(F.col("whole") & F.col("same"), 1.0).when(F.col("at_start") & F.col("ahead"), 0.8).when(F.col("in_name") & F.col("same") & ~F.col("odd"), 0.6)
        .when(F.col("in_name"), 0.4).when(F.col("same") & ~F.col("odd"), 0.3).otherwise(0.2))
    # with a scorer of one's own s is the similarity of a word of the name
    s = held if scorer is None else F.when(F.col("in_name"), F.col("sim"))
    best_of = lambda of: of.groupBy("term", "key").agg(F.max(s).alias("s"), F.first("tie").alias("tie"))
    shared, alone = found.where("not alone"), found.where("alone")
    few = shared.count() <= FEW
    there = best_of((F.broadcast(shared) if few else shared).join(postings, "word"))
    matched = bucketed(there if few else there.repartition(n, "key"), "key", n, best_of(alone.join(postings.where("in_name"), "word")).repartition(n, "key"))
    scored = matched.groupBy("term", "key").agg(F.max("s").alias("s"), F.first("tie").alias("tie"))
    if scorer is None:
        scored = scored.where("s > 0")
    else:
        cand = scored.groupBy("key").agg(F.collect_list(F.struct("term", F.col("s").alias("sim"))).alias("asked"), F.first("tie").alias("tie"))
        texts = cand.hint("shuffle_hash").join(entities.select("key", "name", "search_text"), "key")  # texts move once and are not sorted
        more = {}
        if "word" in signature(scorer).parameters:
            texts = texts.withColumn("whole", F.array_intersect(F.col("asked.term"), F.split("search_text", _WORD)))
            more["word"] = F.array_contains("whole", F.col("a.term"))
        s = scorer(F.col("a.term"), F.col("name"), F.col("search_text"), F.col("a.sim"), **more)
        scored = texts.withColumn("a", F.explode("asked")).select("a.term", "key", "tie", s.alias("s")).where("s > 0")
    n_terms = stored(terms.groupBy("query_id").agg(F.count("*").alias("n")))
    total = terms.join(scored, "term").groupBy("query_id", "key").agg(F.sum("s").alias("s"), F.first("tie").alias("tie")).join(n_terms, "query_id")
    total = total.select("query_id", "key", "tie", F.round(F.col("s") / F.col("n"), 6).alias("score")).where((F.col("score") > 0) & (F.col("score") >= least))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "tie", "key")
    best = stored(total.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).drop("tie"))  # few, and read by whatever uses the hits
    forget(postings, vocabulary, found, matched)
    return best.join(entities.select("kind", "key", "title", "path", "body"), "key").select("query_id", "rank", "score", "kind", "key", "title", "path", S.make_snippet(F.col("body")).alias("snippet"))


def rank_hits(scored: DataFrame, limit: int = 20) -> DataFrame:
    """scored (query_id, key, kind, def_kind, score, ...) with rank: the best limit rows of each query."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), _tie(F.col("kind"), F.col("def_kind")), "key")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def find_symbols(requests: DataFrame, symbols: DataFrame) -> DataFrame:
    """requests (request_id, name, kind?, path?) -> the symbols of that name and, where given, kind and path."""
    r = requests.select("request_id", "name", F.col("kind").alias("want_kind"), F.col("path").alias("want_path"))
    ok = (F.col("want_kind").isNull() | (F.col("kind") == F.col("want_kind"))) & (F.col("want_path").isNull() | (F.col("path") == F.col("want_path")))
    return r.join(symbols, "name").where(ok).drop("want_kind", "want_path")


def lookup_summaries(requests: DataFrame, summaries: DataFrame) -> DataFrame:
    """requests (request_id, target, kind?) -> found and the overview; a summary that is missing is a row, not an error."""
    r = requests.select("request_id", "target", F.col("kind").alias("want"))
    s = summaries.select("target", F.col("kind").alias("summary_kind"), "overview")
    return r.join(s, (r["target"] == s["target"]) & (F.col("want").isNull() | (F.col("want") == F.col("summary_kind"))), "left").select("request_id", r["target"], "summary_kind", F.col("summary_kind").isNotNull().alias("found"), "overview")
