"""Extraction: symbols, imports and references of source lines, links of pages, cached enrichment."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeResult
from pyspark.sql.window import Window

from ..functions import scalars as S
from .stored import dealt, stored, together

_DECLARATION = r"^\s*(export\s+)?(default\s+)?((?:(?:public|private|protected|static|async|abstract|readonly|declare)\s+)*)(class|interface|enum|function|type|namespace|const|let|var|def)\s+\*?([A-Za-z_$][\w$]*)"
_METHOD = r"^\s+((?:(?:public|private|protected|static|async|readonly|get|set)\s+)*)([A-Za-z_$][\w$]*)\s*\([^;]*\)\s*(?::[^{;]+)?\{\s*$"
_NO_METHODS = ["if", "for", "while", "switch", "catch", "return", "function"]
_KIND = {"type": "type-alias", "const": "constant", "let": "variable", "var": "variable", "def": "function"}


#: Strings, templates and comments, whole or up to where they are left open: a string to the end of its line, the others to the end of the file. Possessive, so that none is too long.
_SINGLE, _DOUBLE = r"'(?:[^'\\\r\n]|\\[^\r\n])*+'?", r'"(?:[^"\\\r\n]|\\[^\r\n])*+"?'
_HOLE = rf"\$\{{(?:[^{{}}'\"`]|{_SINGLE}|{_DOUBLE}|\{{[^{{}}`]*+\}})*+\}}"
_QUIET = rf"//[^\r\n]*+|/\*(?:[^*]|\*(?!/))*+(?:\*/)?|{_DOUBLE}|{_SINGLE}|`(?:[^`\\$]|\\[\s\S]|{_HOLE}|\$)*+`?"


def code_only(content: Column) -> Column:
    """The content with what stands in strings, templates and comments taken out; line breaks stay where they are.

    One expression finds them from left to right, so a quote in a comment opens no string and a comment sign in a string no
    comment. A template's holes go with it, braces one deep among them; templates inside holes and the language's own regular expressions
    are not told apart.
    """
    between, quiet = F.split(content, _QUIET, -1), F.regexp_extract_all(content, F.lit(_QUIET), 0)
    breaks = F.transform(quiet, lambda q: F.regexp_replace(q, r"[^\n]++", ""))
    return F.array_join(F.zip_with(between, breaks, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")


def source_lines(files: DataFrame, code: bool = False) -> DataFrame:
    """path, line (from 1), text; and with code, the line without strings, templates and comments."""
    cut = lambda c: F.split(c, "\r?\n", -1)
    if not code:
        return files.select("path", F.posexplode(cut(F.col("content"))).alias("pos", "text")).select("path", (F.col("pos") + 1).alias("line"), "text")
    both = files.select("path", F.posexplode(F.arrays_zip(cut(F.col("content")).alias("text"), cut(code_only(F.col("content"))).alias("code"))).alias("pos", "x"))
    return both.select("path", (F.col("pos") + 1).alias("line"), "x.text", "x.code")


def brace_depth(lines: DataFrame) -> DataFrame:
    """lines with the depth of open braces before (depth) and after (depth_after) each: a running sum within a file. Braces are those of code, where lines have it, else of text."""
    of = "code" if "code" in lines.columns else "text"
    delta = F.length(F.regexp_replace(of, r"[^{]", "")) - F.length(F.regexp_replace(of, r"[^}]", ""))
    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("depth_after", F.sum(delta).over(w)).withColumn("depth", F.col("depth_after") - delta)


def block_ends(openers: DataFrame, lines: DataFrame) -> DataFrame:
    """openers (path, line, depth), lines of brace_depth() -> path, line, end_line: the first later line that closes down to the opener's depth.

    A line that closes braces meets every depth that it goes down to; openers and closers of one depth in a file are read once,
    backwards, instead of every opener against every closing line.
    """
    of = "code" if "code" in lines.columns else "text"
    closing = lines.where(F.contains(of, F.lit("}")))
    braces = F.split(F.regexp_replace(of, r"[^{}]", ""), "")
    step = lambda s, c: F.struct(*[x.alias(n) for n, x in (("at", s["at"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)), ("low", F.least(s["low"], s["at"] + F.when(c == "}", -1).otherwise(0))))])
    low = F.aggregate(braces, F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")), step)["low"]
    closers = closing.withColumn("low", low).where("low < 0").select("path", F.explode(F.sequence(F.col("depth") + F.col("low"), F.col("depth") - 1)).alias("depth"), "line", F.col("line").alias("close"))
    both = openers.select("path", "depth", "line", F.lit(None).cast("int").alias("close")).unionByName(closers)
    later = Window.partitionBy("path", "depth").orderBy(F.desc("line")).rangeBetween(Window.unboundedPreceding, -1)
    return both.withColumn("end_line", F.last("close", ignorenulls=True).over(later)).where("close IS NULL AND end_line IS NOT NULL").select("path", "line", "end_line")


def _lines_that_count(files: DataFrame) -> DataFrame:
    """A row for each line that declares something or has braces: path, line, text, before (the line before it), delta and low (what its braces add to
    the depth, and the least they reach on their way), d (what a declaration says) and m (what may be a method).

    Files move once, to their path's partition, and all that extract_symbols() does is done there: lines are looked at once, and no line moves.
    """
    cut = lambda c: F.split(c, "\r?\n", -1)
    whole = dealt(files.select("path", "content")).select("path", cut(F.col("content")).alias("texts"), cut(code_only(F.col("content"))).alias("codes"))
    group = lambda code, pattern, i: F.regexp_extract(code, pattern, i)
    step = lambda s, c: F.struct(*[x.alias(k) for k, x in (("at", s["at"] + F.when(c == "{", 1).otherwise(-1)), ("low", F.least(s["low"], s["at"] + F.when(c == "}", -1).otherwise(0))))])

    def line(code, i):
        declared = F.when(code.rlike(_DECLARATION), F.struct(
            *[group(code, _DECLARATION, k).alias(name) for k, name in ((4, "kind"), (5, "name"), (3, "words"))],
            (group(code, _DECLARATION, 1) != "").alias("exported"), (group(code, _DECLARATION, 2) != "").alias("is_default"),
        ))
        method = F.when(code.rlike(_METHOD), F.struct(group(code, _METHOD, 2).alias("name"), group(code, _METHOD, 1).alias("words")))
        braces = F.when(F.contains(code, F.lit("{")) | F.contains(code, F.lit("}")), F.regexp_replace(code, r"[^{}]++", "")).otherwise("")
        return F.struct(i.alias("pos"), declared.alias("d"), method.alias("m"), braces.alias("braces"))

    counts = lambda x: x["d"].isNotNull() | (x["braces"] != "")  # noqa: E731 - a method opens a brace
    at = lambda x, i: F.when(x["d"].isNotNull() | x["m"].isNotNull(), F.get("texts", i))
    told = lambda x: F.struct(x["pos"].alias("pos"), x["d"].alias("d"), x["m"].alias("m"), x["braces"].alias("braces"), at(x, x["pos"]).alias("text"), at(x, x["pos"] - 1).alias("before"))
    each = whole.select("path", F.explode(F.transform(F.filter(F.transform("codes", line), counts), told)).alias("x"))
    low = F.aggregate(F.split("x.braces", ""), F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")), lambda s, c: F.when(c == "", s).otherwise(step(s, c)))["low"]
    falls = F.when(F.contains("x.braces", F.lit("}")), low).otherwise(0)
    delta = 2 * F.length(F.translate("x.braces", "}", "")) - F.length("x.braces")
    return each.select("path", (F.col("x.pos") + 1).alias("line"), "x.text", "x.before", delta.alias("delta"), falls.alias("low"), "x.d", "x.m")


def extract_symbols(files: DataFrame) -> DataFrame:
    """Declarations found line by line: id, path, name, kind, start_line, start_col, end_line, parent_id, visibility,
    exported, modifiers, documentation. A rule of thumb over lines and braces, not a parser of any language; braces and
    declarations in strings, templates and comments do not count."""
    running = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    lines = _lines_that_count(files).withColumn("depth_after", F.sum("delta").over(running)).withColumn("depth", F.col("depth_after") - F.col("delta"))
    mapped = F.col("d.kind")
    for a, b in _KIND.items():
        mapped = F.when(F.col("d.kind") == a, b).otherwise(mapped)
    is_method = F.col("d").isNull() & ~F.col("m.name").isin(_NO_METHODS) & (F.col("depth") > 0)
    declared = F.coalesce(F.col("d").isNotNull() | is_method, F.lit(False))
    symbol = F.struct(
        F.when(F.col("d").isNull(), "method").otherwise(mapped).alias("kind"), F.coalesce("d.name", "m.name").alias("name"), F.coalesce("d.words", "m.words").alias("words"),
        F.coalesce("d.exported", F.lit(False)).alias("exported"), F.coalesce("d.is_default", F.lit(False)).alias("is_default"), "text", "before", "depth",
    )
    # a line goes to the depth that it opens, if it declares something there, and to every depth that it closes down to; the next closer of a depth ends what opened it
    opens = F.col("depth_after") > F.col("depth")
    own = F.when(declared, F.array(F.struct(F.when(opens, F.col("depth")).alias("level"), symbol.alias("s"))))
    closes = F.when(F.col("low") < 0, F.transform(F.sequence(F.col("depth") + F.col("low"), F.col("depth") - 1), lambda k: F.struct(k.alias("level"), F.when(F.lit(False), symbol).alias("s"))))
    events = lines.select("path", "line", F.explode(F.concat(F.coalesce(own, F.array()), F.coalesce(closes, F.array()))).alias("e")).select("path", "line", "e.level", "e.s")
    later = Window.partitionBy("path", "level").orderBy(F.desc("line")).rangeBetween(Window.unboundedPreceding, -1)
    ended = events.withColumn("end_line", F.last(F.when(F.col("s").isNull(), F.col("line")), ignorenulls=True).over(later)).where("s IS NOT NULL")
    ended = ended.select("path", F.col("line").alias("start_line"), "level", "s.*", F.when(F.col("level").isNull(), F.col("line")).otherwise(F.coalesce("end_line", "line")).alias("end_line"))
    modifiers = F.filter(F.concat(F.split(F.trim("words"), r"\s+"), F.when(F.col("is_default"), F.array(F.lit("default"))).otherwise(F.array(F.lit("")))), lambda m: m != "")
    visibility = F.when(F.array_contains("modifiers", "private"), "private").when(F.array_contains("modifiers", "protected"), "protected").otherwise("public")
    column = F.length(F.regexp_extract("text", r"^\s*", 0))
    note = F.regexp_extract("before", r"^\s*(?://+|#|\*+|/\*\*?)\s*(.*?)\s*(?:\*/)?\s*$", 1)
    is_box = F.col("kind").isin("class", "interface", "enum", "namespace") & (F.col("end_line") > F.col("start_line"))
    out = ended.withColumns({"modifiers": modifiers, "start_col": column}).select(
        S.symbol_id(F.col("path"), F.col("name"), F.col("start_line"), F.col("start_col")).alias("id"), "path", "name", "kind", "start_line", "start_col", "end_line",
        visibility.alias("visibility"), "exported", "modifiers", F.nullif(note, F.lit("")).alias("documentation"), "depth", F.when(is_box, F.col("level")).alias("box"),
    )
    # what holds a symbol was opened at a lesser depth, and what of each depth was opened last has not ended: each symbol asks the depths of its file's classes
    levels = F.collect_set("box").over(Window.partitionBy("path"))
    row = F.struct(*[c for c in out.columns if c not in ("depth", "box", "path")])
    asked = F.transform(F.filter(F.col("levels"), lambda k: k < F.col("depth")), lambda k: F.struct(k.alias("level"), F.lit(False).alias("opened")))
    tells = F.when(F.col("box").isNotNull(), F.array(F.struct(F.col("box").alias("level"), F.lit(True).alias("opened")))).otherwise(F.array())
    none = F.array(F.struct(F.lit(None).cast("bigint").alias("level"), F.lit(False).alias("opened")))  # each symbol has a row of its own
    events = out.withColumn("levels", levels).select("path", F.col("start_line").alias("line"), row.alias("s"), F.explode(F.concat(none, asked, tells)).alias("e")).select("path", "line", "s", "e.level", "e.opened")
    sooner = Window.partitionBy("path", "level").orderBy("line").rangeBetween(Window.unboundedPreceding, -1)
    box = F.last(F.when(F.col("opened"), F.struct("line", F.col("s.end_line").alias("hi"), F.col("s.id").alias("id"))), ignorenulls=True).over(sooner)
    held = events.withColumn("b", F.when(F.col("level").isNotNull(), box)).where("not opened")
    inner = F.max_by("b.id", F.when(F.col("b.hi") >= F.col("line"), F.col("b.line")))
    return held.groupBy("path", "line").agg(F.first(F.when(F.col("level").isNull(), F.col("s")), ignorenulls=True).alias("s"), inner.alias("parent_id")).select("s.id", "path", *[f"s.{c}" for c in out.columns if c not in ("id", "path", "depth", "box")], "parent_id")


def extract_imports(files: DataFrame) -> DataFrame:
    """from_path, name, imported_name, specifier, is_default: a row for each name that an import or export-from binds."""
    stmt = r"""(?m)^\s*(?:import|export)\s+(?:type\s+)?([^'";]*?)\s*from\s*['"]([^'"]+)['"]"""
    each = files.select(F.col("path").alias("from_path"), F.explode(F.arrays_zip(F.regexp_extract_all("content", F.lit(stmt), 1).alias("b"), F.regexp_extract_all("content", F.lit(stmt), 2).alias("s"))).alias("m"))
    each = each.select("from_path", F.col("m.b").alias("bindings"), F.col("m.s").alias("specifier"))
    braces = F.regexp_extract("bindings", r"\{([^}]*)\}", 1)
    plain = F.trim(F.regexp_replace(F.regexp_replace("bindings", r"\{[^}]*\}", ""), r"[,\s]+$", ""))
    named = each.select("from_path", "specifier", F.explode(F.filter(F.transform(F.split(braces, ","), lambda x: F.trim(x)), lambda x: x != "")).alias("b"))
    named = named.select("from_path", F.regexp_extract("b", r"([A-Za-z_$][\w$]*)$", 1).alias("name"), F.regexp_extract("b", r"^(?:type\s+)?([A-Za-z_$][\w$]*)", 1).alias("imported_name"), "specifier", F.lit(False).alias("is_default"))
    whole = each.where(plain != "").select("from_path", F.regexp_extract(plain, r"([A-Za-z_$*][\w$]*)\s*$", 1).alias("name"), F.when(plain.startswith("*"), F.lit("*")).otherwise(F.lit("default")).alias("imported_name"), "specifier", (~plain.startswith("*")).alias("is_default"))
    return named.unionByName(whole)


def extract_references(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """ref_id, path, name, kind, line of uses of known names: construct, extends, implements, property, call, write, read.

    A word may stand in every file, so its uses are never sorted or held: they pass by the known names, which are.
    """
    symbols = stored(symbols.select("path", "name", F.col("start_line").alias("line")))  # read twice
    one = r"(?:\b(new|extends|implements)\s+)?(\.)?([A-Za-z_$][\w$]*)(\s*\(|\s*=(?![=>]))?"
    m = F.arrays_zip(*[F.regexp_extract_all("text", F.lit(one), i).alias(k) for i, k in ((1, "before"), (2, "dot"), (3, "name"), (4, "after"))])
    uses = source_lines(dealt(files.select("path", "content"))).select("path", "line", F.posexplode(m).alias("n", "m")).select("path", "line", "n", "m.*")
    known = symbols.select("name").distinct()
    uses = uses.join(known.hint("shuffle_hash"), "name", "left_semi")
    kind = (
        F.when(F.col("before") == "new", "construct").when(F.col("before") != "", F.col("before")).when(F.col("after").rlike(r"\("), "call")
        .when(F.col("dot") != "", "property").when(F.col("after") != "", "write").otherwise("read")
    )
    own = symbols.distinct()
    uses = uses.join(own.hint("shuffle_hash"), ["path", "name", "line"], "left_anti")
    return uses.select(F.concat_ws(":", "path", "line", "n").alias("ref_id"), "path", "name", kind.alias("kind"), "line")


def extract_links(pages: DataFrame) -> DataFrame:
    """page_id, host, pos, href of every link of HTML pages."""
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)
    return pages.select("page_id", host.alias("host"), F.posexplode(F.regexp_extract_all("html", F.lit(r'href="([^"]+)"'), 1)).alias("pos", "href"))


def extract_with(files: DataFrame, parsers: dict[str, Callable[[str, str], list[dict]]], schema: str) -> tuple[DataFrame, DataFrame]:
    """files (path, language, content) through the parser of their language -> rows of schema, and skipped (path, reason).

    A file without a parser, or whose parser raises, is a skipped row; the job goes on.
    """
    full = T.StructType([T.StructField("path", T.StringType()), T.StructField("reason", T.StringType()), T.StructField("row", T._parse_datatype_string(schema))])

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            out = []
            for path, language, content in zip(pdf["path"], pdf["language"], pdf["content"]):
                try:
                    out += [(path, None, row) for row in parsers[language](path, content)]
                except KeyError as e:
                    out.append((path, f"unsupported language: {language}" if language not in parsers else f"KeyError: {e}", None))
                except Exception as e:
                    out.append((path, f"{type(e).__name__}: {e}", None))
            yield pd.DataFrame(out, columns=["path", "reason", "row"])

    done = files.select("path", "language", "content").mapInPandas(run, full)
    return done.where("reason is null").select("row.*"), done.where("reason is not null").select("path", "reason")


def register_parsers(spark: SparkSession, parsers: dict[str, tuple[str, dict[str, Callable[[str, str], list[dict]]]]], name: str = "parse_source") -> None:
    """Registers a table function for SQL: FROM files, LATERAL name('kind', path, language, content).

    parsers: kind -> (schema, parser of each language). The kind, a constant, decides the columns; `skipped` comes last: why a file has no row of
    its own, as in extract_with(). A file that is skipped is one row with nulls in the parser's columns.
    """
    made = {kind: (T._parse_datatype_string(schema), of) for kind, (schema, of) in parsers.items()}
    made = {kind: (T.StructType([T.StructField(f.name, f.dataType, True) for f in row] + [T.StructField("skipped", T.StringType())]), of) for kind, (row, of) in made.items()}

    class Parse:
        @staticmethod
        def analyze(kind, path, language, content):
            if not kind.isConstantExpression or kind.value not in made:
                raise ValueError(f"the first argument must be one of {sorted(made)}")
            return AnalyzeResult(schema=made[kind.value][0])

        def eval(self, kind, path, language, content):
            row, of = made[kind]
            names = row.names[:-1]
            try:
                rows = list(of[language](path, content))
            except Exception as e:
                rows = [f"unsupported language: {language}" if language not in of else f"{type(e).__name__}: {e}"]
            for r in rows:
                yield (None,) * len(names) + (r,) if isinstance(r, str) else tuple(r.get(n) for n in names) + (None,)

    spark.udtf.register(name, udtf(Parse))


def cache_key(kind: Column, text: Column) -> Column:
    return F.concat(F.lit("summary:"), kind, F.lit(":"), S.content_hash(text))


def scope_keys(files: DataFrame) -> DataFrame:
    """files (path, hash) -> target, kind (file, folder), depth, key: a key for each file and for each folder above one, '' the root.

    A file's key is the SHA-256 of its path, '|' and its hash; a folder's that of its path, '|' and its children's keys, sorted and put together. Level by level,
    the deepest first: a changed file changes its own folders' keys and no others.
    """
    parent = lambda c: F.regexp_extract(c, r"^(.*)/[^/]*$", 1)
    deep = lambda c: F.size(F.split(c, "/", -1))
    leaves = files.select(F.col("path").alias("target"), F.lit("file").alias("kind"), deep(F.col("path")).alias("depth"), F.sha2(F.concat_ws("|", "path", "hash"), 256).alias("key"))
    levels, below = [stored(leaves)], None
    for depth in range(levels[0].agg(F.max("depth")).first()[0] or 0, 0, -1):
        here = levels[0].where(F.col("depth") == depth).select("target", "key")
        here = here.unionByName(below.select("target", "key")) if below is not None else here
        up = here.groupBy(F.when(F.contains("target", F.lit("/")), parent(F.col("target"))).otherwise("").alias("target")).agg(F.array_join(F.sort_array(F.collect_list("key")), "").alias("keys"))
        below = stored(up.select("target", F.lit("folder").alias("kind"), F.lit(depth - 1).alias("depth"), F.sha2(F.concat_ws("|", "target", "keys"), 256).alias("key")))
        levels.append(below)
    return together(levels)


def roll_up(files: DataFrame, contents: DataFrame, cache: DataFrame, fn: Callable[[str], str], now) -> DataFrame:
    """A value of each folder by enrich_with_cache(), under its scope key: id, key, value, cache_hit, error.

    contents (target, content) says what fn sees of a folder. Only folders above something that changed since the cache was filled are computed.
    """
    scopes = scope_keys(files).where("kind = 'folder'").join(contents, "target").select(F.col("target").alias("id"), F.concat(F.lit("scope:"), "key").alias("key"), "content")
    return enrich_with_cache(scopes, cache, fn, now)


def live_entries(cache: DataFrame, now) -> DataFrame:
    """Cache entries (key, value, expires_at) without an end or with one still to come."""
    return cache.where(F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now)))


def enrich_with_cache(items: DataFrame, cache: DataFrame, fn: Callable[[str], str], now) -> DataFrame:
    """items (id, key, content) -> id, key, value, cache_hit, error. Live entries are used; each missing key is computed once.

    fn sees one content of each missing key; where it raises, the row has an error and no value.
    """
    live = live_entries(cache, now).groupBy("key").agg(F.max("value").alias("value"))
    missing = items.join(live, "key", "left_anti").groupBy("key").agg(F.min("content").alias("content"))

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            values, errors = [], []
            for content in pdf["content"]:
                try:
                    values.append(fn(content)), errors.append(None)
                except Exception as e:
                    values.append(None), errors.append(f"{type(e).__name__}: {e}")
            yield pdf[["key"]].assign(value=values, error=errors)

    made = missing.mapInPandas(run, "key string, value string, error string").withColumn("cache_hit", F.lit(False))
    have = live.select("key", "value", F.lit(None).cast("string").alias("error"), F.lit(True).alias("cache_hit"))
    return items.select("id", "key").join(made.unionByName(have), "key", "left").select("id", "key", "value", "cache_hit", "error")
