"""Site-relative line deduplication: lines that a large share of a site's pages carry are boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def boilerplate(pages: DataFrame, ratio: float, min_pages: int) -> DataFrame:
    """pages (site, lines) -> site, keys: the line keys on more than ratio of the site's pages and on min_pages at least.

    A site has at most (mean lines a page) / ratio such lines, so the array is bounded. Counting is by partial sums:
    a page counts once for a line, however often the line stands in it.
    """
    lines = pages.select("site", F.explode(F.array_distinct(F.transform(F.filter("lines", lambda x: F.trim(x) != ""), _key))).alias("key"))
    seen = lines.groupBy("site", "key").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    totals = pages.groupBy("site").agg(F.count("*").alias("pages"))
    often = seen.join(totals, "site").where(F.col("n") > F.col("pages") * ratio)
    return often.groupBy("site").agg(F.collect_list("key").alias("keys"))


def drop_site_lines(docs: DataFrame, site: Column | str, text: str = "text", ratio: float = 0.1, min_pages: int = 5, into: str | None = None, dropped: str | None = None) -> DataFrame:
    """docs with boilerplate lines cut out of the text column (or a copy of it, into); rows and other columns unchanged.

    site: an expression over docs, or the name of a column (a missing one: all rows are of one site).
    A line (cut at \\n, compared without outer spaces) goes from every page of a site when more than ratio of the
    site's pages, and at least min_pages, carry it. Blank lines stay. Null texts stay null and count as pages; a null site is
    a site of its own; repeated rows count as pages of their own; an empty table stays empty; a text of any
    length is cut whole. dropped: an extra column with the number of lines cut; columns named like into or dropped are
    replaced, others may have any names.
    """
    if isinstance(site, str):
        own, of = C.by_position(docs)
        own = own.withColumn("site_of", F.lit("") if C.column_of(of, site) is None else F.col(C.column_of(of, site)).cast("string"))
    else:
        own, of = C.by_position(docs.select("*", site.cast("string")))
    key = own.columns[-1]  # the site stands last
    body = F.col(C.column_of(of, text))
    lines = F.split(body, "\n", -1)
    own = own.withColumn(key, F.coalesce(F.col(key), F.lit("")))
    rare = C.table(boilerplate(own.select(F.col(key).alias("site"), lines.alias("lines")), ratio, min_pages), "boilerplate")
    rare = C.broadcast_if_small(rare)
    named = own.join(rare, F.col(key) == F.col("site"), "left")
    stay = F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains("keys", _key(x)))
    cut = F.when(F.col("keys").isNull(), body).otherwise(F.array_join(stay, "\n"))
    n_cut = F.when(F.col("keys").isNull(), 0).otherwise(F.coalesce(F.size(lines) - F.size(stay), F.lit(0))).cast("long")
    put = {into or text: cut} | ({dropped: n_cut} if dropped else {})
    out = [(c, put.pop(c).alias(c) if c in put else F.col(mine)) for c, mine in zip(docs.columns, own.columns)]
    out += [(c, value) for c, value in put.items()]
    return named.select(*[value for _, value in out]).toDF(*[c for c, _ in out])


def visible_lines(html: Column) -> Column:
    """Text of a web page with one line a block element: scripts, styles, comments and tags are cut away."""
    bare = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", "")
    return F.regexp_replace(F.regexp_replace(bare, r"(?i)</?(?:p|div|li|ul|ol|br|h[1-6]|nav|article|section|header|footer|title|head|body|html|table|tr|td|th)\b[^>]*>", "\n"), r"<[^>]*>", "")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
