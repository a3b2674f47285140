"""The registered query of each training-data operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontaminate, hard_negatives, kneser_ney, line_dedup, minhash, mixing, packing, resharding, span_dedup, toxicity, warc, weak_rules

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.benchmark_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op2_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), added_tokens=True)


def op3_site_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url", line_dedup.visible_lines(F.col("html")).alias("text"))
    return line_dedup.drop_site_lines(pages, line_dedup.host_of(F.col("url")), dropped="n_dropped").select("page_id", "text", "n_dropped")


def op4_perplexity_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = _read(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return kneser_ney.perplexity_quality(_read(spark, sf_dir, "documents"), trusted)


def op5_sentence_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_dedup.drop_repeated_spans(_read(spark, sf_dir, "documents"), by_content=True)


def op6_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses_from_pages(_read(spark, sf_dir, "pages")))


def op7_min_cost_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = F.crc32(F.coalesce(F.col("source"), F.lit("")).cast("binary"))  # the old layout: 16 shards by source
    placed = resharding.reshard(_read(spark, sf_dir, "documents"), old, shards=24, old_shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard", "moved")


def op8_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"), percent=85)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_weak_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    voted = weak_rules.quality_votes(_read(spark, sf_dir, "documents"))
    return voted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_read(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(_read(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    own = (op1_benchmark_leaks, op2_mixture_packing, op3_site_line_dedup, op4_perplexity_quality, op5_sentence_span_dedup, op6_warc_derivatives, op7_min_cost_resharding, op8_minhash_near_duplicates, op9_toxicity, op10_weak_quality_rules, op11_source_mix, op12_collocations, op13_hard_negatives)
    return {f.__name__: f for f in own}


_LINES_SQL = r"""
WITH p AS (
  SELECT row_number() OVER () AS rid, page_id,
         coalesce(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '') AS site,
         regexp_replace(regexp_replace(regexp_replace(html,
           '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', '', 'g'),
           '(?i)</?(?:p|div|li|ul|ol|br|h[1-6]|nav|article|section|header|footer|title|head|body|html|table|tr|td|th)\b[^>]*>', chr(10), 'g'),
           '<[^>]*>', '', 'g') AS text
  FROM pages
), l AS (
  SELECT DISTINCT rid, site, trim(x) AS line FROM (SELECT rid, site, unnest(string_split(text, chr(10))) AS x FROM p) WHERE trim(x) <> ''
), n AS (SELECT site, line, count(*) AS n FROM l GROUP BY site, line
), t AS (SELECT site, count(*) AS pages FROM p GROUP BY site
), bad AS (SELECT site, list(line) AS keys FROM n JOIN t USING (site) WHERE n >= 5 AND n > pages * 0.1 GROUP BY site
), cut AS (
  SELECT page_id, text, keys, list_filter(string_split(text, chr(10)), lambda x: trim(x) = '' OR NOT list_contains(keys, trim(x))) AS stay
  FROM p LEFT JOIN bad USING (site)
)
SELECT page_id, CASE WHEN keys IS NULL THEN text ELSE array_to_string(stay, chr(10)) END AS text,
       CASE WHEN keys IS NULL THEN 0 ELSE coalesce(len(string_split(text, chr(10))) - len(stay), 0) END::BIGINT AS n_dropped
FROM cut
"""


def _uuid_sql(text: str) -> str:
    return "'<urn:uuid:' || " + " || '-' || ".join(f"substr(md5({text}), {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + " || '>'"


_NAMES = "MAP {" + ", ".join(f"'{n}': '{c if c != chr(39) else c * 2}'" for n, c in warc.ENTITIES.items()) + "}"
_NUMBER = "CASE WHEN regexp_matches(r, '^&#[xX]') THEN ('0x' || regexp_extract(r, '^&#[xX]([0-9a-fA-F]+)', 1))::BIGINT WHEN starts_with(r, '&#') THEN regexp_extract(r, '^&#([0-9]+)', 1)::BIGINT END"
_CHARACTER = f"CASE WHEN starts_with(r, '&#') THEN CASE WHEN ({_NUMBER}) BETWEEN 1 AND 55295 OR ({_NUMBER}) BETWEEN 57344 AND 1114111 THEN chr(({_NUMBER})::INTEGER) ELSE chr(65533) END ELSE coalesce(n[regexp_extract(r, '^&(.*);$', 1)], r) END"

_WARC_SQL = f"""
WITH r AS (
  SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS payload FROM pages
), i AS (
  SELECT *, {_uuid_sql("'response|' || coalesce(page_id::VARCHAR, '') || '|' || target_uri")} AS refers_to,
    regexp_replace(regexp_replace(regexp_replace(payload,
      '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', '', 'g'),
      '(?i)<(?:/(?:p|div|li|h[1-6]|title|article|nav|tr|table|section)|br/?)>', chr(10), 'g'), '<[^>]*>', '', 'g') AS bare
  FROM r
), e AS (
  SELECT *, {_NAMES} AS n, regexp_extract_all(bare, '&{warc.REFERENCE}') AS refs, string_split_regex(bare, '&{warc.REFERENCE}') AS parts FROM i
), d AS (
  SELECT * EXCLUDE (n, refs, parts), replace(array_to_string(list_transform(list_zip(parts, list_transform(refs, lambda r: {_CHARACTER})), lambda x: x[1] || coalesce(x[2], '')), ''), chr(160), ' ') AS text FROM e
), c AS (
  SELECT *, {_uuid_sql("'conversion|' || refers_to")} AS conversion_id, {_uuid_sql("'metadata|' || refers_to")} AS metadata_id,
    regexp_replace(regexp_replace(text, '[ \\t\\r]*\\n[ \\t\\r\\n]*', chr(10), 'g'), '^[ \\n]+|[ \\n]+$', '', 'g') AS plain, chr(13) || chr(10) AS crlf
  FROM d
), b AS (
  SELECT page_id, refers_to, target_uri, payload, 'metadata' AS record_type, metadata_id AS record_id, 'application/warc-fields' AS content_type,
    'payload-digest: sha1:' || sha1(payload) || crlf || 'payload-length: ' || strlen(payload) || crlf || 'has-conversion: ' || conversion_id || crlf
    || 'source-line: HTTP/1.1 200 OK' || crlf || 'Content-Type: text/html; charset=utf-8' || crlf || 'Content-Length: ' || strlen(payload) || crlf AS block FROM c
  UNION ALL
  SELECT page_id, refers_to, target_uri, payload, 'conversion', conversion_id, 'text/plain', plain FROM c
)
SELECT page_id, refers_to, target_uri, '1970-01-01T00:00:00Z' AS date, 'sha1:' || sha1(payload) AS payload_digest, record_type, record_id,
       content_type, block, 'sha1:' || sha1(block) AS block_digest, strlen(block) AS content_length
FROM b
"""


_PHRASES_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\x0C\r]')) AS piece FROM documents
), w AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w FROM d)
), n AS (SELECT lang, count(*) AS n FROM w GROUP BY lang
), f AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM w, range(1, 6) x(k) WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 100
), c AS (
  SELECT lang, phrase, string_split(phrase, ' ') AS p, k, f AS a, unnest(range(1, k)) AS cut FROM f WHERE k > 1
), s AS (
  SELECT c.lang, c.phrase, a, l.f AS l, r.f AS r, n, ((1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(p[1:cut], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(p[cut + 1:], ' ') JOIN n ON n.lang = c.lang
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, cut) = 1
), stay AS (
  SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.lang = s.lang AND f.f >= s.a AND len(f.phrase) > len(s.phrase) AND contains(' ' || f.phrase || ' ', ' ' || s.phrase || ' '))
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score FROM stay QUALIFY rank <= 2000
"""

_NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
), p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id, (row_number() OVER w)::INTEGER AS rank, s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id)
QUALIFY row_number() OVER w <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op12_collocations": _PHRASES_SQL, "op13_hard_negatives": _NEGATIVES_SQL, "op3_site_line_dedup": _LINES_SQL, "op6_warc_derivatives": _WARC_SQL}
