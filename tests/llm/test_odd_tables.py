"""Every operator and stage on odd tables: nulls, empty and very long texts, repeated rows, no rows, clashing names."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import decontaminate, kneser_ney, line_dedup, minhash, packing, resharding, span_dedup, toxicity, warc, weak_rules

LINE = "the rules of the house and the garden are for all of us to keep in mind today."
PROSE = "\n".join(f"{LINE} so it goes in the {n} part of the book, and that is how they found it." for n in ("first", "second", "third", "fourth", "fifth"))
ITEM = "when does the copper kettle sing its low song to the seven sleeping wardens of the northern gate"
GOOD = """The ferry left the harbour before dawn, and the two sisters stood at the rail to watch the lights of the town grow small behind them.
They had packed only what they could carry: some bread, a blanket, the letters from their uncle and a map that was older than either of them.
By noon the wind had turned, so the captain told everyone to go below and wait; nobody was afraid, because the sea was known to be kind in that month.
In the evening they saw the island for the first time, green and steep, with a single road that led up from the quay to the houses on the hill."""
ROWS = [
    (1, PROSE, "en", "s"), (1, PROSE, "en", "s"), (1, PROSE + " Another text of the same id.", "en", "s"), (2, PROSE, None, None), (3, None, "en", "s"), (4, "", None, "s"), (None, PROSE, "en", "s"), (None, None, None, None),
    (5, " \n\t ", "de", "t"), (6, "one", "en", "t"), (7, "long words of text " * 60_000, "en", "t"), (8, "é" * 400_000, "fr", "t"), (9, PROSE + "\n" + ITEM + ".", "en", "s"), (10, "idi0t " * 60 + PROSE, "en", "s"),
    (11, GOOD, "en", "t"),
]
COLUMNS = ["doc_id", "text", "lang", "source"]
#: Names that operators use for columns of their own, and names that differ in case only.
CLASHES = ["gone", "__gone", "__cut", "__keys", "site", "keys", "site_of", "c0", "c1", "id", "size", "shard", "slot", "old_shard", "block", "tie", "tag", "cut", "clean", "place", "node", "rep", "n", "f1", "f2", "bucket", "component_id", "kept", "any", "row", "part", "queue", "ids", "runs", "start", "length", "offset", "score", "top", "held_out", "p_good", "v_length", "perplexity", "threshold", "own", "of", "Text", "DOC_ID", "Source", "item_id", "record_id", "block_digest"]


def bench(spark):
    return spark.createDataFrame([(1, ITEM, 7), (2, None, 7), (3, "", 7), (4, "word " * 3000, 7)], "item_id long, text string, doc_id long")


def labels(spark):
    return spark.createDataFrame([(i, int(i == 10), 1) for i in range(11)] + [(None, 1, 1), (3, None, 1)], "doc_id long, toxic int, quality int")


def pages(df):
    return df.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://"), "source").alias("url"), F.col("text").alias("html"))


ROWWISE = {
    "op2": lambda s, d: packing.pack(d).groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("length")),
    "op3": lambda s, d: line_dedup.drop_site_lines(d, "source", dropped="n_cut").select("doc_id", "text", "n_cut") if len(d.columns) == len(COLUMNS) else line_dedup.drop_site_lines(d, "source", dropped="n_cut").toDF(*COLUMNS, *(f"x{i}" for i in CLASHES), "n_cut").select("doc_id", "text", "n_cut"),
    "op4": lambda s, d: kneser_ney.perplexity_quality(d, labels(s)).select("doc_id", "lang", "n_bytes", "kept"),
    "op7": lambda s, d: resharding.reshard(d, F.lit(3)).select("doc_id", "size", "text_crc32", "old_shard"),
    "op8": lambda s, d: minhash.near_duplicates(d),
    "op9": lambda s, d: toxicity.toxicity(d, labels(s)).select("doc_id", "held_out", "predicted"),
    "op10": lambda s, d: weak_rules.quality_votes(d).select("doc_id", "n_words", "base_failed", "kept"),
}
FOUND = {
    "op1": lambda s, d: decontaminate.benchmark_leaks(d, bench(s)),
    "op5": lambda s, d: span_dedup.drop_repeated_spans(d, by_content=True),
}
DROPS = {
    "quality": lambda s, d: weak_rules.drop_low_quality(d),
    "lines": lambda s, d: line_dedup.drop_site_lines(d, "source"),
    "near": lambda s, d: minhash.drop_near_duplicates(d),
    "leaks": lambda s, d: decontaminate.drop_contaminated(d, bench(s)),
    "stage lines": lambda s, d: corpus_pipeline.site_lines(s, d, ""),
}


@pytest.fixture(scope="module")
def plain(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").cache()


@pytest.fixture(scope="module")
def clashing(plain):
    return plain.select("*", *[F.lit(f"<{c}>") for c in CLASHES]).toDF(*COLUMNS, *CLASHES).cache()


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


@pytest.mark.parametrize("name", [*ROWWISE, *FOUND])
def test_operators_do_not_see_other_columns(spark, plain, clashing, name):
    f = (ROWWISE | FOUND)[name]
    out = f(spark, plain)
    assert same(out, f(spark, clashing))
    if name not in ("op2", *FOUND):
        assert out.count() == len(ROWS)
    assert f(spark, clashing.limit(0)).count() == 0


def test_found_in_odd_rows(spark, plain):
    assert {(r.doc_id, r.item_id) for r in FOUND["op1"](spark, plain).collect()} == {(9, 1)}
    cut = FOUND["op5"](spark, plain).collect()  # the lines of PROSE repeat each other in part, 7 repeats itself
    assert {r.doc_id for r in cut} == {1, 2, 7, 9, 10} and len({(r.doc_id, r.clean) for r in cut}) == 6
    assert all(r.n_removed < r.n_sentences for r in cut if r.doc_id == 1) and all(r.n_removed == r.n_sentences for r in cut if r.doc_id == 2)
    sizes = {r.doc_id: r.length for r in ROWWISE["op2"](spark, plain).collect() if r.doc_id in (3, 4)}
    assert sizes == {3: 1, 4: 1}


@pytest.mark.parametrize("name", list(DROPS))
def test_stages_keep_columns_and_rows(spark, plain, clashing, name):
    f = DROPS[name]
    out, base = f(spark, clashing), f(spark, plain)
    assert out.columns == clashing.columns
    rows = [tuple(r) for r in out.collect()]
    assert all(list(r[len(COLUMNS) :]) == [f"<{c}>" for c in CLASHES] for r in rows)
    assert sorted(str(r[: len(COLUMNS)]) for r in rows) == sorted(str(tuple(r)) for r in base.collect())
    assert f(spark, clashing.limit(0)).count() == 0 and f(spark, clashing.limit(0)).columns == clashing.columns
    if name == "near":
        # 10 shares 55 of 60 shingles with PROSE
        assert sorted(r[0] for r in rows if r[0]) == [1, 1, 1, 3, 4, 5, 6, 7, 8, 9, 11]
    if name == "leaks":
        assert len(rows) == len(ROWS) - 1 and 9 not in {r[0] for r in rows}
    if name == "quality":
        # 170 of the 175 words of PROSE stand in repeated windows, so all that holds it fails the base rules
        assert {r[0] for r in rows} == {11} and rows[0][1] == GOOD


def test_warc_does_not_see_other_columns(spark, plain):
    p = pages(plain)
    extra = p.select("*", *[F.lit(1)] * 3).toDF("page_id", "url", "html", "payload", "HTML", "block")
    out = warc.derivatives(warc.responses_from_pages(p))
    assert same(out, warc.derivatives(warc.responses_from_pages(extra))) and out.count() == 2 * len(ROWS)


def test_ties_and_repeats_are_placed_one_by_one(spark):
    twins = spark.createDataFrame([(i % 3, "same", i % 2) for i in range(30)], "doc_id long, text string, old int")
    rows = resharding.reshard(twins, "old", shards=4, old_shards=2).collect()
    assert len(rows) == 30 and all(sorted(r.slot for r in rows if r.shard == s) == list(range(len([r for r in rows if r.shard == s]))) for s in range(4))
