"""Mixing: targets against a plain water-filling, exact quotas, the hypergeometric law, reruns, odd rows."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import mixing

ROWS = [(i, " ".join(f"w{i}x{j}" for j in range(n)), s) for i, (n, s) in enumerate([(900, "a"), (40, "a"), (0, "b"), (700, "b"), (3, "c"), (60, "c"), (5, "d"), (5000, "e"), (10, "é"), (1, "zz")])]
ROWS += [(20, None, "a"), (21, "", "a"), (22, " \t\n ", "q"), (23, "no source\x0bhere\r\n", None), (23, "no source\x0bhere\r\n", None), (None, "one two", "a"), (None, None, None)] + [(30, "copies of a row", "b")] * 40


def plain_targets(words, most=3, weights=(5, 2, 1)):
    order = sorted(words, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    limited = set()
    while True:
        left, open_ = sum(words.values()) - sum(most * words[s] for s in limited), [s for s in order if s not in limited]
        target = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_} | {s: most * words[s] for s in limited}
        more = {s for s in open_ if target[s] > most * words[s]}
        if not more:
            return target
        limited |= more


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, source string").withColumn("n", F.lit(1)).withColumn("KEY", F.lit("x")).withColumn("at", F.lit(2)).repartition(5)


@pytest.fixture(scope="module")
def mixed(docs):
    return mixing.mix(docs, shards=5, block_words=64).collect()


def test_targets_and_taken_words(mixed):
    words = Counter()
    for _, t, s in ROWS:
        words[s] += len(words_of(t))
    want, taken = plain_targets(words), Counter()
    assert len(mixed) == len(ROWS)
    for r in mixed:
        assert r.source_size == words[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert {s: taken[s] for s in words} == {s: round(want[s]) for s in words}
    assert sorted((r.doc_id or -1, r.size) for r in mixed) == sorted((i or -1, len(words_of(t))) for i, t, _ in ROWS)


def test_pieces_are_disjoint_and_shards_even(mixed):
    shards = Counter()
    for r in mixed:
        by_epoch = defaultdict(list)
        for p in r.pieces:
            by_epoch[p.epoch] += range(p.first, p.first + p.n)
            shards[p.shard] += p.n
        assert all(len(set(x)) == len(x) and max(x) < r.size for x in by_epoch.values())
    assert set(shards) == set(range(5)) and max(shards.values()) - min(shards.values()) <= 12 * 64


def test_reruns_agree_however_rows_lie(spark, docs, mixed):
    again = mixing.mix(docs.select("source", "text", "doc_id").coalesce(1).orderBy("text"), shards=5, block_words=64).collect()
    assert sorted(map(str, again)) == sorted(map(str, mixed))


def test_texts_of_shards(spark, docs, tmp_path):
    m = mixing.mix(docs, shards=3, block_words=64)
    pieces = mixing.shard_texts(docs, m)
    rows = pieces.collect()
    assert sum(r.n for r in rows) == sum(r.taken for r in m.collect()) and all(len(words_of(r.text)) == r.n for r in rows)
    of = {i: words_of(t) for i, t, _ in ROWS if i is not None}
    assert all(words_of(r.text) == of[r.doc_id][r.first : r.first + r.n] for r in rows if r.doc_id is not None)
    mixing.write_shards(pieces, str(tmp_path / "out"), parts=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(rows) and {r.shard for r in back.select("shard").distinct().collect()} == {0, 1, 2}


def test_no_rows_no_words(spark, docs):
    assert mixing.mix(docs.limit(0)).count() == 0
    none = mixing.mix(docs.where("text is null or length(text) < 1")).collect()
    assert none and all(r.taken == 0 and r.target == 0 and not r.pieces for r in none)


@pytest.mark.parametrize("shards", [1, 4, 7])
def test_dealing_keeps_both_margins(spark, shards):
    rnd = random.Random(5)
    quotas = [rnd.choice([0, 1, 3, 50, 4000]) for _ in range(2500)]  # more sources than one node takes
    rows = mixing.deal(spark.createDataFrame(list(enumerate(quotas)), "rank long, quota long"), shards).collect()
    assert {r["rank"]: sum(r.dealt) for r in rows} == dict(enumerate(quotas)) and all(min(r.dealt) >= 0 for r in rows)
    sums = [sum(r.dealt[j] for r in rows) for j in range(shards)]
    assert sums == [(j + 1) * sum(quotas) // shards - j * sum(quotas) // shards for j in range(shards)]


def test_draws_follow_the_hypergeometric_law(spark):
    """Mean and variance over many seeds of blocks of a source that one shard of four gets."""
    got = []
    for seed in range(15):
        rows = mixing.deal(spark.createDataFrame([(0, 60), (1, 100), (2, 40)], "rank long, quota long"), 4, seed=seed).collect()
        got += [x for r in rows if r["rank"] == 1 for x in r.dealt]
    mean, var = sum(got) / len(got), sum((x - 25) ** 2 for x in got) / len(got)
    assert mean == 25 and 4 < var < 17  # 50 * (1/2) * (1/2) * 150/199 = 9.4
