"""Collocations against plain Python: languages, overlaps, ties, odd rows, cut chunks and slices, several tries."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import collocations as K

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, longest=5, least=100, top=2000):
    n, f = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    f = Counter({k: v for k, v in f.items() if v >= least})
    inside = Counter()
    for (lang, p), v in f.items():
        for i in range(len(p)):
            for j in range(i + 1, len(p) + 1):
                if j - i < len(p):
                    inside[lang, p[i:j]] = max(inside[lang, p[i:j]], v)
    rows = {}
    for (lang, p), a in f.items():
        if len(p) > 1 and inside[lang, p] < a:
            score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            rows.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, own in rows.items() for i, (s, a, p, l, r) in enumerate(sorted(own)[:top])}


def corpus(seed, docs=120):
    rnd = random.Random(seed)
    vocab = ["the", "The", "old", "mill", "is", "é", "naïve", "x.y", "a", "a", "a", "mill's", "\x00odd", "of", " ", "go"]
    fixed = ["in the old mill", "a a a a a a", "one\tTWO three four five six", "so it goes; so it goes"]
    out = []
    for _ in range(docs):
        words = [rnd.choice(fixed) if rnd.random() < 0.3 else rnd.choice(vocab) + rnd.choice(["", "", "", ",", ".", "\n", "\x0b", "\r\n"]) for _ in range(rnd.randrange(1, 90))]
        out.append((rnd.choice(["en", "en", "de", None, "und"]), " ".join(words)))
    return out + [("en", None), (None, ""), ("fr", " \t\n.,"), ("en", "w" * 3000 + " the old mill " * 50)] + [("de", "copies of one text")] * 30


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus(1)
    return rows, spark.createDataFrame(rows, "lang string, text string").withColumn("f", F.lit(1)).withColumn("LANG2", F.lit("x")).withColumn("chunk", F.lit(2)).repartition(3)


def test_same_rows_as_brute_force(docs):
    rows, df = docs
    got = {tuple(r) for r in K.collocations(df, least=12).collect()}
    assert got == plain(rows, least=12) and len(got) > 40 and {"und", "en", "de"} <= {r[0] for r in got}


def test_cut_chunks_slices_and_tries(docs, spark, monkeypatch):
    """Chunks, slices and tries so small that phrases lie across them; the driver's tries are cut, chunks by the tasks are tested below."""
    rows, df = docs
    monkeypatch.setattr(K, "TRIE_PHRASES", 20)
    assert {tuple(r) for r in K.collocations(df, least=12, top=30).collect()} == plain(rows, least=12, top=30)


def test_chunks_and_slices_lose_nothing(monkeypatch):
    import pyarrow as pa
    from pyspark import TaskContext

    class Task:
        partitionId = staticmethod(lambda: 3)

    monkeypatch.setattr(TaskContext, "get", staticmethod(lambda: Task))
    monkeypatch.setattr(K, "SLICE", 37)
    rows = corpus(5, 30)
    batch = pa.RecordBatch.from_pydict({"lang": [lang or "und" for lang, _ in rows], "text": [t for _, t in rows]})
    want = Counter()
    for lang, t in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            want.update((lang or "und", tuple(w[i : i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    for size in (16, 64, 1 << 18):
        monkeypatch.setattr(K, "CHUNK_WORDS", size)
        got, words, numbers = Counter(), Counter(), set()
        for b in K._encode(iter([batch]), ahead=4):
            for c in b.to_pylist():
                names, ids = c["words"], np.frombuffer(c["ids"], np.int32)
                numbers.add(c["chunk"])
                words.update({(c["lang"], w): n for w, n in zip(names[1:], c["counts"][1:])})
                for i in range(c["starts"]):
                    for k in range(1, 6):
                        own = ids[i : i + k]
                        if len(own) == k and own.all():
                            got[c["lang"], tuple(names[x] for x in own)] += 1
        assert got == want and +words == Counter({(lang, p[0]): v for (lang, p), v in want.items() if len(p) == 1})
        assert len(numbers) > 1


def test_double_array_holds_its_phrases_and_no_others():
    rnd = np.random.default_rng(8)
    size = 300
    levels = []
    for k in (1, 2, 3, 5):
        m = np.unique(np.concatenate([rnd.integers(0, size, (800, k)), rnd.integers(0, 6, (400, k))]), axis=0)
        levels.append((m, np.arange(len(m)) + 10_000 * k))
    t = K.Trie(size, levels)
    for m, n in levels:
        text = np.column_stack([m, np.full(len(m), size)]).ravel()
        states = list(t.walk(text, 5))[m.shape[1] - 1]
        first = np.arange(len(m)) * (m.shape[1] + 1)
        value = dict(zip(states[0].tolist(), t.value[states[1]].tolist()))
        assert [value[i] for i in first.tolist()] == n.tolist()
    known = {tuple(r) for m, _ in levels for r in m.tolist()}
    text = rnd.integers(0, 40, 20_000)
    for d, (where, state) in enumerate(t.walk(text, 5), 1):
        hit = {int(w) for w, s in zip(where, state) if t.value[s] >= 0}
        assert hit == {i for i in range(len(text) - d + 1) if tuple(text[i : i + d].tolist()) in known}


def test_exact_beyond_64_bits(spark):
    """The score's products in decimals, on counts that no corpus of a test has."""
    rows = [(10**15, 3 * 10**15, 10**15 + 7, 7 * 10**16), (100, 100, 100, 10**13), (999_999_999_999_999, 10**16 + 1, 10**16 + 3, 99_999_999_999_999_989)]
    df = spark.createDataFrame(rows, "a long, l long, r long, n long").withColumn("score", K.score())
    assert [r.score for r in df.collect()] == [1000 * a * n // (l * r) for a, l, r, n in rows]


def test_no_rows(docs):
    _, df = docs
    assert K.collocations(df.limit(0)).count() == 0
    assert K.collocations(df, least=10**6).count() == 0
