"""Near duplicates against brute force over full shingle sets."""

import random

import numpy as np
import pytest

from corpusmill.llm import common, minhash
from corpusmill.llm.components import components


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(docs, percent):
    sets, root = {i: shingles(t) for i, t in docs}, {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            same = len(sets[a] & sets[b])
            if a < b and same and 100 * same >= percent * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.fixture(scope="module")
def docs():
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(3000)]
    base = [" ".join(rnd.choice(vocab) for _ in range(rnd.randrange(60, 200))) for _ in range(12)]
    out = []
    for b in base:
        for _ in range(rnd.randrange(1, 14)):
            w = b.split()
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 5, 9])):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            out.append(" ".join(w))
    passage = " ".join(rnd.choice(vocab) for _ in range(80))
    out += [passage + " " + " ".join(rnd.choice(vocab) for _ in range(rnd.randrange(5, 60))) for _ in range(25)]
    out += ["same words here"] * 3 + ["Same WORDS\there\n", "", None, "  \n ", "one", "one", "x " * 5000]
    return list(enumerate(out))


@pytest.mark.parametrize("percent", [80, 85])
def test_is_brute_force(spark, docs, percent):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, percent).collect()}
    assert got == brute(docs, percent)


def test_odd_rows(spark):
    """Null ids join a component but name none; repeated rows give a row each; extra and clashing columns do not matter."""
    data = [(1, "a b c d e f", "x", 9), (1, "a b c d e f", "x", 9), (2, "a b c d e f", None, 1), (None, "a b c d e f", "x", None), (3, None, "x", 2), (None, "alone with no id at all", "x", 1), (None, None, "x", 1)]
    df = spark.createDataFrame(data, "doc_id long, text string, bucket string, component long").toDF("doc_id", "text", "gone", "Text")
    got = sorted(map(tuple, minhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (None, 2, 1, True), (None, 2, None, True), (None, 0, None, True)], key=str)
    kept = minhash.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(r[0] or 0 for r in kept.collect()) == [0, 0, 0, 1, 1, 3]
    empty = df.limit(0)
    assert minhash.near_duplicates(empty).count() == 0 and minhash.drop_near_duplicates(empty).count() == 0


def test_rows_of_one_id_with_different_texts_are_one_document(spark):
    rnd = random.Random(8)
    a, b, c = (" ".join(f"w{rnd.randrange(5000)}" for _ in range(100)) for _ in range(3))
    near = lambda t: " ".join([*t.split()[:-1], "other"])
    data = [(5, a), (5, b), (7, near(a)), (8, near(b)), (9, c), (10, c + " more"), (9, "short one")]
    got = {(i, t): k for i, t, k in spark.createDataFrame(data, "doc_id long, text string").join(minhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).select("doc_id", "component_id").distinct(), "doc_id").collect()}
    assert got == {(i, t): (5 if i < 9 else 9) for i, t in data}


def test_components(spark):
    chain = [(i + 1, i) for i in range(40)] + [(100, 101), (200, 200)]
    got = dict(components(spark.createDataFrame(chain, "u long, v long")).collect())
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_circulant_minhash_estimates_jaccard():
    rnd = np.random.default_rng(1)
    for share in (0.3, 0.6, 0.9):
        both = rnd.integers(0, 2**63, 400, np.uint64)
        k = int(400 * share)
        a, b = both[:k], np.concatenate([both[: k - 50], both[k : k + 50]])
        exact = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        est = (minhash.signature(np.unique(a)) == minhash.signature(np.unique(b))).mean()
        assert abs(est - exact) < 0.15
    assert len(common.shingle_set(common.WordHashes().array([b"a", b"b"]), 5)) == 1
