"""Plain re-computations of what has no SQL: packing, Kneser-Ney, toxicity scores, label models, ids of real text."""

import math
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpusmill.llm import kneser_ney, packing, toxicity, weak_rules

from .test_models_and_layout import prose

REAL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("shares", [None, {"a": 0.5, "b": 0.2}])
def test_packing_is_a_plain_deficit_round_robin(spark, shares):
    """Round by round every queue earns its quantum and sends packets while the deficit covers the next one."""
    import public_tokenizers

    rnd = random.Random(21)
    docs = [(i, prose(rnd, rnd.randrange(0, 700)) if i % 9 else None, rnd.choice(["a", "a", "a", "b", "c", None])) for i in range(90)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").coalesce(1)
    own = packing.Ids(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, "<u4")
    n = {i: len(own.of(t or "")) // 4 + 1 for i, t, _ in docs}
    queues = defaultdict(list)
    for i, _, s in docs:
        queues[s or ""] += [(i, at, min(256, n[i] - at)) for at in range(0, n[i], 256)]
    total = sum(n.values())
    part = {q: sum(k for _, _, k in ps) / total for q, ps in queues.items()} if shares is None else {q: shares.get(q, (1 - sum(shares.values())) / len(queues.keys() - shares.keys())) for q in queues}
    stream, earned, sent = [], dict.fromkeys(queues, 0), dict.fromkeys(queues, 0)
    left = {q: list(ps) for q, ps in queues.items()}
    rounds = 0
    while any(left.values()):
        rounds += 1
        for q in sorted(left):
            earned[q] = rounds * part[q] * 1024
            while left[q] and sent[q] + left[q][0][2] <= earned[q] + 1e-6:
                p = left[q].pop(0)
                sent[q] += p[2]
                stream.append(p)
    want, at = set(), 0
    for i, start, k in stream:
        want |= {(i, start + j, (at + j) // 1024, (at + j) % 1024) for j in range(k)}
        at += k
    got = {(r.doc_id, r.start + j, r.sequence_id, r.offset + j) for r in packing.pack(df, shares=shares).collect() for j in range(r.length)}
    assert got == want


def test_packing_reaches_given_shares(spark):
    """Two sources without a share halve what is left over, as long as no queue is dry."""
    rnd = random.Random(4)
    df = spark.createDataFrame([(i, prose(rnd, 300), "abcd"[i % 4]) for i in range(400)], "doc_id long, text string, source string")
    rows = packing.pack(df, shares={"a": 0.4, "b": 0.3}).where("sequence_id < 100").groupBy("source").agg({"length": "sum"}).collect()
    got = {r.source: r["sum(length)"] / (100 * 1024) for r in rows}
    assert all(abs(got[s] - x) < 0.01 for s, x in {"a": 0.4, "b": 0.3, "c": 0.15, "d": 0.15}.items())
    for wrong in ({"a": 0.7, "b": 0.4}, {"a": 0.0}):
        with pytest.raises(ValueError):
            packing.pack(df, shares=wrong)


@pytest.mark.skipif(not os.path.isdir(REAL), reason="the given tables are not here")
def test_ids_of_the_given_texts_are_those_of_tokenizers(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{REAL}/documents.parquet")
    ids = {r.doc_id: [*t.encode(r.text or "", add_special_tokens=False).ids, 0] for r in docs.select("doc_id", "text").collect()}
    seen = Counter()
    for r in packing.pack(docs, added_tokens=True).collect():
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        seen[r.doc_id] += r.length
    assert seen == {i: len(x) for i, x in ids.items()}


def plain_kneser_ney(texts, order):
    """p(byte | history) by the textbook recursion over dictionaries."""
    counts = [Counter() for _ in range(order + 1)]
    for t in texts:
        padded = b"\n" * (order - 1) + t
        for i in range(order - 1, len(padded)):
            counts[order][padded[i - order + 1 : i + 1]] += 1
    for k in range(order - 1, 0, -1):
        for g in counts[k + 1]:
            counts[k][g[1:]] += 1
    cuts, total, kinds = {}, {}, {}
    for k in range(1, order + 1):
        n = [sum(c == i for c in counts[k].values()) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        cuts[k] = [min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.1), i - 0.05) if n[i] else i * 0.5 for i in (1, 2, 3)]
        for g, c in counts[k].items():
            total[k, g[:-1]] = total.get((k, g[:-1]), 0) + c
            kinds.setdefault((k, g[:-1]), []).append(cuts[k][min(c, 3) - 1])

    def p(gram, k=order):
        if k == 0:
            return 1 / 256
        gram = gram[-k:]
        if (k, gram[:-1]) not in total:
            return p(gram, k - 1)
        c = counts[k].get(gram, 0)
        own = c - cuts[k][min(c, 3) - 1] if c else 0
        return (own + sum(kinds[k, gram[:-1]]) * p(gram, k - 1)) / total[k, gram[:-1]]

    return p


def test_perplexity_is_that_of_a_plain_kneser_ney_model(spark):
    rnd = random.Random(22)
    trusted = [prose(rnd, 40).encode() for _ in range(25)]
    p = plain_kneser_ney(trusted, kneser_ney.ORDER)
    others = [prose(rnd, 30), "quite other letters: zyx \u00e9\u00e8 123", "t", prose(rnd, 5) + "\n\n#"]
    model = kneser_ney.train(spark.createDataFrame([(t.decode(),) for t in trusted], "text string"))
    docs = spark.createDataFrame(list(enumerate(others)), "doc_id long, text string")
    got = {r.doc_id: r.perplexity for r in kneser_ney.perplexities(docs, model, shard_rows=model.count() // 2).collect()}
    for i, t in enumerate(others):
        raw = b"\n" * (kneser_ney.ORDER - 1) + t.encode()
        logs = [math.log(p(raw[j - kneser_ney.ORDER + 1 : j + 1])) for j in range(kneser_ney.ORDER - 1, len(raw))]
        assert math.isclose(got[i], math.exp(-sum(logs) / len(logs)), rel_tol=1e-3)


def test_label_model_is_plain_expectation_maximisation(spark):
    """Document by document, with each vote's chance in a dictionary."""
    rnd = random.Random(23)
    texts = ["\n".join(" ".join(rnd.choice(["the", "of", "and", f"w{rnd.randrange(500)}"]) for _ in range(30)) + rnd.choice([".", ""]) for _ in range(4)) for _ in range(40)]
    texts += [" ".join(rnd.choice(["zq##", "ZQ!!", "x1|"]) + str(rnd.randrange(99)) for _ in range(90)) for _ in range(15)] + ["few words", None, "same three words " * 40]
    out = weak_rules.quality_votes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    names = list(weak_rules.rules())
    votes = [{n: r[f"v_{n}"] for n in names} for r in out]
    start = {n: weak_rules.START["fault" if n in weak_rules.FAULTS else "other"] for n in names}
    assert {n for n in names if all(v[n] != 1 for v in votes)} <= set(weak_rules.FAULTS) | {"variety", "endings"}
    observed = [[n for n in names if v[n] or n in weak_rules.FAULTS] for v in votes]
    chance, good, pseudo = {(c, n): start[n][c] for c in (0, 1) for n in names}, 0.8, 20.0

    def odds_of(v, seen):
        out = math.log(good) - math.log(1 - good)
        for n in seen:
            out += math.log(chance[1, n] / chance[0, n]) if v[n] == -1 else math.log((1 - chance[1, n]) / (1 - chance[0, n]))
        return out

    for _ in range(100):
        post = [1 / (1 + math.exp(min(500, -odds_of(v, seen)))) for v, seen in zip(votes, observed)]
        good = (sum(post) + 4 * pseudo) / (len(post) + 5 * pseudo)
        for n in names:
            mass = {}
            for c in (0, 1):
                share = [(q if c else 1 - q, v[n] == -1) for q, v, seen in zip(post, votes, observed) if n in seen]
                mass[c] = (pseudo * start[n][c] + sum(q for q, is_bad in share if is_bad), pseudo + sum(q for q, _ in share))
            rate = {c: a / b for c, (a, b) in mass.items()}
            if rate[1] > rate[0]:
                rate[0] = rate[1] = (mass[0][0] + mass[1][0]) / (mass[0][1] + mass[1][1])
            chance[0, n], chance[1, n] = rate[0], rate[1]
    for r, v, seen in zip(out, votes, observed):
        want = 1 / (1 + math.exp(-odds_of(v, seen)))
        assert math.isclose(r.p_good, want, abs_tol=1e-6) and r.kept == (not r.base_failed and r.p_good >= 0.5)


def test_toxicity_scores_are_those_of_plain_counts(spark):
    """Weights, hits and the logistic model over plain Python counts; restoring is tested on its own."""
    rnd = random.Random(24)
    bad = "idiot moron clown scum".split()
    docs, labels = [], []
    for i in range(260):
        words = prose(rnd, 40).split()
        if i % 3 == 0:
            for _ in range(3):
                words.insert(rnd.randrange(len(words)), rnd.choice(bad).replace("o", rnd.choice("o0")))
        docs.append((i, " ".join(words)))
        if i % 7:
            labels.append((i, int(i % 3 == 0)))
    known = {i: y for i, y in labels if zlib.crc32(str(i).encode()) % 5}
    texts = dict(docs)
    grams = [Counter(), Counter()]
    for i, t in docs:
        for w in t.lower().split():
            w = w.strip(toxicity._EDGES)
            if w.isalpha():
                w = toxicity.EDGE * 2 + w + toxicity.EDGE
                for j in range(len(w) - 2):
                    grams[0][w[j : j + 3]] += 1
                    grams[1][w[j : j + 3]] += known.get(i, 0)
    model = toxicity.CharModel([dict(grams[0]), dict(+grams[1])])
    words = toxicity.Words(model)
    own = {i: toxicity.features(words.of(t)) for i, t in docs}
    n = [Counter(f for i, y in known.items() if y == c for f in own[i]) for c in (0, 1)]
    size = [sum(y == c for y in known.values()) + 1 for c in (0, 1)]
    weight = {}
    for f, k in n[1].items():
        if k >= 3:
            a, b = k + 0.5, n[0][f] + 0.5
            sure = math.log((a / size[1]) / (b / size[0])) - 2 * math.sqrt(1 / a + 1 / b)
            if sure > 0.3:
                weight[f] = sure
    rows = {}
    for i, fs in own.items():
        hits = sorted([weight[f] for f in fs if f in weight] + [0.0, 0.0], reverse=True)
        rows[i] = [hits[0], hits[1], math.log1p(sum(hits)), math.log1p(len(fs))]
    ids = sorted(known)
    w = toxicity.fit_logistic(np.array([rows[i] for i in ids]), np.array([known[i] for i in ids], float))
    got = {r.doc_id: r.score for r in toxicity.toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert weight and all(math.isclose(got[i], 1 / (1 + math.exp(-(np.dot(w[:4], rows[i]) + w[4]))), abs_tol=1e-4) for i in texts)
