"""Packing, resharding, Kneser-Ney and toxicity: round trips, optimality, sums to one, held-out accuracy."""

import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import kneser_ney, packing, resharding, toxicity

WORDS = "the of and tion ing er en re st an".split()


def prose(rnd, n):
    return " ".join("".join(rnd.choice(WORDS) for _ in range(rnd.randrange(1, 4))) for _ in range(n))


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    rnd = random.Random(1)
    docs = [(i, prose(rnd, rnd.randrange(1, 400)), f"s{min(3, int(rnd.expovariate(1)))}", 1) for i in range(150)]
    docs += [(200, None, "s0", 1), (201, "", None, 1), (202, "é  x \n\n y\t<|endoftext|> 1234 'll", "s9", 1), (203, prose(rnd, 9000), "s0", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, round int")
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x, *_ in docs}
    rows = packing.pack(df.repartition(5)).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, own in ids.items():
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(np.array(own[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(own)
    for s, own in by_seq.items():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 1024 or s == max(by_seq)
    # at the end of each window every source is near its share
    total = sum(map(len, ids.values()))
    share = defaultdict(float)
    for i, _, s, _ in docs:
        share[s or ""] += len(ids[i]) / total
    seen = defaultdict(int)
    for s in sorted(by_seq):
        for r in by_seq[s]:
            seen[r.source or ""] += r.length
        done = sum(seen.values())
        assert all(abs(seen[x] - p * done) <= 2 * packing.PACKET + p * 1024 + 1 for x, p in share.items())
    assert packing.pack(df.limit(0)).count() == 0


def test_packing_gives_the_ids_of_tokenizers(spark, tmp_path):
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    from corpusmill.llm import queries

    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n", "a" + " " * 2_000_000 + "b", "<|endoftext|" + " " * 1_000_000 + ">", "plain <| text |>", None]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x in enumerate(texts)}
    assert 50256 in ids[0]
    df = spark.createDataFrame([(i, x, "s") for i, x in enumerate(texts)], "doc_id long, text string, source string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    for out in (queries.op2_mixture_packing(spark, str(tmp_path)), corpus_pipeline.packed(spark, df, "")):
        found = defaultdict(int)
        for r in out.collect():
            assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
            found[r.doc_id] += r.length
        assert found == {i: len(x) for i, x in ids.items()}


def test_packing_given_shares(spark):
    rnd = random.Random(2)
    docs = [(i, prose(rnd, 300), "ab"[i % 2]) for i in range(60)]
    rows = packing.pack(spark.createDataFrame(docs, "doc_id long, text string, source string"), shares={"a": 0.8}).collect()
    first = [r for r in rows if r.sequence_id < 8]
    part = sum(r.length for r in first if r.source == "a") / sum(r.length for r in first)
    assert abs(part - 0.8) < 0.1


def test_min_cost_flow_moves_least():
    rnd = random.Random(3)
    for _ in range(100):
        old = [rnd.randrange(50) for _ in range(rnd.randrange(1, 6))]
        new = resharding.even_capacities(sum(old), rnd.randrange(1, 8))
        flow = resharding.min_cost_flow(old, new)
        assert all(sum(f for (i, _), f in flow.items() if i == k) == n for k, n in enumerate(old))
        assert all(sum(f for (_, j), f in flow.items() if j == k) <= n for k, n in enumerate(new))
        assert sum(f for (i, j), f in flow.items() if i != j) == sum(old) - sum(map(min, zip(old, new)))
    cost = lambda i, j: [[4, 1], [2, 0]][i][j]
    assert resharding.min_cost_flow([3, 3], [3, 3], cost) == {(0, 1): 3, (1, 0): 3}
    with pytest.raises(ValueError):
        resharding.min_cost_flow([5], [3])


def test_resharding(spark, tmp_path):
    rnd = random.Random(4)
    docs = [(i, "x" * int(rnd.lognormvariate(4, 1)), int(min(15, rnd.expovariate(0.5))), "t") for i in range(1500)] + [(2000, None, None, "t"), (2001, "é", 3, "t"), (None, "same", 1, "t"), (7, "twice", 2, "t")]
    df = spark.createDataFrame(docs, "doc_id long, text string, old int, block string")
    out = resharding.reshard(df, F.col("old")).collect()
    assert len(out) == len(docs)
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in out:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert sorted(sizes) == list(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) - min(sizes.values()) <= 3 * max(r.size for r in out) / 2
    one = {r.doc_id: r for r in out}
    assert (one[2000].size, one[2000].text_crc32, one[2000].old_shard) == (8, 0, 0) and (one[2001].size, one[2001].text_crc32) == (10, zlib.crc32("é".encode()))
    assert resharding.reshard(df.limit(0), F.col("old")).count() == 0


@pytest.mark.parametrize("old, new", [(8, 4), (3, 7), (4, 4)])
def test_resharding_is_the_plain_line_and_rewrites_in_place(spark, tmp_path, old, new):
    """Sorted by size class the rows of an old shard make a line; the flow cuts it; a row goes where its middle lies."""
    rnd = random.Random(old)
    docs = [(i, "y" * rnd.randrange(60), rnd.randrange(old), "e") for i in range(200)] + [(None, t, 1, "e") for t in ("a", "a", "b", None)] + [(7, "other text", 2, "e"), (7, "other text", 2, "e"), (7, None, 0, "e")]
    path = str(tmp_path / "table")
    spark.createDataFrame(docs, "doc_id long, text string, shard int, Size string").write.partitionBy("shard").parquet(path)
    df = spark.read.parquet(path)
    place = resharding.reshard(df, "shard", shards=new, old_shards=old)
    rows = place.collect()
    assert len(rows) == len(docs)
    supply = [sum(r.size for r in rows if r.old_shard == i) for i in range(old)]
    flow = resharding.min_cost_flow(supply, resharding.even_capacities(sum(supply), new))
    got = defaultdict(int)
    for r in rows:
        got[r.old_shard, r.shard] += r.size
    largest = max(r.size for r in rows)
    assert set(got) <= set(flow) and all(abs(got[k] - n) <= largest for k, n in flow.items())
    assert sum(r.size for r in rows if r.moved) <= sum(n for (i, j), n in flow.items() if i != j) + largest * len(flow)
    before = sorted(map(str, df.select("doc_id", "text", "Size").collect()))
    want = sorted((str((r.doc_id, r.text_crc32)), r.shard) for r in rows)
    resharding.rewrite(df, "shard", place, path, old_shards=old)
    after = spark.read.parquet(path)
    assert sorted(map(str, after.select("doc_id", "text", "Size").collect())) == before
    assert sorted((str((r.doc_id, zlib.crc32((r.text or "").encode()))), r.shard) for r in after.collect()) == want


def test_kneser_ney_sums_to_one_and_shards_agree(spark):
    rnd = random.Random(5)
    docs = spark.createDataFrame([(i, prose(rnd, 60), "en", 0) for i in range(60)] + [(99, None, None, 0), (98, "", "fr", 0), (97, "\x00\xff", None, 0)], "doc_id long, text string, lang string, p int")
    model = kneser_ney.train(docs.where("doc_id < 40"))
    m = kneser_ney.Model(model.toArrow())
    for h in (b"the ", b"tion", b"zzzz", b"\n\n\n\n"):
        keys = np.array([(int.from_bytes(h, "big") << 8) | c for c in range(256)], np.int64)
        assert math.isclose(np.exp(m.log_p(keys).astype(float)).sum(), 1, abs_tol=1e-3)
    one = {r.doc_id: r.perplexity for r in kneser_ney.perplexities(docs, model).collect()}
    many = {r.doc_id: r.perplexity for r in kneser_ney.perplexities(docs, model, shard_rows=model.count() // 3).collect()}
    assert one[99] is None and one[98] is None and one.keys() == many.keys()
    assert all(math.isclose(one[i], many[i], rel_tol=1e-4) for i in one if one[i] is not None)
    assert one[97] > 50 > one[50]


def test_perplexity_quality(spark):
    rnd = random.Random(6)
    rows = [(i, prose(rnd, 80), "en") for i in range(120)] + [(200 + i, " ".join(f"Q{rnd.randrange(9999)}|#" for _ in range(60)), "en") for i in range(10)] + [(300, None, "en"), (0, "the of and", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trusted = spark.createDataFrame([(i,) for i in range(80)] + [(None,)], "doc_id long")
    out = kneser_ney.perplexity_quality(df, trusted).collect()
    assert len(out) == len(rows)
    kept = {r.doc_id: r.kept for r in out if r.lang}
    assert sum(kept[i] for i in range(120)) >= 118 and not any(kept[i] for i in [*range(200, 210), 300])
    assert all(r.kept == (r.n_bytes > 0) for r in kneser_ney.perplexity_quality(df, trusted.limit(0)).collect())
    assert kneser_ney.perplexity_quality(df.limit(0), trusted).count() == 0


def test_restore():
    model = toxicity.CharModel([{toxicity.EDGE * 2 + "i": 5}, _grams("idiot moron clown scum pathetic loser trash stupid ass letter".split())])
    words = toxicity.Words(model)
    want = {"1d10t": "idiot", "m0r0n": "moron", "cl0wn!!": "clown", "s.c.u.m": "scum", "idiooooot": "idiot", "p4th3t1c": "pathetic", "tr@sh,": "trash", "(loser)": "loser", "plain": "plain", "2024": "2024", "": ""}
    want |= {"i" * 30 + "diot": "idiot", "s-t-u-p-i-d-" + "-" * 20: "stupid", "stuupid": "stupid", "trraash": "trash", "a$$": "ass", "letter": "letter", "$100": "100", "04dbebab91ab85687d33eeaaf9ac699e": "04dbebab91ab85687d33eeaaf9ac699e"}
    want |= {"-".join("stupid" * 9): "stupid" * 9}  # 107 characters
    assert {w: words[w] for w in want} == want
    assert words.of("You i d i o t a b c d now") == ["you", words["idiotabcd"], "now"] and words.of("You i d i o t now") == ["you", "idiot", "now"]
    assert words.of("a b word c") == ["a", "b", "word", "c"] and words.of("") == []


def _grams(words):
    out = defaultdict(int)
    for w in words:
        w = toxicity.EDGE * 2 + w + toxicity.EDGE
        for i in range(len(w) - 2):
            out[w[i : i + 3]] += 9
    return dict(out)


def test_toxicity_held_out(spark):
    rnd = random.Random(7)
    bad = "idiot moron clown scum pathetic".split()
    leet = str.maketrans("oiea", "0134")
    docs, labels = [], []
    for i in range(700):
        toxic = i % 4 == 0
        words = prose(rnd, 60).split()
        for _ in range(3 if toxic else 0):
            w = rnd.choice(bad)
            words.insert(rnd.randrange(len(words)), w.translate(leet) if rnd.random() < 0.3 else w)
        docs.append((i, " ".join(words), "en"))
        labels.append((i, int(toxic), 1))
    docs += [(900, None, "en"), (901, "", "en"), (None, "idiot scum moron", "en"), (0, docs[0][1], "en")]
    labels += [(902, 1, 1), (903, None, 1), (None, 1, 1)]
    df, lab = spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    out = toxicity.toxicity(df, lab).collect()
    assert len(out) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    held = [r for r in out if r.held_out and r.doc_id < 700]
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) >= 0.95 * len(held)
    assert {r.predicted for r in out if r.doc_id in (900, 901)} == {0} and [r.predicted for r in out if r.doc_id is None] == [1]
    assert {r.score for r in toxicity.toxicity(df, lab.limit(0)).collect()} == {0.5}
    assert toxicity.toxicity(df.limit(0), lab).count() == 0


def test_toxicity_weighs_every_feature(spark, monkeypatch):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rare = ["z" + a + b + c for a in letters for b in letters for c in letters] + ["y" + a + b + c for a in letters for b in letters for c in letters[:8]]
    rare = sorted(w for w in rare if all(a != b for a, b in zip(w, w[1:])))
    assert len(rare) > 20_000
    known = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 5]
    docs = [(i, " ".join(rare[k % 20 :: 20])) for k, i in enumerate(known[:100])] + [(i, "some calm words of no harm") for i in known[100:600]]
    labels = [(i, int(k < 100)) for k, (i, _) in enumerate(docs)]
    docs += [(2000, "some calm words " + " ".join(rare[:40])), (2001, "some calm words " + " ".join(rare[-40:])), (2002, "some calm words")]
    df, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    score = {r.doc_id: r.score for r in toxicity.toxicity(df, lab).where("doc_id >= 2000").collect()}
    assert abs(score[2000] - score[2001]) < 1e-6 and score[2001] > score[2002]
    monkeypatch.setattr(toxicity, "SHARD_FEATURES", 9000)
    again = {r.doc_id: r.score for r in toxicity.toxicity(df, lab).where("doc_id >= 2000").collect()}
    assert all(abs(again[i] - x) < 1e-9 for i, x in score.items())
