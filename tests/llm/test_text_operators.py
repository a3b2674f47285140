"""Line and span deduplication, WARC records, decontamination, quality rules: brute force, literals, odd rows."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import common, decontaminate, line_dedup, queries, span_dedup, warc, weak_rules

ODD = [(1, "a b\nc d", "s", "x"), (1, "a b\nc d", "s", "x"), (2, None, None, "y"), (3, "", "s", None), (None, "a b\n", "t", "x"), (4, "long " * 30_000, "s", "x")]
ODD_DDL = "doc_id long, text string, source string, keys string"


def test_site_lines_are_brute_force(spark):
    rnd = random.Random(3)
    lines = [f"line {i}" for i in range(30)]
    docs = [(i, "\n".join(rnd.choice(lines if rnd.random() < 0.5 else [f"own {i} {j}" for j in range(3)] + ["", " menu "]) for _ in range(rnd.randrange(1, 9))), f"s{rnd.randrange(3)}") for i in range(120)]
    pages, have = defaultdict(int), defaultdict(int)
    for _, t, s in docs:
        pages[s] += 1
        for x in {x.strip(" ") for x in t.split("\n")} - {""}:
            have[s, x] += 1
    cut = {k for k, n in have.items() if n >= 5 and n > 0.1 * pages[k[0]]}
    want = {i: "\n".join(x for x in t.split("\n") if not x.strip(" ") or (s, x.strip(" ")) not in cut) for i, t, s in docs}
    out = line_dedup.drop_site_lines(spark.createDataFrame(docs, "doc_id long, text string, source string"), F.col("source"), dropped="n")
    got = {r.doc_id: (r.text, r.n) for r in out.collect()}
    assert {i: t for i, (t, _) in got.items()} == want
    assert sum(n for _, n in got.values()) == sum(t.count("\n") - want[i].count("\n") for i, t, _ in docs if want[i]) + sum(len(t.split("\n")) for i, t, _ in docs if not want[i] and t)


def test_site_lines_odd_rows(spark):
    df = spark.createDataFrame(ODD, ODD_DDL)
    out = line_dedup.drop_site_lines(df, F.col("source"))
    assert out.columns == df.columns and sorted(map(str, out.collect())) == sorted(map(str, df.collect()))
    assert line_dedup.drop_site_lines(df.limit(0), F.col("source")).count() == 0


def test_hosts_and_lines(spark):
    r = spark.range(1).select(line_dedup.host_of(F.lit("https://me@Ex.com:80/a?b")).alias("h"), line_dedup.visible_lines(F.lit("<p>a<b>b</b></p><script>x</p></script><!-- c -->d")).alias("t")).first()
    assert (r.h, [x for x in r.t.split("\n") if x]) == ("ex.com", ["ab", "d"])


def brute_spans(docs):
    """Sentences cut as the operator's docstring says; spans compared as word lists."""
    split = {}
    for i, t in docs:
        own = []
        for line in (t or "").split("\n"):
            words = []
            for w in line.split():
                words.append(w.lower())
                if len(words) == span_dedup.LONGEST or re.search(r"[.!?][\"')\]»”]*$", w):
                    own.append(tuple(words))
                    words = []
            if words:
                own.append(tuple(words))
        split[i] = own
    places = defaultdict(list)
    for i in sorted(split):
        s = split[i]
        for a in range(len(s)):
            for b in range(a + span_dedup.SENTENCES, len(s) + 1):
                if sum(map(len, s[a:b])) >= span_dedup.WORDS:
                    places[tuple(s[a:b])].append((i, a, b))
                    break
    gone = defaultdict(set)
    for found in places.values():
        for i, a, b in sorted(found)[1:]:
            gone[i] |= set(range(a, b))
    return {i: (len(split[i]), len(g)) for i, g in gone.items()}


def test_spans_are_brute_force(spark):
    rnd = random.Random(4)
    sentence = lambda: " ".join(f"w{rnd.randrange(500)}" for _ in range(rnd.randrange(1, 25))) + rnd.choice(". ? !\n".split(" "))
    passages = [" ".join(sentence() for _ in range(6)) for _ in range(4)]
    docs = [(i, " ".join(rnd.choice(passages) if rnd.random() < 0.2 else sentence() for _ in range(rnd.randrange(1, 12)))) for i in range(60)]
    docs += [(60, docs[0][1]), (61, docs[0][1].upper()), (62, passages[0] + " " + passages[0]), (63, ""), (64, None), (65, "one"), (66, "no stop " * 400), (67, "no stop " * 400)]
    got = {r.doc_id: (r.n_sentences, r.n_removed) for r in span_dedup.drop_repeated_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_spans(docs)


def test_spans_meet_wherever_a_passage_begins(spark, tmp_path):
    rnd = random.Random(12)
    own = lambda n, stop: " ".join(f"o{rnd.randrange(10**9)}" + ("." if rnd.random() < stop else "") for _ in range(n))
    docs, passages = [], {}
    for i in range(150):
        stop = rnd.choice([0, 0.03, 0.07, 0.3])
        p = " ".join(f"p{rnd.randrange(10**9)}" + ("." if rnd.random() < stop else "") for _ in range(rnd.randrange(50, 60)))
        docs.append((i, f"{own(rnd.randrange(40), stop)} {p} {own(rnd.randrange(40), stop)}"))
        docs.append((1000 + i, f"{own(rnd.randrange(40), stop)} {p.upper()} {own(rnd.randrange(40), stop)}"))
        passages[1000 + i] = set(p.upper().split())
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: set(r.clean.split()) for r in queries.op5_sentence_span_dedup(spark, str(tmp_path)).collect()}
    texts = dict(docs)
    assert set(got) == set(passages)
    assert all(len(passages[i] & w) <= 30 and set(texts[i].split()) - passages[i] <= w for i, w in got.items())
    hashes = common.WordHashes()
    for t in [*texts.values(), "", " \n ", "one", "a " * 30, "A b. C\n\nd e? f"]:
        pieces = span_dedup.sentences(t, hashes)
        assert [x.lower() for p in pieces for x in p[3]] == t.lower().split() and all(0 < p[2] <= 10 and t[p[0] : p[1]].split() == p[3] for p in pieces)
        assert [p[2] for p in pieces] == span_dedup.units(t, hashes, span_dedup._Ends(), True)[0].tolist()


def test_span_texts_and_odd_rows(spark):
    p = "One two three four five six seven. Eight nine ten eleven twelve thirteen. Last words of it are these ones here."
    df = spark.createDataFrame([(1, f"A start. {p} An end.", 0), (2, f"Other start. {p} Another end.", 0), (None, p, 0), (3, None, 0)], "doc_id long, text string, cut int")
    assert [tuple(r) for r in span_dedup.drop_repeated_spans(df).collect()] == [(2, "Other start. Another end.", 5, 3)]
    assert span_dedup.drop_repeated_spans(df.limit(0)).count() == 0


def test_warc_records(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a.b/c", "<title>T</title><p>x &amp;lt; y</p>", "x"), (2, None, None, "x"), (1, "http://a.b/c", "<title>T</title><p>x &amp;lt; y</p>", "x"), (3, "http://l", "<p>" + "é &amp; " * 300_000, "x")], "page_id long, url string, html string, Url string")
    out = warc.derivatives(warc.responses_from_pages(pages))
    rows = out.collect()
    assert len(rows) == 8
    by = {(r.page_id, r.record_type): r for r in rows}
    meta, conv = by[1, "metadata"], by[1, "conversion"]
    assert meta.refers_to == conv.refers_to and conv.record_id in meta.block and meta.payload_digest in meta.block and "Content-Type: text/html" in meta.block
    assert all(re.match(r"[\w-]+: ", line) for r in rows if r.record_type == "metadata" for line in r.block.split("\r\n")[:-1])
    assert conv.block == "T\nx &lt; y" and conv.content_length == len(conv.block)
    assert by[2, "conversion"].block == "" and by[2, "conversion"].target_uri == "" and by[3, "conversion"].block == ("é & " * 300_000).strip()
    warc.write_warc(out.coalesce(1), str(tmp_path / "w"))
    import gzip
    import zlib

    [file] = (tmp_path / "w").glob("*.warc.gz")
    raw, members, text = file.read_bytes(), 0, b""
    while raw:  # one gzip member a record
        z = zlib.decompressobj(31)
        record = z.decompress(raw)
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
        raw, members, text = z.unused_data, members + 1, text + record
    assert members == 8 and text == gzip.open(file).read()
    at = n = 0
    while at < len(text):  # a reader of the format: headers, a blank line, as many bytes as they say, two line breaks
        head, _, rest = text[at:].partition(b"\r\n\r\n")
        size = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert head.startswith(b"WARC/1.1\r\n") and text[at + len(head) + 4 + size :].startswith(b"\r\n\r\n")
        at += len(head) + 4 + size + 4
        n += 1
    assert n == 8 and warc.derivatives(warc.responses_from_pages(pages.limit(0))).count() == 0


def test_character_references_are_those_of_html(spark):
    import html

    texts = ["&eacute; &#233; &#xE9; &mdash; &apos;&quot; &amp;amp; &AMP; &nosuch; & &; &#0; &#55296; &#x110000; &#128512; x&lt;y&gt; &hearts;", "plain", "&", "&amp;", "a&#65;&#66;", ""]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(warc.decoded(F.col("t"))).collect()]
    assert got == [html.unescape(t.replace("&AMP;", "&amp;AMP;")) for t in texts]


def edits(a, b):
    row = [0] * (len(b) + 1)  # the item may start anywhere
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_best_match_is_the_table():
    rnd = random.Random(5)
    for _ in range(200):
        a, b = [rnd.randrange(4) for _ in range(rnd.randrange(1, 9))], [rnd.randrange(4) for _ in range(rnd.randrange(0, 14))]
        m, limit = decontaminate.best_match(a, b, 3), edits(a, b)
        assert (m[0] if m else None) == (limit if b and limit <= 3 and min(limit, len(a)) == limit else None) or limit == len(a)


def test_leaks_are_found_and_exact(spark):
    rnd = random.Random(6)
    vocab = [f"v{i}" for i in range(300)]
    text = lambda n: [rnd.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(text(rnd.randrange(10, 60)))) for i in range(30)] + [(98, None), (99, "")]
    docs, planted = [], set()
    for d in range(120):
        body = text(rnd.randrange(0, 80))
        if d % 2:
            k = rnd.randrange(30)
            copy = items[k][1].split()
            for _ in range(int(0.1 * len(copy)) if d % 4 == 1 else 0):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocab)
            body += [w.upper() + "," for w in copy] + text(20)
            planted.add((d, k))
        docs.append((d, " ".join(body), "clash"))
    docs += [(500, None, ""), (501, "", "")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.benchmark_leaks(df, bench).collect()
    got = {(r.doc_id, r.item_id) for r in out}
    words = {d: decontaminate.words_of(t) for d, t, _ in docs}
    exact = {(d, i): edits(decontaminate.words_of(t), words[d]) for d in words for i, t in items if t}
    true = {k for k, e in exact.items() if e <= int(0.15 * len(decontaminate.words_of(dict(items)[k[1]])))}
    assert got <= true and planted <= true and len(got & planted) >= 0.95 * len(planted)
    assert all(r.distance == exact[r.doc_id, r.item_id] for r in out)
    for blocks in ({"block_items": 7}, {"block_words": 200}):  # windows and repetitions are chosen block by block
        parts = decontaminate.benchmark_leaks(df, bench, **blocks).collect()
        assert all(r.distance == exact[r.doc_id, r.item_id] for r in parts) and len({(r.doc_id, r.item_id) for r in parts} & planted) >= 0.95 * len(planted)
    kept = decontaminate.drop_contaminated(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(words) - {d for d, _ in got}
    assert decontaminate.benchmark_leaks(df.limit(0), bench).count() == 0 and decontaminate.benchmark_leaks(df, bench.limit(0)).count() == 0


def test_leaks_of_every_length_reach_the_recall():
    rnd = random.Random(11)
    own = lambda n: [f"v{rnd.randrange(5000)}" for _ in range(n)]
    items = [(i, own(300)) for i in range(200)] + [(1000 + n * 100 + i, own(n)) for n in (10, 24, 48) for i in range(100)]
    ix = decontaminate.Index([(i, " ".join(w)) for i, w in items], 0.15, 0.95)
    hashes = common.WordHashes()
    found = defaultdict(list)
    for i, words in items[150:]:
        copy = list(words)
        for _ in range(int(0.15 * len(words))):
            at = rnd.randrange(len(copy))
            copy[at : at + 1] = rnd.choice([[], ["edited"], [copy[at], "edited"]])
        text = own(rnd.randrange(40, 80)) + copy + own(40)
        found[len(words)].append(i in {x[1] for x in ix.leaks([hashes.array(text)])})
    assert all(sum(x) >= 0.93 * len(x) for x in found.values()), {n: sum(x) / len(x) for n, x in found.items()}
    assert decontaminate.plan([[1, 2, 3, 4]], 1.0, 1.0) == decontaminate.plan([], 0.15, 0.95) == ({}, {})


def test_lengths_without_a_window_are_looked_for_word_by_word(monkeypatch):
    monkeypatch.setattr(decontaminate, "MAX_REPETITIONS", 0)
    rnd = random.Random(3)
    items = [(i, [f"v{rnd.randrange(300)}" for _ in range(20)]) for i in range(30)]
    ix = decontaminate.Index([(i, " ".join(w)) for i, w in items], 0.15, 0.95)
    hashes = common.WordHashes()
    assert not ix.tables and len(ix.without) == 30
    docs = [["x"] * 5 + w[:7] + ["edit"] + w[8:] + ["y"] * 9 for _, w in items] + [[f"v{rnd.randrange(300)}" for _ in range(2000)]]
    got = {(d, i): (end, dist) for d, i, end, _, dist in ix.leaks([hashes.array(" ".join(x).encode().split()) for x in docs])}
    assert all(got[n, i] == (25, 1) for n, (i, _) in enumerate(items)) and all(d < 30 for d, _ in got)


def test_texts_of_repeated_words_take_seconds():
    """One item of 2,000 equal words and one that repeats a sentence; a text of 200,000 such words, one that stops short, one without."""
    import time

    sentence = "the lamp of the old mill is lit again tonight by nobody".split()
    ix = decontaminate.Index([(1, "word " * 2000), (2, " ".join(sentence * 60))], 0.15, 0.95)
    hashes = common.WordHashes()
    docs = ["word " * 200_000, " ".join(sentence * 18_000), "word " * 1500, "other words here " * 3000]
    began = time.time()
    got = {(d, i): dist for d, i, _, _, dist in ix.leaks([hashes.array(x.encode().split()) for x in docs])}
    assert got == {(0, 1): 0, (1, 2): 0} and time.time() - began < 40


def brute_facts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    count = defaultdict(list)
    for i in range(len(words) - 2):
        count[tuple(words[i : i + 3])].append(i)
    twice = {i + j for at in count.values() if len(at) > 1 for i in at for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(twice)


def test_quality_facts_and_verdicts(spark):
    rnd = random.Random(8)
    good = lambda: "\n".join(" ".join(rnd.choice(["the", "of", "and", "to"] if rnd.random() < 0.4 else [f"word{rnd.randrange(900)}"]) for _ in range(30)) + "." for _ in range(5))
    docs = [(i, good(), "x") for i in range(80)]
    docs += [(100 + i, " ".join(f"zq{rnd.randrange(900)}***" for _ in range(120)), "x") for i in range(12)] + [(150 + i, " ".join(f"ZQ{rnd.randrange(900)}!!" for _ in range(120)), "x") for i in range(8)]
    docs += [(200, None, "x"), (201, "", None), (202, "a b \x0b c\n\na b \x0b c\n", "x"), (203, "same three words " * 60, "x"), (None, good(), "x"), (204, "é" * 200_000, "x"), (0, docs[0][1], "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, kept string")
    out = weak_rules.quality_votes(df).collect()
    assert len(out) == len(docs)
    texts = dict((i, t) for i, t, _ in docs)
    for r in out:
        n, chars, symbols, dup, rep = brute_facts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep)
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n) and not (r.base_failed and r.kept)
    verdict = {r.doc_id: r.kept for r in out}
    assert all(verdict[i] for i in range(80)) and not any(verdict[i] for i in [*range(100, 112), *range(150, 158), 200, 201, 202, 203])
    kept = weak_rules.drop_low_quality(df)
    assert kept.columns == df.columns and kept.where("doc_id = 0").count() == 2 and kept.where("doc_id is null").count() == 1
    assert weak_rules.quality_votes(df.limit(0)).count() == 0


def test_running_total(spark):
    rnd = random.Random(9)
    data = [(f"g{rnd.randrange(3)}", rnd.randrange(9000), i, rnd.randrange(50)) for i in range(300)]
    out = common.running_total(spark.createDataFrame(data, "g string, block long, i long, v long"), ["g"], "block", ["i"], "v", "before").collect()
    for r in out:
        assert r.before == sum(v for g, b, i, v in data if g == r.g and (b, i) < (r.block, r.i))
