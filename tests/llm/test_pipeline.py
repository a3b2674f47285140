"""The pipeline against the same stages by brute force on a small corpus."""

import random
from collections import defaultdict

import corpus_pipeline
from corpusmill.llm import decontaminate, packing, weak_rules

from .test_minhash import brute
from .test_text_operators import brute_facts, edits

DDL = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rnd = random.Random(11)
    word = lambda: rnd.choice(["the", "of", "and", "to"]) if rnd.random() < 0.35 else f"word{rnd.randrange(4000)}"
    text = lambda n: "\n".join(" ".join(word() for _ in range(25)) + "." for _ in range(n))
    items = [(i, " ".join(f"item{i}x{j}" for j in range(30))) for i in range(4)]
    docs = [(i, text(rnd.randrange(4, 9))) for i in range(70)]
    docs += [(100 + i, docs[i % 5][1]) for i in range(15)]  # copies
    docs += [(130 + i, docs[20 + i][1].replace("word", "Word", 1)) for i in range(6)]  # near copies
    docs += [(150 + i, text(6) + "\n" + items[i % 4][1] + ".") for i in range(8)]  # leaks
    docs += [(170 + i, " ".join(f"q{rnd.randrange(900)}###" for _ in range(90))) for i in range(8)] + [(190, None), (191, ""), (192, "too short")]
    docs = [(i, t if t is None or i % 3 else t + "\nShared footer of the whole site here.") for i, t in docs]
    return [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in docs], items


def test_pipeline_is_brute_force(spark, tmp_path):
    docs, items = corpus()
    spark.createDataFrame(docs, DDL).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    # quality: base rules in plain Python, the rest of the verdict refitted from the votes
    votes = weak_rules.quality_votes(spark.createDataFrame(docs, DDL)).collect()
    names = list(weak_rules.rules())
    patterns = defaultdict(int)
    for r in votes:
        patterns[tuple(r[f"v_{n}"] for n in names)] += 1
    model = weak_rules.fit_label_model(list(patterns.items()), names)
    good = {}
    for r in votes:
        n, _, _, _, rep = brute_facts(next(t for i, t, *_ in docs if i == r.doc_id))
        odds = model.prior + sum(model.weight[x][r[f"v_{x}"]] for x in names)
        good[r.doc_id] = n >= 50 and 100 * rep <= 50 * n and odds >= 0
    left = [(i, t, s) for i, t, _, s, _ in docs if good[i]]
    assert {i for i, *_ in left} >= set(range(70)) and not {i for i, *_ in left} & {*range(170, 178), 190, 191, 192}
    # lines
    pages, have = defaultdict(int), defaultdict(int)
    for _, t, s in left:
        pages[s] += 1
        for x in {x.strip(" ") for x in t.split("\n")} - {""}:
            have[s, x] += 1
    cut = {k for k, n in have.items() if n >= 5 and n > 0.1 * pages[k[0]]}
    assert cut
    left = [(i, "\n".join(x for x in t.split("\n") if (s, x.strip(" ")) not in cut), s) for i, t, s in left]
    # near copies, then leaks
    component = brute([(i, t) for i, t, _ in left], 80)
    left = [(i, t, s) for i, t, s in left if component[i][1] == i]
    leaks = {i for i, t, _ in left for _, item in items if edits(decontaminate.words_of(item), decontaminate.words_of(t)) <= int(0.15 * 30)}
    assert leaks
    left = {i: t for i, t, _ in left if i not in leaks}
    got = defaultdict(int)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r.doc_id] += r.length
    import public_tokenizers

    ids = packing.Ids(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, "<u2")
    assert dict(got) == {i: len(ids.of(t)) // 2 + 1 for i, t in left.items()}


def test_stages_keep_columns(spark):
    docs, _ = corpus()
    df = spark.createDataFrame([(*d, "x") for d in docs], DDL + ", component_id string")
    for name, stage in corpus_pipeline.STAGES[:3]:
        assert stage(spark, df, "").columns == df.columns, name
        assert stage(spark, df.limit(0), "").count() == 0, name
