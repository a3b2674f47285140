"""The rounded moving average against a plain loop: hot keys over many blocks, restarts, ties, null keys."""

import random

import pytest

from corpusmill.operators import activity as A


@pytest.mark.parametrize("block", [4, 16, 4096])
def test_blocks_give_the_plain_fold(spark, monkeypatch, block):
    monkeypatch.setattr(A, "EMA_BLOCK", block)
    rnd = random.Random(block)
    rows = [(rnd.choice(["hot"] * 9 + ["b", None]), i // 2, i, None if i % 17 == 0 else float(rnd.choice([0, 0, 1, 0.4, 7.25, rnd.randrange(900)]))) for i in range(1500)]
    rows += [("zeros", i, i, 0.0) for i in range(30)] + [("one", 1, 1, 3.5)]
    df = spark.createDataFrame(rows, "kind string, ts long, event_id long, ms double").repartition(5)
    want = []
    for k in {r[0] for r in rows}:
        now, n = 0.0, 0
        for _, _, _, v in sorted((r for r in rows if r[0] == k), key=lambda r: r[1:3]):
            if v is not None:
                n, now = n + 1, v if now == 0 else float(int(0.7 * now + 0.3 * v + 0.5))
                want.append((str(k), n, v, now))
    got = A.latency_ema(df, "kind", "ms", ["ts", "event_id"]).collect()
    assert sorted((str(r.kind), r.ord, r.ms, r.ema) for r in got) == sorted(want)
    assert A.latency_ema(df.limit(0), "kind", "ms", ["ts", "event_id"]).count() == 0


def test_starts_meet(spark):
    """The map of a block of a thousand values from a million starts has few ends."""
    import numpy as np

    ends, through = A._ema_parts(-1, 1_000_000)
    values = np.random.default_rng(1).integers(1, 1_000_000, 1000).astype(float)
    firsts, out, raw = ends(values)
    assert len(out) < 5
    for start in (0, 1, 17, 5e5, 1e6, 0.5):
        now = start
        for v in values:
            now = float(v) if now == 0 else float(int(0.7 * now + 0.3 * float(v) + 0.5))
        assert through(start, values[0], raw, firsts, out) == now
