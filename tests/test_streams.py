"""Streams give what their batch twins give."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import extract, snapshots
from corpusmill.sources import corpus
from corpusmill.streaming import streams

T0 = datetime.datetime(2024, 1, 1)


@pytest.fixture()
def events(spark, tmp_path):
    data = [(i, T0 + datetime.timedelta(minutes=7 * i), ["view", "click"][i % 2], float(i % 9 + 1), i % 3, i % 50) for i in range(400)]
    df = spark.createDataFrame(data, "event_id long, ts timestamp, kind string, value double, user_id long, tokens long")
    path = str(tmp_path / "events")
    df.repartition(3).write.parquet(path)
    return df, spark.readStream.schema(df.schema).parquet(path)


def drain(df, name, tmp_path, mode="append", **trigger):
    w = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"c_{name}"))
    q = w.trigger(**(trigger or {"availableNow": True})).start()
    assert q.awaitTermination(120)
    return q


def same(a, b):
    return sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


def test_daily_activity(spark, events, tmp_path):
    batch, stream = events
    drain(streams.stream_daily_activity(stream), "daily", tmp_path, "complete")
    assert same(spark.table("daily"), streams.stream_daily_activity(batch))


def test_sessions(spark, events, tmp_path):
    batch, stream = events
    drain(streams.activity_sessions(stream, late="1 hour"), "sessions", tmp_path, "complete")
    assert same(spark.table("sessions"), streams.activity_sessions(batch))


def test_dedup(spark, events, tmp_path):
    batch, stream = events
    drain(streams.stream_dedup(stream.unionByName(stream)).select("event_id"), "dedup", tmp_path)
    assert spark.table("dedup").count() == batch.count()


def test_incremental_index(spark, tmp_path, monkeypatch):
    src, root = tmp_path / "in", str(tmp_path / "store")
    schema = "path string, content string, modified_at timestamp"

    def arrive(rows):
        spark.createDataFrame([(p, c, T0 + datetime.timedelta(minutes=m)) for p, c, m in rows], schema).coalesce(1).write.mode("append").parquet(str(src))

    def run():
        streams.stream_incremental_index(spark.readStream.schema(schema).parquet(str(src)), extract.extract_symbols, root, str(tmp_path / "ck")).awaitTermination(120)

    def names():
        return sorted(r[0] for r in corpus.load_context(spark, root)["symbols"].select("name").collect())

    summaries = spark.createDataFrame([("a.ts", "kept")], "target string, overview string")
    old = spark.createDataFrame([("z.ts", "class Z {\n}\n")], "path string, content string")
    corpus.save_context(spark, {"files": old, "hashes": snapshots.hash_snapshot(old), "symbols": extract.extract_symbols(old), "summaries": summaries, "edges": spark.createDataFrame([("x", "y", "calls")], "src string, dst string, kind string")}, root)
    arrive([("a.ts", "class A {\n}\n", 0), ("b.ts", "class B {\n}\n", 0)])
    run()
    assert names() == ["A", "B", "Z"]
    arrive([("b.ts", "class Newest {\n}\n", 9), ("b.ts", "class Older {\n}\n", 5), ("c.ts", "enum C {\n}\n", 1), ("a.ts", "no symbols now", 2), ("z.ts", "class Z {\n}\n", 3)])
    run()
    out = corpus.load_context(spark, root)
    assert names() == ["C", "Newest", "Z"]
    assert out["files"].count() == out["hashes"].count() == 4
    assert out["summaries"].count() == out["edges"].count() == 1
    n, tables = corpus._pointer(spark, root)
    # the first run wrote all anew, with the tables of imports that the store had lacked
    assert len(tables["files"]) == 2 and spark.read.parquet(f"{root}/{tables['files'][-1].split(':')[1]}").count() == 3  # z.ts has not changed
    monkeypatch.setattr(corpus, "MOST_FOLDERS", 2)
    arrive([("c.ts", "class D {\n}\n", 10)])
    run()
    assert names() == ["D", "Newest", "Z"] and len(corpus._pointer(spark, root)[1]["files"]) == 1


def test_a_broken_store_is_an_error(spark, tmp_path):
    one = spark.createDataFrame([("a",)], "path string")
    version = corpus.save_context(spark, {"files": one}, str(tmp_path))
    import shutil

    shutil.rmtree(tmp_path / version)
    with pytest.raises(Exception):
        corpus.load_context(spark, str(tmp_path))["files"].count()
    assert corpus.load_context(spark, str(tmp_path / "nothing")) == {}


def test_usage_windows(spark, events, tmp_path):
    batch, stream = events
    usage = lambda df: df.select(F.col("ts").alias("occurred_at"), F.col("kind").alias("provider"), F.col("tokens").cast("double").alias("total_tokens"), F.lit(0).alias("total_src"), F.lit(1.0).alias("cost"), F.lit(1).alias("cost_src"), F.lit("USD").alias("currency"))
    for name, slide in (("tumbling", None), ("sliding", "30 minutes")):
        drain(streams.stream_usage_windows(usage(stream), slide=slide), name, tmp_path, "complete")
        assert same(spark.table(name), streams.stream_usage_windows(usage(batch), slide=slide))


def test_usage_source(spark, tmp_path):
    rows = spark.createDataFrame([("1", "openai", T0, 5), ("2", None, None, None)], "id string, provider string, occurred_at timestamp, input_tokens long")
    rows.write.json(str(tmp_path / "in"))
    assert sorted(tuple(r) for r in corpus.usage_source(spark, str(tmp_path / "in")).select("id", "provider", "input_tokens").na.fill("-").na.fill(-1).collect()) == [("1", "openai", 5), ("2", "-", -1)]
    drain(corpus.usage_source(spark, str(tmp_path / "in"), stream=True).select("id", "occurred_at"), "usage", tmp_path)
    assert sorted(r[0] for r in spark.table("usage").collect()) == ["1", "2"]


def test_ttl(spark):
    c = spark.createDataFrame([(1, None), (2, T0), (3, T0 + datetime.timedelta(days=1))], "key int, expires_at timestamp")
    assert sorted(r[0] for r in streams.ttl_filter(c, F.lit(T0)).select("key").collect()) == [1, 3]


@pytest.fixture()
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def test_latency_ema(spark, events, tmp_path, rocks):
    from corpusmill.operators import activity

    batch, _ = events
    src, rnd = tmp_path / "in", random.Random(3)
    data = [tuple(r) for r in batch.select("event_id", "ts", "kind", "value").collect()]
    data.append((7, data[7][1], data[7][2], 3.0))  # the same event once more
    schema = "event_id long, ts timestamp, kind string, value double"
    data.sort(key=lambda r: r[1] + datetime.timedelta(minutes=rnd.randrange(600)))  # up to ten hours out of order
    odd = [(None, T0, "view", 1.0), (9_000, None, "view", 1.0), (9_001, T0, "view", None)]

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        out = streams.stream_latency_ema(spark.readStream.schema(schema).parquet(str(src)), late="11 hours")
        streams.write_averages(out, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)

    for k in range(3):
        run(data[k * len(data) // 3 : (k + 1) * len(data) // 3] + (odd if k == 1 else []))
    run([(-1, T0 + datetime.timedelta(days=30), "end", 1.0)])
    run([(9_002, T0, "view", 5.0), (9_003, T0 + datetime.timedelta(days=29), "view", 7.0), (9_004, T0, "new", 2.0), (-2, T0 + datetime.timedelta(days=60), "end", 1.0)])
    got = spark.read.parquet(str(tmp_path / "out/averages"))
    whole = spark.createDataFrame(data + [(9_003, T0 + datetime.timedelta(days=29), "view", 7.0), (9_004, T0, "new", 2.0), (-1, T0 + datetime.timedelta(days=30), "end", 1.0)], schema)
    want = activity.latency_ema(whole, "kind", "value", ["ts", "event_id", "value"])
    assert sorted((r.kind, r.ema) for r in got.collect()) == sorted((r.kind, r.ema) for r in want.collect())
    assert {(r.event_id, r.kind) for r in got.collect()} == {(r[0], r[2]) for r in whole.select(*schema.replace(",", "").split()[::2]).collect()}
    late = streams.late_counts(spark.read.parquet(str(tmp_path / "out/late"))).collect()
    assert [(r.kind, r.late_rows) for r in late] == [("view", 1)]


def test_limit_alerts(spark, events, tmp_path, rocks):
    batch, stream = events
    limits = spark.createDataFrame([("view", 100.0), ("click", 1e9)], "scope string, token_limit double")
    used = stream.select(F.col("kind").alias("scope"), "tokens")
    drain(streams.stream_limit_alerts(used, limits), "alerts", tmp_path, "append", once=True)  # with a time to live, availableNow runs empty batches for ever
    out = spark.table("alerts").collect()
    assert [r.scope for r in out] == ["view"] and out[0].used > 100


def test_waiting_rows_share_entries_of_state():
    import pandas as pd

    calls = []

    class State:
        def __init__(self, name):
            self.name, self.rows = name, []

        def exists(self):
            return bool(self.rows)

        def get(self):
            calls.append(self.name)
            return iter(self.rows) if self.name == "waiting" else self.rows[0]

        def appendList(self, rows):
            calls.append(self.name)
            self.rows += rows

        def put(self, rows):
            calls.append(self.name)
            self.rows = list(rows)

        def appendValue(self, row):
            self.appendList([row])

        def update(self, row):
            self.put([row])

        def clear(self):
            self.put([])

    class Handle:
        timers = []
        getListState = getValueState = lambda self, name, ddl: State(name)
        listTimers = lambda self: list(self.timers)
        registerTimer = lambda self, t: self.timers.append(t)
        deleteTimer = lambda self, t: self.timers.remove(t)

    class Passed:
        def getCurrentWatermarkInMs(self):
            return 15

    ema = streams._Ema(streams.EMA_CHUNK)
    ema.init(Handle())
    rows = [(at, i, float(i % 97)) for i, at in enumerate(random.Random(5).sample(range(20_000), 20_000))]
    pdfs = [pd.DataFrame(rows[i : i + 500], columns=["at", "event_id", "value"]) for i in range(0, len(rows), 500)]
    assert sum(len(p) for p in ema.handleInputRows(("k",), iter(pdfs), None)) == 0
    (out,) = ema.handleExpiredTimer(("k",), Passed(), None)
    want, now = [], 0.0
    for _, _, v in (due := sorted(r for r in rows if r[0] <= 15_000)):
        now = v if now == 0 else float(int(0.7 * now + 0.3 * v + 0.5))
        want.append(now)
    assert out["event_id"].tolist() == [r[1] for r in due] and out["ema"].tolist() == want
    assert sum(len(c[0]) for c in ema.waiting.rows) == 20_000 - len(due) and len(calls) < 20
