"""Event streams: the batch operators' twins in Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import snapshots
from ..operators import usage as U
from ..operators.stored import dealt, forget, stored
from ..sources import corpus


def stream_daily_activity(events: DataFrame, late: str = "2 days") -> DataFrame:
    """events (ts, kind, tokens) -> day, kind, events, tokens; rows later than `late` are dropped (and counted by Spark)."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "kind")
    return w.agg(F.count("*").alias("events"), F.sum("tokens").alias("tokens")).select(F.to_date("window.start").alias("day"), "kind", "events", "tokens")


def stream_usage_windows(usage: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Tokens and cost of each provider in tumbling or sliding windows, with the worst provenance of each sum."""
    win = F.window("occurred_at", size, slide) if slide else F.window("occurred_at", size)
    aggs = [F.count("*").alias("events"), *U.sum_quantity("total_tokens", "total_src", "total_tokens"), *U.sum_cost()]
    return usage.withWatermark("occurred_at", late).groupBy(win, "provider").agg(*aggs).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "provider", "events", "total_tokens", "total_tokens_src", "cost", "cost_src", "currency")


def stream_dedup(events: DataFrame, key: str = "event_id", time: str = "ts", late: str = "1 day") -> DataFrame:
    """A key delivered again within the watermark is ignored; in a batch, one delivered again at all."""
    if not events.isStreaming:
        return events.dropDuplicates([key])
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def activity_sessions(events: DataFrame, user: str = "user_id", time: str = "ts", gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """Runs of activity of each user with no pause of `gap`: start, end (last event + gap), events."""
    e = events.withWatermark(time, late) if late else events
    return e.groupBy(user, F.session_window(time, gap)).agg(F.count("*").alias("events")).select(user, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


def _ms(micros: int) -> int:
    return -(-micros // 1000)


#: Rows that share one entry of waiting state: an entry is a call to the state store, so rows do not go there one by one.
EMA_CHUNK = 8192


class _Ema(StatefulProcessor):
    """Rows wait in a list of chunks until the watermark has passed them; a timer a key, at the earliest of them, lets out all that it has passed, in order."""

    def __init__(self, chunk: int):
        self.chunk = chunk

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at array<long>, event_id array<long>, value array<double>")
        self.last = handle.getValueState("last", "at long, event_id long, ema double")

    def _chunks(self, rows: list) -> list[tuple]:
        """rows (arrays of at, event_id, value) in entries of the list."""
        return [tuple(c[i : i + self.chunk].tolist() for c in rows) for i in range(0, len(rows[0]), self.chunk)]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get() if self.last.exists() else None
        first, late, held, n = None, [], [], 0
        for pdf in rows:
            new = [pdf[c].to_numpy() for c in ("at", "event_id", "value")]
            if last is not None:  # one that comes after them has been averaged already
                gone = (new[0] < last[0]) | ((new[0] == last[0]) & (new[1] < last[1]))
                late += new[1][gone].tolist()
                new = [c[~gone] for c in new]
            if len(new[0]):
                least = int(new[0].min())
                first = least if first is None else min(first, least)
                held, n = held + [new], n + len(new[0])
            if n >= self.chunk:
                self.waiting.appendList(self._chunks([np.concatenate(c) for c in zip(*held)]))
                held, n = [], 0
        if n:
            self.waiting.appendList(self._chunks([np.concatenate(c) for c in zip(*held)]))
        if first is not None:
            at, timers = _ms(first), list(self.handle.listTimers())
            if all(t > at for t in timers):
                for t in timers:
                    self.handle.deleteTimer(t)
                self.handle.registerTimer(at)
        yield self._out(key, late, [None] * len(late), True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        parts = [[np.asarray(c, t) for c, t in zip(r, ("int64", "int64", "float64"))] for r in self.waiting.get()] if self.waiting.exists() else []
        if not parts:
            return
        at, ids, values = (np.concatenate(c) for c in zip(*parts))
        wait = at > passed
        rest, due = [c[wait] for c in (at, ids, values)], [c[~wait] for c in (at, ids, values)]
        order = np.lexsort(due[::-1])
        due = [c[order] for c in due]
        now = self.last.get()[2] if self.last.exists() else 0.0
        out = []
        for v in due[2].tolist():
            now = v if now == 0 else float(int(0.7 * now + 0.3 * v + 0.5))
            out.append(now)
        if out:
            self.last.update((int(due[0][-1]), int(due[1][-1]), now))
            self.waiting.put(self._chunks(rest)) if wait.any() else self.waiting.clear()
        if wait.any():  # the timer that has run out goes by itself
            self.handle.registerTimer(_ms(int(rest[0].min())))
        yield self._out(key, due[1].tolist(), out, False)

    @staticmethod
    def _out(key, ids: list, averages: list, late: bool) -> pd.DataFrame:
        n = len(ids)
        return pd.DataFrame({"kind": pd.Series([key[0]] * n, dtype=object), "event_id": pd.Series(ids, dtype="int64"), "ema": pd.Series(averages, dtype="float64"), "late": pd.Series([late] * n, dtype=bool)})

    def close(self) -> None:
        pass


def stream_latency_ema(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """events (kind, event_id, ts, value) -> kind, event_id, ema, late: the rounded moving average of each kind in event time, however rows arrive.

    A row goes in when the watermark, `late` behind the newest ts, has passed it; until then it is state, and so is one number a kind. Late rows,
    those that come after a later one of their kind has gone in, change no average: they come out with late set and no ema (count them by
    late_counts). Rows of one (ts, event_id) go in by value; rows without ts, event_id or value take no part. The newest rows come out
    when newer ones have moved the watermark.
    """
    e = events.where("ts IS NOT NULL AND event_id IS NOT NULL AND value IS NOT NULL").withWatermark("ts", late)
    # without the time column itself, or Spark would drop late rows before they could be told
    rows = e.select("kind", F.unix_micros("ts").alias("at"), F.col("event_id").cast("long").alias("event_id"), F.col("value").cast("double").alias("value"))
    return rows.groupBy("kind").transformWithStateInPandas(_Ema(EMA_CHUNK), "kind string, event_id long, ema double, late boolean", "append", "eventTime")


def write_averages(averages: DataFrame, root: str, checkpoint: str, once: bool = True):
    """What stream_latency_ema gives, to two tables under root: averages and late. Each micro-batch writes its own folder, so one that runs twice counts once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = stored(batch)
        for name, which in (("averages", "NOT late"), ("late", "late")):
            rows.where(which).drop("late").write.mode("overwrite").parquet(f"{root}/{name}/batch={batch_id}")
        forget(rows)

    w = averages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def late_counts(late: DataFrame) -> DataFrame:
    """The late table of write_averages -> batch, kind, late_rows."""
    return late.groupBy("batch", "kind").agg(F.count("*").alias("late_rows"))


class _Alerts(StatefulProcessor):
    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("used", "used double, told boolean", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        used, told = self.state.get() if self.state.exists() else (0.0, False)
        out = []
        for pdf in rows:
            for tokens, limit in zip(pdf["tokens"], pdf["token_limit"]):
                used += float(tokens)
                if not told and used > limit:
                    told = True
                    out.append((key[0], used, float(limit)))
        self.state.update((used, told))
        yield pd.DataFrame(out, columns=["scope", "used", "token_limit"])

    def close(self) -> None:
        pass


def stream_limit_alerts(usage: DataFrame, limits: DataFrame, ttl_ms: int = 40 * 86_400_000) -> DataFrame:
    """usage (scope, tokens) and limits (scope, token_limit): one row when a scope's total first passes its limit."""
    j = usage.join(limits, "scope").select("scope", F.col("tokens").cast("double").alias("tokens"), F.col("token_limit").cast("double").alias("token_limit"))
    return j.groupBy("scope").transformWithStateInPandas(_Alerts(ttl_ms), "scope string, used double, token_limit double", "append", "processingTime")


def stream_incremental_index(stream: DataFrame, extract: Callable[[DataFrame], DataFrame], root: str, checkpoint: str, once: bool = True):
    """Files that arrive (path, content and, if known, modified_at and deleted) are merged into the stored context under root.

    Of several arrivals of a path in a micro-batch the newest counts; without modified_at, the greatest content. Rows that are deleted take their file
    away. Only files whose hash is new go through extract, and what apply_changes() says they touch is written: their own rows, and links of
    importers whose targets came or went. Every other stored table stays as it is. A micro-batch that runs twice changes nothing.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        row = F.struct(F.col("content"), (F.col("deleted") if "deleted" in batch.columns else F.lit(False)).alias("deleted"))
        newest = F.max_by(row, "modified_at") if "modified_at" in batch.columns else F.max(row)
        arrived = stored(dealt(batch).groupBy("path").agg(newest.alias("r")).select("path", "r.content", F.coalesce("r.deleted", F.lit(False)).alias("deleted")))
        files, gone = arrived.where("not deleted").select("path", "content"), arrived.where("deleted").select("path")
        have = corpus.load_context(spark, root)
        hashes = snapshots.hash_snapshot(files)
        again = hashes.join(have["hashes"].select("path", "hash"), ["path", "hash"], "left_anti") if have else hashes
        fresh = stored(files.join(again.select("path"), "path", "left_semi"))
        if have:
            gone = gone.join(have["files"].select("path"), "path", "left_semi")
        if not (fresh.isEmpty() and (not have or gone.isEmpty())):
            whole = "candidates" not in have
            prev = have if not whole else ({**snapshots.apply_changes(None, have["files"], None, extract)[0], **have} if have else None)
            tables, touched = snapshots.apply_changes(prev, fresh, gone, extract)
            if whole:
                corpus.save_context(spark, have | tables, root)
            else:
                rows = {n: tables[n].join(touched[n].withColumnRenamed("path", p), p, "left_semi") for n in snapshots.INDEX_TABLES for p in [corpus.PATH_OF.get(n, "path")]}
                corpus.save_context(spark, rows, root, changes=True, touched=touched)
        forget(arrived, fresh)

    w = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def ttl_filter(cache: DataFrame, now: Column) -> DataFrame:
    return cache.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))
