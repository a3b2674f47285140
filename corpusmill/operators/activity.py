"""Activity metrics: daily history, lifetime snapshots, moving latency, savings, scored answers, run steps."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed as X
from ..functions import scalars as S
from .stored import stored

#: Kinds of activity and the counter of each.
COUNTERS = {"scan": "scans", "context_build": "context_builds", "search": "searches", "summary": "summaries", "agent_run": "agent_runs", "error": "errors"}


def daily_activity(events: DataFrame, keep: int = X.HISTORY_DAYS) -> DataFrame:
    """events (ts, kind, baseline_tokens, used_tokens) -> one row a day with six counters and token sums; the last days only."""
    saved = F.greatest(F.lit(0), F.col("baseline_tokens") - F.col("used_tokens"))
    counts = [F.count_if(F.col("kind") == k).alias(c) for k, c in COUNTERS.items()]
    return events.groupBy(F.to_date("ts").alias("date")).agg(*counts, F.sum("used_tokens").alias("tokens_used"), F.sum("baseline_tokens").alias("baseline_tokens"), F.sum(saved).alias("saved_tokens")).orderBy(F.desc("date")).limit(keep)


def rolling_activity(daily: DataFrame, key: str, value: str, days: int = X.HISTORY_DAYS) -> DataFrame:
    """daily (key, date, value) with the sum of value over the last `days` days of each key."""
    n = F.unix_date("date")
    return daily.withColumn(f"{value}_rolling", F.sum(value).over(Window.partitionBy(key).orderBy(n).rangeBetween(-(days - 1), 0)))


def cumulative_savings(events: DataFrame) -> DataFrame:
    """Per day: baseline, used, saved, and their running sums. Days are summed first; the window is over days."""
    saved = F.greatest(F.lit(0), F.col("baseline_tokens") - F.col("used_tokens"))
    days = events.groupBy(F.to_date("ts").alias("date")).agg(F.sum("baseline_tokens").alias("baseline"), F.sum("used_tokens").alias("used"), F.sum(saved).alias("saved"))
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return days.select("date", "baseline", "used", "saved", *[F.sum(c).over(w).alias(f"{c}_running") for c in ("baseline", "used", "saved")])


def activity_snapshot(events: DataFrame) -> DataFrame:
    """One row: lifetime counters, first and latest scan, the latest scan's size, and savings over all."""
    scan = F.col("kind") == "scan"
    counts = [F.count_if(F.col("kind") == k).alias(c) for k, c in COUNTERS.items()]
    one = events.agg(*counts, F.min(F.when(scan, F.col("ts"))).alias("first_scan"), F.max(F.when(scan, F.col("ts"))).alias("latest_scan"), F.max_by(F.when(scan, F.col("files")), F.when(scan, F.struct("ts", "event_id"))).alias("last_files"), F.sum("baseline_tokens").alias("baseline"), F.sum("used_tokens").alias("used"))
    return one.withColumn("s", S.calculate_savings(F.col("baseline"), F.col("used"))).select("*", "s.saved", "s.percent").drop("s")


#: Events in a block of the moving average, and blocks in a block of blocks.
EMA_BLOCK = 4096
#: Start states looked at together.
EMA_STATES = 1 << 20


def _ema_parts(lo: int, hi: int) -> tuple[Callable, Callable]:
    """(ends, through) for averages from lo to hi; functions of a function, so that workers need no package of ours."""
    slice_ = EMA_STATES

    def after(now, value):
        """The average after one more value; now is 0 where it starts anew."""
        return np.where(now == 0, value, np.trunc(0.7 * now + 0.3 * value + 0.5))

    def ends(values: np.ndarray) -> tuple[list[int], list[float], float]:
        """Where whole numbers lo to hi lead past the first value: the first of each run of starts with one end, and the ends. Rounding lets most
        states meet soon. And where the first value itself leads."""
        firsts, out = [], []
        raw = np.float64(values[0])
        for v in values[1:]:
            raw = after(raw, v)
        for at in range(lo, hi + 1, slice_):
            starts = np.arange(at, min(at + slice_, hi + 1))
            state, where = starts.astype(float), np.arange(len(starts))
            for i, v in enumerate(values[1:]):
                state = after(state, v)
                if len(state) > 8 and i % 4 == 3:
                    state, back = np.unique(state, return_inverse=True)
                    where = back[where]
            end = state[where]
            new = np.flatnonzero(np.append(True, end[1:] != end[:-1]))
            firsts += starts[new].tolist()
            out += end[new].tolist()
        return firsts, out, float(raw)

    def through(start: float, first: float, raw_end: float, firsts: list, out: list) -> float:
        """The average after a block: its first value is taken by itself, what comes out is a whole number or that value."""
        return raw_end if start == 0 else out[bisect_right(firsts, float(after(np.float64(start), first))) - 1]

    return ends, through


def latency_ema(events: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """The moving average after each event: the first value, then round(0.7 * before + 0.3 * value); restarts after 0. Columns key, ord, value, ema.

    Events lie in blocks of EMA_BLOCK in order of key and order. A block is a map from the average before it to that after it: rounding
    makes its whole-number starts lead to few ends. Blocks' maps are composed in blocks of blocks, and those one after the other;
    then each block, knowing where it starts, is gone through by itself. No task sees more of a key than a block.
    """
    rows = events.where(F.col(value).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(value).cast("double").alias("v"), F.struct(*order).alias("o"))
    span = rows.agg(F.floor(F.min("v")), F.ceil(F.max("v"))).first()
    if span[0] is None:
        return rows.select(F.col("k").alias(key), F.lit(0).cast("long").alias("ord"), F.col("v").alias(value), F.col("v").alias("ema"))
    lo, hi, size = min(0, span[0]) - 1, max(0, span[1]) + 1, EMA_BLOCK
    ends_of, through = _ema_parts(lo, hi)
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def dealt(batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        block, at, last = (TaskContext.get().partitionId() << 32) - 1, size, ""
        for pdf in batches:
            blocks, places = [], []
            for k in pdf["k"].astype(object).where(pdf["k"].notna(), None):
                if k != last or at == size:
                    block, at, last = block + 1, 0, k
                blocks.append(block), places.append(at)
                at += 1
            yield pdf[["k", "v"]].assign(block=blocks, i=places)

    lined = stored(rows.repartitionByRange(parts, F.col("k").asc_nulls_first(), "o").sortWithinPartitions(F.col("k").asc_nulls_first(), "o").select("k", "v").mapInPandas(dealt, "k string, v double, block long, i int"))

    def summed(pdf):
        import pandas as pd

        v = pdf.sort_values("i")["v"].to_numpy()
        firsts, ends, raw = ends_of(v)
        return pd.DataFrame({"k": [pdf["k"].iloc[0]], "block": [pdf["block"].iloc[0]], "n": [len(v)], "first": [v[0]], "raw_end": [raw], "firsts": [firsts], "ends": [ends]})

    ddl = "k string, block long, n long, first double, raw_end double, firsts array<long>, ends array<double>"
    maps = stored(lined.groupBy("block").applyInPandas(summed, ddl))
    # blocks of blocks: a key's blocks of one part of the order, size of them at most
    tops = maps.withColumn("top", F.floor(F.col("block") / size))

    def composed(pdf):
        import pandas as pd

        pdf = pdf.sort_values("block")
        each = list(zip(pdf["first"], pdf["raw_end"], pdf["firsts"].map(list), pdf["ends"].map(list)))
        firsts, ends = each[0][2], [float(x) for x in each[0][3]]
        raw = each[0][1]
        for m in each[1:]:
            raw, ends = through(raw, *m), [through(x, *m) for x in ends]
        return pd.DataFrame({"k": [pdf["k"].iloc[0]], "top": [pdf["top"].iloc[0]], "n": [int(pdf["n"].sum())], "first": [each[0][0]], "raw_end": [raw], "firsts": [firsts], "ends": [ends]})

    big = tops.groupBy("k", "top").applyInPandas(composed, ddl.replace("block long", "top long"))

    def chained(id_: str):
        def of(pdf):
            import pandas as pd

            pdf, state, n, out = pdf.sort_values(id_), None, None, []
            for r in pdf.itertuples(index=False):
                state, n = (getattr(r, "start0", 0.0), int(getattr(r, "ord0", 0))) if state is None else (state, n)
                out.append((r.k, getattr(r, id_), state, n))
                state, n = through(state, r.first, r.raw_end, list(r.firsts), list(r.ends)), n + int(r.n)
            return pd.DataFrame(out, columns=["k", id_, "start", "ord"])

        return of

    heads = big.groupBy("k").applyInPandas(chained("top"), "k string, top long, start double, ord long")
    begun = tops.join(heads.select(F.col("k").alias("hk"), F.col("top").alias("ht"), F.col("start").alias("start0"), F.col("ord").alias("ord0")), F.col("k").eqNullSafe(F.col("hk")) & (F.col("top") == F.col("ht")))
    starts = begun.drop("hk", "ht").groupBy("k", "top").applyInPandas(chained("block"), "k string, block long, start double, ord long")

    def walked(pdf):
        pdf, now, out = pdf.sort_values("i"), float(pdf["start"].iloc[0]), []
        for v in pdf["v"]:
            now = float(v) if now == 0 else float(int(0.7 * now + 0.3 * float(v) + 0.5))
            out.append(now)
        return pdf.assign(ema=out, ord=pdf["ord"] + pdf["i"] + 1)[["k", "ord", "v", "ema"]]

    each = lined.join(starts.select("block", "start", "ord"), "block")
    return each.groupBy("block").applyInPandas(walked, "k string, ord long, v double, ema double").select(F.col("k").alias(key), "ord", F.col("v").alias(value), "ema")


def latency_ema_unrounded(events: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """The last value of the same average without rounding, in closed form: weights 0.3 * 0.7^k, the first 0.7^(n-1).

    Only a key's first event and its last 2000 count: 0.7^2000 is below the least positive double.
    """
    known = events.where(F.col(value).isNotNull())
    place = F.struct(*order)
    first = known.groupBy(key).agg(F.min_by(value, place).alias("first"), F.count("*").alias("n"))
    last = known.withColumn("back", F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])) - 1).where("back < 2000")
    sums = last.join(first, key).groupBy(key).agg(F.sum(F.when(F.col("back") < F.col("n") - 1, F.pow(F.lit(0.7), F.col("back")) * 0.3 * F.col(value))).alias("recent"), F.max(F.pow(F.lit(0.7), F.col("n") - 1) * F.col("first")).alias("oldest"))
    return sums.select(key, (F.coalesce("recent", F.lit(0.0)) + F.col("oldest")).alias("ema"))


def savings_report(contexts: DataFrame, corpora: DataFrame) -> DataFrame:
    """contexts (task_id, repo_id, used_tokens) against the whole repository (repo_id, lines): tokens saved by each task."""
    j = contexts.groupBy("task_id", "repo_id").agg(F.sum("used_tokens").alias("used")).join(corpora.select("repo_id", S.estimate_baseline_tokens(F.col("lines")).alias("baseline")), "repo_id")
    return j.withColumn("s", S.calculate_savings(F.col("baseline"), F.col("used"))).select("task_id", "repo_id", "baseline", "used", "s.saved", "s.percent")


def score_answers(answers: DataFrame, expected: DataFrame) -> DataFrame:
    """answers (task_id, mode, text), expected (task_id, term) -> coverage and points: all terms 2, some 1, none 0; null text -1."""
    j = answers.join(expected, "task_id")
    hit = F.contains(F.lower("text"), F.lower("term"))
    cov = j.groupBy("task_id", "mode").agg(F.avg(F.coalesce(hit, F.lit(False)).cast("int")).alias("coverage"), F.bool_and(F.col("text").isNull()).alias("failed"))
    return cov.select("task_id", "mode", "coverage", F.when(F.col("failed"), -1).when(F.col("coverage") == 1, 2).when(F.col("coverage") > 0, 1).otherwise(0).alias("points"))


def answer_totals(scored: DataFrame, modes: list[str]) -> DataFrame:
    """score_answers() with one row for each task: points and coverage of each mode side by side, and the mode that won; and in the row
    without a task the sums of points and mean coverages over all."""
    pick = lambda m, c: F.max(F.when(F.col("mode") == m, F.col(c)))
    rows = scored.groupBy("task_id").agg(*[pick(m, c).alias(f"{m}_{c}") for m in modes for c in ("points", "coverage")])
    best = F.greatest(*[F.coalesce(f"{m}_points", F.lit(-2)) for m in modes])
    leaders = F.filter(F.array(*[F.when(F.coalesce(f"{m}_points", F.lit(-2)) == best, F.lit(m)) for m in modes]), lambda m: m.isNotNull())
    rows = rows.withColumn("winner", F.when(F.size(leaders) == 1, leaders[0]).otherwise("tie"))
    total = rows.agg(*[(F.sum if c == "points" else F.avg)(f"{m}_{c}").alias(f"{m}_{c}") for m in modes for c in ("points", "coverage")])
    total = total.select(F.lit(None).cast(rows.schema["task_id"].dataType).alias("task_id"), *[F.col(f"{m}_{c}").cast(rows.schema[f"{m}_{c}"].dataType) for m in modes for c in ("points", "coverage")], F.lit("all").alias("winner"))
    return rows.unionByName(total)


def run_step_details(steps: DataFrame) -> DataFrame:
    """steps (task_id, mode, at, event as JSON) -> for each run all kinds of tokens (input, output, reasoning, cache_read, cache_write), cost,
    steps, and the time of a call: from each step to the next (mean and longest, in seconds). Missing kinds count as 0."""
    kinds = ("input", "output", "reasoning", "cache_read", "cache_write")
    e = F.from_json("event", ", ".join(f"{k} long" for k in kinds) + ", cost double")
    w = Window.partitionBy("task_id", "mode").orderBy("at", "event")
    rows = steps.select("task_id", "mode", "at", "event", e.alias("e")).withColumn("took", F.unix_micros(F.lead("at").over(w).cast("timestamp")) / 1e6 - F.unix_micros(F.col("at").cast("timestamp")) / 1e6)
    sums = [F.sum(F.coalesce(f"e.{k}", F.lit(0))).alias(k) for k in kinds]
    return rows.groupBy("task_id", "mode").agg(*sums, F.round(F.sum("e.cost"), 6).alias("cost"), F.count("*").alias("steps"), F.round(F.avg("took"), 3).alias("mean_seconds"), F.max("took").alias("longest_seconds"))


def rollup_run_steps(steps: DataFrame) -> DataFrame:
    """steps (task_id, mode, event as JSON with tokens and cost) -> sums for each task, the two modes side by side, savings."""
    e = F.from_json("event", "input long, output long, cost double")
    runs = steps.select("task_id", "mode", e.alias("e")).groupBy("task_id", "mode").agg(F.sum("e.input").alias("input"), F.sum("e.output").alias("output"), F.round(F.sum("e.cost"), 6).alias("cost"), F.count("*").alias("steps"))
    runs = runs.withColumn("total", F.col("input") + F.col("output"))
    base, treated = runs.where("mode = 'baseline'"), runs.where("mode = 'treatment'")
    pick = lambda df, p: df.select("task_id", *[F.col(c).alias(f"{p}_{c}") for c in ("total", "cost", "steps")])
    j = pick(base, "base").join(pick(treated, "used"), "task_id").withColumn("s", S.calculate_savings(F.col("base_total"), F.col("used_total")))
    return j.select("task_id", "base_total", "used_total", "base_cost", "used_cost", "base_steps", "used_steps", "s.saved", "s.percent")
