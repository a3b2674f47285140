"""Toxicity behind a noisy channel: disguised words are restored by Viterbi decoding, then the text is scored.

A word that has digits or signs among its letters, a letter twice in a row, or single letters set apart may be
a disguise, however long it is. Its lattice offers, for each character, what it may stand for; a character trigram model, of the words
of all documents and those of toxic training texts alike, finds the likeliest path. Restored words and their
beginnings carry weights learnt from labels, and a small logistic model turns a text's weights into a probability.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Letters that a sign may stand for.
SIGNS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l"}
#: Signs between letters that may stand for nothing.
APART = ".-_*'~·,/\\:;#^`\""
#: A restored word whose letters are less likely than this, on the geometric mean, is no word: what is written is kept.
LEAST_LIKELY = 0.01
#: A doubled letter is natural where both trigrams that hold it have at least this log chance.
NATURAL = math.log(0.02)
#: Weighed features in one broadcast. More are taken in shards of about this many, one pass over the documents each.
SHARD_FEATURES = 400_000
#: The logistic model is fitted on this many training texts at most (by hash of the id).
FIT_ROWS = 50_000

#: Words that a Python worker remembers as restored.
WORDS_HELD = 400_000

EDGE = "\x02"


class CharModel:
    """log p of a letter after two others: two trigram tables mixed half and half, over an even floor."""

    def __init__(self, tables: list[dict[str, int]]):
        self.tables = []
        letters = {c for t in tables for g in t for c in g}
        self.floor = math.log(0.02 / max(26, len(letters)))
        self.cache: dict[str, float] = {}
        for t in tables:
            context: Counter = Counter()
            for g, n in t.items():
                context[g[:2]] += n
            self.tables.append((t, context))

    def log_p(self, gram: str) -> float:
        p = self.cache.get(gram)
        if p is None:
            parts = [t.get(gram, 0) / c[gram[:2]] for t, c in self.tables if c.get(gram[:2])]
            p = self.cache[gram] = math.log(math.exp(self.floor) + 0.98 * sum(parts) / max(1, len(self.tables)))
        return p


def lattice(word: str) -> list[list[tuple[str, float]]]:
    """For each run of one character: what it may stand for ('' for nothing) and the log chance of that disguise."""
    steps: list[list[tuple[str, float]]] = []
    i = 0
    while i < len(word):
        c, j = word[i], i
        while j < len(word) and word[j] == c:
            j += 1
        run = j - i
        if c.isalpha():
            ways = [(c, -0.1)] if run == 1 else [(c + c, -0.2), (c, -3.5)] if run == 2 else [(c, -0.7), (c + c, -0.7)]
        else:
            ways = [(x * k, -1.0 - 0.2 * (run > k)) for x in SIGNS.get(c, "") for k in ((1, 2) if run > 1 else (1,))]
            if c in APART or not ways:
                ways.append(("", -0.5))
            elif run > 2 or c in "!|+(<":
                ways.append(("", -2.0))
        steps.append(ways)
        i = j
    return steps


def restore(word: str, model: CharModel) -> str | None:
    """The likeliest plain word for a disguised one: Viterbi over the lattice, with the last two letters as state.

    None where the letters found are no likely word, as in digests and numbers of parts.
    """
    states: dict[str, tuple[float, str]] = {EDGE * 2: (0.0, "")}
    for ways in lattice(word):
        after: dict[str, tuple[float, str]] = {}
        for state, (score, path) in states.items():
            for letters, chance in ways:
                s, now = score + chance, state
                for c in letters:
                    s += model.log_p(now + c)
                    now = now[1] + c
                if now not in after or s > after[now][0]:
                    after[now] = (s, path + letters)
        states = after
    path = max((s + model.log_p(state + EDGE), path) for state, (s, path) in states.items())[1]
    spelt = EDGE * 2 + path + EDGE
    likely = sum(model.log_p(spelt[i : i + 3]) for i in range(len(spelt) - 2)) / (len(spelt) - 2)
    return path if path and likely >= math.log(LEAST_LIKELY) else None


_EDGES = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum()) + "«»“”„…¡¿"
_INNER_EDGES = _EDGES.translate({ord(c): None for c in "@$!|+(<"})


def disguised(word: str) -> bool:
    """word: lower-cased, without signs at its ends that stand for nothing. Numbers are none, nor is what has no letter and
    no sign that looks like one."""
    if len(word) < 3:
        return False
    if word.isalpha():
        return any(map(str.__eq__, word, word[1:]))
    letters = sum(map(str.isalpha, word))
    if letters * 2 >= len(word):
        return True
    like = all(c.isalpha() or c in SIGNS for c in word)
    return like and (letters > 0 or any(not c.isdigit() for c in word) and not any(map(str.isdigit, word)))


class Words(dict):
    """Written word -> the plain word it stands for ('' for none), remembered up to WORDS_HELD words."""

    def __init__(self, model: CharModel | None):
        self.model = model

    def __missing__(self, written: str) -> str:
        if len(self) >= WORDS_HELD:
            self.clear()
        plain = written.strip(_EDGES)
        if self.model:
            inner = written.strip(_INNER_EDGES)
            bare = len(plain) > 2 and plain.isalpha()  # signs at most at its ends, where they stand for nothing
            if disguised(plain if bare else inner) and not (bare and self.natural(plain)):
                plain = restore(inner, self.model) or plain
        self[written] = plain
        return plain

    def natural(self, word: str) -> bool:
        """Whether every doubled letter of a word is one that words double there (the tt of letter)."""
        spelt = EDGE + word + EDGE
        return all(self.model.log_p(spelt[i : i + 3]) >= NATURAL and self.model.log_p(spelt[i + 1 : i + 4]) >= NATURAL for i in range(len(word)) if spelt[i + 1] == spelt[i + 2])

    def of(self, text: str) -> list[str]:
        """The plain words of a text; three or more single characters in a row are one word set apart."""
        written = text.lower().split()
        lone = [i for i, w in enumerate(written) if len(w) == 1]
        if not lone:
            return list(map(self.__getitem__, written))
        out, at = [], 0
        for begin, end in _runs(lone):
            out += map(self.__getitem__, written[at:begin])
            out += [self["".join(written[begin:end])]] if end - begin > 2 else [self[w] for w in written[begin:end]]
            at = end
        return out + list(map(self.__getitem__, written[at:]))


def _runs(places: list[int]) -> Iterator[tuple[int, int]]:
    """(first, one past the last) of each run of numbers that follow on each other."""
    begin = 0
    for i in range(1, len(places) + 1):
        if i == len(places) or places[i] != places[i - 1] + 1:
            yield places[begin], places[i - 1] + 1
            begin = i


def features(words: list[str]) -> set[str]:
    """Different words, and the first four and five letters of longer ones (marked with a star)."""
    own = set(words)
    own.discard("")
    return own | {w[:4] + "*" for w in own if len(w) > 4} | {w[:5] + "*" for w in own if len(w) > 5}


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams: Counter = Counter()
    held: Counter = Counter()

    def spill():
        for w, n in held.items():
            w = w.strip(_EDGES)
            if w.isalpha():
                w = EDGE * 2 + w + EDGE
                for i in range(len(w) - 2):
                    grams[w[i : i + 3]] += n
        held.clear()

    for b in batches:
        for t in b.column("text").to_pylist():
            if t:
                held.update(t.lower().split())
        if len(held) > WORDS_HELD:
            spill()
    spill()
    yield pa.RecordBatch.from_arrays([pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())], names=["gram", "n"])


def trigrams(docs: DataFrame) -> dict[str, int]:
    """The letter trigrams of all words of docs: a table that the alphabets bound."""
    counted = C.mapped(C.plain(docs, "text"), _trigrams, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return _fetched(counted)


def _fetched(pairs: DataFrame) -> dict:
    """Two columns as a dictionary; as Arrow, since rows take several times the memory."""
    t = pairs.toArrow()
    return dict(zip(t.column(0).to_pylist(), t.column(1).to_pylist()))


def _feature_counts(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    words, counts = Words(model.value), Counter()

    def out():
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["feature", "n"])

    for b in batches:
        for t in b.column("text").to_pylist():
            counts.update(features(words.of(t or "")))
        if len(counts) > 500_000:
            yield from out()
            counts.clear()
    yield from out()


_RAW = pa.schema([("doc_id", pa.int64()), ("top", pa.float64()), ("second", pa.float64()), ("total", pa.float64()), ("size", pa.float64())])
_RAW_DDL = "doc_id long, top double, second double, total double, size double"


_PART = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("top", pa.float64()), ("second", pa.float64()), ("total", pa.float64())])
_PART_DDL = "doc_id long, text string, top double, second double, total double"


def _weigh(batches: Iterator[pa.RecordBatch], model, weights, last: bool) -> Iterator[pa.RecordBatch]:
    """Adds the hits of one shard of the weights to top, second and total; the last shard's rows are _RAW, others _PART."""
    words, w = Words(model.value), weights.value
    schema = _RAW if last else _PART
    for b in batches:
        rows = []
        for doc, t, top, second, total in zip(*(b.column(c).to_pylist() for c in _PART.names)):
            own = features(words.of(t or ""))
            hits = sorted([w[f] for f in own if f in w] + [top, second], reverse=True)
            total += sum(hits) - top - second
            rows.append((doc, hits[0], hits[1], math.log1p(total), math.log1p(len(own))) if last else (doc, t, hits[0], hits[1], total))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


def _lexicon(toxic: DataFrame, clean: DataFrame, letters, bad: int, good: int) -> DataFrame:
    """(feature, sure): the log ratio of rates, less two standard errors, of every feature where that is over 0.3."""
    counted = lambda df, n: C.mapped(df, partial(_feature_counts, model=letters), "feature string, n long").groupBy("feature").agg(F.sum("n").alias(n))
    both = counted(toxic, "n").where("n >= 3").join(counted(clean, "m").hint("merge"), "feature", "left")
    n, m = F.col("n") + 0.5, F.coalesce("m", F.lit(0)) + 0.5
    sure = F.log((n / bad) / (m / good)) - 2 * F.sqrt(1 / n + 1 / m)
    return both.select("feature", sure.alias("sure")).where("sure > 0.3")


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights, the constant last, by Newton's method with a ridge on all but the constant. No rows: zeros."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) and labels (doc_id, toxic) -> doc_id, held_out, score, predicted; one row for each row.

    Labels are learnt only from ids whose crc32, as text, mod 5 is not 0; held_out marks the others. score is between
    0 and 1; empty and null texts are scored as texts without hits. Labels that are null or name no document are
    passed over; a document with labels of both kinds counts as both. Without labels every score is 0.5. Null ids are not
    held out. Repeated rows are scored one by one, texts of any length whole; an empty table gives no rows; extra columns are
    ignored, whatever their names.
    """
    spark = docs.sparkSession
    C.prepare(spark)
    src = C.plain(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    known = C.plain(labels, "doc_id", "toxic").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").where(remainder != 0)
    known = C.table(known.distinct(), "known")
    marked = C.broadcast_if_small(known)
    train = src.join(marked, "doc_id")
    toxic, clean = train.where("toxic = 1").select("text"), train.where("toxic = 0").select("text")
    sizes = {r[0]: r[1] for r in known.join(src.select("doc_id"), "doc_id").groupBy("toxic").count().collect()}
    letters = spark.sparkContext.broadcast(CharModel([trigrams(src), trigrams(toxic)]))
    lexicon = C.table(_lexicon(toxic, clean, letters, sizes.get(1, 0) + 1, sizes.get(0, 0) + 1), "lexicon")
    shards = max(1, -(-lexicon.count() // SHARD_FEATURES))
    raw = src.select("doc_id", "text", *(F.lit(0.0).alias(c) for c in ("top", "second", "total")))
    for k in range(shards):
        weights = spark.sparkContext.broadcast(_fetched(lexicon.where(F.pmod(F.xxhash64("feature"), F.lit(shards)) == k)))
        last = k + 1 == shards
        before, raw = raw, C.table(C.mapped(raw, partial(_weigh, model=letters, weights=weights, last=last), _RAW_DDL if last else _PART_DDL), "raw")
        weights.destroy()
        C.drop(before)
    letters.destroy()
    columns = ["top", "second", "total", "size"]
    sample = raw.join(marked, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").select(*columns, "toxic").limit(FIT_ROWS).collect()
    C.drop(known, lexicon)
    w = fit_logistic(np.array([r[:4] for r in sample], float).reshape(len(sample), 4), np.array([r[4] for r in sample], float))
    odds = F.lit(float(w[4]))
    for c, k in zip(columns, w):
        odds = odds + F.col(c) * float(k)
    score = 1 / (1 + F.exp(-odds))
    out = raw.select("doc_id", F.coalesce(remainder == 0, F.lit(False)).alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
