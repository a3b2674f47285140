"""Phrase collocation mining with double-array tries over words.

Texts are cut into pieces and words once and stored as chunks of word numbers. Candidates grow by a word at a time and are safe after
Apriori: a phrase of k words comes into question only where its first and its last k - 1 words are candidates, which the positions'
states in the trie of the level before tell; what the tasks saw of it, summed, must reach the least count. In the end a trie of all
candidates is broadcast, numpy advances the states of all positions of a chunk together, level by level, counts the states reached, and the
tasks' counts are summed. Tries are double arrays, cut into shards of bounded size by first word; each shard is one pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

LONGEST, LEAST_COUNT, TOP = 5, 100, 2000
#: Words of a chunk of the stored texts.
CHUNK_WORDS = 1 << 18
#: Bytes of a text looked at together.
SLICE = 1 << 20
#: Phrases in one trie.
TRIE_PHRASES = 1_000_000
#: Distinct extensions that a task holds before it hands on what it has.
HELD = 2_000_000

#: Piece breaks `[.,;:!?\x0A-\x0D]` become full stops and tabs become spaces; a full stop by itself is then no word but a break.
_BREAKS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b"..........\x20")
_BREAK = b"."


class _Numbers(dict):
    """Word -> number, in order of first sight; 0 is the break."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def tokens(text: bytes) -> Iterator[list[bytes]]:
    """Words and breaks of a text, A-Z lower-cased, some SLICE bytes at a time."""
    at = 0
    while at < len(text):
        end = at + SLICE
        part = text[at:end].lower().translate(_BREAKS)
        while end < len(text) and part[-1] not in b" .":  # up to the end of the word
            more = text[end : end + 4096].lower().translate(_BREAKS)
            stops = [i for i in (more.find(b" "), more.find(b".")) if i >= 0]
            more = more[: min(stops) + 1] if stops else more
            part, end = part + more, end + len(more)
        yield part.replace(b".", b" . ").split()
        at = end


_CHUNK_DDL = "chunk long, lang string, starts int, ids binary, words array<string>, counts array<int>"
_CHUNK = pa.schema([("chunk", pa.int64()), ("lang", pa.string()), ("starts", pa.int32()), ("ids", pa.binary()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int32()))])


def _chunk(number: int, lang: str, held: list[bytes], starts: int) -> pa.RecordBatch:
    """held: words and breaks; phrases start at the first `starts` of them, the others only follow."""
    own = _Numbers({_BREAK: 0})
    ids = np.fromiter(map(own.__getitem__, held), np.int32, len(held))
    counts = np.bincount(ids[:starts], minlength=len(own)).astype(np.int32)
    words = pa.array(list(own), pa.binary()).cast(pa.string())
    one = np.array([0, len(own)], np.int32)
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([lang], pa.string()), pa.array([starts], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.ListArray.from_arrays(one, words), pa.ListArray.from_arrays(one, pa.array(counts))], schema=_CHUNK)


def _encode(batches: Iterator[pa.RecordBatch], ahead: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    held: dict[str, list[bytes]] = {}
    number, total = TaskContext.get().partitionId() << 32, 0
    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").cast(pa.binary())):
            own = held.setdefault(lang, [])
            for part in tokens(text.as_py() or b""):
                own += part
                total += len(part)
                while len(own) >= CHUNK_WORDS + ahead:
                    yield _chunk(number, lang, own[: CHUNK_WORDS + ahead], CHUNK_WORDS)
                    del own[:CHUNK_WORDS]
                    number, total = number + 1, total - CHUNK_WORDS
            own.append(_BREAK)
            total += 1
        while total > 2 * CHUNK_WORDS:  # many languages, each with little
            lang = max(held, key=lambda k: len(held[k]))
            own = held.pop(lang)
            yield _chunk(number, lang, own, len(own))
            number, total = number + 1, total - len(own)
    for lang, own in held.items():
        if own:
            yield _chunk(number, lang, own, len(own))
            number += 1


_CODED_DDL = "starts int, words binary"
_CODED = pa.schema([("starts", pa.int32()), ("words", pa.binary())])


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks with the numbers of their frequent words -> those numbers word by word, -1 for the others and for breaks; runs of -1 become one."""
    for b in batches:
        for starts, ids, mine in zip(*(b.column(c).to_pylist() for c in ("starts", "ids", "frequent"))):
            ids = np.frombuffer(ids, np.int32)
            number = np.full(ids.max(initial=0) + 1, -1, np.int32)
            for x in mine or ():
                number[x["pos"]] = x["id"]
            out = number[ids]
            stay = out >= 0
            stay[1:] |= out[:-1] >= 0
            yield pa.RecordBatch.from_arrays([pa.array([int(stay[:starts].sum())], pa.int32()), pa.array([out[stay].tobytes()], pa.binary())], schema=_CODED)


class Trie:
    """A double array: from state s symbol c leads to base[s] + c, if check there is s. States of one word are the symbols themselves.

    Symbols are 0 .. size - 1, size stands for any other. value[s] is the number of the phrase that ends in s, or -1.
    """

    def __init__(self, size: int, phrases: list[tuple[np.ndarray, np.ndarray]]):
        """phrases: (symbols, one row a phrase; numbers of the phrases), one pair for each length."""
        self.size, self.top = size, size + 1
        room = 2 * (size + 1) + 2 * sum(len(n) * (m.shape[1] if len(n) else 0) for m, n in phrases) + 1024
        self.base, self.check = np.zeros(room, np.int32), np.full(room, -1, np.int32)
        self.free = np.ones(room, bool)
        self.free[: self.top] = False
        self.low = self.top
        self.value = np.full(room, -1, np.int64)
        at = [m[:, 0].astype(np.int64) for m, _ in phrases]  # each phrase's state so far
        for (m, n), states in zip(phrases, at):
            if m.shape[1] == 1:
                self.value[states] = n
        depth = 1
        while any(m.shape[1] > depth for m, _ in phrases):
            deeper = [i for i, (m, _) in enumerate(phrases) if m.shape[1] > depth]
            keys = [at[i] << 32 | phrases[i][0][:, depth].astype(np.int64) for i in deeper]
            edges = np.unique(np.concatenate(keys))
            self._grow(edges >> 32, edges & 0xFFFFFFFF)
            for i, key in zip(deeper, keys):
                at[i] = self.base[at[i]] + (key & 0xFFFFFFFF)
                if phrases[i][0].shape[1] == depth + 1:
                    self.value[at[i]] = phrases[i][1]
            depth += 1
        end = 1 + int(max(np.nonzero(~self.free)[0].max(initial=0), self.base.max(initial=0) + size))
        self._more(end)
        self.base, self.check, self.value = self.base[:end].copy(), self.check[:end].copy(), self.value[:end].copy()
        del self.free

    def _more(self, need: int) -> None:
        if need > len(self.base):
            n = 2 * need - len(self.base)
            self.base, self.check, self.value, self.free = np.append(self.base, np.zeros(n, np.int32)), np.append(self.check, np.full(n, -1, np.int32)), np.append(self.value, np.full(n, -1, np.int64)), np.append(self.free, np.ones(n, bool))

    def _grow(self, parents: np.ndarray, symbols: np.ndarray) -> None:
        """Children of the given states, sorted by state: those of several children first, most children first, then the others into any gap."""
        starts = np.nonzero(np.append(True, parents[1:] != parents[:-1]))[0]
        sizes = np.diff(np.append(starts, len(parents)))
        several = np.nonzero(sizes > 1)[0]
        for i in several[np.argsort(-sizes[several], kind="stable")]:
            self._place(int(parents[starts[i]]), symbols[starts[i] : starts[i] + sizes[i]])
        one = starts[sizes == 1]
        self._more(self.top + len(one) + int(self.free.size - self.free.sum()))
        slots = np.nonzero(self.free)[0][: len(one)]
        self.base[parents[one]], self.check[slots], self.free[slots] = slots - symbols[one], parents[one], False

    def _place(self, parent: int, symbols: np.ndarray) -> None:
        at, tries = self.low, 0
        while True:
            self._more(at + 1024 + self.size)
            first = at + np.nonzero(self.free[at : at + 1024])[0]  # slots of the first child
            fits = first[self.free[(first - symbols[0])[:, None] + symbols[None, :64]].all(1)] if len(first) else first
            for slot in fits:
                base = int(slot) - int(symbols[0])
                if len(symbols) <= 64 or self.free[base + symbols].all():
                    own = base + symbols
                    self.base[parent], self.check[own], self.free[own] = base, parent, False
                    if tries > 8:  # what lies below is too dense to look at again
                        self.low = min(self.low + 1024 * (tries // 2), len(self.free) - 1)
                    return
            at, tries = at + 1024, tries + 1

    def walk(self, words: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions, states) of those positions whose next 1, 2, ... words are a path, up to depth."""
        where = np.nonzero(words < self.size)[0]
        state = words[where]
        yield where, state
        for d in range(1, depth):
            there = where + d < len(words)
            where, state = where[there], state[there]
            after = self.base[state] + words[where + d]
            stay = self.check[after] == state
            where, state = where[stay], after[stay]
            yield where, state


class Shard:
    """A trie over some first words, with its symbols: numbers of words, sorted."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]], whole: bool):
        self.alphabet = np.unique(np.concatenate([m.ravel() for m, _ in levels])) if levels else np.empty(0, np.int32)
        self.whole, self.depth = whole, max((m.shape[1] for m, _ in levels), default=0)
        self.trie = Trie(len(self.alphabet), [(np.searchsorted(self.alphabet, m), n) for m, n in levels])

    def symbols(self, words: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.alphabet, words)
        at[at == len(self.alphabet)] = 0
        return np.where(self.alphabet[at] == words, at, len(self.alphabet)) if len(self.alphabet) else np.zeros(len(words), np.int64)


class _Sums:
    """Keys and their summed counts, merged when many are held."""

    def __init__(self):
        self.keys, self.counts, self.n = [], [], 0

    def add(self, keys: np.ndarray) -> None:
        k, n = np.unique(keys, return_counts=True)
        self.keys.append(k), self.counts.append(n)
        self.n += len(k)
        if self.n > HELD:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        starts = np.nonzero(np.append(True, keys[1:] != keys[:-1]))[0] if len(keys) else np.empty(0, np.int64)
        keys, counts = keys[starts], np.add.reduceat(counts, starts) if len(keys) else counts
        self.keys, self.counts, self.n = [keys], [counts], len(keys)
        return keys, counts

    def full(self) -> bool:
        return self.n > HELD // 2


_SEEN_DDL = "head long, word int, n long"
_SEEN = pa.schema([("head", pa.int64()), ("word", pa.int32()), ("n", pa.int64())])


def _extensions(batches: Iterator[pa.RecordBatch], shard, k: int) -> Iterator[pa.RecordBatch]:
    """Phrases of k words whose first k - 1 and last k - 1 words are candidates, as (number of the first, last word), with counts.

    shard: of candidates of k - 1 words; None for k = 2, where words are their own numbers. The last k - 1 words may be in another
    shard; they are asked for only where there is one.
    """
    of, sums = shard.value if shard else None, _Sums()

    def out() -> Iterator[pa.RecordBatch]:
        keys, counts = sums.merge()
        head = keys >> 32
        head = of.trie.value[head] if of else head
        for i in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(head[i : i + 100_000]), pa.array((keys[i : i + 100_000] & 0xFFFFFFFF).astype(np.int32)), pa.array(counts[i : i + 100_000], pa.int64())], schema=_SEEN)

    for b in batches:
        for starts, words in zip(b.column("starts").to_pylist(), b.column("words").to_pylist()):
            words = np.frombuffer(words, np.int32)
            if of is None:
                state, live = words.astype(np.int64), words >= 0
            else:
                state = np.full(len(words), -1, np.int64)
                for d, (where, s) in enumerate(of.trie.walk(of.symbols(words), k - 1), 1):
                    if d == k - 1:
                        state[where] = s
                live = state >= 0
            n = max(0, min(starts, len(words) - k + 1))
            if not n:
                continue
            fit = live[:n] & (words[k - 1 : k - 1 + n] >= 0)
            if of is None or of.whole:
                fit &= live[1 : n + 1]
            at = np.nonzero(fit)[0]
            sums.add(state[at] << 32 | words[at + k - 1])
            if sums.full():
                yield from out()
                sums = _Sums()
    yield from out()


#: States whose counts lie in one row on their way to the sum.
STATES = 1 << 13
_REACHED_DDL = "part int, counts binary"
_REACHED = pa.schema([("part", pa.int32()), ("counts", pa.binary())])


def _reached(batches: Iterator[pa.RecordBatch], shard) -> Iterator[pa.RecordBatch]:
    """How often each state of the trie is reached in the task's chunks, STATES to a row."""
    of = shard.value
    reached = np.zeros(len(of.trie.base), np.int64)
    for b in batches:
        for starts, words in zip(b.column("starts").to_pylist(), b.column("words").to_pylist()):
            for where, state in of.trie.walk(of.symbols(np.frombuffer(words, np.int32)), of.depth):
                reached += np.bincount(state[where < starts], minlength=len(reached))
    for part in range(-(-len(reached) // STATES)):
        own = reached[part * STATES : (part + 1) * STATES]
        if own.any():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([own.tobytes()], pa.binary())], schema=_REACHED)


_COUNT_DDL = "id long, n long"
_COUNT = pa.schema([("id", pa.int64()), ("n", pa.int64())])


def _summed(batches: Iterator[pa.RecordBatch], shard) -> Iterator[pa.RecordBatch]:
    """The rows of a part summed one by one as they come; then a row for each phrase."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for part, counts in zip(b.column("part").to_pylist(), b.column("counts").to_pylist()):
            own = np.frombuffer(counts, np.int64)
            sums[part] = sums[part] + own if part in sums else own
    value = shard.value.trie.value
    for part, own in sums.items():
        phrase = value[part * STATES : part * STATES + len(own)]
        hit = np.nonzero((own > 0) & (phrase >= 0))[0]
        yield pa.RecordBatch.from_arrays([pa.array(phrase[hit]), pa.array(own[hit])], schema=_COUNT)


def _counted(coded: DataFrame, shard) -> DataFrame:
    """(id, n): how often each phrase of the shard stands in the chunks. Tasks' counts are dealt out by part of the trie and summed there."""
    parts = max(1, -(-len(shard.value.trie.base) // STATES))
    reached = C.mapped(coded, partial(_reached, shard=shard), _REACHED_DDL).repartition(min(parts, int(coded.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "part")
    return C.table(C.mapped(reached, partial(_summed, shard=shard), _COUNT_DDL), "counts")


def _numbered(df: DataFrame, key: list[str]) -> DataFrame:
    """df with id: numbers from 0 without gaps, in order of hashes."""
    spread = df.withColumn("__h", F.xxhash64(*key)).withColumn("__b", F.shiftright("__h", 48).cast("long")).withColumn("__1", F.lit(1).cast("long"))
    return C.running_total(spread, [], "__b", ["__h", *key], "__1", "id").drop("__h", "__b", "__1")


def _shards(spark: SparkSession, levels: list[DataFrame]) -> Iterator[tuple]:
    """Broadcast tries over the phrases of levels (id, numbers), one at a time; each is destroyed when the next is asked for."""
    parts = 1 + sum(t.count() for t in levels) // TRIE_PHRASES
    for i in range(parts):
        own = []
        for t in levels:
            rows = t.where(F.pmod(F.xxhash64(F.element_at("numbers", 1)), F.lit(parts)) == i).select("id", "numbers").toArrow().combine_chunks()
            if rows.num_rows:
                flat = np.concatenate([np.asarray(c.flatten()) for c in rows.column("numbers").chunks]).astype(np.int32)
                own.append((flat.reshape(rows.num_rows, -1), np.asarray(rows.column("id"))))
        if own:
            sent = spark.sparkContext.broadcast(Shard(own, parts == 1))
            yield sent
            sent.destroy()


def _longer(spark: SparkSession, coded: DataFrame, below: DataFrame, words: DataFrame, k: int, least: int) -> DataFrame:
    """Candidates of k words from those of k - 1."""
    seen = [C.table(C.mapped(coded, partial(_extensions, shard=s, k=k), _SEEN_DDL).groupBy("head", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "seen") for s in ([None] if k == 2 else _shards(spark, [below]))]
    if not seen:
        return below.limit(0)
    rows = spark.read.schema(seen[0].schema).parquet(*[t.table_path for t in seen])
    last = words.select(F.col("id").alias("word"), F.col("phrase").alias("more"))
    rows = rows.select("head", F.col("word").cast("long").alias("word")).join(below.withColumnRenamed("id", "head"), "head").join(last, "word")
    rows = rows.select("lang", F.concat_ws(" ", "phrase", "more").alias("phrase"), F.concat("numbers", F.array("word")).alias("numbers"))
    out = C.table(_numbered(rows, ["lang", "phrase"]).select("id", "lang", "phrase", "numbers"), f"phrases{k}")
    C.drop(*seen)
    return out


def phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST_COUNT) -> tuple[DataFrame, DataFrame]:
    """docs (lang, text, ...) -> every phrase of 1 to `longest` words that stands `least` times in its language (lang, phrase, words, f);
    and all words of each language (lang, n). Stored tables."""
    spark = docs.sparkSession
    C.prepare(spark)
    own = C.plain(docs, "lang", "text").select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    chunks = C.table(C.mapped(own, partial(_encode, ahead=longest - 1), _CHUNK_DDL), "chunks")
    seen = chunks.select("chunk", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("pos", "x")).where("pos > 0").select("chunk", "lang", "pos", F.col("x.words").alias("phrase"), F.col("x.counts").alias("n"))
    counted = seen.groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
    totals = C.table(seen.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    words = C.table(_numbered(counted.where(F.col("f") >= least), ["lang", "phrase"]).withColumn("numbers", F.array("id")).select("id", "lang", "phrase", "numbers", "f"), "words")
    frequent = seen.join(words.select("lang", "phrase", "id"), ["lang", "phrase"]).groupBy("chunk").agg(F.collect_list(F.struct(F.col("pos"), F.col("id"))).alias("frequent"))
    coded = C.table(C.mapped(chunks.select("chunk", "starts", "ids").join(frequent, "chunk", "left").select("starts", "ids", "frequent"), _coded, _CODED_DDL), "coded")
    C.drop(chunks)
    levels = [words]
    for k in range(2, longest + 1):
        levels.append(_longer(spark, coded, levels[-1], words, k, least))
    # one numbering over all lengths
    several = [t.select((F.col("id") * longest + k).alias("id"), "lang", "phrase", "numbers") for k, t in enumerate(levels[1:], 1)]
    counts = [_counted(coded, s) for s in _shards(spark, several)]
    found = words.select("lang", "phrase", F.lit(1).alias("words"), "f")
    if counts:
        f = spark.read.schema(counts[0].schema).parquet(*[t.table_path for t in counts])
        for k, t in enumerate(several, 2):
            found = found.unionByName(t.join(f, "id").select("lang", "phrase", F.lit(k).alias("words"), F.col("n").alias("f")))
    found = C.table(found, "phrases")
    C.drop(coded, *levels, *counts)
    return found, totals


def score() -> Column:
    """floor(1000 a n / (l r)) in decimals of 38 digits."""
    return F.expr("(1000 * CAST(a AS DECIMAL(18, 0))) * CAST(n AS DECIMAL(17, 0)) div (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST_COUNT, top: int = TOP) -> DataFrame:
    """docs (lang, text, ...) -> lang, rank, phrase, a, l, r, n, score: the best `top` phrases of each language.

    A-Z are lower-cased; pieces end at `[.,;:!?\\x0A-\\x0D]`, words are `[^\\x20\\x09]+`. A candidate is a phrase of 2 to `longest` words that stands a >= `least` times in its language within pieces, overlaps
    included. Cut after k words, its score is floor(1000 a n / (l r)), l and r being the counts of the parts and n that of all words; the lowest cut counts, of
    equal ones the first. Candidates that lie in a longer one standing as often are dropped. Order: score, a (both descending), phrase by bytes. Arithmetic is exact: decimals of 38 digits.

    A null lang is `und`; null and empty texts have no words; texts of any length, words and pieces too, are read in slices and lose nothing between
    them. Repeated rows count each; an empty table gives no rows; extra columns are ignored. A word of any frequency spreads over all tasks.
    """
    found, totals = phrases(docs, longest, least)
    multi = found.where("words > 1")
    parts = F.split("phrase", " ")
    cuts = multi.withColumn("p", parts).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", F.col("f").alias("a"), "k", F.array_join(F.slice("p", F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice("p", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("right"))
    part = found.select("lang", "phrase", "f")
    cuts = cuts.join(part.toDF("lang", "left", "l"), ["lang", "left"]).join(part.toDF("lang", "right", "r"), ["lang", "right"]).join(C.broadcast_if_small(totals), "lang")
    cuts = cuts.withColumn("score", score())
    best = cuts.groupBy("lang", "phrase").agg(F.min_by(F.struct("a", "l", "r", "n", "score"), F.struct("score", "k")).alias("x")).select("lang", "phrase", "x.*")
    # a longer phrase that stands as often: one that is a word longer does, too
    inside = multi.where("words > 2").withColumn("p", parts).select("lang", "f", F.explode(F.array(F.array_join(F.slice("p", F.lit(1), F.col("words") - 1), " "), F.array_join(F.slice("p", F.lit(2), F.col("words") - 1), " "))).alias("phrase"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    stay = best.join(inside, ["lang", "phrase"], "left").where("f IS NULL OR f < a")
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return stay.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
