"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit distance.

The CGK random walk (Chakraborty, Goldenberg, Koucky, STOC 2016) turns edit distance between runs of words into
Hamming distance: at step j it emits the word under its pointer and moves on when a random bit of (j, word) says so.
An LSH repetition samples a few steps of one walk; equal samples make a candidate, and Myers' bit-parallel algorithm
gives the exact word edit distance of the whole item inside the document.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Window sizes in words; an item takes at most the largest that is at most 2/3 of it, so that a window at every half
#: window of a document always falls inside a leaked item (see plan).
SIZES = (1, 2, 4, 8, 16, 32)
#: Items and words in one broadcast index (some hundred bytes a word). More are taken in blocks of so many, one pass over
#: the documents each; an item with more words is a block of its own.
BLOCK_ITEMS, BLOCK_WORDS = 20_000, 500_000
#: Windows of one key, or an item's offsets of one, so many words apart at most are one run.
RUN = 64
#: A window size at which a length of items needs more is not taken for it.
MAX_REPETITIONS = 20
#: Edited copies on which a length of items is measured.
TRIALS = 300
WORDS_AT_ONCE = 200_000

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits."""
    return _WORD.findall(text.lower()) if text else []


def window_size(n: int) -> int:
    return max(s for s in SIZES if s <= max(1, (2 * n + 2) // 3))


def sampled_steps(size: int, rep: int) -> list[int]:
    """The steps of a walk of 1.5 * size steps, which pass about 3/4 of the window, that repetition rep samples."""
    steps = max(1, 3 * size // 2)
    return sorted(random.Random(f"{size}/{rep}").sample(range(steps), min(steps, 5)))


def walk_bits(h: np.ndarray, rep: int) -> np.ndarray:
    """64 random bits for each word: bit j tells the walk of a repetition to move on at step j."""
    return C.mix64(h ^ np.uint64((rep + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)).view(np.int64)


def keys(h: np.ndarray, starts: np.ndarray, size: int, rep: int, bits: np.ndarray | None = None) -> np.ndarray:
    """The LSH key of the window of each start in one repetition. A walk may look past its window's end by some
    words; h must go on for size words after the last window (see padded)."""
    bits = walk_bits(h, rep) if bits is None else bits
    at, move = starts.astype(np.int64), np.empty(len(starts), np.int64)
    key = np.full(len(starts), (size << 32) + rep, np.uint64)
    wanted = sampled_steps(size, rep)
    for j in range(wanted[-1] + 1):
        if j in wanted:
            key *= np.uint64(0xFF51AFD7ED558CCD)
            key += h[at]
        np.take(bits, at, out=move, mode="wrap")
        move >>= j
        move &= 1
        at += move
    return C.mix64(key)


def padded(words, size: int = SIZES[-1]) -> np.ndarray:
    h = np.zeros(len(words) + 2 * size, np.uint64)
    h[: len(words)] = words
    return h


def best_match(item: list, region: list, limit: int) -> tuple[int, int] | None:
    """(edit distance, end) of the run of region nearest to item, if within limit; the first end among ties."""
    n = len(item)
    masks: dict = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score, best = full, 0, n, None
    for end, w in enumerate(region, 1):
        eq = masks.get(w, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph, mh = (minus | ~(xh | plus)) & full, plus & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1 & full, mh << 1 & full
        plus, minus = (mh | ~(xv | ph)) & full, ph & xv
        if score <= limit and (best is None or score < best[0]):
            best = (score, end)
    return best


def _edited(item: list[int], edit_share: float, rnd: random.Random) -> list[int]:
    copy = list(item)
    for _ in range(int(edit_share * len(item))):
        i = rnd.randrange(len(copy))
        kind = rnd.randrange(3)
        if kind == 0:
            copy[i] = rnd.getrandbits(63)
        elif kind == 1 and len(copy) > 1:
            del copy[i]
        else:
            copy.insert(i, rnd.getrandbits(63))
    return copy


def repetitions(items: list[list[int]], size: int, edit_share: float, recall: float, trials: int = TRIALS) -> int | None:
    """Repetitions at this window size after which an edited copy of one of items is a candidate with probability
    recall; None where MAX_REPETITIONS do not reach it.

    Measured on edited copies of the items themselves, which keeps their own word frequencies. The copies stand among
    other words; a copy without a full window is a miss.
    """
    rnd, step = random.Random(7), max(1, size // 2)
    a, b, own, theirs, at_a, at_b = [], [], [], [], 0, 0
    for t in range(trials):
        item = items[t % len(items)]
        copy = _edited(item, edit_share, rnd)
        starts = np.arange(rnd.randrange(step), len(copy) - size + 1, step)
        own.append(np.column_stack([np.full(max(0, len(item) - size + 1), t), at_a + np.arange(max(0, len(item) - size + 1))]))
        theirs.append(np.column_stack([np.full(len(starts), t), at_b + starts]))
        a += item + [0] * (2 * size)
        b += copy + [rnd.getrandbits(63) for _ in range(2 * size)]
        at_a, at_b = len(a), len(b)
    h_a, h_b = np.array(a, np.uint64), np.array(b, np.uint64)
    mine, there = np.concatenate(own), np.concatenate(theirs)
    left, enough = np.ones(trials, bool), min(1.0, recall + (recall * (1 - recall) / trials) ** 0.5)  # a standard error more
    for rep in range(MAX_REPETITIONS):
        mine, there = mine[left[mine[:, 0]]], there[left[there[:, 0]]]
        mark = C.mix64(np.arange(1, trials + 1, dtype=np.uint64))  # copies meet their own items only
        hit = np.isin(keys(h_b, there[:, 1], size, rep) ^ mark[there[:, 0]], keys(h_a, mine[:, 1], size, rep) ^ mark[mine[:, 0]])
        left[there[hit, 0]] = False
        if 1 - left.mean() >= enough:
            return rep + 1
    return None


def _length(n: int) -> int:
    """Items are measured by length; those of many windows together, on the shortest of them."""
    return min(n, 4 * SIZES[-1])


def plan(items: list[list[int]], edit_share: float, recall: float) -> tuple[dict[int, int], dict[int, int]]:
    """(length -> window size, window size -> repetitions) that reach recall at every length of items.

    A length takes window_size() or the next smaller one, whichever makes fewer passes over the documents in all, and
    still smaller ones where neither reaches recall. A length that none brings there is left out: its items are looked for without windows.
    """
    pools: dict[int, list[list[int]]] = {}
    for x in sorted(items, key=len):
        pools.setdefault(_length(len(x)), []).append(x)
    need: dict[int, dict[int, int]] = {}
    for n, pool in pools.items():
        need[n] = {}
        for tried, size in enumerate(s for s in reversed(SIZES) if s <= window_size(n)):
            if tried > 1 and need[n]:
                break
            found = repetitions(pool[:TRIALS], size, edit_share, recall)
            if found:
                need[n][size] = found
        if not need[n]:
            del need[n]
    best: tuple[int, dict[int, int], dict[int, int]] | None = None
    for most in range(1, MAX_REPETITIONS + 1):
        sizes = {n: max((s for s, r in by.items() if r <= most), default=0) for n, by in need.items()}
        if 0 in sizes.values():
            continue
        reps: dict[int, int] = {}
        for n, s in sizes.items():
            reps[s] = max(reps.get(s, 0), need[n][s])
        if best is None or sum(reps.values()) < best[0]:
            best = (sum(reps.values()), sizes, reps)
    return (best[1], best[2]) if best else ({}, {})


class Index:
    """Keys of every window of every item, by window size and repetition; and the items' words."""

    def __init__(self, items: list[tuple[int, str]], edit_share: float, recall: float):
        hashes = C.WordHashes()
        self.items = [(i, [hashes[w] for w in words_of(t)]) for i, t in items]
        self.items = [x for x in self.items if x[1]]
        self.word_sets = [frozenset(w) for _, w in self.items]
        self.edit_share = edit_share
        sizes, self.reps = plan([w for _, w in self.items], edit_share, recall)
        #: Window size, repetition; by key, then item, then place: runs of offsets of one item with one key.
        self.tables: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        by_size: dict[int, list[int]] = {}
        self.without: list[int] = []  # items that no window finds often enough: every document is asked for their words
        for k, (_, w) in enumerate(self.items):
            size = sizes.get(_length(len(w)))
            (by_size.setdefault(size, []) if size else self.without).append(k)
        for size, ks in by_size.items():
            for rep in range(self.reps[size]):
                made = [(keys(padded(self.items[k][1]), np.arange(len(self.items[k][1]) - size + 1), size, rep), k) for k in ks]
                key = np.concatenate([x for x, _ in made])
                item = np.concatenate([np.full(len(x), k) for x, k in made])
                offset = np.concatenate([np.arange(len(x)) for x, _ in made])
                order = np.argsort(key, kind="stable")
                key, item, offset = key[order], item[order], offset[order]
                new = np.append(True, (key[1:] != key[:-1]) | (item[1:] != item[:-1]) | (offset[1:] - offset[:-1] > RUN))
                first, last = np.flatnonzero(new), np.flatnonzero(np.append(new[1:], True))
                key, item, low, high = key[first], item[first], offset[first], offset[last]
                seen = np.zeros(1 << max(12, min(22, (16 * len(key)).bit_length())), bool)
                seen[(key & np.uint64(len(seen) - 1)).astype(np.int64)] = True
                self.tables.append((size, rep, key, item, low, high, seen))

    @property
    def by_rep(self):
        return [(rep, [t for t in self.tables if t[1] == rep]) for rep in range(max(self.reps.values(), default=0))]

    def candidates(self, h: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> dict[tuple[int, int], list[tuple[int, int]]]:
        """(document, item) -> where the item would start, first and last place of each run, for documents h[begin:end].

        A document's windows of one key that lie close together are one run, like an item's offsets: a text that says the same words
        over and over meets an item that does so once, not window by offset.
        """
        found: list[np.ndarray] = []
        places = {}
        for size in {t[0] for t in self.tables}:
            step = max(1, size // 2)
            counts = np.maximum(0, (ends - begins - size) // step + 1)
            doc = np.repeat(np.arange(len(begins)), counts)
            nth = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
            places[size] = doc, begins[doc] + nth * step
        for rep, tables in self.by_rep:
            bits = walk_bits(h, rep)
            for size, _, key, item, low, high, seen in tables:
                doc, starts = places[size]
                mine = keys(h, starts, size, rep, bits)
                at = np.flatnonzero(seen[(mine & np.uint64(len(seen) - 1)).view(np.int64)])
                at = at[np.isin(mine[at], key)]
                if not len(at):
                    continue
                at = at[np.lexsort([starts[at], mine[at], doc[at]])]
                d, k, s = doc[at], mine[at], starts[at] - begins[doc[at]]
                new = np.append(True, (d[1:] != d[:-1]) | (k[1:] != k[:-1]) | (s[1:] - s[:-1] > RUN))
                first, last = np.flatnonzero(new), np.flatnonzero(np.append(new[1:], True))
                lo, hi = np.searchsorted(key, k[first], "left"), np.searchsorted(key, k[first], "right")
                run = np.repeat(np.arange(len(first)), hi - lo)
                x = np.arange(len(run)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[run]
                found.append(np.unique(np.stack([d[first][run], item[x], s[first][run] - high[x], s[last][run] - low[x]]), axis=1))
        if not found:
            return {}
        doc, item, low, high = np.unique(np.concatenate(found, axis=1), axis=1)
        out: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for d, k, a, b in zip(*(v.tolist() for v in (doc, item, low, high))):
            runs = out.setdefault((d, k), [])
            if runs and a <= runs[-1][1] + RUN // 4:
                runs[-1] = (runs[-1][0], max(b, runs[-1][1]))
            else:
                runs.append((a, b))
        return out

    def leaks(self, docs: list[np.ndarray]) -> Iterator[tuple[int, int, int, int, int]]:
        """(document, item id, end word, item words, edit distance): the best place of each item in each document."""
        sizes = np.array([len(d) for d in docs])
        ends = np.cumsum(sizes)
        asked = self.candidates(padded(np.concatenate(docs)), ends - sizes, ends) if self.tables else {}
        for d, words in enumerate(docs):
            own = set(words.tolist()) if self.without else set()
            for k in self.without:
                if len(self.word_sets[k] & own) >= len(self.word_sets[k]) - int(self.edit_share * len(self.items[k][1])):
                    asked[d, k] = [(0, len(words))]
        for (d, k), runs in sorted(asked.items()):
            words, best = self.items[k][1], None
            limit = int(self.edit_share * len(words))
            for first, last in runs:
                lo = max(0, first - limit - 2)
                region = docs[d][lo : max(0, last + len(words) + limit + 8)].tolist()
                if sum(map(self.word_sets[k].__contains__, region)) < len(words) - limit:
                    continue  # an item within the limit keeps that many of its words
                m = best_match(words, region, limit)
                if m and (best is None or m[0] < best[0]):
                    best = (m[0], lo + m[1])
            if best:
                yield d, self.items[k][0], best[1], len(words), best[0]


_LEAKS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("end_word", pa.int64()), ("item_words", pa.int64()), ("distance", pa.int64())])


def _search(batches: Iterator[pa.RecordBatch], index) -> Iterator[pa.RecordBatch]:
    ix: Index = index.value
    hashes = C.WordHashes()

    def emit(ids, docs):
        rows = [(ids[d], *rest) for d, *rest in ix.leaks(docs)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=_LEAKS)

    for b in batches:
        ids, docs, n = [], [], 0
        for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
            ids.append(i), docs.append(hashes.array(words_of(t)))
            n += len(docs[-1])
            if n >= WORDS_AT_ONCE:
                yield from emit(ids, docs)
                ids, docs, n = [], [], 0
        if docs:
            yield from emit(ids, docs)


def _blocks(benchmark: DataFrame, items: int, words: int) -> Iterator[list[tuple[int, str]]]:
    block: list[tuple[int, str]] = []
    held = 0
    for r in C.plain(benchmark, "item_id", "text").where("text is not null").orderBy("item_id").toLocalIterator():
        n = len(words_of(r[1]))
        if block and (len(block) == items or held + n > words):
            yield block
            block, held = [], 0
        block.append((r[0], r[1]))
        held += n
    if block:
        yield block


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame, edit_share: float = 0.15, recall: float = 0.95, block_items: int = BLOCK_ITEMS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Where benchmark items (item_id, text) occur in docs (doc_id, text), up to edit_share of their words edited.

    One row for each document and item found: doc_id, item_id, start_word (the match's last word less the item's
    length), end_word, item_words, distance (words). Words are lower-cased letters and digits. Null and empty texts and items
    match nothing; items of the same text each match; rows repeating a doc_id give their own rows; extra columns are
    ignored, whatever their names. A text of any length is searched whole, in memory of its own length. The benchmark is
    the stated query set: it is read in blocks of block_items and block_words, each a broadcast index of bounded size and
    one pass over the documents. Items of lengths at which no window reaches recall are looked for in every text that holds enough of their words.
    """
    spark: SparkSession = docs.sparkSession
    C.prepare(spark)
    src = C.plain(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    out = C.empty_like(spark, "doc_id long, item_id long, end_word long, item_words long, distance long")
    made = []
    for block in _blocks(benchmark, block_items, block_words):
        index = spark.sparkContext.broadcast(Index(block, edit_share, recall))
        made.append(C.table(C.mapped(src, partial(_search, index=index), out.schema), "leaks"))
        index.destroy()
    if made:
        out = spark.read.schema(out.schema).parquet(*[t.table_path for t in made])
    return out.select("doc_id", "item_id", F.greatest(F.lit(0), F.col("end_word") - F.col("item_words")).alias("start_word"), "end_word", "item_words", "distance")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, edit_share: float = 0.15) -> DataFrame:
    """docs without those that hold a benchmark item; columns and kept rows unchanged.

    Null doc_ids stay; rows that share a doc_id go when one of them holds an item; null and empty texts hold none; an
    empty table or benchmark takes nothing away; further columns may have any names.
    """
    gone = C.table(benchmark_leaks(docs, benchmark, edit_share).select("doc_id").distinct(), "gone")
    return C.without_ids(docs, gone)
