"""Substring deduplication by sliding sentence spans: runs of several sentences that repeat anywhere go but once."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: A span is the shortest run of at least SENTENCES sentences with at least WORDS words. A sentence ends at . ! or ?
#: before white space, at a line break, and after LONGEST words, so that a passage of 50 words that starts with a
#: sentence always holds a whole span, however it is punctuated.
SENTENCES, WORDS, LONGEST = 3, 20, 16
#: By content, a sentence of so many words or more is cut before each word whose hash is the least among so many words
#: in a row, and not after LONGEST. Pieces have at most so many words, and copies of a passage fall in step within so
#: many wherever it begins or ends: any passage of 50 words holds a span (10 + 3 * 10 + 10).
LEAST_OF = 10

_WORDS = re.compile(r"\S+")
_END = re.compile(r"[.!?][\"')\]»”]*$")


def content_ends(h: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One past the last word of each piece of the sentences that end at ends; h: hashes of the lower-cased words."""
    n = len(h)
    cut = np.zeros(n + 1, bool)
    cut[ends] = True
    k = n - LEAST_OF + 1
    if k > 0:
        sentence = np.cumsum(cut)
        least, at = h[:k].copy(), np.arange(k)
        for j in range(1, LEAST_OF):
            less = h[j : j + k] < least
            np.copyto(least, h[j : j + k], where=less)
            at[less] = np.flatnonzero(less) + j
        cut[at[sentence[:k] == sentence[LEAST_OF - 1 : n]]] = True
        cut[0] = False
    return np.flatnonzero(cut)


def sentences(text: str, hashes: C.WordHashes | None = None) -> list[tuple[int, int, int, list[str]]]:
    """(begin, end, words, the words) of each sentence; white space between sentences belongs to none.

    hashes: cut long sentences by content, with these hashes of words.
    """
    if hashes is not None:
        places, ends, at = [], [], 0
        for line in text.split("\n"):
            for m in _WORDS.finditer(line):
                places.append((at + m.start(), at + m.end(), m.group()))
                if _END.search(m.group()):
                    ends.append(len(places))
            if places and (not ends or ends[-1] < len(places)):
                ends.append(len(places))
            at += len(line) + 1
        words = [w for _, _, w in places]
        ends = content_ends(hashes.array([w.lower() for w in words]), np.array(ends, np.int64)).tolist()
        return [(places[a][0], places[b - 1][1], b - a, words[a:b]) for a, b in zip([0, *ends], ends)]
    out = []
    at = 0
    for line in text.split("\n"):
        words: list[str] = []
        first = last = 0
        for m in _WORDS.finditer(line):
            w = m.group()
            if not words:
                first = at + m.start()
            words.append(w)
            last = at + m.end()
            if len(words) == LONGEST or _END.search(w):
                out.append((first, last, len(words), words))
                words = []
        if words:
            out.append((first, last, len(words), words))
        at += len(line) + 1
    return out


_CLOSERS = frozenset(".!?\"')]»”")


class _Ends(dict):
    """Word -> whether a sentence ends with it; emptied when it holds C.CACHE_WORDS words."""

    def __missing__(self, word: str) -> bool:
        if len(self) >= C.CACHE_WORDS:
            self.clear()
        self[word] = end = word[-1] in _CLOSERS and bool(_END.search(word))
        return end


_FACTOR = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def run_hashes(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each h[start:end], wherever it stands: differences of one running sum of h[k] * FACTOR^-k."""
    n = len(h) + 1
    if not _powers or len(_powers[0]) < n:
        size = max(4096, 2 * n)
        _powers[:] = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, f, np.uint64))]) for f in (_FACTOR, pow(_FACTOR, -1, 1 << 64))]
    up, down = _powers
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * down[: n - 1])])
    return C.mix64((total[ends] - total[starts]) * up[ends])


def units(text: str, hashes: C.WordHashes, marks: _Ends, by_content: bool) -> tuple[np.ndarray, np.ndarray]:
    """Word count and hash of each sentence: what sentences() finds, without the places."""
    words: list[str] = []
    lines = []
    for line in text.lower().split("\n"):
        words += line.split()
        lines.append(len(words))
    end = np.fromiter(map(marks.__getitem__, words), bool, len(words))
    ends = np.union1d(np.flatnonzero(end) + 1, np.array(lines, np.int64))
    ends = ends[ends > 0]
    h = hashes.array(words)
    if by_content:
        ends = content_ends(h, ends)
    elif len(ends):
        starts = np.concatenate([[0], ends[:-1]])
        ends = np.concatenate([np.append(np.arange(a + LONGEST, b, LONGEST), b) for a, b in zip(starts, ends)])
    starts = np.concatenate([np.zeros(min(1, len(ends)), np.int64), ends[:-1]])
    return ends - starts, run_hashes(h, starts, ends)


def spans(counts: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First sentence, number of sentences and hash of the span that starts at each sentence, where one is left."""
    total = np.concatenate([[0], np.cumsum(counts)])
    first = np.arange(len(counts))
    past = np.maximum(np.searchsorted(total, total[:-1] + WORDS, "left"), first + SENTENCES)
    whole = past <= len(counts)
    first, past = first[whole], past[whole]
    return first, past - first, run_hashes(hashes, first, past).view(np.int64)


#: place holds a tag of the text (24 bits), the first sentence (31 bits) and how many there are (8 bits): a span has at most
#: WORDS sentences, since each has a word.
_SPANS = pa.schema([("h", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int64()), ("again", pa.bool_())])
_SPANS_DDL = "h long, doc_id long, place long, again boolean"
_TAGS = (1 << 24) - 1


def _tagged(docs: DataFrame) -> DataFrame:
    """doc_id, text, tag: the tag tells rows apart that share a doc_id."""
    src = C.plain(docs, "doc_id", "text")
    return src.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").bitwiseAND(F.lit(_TAGS)).alias("tag"))


def _emit_spans(batches: Iterator[pa.RecordBatch], by_content: bool) -> Iterator[pa.RecordBatch]:
    hashes, marks = C.WordHashes(), _Ends()
    for b in batches:
        rows: list[tuple[np.ndarray, ...]] = []
        for doc, text, tag in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "tag"))):
            if doc is None or not text:
                continue
            first, size, h = spans(*units(text, hashes, marks, by_content))
            if len(h):
                again = np.ones(len(h), bool)
                again[np.unique(h, return_index=True)[1]] = False  # all but the first of each
                rows.append((h, np.full(len(h), doc, np.int64), tag << 39 | first << 8 | size, again))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows)], schema=_SPANS)


_CLEAN = pa.schema([("doc_id", pa.int64()), ("clean", pa.string()), ("n_sentences", pa.int64()), ("n_removed", pa.int64())])
_CLEAN_DDL = "doc_id long, clean string, n_sentences long, n_removed long"


def _remove(batches: Iterator[pa.RecordBatch], by_content: bool) -> Iterator[pa.RecordBatch]:
    hashes = C.WordHashes() if by_content else None
    for b in batches:
        rows = []
        for doc, text, cut in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "cut"))):
            own = sentences(text, hashes)
            gone = np.zeros(len(own) + 1, np.int64)
            for place in cut:
                gone[place >> 8] += 1
                gone[(place >> 8) + (place & 255)] -= 1
            gone = np.cumsum(gone)[:-1] > 0
            parts, at = [], 0
            for (begin, end, _, _), g in zip(own, gone):
                if g:
                    parts.append(text[at:begin].rstrip(" "))
                    at = end
            parts.append(text[at:])
            rows.append((doc, "".join(parts).strip(), len(own), int(gone.sum())))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _CLEAN)] if rows else [pa.array([], f.type) for f in _CLEAN], schema=_CLEAN)


def repeated_spans(docs: DataFrame, by_content: bool = False) -> DataFrame:
    """docs (doc_id, text) -> doc_id, tag, cut: the places (first sentence << 8 | sentences) that non-first repeated spans
    cover. Only texts that lose something.

    The first of a span is the one in the smallest doc_id, and there the earliest. A text of any length is read whole, and
    the groups of a hash are only counted and joined, so that no task holds a hot one.
    """
    C.prepare(docs.sparkSession)
    found = C.table(C.mapped(_tagged(docs), partial(_emit_spans, by_content=by_content), _SPANS_DDL), "spans")
    firsts = found.where("not again").groupBy("h").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("other")).where("keeper < other").select("h", "keeper")
    firsts = C.table(firsts, "firsts")
    later = found.where("not again").join(firsts, "h").where("doc_id > keeper").select("doc_id", "place")
    # a span that its own text repeats: all but the earliest go, wherever the first of all is
    inner = found.where("again").select("doc_id", "place")
    cut = later.unionByName(inner).withColumn("tag", F.shiftright("place", 39)).groupBy("doc_id", "tag").agg(F.collect_set(F.col("place").bitwiseAND(F.lit((1 << 39) - 1))).alias("cut"))
    cut = C.table(cut, "cut")
    C.drop(found, firsts)
    return cut


def drop_repeated_spans(docs: DataFrame, by_content: bool = False) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, clean, n_sentences, n_removed for the rows that lose sentences.

    clean is the text without the sentences that a non-first repeated span covers; all else is as it was but for
    spaces at the cuts. Texts that stay as they are have no row; null and empty texts never change, nor do rows with a
    null doc_id. Rows that repeat a doc_id are one document: what repeats only among them stays, and each text that loses
    something to others, or to itself, has a row of its own. Case and white space do not tell spans apart. Spans are
    compared by 64-bit hashes. Very long texts are cut whole; an empty table gives no rows; extra columns are ignored,
    whatever their names. by_content: cut long sentences by content, so that passages meet wherever they begin (see LEAST_OF).
    """
    cut = repeated_spans(docs, by_content)
    changed = _tagged(docs).where("text is not null")
    return C.mapped(changed.join(cut, ["doc_id", "tag"]).select("doc_id", "text", "cut"), partial(_remove, by_content=by_content), _CLEAN_DDL)
