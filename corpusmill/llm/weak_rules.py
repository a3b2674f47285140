"""Quality rules under weak supervision: rules vote or abstain, expectation-maximisation weighs them."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

SPACE = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
_MARKED = re.compile(rb"[#*$%&|<>](?:\s|$)")  # words that end in a symbol

_FACTS = pa.schema([(n, pa.int64()) for n in ("row_part", "row_no", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended", "n_upper", "n_letters", "n_distinct", "n_shouts", "n_marked", "n_function")])
_FACTS_DDL = ", ".join(f"{f.name} long" for f in _FACTS)


def repeated_words(h: np.ndarray, n: int = 3) -> int:
    """Words inside n-word windows that occur twice or more in the text, the first occurrence included."""
    grams = C.ngram_hashes(h, n)
    if len(grams) < 2:
        return 0
    _, where, count = np.unique(grams, return_inverse=True, return_counts=True)
    twice = count[where] > 1
    covered = np.zeros(len(h), bool)
    for j in range(n):
        covered[j : j + len(twice)] |= twice
    return int(covered.sum())


def facts_of(text: str, hashes: C.WordHashes) -> list[int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and what the other rules look at."""
    raw = text.encode()
    words = raw.split()
    h = hashes.array(words)
    blank = sum(map(text.count, SPACE))
    seen: set[str] = set()
    dup = ended = lines = 0
    for line in text.split("\n"):
        line_text = line.strip(SPACE)
        if not line_text:
            continue
        lines += 1
        ended += line_text[-1] in ".!?\"')»”:;"
        dup += line in seen
        seen.add(line)
    lower = text.lower()
    upper = sum(a != b for a, b in zip(text, lower)) if text != lower and len(lower) == len(text) else 0
    letters = len(text) - blank - sum(map(text.count, "0123456789.,;:!?-_'\"()[]{}/\\@=+~^`" + SYMBOLS))
    return [len(words), len(text) - blank, sum(map(text.count, SYMBOLS)), dup, repeated_words(h), lines, ended, upper, letters, len(np.unique(h)), raw.count(b"!!"), len(_MARKED.findall(raw)), sum(len(w) < 4 and w.isalpha() and w.islower() for w in words)]


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, at, hashes = TaskContext.get().partitionId(), 0, C.WordHashes()
    for b in batches:
        rows = [facts_of(t or "", hashes) for t in b.column("text").to_pylist()]
        made = np.array(rows, np.int64).reshape(len(rows), 13)
        ids = [pa.array(np.full(len(rows), part, np.int64)), pa.array(np.arange(at, at + len(rows)))]
        at += len(rows)
        yield pa.RecordBatch.from_arrays([*ids, b.column("doc_id"), *(pa.array(made[:, i]) for i in range(13))], schema=_FACTS)


def _share(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def _vote(good: Column, bad: Column) -> Column:
    """1 good, -1 bad, 0 abstains."""
    return F.when(bad, -1).when(good, 1).otherwise(0)


def _defect(bad: Column) -> Column:
    """For rules that look for one fault (FAULTS): they vote bad or abstain."""
    return _vote(F.lit(False), bad)


def rules() -> dict[str, Column]:
    """Each rule votes 1 (good), -1 (bad) or abstains with 0. A text too short for a rule makes it abstain, and
    variety abstains over 2,000 words, where the share of different words falls by itself."""
    words, lines = F.col("n_words"), F.col("n_lines")
    marked, function = _share("n_marked", "n_words"), _share("n_function", "n_words")
    length, symbols = _share("word_chars", "n_words"), _share("n_symbols", "n_words")
    upper, letters = _share("n_upper", "n_letters"), _share("n_letters", "word_chars")
    dup, ended = _share("n_dup_lines", "n_lines"), _share("n_ended", "n_lines")
    repeat, distinct, shouts = _share("n_repeat_words", "n_words"), _share("n_distinct", "n_words"), _share("n_shouts", "n_words")
    return {
        "length": _vote(words >= 80, words < 20),
        "word_length": _vote((length >= 3) & (length <= 12) & (words >= 20), (length < 2) | (length > 20)),
        "symbols": _defect(symbols > 0.1),
        "marked_words": _defect(marked > 0.1),
        "function_words": _vote((function > 0.15) & (words >= 20), (function < 0.05) & (words >= 20)),
        "lines": _defect((dup > 0.3) & (lines >= 3)),
        "repeats": _defect(repeat > 0.4),
        "capitals": _defect(upper > 0.4),
        "letters": _defect(letters < 0.7),
        "endings": _vote((ended > 0.6) & (lines >= 2), (ended < 0.2) & (lines >= 2)),
        "variety": _vote((distinct > 0.25) & words.between(20, 2000), (distinct < 0.1) & words.between(20, 2000)),
        "shouting": _defect(shouts > 0.1),
    }


#: Rules that look for one fault: not finding it is what they observe of a text. The others observe nothing where they abstain.
FAULTS = ("symbols", "marked_words", "lines", "repeats", "capitals", "letters", "shouting")
#: Where expectation-maximisation starts: the chance that a rule which observes a text votes bad, for a bad and for a good document.
START = {"fault": (0.30, 0.03), "other": (0.65, 0.07)}


@dataclass(frozen=True)
class LabelModel:
    """prior: log odds of good before any vote. weight[rule][vote]: what a vote adds to the log odds; their sum is the fitted posterior's."""

    prior: float
    weight: dict[str, dict[int, float]]

    def posterior(self) -> Column:
        odds = F.lit(self.prior)
        for rule, w in self.weight.items():
            odds = odds + F.when(F.col(f"v_{rule}") == 1, w[1]).when(F.col(f"v_{rule}") == -1, w[-1]).otherwise(w[0])
        return 1 / (1 + F.exp(-odds))


def fit_label_model(patterns: list[tuple[tuple[int, ...], int]], names: list[str], rounds: int = 100, pseudo: float = 20.0) -> LabelModel:
    """Expectation-maximisation over vote patterns and how many documents cast each.

    A rule that observes a document votes bad with one chance for each class. An abstention is no observation, in the
    fit as in the posterior; of FAULTS it is the observation that the fault is not there. Pseudo-counts hold each rule near START where
    data say little. A bad vote may not be likelier of good documents: where counts say so, both classes share the pooled chance, which is the
    likeliest one under that condition, so classes cannot swap and no vote counts against its own side. No documents: START.
    """
    votes = np.array([p for p, _ in patterns], np.int64).reshape(len(patterns), len(names))
    n = np.array([c for _, c in patterns], float)
    bad = (votes == -1).astype(float)
    seen = ((votes != 0) | np.array([r in FAULTS for r in names])).astype(float)
    start = np.array([START["fault" if r in FAULTS else "other"] for r in names]).T  # class, rule
    good, chance = 0.8, start.copy()
    for _ in range(rounds if len(patterns) else 0):
        at = bad @ np.log(chance).T + (seen - bad) @ np.log1p(-chance).T  # pattern, class
        post = 1 / (1 + np.exp(-np.clip(math.log(good / (1 - good)) + at[:, 1] - at[:, 0], -500, 500)))
        good = float(((post * n).sum() + 4 * pseudo) / (n.sum() + 5 * pseudo))
        of = np.stack([(1 - post) * n, post * n])  # class, pattern
        hits, all_ = pseudo * start + of @ bad, pseudo + of @ seen
        chance = np.where(hits[1] / all_[1] > hits[0] / all_[0], hits.sum(0) / all_.sum(0), hits / all_)
    w = {-1: np.log(chance[1] / chance[0]), 1: np.log1p(-chance[1]) - np.log1p(-chance[0])}
    return LabelModel(math.log(good / (1 - good)), {r: {-1: float(w[-1][i]), 1: float(w[1][i]), 0: float(w[1][i]) if r in FAULTS else 0.0} for i, r in enumerate(names)})


def quality_votes(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> one row each with text facts, votes, base_failed, p_good and kept.

    kept is false where base_failed (under 50 words, or more than half of the words in repeated 3-word windows), else
    p_good >= 0.5. A null text counts as empty: no words, base_failed. Repeated rows and null ids give a row each;
    an empty table gives none. Texts of any length are read whole. Extra columns are ignored, whatever their names. The model sees counts of vote patterns of all documents:
    at most 3^12 rows however many documents there are.
    """
    spark = docs.sparkSession
    C.prepare(spark)
    facts = C.plain(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    facts = C.table(C.mapped(facts, _facts, _FACTS_DDL), "facts")
    names = list(rules())
    voted = facts.withColumns({f"v_{r}": v for r, v in rules().items()})
    patterns = voted.groupBy(*[f"v_{r}" for r in names]).count().collect()
    model = fit_label_model([(tuple(p[:-1]), p[-1]) for p in patterns], names)
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return voted.withColumn("p_good", model.posterior()).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5))


def drop_low_quality(docs: DataFrame) -> DataFrame:
    """docs that quality_votes() keeps; columns unchanged, whatever their names.

    Rows that share a doc_id, or a null one, go only when none of them is kept.
    """
    gone = quality_votes(docs).groupBy("doc_id").agg(F.max("kept").alias("any")).where("not any").select("doc_id")
    return C.without_ids(docs, C.table(gone, "gone"), nulls=True)
