"""Quality by perplexity: an interpolated modified Kneser-Ney model of byte n-grams, trained on trusted text.

Counts are Spark tables keyed by n-gram, and discounts, back-off weights and probabilities are joins between them,
dealt out by key. A document is scored in passes over shards of the finished model, each of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Symbols are bytes; an n-gram is a number of ORDER bytes, the latest lowest.
ORDER = 5
#: Rows of the model in one broadcast shard (12 bytes each in a worker).
SHARD_ROWS = 3_000_000
#: Distinct n-grams that a counting task holds before it hands on what it has.
HELD_GRAMS = 1_500_000
#: Bytes of text looked at together.
CHUNK = 1 << 20

_PAD = b"\n" * (ORDER - 1)


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ORDER-gram that ends at each byte of each text, line breaks before its start; and the texts' lengths."""
    raw = np.frombuffer(b"".join(_PAD + t for t in texts), np.uint8).astype(np.int64)
    key = np.zeros(max(0, len(raw) - ORDER + 1), np.int64)
    for j in range(ORDER):
        key <<= 8
        key |= raw[j : j + len(key)]
    sizes = np.array([len(t) for t in texts], np.int64)
    mine = np.ones(len(key), bool)
    ends = np.cumsum(sizes + ORDER - 1)[:-1]
    for j in range(ORDER - 1):
        mine[ends - ORDER + 1 + j] = False  # those that begin in one text and end in the next one's padding
    return key[mine], sizes


def chunks(ids: list, texts: list[bytes]) -> Iterator[tuple[list, list[bytes]]]:
    own, held, n = [], [], 0
    for i, t in zip(ids, texts):
        own.append(i), held.append(t)
        n += len(t)
        if n >= CHUNK:
            yield own, held
            own, held, n = [], [], 0
    if own:
        yield own, held


def _merge(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    return keys, np.bincount(where, np.concatenate([n, m])).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def out():
        for i in range(0, len(keys), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 50_000]), pa.array(counts[i : i + 50_000])], names=["gram", "c"])

    for b in batches:
        for _, texts in chunks(*[[t for t in C.texts(b) if t]] * 2):
            keys, counts = _merge(keys, counts, *np.unique(grams(texts)[0], return_counts=True))
            if len(keys) > HELD_GRAMS:
                yield from out()
                keys, counts = keys[:0], counts[:0]
    yield from out()


def _smoothed(counts: DataFrame, order: int, lower: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """counts (gram, c) of one order -> (gram, p) interpolated with lower's p, and (context, gamma)."""
    n = counts.agg(*[F.count_if(F.col("c") == i).alias(f"n{i}") for i in (1, 2, 3, 4)]).first()
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    cut = [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.1), k - 0.05) if n[k - 1] else k * 0.5 for k in (1, 2, 3)]
    discount = F.when(F.col("c") == 1, cut[0]).when(F.col("c") == 2, cut[1]).otherwise(cut[2])
    held = counts.withColumn("context", F.shiftright("gram", 8))
    contexts = held.groupBy("context").agg(F.sum("c").alias("total"), F.sum(discount).alias("freed")).withColumn("gamma", F.col("freed") / F.col("total"))
    shared = held.join(contexts, "context").withColumn("own", (F.col("c") - discount) / F.col("total"))
    if lower is None:
        p = shared.select("gram", (F.col("own") + F.col("gamma") / 256).alias("p"))
    else:
        mask = (1 << 8 * (order - 1)) - 1
        shared = shared.withColumn("suffix", F.col("gram").bitwiseAND(F.lit(mask)))
        p = shared.join(lower.select(F.col("gram").alias("suffix"), F.col("p").alias("q")), "suffix").select("gram", (F.col("own") + F.col("gamma") * F.col("q")).alias("p"))
    return p, contexts.select("context", "gamma")


def train(trusted: DataFrame) -> DataFrame:
    """trusted (text) -> the model: kind (order k for probabilities, -k for the weights of k-gram contexts), key, value.

    value is log p of the k-gram, or log gamma of the context. No text gives no rows: every byte then has 1/256.
    """
    C.prepare(trusted.sparkSession)
    counts = C.table(C.mapped(C.plain(trusted, "text"), _count, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c")), "grams")
    levels = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):  # a lower order counts the different bytes seen before a gram
        levels[k] = C.table(levels[k + 1].groupBy(F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("gram")).agg(F.count("*").alias("c")), "grams")
    lower, parts, stored = None, [], []
    for k in range(1, ORDER + 1):
        p, contexts = _smoothed(levels[k], k, lower)
        lower = C.table(p, "p")
        stored.append(lower)
        parts += [lower.select(F.lit(k).alias("kind"), F.col("gram").alias("key"), F.log("p").cast("float").alias("value"))]
        if k > 1:
            parts += [contexts.select(F.lit(-k).alias("kind"), F.col("context").alias("key"), F.log("gamma").cast("float").alias("value"))]
        else:
            parts += [contexts.select(F.lit(-1).alias("kind"), F.lit(0).cast("long").alias("key"), F.log("gamma").cast("float").alias("value"))]
    model = parts[0]
    for x in parts[1:]:
        model = model.unionByName(x)
    model = C.table(model, "model")
    C.drop(*levels.values(), *stored)
    return model


class Model:
    """Sorted keys and values of one shard, and log p of any n-gram whose two bytes before the last fall in it."""

    def __init__(self, rows: pa.Table):
        kind, key, value = (rows.column(c).to_numpy() for c in ("kind", "key", "value"))
        self.tables = {}
        for k in np.unique(kind):
            at = kind == k
            order = np.argsort(key[at])
            self.tables[int(k)] = key[at][order], value[at][order].astype(np.float32)

    def _look(self, kind: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own, values = self.tables.get(kind, (np.zeros(0, np.int64), np.zeros(0, np.float32)))
        if not len(own):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.float32)
        at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
        return own[at] == keys, values[at]

    def log_p(self, keys: np.ndarray) -> np.ndarray:
        gone, gamma1 = self._look(-1, np.zeros(1, np.int64))
        out = np.full(len(keys), (gamma1[0] if gone[0] else 0.0) + np.log(1 / 256), np.float32)
        for k in range(1, ORDER + 1):
            part = keys & ((1 << 8 * k) - 1)
            seen, p = self._look(k, part)
            if k > 1:
                known, gamma = self._look(-k, part >> 8)
                out += np.where(known, gamma, 0)
            out = np.where(seen, p, out)
        return out


def shard_of(context2: np.ndarray, shards: int) -> np.ndarray:
    """Positions and model rows are dealt to shards by the two bytes before the predicted one."""
    return ((context2 * 40503) >> 4) % shards


_SCORES = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("log_p", pa.float64()), ("n_bytes", pa.int64()), ("text", pa.string())])
_SCORES_DDL = "doc_id long, lang string, log_p double, n_bytes long, text string"


def _score(batches: Iterator[pa.RecordBatch], model, shard: int, shards: int) -> Iterator[pa.RecordBatch]:
    """Adds to log_p what one shard knows; only a pass that others follow hands the text on."""
    m: Model = model.value
    for b in batches:
        sums, sizes = [np.zeros(0)], [np.zeros(0, np.int64)]
        texts = [t or b"" for t in C.texts(b)]
        for _, some in chunks(texts, texts):
            keys, size = grams(some)
            each, where = np.unique(keys, return_inverse=True)
            p = np.zeros(len(each), np.float32)
            use = shard_of((each >> 8) & 0xFFFF, shards) == shard
            p[use] = m.log_p(each[use])
            total = np.concatenate([[0], np.cumsum(p[where], dtype=np.float64)])
            ends = np.cumsum(size)
            sums.append(total[ends] - total[ends - size])
            sizes.append(size)
        so_far = np.asarray(b.column("log_p").to_pylist(), float) + np.concatenate(sums)
        text = b.column("text") if shard + 1 < shards else pa.nulls(len(texts), pa.string())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), pa.array(so_far), pa.array(np.concatenate(sizes)), text], schema=_SCORES)


def perplexities(docs: DataFrame, model: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """docs (doc_id, text, lang) -> doc_id, lang, n_bytes, perplexity (a byte; null for texts without bytes), row by row.

    Each n-gram of a text is looked up in the shard that it is dealt to; a shard is one broadcast of shard_rows rows at most
    and one pass, after which it is given up. Rows of the model that belong to all shards (n-grams of one byte or two) are few.
    """
    spark = docs.sparkSession
    C.prepare(spark)
    out = C.plain(docs, "doc_id", "text", "lang").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", F.lit(0.0).alias("log_p"))
    shards = max(1, -(-model.count() // shard_rows))
    # the two bytes before the predicted one: in a gram those above the last byte, in a context its last two
    two = F.when(F.col("kind") > 0, F.shiftright("key", 8)).otherwise(F.col("key")).bitwiseAND(F.lit(0xFFFF))
    own = F.shiftright(two * 40503, 4) % shards
    for s in range(shards):
        # grams and contexts too short to have those two bytes go to every shard
        rows = model.where(F.col("kind").between(-1, 2) | (own == s)) if shards > 1 else model
        shared = spark.sparkContext.broadcast(Model(rows.toArrow()))
        before, out = out, C.table(C.mapped(out, partial(_score, model=shared, shard=s, shards=shards), _SCORES_DDL), "scores")
        shared.destroy()
        C.drop(before)
    return out.select("doc_id", "lang", "n_bytes", F.when(F.col("n_bytes") > 0, F.exp(-F.col("log_p") / F.col("n_bytes"))).alias("perplexity"))


def perplexity_quality(docs: DataFrame, trusted_ids: DataFrame, quantile: float = 0.995, slack: float = 1.1) -> DataFrame:
    """docs (doc_id, text, lang, ...) -> doc_id, lang, n_bytes, perplexity, threshold, kept; one row for each row.

    trusted_ids (doc_id): trusted texts. Four in five train the model; the fifth, by crc32 of the id, sets thresholds on
    text that it has not seen. A language's threshold is slack times that quantile of its held-out perplexities;
    languages without any, and null, take that of all held-out ones. kept: perplexity is at most the threshold; texts without bytes are not kept. Without trusted documents thresholds are null and
    every document with text is kept. Repeated rows are scored one by one, texts of any length whole; a null doc_id is
    scored and never trusted; an empty table gives no rows; extra columns are ignored, whatever their names.
    """
    docs = C.plain(docs, "doc_id", "text", "lang")
    ids = C.table(C.plain(trusted_ids, "doc_id").select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct(), "trusted")
    small = C.broadcast_if_small(ids)
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = train(docs.join(small, "doc_id", "left_semi").where(~held_out))
    scored = perplexities(docs, model)
    C.drop(model)
    marked = scored.join(small, "doc_id", "left_semi").where(held_out & F.col("perplexity").isNotNull())
    q = F.percentile_approx("perplexity", quantile, 10_000) * slack
    by_lang = marked.groupBy(F.coalesce("lang", F.lit("")).alias("of")).agg(q.alias("own"))
    anyone = marked.agg(q.alias("any")).first()[0]
    out = scored.join(by_lang, F.coalesce("lang", F.lit("")) == F.col("of"), "left")
    threshold = F.coalesce("own", F.lit(anyone).cast("double"))
    kept = F.when(F.col("perplexity").isNull(), False).otherwise(F.coalesce(F.col("perplexity") <= threshold, F.lit(True)))
    return out.select("doc_id", "lang", "n_bytes", "perplexity", threshold.alias("threshold"), kept.alias("kept"))
