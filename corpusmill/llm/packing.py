"""Mixture-controlled packing: deficit round-robin over source queues into windows of token ids.

Each source is a queue of packets (runs of at most PACKET ids of one document). Every round a source earns its
share of a window, its quantum; a packet leaves in the first round in which the earned and unspent tokens, the
deficit, cover it. With c the queue's tokens up to and with the packet that round is ceil(c / quantum): the deficit
at any point is known from a running total, so queues are served in parallel and deficits carry over windows and
partitions. Rounds are then laid end to end, and the stream is cut every `window` ids.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

WINDOW, PACKET = 1024, 256
END_ID = 0


class Ids:
    """Ids of texts, as bytes. ranks: a .tiktoken file; pattern: the pieces' pattern; kind: u2 or u4, little-endian.

    vocabulary: the same vocabulary as a json file of tokenizers, which encodes what tiktoken cannot: texts that hold
    one of added (added tokens of the json that count as such), and texts on which tiktoken panics (white space of a million
    characters). It is read when the first such text comes. A dictionary of words seen before costs more than it saves: most
    misses are words that occur once.
    """

    def __init__(self, ranks: str, pattern: str, kind: str, vocabulary: str | None = None, added: tuple[str, ...] = ()):
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.code = {"<u2": "H", "<u4": "I"}[kind]
        self.vocabulary, self.added, self.slow = vocabulary, added, None

    def of(self, text: str) -> bytes:
        if not any(t in text for t in self.added):
            try:
                return array(self.code, self.encode(text)).tobytes()
            except BaseException as e:  # pyo3's PanicException is no Exception and cannot be imported
                if type(e).__name__ != "PanicException" or self.vocabulary is None:
                    raise
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.vocabulary)
            self.slow.encode_special_tokens = not self.added
        return array(self.code, self.slow.encode(text, add_special_tokens=False).ids).tobytes()


def added_tokens_of(vocabulary: str) -> dict[int, str]:
    """The added tokens of a json file of tokenizers, by id."""
    from tokenizers import Tokenizer

    return {i: t.content for i, t in Tokenizer.from_file(vocabulary).get_added_tokens_decoder().items()}


def id_kind(ranks: str, added: dict[int, str]) -> str:
    """The narrowest of u2 and u4 that holds every id of the vocabulary."""
    with open(ranks, "rb") as f:
        most = max((int(line.split()[1]) for line in f), default=0)
    return "<u2" if max([most, *added]) < 1 << 16 else "<u4"


_IDS = pa.schema([("row", pa.int64()), ("part", pa.int64()), ("doc_id", pa.int64()), ("source", pa.string()), ("ids", pa.binary()), ("n", pa.int64())])
_IDS_DDL = "row long, part long, doc_id long, source string, ids binary, n long"


def _tokenise(batches: Iterator[pa.RecordBatch], ranks: str, pattern: str, kind: str, vocabulary: str | None, added: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    ids = Ids(ranks, pattern, kind, vocabulary, added)  # made in a tenth of a second, and gone with the task
    part, at, end = TaskContext.get().partitionId(), 0, np.array([END_ID], kind).tobytes()
    size = len(end)
    for b in batches:
        made = [(ids.of(t) if t else b"") + end for t in b.column("text").to_pylist()]
        n = len(made)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + n) + (part << 40)), pa.array(np.full(n, part, np.int64)), b.column("doc_id"), b.column("source"), pa.array(made, pa.binary()), pa.array([len(x) // size for x in made], pa.int64())], schema=_IDS)
        at += n


_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("source", pa.string())])
_PIECES_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


def _cut(batches: Iterator[pa.RecordBatch], kind: str, window: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[tuple] = []
        for doc, source, ids, n, runs in zip(*(b.column(c).to_pylist() for c in ("doc_id", "source", "ids", "n", "runs"))):
            wide = np.frombuffer(ids, kind).astype("<u4").tobytes()
            pieces: list[list[int]] = []
            for run in sorted(runs, key=lambda r: r["start"]):
                start, left, at = run["start"], run["length"], run["at"]
                while left:
                    take = min(left, window - at % window)
                    last = pieces[-1] if pieces else None
                    if last and last[2] // window == at // window and last[2] + last[1] == at and last[0] + last[1] == start:
                        last[1] += take  # the next packet follows on in the same window
                    else:
                        pieces.append([start, take, at])
                    start, left, at = start + take, left - take, at + take
            out += [(doc, s, k, zlib.crc32(wide[4 * s : 4 * (s + k)]), n, at // window, at % window, source) for s, k, at in pieces]
        for i in range(0, len(out), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out[i : i + 100_000]), _PIECES)], schema=_PIECES)


def pack(docs: DataFrame, ranks: str | None = None, pattern: str | None = None, window: int = WINDOW, packet: int = PACKET, shares: dict[str, float] | None = None, vocabulary: str | None = None, added_tokens: bool = False) -> DataFrame:
    """docs (doc_id, text, source, ...) -> one row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source.

    A document is the ids of its text (null: none) and END_ID; every id lies in exactly one piece, sequences are full
    but for the last. shares: a source's part of each window; the default is its part of all tokens, so that queues run
    dry together. Sources missing from shares get what is left over in equal parts; shares that are not positive, or above 1 together, are an
    error. At any window's end a source is behind or
    ahead of its share by less than a packet and a quantum, as long as no queue is empty. Null and
    repeated doc_ids are packed row by row, null sources as one queue; texts of any length are packed whole; an empty
    table gives no rows; extra columns are ignored, whatever their names. vocabulary: see Ids. added_tokens:
    its added tokens (<|endoftext|>) get their own ids where a text holds them, as tokenizers' encode gives by default;
    otherwise they are text like any other.
    """
    spark = docs.sparkSession
    C.prepare(spark)
    if ranks is None or pattern is None:
        import public_tokenizers

        if ranks is None:
            vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
        ranks, pattern = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    if added_tokens and not vocabulary:
        raise ValueError("added_tokens needs the vocabulary's json file")
    added = added_tokens_of(vocabulary) if vocabulary else {}
    kind, taken = id_kind(ranks, added), tuple(added.values()) if added_tokens else ()
    src = C.plain(docs, "doc_id", "text", "source").withColumn("doc_id", F.col("doc_id").cast("long"))
    ids = C.table(C.mapped(src, partial(_tokenise, ranks=ranks, pattern=pattern, kind=kind, vocabulary=vocabulary, added=taken), _IDS_DDL), "ids")
    lengths = ids.select("row", "part", F.coalesce("source", F.lit("")).alias("queue"), "n")
    by_queue = lengths.groupBy("queue").agg(F.sum("n").alias("tokens"))
    total, others = by_queue.agg(F.sum("tokens"), F.count_if(~F.col("queue").isin(list(shares or ())))).first()
    by_queue = by_queue.withColumn("quantum", _quantum(total or 0, window, shares, others))
    # docs of a part and source in line; then the round in which each packet's deficit is covered
    lined = C.running_total(lengths, ["queue"], "part", ["row"], "n", "before")
    lined = lined.join(by_queue.select("queue", "quantum"), "queue")
    packets = lined.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(packet).cast("long"))))
    packets = packets.withColumn("length", F.least(F.lit(packet).cast("long"), F.col("n") - F.col("start")))
    packets = packets.withColumn("round", F.ceil((F.col("before") + F.col("start") + F.col("length")) / F.col("quantum")).cast("long"))
    # rounds are cut into blocks of some 250 windows, salted by nothing: a round has about one window of tokens
    packets = packets.withColumn("block", F.floor(F.col("round") / 256)).select("row", "queue", "before", "start", "length", "round", "block")
    laid = C.running_total(packets, [], "block", ["round", "queue", "before", "start"], "length", "at")
    runs = laid.groupBy("row").agg(F.collect_list(F.struct("start", "length", "at")).alias("runs"))  # at most n / packet of a document
    both = ids.select("row", "doc_id", "source", "ids", "n").join(runs.hint("shuffle_hash"), "row")
    return C.mapped(both.select("doc_id", "source", "ids", "n", "runs"), partial(_cut, kind=kind, window=window), _PIECES_DDL)


def _quantum(total: int, window: int, shares: dict[str, float] | None, others: int) -> Column:
    if not shares:
        return F.col("tokens") * F.lit(float(window)) / F.lit(float(max(total, 1)))
    if min(shares.values()) <= 0 or sum(shares.values()) > 1 + 1e-9:
        raise ValueError("shares must be positive and add up to 1 at most")
    share = F.lit(max(1e-6, 1 - sum(shares.values())) / max(1, others))  # what is left over, by the sources that have no share
    for source, part in shares.items():
        share = F.when(F.col("queue") == source, part).otherwise(share)
    return share * window
