"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard on full shingle sets, components.

Two fixed permutations of the universe of 2^32 shingles make every signature coordinate: sigma scatters a set once,
and coordinate k is the least pi((sigma(x) + k * STEP) mod 2^32), pi shifted circularly (C-MinHash, Li and Li 2021).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import components

ROWS, BANDS = 5, 30
SHINGLE = 5
STEP = 0x9E3779B1
#: One bit of so many coordinates is kept to tell unlike sets apart before they are compared.
SKETCH_BITS = 128


def _sigma(x: np.ndarray) -> np.ndarray:
    x = x * np.uint32(0x2C1B3C6D)
    x ^= x >> np.uint32(12)
    x *= np.uint32(0x297A2D39)
    x ^= x >> np.uint32(15)
    return x


def _pi_in_place(x: np.ndarray, spare: np.ndarray) -> None:
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        np.right_shift(x, np.uint32(shift), out=spare)
        np.bitwise_xor(x, spare, out=x)
        np.multiply(x, np.uint32(factor), out=x)
    np.right_shift(x, np.uint32(16), out=spare)
    np.bitwise_xor(x, spare, out=x)


_SHIFTS = (np.arange(ROWS * BANDS, dtype=np.uint64) * np.uint64(STEP)).astype(np.uint32)[:, None]


def signature(shingles: np.ndarray, block: int = 1024) -> np.ndarray:
    """All coordinates of a non-empty shingle set."""
    x = _sigma((shingles ^ (shingles >> np.uint64(32))).astype(np.uint32))
    best = np.full(len(_SHIFTS), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), block):
        y = x[None, at : at + block] + _SHIFTS
        _pi_in_place(y, np.empty_like(y))
        np.minimum(best, y.min(axis=1), out=best)
    return best


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    acc = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + rows[:, j]
        acc = C.mix64(acc)
    return acc.view(np.int64)


def sketch(sig: np.ndarray) -> tuple[int, int]:
    bits = np.packbits((sig[:SKETCH_BITS] & 1).astype(np.uint8)).view(np.int64)
    return int(bits[0]), int(bits[1])


_SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("bands", pa.list_(pa.int64()))])
_SIGNED_DDL = "doc_id long, n_shingles long, f1 long, f2 long, s1 long, s2 long, bands array<long>"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = C.WordHashes()
    for b in batches:
        n, f1, f2, s1, s2, bands = [], [], [], [], [], []
        for text in C.texts(b):
            s = C.shingle_set(hashes.array(C.words_lower(text)), SHINGLE)
            n.append(len(s))
            if not len(s):
                f1.append(None), f2.append(None), s1.append(None), s2.append(None), bands.append(None)
                continue
            fp = _fingerprint(s)
            sig = signature(s)
            one, two = sketch(sig)
            f1.append(int(fp[0])), f2.append(int(fp[1])), s1.append(one), s2.append(two), bands.append(band_keys(sig))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, t.type) for x, t in zip((n, f1, f2, s1, s2, bands), list(_SIGNED)[1:]))], schema=_SIGNED)


_SETS = pa.schema([("f1", pa.int64()), ("f2", pa.int64()), ("shingles", pa.list_(pa.int64()))])
_SETS_DDL = "f1 long, f2 long, shingles array<long>"


def _fingerprint(shingles: np.ndarray) -> np.ndarray:
    return np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), np.int64)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = C.WordHashes()
    for b in batches:
        made = [s for t in C.texts(b) if len(s := C.shingle_set(hashes.array(C.words_lower(t)), SHINGLE))]
        prints = np.array([_fingerprint(s) for s in made], np.int64).reshape(len(made), 2)
        yield pa.RecordBatch.from_arrays([pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.array([s.view(np.int64) for s in made], _SETS.field(2).type)], schema=_SETS)


def _links(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Of the candidate pairs (u, v) of nodes, those with 100 * intersection >= percent * union of the full sets."""
    ids = C.table(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "ids")
    wanted = sets.join(C.broadcast_if_small(ids), "node", "left_semi")
    one = wanted.select(F.col("node").alias("u"), F.col("shingles").alias("a"))
    two = wanted.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    both = pairs.join(one, "u").join(two, "v").withColumn("same", F.size(F.array_intersect("a", "b")))
    links = C.table(both.where(F.col("same") * 100 >= (F.size("a") + F.size("b") - F.col("same")) * percent).select("u", "v").distinct(), "links")
    C.drop(ids, pairs)
    return links


def _alike(percent: int, mine: str, theirs: str) -> Column:
    """What every pair over the similarity keeps to, between facts (n, s1, s2) and (k, t1, t2).

    mine and theirs count the shingles that the pair may share. The sketches' bits differ as a binomial of
    (1 - similarity) / 2; beyond 6.5 deviations is 1 in 10^9.
    """
    most = F.least(mine, theirs)
    chance = (100 - percent) / 200
    differ = SKETCH_BITS * chance + 6.5 * (SKETCH_BITS * chance * (1 - chance)) ** 0.5
    off = F.bit_count(F.col("s1").bitwiseXOR(F.col("t1"))) + F.bit_count(F.col("s2").bitwiseXOR(F.col("t2")))
    return (most * 100 >= (F.col("n") + F.col("k") - most) * percent) & (off <= int(differ))


def _rare(sets: DataFrame) -> DataFrame:
    """(a, null, r1, r3): how many shingles of node a nobody else has, and at most two others have; and (a, b, ...):
    each pair of nodes, a < b, that share a shingle of two or three nodes. Sums only: the least, the greatest and
    the exclusive or of at most three ids give all of them."""
    seen = sets.select("node", F.explode("shingles").alias("x")).groupBy("x").agg(F.count("*").alias("df"), F.min("node").alias("lo"), F.max("node").alias("hi"), F.bit_xor("node").alias("all")).where("df <= 3")
    seen = seen.withColumn("mid", F.col("all").bitwiseXOR(F.col("lo")).bitwiseXOR(F.col("hi")))
    pair = lambda a, b: F.struct(F.col(a).alias("a"), (F.lit(None).cast("long") if b is None else F.col(b)).alias("b"))
    two, three = [pair("lo", None), pair("hi", None), pair("lo", "hi")], [pair("mid", None), pair("lo", "mid"), pair("mid", "hi")]
    each = F.when(F.col("df") == 1, F.array(pair("lo", None))).when(F.col("df") == 2, F.array(*two)).otherwise(F.array(*two, *three))
    return seen.select("df", F.inline(each)).groupBy("a", "b").agg(F.count_if(F.col("df") == 1).alias("r1"), F.count("*").alias("r3"))


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_shingles, component_id, kept; one row for each row of docs.

    Texts are lower-cased (A-Z) and cut at ASCII white space; a set holds the distinct 5-word shingles, or the whole
    sequence of fewer words. Documents are linked when 100 * intersection >= percent * union (percent from 80 on);
    component_id is the smallest doc_id that can be reached. Null, empty and blank texts have no shingles and are their
    own component. Equal sets are one node from the start, so copies never meet as pairs. Sets that share too few shingles
    with all other candidates leave. A bucket's members are first held against one of them only; after those links are
    known, members still in different components are compared with each other, each pair in one bucket; pairs that share
    a shingle of no more than three nodes are compared anyway, and all others must do without those shingles.

    Rows that repeat a doc_id are one document, whatever their texts: each text may link it, and all its rows get the
    same component. Copies with a null doc_id count as texts, but name no component: their component_id is the smallest doc_id
    of their component, null where it has none, and they are kept. Texts of any length are hashed whole. An empty table
    gives no rows; extra columns are ignored, whatever their names.
    """
    C.prepare(docs.sparkSession)
    docs = C.plain(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    signed = C.table(C.mapped(docs, _sign, _SIGNED_DDL), "signed")
    some = signed.where("f1 is not null")
    classes = some.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first(F.struct("s1", "s2", "bands")).alias("sig"))
    classes = C.table(classes.select("f1", "f2", "rep", "n", "sig.*").withColumn("node", F.monotonically_increasing_id()), "classes")
    # rows of one doc_id with different texts are one document: their nodes are linked from the start
    many = some.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("f1", "f2")).alias("a"), F.max(F.struct("f1", "f2")).alias("b")).where("a <> b").select("doc_id")
    many = C.table(some.join(C.broadcast_if_small(C.table(many, "many")), "doc_id", "left_semi").join(classes.select("f1", "f2", "node"), ["f1", "f2"]).select("doc_id", "node").distinct(), "many_nodes")
    own = C.table(many.groupBy("doc_id").agg(F.min("node").alias("u")).join(many, "doc_id").where("u < node").select("u", F.col("node").alias("v")).distinct(), "own")
    reps = classes.select("node", "n", "s1", "s2", "bands")
    spread = reps.select("node", F.explode("bands").alias("bucket"))
    crowded = C.table(spread.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1").select("bucket"), "crowded")
    members = C.table(spread.join(crowded, "bucket"), "members")
    wanted = C.table(members.select("node").distinct().join(classes.select("node", "rep", "f1", "f2"), "node"), "wanted")
    prints = wanted.select("node", "f1", "f2")
    ids = C.broadcast_if_small(C.table(wanted.select("rep").distinct(), "rep_ids"))  # a null stands for all rows without an id
    texts = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")
    sets = C.table(C.mapped(texts, _sets, _SETS_DDL).join(C.broadcast_if_small(prints), ["f1", "f2"]).select("node", "shingles").dropDuplicates(["node"]), "sets")
    # shingles that no other candidate has can be in no link; those of two or three nodes only in a few, all known
    rare = C.table(_rare(sets), "rare")
    facts = reps.join(wanted.select("node"), "node", "left_semi").join(rare.where("b is null").select(F.col("a").alias("node"), "r1", "r3"), "node", "left")
    facts = facts.withColumn("c", F.col("n") - F.coalesce("r1", F.lit(0))).withColumn("c3", F.col("n") - F.coalesce("r3", F.lit(0)))
    facts = C.table(facts.where(F.col("c") * 100 >= F.col("n") * percent).select("node", "n", "c", "c3", "s1", "s2", "bands"), "facts")
    narrow = facts.drop("bands")
    other = narrow.toDF("v", "k", "d", "d3", "t1", "t2")
    # a bucket's hub is the member that shares most of its shingles: the likeliest middle of a group of near copies
    shared = C.table(members.join(narrow.select("node", (F.col("c") / F.col("n")).alias("shared")), "node"), "shared")
    hubs = shared.groupBy("bucket").agg(F.min_by("node", F.struct(-F.col("shared"), "node")).alias("hub"), F.count("*").alias("m")).where("m > 1").select("bucket", "hub")
    alive = C.table(shared.select("bucket", "node").join(hubs, "bucket"), "alive")
    first = alive.where("node <> hub").select(F.col("hub").alias("u"), F.col("node").alias("v")).distinct()
    first = first.join(narrow.withColumnRenamed("node", "u"), "u").join(other, "v").where(_alike(percent, "c", "d")).select("u", "v")
    close = _links(sets, C.table(first, "pairs"), percent)
    links = close.unionByName(own)
    found = C.table(components(links), "found")
    placed = alive.select("bucket", "node").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket")
    rest = C.table(placed.join(mixed, "bucket").join(facts, "node"), "rest")
    right = rest.select(F.col("bucket").alias("place"), F.col("node").alias("v"), F.col("component").alias("other"), F.col("n").alias("k"), F.col("c3").alias("d3"), F.col("s1").alias("t1"), F.col("s2").alias("t2"), F.col("bands").alias("theirs"))
    once = F.array_min(F.array_intersect("bands", "theirs")) == F.col("bucket")  # a pair comes from one of its buckets only
    second = rest.withColumnRenamed("node", "u").join(right, (F.col("bucket") == F.col("place")) & (F.col("component") < F.col("other")) & _alike(percent, "c3", "d3") & once)
    # pairs that share a rare shingle are held against the wider bound, whatever their buckets
    few = rare.where("b is not null").select(F.col("a").alias("u"), F.col("b").alias("v"))
    few = few.join(narrow.withColumnRenamed("node", "u"), "u").join(other, "v").where(_alike(percent, "c", "d")).select("u", "v")
    of = lambda end, name: found.select(F.col("node").alias(end), F.col("component").alias(name))
    apart = few.join(of("u", "cu"), "u", "left").join(of("v", "cv"), "v", "left").where(F.coalesce("cu", "u") != F.coalesce("cv", "v")).select("u", "v")
    more = _links(sets, C.table(second.select("u", "v").unionByName(apart).distinct(), "pairs"), percent)
    done = C.table(components(links.unionByName(more)), "done") if not more.isEmpty() else found
    # a component's name is the least doc_id of its nodes
    named = classes.select("f1", "f2", "node", "rep").join(done, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    merged = C.table(named.join(least, "component").select("f1", "f2", "component_id"), "merged")
    C.drop(many, own, crowded, members, wanted, sets, rare, facts, shared, alive, found, rest, close, more, classes, *([] if done is found else [done]))
    out = signed.select("doc_id", "n_shingles", "f1", "f2").join(merged, ["f1", "f2"], "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs without the documents that near_duplicates() does not keep; columns and kept rows unchanged, whatever their names.

    The smallest doc_id of a group stays, with all its rows. Rows with a null doc_id stay too, as do those without text.
    """
    gone = C.table(near_duplicates(docs, percent).where("not kept").select("doc_id").distinct(), "gone")
    return C.without_ids(docs, gone)
