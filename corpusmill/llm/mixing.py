"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree over blocks of words.

Each source's documents lie in a pseudo-random order on a line of words, which is cut into blocks of equal length. A
source's target is an exact number of words, that is a number of whole passes over its blocks and one more pass that ends within a
block. These block quotas are dealt out to the output shards: a quota is split over a binary tree of shards, each branch
drawing its part from the hypergeometric law of what room is left below it, so that shards are as mixed as if all blocks had been
shuffled, and yet every source's quota and every shard's room come out exactly. Then each shard draws its number of the source's
permuted blocks, disjoint from the other shards', and is shuffled in itself.

All of it is DataFrame and SQL functions: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, MOST, SHARDS, SEED = (5, 2, 1), 3, 16, 20
#: Blocks in all, about; and the least words of a block.
BLOCKS, LEAST_BLOCK = 1 << 16, 256
#: Siblings in one node of the tree of sources.
SIBLINGS = 1024
#: Multipliers of the block permutations: primes above any number of blocks.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549, 2147483543, 2147483497)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _key_of(source: Column) -> Column:
    """The source as a string that is never null; its order is that of code points, null last."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("t"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sizes (source, words), a row a source -> with rank, weight and target.

    Sources in order of code points, null last, weigh weights[0], weights[1], ..., repeating. Their targets share all words by weight,
    but none exceeds `most` times its own words; what is above is shared again by weight until none is. In order of words a weight those
    that reach their limit come first: each is limited if the level that the others would share, were all before it limited,
    passes its own limit, so sums of earlier rows settle every source at once.
    """
    prefix = F.conv(F.rpad(F.hex(F.substring(F.encode("__k", "UTF-8"), 1, 5)), 10, "0"), 16, 10).cast("long")
    own = sizes.withColumn("__k", _key_of(F.col("source")))
    own = C.running_total(own.withColumn("__p", prefix).withColumn("__1", F.lit(1).cast("long")), [], "__p", ["__k"], "__1", "rank")
    own = own.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double"))
    own = own.withColumn("__cap", (F.col("words") * most).cast("double")).withColumn("__r", F.col("__cap") / F.col("weight"))
    own = C.table(own.withColumn("__b", F.floor(F.log2(F.col("__r") + 1) * 64)).select("source", "words", "rank", "weight", "__k", "__cap", "__r", "__b"), "sources")
    all_words, all_weights = own.agg(F.sum("words"), F.sum("weight")).first()
    if not all_weights:
        return own.withColumn("target", F.lit(0.0)).select("source", "words", "rank", "weight", F.col("__k").alias("key"), "target")
    lined = C.running_total(own, [], "__b", ["__r", "rank"], "__cap", "__caps")
    lined = C.running_total(lined, [], "__b", ["__r", "rank"], "weight", "__weights")
    lined = lined.withColumn("__level", (F.lit(float(all_words)) - F.col("__caps")) / (F.lit(float(all_weights)) - F.col("__weights")))
    lined = C.table(lined.withColumn("__full", F.col("__level") > F.col("__r")), "levels")
    level = lined.agg(F.max(F.when(~F.col("__full"), F.col("__level")))).first()[0] or 0.0
    C.drop(own)
    target = F.when(F.col("__full"), F.col("__cap")).otherwise(F.least(F.col("weight") * F.lit(level), F.col("__cap")))
    return lined.select("source", "words", "rank", "weight", F.col("__k").alias("key"), target.alias("target"))


def _draw(rest: str, half: str, quota: str, chance: str) -> str:
    """SQL: how many of `quota` blocks, drawn from `rest` of which `half` lie left, lie left. chance: uniform in [0, 1).

    The hypergeometric law by inversion: weights of ten deviations around the mean follow from one another by ratios; what lies
    beyond weighs less than the last bit of the chance. SQL has no let, so a one-element array binds what is used repeatedly.
    """
    step = "((p.k - x) * (p.n - x) * s.w) / ((x + 1D) * (p.t - p.k - p.n + x + 1D))"
    ends = "struct(r.t AS t, r.k AS k, r.n AS n, greatest(r.lo, bigint(floor(r.m - 10 * r.sd - 10))) AS a, least(r.hi, bigint(ceil(r.m + 10 * r.sd + 10))) AS b)"
    facts = f"""struct({rest} AS t, {half} AS k, {quota} AS n, greatest(0L, {quota} - ({rest} - {half})) AS lo, least({half}, {quota}) AS hi,
      {quota} * double({half}) / greatest({rest}, 1L) AS m,
      sqrt({quota} * (double({half}) / greatest({rest}, 1L)) * (double({rest} - {half}) / greatest({rest}, 1L)) * (double({rest} - {quota}) / greatest({rest} - 1L, 1L))) AS sd)"""
    total = f"aggregate(sequence(p.a, p.b), struct(1D AS w, 0D AS c), (s, x) -> struct({step} AS w, s.c + s.w AS c)).c"
    below = f"aggregate(sequence(p.a, p.b), struct(1D AS w, 0D AS c, 0L AS y), (s, x) -> struct({step} AS w, s.c + s.w AS c, s.y + IF(s.c + s.w <= g, 1L, 0L) AS y)).y"
    return f"transform(transform(array({facts}), r -> {ends}), p -> IF(p.a >= p.b, p.a, least(p.b, p.a + transform(array({chance} * {total}), g -> {below})[0])))[0]"


def _split(room: str, child: str, quota: str, height: int, seed: int) -> str:
    """SQL: a quota dealt out over the shards' room, an array of 2**height longs. child: what makes its chances its own."""
    pyramid = f"aggregate(sequence(1, {height}), array({room}), (p, h) -> concat(array(transform(sequence(0, size(p[0]) div 2 - 1), i -> p[0][2 * i] + p[0][2 * i + 1])), p))"
    chance = f"((xxhash64({seed}, {child}, h, i) & 9007199254740991L) / 9007199254740992D)"
    left = _draw("q[h][i]", "q[h + 1][2 * i]", "had[i]", chance)
    level = f"flatten(transform(sequence(0, size(had) - 1), i -> transform(array({left}), l -> array(l, had[i] - l))[0]))"
    return f"transform(array({pyramid}), q -> aggregate(sequence(0, {height - 1}), array({quota}), (had, h) -> {level}))[0]"


def deal(quotas: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """quotas (rank, quota), ranks gapless from 0 -> (rank, dealt): how many of the source's blocks each shard gets.

    Shards have room for equal numbers of blocks, but for one. Sources are dealt out one after the other by the room that earlier ones left,
    at most SIBLINGS a row: beyond that, groups of sources are dealt out first, then the sources of each group by the group's room.
    """
    height = max(1, (shards - 1).bit_length())
    total, n = quotas.agg(F.sum("quota"), F.count("*")).first()
    room = [((j + 1) * (total or 0)) // shards - (j * (total or 0)) // shards for j in range(shards)] + [0] * ((1 << height) - shards)
    levels = [quotas.select(F.col("rank").alias("child"), "quota")]
    while n > 1:
        n = -(-n // SIBLINGS)
        levels.append(levels[-1].groupBy(F.floor(F.col("child") / SIBLINGS).alias("child")).agg(F.sum("quota").alias("quota")))
    one_by_one = f"""aggregate(children, struct(room AS room, array(array(0L)) AS out), (s, k) -> transform(array({_split("s.room", "k.child", "k.quota", height, seed)}),
        d -> struct(zip_with(s.room, d, (a, b) -> a - b) AS room, concat(s.out, array(d)) AS out))[0]).out"""
    top = levels.pop() if len(levels) > 1 else levels[0].groupBy(F.lit(0).cast("long").alias("child")).agg(F.sum("quota").alias("quota"))
    dealt = top.select(F.col("child").alias("node"), F.array(*[F.lit(r).cast("long") for r in room]).alias("room"))
    for below in reversed(levels):
        lists = below.groupBy(F.floor(F.col("child") / SIBLINGS).alias("node")).agg(F.sort_array(F.collect_list(F.struct("child", "quota"))).alias("children"))
        rows = dealt.join(lists, "node").withColumn("out", F.expr(one_by_one))
        dealt = rows.select(F.explode(F.arrays_zip("children", F.expr("slice(out, 2, size(children))").alias("of"))).alias("x")).select(F.col("x.children.child").alias("node"), F.col("x.of").alias("room"))
    return dealt.select(F.col("node").alias("rank"), F.slice("room", 1, shards).alias("dealt"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, shards: int = SHARDS, block_words: int | None = None, seed: int = SEED) -> DataFrame:
    """docs (doc_id, text, source, ...) -> a row a document: doc_id, source, key, size, source_size, target, taken, pieces.

    size: words of the text (null: 0). target: see targets(). taken: the words that the mix takes, repeats counted: a source's sum is
    its target rounded to a whole number, and no word is taken more than `most` times. pieces: array of (shard, turn, epoch, first, n): n words
    from the first on go to the shard in the given pass over the source; within a shard pieces are read in order of turn, a hash.
    A block has block_words words, by default as many as make about BLOCKS blocks in all; a document that lies over several blocks is cut
    between them. The same documents give the same mix, however they are partitioned: places follow from hashes of doc_id and text.

    Rows with null or repeated doc_ids count one by one; rows that are equal throughout lie side by side. Null sources are one
    source, the last. Empty texts and sources without words take nothing. Texts of any length are cut only at blocks. An empty table gives no rows.
    Extra columns are ignored, whatever their names. Sources of any number and size: hot ones are lined up in buckets of rows.
    """
    own = C.plain(docs, "doc_id", "text", "source")
    own = own.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64("doc_id", "text").alias("key"), word_count(F.col("text")).alias("size"))
    digest = C.table(own.groupBy("source", "doc_id", "key", "size").agg(F.count("*").alias("n")), "digest")
    sources = C.table(targets(digest.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words")), weights, most), "targets")
    wanted = sources.agg(F.sum(F.rint("target"))).first()[0] or 0
    block = block_words or max(LEAST_BLOCK, int(wanted) // BLOCKS + 1)
    width = F.lit(block).cast("long")
    words = F.rint("target").cast("long")
    sources = sources.withColumn("wanted", F.least(words, F.col("words") * most)).withColumn("passes", F.expr("IF(words = 0, 0L, wanted div words)"))
    sources = sources.withColumn("over", F.col("wanted") - F.col("passes") * F.col("words")).withColumn("whole", F.expr(f"words div {block}L")).withColumn("blocks", F.ceil(F.col("words") / width))
    sources = sources.withColumn("quota", F.col("passes") * F.col("blocks") + F.ceil(F.col("over") / width))
    dealt = deal(C.table(sources.select("rank", "quota"), "quotas"), shards, seed)
    ends = F.expr("transform(sequence(1, size(dealt)), j -> aggregate(slice(dealt, 1, j), 0L, (a, b) -> a + b))")
    law = C.table(sources.join(dealt, "rank").select(F.col("key").alias("of"), F.col("words").alias("source_size"), "target", "passes", "over", "whole", "blocks", ends.alias("ends")), "law")

    rows = digest.withColumn("of", _key_of(F.col("source"))).withColumn("words", F.col("size") * F.col("n"))
    buckets = 1 + digest.count() // 4096
    lined = C.running_total(rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(buckets))), ["of"], "bucket", ["key", "doc_id", "size"], "words", "before")
    each = lined.join(C.broadcast_if_small(law), "of").withColumn("copy", F.explode(F.expr("sequence(0L, n - 1)"))).withColumn("at", F.col("before") + F.col("copy") * F.col("size"))
    primes = "array(" + ", ".join(f"{p}L" for p in PRIMES) + ")"
    slot = f"IF(k >= whole, whole, (({primes}[pmod(xxhash64({seed}, of, e), {len(PRIMES)})] % whole) * k + pmod(xxhash64({seed + 1}, of, e), whole)) % whole)"
    # of each pass and block that the document lies in: where its words begin there, how many there are, and the block's place among the permuted ones
    pieces = f"""IF(size = 0, array(), flatten(transform(sequence(0L, passes), e -> transform(sequence(at div {block}L, (at + size - 1) div {block}L),
      k -> struct(e AS epoch, k AS k, {slot} AS slot, greatest(at, k * {block}L) AS lo, least(at + size, (k + 1) * {block}L) AS hi)))))"""
    taken = f"transform(places, p -> struct(p.epoch AS epoch, p.epoch * blocks + p.slot AS turn, p.lo - at AS first, least(p.hi - p.lo, greatest(0L, IF(p.epoch < passes, source_size, over) - p.slot * {block}L - (p.lo - p.k * {block}L))) AS n))"
    given = f"transform(filter(taken_of, p -> p.n > 0), p -> struct(size(filter(ends, x -> x <= p.turn)) AS shard, xxhash64({seed}, of, p.turn, key, copy, p.first) AS turn, p.epoch AS epoch, p.first AS first, p.n AS n))"
    each = each.withColumn("places", F.expr(pieces)).withColumn("taken_of", F.expr(taken)).withColumn("pieces", F.expr(given))
    return each.select("doc_id", "source", "key", "size", "source_size", "target", F.expr("aggregate(pieces, 0L, (a, p) -> a + p.n)").alias("taken"), "pieces")


def shard_texts(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """docs and mix(docs) -> a row a piece: shard, turn, doc_id, source, epoch, first, n, text. A whole document keeps its text; of a part, the words are joined by spaces."""
    own = C.plain(docs, "doc_id", "text")
    own = own.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("key", F.xxhash64("doc_id", "text")).dropDuplicates(["doc_id", "key"])
    pieces = mixed.select(F.col("doc_id").alias("id"), "source", F.col("key").alias("mark"), "size", F.explode("pieces").alias("p"))
    both = pieces.join(own, (F.col("mark") == F.col("key")) & F.col("id").eqNullSafe(F.col("doc_id")))
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), 0), F.col("p.first").cast("int") + 1, F.col("p.n").cast("int")), " ")
    return both.select("p.shard", "p.turn", "doc_id", "source", "p.epoch", "p.first", "p.n", F.when(F.col("p.n") == F.col("size"), F.col("text")).otherwise(cut).alias("text"))


def write_shards(pieces: DataFrame, path: str, parts: int = 8) -> None:
    """Writes shard_texts() as Parquet by shard, `parts` files each, every file shuffled in itself. A shard may be larger than a task: its rows are dealt out by their hash."""
    dealt = pieces.withColumn("part", F.pmod("turn", F.lit(parts)))
    dealt.repartition("shard", "part").sortWithinPartitions("shard", "turn").drop("part").write.partitionBy("shard").parquet(path)
