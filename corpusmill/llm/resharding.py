"""Resharding by minimum-cost flow: the fewest bytes move from old shards to new capacities.

Only shard sizes reach the driver (old shards x new shards numbers). Documents of an old shard are laid out
largest first in blocks; the flow cuts that line, and because its tail is the smallest documents, cuts are fine.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

#: A block is one size class (power of two) of one old shard, split by a hash into so many.
SPLITS = 64


def min_cost_flow(supply: list[int], capacity: list[int], cost=lambda old, new: int(old != new)) -> dict[tuple[int, int], int]:
    """Bytes to send from each old to each new shard at the least total cost: successive shortest paths.

    Sum of capacity must cover the sum of supply. The graph has one node a shard and one edge an (old, new) pair.
    """
    n, m = len(supply), len(capacity)
    flow: dict[tuple[int, int], int] = {}
    left, room = list(supply), list(capacity)
    for i in range(min(n, m)):  # what can stay costs nothing: no shorter path exists
        if cost(i, i) == 0 and (stay := min(left[i], room[i])):
            flow[i, i] = stay
            left[i] -= stay
            room[i] -= stay
    potential = [0] * (n + m)
    for i in range(n):
        while left[i] > 0:
            # Dijkstra over the residual graph from old shard i; nodes 0..n-1 are old, n.. are new
            dist: dict[int, int] = {i: 0}
            back: dict[int, int] = {}
            heap, done = [(0, i)], set()
            while heap:
                d, u = heapq.heappop(heap)
                if u in done:
                    continue
                done.add(u)
                ways = [(n + j, cost(u, j)) for j in range(m)] if u < n else [(o, -cost(o, u - n)) for o in range(n) if flow.get((o, u - n), 0) > 0]
                for v, c in ways:
                    new = d + c + potential[u] - potential[v]
                    if v not in dist or new < dist[v]:
                        dist[v], back[v] = new, u
                        heapq.heappush(heap, (new, v))
            ends = [(dist[n + j] + potential[n + j] - potential[i], j) for j in range(m) if room[j] > 0 and n + j in dist]
            if not ends:
                raise ValueError("capacity is smaller than supply")
            end = n + min(ends)[1]
            path, v = [], end
            while v != i:
                path.append((back[v], v))
                v = back[v]
            push = min([left[i], room[end - n], *(flow[v, u - n] for u, v in path if u >= n)])
            for u, v in path:
                if u < n:
                    flow[u, v - n] = flow.get((u, v - n), 0) + push
                else:
                    flow[v, u - n] -= push
            left[i] -= push
            room[end - n] -= push
            top = max(dist.values())
            potential = [p + min(dist.get(k, top), top) for k, p in enumerate(potential)]
    return {k: v for k, v in flow.items() if v}


def even_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (i < total % shards) for i in range(shards)]


def _sized(docs: DataFrame, old_shard: Column | str, old_shards: int) -> DataFrame:
    """All columns of docs by position (c0, c1, ...), and id, size, text_crc32, old_shard."""
    own, of = C.by_position(docs if isinstance(old_shard, str) else docs.select("*", old_shard.cast("long")))
    old = F.col(C.column_of(of, old_shard)).cast("long") if isinstance(old_shard, str) else F.col(own.columns[-1])
    text = F.col(C.column_of(of, "text"))
    return own.withColumns({
        "id": F.col(C.column_of(of, "doc_id")), "size": C.utf8_length(text) + 8, "text_crc32": F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")),
        "old_shard": F.coalesce(F.pmod(old, F.lit(old_shards)).cast("int"), F.lit(0)),
    })


def reshard(docs: DataFrame, old_shard: Column | str, shards: int = 24, old_shards: int = 16) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, size, text_crc32, old_shard, shard, slot, moved; one row for each row.

    old_shard: an expression over docs, or the name of a column; taken modulo old_shards, null counts as shard 0. size is
    the UTF-8 bytes of the text (null: none) plus 8. Shards get near equal bytes with the fewest bytes moved; a document of
    any length stays whole. slot counts from 0 without gaps in each shard. Repeated rows and rows with a null doc_id are
    placed one by one; an empty table gives no rows; extra columns are ignored, whatever their names. More old than new
    shards empties the surplus.
    """
    rows = _sized(docs, old_shard, old_shards).select(F.col("id").alias("doc_id"), "size", "text_crc32", "old_shard")
    tie = F.xxhash64("doc_id", "text_crc32")
    block = (62 - F.floor(F.log2("size"))) * SPLITS + F.pmod(tie, F.lit(SPLITS))
    rows = C.table(rows.withColumn("block", block.cast("long")).withColumn("tie", tie), "sizes")
    sums = {r[0]: r[1] for r in rows.groupBy("old_shard").agg(F.sum("size")).collect()}  # at most old_shards rows
    supply = [sums.get(i, 0) for i in range(old_shards)]
    flow = min_cost_flow(supply, even_capacities(sum(supply), shards))
    cuts, at = [], dict.fromkeys(range(old_shards), 0)
    for (i, j), size in sorted(flow.items(), key=lambda x: (x[0][0], x[0][0] != x[0][1], x[0][1])):  # what stays comes first
        cuts.append((i, at[i], at[i] + size, j))
        at[i] += size
    spark = docs.sparkSession
    pieces = spark.createDataFrame(cuts, "old_shard int, lo long, hi long, shard int")  # old + new shards - 1 rows at most
    placed = C.running_total(rows, ["old_shard"], "block", ["tie", "doc_id"], "size", "start")
    middle = F.col("start") + F.floor(F.col("size") / 2)
    placed = placed.join(F.broadcast(pieces.withColumnRenamed("old_shard", "o")), (F.col("old_shard") == F.col("o")) & (middle >= F.col("lo")) & (middle < F.col("hi"))).drop("o", "lo", "hi", "start")
    placed = C.table(placed.withColumn("group", F.col("old_shard") * (64 * SPLITS) + F.col("block")), "placed")
    # slots: rows before a group in its shard, from counts by (shard, group); then a row number inside the group
    counts = placed.groupBy("shard", "group").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("shard", "group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard", "group").orderBy("tie", "doc_id")
    out = placed.withColumn("inside", F.row_number().over(inside) - 1).join(C.broadcast_if_small(C.table(base, "base")), ["shard", "group"])
    C.drop(rows)
    return out.select("doc_id", "size", "text_crc32", "old_shard", "shard", (F.col("base") + F.col("inside")).alias("slot"), (F.col("shard") != F.col("old_shard")).alias("moved"))


def rewrite(docs: DataFrame, old_shard: Column | str, placement: DataFrame, path: str, old_shards: int = 16) -> None:
    """Writes the rows of every shard that gains or loses a row under path/shard=N and empties what nothing is left in.

    placement: reshard()'s rows for the same docs, old_shard and old_shards. Files of shards that nothing enters or leaves
    stay untouched; docs may be read from path itself. Rows are told apart by old shard, doc_id (null or not), text and,
    where they repeat in all of these, by number, so that each is written once. New files are complete before any folder
    is replaced; if the job dies in between, run it again on the docs as they were, from a copy.
    """
    spark = docs.sparkSession
    changed = [r[0] for r in placement.where("moved").select(F.explode(F.array("shard", "old_shard")).alias("s")).distinct().collect()]  # at most the number of shards
    if not changed:
        return
    key = ["old_shard", "id", "text_crc32", "size"]
    nth = lambda by: F.row_number().over(Window.partitionBy(*key).orderBy(*by))
    rows = _sized(docs, old_shard, old_shards).where(F.col("old_shard").isin(changed))
    places = placement.withColumnRenamed("doc_id", "id").where(F.col("old_shard").isin(changed)).select(*key, "shard", "slot")
    rows, places = rows.withColumn("nth", nth([F.lit(0)])), places.withColumn("nth", nth(["shard", "slot"])).toDF(*[f"p_{k}" for k in key], "shard", "slot", "p_nth")
    same = F.lit(True)
    for k in (*key, "nth"):
        same = same & F.col(k).eqNullSafe(F.col(f"p_{k}"))
    kept = rows.join(places, same).repartition("shard", F.floor(F.col("slot") / 1_000_000)).sortWithinPartitions("shard", "slot")
    names = [c for c in docs.columns if c.lower() != "shard"]
    own = [f"c{i}" for i, c in enumerate(docs.columns) if c.lower() != "shard"]
    kept.select(*own, "shard").toDF(*names, "shard").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    left = {r[0] for r in placement.select("shard").distinct().collect()}
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for s in set(changed) - left:
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root, f"shard={s}"), True)
