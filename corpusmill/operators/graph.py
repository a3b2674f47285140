"""Graphs as two tables: building, neighbours, paths, components, cycles, projections."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from .stored import stored as _settle
from .stored import shared_folder, together


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports (import_id, from_path, specifier) -> target: the first candidate of a relative specifier that is a file."""
    rel = imports.where(F.col("specifier").rlike(r"^\.\.?/")).select("import_id", F.posexplode(S.module_candidates(S.resolve_relative(F.col("from_path"), F.col("specifier")))).alias("pos", "path"))
    found = rel.join(files.select("path").distinct(), "path").groupBy("import_id").agg(F.min_by("path", "pos").alias("target"))
    return imports.join(found, "import_id", "left")


def link_definitions(imports: DataFrame, exports: DataFrame) -> DataFrame:
    """imports (import_id, target, name, imported_name) and exports (path, name, modifiers, symbol_id) -> import_id, symbol_id.

    A default import meets exports that are marked, or named, default; any other meets its imported name.
    """
    wanted = F.coalesce("imported_name", "name")
    i = imports.where("target is not null").select("import_id", F.col("target").alias("path"), wanted.alias("w"))
    e = exports.select("path", "name", "modifiers", "symbol_id")
    named = i.where("w <> 'default'").join(e.select("path", F.col("name").alias("w"), "symbol_id"), ["path", "w"])
    is_default = (F.col("name") == "default") | F.array_contains(F.coalesce("modifiers", F.expr("cast(array() as array<string>)")), "default")
    default = i.where("w = 'default'").join(e.where(is_default).select("path", "symbol_id"), "path")
    return named.select("import_id", "symbol_id").unionByName(default.select("import_id", "symbol_id"))


#: Lines of a file in a block; a reference meets only the spans that reach into its block.
LINE_BLOCK = 256


def spans_around(refs: DataFrame, spans: DataFrame) -> DataFrame:
    """refs (ref_id, path, line) and spans (path, lo, hi, ...) -> ref_id and the columns of each span that holds the line.

    Spans are dealt to the blocks of lines that they reach into, so a long file's references are not tried against all of
    its spans, and no file is one group.
    """
    block = lambda c: F.floor(F.col(c) / LINE_BLOCK)
    dealt = spans.withColumn("block", F.explode(F.sequence(block("lo"), block("hi"))))
    return refs.select("ref_id", "path", "line", block("line").alias("block")).join(dealt, ["path", "block"]).where("line between lo and hi").drop("block", "path", "line")


#: Rows of symbols that a part of a graph's build holds at most, about; beyond the usual number of parts their number follows the rows, so none outgrows a task.
PART_ROWS = 200_000


def _parts(rows: DataFrame) -> int | None:
    """How many parts so many rows ask for; None where the usual number will do."""
    n = -(-rows.count() // PART_ROWS)
    return n if n > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def _moved(df: DataFrame, n: int | None, *keys: str) -> DataFrame:
    """df in n parts by keys, which a join or grouping by them takes as they are."""
    return df.repartition(n, *keys) if n else df


def _located(refs: DataFrame, symbols: DataFrame, owner: bool = False, n: int | None = None) -> DataFrame:
    """refs (path, line, ...) with n, how many rows are equal to it, parent_id, the first container whose lines hold it, and, if asked for,
    owner: the innermost symbol that does.

    References move once, to their file's block of lines, where the spans come to them; equal ones and their spans are put together there.
    """
    block = lambda c: F.floor(F.col(c) / LINE_BLOCK)
    box = F.col("kind").isin("class", "interface", "enum")
    spans = symbols if owner else symbols.where(box)
    spans = spans.select(F.col("path").alias("__path"), "id", "start_line", "start_col", "end_line", box.alias("box"), F.explode(F.sequence(block("start_line"), block("end_line"))).alias("__block"))
    of = refs.columns
    here = refs.withColumn("block", block("line")).repartition(*([n] if n else []), "path", "block").groupBy("path", "block", *[c for c in of if c != "path"]).agg(F.count("*").alias("n"))
    met = here.join(spans, (F.col("path") == F.col("__path")) & (F.col("block") == F.col("__block")) & F.col("line").between(F.col("start_line"), F.col("end_line")), "left")
    found = [F.min_by(F.when(F.col("box"), F.col("id")), F.when(F.col("box"), F.struct("start_line", "start_col", "id"))).alias("parent_id")]
    if owner:
        found.append(F.min_by("id", F.struct(F.col("end_line") - F.col("start_line"), "id")).alias("owner"))
    return met.groupBy("path", "block", *[c for c in of if c != "path"], "n").agg(*found).drop("block")


def _with_targets(located: DataFrame, symbols: DataFrame, n: int | None = None) -> DataFrame:
    """located references of a name with target: their container's first member of that name, else the file's first module-level symbol."""
    order = F.struct("start_line", "start_col", "id")
    members = _moved(symbols.where("parent_id is not null"), n, "parent_id", "name").groupBy("parent_id", "name").agg(F.min_by("id", order).alias("member"))
    tops = _moved(symbols.where("parent_id is null"), n, "path", "name").groupBy("path", "name").agg(F.min_by("id", order).alias("top"))
    j = _moved(located, n, "parent_id", "name").join(members, ["parent_id", "name"], "left").drop("parent_id")
    j = _moved(j, n, "path", "name").join(tops, ["path", "name"], "left")
    return j.withColumn("target", F.coalesce("member", "top")).drop("member", "top").where("target is not null")


def resolve_references(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """refs (ref_id, path, name, line), symbols (id, path, name, kind, parent_id, start_line, end_line, start_col) -> ref_id, target.

    The first container whose lines span the reference is asked for a member of that name (its first), then the
    file's module-level symbols; unresolved references are dropped.
    """
    symbols = _settle(symbols.select("id", "path", "name", "kind", "parent_id", "start_line", "end_line", "start_col"))
    n = _parts(symbols)
    found = _with_targets(_located(refs.select("ref_id", "path", "name", "line"), symbols, n=n), symbols, n)
    return found.select("ref_id", "target", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).select("ref_id", "target")


def first_symbol_wins(symbols: DataFrame) -> DataFrame:
    w = Window.partitionBy("path", "name").orderBy("start_line", "start_col", "id")
    return symbols.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def symbols_with_files(symbols: DataFrame, files: DataFrame) -> DataFrame:
    return symbols.join(files.select("path", "language"), "path")


def label_edges(edges: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """edges with src_label and dst_label: the path of a file node, name (path) of a symbol node, else the id."""
    labels = files.select(S.file_node_id(F.col("path")).alias("node"), F.col("path").alias("label")).unionByName(symbols.select(S.symbol_node_id(F.col("id")).alias("node"), F.concat("name", F.lit(" ("), "path", F.lit(")")).alias("label")))
    out = edges
    for end in ("src", "dst"):
        out = out.join(labels.select(F.col("node").alias(end), F.col("label").alias(f"__{end}")), end, "left")
    return out.select("src", "dst", "kind", F.coalesce("__src", "src").alias("src_label"), F.coalesce("__dst", "dst").alias("dst_label"))


def build_graph(symbols: DataFrame, refs: DataFrame, imports: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (id, kind) and edges (src, dst, kind), each once: contains, imports, exports and resolved references.

    A reference starts at the innermost symbol whose lines hold it, else at the file.
    """
    sym, file = lambda c: S.symbol_node_id(F.col(c)), lambda c: S.file_node_id(F.col(c))
    symbols = _settle(symbols.select("id", "path", "name", "kind", "parent_id", "start_line", "end_line", "start_col", "exported"))  # read six times
    nodes = files.select(file("path").alias("id"), F.lit("file").alias("kind")).unionByName(symbols.select(sym("id").alias("id"), "kind"))
    contains = symbols.select(F.when(F.col("parent_id").isNull(), file("path")).otherwise(sym("parent_id")).alias("src"), sym("id").alias("dst"), F.lit("contains").alias("kind"))
    exports = symbols.where("exported").select(file("path").alias("src"), sym("id").alias("dst"), F.lit("exports").alias("kind"))
    targets = resolve_imports(imports, files).where("target is not null")
    links = targets.select(file("from_path").alias("src"), file("target").alias("dst"), F.lit("imports").alias("kind"))
    # references that differ in nothing but their ids give one edge
    n = _parts(symbols)
    located = _located(refs.select("path", "name", "line", "kind"), symbols, owner=True, n=n).select("path", "name", "kind", "parent_id", "owner")
    used = _with_targets(located, symbols, n).select(F.coalesce(sym("owner"), file("path")).alias("src"), sym("target").alias("dst"), F.col("kind"))
    edges = _moved(contains.unionByName(exports).unionByName(links).unionByName(used), n, "src", "dst", "kind").distinct()
    return nodes.dropDuplicates(["id"]), edges


def neighbors(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, neighbor) in either direction, each once, for seeds (node)."""
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("neighbor")).unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("neighbor")))
    return both.join(seeds.select("node").distinct(), "node", "left_semi").distinct()


def dependencies(edges: DataFrame, requests: DataFrame, direction: str = "out", kinds: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """requests (request_id, node) -> request_id, other, kind, direction; up to limit of each request, by kind and node."""
    e = edges.where(F.col("kind").isin(kinds)) if kinds else edges
    out = requests.join(e.withColumnRenamed("src", "node"), "node").select("request_id", F.col("dst").alias("other"), "kind", F.lit("out").alias("direction"))
    into = requests.join(e.withColumnRenamed("dst", "node"), "node").select("request_id", F.col("src").alias("other"), "kind", F.lit("in").alias("direction"))
    found = {"out": out, "in": into, "both": out.unionByName(into)}[direction].distinct()
    if limit is None:
        return found
    w = Window.partitionBy("request_id").orderBy("kind", "other", "direction")
    return found.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= limit).drop("__n")


def k_hop(edges: DataFrame, seeds: DataFrame, k: int | None = None, max_rounds: int = 10_000) -> DataFrame:
    """seeds (node) -> seed, node, distance for everything within k edges (any number where k is None), the seed at 0.

    Edges move once, to their node's bucket. A node that one edge enters is reached from a seed once, by way of the node before it, so only nodes that several
    edges enter are compared with what was seen.
    """
    spark, e = edges.sparkSession, edges.select(F.col("src").alias("node"), F.col("dst").alias("next"))
    into = Window.partitionBy("next")
    both_known = F.col("node").isNotNull() & F.col("next").isNotNull()
    e, name = _bucketed(e.where(both_known).withColumn("many", F.min("node").over(into) < F.max("node").over(into)).unionByName(e.where("node IS NOT NULL AND next IS NULL").withColumn("many", F.lit(True))), ["node"])
    some = not e.where("many").isEmpty()
    frontier, d = _settle(seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("distance"), F.lit(False).alias("many")).distinct()), 0
    found = [frontier]
    while d < (max_rounds if k is None else k):
        d += 1
        step = frontier.join(e, "node").select("seed", F.col("next").alias("node"), F.lit(d).alias("distance"), e["many"]).where("NOT seed <=> node")
        if some:
            step = _settle(step)
            step = step.where("NOT many").unionByName(step.where("many").distinct().join(together(found).where("many").select("seed", "node"), ["seed", "node"], "left_anti"))
        frontier = _settle(step)
        if frontier.isEmpty():
            break
        found.append(frontier)
    else:
        if k is None:
            raise RuntimeError(f"not settled after {max_rounds} rounds")
    spark.sql(f"DROP TABLE {name}")  # what follows reads stored tables only
    return together(found).select("seed", "node", "distance")


def transitive_closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    return k_hop(edges, seeds)


def _bucketed(edges: DataFrame, keys: list[str]) -> tuple[DataFrame, str]:
    """Distinct edges as a table bucketed by keys, and its name.

    It moves once; each round's nodes go to its buckets. The catalog entry is to be dropped in the end, the files are the shared folder's.
    """
    spark, name = edges.sparkSession, "cm_" + uuid.uuid4().hex
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges.repartition(n, *keys).distinct().write.bucketBy(n, *keys).sortBy(*keys).option("path", f"{shared_folder(spark)}/{name}").format("parquet").saveAsTable(name)
    return spark.table(name), name


def _both_ways(edges: DataFrame) -> tuple[DataFrame, str]:
    """Edges from either end, bucketed: side (0 from src, 1 from dst), node, next, each once; and the table's name."""
    both = edges.select(F.lit(0).alias("side"), F.col("src").alias("node"), F.col("dst").alias("next")).unionByName(edges.select(F.lit(1).alias("side"), F.col("dst").alias("node"), F.col("src").alias("next")))
    return _bucketed(both, ["side", "node"])


def shortest_paths(edges: DataFrame, pairs: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """pairs (pair_id, src, dst) -> pair_id, distance (null where there is no way), step, node: the nodes of one shortest way.

    Breadth first from both ends of all pairs at once: each round takes one step on either side, so a way of n edges takes n / 2 rounds, and a
    pair whose sides have met, or one of whose sides has ended, goes no further. Read backwards from dst, the way takes the smallest of several parents.
    """
    both, name = _both_ways(edges)
    end = lambda side, c: pairs.select("pair_id", F.lit(side).alias("side"), F.col(c).alias("node"), F.lit(0).alias("distance"))
    frontier, d = _settle(end(0, "src").unionByName(end(1, "dst"))), 0
    found, seen = [frontier], frontier
    while not frontier.isEmpty():
        if d == max_rounds:
            raise RuntimeError(f"not settled after {max_rounds} rounds")
        d += 1
        # the sides meet in a node of this round on both, or of this one and the one before
        near = together(found[-2:])
        one, other = (near.where(F.col("side") == k).select("pair_id", "node") for k in (0, 1))
        alive = frontier.groupBy("pair_id").agg(F.count_distinct("side").alias("sides")).where("sides = 2").select("pair_id")
        going = alive.join(one.join(other, ["pair_id", "node"]).select("pair_id"), "pair_id", "left_anti")
        step = frontier.join(going, "pair_id", "left_semi").join(both, ["side", "node"]).select("pair_id", "side", F.col("next").alias("node")).distinct()
        frontier = _settle(step.join(seen, ["pair_id", "side", "node"], "left_anti").withColumn("distance", F.lit(d)))
        found.append(frontier)
        seen = together(found)
    fore = seen.where("side = 0").select("pair_id", "node", F.col("distance").alias("before"))
    back = seen.where("side = 1").select("pair_id", "node", F.col("distance").alias("left"))
    met = _settle(fore.join(back, ["pair_id", "node"]))
    best = met.groupBy("pair_id").agg(F.min(F.col("before") + F.col("left")).alias("distance"))
    middle = F.expr("before + left = distance AND before - left IN (0, 1)")
    # down from all nodes in the middle, each node with the way that reads backwards over smallest parents: at dst one is left
    text = F.col("node").cast("string")
    ways = [_settle(met.join(best, "pair_id").where(middle).select("pair_id", F.lit(0).alias("side"), "node", "before", "left", F.array(text).alias("way")))]
    for _ in range(ways[0].agg(F.max("left")).first()[0] or 0):
        step = ways[-1].where("left > 0").join(both, ["side", "node"]).groupBy("pair_id", "side", F.col("next").alias("node"), "before", (F.col("left") - 1).alias("left")).agg(F.min_by("way", text).alias("way"))
        ways.append(_settle(step.join(back, ["pair_id", "node", "left"], "left_semi").select("pair_id", "side", "node", "before", "left", F.concat("way", F.array(text)).alias("way"))))
    ends = together(ways).where("left = 0").select("pair_id", "before", "way")
    # up from the node in the middle to src
    node = F.col("way")[0].cast(both.schema["node"].dataType)
    whole = [_settle(ends.select("pair_id", F.lit(1).alias("side"), F.col("before").alias("step"), node.alias("node")))]
    fore = fore.withColumnsRenamed({"node": "parent", "before": "step"})
    for _ in range(whole[0].agg(F.max("step")).first()[0] or 0):
        up = whole[-1].where("step > 0").join(both, ["side", "node"]).select("pair_id", "side", (F.col("step") - 1).alias("step"), F.col("next").alias("parent")).join(fore, ["pair_id", "parent", "step"], "left_semi")
        whole.append(_settle(up.groupBy("pair_id", "side", "step").agg(F.min_by("parent", F.col("parent").cast("string")).alias("node"))))
    both.sparkSession.sql(f"DROP TABLE {name}")  # what follows reads stored tables only
    lower = ends.select("pair_id", F.posexplode(F.expr("slice(way, 2, size(way))")).alias("at", "node"), "before").select("pair_id", (F.col("before") + F.col("at") + 1).alias("step"), "node")
    way = together(whole).select("pair_id", "step", text.alias("node")).unionByName(lower)
    return pairs.select("pair_id").join(best, "pair_id", "left").join(way, "pair_id", "left").select("pair_id", "distance", "step", "node")


def _compressed(e: DataFrame) -> tuple[DataFrame | None, DataFrame | None, DataFrame | None]:
    """Edges without their chains and dead ends, or None: nodes of one edge in and one out are passed over, whole runs of them at once; nodes
    without way in or out go. Edges may be repeated.

    Also what was passed over (node, before, after: the ends of its run), and the nodes of rings that are nothing but chain (node, least:
    the ring's smallest node, step: how far the node lies behind that, size). Pointers double in each round, so a run of n nodes takes
    log2(n) of them, and a node that knows its run takes part in no more. In a ring, a node sees the smallest of the nodes ahead; where the stretch
    behind those has the same smallest, the two stretches have gone round the ring, and how far that node lies ahead in both tells the ring's size. The
    next round the whole ring knows, so such a node answers for one round yet and leaves.
    """
    nothing = F.lit(None).cast(e.schema["src"].dataType)
    both = e.select(F.col("src").alias("node"), F.col("dst").alias("after"), nothing.alias("before")).unionByName(e.select(F.col("dst").alias("node"), nothing.alias("after"), F.col("src").alias("before")))
    near = both.repartition("node").groupBy("node").agg(*[f(c).alias(f"{n}_{c}") for c in ("before", "after") for n, f in (("low", F.min), ("high", F.max))]).where("low_before is not null and low_after is not null")
    near = _settle(near.select("node", F.col("low_before").alias("before"), F.col("low_after").alias("after"), F.expr("low_before = high_before and low_after = high_after").alias("chain")))
    live = _settle(near.where("not chain").select("node"))
    start = near.where("chain").select(
        "node", "before", "after", F.col("node").alias("least"), F.lit(0).cast("long").alias("ahead"), F.lit(None).cast("long").alias("size"), F.lit(True).alias("less"), F.lit(True).alias("more")
    )
    tables, going, stretch = [], start, 1
    while not going.isEmpty():
        # each tells the node at its one end what lies at its other; pointers between chain nodes are mutual, and what others are told in the first round is lost
        own = F.struct("node", F.lit(0).alias("role"), F.col("before").alias("far"), F.col("after").alias("next"), "least", "ahead", F.col("size").isNotNull().alias("flag"))
        ahead = F.struct(F.col("after").alias("node"), F.lit(1).alias("role"), F.col("before").alias("far"), nothing.alias("next"), nothing.alias("least"), F.lit(None).cast("long").alias("ahead"), F.col("less").alias("flag"))
        behind = F.struct(F.col("before").alias("node"), F.lit(2).alias("role"), F.col("after").alias("far"), nothing.alias("next"), "least", "ahead", F.col("more").alias("flag"))
        told = going.select(F.explode(F.array(own, F.when(F.col("more"), ahead), F.when(F.col("less"), behind))).alias("m")).where("m is not null").select("m.*").repartition("node")
        of = lambda role, c, name: F.max(F.when(F.col("role") == role, F.col(c))).alias(name)
        heard = told.groupBy("node").agg(
            of(0, "far", "before"), of(0, "next", "after"), *[of(0, c, c) for c in ("least", "ahead")], of(0, "flag", "old"),
            of(1, "far", "before2"), of(1, "flag", "less"), of(2, "far", "after2"), of(2, "flag", "more"), *[of(2, c, f"{c}2") for c in ("least", "ahead")],
        ).where("not old")
        tables.append(_settle(heard.select(
            "node", F.coalesce("before2", "before").alias("before"), F.coalesce("after2", "after").alias("after"), F.least("least", "least2").alias("least"),
            F.when(F.col("least2") < F.col("least"), F.col("ahead2") + stretch).otherwise(F.col("ahead")).alias("ahead"), F.when(F.col("least2") == F.col("least"), F.col("ahead2") + stretch - F.col("ahead")).alias("size"),
            F.coalesce("less", F.lit(False)).alias("less"), F.coalesce("more", F.lit(False)).alias("more"),
        )))
        going, stretch = tables[-1].where("less or more"), 2 * stretch
    passed = rings = None
    if tables:
        known = together(tables)
        rings = known.where("size is not null").select("node", "least", F.expr("(size - ahead) % size").alias("step"), "size")
        passed = known.where("not less and not more").select("node", "before", "after")
    if live.isEmpty():
        return None, passed, rings
    left = e.select("src", "dst")
    if passed is not None:
        left = left.unionByName(passed.select(F.col("before").alias("src"), F.col("after").alias("dst")).where("src <> dst"))
    for end in ("src", "dst"):
        left = left.join(live.withColumnRenamed("node", end), end, "left_semi")
    return _settle(left.select("src", "dst").distinct()), passed, rings


def scc(edges: DataFrame, max_rounds: int = 1_000) -> DataFrame:
    """(node, component): strongly connected components with more than one node, named by their greatest node.

    Nodes without way in or out are trimmed and chains passed over until that no longer shrinks the graph by a tenth: trees and long ways and rings
    take a logarithm of their length in rounds. Then, round by round, each node takes the greatest name that reaches it;
    those that a name's own node can be reached from, inside the name, are its component and leave. In the end a node that was passed over
    belongs to the component of both ends of its run, where that is one.
    """
    rest, rings = _components(_settle(edges.select("src", "dst").where("src <> dst")), max_rounds)
    if rings is not None:
        rings = rings.select("node", F.max("node").over(Window.partitionBy("least")).alias("component"))
    found = [t for t in (rest, rings) if t is not None]
    return reduce(DataFrame.unionByName, found) if found else edges.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)


def _components(e: DataFrame, max_rounds: int = 1_000) -> tuple[DataFrame | None, DataFrame | None]:
    """scc() of stored edges without self-loops, in two parts, each None where there are none: node, component; and of _compressed() the rings that
    no other edge touches."""
    alone_rings, parts, passed_over, first = None, [], [], True
    for _ in range(max_rounds):
        while e is not None:
            n = e.count()
            e, passed, rings = _compressed(e)
            if passed is not None:
                passed_over.append(passed)
                if first:
                    alone_rings = rings
                else:
                    parts.append(rings.select("node", F.col("least").alias("color")))
            first = False
            if e is not None and e.count() > 0.9 * n:
                break
        if e is None or e.isEmpty():
            break
        color = _settle(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct().withColumn("color", F.col("node")))
        while True:
            sent = e.join(color.select(F.col("node").alias("src"), "color"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("color").alias("c"))
            new = _settle(color.join(sent, "node", "left").select("node", F.greatest("color", F.coalesce("c", "color")).alias("color"), (F.coalesce("c", "color") > F.col("color")).alias("moved")))
            moved = new.where("moved").isEmpty()
            color = new.select("node", "color")
            if moved:
                break
        # backwards from each name's own node, inside its colour
        inner = e.join(color.select(F.col("node").alias("src"), F.col("color").alias("a")), "src").join(color.select(F.col("node").alias("dst"), F.col("color").alias("b")), "dst").where("a = b").select("src", "dst", F.col("a").alias("color"))
        inner = _settle(inner)
        found = _settle(color.where("node = color"))
        front = found
        while True:
            step = front.select(F.col("node").alias("dst"), "color").join(inner, ["dst", "color"]).select(F.col("src").alias("node"), "color").distinct()
            front = _settle(step.join(found, "node", "left_anti"))
            if front.isEmpty():
                break
            found = _settle(found.unionByName(front))
        parts.append(found)
        gone = found.select("node")
        e = _settle(e.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti"))
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    known = _settle(reduce(DataFrame.unionByName, parts)) if parts else None
    for passed in reversed(passed_over):  # the last passed over first: its ends are settled
        ends = passed.withColumns({"of_before": F.col("before"), "of_after": F.col("after")})
        if known is not None:
            for end in ("before", "after"):
                ends = ends.drop(f"of_{end}").join(known.select(F.col("node").alias(end), F.col("color").alias(f"of_{end}")), end, "left").withColumn(f"of_{end}", F.coalesce(f"of_{end}", end))
        inside = _settle(ends.where("of_before = of_after").select("node", F.col("of_before").alias("color")))
        if inside.isEmpty():
            continue
        # an end that was alone so far has its own name now
        alone = inside.select(F.col("color").alias("node"), "color").distinct()
        if known is not None:
            alone = alone.join(known, "node", "left_anti")
            inside = known.unionByName(inside)
        known = _settle(inside.unionByName(alone))
    if known is None:
        return None, alone_rings
    named = known.groupBy("color").agg(F.max("node").alias("component"), F.count("*").alias("n")).where("n > 1").select("color", "component")
    return known.join(named, "color").select("node", "component"), alone_rings


def cycles(edges: DataFrame) -> DataFrame:
    """cycle_id, step, node: one shortest cycle through the smallest node of each component, closed, and every self-loop.

    A ring that no other edge touches is its own cycle, and its nodes know their places in it; only what else there is is searched.
    """
    edges = _settle(edges.select("src", "dst"))
    loops = edges.where("src = dst").select(F.col("src").cast("string").alias("cycle_id")).distinct()
    loops = loops.select("cycle_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("step"), F.col("cycle_id").alias("node"))
    comp, rings = _components(edges.where("src <> dst"))
    if rings is not None:
        at = F.when(F.col("step") == 0, F.array(F.lit(0), F.col("size").cast("int"))).otherwise(F.array(F.col("step").cast("int")))
        loops = loops.unionByName(rings.select(F.col("least").cast("string").alias("cycle_id"), F.explode(at).alias("step"), F.col("node").cast("string").alias("node")))
    if comp is None or (comp := _settle(comp)).isEmpty():
        return loops
    inner = edges.where("src <> dst").join(comp.select(F.col("node").alias("src"), F.col("component").alias("a")), "src").join(comp.select(F.col("node").alias("dst"), F.col("component").alias("b")), "dst").where("a = b").select("src", "dst")
    inner = _settle(inner.distinct())  # one edge given twice is no second first edge
    starts = comp.groupBy("component").agg(F.min("node").alias("start"))
    # a shortest cycle is a first edge and a shortest way back from its end; the smallest of the shortest is taken
    first = inner.join(starts, inner["src"] == starts["start"]).select(F.concat_ws(">", "src", "dst").alias("pair_id"), F.col("dst").alias("src"), F.col("start").alias("dst"))
    ways = _settle(shortest_paths(inner, first))
    best = ways.where("distance is not null").join(first.select("pair_id", F.col("dst").alias("start")), "pair_id").groupBy("start").agg(F.min_by("pair_id", F.struct("distance", "pair_id")).alias("pair_id"))
    steps = ways.join(best, "pair_id").select(F.col("start").cast("string").alias("cycle_id"), (F.col("step") + 1).alias("step"), "node")
    heads = best.select(F.col("start").cast("string").alias("cycle_id"), F.lit(0).alias("step"), F.col("start").cast("string").alias("node"))
    return steps.unionByName(heads).unionByName(loops)


def degree_stats(edges: DataFrame) -> DataFrame:
    """node, kind, n_out, n_in."""
    o = edges.groupBy(F.col("src").alias("node"), "kind").agg(F.count("*").alias("n_out"))
    i = edges.groupBy(F.col("dst").alias("node"), "kind").agg(F.count("*").alias("n_in"))
    return o.join(i, ["node", "kind"], "full_outer").na.fill(0, ["n_out", "n_in"])


def module_graph(edges: DataFrame, members: DataFrame) -> DataFrame:
    """edges (src, dst) and members (node, module) -> module_from, module_to, weight, without edges inside a module."""
    pairs = edges.groupBy("src", "dst").agg(F.count("*").alias("n"))
    a, b = members.select(F.col("node").alias("src"), F.col("module").alias("module_from")), members.select(F.col("node").alias("dst"), F.col("module").alias("module_to"))
    return pairs.join(a, "src").join(b, "dst").where("module_from <> module_to").groupBy("module_from", "module_to").agg(F.sum("n").alias("weight"))


def dead_files(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Files that no import edge enters."""
    entered = edges.where("kind = 'imports'").select(F.col("dst").alias("node")).distinct()
    return files.select("path", S.file_node_id(F.col("path")).alias("node")).join(entered, "node", "left_anti").select("path")


def duplicate_names(symbols: DataFrame) -> DataFrame:
    """Names that stand in several files: name, files, symbols.

    A name and a path are rarely met twice in a task, so they are not put together before they have moved, to small parts in a fixed number.
    """
    n = 4 * int(symbols.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = symbols.select("name", "path").repartition(n, "name", "path").groupBy("name", "path").agg(F.count("*").alias("n"))
    return each.groupBy("name").agg(F.count("path").alias("files"), F.sum("n").alias("symbols")).where("files > 1")


def duplicate_content(files: DataFrame) -> DataFrame:
    """path, hash, copies of files whose content several paths have; one shuffle by hash and a narrow join."""
    h = files.select("path", S.content_hash(F.col("content")).alias("hash"))
    many = h.groupBy("hash").agg(F.count("*").alias("copies")).where("copies > 1")
    return h.join(many, "hash")
