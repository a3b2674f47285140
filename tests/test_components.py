"""Strongly connected components: random graphs against plain reachability, long rings and ways in few rounds."""

import random

import pytest

from corpusmill.operators import graph as G


def plain(edges):
    nodes = sorted({x for e in edges for x in e})
    out = {n: {b for a, b in edges if a == n} for n in nodes}
    reach = {}
    for n in nodes:
        seen, todo = set(), [n]
        while todo:
            for x in out[todo.pop()] - seen:
                seen.add(x), todo.append(x)
        reach[n] = seen
    return sorted((n, max(group)) for n in nodes if len(group := {m for m in nodes if m == n or (m in reach[n] and n in reach[m])}) > 1)


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs_with_chains(spark, seed):
    rnd = random.Random(seed)
    edges = {(rnd.randrange(30), rnd.randrange(30)) for _ in range(rnd.randrange(20, 45))}
    for k in range(6):  # ways and rings through, into and out of the rest
        ends = rnd.choice([(rnd.randrange(30), rnd.randrange(30)), (k, k), (500 + k, rnd.randrange(30)), (rnd.randrange(30), 600 + k)])
        way = [ends[0], *range(100 + 20 * k, 100 + 20 * k + rnd.randrange(1, 12)), ends[1]]
        edges |= set(zip(way, way[1:]))
    edges |= {(900, 901), (901, 900), (910, 911), (911, 912), (912, 910), (7, 7), (920, 920)}
    got = G.scc(spark.createDataFrame(sorted(edges), "src long, dst long")).collect()
    assert sorted(map(tuple, got)) == plain(edges)


def test_long_rings_and_ways_settle_in_few_rounds(spark, monkeypatch):
    n, tables = 10_000, []
    monkeypatch.setattr(G, "_settle", lambda df, real=G._settle: tables.append(1) or real(df))
    ring = spark.range(n).selectExpr("id AS src", f"(id + 1) % {n} AS dst")
    way = spark.range(n, 2 * n).selectExpr("id AS src", "id + 1 AS dst").union(spark.createDataFrame([(3, n)], "src long, dst long"))
    loop = spark.range(3 * n, 3 * n + 500).selectExpr("id AS src", "id + 1 AS dst").union(spark.createDataFrame([(3 * n + 500, 3 * n), (3 * n, 3 * n + 250)], "src long, dst long"))
    got = G.scc(ring.union(way).union(loop)).groupBy("component").count().collect()
    assert {(r.component, r["count"]) for r in got} == {(n - 1, n), (3 * n + 500, 501)}
    assert len(tables) < 70


def ways(edges, pairs):
    """Breadth first, one pair at a time: the way read backwards over smallest parents."""
    out = []
    for k, a, b in pairs:
        level, at = {a: 0}, {a}
        while at and b not in level:
            at = {y for s, y in edges if s in at} - set(level)
            level |= dict.fromkeys(at, max(level.values()) + 1)
        if b not in level:
            out.append((k, None, None, None))
            continue
        way = [b]
        while level[way[-1]]:
            way.append(min((s for s, y in edges if y == way[-1] and level.get(s) == level[way[-1]] - 1), key=str))
        out += [(k, level[b], i, str(n)) for i, n in enumerate(reversed(way))]
    return sorted(out, key=str)


def test_ways_from_both_ends(spark):
    rnd = random.Random(1)
    edges = {(rnd.randrange(40), rnd.randrange(40)) for _ in range(75)} | {(100 + i, 101 + i) for i in range(9)}
    pairs = [(k, rnd.randrange(40), rnd.randrange(40)) for k in range(60)] + [(90, 100, 109), (91, 100, 108), (92, 109, 100), (93, 5, 5), (94, 777, 777), (95, 0, 777)]
    got = G.shortest_paths(spark.createDataFrame(sorted(edges), "src long, dst long"), spark.createDataFrame(pairs, "pair_id int, src long, dst long"))
    assert sorted(map(tuple, got.collect()), key=str) == ways(edges, pairs)


def test_a_long_way_takes_half_as_many_rounds(spark, monkeypatch):
    rounds = []
    real = G._settle
    monkeypatch.setattr(G, "_settle", lambda df: rounds.append("distance" in df.columns) or real(df))
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)], "src long, dst long")
    got = G.shortest_paths(edges, spark.createDataFrame([(1, 0, 30), (2, 30, 0)], "pair_id int, src long, dst long")).collect()
    assert sorted(r.step for r in got if r.pair_id == 1) == list(range(31)) and [r.distance for r in got if r.pair_id == 2] == [None]
    assert sum(rounds) == 17  # the ends, fifteen rounds, and one that finds nothing open
    none = spark.createDataFrame([], "pair_id int, src long, dst long")
    assert G.shortest_paths(edges, none).count() == 0 and G.shortest_paths(edges.limit(0), none).count() == 0


def test_many_short_rings_take_no_more_rounds_than_a_few(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(G, "_settle", lambda df, real=G._settle: tables.append(1) or real(df))
    rounds = []
    for n in (3, 3000):
        tables.clear()
        rings = spark.range(n * 10).selectExpr("id AS src", "id - id % 10 + (id + 1) % 10 AS dst")
        got = G.scc(rings)
        assert got.count() == n * 10 and got.where("component <> node - node % 10 + 9").isEmpty()
        rounds.append(len(tables))
    assert rounds[0] == rounds[1]


def test_rounds_of_shortest_paths_do_not_move_the_edges(spark, monkeypatch):
    plans = []
    real = G._settle
    monkeypatch.setattr(G, "_settle", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]) or real(df))
    before = {t.name for t in spark.catalog.listTables()}
    edges = spark.createDataFrame([(i, i + 1) for i in range(4)] * 2, "src long, dst long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = G.shortest_paths(edges, spark.createDataFrame([(1, 0, 4)], "pair_id int, src long, dst long")).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted((r.step, r.node) for r in got) == [(i, str(i)) for i in range(5)]
    rounds = [p for p in plans if "cm_" in p and "Join" in p]
    # an exchange is for what comes to the buckets; the scan of the edges has none of its own
    lines = [p.split("\n") for p in rounds]
    scans = [(x, k) for x in lines for k, line in enumerate(x) if "Scan parquet" in line and "next" in line]
    assert scans and all("Exchange" not in "".join(x[max(0, k - 3):k]) for x, k in scans)
    assert {t.name for t in spark.catalog.listTables()} == before


def test_lone_rings_are_their_own_cycles_without_a_search(spark, monkeypatch):
    rings = [[7, 3, 9, 5], [20, 30], [41, 40, 43, 42, 45, 44, 46], [60, 61, 62], [70, 71]]
    edges = [(a, b) for ring in rings for a, b in zip(ring, ring[1:] + ring[:1])] * 2 + [(7, 7), (80, 80), (90, 91), (91, 92), (61, 95), (71, 70)]
    searched = []
    real = G.shortest_paths
    monkeypatch.setattr(G, "shortest_paths", lambda e, pairs: searched.extend(tuple(r) for r in e.distinct().collect()) or real(e, pairs))
    got = G.cycles(spark.createDataFrame(edges, "src long, dst long"))
    assert dict(got.dtypes) == {"cycle_id": "string", "step": "int", "node": "string"}
    want = [("7", 0, "7"), ("7", 1, "7"), ("80", 0, "80"), ("80", 1, "80")]
    for ring in rings:
        k = ring.index(min(ring))
        turned = ring[k:] + ring[:k]
        want += [(str(turned[0]), i, str(n)) for i, n in enumerate(turned + turned[:1])]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert sorted(searched) == [(60, 61), (61, 62), (62, 60)]  # the one that another edge leaves


def test_a_round_of_pointers_moves_narrow_rows(spark, monkeypatch):
    plans, real = [], G._settle
    monkeypatch.setattr(G, "_settle", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df))
    ring = spark.createDataFrame([(i, (i + 1) % 9) for i in range(9)], "src long, dst long")
    assert G.scc(ring).count() == 9
    rounds = [p for p in plans if "role" in p]
    assert len(rounds) == 6 and all("Join" not in p for p in plans) and all("Repartition" in p for p in rounds)


def test_everything_within_reach(spark, monkeypatch):
    rnd = random.Random(5)
    edges = [(rnd.randrange(25), rnd.randrange(25)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(6)] + [(106, 103), (3, 3), (200, 201), (201, 200), (4, None), (5, None), (6, None), (None, 4)]
    seeds = [0, 3, 7, 12, 100, 200, 777]
    plans, real = [], G._settle
    monkeypatch.setattr(G, "_settle", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df))

    def plain(start, k):
        level, todo = {start: 0}, [start]
        for at in todo:
            for y in sorted({y for x, y in edges if x == at and y is not None}):
                if y not in level and level[at] < k:
                    level[y] = level[at] + 1
                    todo.append(y)
        return level

    frame = lambda e: spark.createDataFrame(e * 2, "src long, dst long")
    for k in (None, 2):
        got = G.k_hop(frame(edges), spark.createDataFrame([(s,) for s in seeds], "node long"), k).where("node IS NOT NULL").collect()
        assert sorted(map(tuple, got)) == sorted((s, n, d) for s in seeds for n, d in plain(s, 99 if k is None else k).items())
    assert any("LeftAnti" in p for p in plans)
    plans.clear()
    chain = [(i, i + 1) for i in range(5)]  # one way to each node: rounds compare nothing with what was seen, and make no edges anew
    got = G.k_hop(frame(chain), spark.createDataFrame([(0,), (2,)], "node long")).collect()
    assert sorted(map(tuple, got)) == [(s, n, n - s) for s in (0, 2) for n in range(s, 6)]
    assert plans and not any("LeftAnti" in p for p in plans) and all("cm_" in p for p in plans if "Join" in p)
