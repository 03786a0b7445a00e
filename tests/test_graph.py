from pyspark.sql import functions as F

from lodestone.operators import graph as G

UNIT = "repo string, node long, relpath string, symbol_name string, symbol_kind string, qualified_name string, route_path string, imports array<string>, calls array<string>, refs array<string>, inherits array<string>, handler_names array<string>"


def unit(n, path, name="", kind="", qualified="", calls=(), imports=(), handlers=()):
    return ("r", n, path, name, kind, qualified, "", list(imports), list(calls), [], [], list(handlers))


def test_resolution_prefers_qualified_then_same_file(spark):
    u = spark.createDataFrame([unit(1, "a.py", "f", "function", calls=["save"]), unit(2, "a.py", "save", "function"), unit(3, "b.py", "save", "function"), unit(4, "c.py", "other", "function", qualified="save")], UNIT)
    assert {(r.source, r.target, r.tier) for r in G.resolve(u, G.names_asked(u)).collect()} == {(1, 4, 1)}
    u = u.where("node <> 4")
    assert {(r.source, r.target, r.tier) for r in G.resolve(u, G.names_asked(u)).collect()} == {(1, 2, 2)}


def test_edges_weights_loops_and_imports(spark):
    u = spark.createDataFrame([unit(1, "a.py", "f", "function", calls=["f", "g", "g"], imports=["pkg.b"]), unit(2, "b.py", "g", "function"), unit(3, "pkg.py")], UNIT)
    got = {(r.source, r.target, r.label, r.weight) for r in G.edges(u).collect()}
    assert got == {(1, 2, "calls", 1.8), (1, 3, "imports", 1.4)}


EDGES = "repo string, source long, target long, label string, weight double"


def test_bfs_depth_parent_and_cycles(spark):
    e = spark.createDataFrame([("r", 1, 2, "calls", 1.0), ("r", 1, 3, "calls", 2.0), ("r", 2, 4, "calls", 1.0), ("r", 3, 4, "calls", 1.0), ("r", 4, 1, "calls", 1.0)], EDGES)
    s = spark.createDataFrame([(1, 1)], "start long, node long")
    assert {(r.node, r.depth, r.parent) for r in G.bounded_bfs(e, s, 3, 9).collect()} == {(1, 0, None), (2, 1, 1), (3, 1, 1), (4, 2, 2)}
    assert {r.node for r in G.bounded_bfs(e, s, 3, 1).collect()} == {1, 3, 4}


def test_pagerank_mass_is_one_and_converges(spark):
    e = spark.createDataFrame([("r", 1, 2, "calls", 1.0), ("r", 2, 3, "calls", 9.0), ("r", 1, 3, "calls", 0.001)], EDGES)
    t = spark.createDataFrame([("r", 1, 1.0)], "repo string, node long, share double")
    rank = G.pagerank(e, t, 60, tolerance=1e-7)
    assert abs(rank.agg(F.sum("rank")).collect()[0][0] - 1) < 1e-6


def test_empty_edges(spark):
    e = spark.createDataFrame([], EDGES)
    s = spark.createDataFrame([(1, 1)], "start long, node long")
    assert G.bounded_bfs(e, s, 2, 5).count() == 1


def test_neighborhood_rank_keeps_each_starts_mass(spark):
    e = spark.createDataFrame([("r", 1, 2, "calls", 1.0), ("r", 2, 3, "calls", 9.0), ("r", 1, 3, "calls", 1.0), ("r", 3, 9, "calls", 1.0)], EDGES)
    seeds = spark.createDataFrame([(7, 1, 4.0), (7, 2, 0.0), (8, 3, 1.0)], "start long, node long, score double")
    got = G.neighborhood_rank(G.both_ways(e), seeds, 1, 12).collect()
    for start in (7, 8):
        assert abs(sum(r.rank for r in got if r.start == start) - 1) < 1e-9
    assert {r.node for r in got if r.start == 8} == {1, 2, 3, 9} and {(r.node, r.parent) for r in got if r.start == 7 and r.depth == 1} == {(3, 1)}
    hybrid = spark.createDataFrame([(8, 9, 1.0)], "start long, node long, score double")
    top = G.boosted(spark.createDataFrame(got), hybrid, 1).collect()
    assert len(top) == 2 and {r.rank for r in top} == {1}


def test_explored_gains(spark):
    e = spark.createDataFrame([("r", 1, 2, "calls", 2.0), ("r", 2, 3, "calls", 1.0)], EDGES)
    seeds = spark.createDataFrame([(5, 1)], "start long, node long")
    assert {(r.node, r.boost) for r in G.explored(G.both_ways(e), seeds, 2).collect()} == {(2, 3.8), (1, 2.3), (3, 1.15)}


def test_impact_goes_both_ways(spark):
    e = spark.createDataFrame([("r", 1, 2, "calls", 2.0), ("r", 1, 3, "calls", 1.0), ("r", 2, 4, "calls", 1.0), ("r", 3, 4, "calls", 3.0), ("r", 9, 1, "calls", 1.0)], EDGES)
    t = spark.createDataFrame([(1,)], "node long")
    got = {(r.node, r.direction, r.depth, r.weight, r.rank) for r in G.impact(e, t, 2).collect()}
    assert got == {(2, "forward", 1, 2.0, 1), (3, "forward", 1, 1.0, 2), (4, "forward", 2, 4.0, 3), (9, "reverse", 1, 1.0, 1)}
    assert len(G.impact(e, t, 2, most=1).collect()) == 2


def test_edges_inside_neighborhoods_are_met_from_the_smaller_node(spark):
    import random

    r = random.Random(3)
    one = sorted({(0, n) for n in range(1, 400)} | {tuple(r.sample(range(1, 60), 2)) for _ in range(300)})
    e = G.both_ways(spark.createDataFrame([("r", a, b, "calls", r.choice([0.01, 1.0, 9.0])) for a, b in one] + [("r", 7, 7, "calls", 1.0)], EDGES))
    hood = spark.createDataFrame([(s, n) for s in range(20) for n in {0, *r.sample(range(60), 8)}], "start long, node long")
    w = F.sum(F.least(F.lit(4.0), F.greatest(F.lit(0.05), F.col("weight")))).alias("w")
    plain = hood.select("start", F.col("node").alias("source")).join(e.where("source <> target").groupBy("source", "target").agg(w), "source").join(hood.select("start", F.col("node").alias("target")), ["start", "target"])
    rows = lambda df: sorted((x.start, x.source, x.target, round(x.w, 9)) for x in df.collect())
    got = rows(G.edges_inside(e, hood))
    assert got == rows(plain) and got and all(a != b for _, a, b, _ in got)


def test_callers_names_cross_one_shuffle(spark):
    """F8, F14, F17: names are distinct within their unit, and callers with and without a definition in their file are dealt once."""
    null = ("r", 5, None, "h", "function", "", "", [], ["g", None, "G"], [], [], [])
    u = spark.createDataFrame([unit(1, "a.py", "f", "function", calls=["G", "g", "far"], imports=["b", "b"]), unit(2, "a.py", "g", "function"), unit(3, "b.py", "g", "function"), unit(4, "", "far", "function", calls=["h"]), null, unit(6, "b.py")], UNIT)
    got = sorted((r.source, r.target, r.label, r.weight) for r in G.edges(u).collect())
    assert got == [(1, 2, "calls", 2.6), (1, 4, "calls", 1.8), (1, 6, "imports", 1.4), (4, 5, "calls", 1.8), (5, 2, "calls", 1.8), (5, 3, "calls", 1.8)]
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(G.names_asked(u))
    assert plan(G.edges(u)).count("REPARTITION_BY_COL") == 1 and plan(G.top_edges(G.edges(u), 3)).count("Exchange hashpartitioning(source") == 1
