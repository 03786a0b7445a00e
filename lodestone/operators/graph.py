"""Code graph: name resolution, typed edges, bounded traversals and personalised PageRank.

Units are (repo, chunk_id) pairs, each represented by its latest chunk_no, so that a unit indexed again is one node.
Hot names are spread by the joins' own hash of (repo, name); traversals move one level per round and cut lineage by
checkpoints in the folder the session names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from .lineage import checkpointed

LABELS = ("calls", "references", "inherits", "imports", "routes_to")
FANOUT_PPR, FANOUT_IMPACT, FANOUT_ROUTE = 24, 12, 14


def units(chunks: DataFrame, latest: bool = True) -> DataFrame:
    """One row per (repo, chunk_id): the columns the graph needs of its latest chunk_no, or of its first."""
    cols = ["chunk_no", "relpath", "symbol_name", "symbol_kind", "qualified_name", "route_path", "imports", "calls", "refs", "inherits", "handler_names"]
    pick = F.max_by if latest else F.min_by
    one = chunks.where("repo is not null and chunk_id is not null").groupBy("repo", "chunk_id").agg(pick(F.struct(*cols), "chunk_no").alias("u"))
    return one.select("repo", "u.*").withColumnRenamed("chunk_no", "node")


def names_asked(u: DataFrame) -> DataFrame:
    """repo, source, relpath, label, name: every name a unit calls, references or inherits, once per unit and label, without a shuffle."""
    once = lambda c: F.array_distinct(F.filter(F.transform(c, F.lower), lambda x: x.isNotNull()))
    lists = F.array(
        F.struct(F.lit("calls").alias("label"), once(F.concat("calls", "handler_names")).alias("names")),
        F.struct(F.lit("references").alias("label"), once(F.col("refs")).alias("names")),
        F.struct(F.lit("inherits").alias("label"), once(F.col("inherits")).alias("names")),
        F.struct(F.lit("routes_to").alias("label"), F.when(F.col("symbol_kind") == "route", once(F.col("handler_names"))).alias("names")),
    )
    return u.select("repo", F.col("node").alias("source"), "relpath", F.inline(lists)).select("repo", "source", "relpath", "label", F.explode("names").alias("name"))


def resolve(u: DataFrame, asked: DataFrame) -> DataFrame:
    """Prioritised join: qualified names before bare ones, the same file before others; all that tie stay.

    The tier of a name is settled among its definitions, before any caller meets them, and callers with a definition in
    their own file meet that one only; no window sees callers times definitions.  Callers cross one shuffle for both."""
    named = F.array(F.struct(F.lit(1).alias("tier"), F.lower("qualified_name").alias("name")), F.struct(F.lit(2).alias("tier"), F.lower("symbol_name").alias("name")))
    targets = u.select("repo", F.col("node").alias("target"), F.col("relpath").alias("relpath"), F.inline(named)).where("name <> ''")
    tiers = targets.groupBy("repo", "name").agg(F.min("tier").alias("tier"))
    targets = targets.join(tiers, ["repo", "name", "tier"]).select("repo", "name", "tier", "target", "relpath")
    place = F.coalesce(F.concat(F.lit("/"), "relpath"), F.lit("")).alias("place")  # never null, and without a path like no definition's, so that both joins take the same rows
    asked = asked.where("repo is not null and name is not null").select("repo", "source", place, "label", "name")
    placed = targets.where("relpath is not null").select("repo", "name", "tier", "target", place)
    own = asked.join(placed, ["repo", "name", "place"]).select("repo", "source", "target", "label", "name", "tier", F.lit(True).alias("same"))
    without = asked.join(placed.select("repo", "name", "place").distinct(), ["repo", "name", "place"], "left_anti")
    far = without.join(targets.drop("relpath"), ["repo", "name"]).select("repo", "source", "target", "label", "name", "tier", F.lit(False).alias("same"))
    return own.unionByName(far)


def stem(col):
    """Last path part without its last suffix; a dotted module name keeps what stands before the last dot."""
    tail = F.lower(F.element_at(F.split(F.regexp_replace(F.regexp_replace(col, r"\\", "/"), "/+$", ""), "/"), -1))
    return F.regexp_replace(tail, r"(?<=.)\.[^.]*$", "")


def edges(u: DataFrame) -> DataFrame:
    """repo, source, target, label, weight: distinct typed edges without loops, dealt by source, as walks take the best of a source."""
    named = resolve(u, names_asked(u))
    weight = F.when(F.col("label") == "calls", F.when(F.col("same"), 2.6).otherwise(1.8)).when(F.col("label") == "references", F.when(F.col("same"), 1.35).otherwise(0.85)).when(F.col("label") == "inherits", 3.0).otherwise(3.2)
    first = named.select("repo", "source", "target", "label", weight.alias("weight"))
    files = u.where("symbol_name = ''").select("repo", F.col("node").alias("target"), stem(F.col("relpath")).alias("stem"))
    asked = u.select("repo", F.col("node").alias("source"), F.explode(F.array_distinct("imports")).alias("i")).select("repo", "source", stem(F.col("i")).alias("stem"))
    imports = asked.join(files, ["repo", "stem"]).select("repo", "source", "target", F.lit("imports").alias("label"), F.lit(1.4).alias("weight"))
    return first.unionByName(imports).where("source <> target").repartition("source").groupBy("repo", "source", "target", "label").agg(F.max("weight").alias("weight"))


def both_ways(e: DataFrame) -> DataFrame:
    return e.unionByName(e.select("repo", F.col("target").alias("source"), F.col("source").alias("target"), "label", "weight"))


def top_edges(e: DataFrame, n: int) -> DataFrame:
    """At most n edges per source by weight, label and target, all descending."""
    order = W.partitionBy("source").orderBy(F.col("weight").desc(), F.col("label").desc(), F.col("target").desc())
    return e.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def bounded_bfs(e: DataFrame, seeds: DataFrame, depth: int, fanout: int) -> DataFrame:
    """start, node, depth, parent within ``depth`` levels of each start, every node expanding its ``fanout`` best edges;
    among parents of one level the smallest counts.  seeds: start, node.  Rows grow by at most fanout per level."""
    steps = checkpointed(top_edges(e, fanout).select(F.col("source").alias("node"), "target").distinct())
    seen = seeds.select("start", "node", F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent"))
    front = seeds.select("start", "node")
    for level in range(1, depth + 1):
        reached = front.join(steps, "node").groupBy("start", F.col("target")).agg(F.min("node").alias("parent"))
        fresh = reached.select("start", F.col("target").alias("node"), F.lit(level).alias("depth"), "parent").join(seen, ["start", "node"], "left_anti")
        fresh = checkpointed(fresh)
        seen = seen.unionByName(fresh)
        front = fresh.select("start", "node")
    return seen


#: How a rank becomes a boost.
BOOST, BASE_SHARE, HYBRID_SHARE, LEAST_SEED = 35.0, 0.7, 0.3, 0.05


def edges_inside(e: DataFrame, hood: DataFrame) -> DataFrame:
    """start, source, target, w: merged and clamped edges between two nodes of a start's neighborhood (start, node).

    e holds both directions, so that a pair of nodes weighs the same either way and is looked for once: from its node of fewer
    neighbors.  A hub's edges are met only from the other end, and no node is asked for more neighbors than the root of twice the edges."""
    pair = checkpointed(e.where("source < target").groupBy("source", "target").agg(F.sum(F.least(F.lit(4.0), F.greatest(F.lit(0.05), F.col("weight")))).alias("w")))
    degree = pair.select(F.explode(F.array("source", "target")).alias("node")).groupBy("node").agg(F.count("*").alias("n"))
    of = lambda c: degree.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"))
    fewer = F.col("n_source") <= F.col("n_target")
    asked = pair.join(of("source"), "source").join(of("target"), "target").select(F.when(fewer, F.col("source")).otherwise(F.col("target")).alias("a"), F.when(fewer, F.col("target")).otherwise(F.col("source")).alias("b"), "w")
    met = hood.select("start", F.col("node").alias("a")).join(asked, "a").join(hood.select("start", F.col("node").alias("b")), ["start", "b"])
    return met.select("start", F.inline(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("target"), "w"), F.struct(F.col("b").alias("source"), F.col("a").alias("target"), "w"))))


def neighborhood_rank(e: DataFrame, seeds: DataFrame, depth: int, iterations: int, fanout: int = FANOUT_PPR, damping: float = 0.85, block: int = 50_000) -> DataFrame:
    """start, node, depth, parent, rank: personalised PageRank of each start inside the neighborhood of its own seeds.

    seeds: start, node, score; mass returns to a seed by its score, at least 0.05.  e holds both directions.  Every start
    is a graph of its own: rows are keyed by (start, node), at most seeds times ``fanout`` to the power of ``depth`` each.
    Blocks of whole starts, of some ``block`` rows, run all rounds as arrays, so that rows are shuffled once."""
    hood = checkpointed(bounded_bfs(e, seeds.select("start", "node").distinct(), depth, fanout))
    weight = F.greatest(F.lit(LEAST_SEED), F.col("score"))
    total = seeds.groupBy("start").agg(F.sum(weight).alias("total"))
    share = seeds.join(total, "start").select("start", "node", (weight / F.col("total")).alias("share"))
    nodes = hood.join(share, ["start", "node"], "left").select("start", "node", "depth", "parent", F.coalesce("share", F.lit(0.0)).alias("share"))
    n = -(-hood.count() // block) or 1
    dealt = lambda df: df.select(*(F.col(c).alias(c) for c in df.columns), F.pmod(F.xxhash64("start"), F.lit(n)).alias("block")).groupBy("block")

    def walk(left, right):
        import pyarrow as pa

        start, node = left["start"].to_numpy(), left["node"].to_numpy()
        order = np.lexsort((node, start))
        left, start, node = left.take(order), start[order], node[order]
        starts, of = np.unique(start, return_inverse=True)
        names = np.unique(node)
        key = of * len(names) + np.searchsorted(names, node)
        at = lambda c: np.searchsorted(key, np.searchsorted(starts, right["start"].to_numpy()) * len(names) + np.searchsorted(names, right[c].to_numpy()))
        source, target, w = at("source"), at("target"), right["w"].to_numpy()
        total = np.bincount(source, weights=w, minlength=len(key))
        p, stays, share = w / total[source], total == 0, left["share"].to_numpy()
        rank = share
        for _ in range(iterations):
            lost = np.bincount(of, weights=rank * stays, minlength=len(starts))[of]
            rank = (1 - damping) * share + damping * np.bincount(target, weights=rank[source] * p, minlength=len(key)) + damping * lost * share
        return pa.table({c: left[c] for c in ("start", "node", "depth", "parent")} | {"rank": pa.array(rank, pa.float64())})

    inside = edges_inside(e, hood)
    return dealt(nodes).cogroup(dealt(inside)).applyInArrow(walk, "start long, node long, depth int, parent long, rank double")


def boosted(ranks: DataFrame, hybrid: DataFrame, k: int = 10) -> DataFrame:
    """start, node, boost, path, rank of the k greatest boosts: a rank, raised by the fused score (start, node, score), with the nodes that lead there from a seed."""
    up = ranks.select("start", F.col("node").alias("parent"), F.col("parent").alias("grand"))
    boost = F.col("rank") * (BASE_SHARE + HYBRID_SHARE * F.coalesce("score", F.lit(0.0))) * BOOST
    j = ranks.join(hybrid, ["start", "node"], "left").withColumn("boost", F.round(boost, 4))
    first = W.partitionBy("start").orderBy(F.col("boost").desc(), "node")
    top = j.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k).join(up, ["start", "parent"], "left")
    return top.select("start", "node", "boost", F.concat_ws(">", "grand", "parent", "node").alias("path"), F.col("place").alias("rank"))


def explored(e: DataFrame, seeds: DataFrame, hops: int = 3, per_node: int = 8, frontier: int = 6) -> DataFrame:
    """start, node, boost of what neighbors of a start's seeds gain: 1.9 times an edge's weight on the first hop, 1.15 times later, summed over all edges that lead there.

    Each node passes its ``per_node`` heaviest edges on, and the ``frontier`` new nodes with the heaviest edge lead to the next hop."""
    steps = checkpointed(top_edges(e, per_node).select(F.col("source").alias("node"), "target", "weight"))
    seen, front, gains = seeds.select("start", "node"), seeds.select("start", "node"), None
    for hop in range(1, hops + 1):
        met = front.join(steps, "node").groupBy("start", F.col("target").alias("node")).agg((F.sum("weight") * (1.9 if hop == 1 else 1.15)).alias("boost"), F.max("weight").alias("best"))
        met = checkpointed(met)
        gains = met if gains is None else gains.unionByName(met)
        first = W.partitionBy("start").orderBy(F.col("best").desc(), "node")
        front = checkpointed(met.join(seen, ["start", "node"], "left_anti").withColumn("i", F.row_number().over(first)).where(F.col("i") <= frontier).select("start", "node"))
        seen = seen.union(front)
    return gains.groupBy("start", "node").agg(F.round(F.sum("boost"), 4).alias("boost"))


def impact(e: DataFrame, targets: DataFrame, depth: int = 3, fanout: int = FANOUT_IMPACT, most: int = 24) -> DataFrame:
    """start, node, direction, depth, weight, rank: what each target reaches along edges (forward) and what reaches it (reverse).

    Every node expands its ``fanout`` best edges; a node counts where it is met first, by the heaviest path of that level
    and then the smallest parent; at most ``most`` nodes per target and direction, by depth and path weight."""
    both = e.select(F.lit("forward").alias("direction"), "repo", "source", "target", "label", "weight").unionByName(e.select(F.lit("reverse").alias("direction"), "repo", F.col("target").alias("source"), F.col("source").alias("target"), "label", "weight"))
    order = W.partitionBy("direction", "source").orderBy(F.col("weight").desc(), F.col("label").desc(), F.col("target").desc())
    kept = both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= fanout).groupBy("direction", F.col("source").alias("node"), "target").agg(F.max("weight").alias("step"))
    steps = checkpointed(kept)
    seen = targets.select(F.col("node").alias("start"), "node", F.explode(F.array(F.lit("forward"), F.lit("reverse"))).alias("direction"), F.lit(0).alias("depth"), F.lit(0.0).alias("weight"))
    seen = checkpointed(seen)
    front = seen
    for level in range(1, max(1, min(depth, 5)) + 1):
        reached = front.join(steps, ["direction", "node"]).groupBy("start", "direction", F.col("target").alias("node")).agg(F.max(F.col("weight") + F.col("step")).alias("weight"))
        front = checkpointed(reached.join(seen.select("start", "direction", "node"), ["start", "direction", "node"], "left_anti").select("start", "node", "direction", F.lit(level).alias("depth"), F.round("weight", 4).alias("weight")))
        seen = seen.unionByName(front)
    first = W.partitionBy("start", "direction").orderBy("depth", F.col("weight").desc(), "node")
    return seen.where("depth > 0").withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= most)


def route_anchors(e: DataFrame, anchors: DataFrame, handlers: DataFrame, depth: int = 3, fanout: int = FANOUT_ROUTE) -> DataFrame:
    """start, node, depth, boost of what each anchor (start, node) reaches by its ``fanout`` best edges: 9 less 1.4 a level, at least 1.2, for functions called directly 7 more, for routes 0.35 of it.

    handlers: node, kind."""
    walked = bounded_bfs(e, anchors, depth, fanout).where("depth > 0")
    base = F.greatest(F.lit(1.2), 9.0 - (F.col("depth") - 1) * 1.4) + F.when((F.col("depth") == 1) & (F.col("kind") == "function"), 7.0).otherwise(0.0)
    return walked.join(handlers, "node").select("start", "node", "depth", F.round(F.when(F.col("kind") == "route", base * 0.35).otherwise(base), 4).alias("boost"))


def pagerank(e: DataFrame, teleport: DataFrame, iterations: int, damping: float = 0.85, tolerance: float | None = None, every: int = 4) -> DataFrame:
    """node, rank of personalised PageRank over merged, clamped and row-normalised edges; dangling mass returns to the
    teleport nodes.  teleport: group, node, share (summing to 1 per group); nodes of a group meet only their own mass.
    With a tolerance, rounds stop when the total change falls below it."""
    merged = e.groupBy("source", "target").agg(F.sum(F.least(F.lit(4.0), F.greatest(F.lit(0.05), F.col("weight")))).alias("w"))
    out = merged.groupBy("source").agg(F.sum("w").alias("total"))
    moves = checkpointed(merged.join(out, "source").select(F.col("source").alias("node"), "target", (F.col("w") / F.col("total")).alias("p")))
    nodes = checkpointed(e.select("repo", F.col("source").alias("node")).union(e.select("repo", "target")).union(teleport.select("repo", "node")).distinct().join(teleport, ["repo", "node"], "left").join(moves.select("node").distinct().withColumn("moves", F.lit(True)), "node", "left").select("repo", "node", F.coalesce("share", F.lit(0.0)).alias("share"), F.coalesce("moves", F.lit(False)).alias("moves")))
    rank = nodes.select("repo", "node", F.col("share").alias("rank"))
    for i in range(iterations):
        flow = rank.join(moves, "node").groupBy(F.col("target").alias("node")).agg(F.sum(F.col("rank") * F.col("p")).alias("flow"))
        lost = rank.join(nodes.where("not moves").select("node"), "node", "left_semi").groupBy("repo").agg(F.sum("rank").alias("lost"))
        new = nodes.join(flow, "node", "left").join(lost, "repo", "left").select("repo", "node", ((1 - damping) * F.col("share") + damping * F.coalesce("flow", F.lit(0.0)) + damping * F.coalesce("lost", F.lit(0.0)) * F.col("share")).alias("rank"))
        if tolerance is not None or (i + 1) % every == 0:
            new = checkpointed(new)
        if tolerance is not None:
            delta = new.join(rank.withColumnRenamed("rank", "old"), ["repo", "node"]).agg(F.sum(F.abs(F.col("rank") - F.col("old"))).alias("d")).collect()[0]["d"]
            rank = new
            if delta is None or delta < tolerance:
                break
        rank = new
    return rank
