"""Problem 3: train, dev and test splits that keep related cases together.

Cases of a suite are tied by the same repository (organisation and name) or the same id, through chains.  Ties are
stars to each key's smallest case, never pairs; components come from alternating large-star and small-star rounds, cut
by checkpoints.  Components are then dealt into equal bins by largest differencing over a histogram of their weights,
and whole bins go to splits.  Null and blank keys tie nothing; a null suite_id is a suite of its own.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from lodestone.functions.text import repository_key
from lodestone.operators.lineage import checkpointed
from lodestone.plans import sql as S

from .batches import table

BINS = 20
SHARES = (("train", 0.8), ("dev", 0.1), ("test", 0.1))
SALTS = 64


def id_key(col: Column) -> Column:
    s = F.lower(F.regexp_replace(col, r"^[\s 　]+|[\s 　]+$", ""))
    return F.when(s != "", s)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b); root is the smallest node of its component.

    Alternating large-star and small-star rounds (Kiveris et al. 2014) keep at most one edge per node and round, and
    need O(log^2 n) rounds; minima combine map-side and the join back onto hot centres is left to AQE's skew join."""
    both = lambda e: e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        # large-star: hang every larger neighbour on the smallest node around
        sym = both(edges)
        low = sym.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = sym.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small-star: hang a node and its smaller neighbours on the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select("a", F.col("m").alias("b")).union(small.select(F.col("b").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        new = checkpointed(small)
        # done when every node hangs on a root that hangs on nothing
        star = new.groupBy("a").agg(F.count("*").alias("n"))
        state = star.agg(F.max("n").alias("most")).collect()[0]["most"]
        deep = new.select("b").distinct().join(new.select(F.col("a").alias("b")).distinct(), "b", "left_semi").limit(1).count()
        edges = new
        if state in (None, 1) and deep == 0:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def ties(cases: DataFrame) -> DataFrame:
    """Star edges (a, b): each case to the smallest case that shares its suite's repository or id key."""
    keyed = cases.select("case_no", F.coalesce("suite_id", F.lit("\u0000")).alias("suite"), F.posexplode(F.array(repository_key(F.col("repo")), id_key(F.col("id")))).alias("kind", "key")).where("key is not null")
    low = keyed.groupBy("suite", "kind", "key").agg(F.min("case_no").alias("low"))
    return keyed.join(low, ["suite", "kind", "key"]).select(F.col("case_no").alias("a"), F.col("low").alias("b"))


def differencing(weights: list[tuple[int, int]], bins: int) -> list[tuple[int, int, int]]:
    """(weight, bin, how many components of that weight) over a histogram [(weight, count)].

    Multi-way largest differencing: of all partial partitions the two with the widest spread are combined, heaviest bin
    with lightest, until one is left.  Components of one weight are handled together, with the result they would have one
    by one: ``bins`` of them combine to a level partition, and those that a wide partition takes in go to its lightest bin
    each until its spread is down to their weight.  Ties: partitions of equal components first, single ones next."""
    out: dict[tuple[int, int], int] = {}
    heap: list[tuple[int, int, int, list]] = []  # (-spread, 0 if of equal components else 1, order, [(load, parts)] by load)
    made = 0

    def put(partition: list, mixed: int) -> None:
        nonlocal made
        made += 1
        heapq.heappush(heap, (partition[0][0] - partition[-1][0], mixed, made, partition))

    def combine(a: list, b: list) -> list:
        return sorted(((x[0] + y[0], (x[1], y[1])) for x, y in zip(a, reversed(b))), key=lambda x: x[0])

    for weight, count in sorted(((w, n) for w, n in weights if w > 0 and n > 0), reverse=True):
        while count:
            while len(heap) > 1 and -heap[1 if len(heap) == 2 or heap[1] < heap[2] else 2][0] > weight:
                put(combine(heapq.heappop(heap)[3], heapq.heappop(heap)[3]), 1)
            if heap and -heap[0][0] > weight:
                part, count = _fill(heapq.heappop(heap)[3], weight, count)
                put(part, 1)
                continue
            level, count = divmod(count, bins)
            for b in range(bins) if level else ():
                out[weight, b] = level
            if count:
                put([(0, ())] * (bins - count) + [(weight, (weight, 1))] * count, 0)
            count = 0
    while len(heap) > 1:
        put(combine(heapq.heappop(heap)[3], heapq.heappop(heap)[3]), 1)
    for b, (_, tree) in enumerate(heap[0][3] if heap else []):
        stack = [tree]
        while stack:
            x = stack.pop()
            if x and isinstance(x[0], int):
                out[x[0], b] = out.get((x[0], b), 0) + x[1]
            else:
                stack.extend(x)
    return sorted((w, b, c) for (w, b), c in out.items())


def _fill(partition: list, weight: int, count: int) -> tuple[list, int]:
    """The partition after components of one weight went to its lightest bin each, while its spread is over the weight and any are left; and how many are left."""
    loads = [x[0] for x in partition]
    need = lambda floor: sum(-(-(floor - x) // weight) for x in loads if x < floor)
    floor = loads[-1] - weight
    if need(floor) > count:  # the highest floor that so many lift all bins to
        low, high = loads[0], floor
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if need(mid) <= count else (low, mid - 1)
        floor = low
    given = [max(0, -(-(floor - x) // weight)) for x in loads]
    left = count - sum(given)
    if floor < loads[-1] - weight:  # too few for the next floor: one each to the lightest bins
        for i in sorted(range(len(loads)), key=lambda i: (loads[i] + given[i] * weight, i))[:left]:
            given[i] += 1
        left = 0
    return sorted(((x + g * weight, (t, (weight, g)) if g else t) for (x, t), g in zip(partition, given)), key=lambda x: x[0]), left


def allot(loads: list[int], shares=SHARES) -> list[int]:
    """Split of each bin: heaviest first, to the split that is farthest below its target."""
    total = sum(loads) or 1
    got = [0.0] * len(shares)
    split = [0] * len(loads)
    for b in sorted(range(len(loads)), key=lambda i: (-loads[i], i)):
        s = max(range(len(shares)), key=lambda k: (shares[k][1] * total - got[k], -k))
        split[b] = s
        got[s] += loads[b]
    return split


def assign_splits(cases: DataFrame, bins: int = BINS, shares=SHARES) -> DataFrame:
    """case_no, suite_id, component (its smallest case_no), split; one row per case."""
    roots = components(ties(cases))
    placed = cases.select("case_no", "suite_id").join(roots.select(F.col("node").alias("case_no"), "root"), "case_no", "left").withColumn("component", F.coalesce("root", "case_no")).drop("root")
    placed = checkpointed(placed.withColumn("suite", F.coalesce("suite_id", F.lit("\u0000"))))
    sized = placed.groupBy("suite", "component").agg(F.count("*").alias("weight")).withColumn("salt", F.pmod(F.xxhash64("component"), F.lit(SALTS)).cast("int"))
    counts = checkpointed(sized.groupBy("suite", "weight", "salt").agg(F.count("*").alias("n")))
    before = W.partitionBy("suite", "weight").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("suite", "weight", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        """A suite's histogram of weights: at most about sqrt(2 n) rows of it, whatever the number of components."""
        rows = differencing([(int(w), int(n)) for w, n in sorted(zip(pdf.weight, pdf.n))], bins)
        loads = [0] * bins
        for w, b, c in rows:
            loads[b] += w * c
        split = allot(loads, shares)
        out, done = [], {}
        for w, b, c in rows:
            start = done.get(w, 0)
            out.append((pdf.suite.iloc[0], w, start, start + c, shares[split[b]][0]))
            done[w] = start + c
        return pd.DataFrame(out, columns=["suite", "weight", "low", "high", "split"])

    dealt = counts.groupBy("suite", "weight").agg(F.sum("n").alias("n")).groupBy("suite").applyInPandas(deal, "suite string, weight long, low long, high long, split string")
    # ranks run within salted groups, so that a hot weight never meets in one task; offsets make them global
    rank = F.row_number().over(W.partitionBy("suite", "weight", "salt").orderBy("component"))
    ranked = sized.withColumn("rn", rank).join(offsets, ["suite", "weight", "salt"]).withColumn("rank", F.col("offset") + F.col("rn") - 1)
    ranges = dealt.groupBy("suite", "weight").agg(F.array_sort(F.collect_list(F.struct("low", "high", "split"))).alias("ranges"))  # at most ``bins`` entries
    split = F.filter("ranges", lambda r: (r["low"] <= F.col("rank")) & (F.col("rank") < r["high"]))[0]["split"]
    chosen = ranked.join(ranges, ["suite", "weight"]).select("suite", "component", split.alias("split"))
    return placed.join(chosen, ["suite", "component"]).select("case_no", "suite_id", "component", "split")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = components(ties(table(spark, sf_dir, "benchmark_challenge_suite")))
    return roots.select(F.col("root").alias("first_case_no"), F.col("node").alias("case_no"))


def p3_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_splits(table(spark, sf_dir, "benchmark_challenge_suite"))


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases and share of each split by suite."""
    s = assign_splits(table(spark, sf_dir, "benchmark_challenge_suite"))
    by = s.groupBy("suite_id").agg(F.count("*").alias("cases"), *(F.count_if(F.col("split") == n).alias(f"{n}_cases") for n, _ in SHARES), F.max("component").alias("last_component"))
    return by.select("suite_id", "cases", *(f"{n}_cases" for n, _ in SHARES), *(F.round(F.col(f"{n}_cases") / F.col("cases"), 6).alias(f"{n}_share") for n, _ in SHARES))


def p3_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per suite: cases, groups, groups that more than one split holds, cases without a split."""
    s = assign_splits(table(spark, sf_dir, "benchmark_challenge_suite"))
    g = s.groupBy("suite_id", "component").agg(F.count("*").alias("n"), (F.min("split") != F.max("split")).alias("torn"), F.count_if(F.col("split").isNull()).alias("unplaced"))
    return g.groupBy("suite_id").agg(F.sum("n").alias("cases"), F.count("*").alias("groups"), F.count_if("torn").alias("torn"), F.sum("unplaced").alias("unplaced"))


_KEY = "lower(regexp_replace(id, '^[\\s\u00a0\u3000]+|[\\s\u00a0\u3000]+$', '', 'g'))"
_CASES = f"SELECT case_no, coalesce(suite_id, chr(1)) AS suite, {S.repo('repo')} AS r, nullif({_KEY}, '') AS i FROM benchmark_challenge_suite"
ORACLES = {
    "p3_kept": f"""WITH RECURSIVE k AS ({_CASES}), e AS (SELECT DISTINCT case_no AS a, unnest([min(case_no) OVER (PARTITION BY suite, r), case_no]) AS b FROM k WHERE r IS NOT NULL UNION SELECT case_no, min(case_no) OVER (PARTITION BY suite, i) FROM k WHERE i IS NOT NULL),
      g AS (SELECT a, b FROM e UNION SELECT b, a FROM e), w AS (SELECT DISTINCT a AS node, a AS seen FROM g UNION SELECT w.node, g.b FROM w JOIN g ON g.a = w.seen), m AS (SELECT node, min(seen) AS root FROM w GROUP BY node)
      SELECT suite_id, count(*) AS cases, count(DISTINCT coalesce(root, case_no)) AS groups, 0::BIGINT AS torn, 0::BIGINT AS unplaced FROM benchmark_challenge_suite LEFT JOIN m ON node = case_no GROUP BY suite_id""",
    "p3_found": f"""WITH RECURSIVE k AS ({_CASES}), e AS (SELECT DISTINCT case_no AS a, unnest([min(case_no) OVER (PARTITION BY suite, r), case_no]) AS b FROM k WHERE r IS NOT NULL UNION SELECT case_no, min(case_no) OVER (PARTITION BY suite, i) FROM k WHERE i IS NOT NULL),
      g AS (SELECT a, b FROM e UNION SELECT b, a FROM e), w AS (SELECT DISTINCT a AS node, a AS seen FROM g UNION SELECT w.node, g.b FROM w JOIN g ON g.a = w.seen)
      SELECT min(seen) AS first_case_no, node AS case_no FROM w GROUP BY node HAVING min(seen) <> node""",
}
QUERIES = {"p3_found": p3_found, "p3_splits": p3_splits, "p3_report": p3_report, "p3_kept": p3_kept}
