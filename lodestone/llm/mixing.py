"""Problem 8: mixing sources to target shares of all tokens, by entropy balancing.

Each document starts at rate 1.  The rates closest to that in relative entropy that meet every source's token target
are exponentially tilted, exp(lambda_source * tokens), and cut at the source's cap; the convex dual is solved by Newton
iterations over a distributed histogram of token counts.  Systematic rounding turns rates into whole copies; what it
leaves of a source's token target is then settled by single copies of the documents that fit it best.

The total is the largest that lets every source with documents reach its share within its cap (or a parameter).  A
listed source without tokens is reported and its share is divided among the others in proportion.  Documents of other
sources, with null source, or with null or empty text get no copies and no row.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from lodestone.operators.lineage import checkpointed

from .batches import table
from .tokens import VOCABULARY, encode_texts

TOLERANCE = 1e-9
WINDOW_ROWS = 20_000


def token_sizes(docs: DataFrame, targets: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, source and n_tokens of the documents of listed sources; the list of targets has one row per source."""
    listed = docs.where("text is not null and text <> ''").join(targets.select("source").distinct(), "source", "left_semi")
    return encode_texts(listed, counts=True, carry=("source",), path=path).where("n_tokens > 0")


def solve(hist: DataFrame, wanted: dict[str, tuple[float, int, int]], rounds: int = 60) -> dict[str, float]:
    """lambda per source.  wanted: source -> (token target, cap, tokens).  One aggregation over ``hist`` (source,
    n_tokens, docs) serves all sources in each Newton round; only sums per source reach the driver."""
    low = {s: -60.0 for s in wanted}
    high = {s: 60.0 for s in wanted}
    now = {s: 0.0 for s in wanted}
    scale = {s: w[2] for s, w in wanted.items()}
    done: set[str] = {s for s, (target, cap, tokens) in wanted.items() if target >= cap * tokens * (1 - TOLERANCE)}
    for s in done:
        now[s] = 60.0
    size = hist.groupBy("source").agg((F.sum(F.col("docs") * F.col("n_tokens")) / F.sum("docs")).alias("mean")).collect()
    mean = {r["source"]: r["mean"] for r in size}
    for _ in range(rounds):
        open_ = [s for s in wanted if s not in done]
        if not open_:
            break
        spark = hist.sparkSession
        trial = spark.createDataFrame([(s, float(now[s] / mean[s]), math.log(wanted[s][1])) for s in open_], "source string, lam double, log_cap double")
        x = F.col("lam") * F.col("n_tokens")
        rate = F.exp(F.least(x, F.col("log_cap")))
        free = F.when(x < F.col("log_cap"), rate).otherwise(0.0)
        sums = hist.join(trial, "source").groupBy("source").agg(
            F.sum(F.col("docs") * rate * F.col("n_tokens")).alias("got"), F.sum(F.col("docs") * free * F.col("n_tokens") * F.col("n_tokens")).alias("slope")
        )
        for r in sums.collect():
            s = r["source"]
            gap = r["got"] - wanted[s][0]
            if abs(gap) <= TOLERANCE * scale[s]:
                done.add(s)
                continue
            if gap > 0:
                high[s] = now[s]
            else:
                low[s] = now[s]
            step = now[s] - gap / r["slope"] * mean[s] if r["slope"] > 0 else math.nan
            now[s] = step if low[s] < step < high[s] else (low[s] + high[s]) / 2
    return {s: now[s] / mean[s] for s in wanted}


def settle(copies: DataFrame, wanted: dict[str, float], rounds: int = 8) -> DataFrame:
    """The copies with at most ``rounds`` documents a source given one copy more or less, each time the one that brings the
    source nearest to its token target.  A round is one aggregation; one row per source and round reaches the driver."""
    spark = copies.sparkSession
    used = {r["source"]: r["used"] for r in copies.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("used")).collect()}
    gap = {s: wanted[s] - u for s, u in used.items()}
    moves: dict[int, int] = {}
    for _ in range(rounds):
        gaps = spark.createDataFrame([(s, float(g)) for s, g in gap.items() if g] or [("", 0.0)], "source string, gap double")
        size = F.abs("gap")
        fits = (F.col("n_tokens") < 2 * size) & F.when(F.col("gap") > 0, F.col("copies") < F.col("cap")).otherwise(F.col("copies") > 0)
        best = copies.where(~F.col("row").isin(*moves) if moves else F.lit(True)).join(gaps, "source").where(fits).groupBy("source").agg(F.min_by(F.struct("row", "n_tokens"), F.struct(F.abs(size - F.col("n_tokens")), F.col("row"))).alias("m")).collect()
        for r in best:
            step = 1 if gap[r["source"]] > 0 else -1
            moves[r["m"]["row"]] = step
            gap[r["source"]] -= step * r["m"]["n_tokens"]
        if not best:
            break
    changed = spark.createDataFrame(list(moves.items()), "row long, step int")
    return copies.join(changed, "row", "left").withColumn("copies", (F.col("copies") + F.coalesce("step", F.lit(0))).cast("int")).drop("row", "step")


def mix(docs: DataFrame, targets: DataFrame, total: float | None = None, path: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(copies, report).  copies: doc_id, source, n_tokens, rate, copies.  report: one row per target source."""
    spark = docs.sparkSession
    sizes = checkpointed(token_sizes(docs, targets, path).withColumn("row", F.monotonically_increasing_id()))
    hist = checkpointed(sizes.groupBy("source", "n_tokens").agg(F.count("*").alias("docs")))
    plan = [r.asDict() for r in targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("cap")).collect()]  # a fixed list
    have = {r["source"]: (r["tokens"], r["docs"]) for r in hist.groupBy("source").agg(F.sum(F.col("docs") * F.col("n_tokens")).alias("tokens"), F.sum("docs").alias("docs")).collect()}
    usable = {p["source"]: p for p in plan if p["source"] in have and (p["share"] or 0) > 0 and (p["cap"] or 0) > 0}
    whole = sum(p["share"] for p in usable.values()) or 1.0
    most = min((p["cap"] * have[s][0] * whole / p["share"] for s, p in usable.items()), default=0.0)
    total = most if total is None else total
    wanted = {s: (min(total * p["share"] / whole, p["cap"] * have[s][0]), p["cap"], have[s][0]) for s, p in usable.items()}
    lam = solve(hist, wanted) if wanted else {}
    rows = [(s, float(lam[s]), int(wanted[s][1]), max(1, -(-have[s][1] // WINDOW_ROWS))) for s in wanted]
    tilt = spark.createDataFrame(rows, "source string, lam double, cap int, salts long")
    rated = sizes.join(tilt, "source").withColumn("rate", F.exp(F.least(F.col("lam") * F.col("n_tokens"), F.log(F.col("cap").cast("double")))))
    # systematic rounding: running sums of rates in order of size round to whole copies; salts bound each window's rows
    rated = rated.withColumn("salt", F.pmod(F.xxhash64("row"), F.col("salts")))
    run = F.sum("rate").over(W.partitionBy("source", "salt").orderBy("n_tokens", "row").rowsBetween(W.unboundedPreceding, W.currentRow))
    start = F.lit(0.5)
    copies = rated.withColumn("run", run).withColumn("copies", (F.floor(F.col("run") + start + 1e-9) - F.floor(F.col("run") - F.col("rate") + start + 1e-9)).cast("int"))
    copies = checkpointed(copies.select("doc_id", "source", "n_tokens", "rate", F.least("copies", "cap").alias("copies"), "cap", "row"))
    copies = settle(copies, {s: w[0] for s, w in wanted.items()}).select("doc_id", "source", "n_tokens", "rate", "copies")
    used = copies.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"), F.sum(F.col("copies") * F.col("n_tokens")).alias("used_tokens"), F.max("copies").alias("most_copies"), F.count_if(F.col("copies") > 0).alias("used_docs"))
    base = spark.createDataFrame([(p["source"], p["share"], p["cap"]) for p in plan], "source string, target_share double, max_repeats int")
    report = base.join(used, "source", "left").withColumn("all_tokens", F.sum("used_tokens").over(W.partitionBy(F.lit(1))))  # one row per target source
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    report = report.select("source", "target_share", "max_repeats", zero("docs"), zero("used_docs"), zero("tokens"), zero("used_tokens"), zero("most_copies"), F.round(F.coalesce(F.col("used_tokens") / F.col("all_tokens"), F.lit(0.0)), 6).alias("actual_share"))
    return copies, report


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of each document of the listed sources."""
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares of tokens by source."""
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


QUERIES = {"p8_mix": p8_mix, "p8_shares": p8_shares}
