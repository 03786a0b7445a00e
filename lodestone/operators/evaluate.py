"""Ranking evaluation: per-query metrics, aggregates, paired deltas, bootstrap, and hash-ordered repository splits."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window as W, functions as F

SEED = 17
RATIOS = (("train", 0.6), ("dev", 0.2), ("test", 0.2))


def per_query(ranking: DataFrame, qrels: DataFrame, methods: tuple[str, ...]) -> DataFrame:
    """method, query_id and metrics of every judged query; a method that ranks none of its relevant documents scores 0.

    ranking: method, query_id, doc_id, rank (cut at 100).  qrels: query_id, doc_id, relevance > 0."""
    ideal = qrels.withColumn("i", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("relevance").desc(), "doc_id")))
    ideal = ideal.groupBy("query_id").agg(F.sum(F.when(F.col("i") <= 10, (F.pow(F.lit(2.0), "relevance") - 1) / F.log2(F.col("i") + 1.0))).alias("idcg"), F.count("*").alias("relevant"))
    hit = ranking.where("rank <= 100").join(qrels, ["query_id", "doc_id"])
    seen = F.row_number().over(W.partitionBy("method", "query_id").orderBy("rank"))
    got = hit.withColumn("seen", seen).groupBy("method", "query_id").agg(
        F.min("rank").alias("first"),
        F.sum(F.when(F.col("rank") <= 10, (F.pow(F.lit(2.0), "relevance") - 1) / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"),
        F.count("*").alias("found"),
        F.sum(F.col("seen") / F.col("rank")).alias("precision"),
    )
    base = ideal.withColumn("method", F.explode(F.array(*[F.lit(m) for m in methods])))
    return measures(base.join(got, ["method", "query_id"], "left"))


def measures(cases: DataFrame) -> DataFrame:
    """method, query_id and metrics from the first relevant rank, gains, found and relevant documents and summed precision of each."""
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return cases.select(
        "method", "query_id", F.col("first").cast("int").alias("rank"), *(F.coalesce((F.col("first") <= k).cast("int"), F.lit(0)).alias(f"hit{k}") for k in (1, 3, 5)),
        F.round(z(1.0 / F.col("first")), 9).alias("mrr"), F.round(z(F.col("dcg") / F.col("idcg")), 9).alias("ndcg10"), F.round(z(F.col("found") / F.col("relevant")), 9).alias("recall100"), F.round(z(F.col("precision") / F.col("relevant")), 9).alias("map100"),
    )


def by_method(cases: DataFrame, *more: str) -> DataFrame:
    metrics = ("hit1", "hit3", "hit5", "mrr", "ndcg10", "recall100", "map100")
    return cases.groupBy("method", *more).agg(F.count("*").alias("queries"), *(F.round(F.avg(m), 5).alias(m) for m in metrics))


def paired(cases: DataFrame, baseline: str) -> DataFrame:
    """Mean deltas against a baseline, and wins, ties and losses by nDCG."""
    base = cases.where(F.col("method") == baseline).select("query_id", F.col("ndcg10").alias("b_ndcg"), F.col("mrr").alias("b_mrr"))
    d = cases.where(F.col("method") != baseline).join(base, "query_id").withColumn("delta", F.col("ndcg10") - F.col("b_ndcg"))
    return d.groupBy("method").agg(F.count("*").alias("pairs"), F.round(F.avg("delta"), 5).alias("ndcg_delta"), F.round(F.avg(F.col("mrr") - F.col("b_mrr")), 5).alias("mrr_delta"), F.count_if(F.col("delta") > 1e-12).alias("wins"), F.count_if(F.abs("delta") <= 1e-12).alias("ties"), F.count_if(F.col("delta") < -1e-12).alias("losses"))


def bootstrap(cases: DataFrame, baseline: str, samples: int = 2000, seed: int = 20260804) -> DataFrame:
    """95 % interval of each method's mean nDCG delta.  Poisson resampling: every pair draws its weights for all
    samples from its own seeded generator, so partial sums combine map-side and no group is collected."""
    import numpy as np
    import pandas as pd

    base = cases.where(F.col("method") == baseline).select("query_id", F.col("ndcg10").alias("b"))
    d = cases.where(F.col("method") != baseline).join(base, "query_id").select("method", "query_id", (F.col("ndcg10") - F.col("b")).alias("delta"))

    def partial(batches):
        sums: dict[str, np.ndarray] = {}
        for pdf in batches:
            for m, q, x in zip(pdf.method, pdf.query_id, pdf.delta):
                w = np.random.default_rng([seed, int(q)]).poisson(1.0, samples)
                acc = sums.setdefault(m, np.zeros((2, samples)))
                acc[0] += w * x
                acc[1] += w
        rows = [(m, i, a[0, i], a[1, i]) for m, a in sums.items() for i in range(samples)]
        yield pd.DataFrame(rows, columns=["method", "sample", "s", "w"])

    means = d.mapInPandas(partial, "method string, sample int, s double, w double").groupBy("method", "sample").agg((F.sum("s") / F.greatest(F.sum("w"), F.lit(1.0))).alias("mean"))
    return means.groupBy("method").agg(F.round(F.percentile("mean", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("mean", F.lit(0.975)), 6).alias("high"))


def repository_splits(cases: DataFrame, seed: int = SEED) -> DataFrame:
    """repo, split: repositories in order of a seeded hash, cut at rounded shares of their number.

    The rank comes from counts per leading hash byte plus a rank inside that byte's rows, never from one global sort."""
    names = cases.where("repo is not null").select("repo").distinct().withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), "repo"), 256)).withColumn("lead", F.substring("h", 1, 3))
    counts = names.groupBy("lead").agg(F.count("*").alias("n"))
    before = W.partitionBy(F.lit(1)).orderBy("lead").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("total", F.sum("n").over(W.partitionBy(F.lit(1))))  # at most 4096 rows
    ranked = names.join(offsets, "lead").withColumn("rank", F.col("offset") + F.row_number().over(W.partitionBy("lead").orderBy("h")))
    train = F.greatest(F.lit(1), F.round(F.col("total") * RATIOS[0][1]))
    dev = F.greatest(F.lit(1), F.round(F.col("total") * RATIOS[1][1]))
    dev = F.when(train + dev >= F.col("total"), F.greatest(F.lit(1), F.col("total") - train - 1)).otherwise(dev)
    return ranked.select("repo", F.when(F.col("rank") <= train, "train").when(F.col("rank") <= train + dev, "dev").otherwise("test").alias("split"))


def hash_sample(questions: DataFrame, repos: DataFrame, total: int, seed: int = SEED) -> DataFrame:
    """query_id, repo: at most ``total`` questions.  Repositories come in the order of their seeded hash; each takes the
    share of what is left, rounded up, at least one, as far as it has questions.  Sequential by definition, over one row per repository."""
    order = sorted(((r["n"], r["repo"]) for r in repos.select("repo", "n").collect()), key=lambda x: hashlib.sha256(f"{seed}:{x[1]}".encode()).hexdigest())
    takes, left = [], total
    for i, (n, repo) in enumerate(order):
        take = min(n, max(1, -(-left // (len(order) - i))) if left > 0 else 0)
        takes.append((repo, take))
        left -= take
    spark = questions.sparkSession
    t = spark.createDataFrame(takes, "repo string, take long").where("take > 0")
    first = W.partitionBy("repo").orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("query_id").cast("string")), 256), "query_id")
    return questions.join(t, "repo").withColumn("i", F.row_number().over(first)).where("i <= take").select("query_id", "repo")


#: The same order and shares as a recursive query over b (repo, n, i, m).
SAMPLE_SQL = """r AS (SELECT 0::BIGINT AS i, {total}::BIGINT AS lf, NULL::VARCHAR AS repo, 0::BIGINT AS take UNION ALL SELECT b.i, r.lf - least(b.n, CASE WHEN r.lf > 0 THEN greatest(1, ceil(r.lf / (b.m - b.i + 1))::BIGINT) ELSE 0 END), b.repo, least(b.n, CASE WHEN r.lf > 0 THEN greatest(1, ceil(r.lf / (b.m - b.i + 1))::BIGINT) ELSE 0 END) FROM r JOIN b ON b.i = r.i + 1), tk AS (SELECT repo, take FROM r WHERE take > 0)"""
