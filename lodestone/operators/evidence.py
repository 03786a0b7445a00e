"""Evidence algebra: labels, drift, scorecards, verdicts and deltas over flattened evidence bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from lodestone.functions.text import label_of, repository_key, tokenize

from .flatten import child_table, elements, flatten_bundles
from .lineage import narrowed
from .parse import jaccard, name_similarity

#: What a failed check means.
DRIFT = {"graph_search_ran": ("proof_graph_stale", "medium"), "route_anchor_present": ("route_anchor_missing", "high"), "top_hit_on_route_path": ("execution_path_broken", "medium"), "top_hit_present": ("top_hit_missing", "high"), "decoy_audit_rejected": ("decoy_audit_stale", "medium")}


def evidence_rows(bundles: DataFrame) -> DataFrame:
    """bundle_no, pos, rank, label, relpath, symbol_name, route_path, score, snippet of each evidence element."""
    rows = child_table(flatten_bundles(bundles, ("evidence",)), "evidence", "rank", "source_label", "relpath", "symbol_name", "route_path", "score", "snippet", "matched_terms")
    terms = F.coalesce(F.when(F.col("matched_terms").startswith("["), elements(F.col("matched_terms"))), F.array().cast("array<string>"))
    return rows.select(F.col("record_no").alias("bundle_no"), "pos", F.col("source_label").alias("label"), "relpath", "symbol_name", "route_path", F.expr("try_cast(score AS DOUBLE)").alias("score"), "snippet", terms.alias("terms"))


def edge_rows(bundles: DataFrame, child: str = "graph_edges") -> DataFrame:
    rows = child_table(flatten_bundles(bundles, (child,)), child, "source", "target", "label")
    return rows.select(F.col("record_no").alias("bundle_no"), "pos", "source", "target", "label")


def check_rows(bundles: DataFrame) -> DataFrame:
    rows = child_table(flatten_bundles(bundles, ("proof.checks",)), "proof.checks", "name", "passed")
    return rows.select(F.col("record_no").alias("bundle_no"), "pos", "name", (F.lower("passed") == "true").alias("passed"))


def current_labels(chunks: DataFrame, asked: DataFrame | None = None, latest: bool = True) -> DataFrame:
    """repo, label, text: the last chunk of each label wins, or the first; of the ``asked`` labels only, if given, so that other texts stay where they are."""
    named = chunks.select("repo", label_of(F.col("relpath"), F.col("symbol_name")).alias("label"), "text", "chunk_no").where("repo is not null")
    return (named if asked is None else narrowed(named, asked, ["repo", "label"])).groupBy("repo", "label").agg((F.max_by if latest else F.min_by)("text", "chunk_no").alias("text"))


def with_repo(rows: DataFrame, bundles: DataFrame) -> DataFrame:
    return rows.join(bundles.select("bundle_no", repository_key(F.col("repo_root")).alias("repo")), "bundle_no")


def normal(c):
    return F.trim(F.regexp_replace(F.regexp_replace(c, "\r\n", "\n"), r"^\s+|\s+$", ""))


def snippet_drift(evidence: DataFrame, labels: DataFrame) -> DataFrame:
    """bundle_no, pos, status: same, cut (the snippet is a marked prefix), drift, or missing."""
    j = evidence.where("label is not null").join(labels, ["repo", "label"], "left")
    snippet, text = normal(F.col("snippet")), normal(F.col("text"))
    stem = F.regexp_replace(snippet, r"\s*(?:\.\.\.|…)$", "")
    status = F.when(F.col("text").isNull(), "missing").when(F.coalesce(snippet == text, F.lit(False)), "same").when(F.coalesce((stem != snippet) & F.startswith(text, stem), F.lit(False)), "cut").otherwise("drift")
    return j.select("bundle_no", "pos", status.alias("status"))


def drift_of(checks: DataFrame) -> DataFrame:
    """bundle_no, type, severity of failed checks; one row of type none for a bundle whose checks all passed."""
    table = F.create_map(*(x for n, (t, s) in DRIFT.items() for x in (F.lit(n), F.struct(F.lit(t).alias("type"), F.lit(s).alias("severity")))))
    failed = checks.where(~F.col("passed")).select("bundle_no", F.coalesce(F.try_element_at(table, F.col("name")), F.struct(F.lit("unknown_drift").alias("type"), F.lit("unknown").alias("severity"))).alias("d")).select("bundle_no", "d.type", "d.severity").distinct()
    clean = checks.groupBy("bundle_no").agg(F.bool_and("passed").alias("ok")).where("ok").select("bundle_no", F.lit("none").alias("type"), F.lit("none").alias("severity"))
    return failed.unionByName(clean)


def diagnostics(evidence: DataFrame, edges: DataFrame) -> DataFrame:
    """bundle_no and confidence of its hits, in their order: thresholds on the top score, its lead over the next, matched terms of the first four hits, files, symbols, routes and edges.

    Counted in thousandths and rounded to two digits, halves up."""
    e = evidence.withColumn("i", F.row_number().over(W.partitionBy("bundle_no").orderBy("pos")))
    g = e.groupBy("bundle_no").agg(
        F.count("*").alias("hits"), F.max(F.when(F.col("i") == 1, F.col("score"))).alias("top"), F.max(F.when(F.col("i") == 2, F.col("score"))).alias("second"), F.least(F.lit(12), F.size(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("i") <= 4, F.col("terms"))))))).alias("terms"),
        F.count_distinct("relpath").alias("files"), F.count_if(F.col("symbol_name") != "").alias("symbols"), F.count_if(F.col("route_path") != "").alias("routes"),
    )
    g = g.join(edges.groupBy("bundle_no").agg(F.count("*").alias("edges")), "bundle_no", "left").fillna(0, ["edges"])
    top = F.coalesce("top", F.lit(0.0))
    gap = F.greatest(F.lit(0.0), top - F.coalesce("second", F.lit(0.0)))
    m = (
        F.lit(280) + F.when(top >= 18, 220).when(top >= 10, 140).otherwise(60) + F.when(gap >= 6, 160).when(F.col("hits") > 1, 60).otherwise(0) + F.least(F.lit(140), 35 * F.col("terms"))
        + F.least(F.lit(120), 35 * F.col("edges")) + F.when(F.col("files") >= 2, 60).otherwise(0) + F.when(F.col("symbols") > 0, 60).otherwise(0) + F.when(F.col("routes") > 0, 40).otherwise(0)
    )
    level = F.when(m >= 720, "high").when(m >= 450, "medium").otherwise("low")
    return g.select("bundle_no", "hits", "files", "edges", "terms", (F.floor((F.least(F.lit(1000), m) + 5) / 10) / 100.0).alias("confidence"), level.alias("level"))


#: Weights of a successor's signs, with the least similarity from which names and bodies count, and the least scores to be kept and to be sure.
SAME_FILE, SAME_KIND, NAME, BODY, CALLS, REACHED, CALLED = 0.18, 0.10, 0.22, 0.28, 0.12, 0.22, 0.18
LEAST_NAME, LEAST_BODY, SURE_BODY, SURE_CALLS, KEPT, HIGH = 0.45, 0.35, 0.55, 0.5, 0.52, 0.78


def successors(targets: DataFrame, before: DataFrame, after: DataFrame, continued: DataFrame, k: int = 5) -> DataFrame:
    """bundle_no, target, candidate, score, confidence, rank: the best k units that may have taken a proof's target's place.

    before and after: repo, node, label, relpath, symbol, kind, calls, text of units.  continued: bundle_no, node, reached,
    called - units that the proof's routes reach or a predecessor on its paths calls; as only those may succeed, no target
    meets other units.  Name, body and calls must show likeness too."""
    old = targets.join(before.select("repo", F.col("label").alias("target"), *(F.col(c).alias("old_" + c) for c in ("relpath", "symbol", "kind", "calls", "text"))), ["repo", "target"])
    pair = old.join(continued, "bundle_no").join(after.select("node", "label", "relpath", "symbol", "kind", "calls", "text"), "node").where("symbol <> '' and label <> target")
    pair = name_similarity(pair, "old_symbol", "symbol", "name").withColumn("body", jaccard(tokenize(F.col("old_text")), tokenize(F.col("text")))).withColumn("call", jaccard(F.col("old_calls"), F.col("calls")))
    when = lambda c, v: F.when(c, v).otherwise(0.0)
    score = (
        when(F.col("relpath") == F.col("old_relpath"), SAME_FILE) + when(F.col("kind") == F.col("old_kind"), SAME_KIND) + when(F.col("name") >= LEAST_NAME, NAME * F.col("name")) + when(F.col("body") >= LEAST_BODY, BODY * F.col("body"))
        + when(F.col("call") > 0, CALLS * F.col("call")) + when(F.col("reached"), REACHED) + when(F.col("called"), CALLED)
    )
    like = (F.col("name") >= LEAST_NAME) | (F.col("body") >= SURE_BODY) | (F.col("call") >= SURE_CALLS)
    best = pair.withColumn("score", F.round(F.least(F.lit(1.0), score), 3)).where(like & (F.col("score") >= KEPT))
    first = W.partitionBy("bundle_no").orderBy(F.col("score").desc(), "label")
    return best.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select("bundle_no", "target", F.col("label").alias("candidate"), "score", F.when(F.col("score") >= HIGH, "high").otherwise("medium").alias("confidence"), "rank")
