"""Strict replay of proofs against the current chunks and edges, and six mutations of every bundle replayed alike.

Every bundle's proof becomes one struct; the mutations change that struct, all seven are exploded and their claims are
settled once per distinct (repository, check, key): a mutation counts as detected only if its own replay fails.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lodestone.functions.text import label_of, repository_key

from .flatten import content, elements, members

#: What the mutations put in.
MUTATIONS = ("top_hit_missing", "evidence_snippet_drift", "route_anchor_missing", "supporting_path_missing", "proof_graph_edge_unverified", "decoy_audit_stale")
BASELINE = "baseline"
_TOP, _NODE, _ROUTE, _SNIPPET = "server.js:__missingProofTarget", "server.js:__missingProofPathNode", "/__missing/proof-route", "__stale_proof_evidence_snippet__"
_EDGE = {"source": "server.js:writeAdminChatDelta", "target": "server.js:writeChatDelta", "label": "route_path", "route": "server.js:writeAdminChatDelta"}


def _items(text: Column, get) -> Column:
    """Array of ``get(element)`` of the elements that are no nulls; empty where there is no array."""
    return F.transform(F.filter(F.coalesce(elements(text), F.array().cast("array<string>")), lambda e: e.isNotNull()), get)


def _str(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def proof_docs(bundles: DataFrame) -> DataFrame:
    """bundle_no, repo and what the replay reads of each valid payload that is an object."""
    base = bundles.select("bundle_no", repository_key(F.col("repo_root")).alias("repo"), content(F.col("payload")).alias("doc")).where("doc like '{%'")
    base = base.select("bundle_no", "repo", members(F.col("doc"), "evidence", "proof").alias("m"))
    base = base.select("bundle_no", "repo", "m.evidence", members(F.col("m.proof"), "status", "top_hit", "route_literals", "supporting_paths", "proof_graph", "decoy_audit").alias("p"))

    def evidence(e):
        m = members(e, "source_label", "snippet")
        return F.struct(_str(m["source_label"]).alias("label"), _str(m["snippet"]).alias("snippet"))

    def edge(e):
        m = members(e, "source", "target", "label", "route")
        return F.struct(_str(m["source"]).alias("source"), _str(m["target"]).alias("target"), _str(m["label"]).alias("label"), F.coalesce(m["route"], _str(m["source"])).alias("route"))

    def decoy(e):
        m = members(e, "candidate", "rejected")
        return F.struct(_str(m["candidate"]).alias("candidate"), (~F.lower(_str(m["rejected"])).isin("", "false", "0", "null")).alias("rejected"))

    doc = F.struct(
        _str(F.col("p.top_hit")).alias("top_hit"), F.filter(_items(F.col("p.route_literals"), lambda e: e), lambda e: e != "").alias("routes"), _items(F.col("evidence"), evidence).alias("evidence"),
        _items(F.col("p.supporting_paths"), lambda e: _items(members(e, "path")["path"], lambda x: x)).alias("paths"), _items(members(F.col("p.proof_graph"), "edges")["edges"], edge).alias("edges"), _items(F.col("p.decoy_audit"), decoy).alias("decoys"),
    )
    return base.select("bundle_no", "repo", F.col("p.status").alias("proof_status"), doc.alias("doc"))


def _with_first(items: Column, change) -> Column:
    return F.transform(items, lambda x, i: F.when(i == 0, change(x)).otherwise(x))


def cases(docs: DataFrame, mutations: tuple[str, ...] = MUTATIONS) -> DataFrame:
    """bundle_no, repo, mutation, doc: each bundle as it is and with each of the mutations."""
    d = F.col("doc")
    edge = F.struct(*(F.lit(v).alias(k) for k, v in _EDGE.items()))
    changed = {
        BASELINE: d,
        "top_hit_missing": d.withField("top_hit", F.lit(_TOP)),
        "evidence_snippet_drift": d.withField("evidence", _with_first(d["evidence"], lambda x: x.withField("snippet", F.lit(_SNIPPET)))),
        "route_anchor_missing": d.withField("routes", F.array(F.lit(_ROUTE))),
        "supporting_path_missing": d.withField("paths", _with_first(d["paths"], lambda x: F.concat(x, F.array(F.lit(_NODE))))),
        "proof_graph_edge_unverified": d.withField("edges", F.concat(d["edges"], F.array(edge))),
        "decoy_audit_stale": d.withField("decoys", _with_first(d["decoys"], lambda x: x.withField("rejected", F.lit(False)))),
    }
    return docs.select("bundle_no", "repo", F.explode(F.array(*(F.struct(F.lit(k).alias("mutation"), v.alias("doc")) for k, v in changed.items() if k in (BASELINE, *mutations)))).alias("c")).select("bundle_no", "repo", "c.mutation", "c.doc")


def claims(cases: DataFrame) -> DataFrame:
    """bundle_no, repo, mutation, check, kind, a, b, snippet: everything a case's proof says about its repository."""
    d = F.col("doc")
    claim = lambda check, kind, a, b=F.lit(""), snippet=F.lit(""): F.struct(F.lit(check).alias("check"), F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), a.alias("a"), b.alias("b"), snippet.alias("snippet"))
    ends = F.filter(F.flatten(F.transform(d["edges"], lambda e: F.array(e["source"], e["target"]))), lambda x: x != "")
    claimed = F.concat(
        F.array(claim("top_hit_exists", "label", d["top_hit"])),
        F.transform(F.filter(d["evidence"], lambda e: e["label"] != ""), lambda e: claim("evidence_fingerprints_match", "text", e["label"], F.sha2(e["snippet"], 256), e["snippet"])),
        F.transform(d["routes"], lambda r: claim("route_literals_exist", "route", r)),
        F.transform(F.filter(F.flatten(d["paths"]), lambda x: x.isNotNull()), lambda x: claim("supporting_paths_exist", "label", x)),
        F.transform(ends, lambda x: claim("proof_graph_edges_resolve", "end", x)),
        F.transform(F.filter(d["edges"], lambda e: e["label"].isin("anchors", "route_path")), lambda e: claim("proof_graph_edges_verified", e["label"], F.when(e["label"] == "anchors", e["route"]).otherwise(e["source"]), e["target"])),
        F.transform(d["decoys"], lambda x: claim("decoy_audit_still_rejected", F.when(x["rejected"], "label").otherwise("open"), x["candidate"])),
    )
    return cases.select("bundle_no", "repo", "mutation", F.inline(claimed)).withColumn("repo", F.coalesce("repo", F.lit("")))


def _normal(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "\r\n?", "\n"), r"^\s+|\s+$", "")


def links(units: DataFrame, edges: DataFrame) -> DataFrame:
    """repo, kind, a, b: what backs a proof's edges; labels joined either way, and routes with what they anchor."""
    u = units.select("repo", "node", label_of(F.col("relpath"), F.col("symbol_name")).alias("label"), "route_path")
    e = edges.where("label in ('routes_to', 'calls', 'imports')").select("repo", "source", "target", F.col("label").alias("edge"))
    e = e.join(u.select("repo", F.col("node").alias("source"), F.col("label").alias("a"), "route_path"), ["repo", "source"]).join(u.select("repo", F.col("node").alias("target"), F.col("label").alias("b")), ["repo", "target"])
    path, anchor = F.lit("route_path").alias("kind"), F.lit("anchors").alias("kind")
    anchored = u.where("route_path <> ''").select("repo", anchor, F.col("route_path").alias("a"), F.col("label").alias("b"))
    through = e.where("edge <> 'imports' and route_path <> ''").select("repo", anchor, F.col("route_path").alias("a"), "b")
    return e.select("repo", path, "a", "b").unionByName(e.select("repo", path, F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(anchored).unionByName(through).distinct()


def refuted(claims: DataFrame, labels: DataFrame, units: DataFrame, edges: DataFrame) -> DataFrame:
    """repo, kind, a, b of the claims that the repository does not bear out; each distinct claim is settled once."""
    asked = claims.groupBy("repo", "kind", "a", "b").agg(F.first("snippet").alias("snippet"))
    asked = asked.join(labels.select("repo", F.col("label").alias("a"), F.coalesce("text", F.lit("")).alias("text")), ["repo", "a"], "left")
    asked = asked.join(units.where("route_path <> ''").select("repo", F.col("route_path").alias("a"), F.lit(True).alias("routed")).distinct(), ["repo", "a"], "left")
    asked = asked.join(links(units, edges).withColumn("linked", F.lit(True)), ["repo", "kind", "a", "b"], "left")
    said, now = _normal(F.col("snippet")), _normal(F.col("text"))
    same = F.when(said == "", True).when(said.endswith("..."), F.startswith(now, F.regexp_replace(said, r"\s*\.\.\.$", ""))).otherwise(said == now)
    there, routed = F.col("text").isNotNull(), F.coalesce("routed", F.lit(False))
    holds = F.when(F.col("kind") == "label", there).when(F.col("kind") == "text", there & same).when(F.col("kind") == "route", routed).when(F.col("kind") == "end", there | routed).when(F.col("kind") == "open", False).otherwise(F.coalesce("linked", F.lit(False)))
    return asked.where(~holds).select("repo", "kind", "a", "b")


def replay(docs: DataFrame, labels: DataFrame, units: DataFrame, edges: DataFrame, mutations: tuple[str, ...] = MUTATIONS) -> DataFrame:
    """bundle_no, mutation, failed: the checks that fail in a strict replay of each bundle and of its six mutations.

    A bundle without a repository meets an empty one."""
    c = claims(cases(docs, mutations))
    failed = c.drop("snippet").join(refuted(c, labels, units, edges), ["repo", "kind", "a", "b"]).groupBy("bundle_no", "mutation").agg(F.array_sort(F.collect_set("check")).alias("failed"))
    every = docs.select("bundle_no", F.explode(F.array(*map(F.lit, (BASELINE, *mutations)))).alias("mutation"))
    return every.join(failed, ["bundle_no", "mutation"], "left").select("bundle_no", "mutation", F.coalesce("failed", F.array().cast("array<string>")).alias("failed"))


#: Weights and grades of the reliability score.
WEIGHTS = {"proof_proved": 20, "strict_replay_valid": 20, "evidence_fingerprints_match": 10, "proof_edges_verified": 15, "decoy_audit_present": 10, "mutation_detection_complete": 25}
GRADES = (("A", 95), ("B", 85), ("C", 70))


def scorecard(docs: DataFrame, replayed: DataFrame) -> DataFrame:
    """bundle_no, score, grade, status of every document of ``docs``."""
    base = F.col("mutation") == BASELINE
    r = replayed.groupBy("bundle_no").agg(F.max(F.when(base, F.col("failed"))).alias("failed"), F.bool_and(base | (F.size("failed") > 0)).alias("complete"))
    j = docs.select("bundle_no", "proof_status", (F.size("doc.decoys") > 0).alias("decoys")).join(r, "bundle_no")
    items = {
        "proof_proved": F.coalesce(F.col("proof_status") == "proved", F.lit(False)), "strict_replay_valid": F.size("failed") == 0, "evidence_fingerprints_match": ~F.array_contains("failed", "evidence_fingerprints_match"),
        "proof_edges_verified": ~F.array_contains("failed", "proof_graph_edges_verified"), "decoy_audit_present": F.col("decoys"), "mutation_detection_complete": F.col("complete"),
    }
    j = j.select("bundle_no", sum((F.when(items[k], w).otherwise(0) for k, w in WEIGHTS.items()), F.lit(0)).alias("score"))
    score, grade = F.col("score"), F.lit("F")
    for name, least in reversed(GRADES):
        grade = F.when(score >= least, name).otherwise(grade)
    return j.select("bundle_no", "score", grade.alias("grade"), F.when(score >= 85, "pass").when(score >= 70, "warn").otherwise("fail").alias("status"))


#: Agents of the court, their claims and weights.
CLAIMS = (("retrieval_advocate", "top_hit_claim", 15), ("graph_navigator", "route_path_claim", 15), ("proof_verifier", "strict_replay_claim", 20), ("mutation_skeptic", "mutation_resistance_claim", 15))
COURT_GRADES = (("A", 95), ("B", 85), ("C", 70))


def court_claims(docs: DataFrame, replayed: DataFrame) -> DataFrame:
    """bundle_no, ord, agent, claim, weight, passed: the four claims that every proof makes; claims on reports that no table holds are not active."""
    base = F.col("mutation") == BASELINE
    r = replayed.groupBy("bundle_no").agg(F.max(F.when(base, F.col("failed"))).alias("failed"), F.bool_and(base | (F.size("failed") > 0)).alias("complete"))
    d = docs.select("bundle_no", "proof_status", "doc").join(r, "bundle_no")
    passed = (
        F.coalesce(F.col("proof_status") == "proved", F.lit(False)) & (F.col("doc.top_hit") != ""),
        (F.size("doc.routes") > 0) & (F.size("doc.paths") > 0),
        F.size("failed") == 0,
        F.col("complete"),
    )
    rows = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(a).alias("agent"), F.lit(c).alias("claim"), F.lit(w).alias("weight"), p.alias("passed")) for i, ((a, c, w), p) in enumerate(zip(CLAIMS, passed), 1)))
    return d.select("bundle_no", F.inline(rows))


def court(docs: DataFrame, replayed: DataFrame) -> DataFrame:
    """bundle_no, score, grade, passed_claims, challenges, open_challenges, status.

    Challenges are the audited decoys (warnings, discharged where rejected) and the failed checks of the replay (errors,
    open).  A proof is accepted with 90 points or more, no failed claim and no open error; 70 points need a review."""
    c = court_claims(docs, replayed).groupBy("bundle_no").agg(F.sum(F.when(F.col("passed"), F.col("weight")).otherwise(0)).alias("won"), F.sum("weight").alias("active"), F.count_if("passed").alias("passed_claims"), F.bool_and("passed").alias("all_passed"))
    failed = replayed.where(F.col("mutation") == BASELINE).select("bundle_no", F.size("failed").alias("errors"))
    j = c.join(failed, "bundle_no").join(docs.select("bundle_no", F.size("doc.decoys").alias("decoys")), "bundle_no")
    score = F.round(F.col("won") * 100 / F.col("active")).cast("int")
    grade = F.lit("F")
    for name, least in reversed(COURT_GRADES):
        grade = F.when(score >= least, name).otherwise(grade)
    status = F.when(F.col("all_passed") & (F.col("errors") == 0) & (score >= 90), "accepted").when(score >= 70, "needs_review").otherwise("rejected")
    return j.select("bundle_no", score.alias("score"), grade.alias("grade"), "passed_claims", (F.col("decoys") + F.col("errors")).alias("challenges"), F.col("errors").alias("open_challenges"), status.alias("status"))


#: The invariants of a regression contract that a replay settles, and the checks that settle them; none for all of them.
INVARIANTS = (("target_exists", "P0", "top_hit_exists"), ("strict_proof_replay", "P0", None), ("route_literals_exist", "P0", "route_literals_exist"), ("supporting_paths_exist", "P0", "supporting_paths_exist"), ("decoys_remain_rejected", "P1", "decoy_audit_still_rejected"))


def contract(replayed: DataFrame) -> DataFrame:
    """bundle_no, invariant, level, passed of every bundle's contract."""
    failed = F.col("failed")
    rows = F.array(*(F.struct(F.lit(i).alias("invariant"), F.lit(level).alias("level"), (F.size(failed) == 0 if check is None else ~F.array_contains(failed, check)).alias("passed")) for i, level, check in INVARIANTS))
    return replayed.where(F.col("mutation") == BASELINE).select("bundle_no", F.inline(rows))
