"""Proofs replayed against the current chunks and edges: scorecards, mutations, verdicts, contracts and guards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from lodestone.functions import text as T
from lodestone.operators import evidence as V, graph as G, replay as RP
from lodestone.operators.flatten import flatten_bundles, members
from lodestone.operators.lineage import checkpointed, narrowed
from lodestone.sources.tables import chunks, table

from . import sql as S
from .evidence import _BR, _DOCS, _EV, _EVR, _INNER, _LS, _MEM, _X
from .graphs import _E


def _replayed(spark, d) -> tuple[DataFrame, DataFrame]:
    """The proofs, and what fails of them and of their six mutations; written once, as every query reads both twice."""
    c, docs = chunks(spark, d), checkpointed(RP.proof_docs(table(spark, d, "evidence_bundles")))
    units, none = G.units(c), F.array().cast("array<string>")
    asked = RP.claims(RP.cases(docs)).where("kind in ('label', 'text', 'end')").select("repo", F.col("a").alias("label"))
    return docs, checkpointed(RP.replay(docs, V.current_labels(c, asked), units, G.edges(units.withColumns({"refs": none, "inherits": none}))))  # their edges back no proof


def _history(spark, d) -> DataFrame:
    """bundle_no, then, now: the failed checks of every proof against the first and the latest index of its repository."""
    c, docs = chunks(spark, d), checkpointed(RP.proof_docs(table(spark, d, "evidence_bundles")))
    asked = RP.claims(RP.cases(docs, ())).where("kind in ('label', 'text', 'end')").select("repo", F.col("a").alias("label"))
    none = F.array().cast("array<string>")

    def at(latest: bool) -> DataFrame:
        u = G.units(c, latest)
        return RP.replay(docs, V.current_labels(c, asked, latest), u, G.edges(u.withColumns({"refs": none, "inherits": none})), ()).select("bundle_no", "failed")

    return at(False).withColumnRenamed("failed", "then").join(at(True).withColumnRenamed("failed", "now"), "bundle_no")


def temporal_status(spark, d):
    """Whether each proof holds in both indexes, in the first only, in the latest only, or in none, and the checks that broke in between."""
    h = _history(spark, d)
    then, now = F.size("then") == 0, F.size("now") == 0
    status = F.when(then & now, "valid_across_history").when(then, "regression_found").when(now, "recovered").otherwise("always_failing")
    return h.select("bundle_no", status.alias("status"), F.array_join(F.array_except("now", "then"), ",").alias("broken"), F.array_join(F.array_except("then", "now"), ",").alias("mended"))


def proof_replay(spark, d):
    """The seven checks of every bundle's strict replay that fail."""
    return _replayed(spark, d)[1].where(F.col("mutation") == RP.BASELINE).select("bundle_no", F.explode("failed").alias("check"))


def mutation_lab(spark, d):
    """The failed checks of every mutation of every bundle."""
    return _replayed(spark, d)[1].where(F.col("mutation") != RP.BASELINE).select("bundle_no", "mutation", F.array_join("failed", ",").alias("failed"))


def mutation_detection(spark, d):
    """Per mutation: bundles, replays that fail, their rate, and, as many fail unmutated too, those that fail a check which the unmutated one passes."""
    r = _replayed(spark, d)[1]
    base = r.where(F.col("mutation") == RP.BASELINE).select("bundle_no", F.col("failed").alias("base"))
    per = r.where(F.col("mutation") != RP.BASELINE).join(base, "bundle_no")
    detected, told = F.size("failed") > 0, F.size(F.array_except("failed", "base")) > 0
    return per.groupBy("mutation").agg(F.count("*").alias("bundles"), F.count_if(detected).alias("detected"), F.round(F.avg(detected.cast("double")), 3).alias("rate"), F.count_if(F.size("base") == 0).alias("valid_before"), F.count_if(told).alias("newly_failed"))


def proof_scorecard(spark, d):
    """Score of every bundle with a valid payload: status, strict replay, two of its checks, decoys and mutations."""
    return RP.scorecard(*_replayed(spark, d))


def court_verdict(spark, d):
    return RP.court(*_replayed(spark, d))


def court_agents(spark, d):
    """Claims of each agent and how many hold, over all bundles, in the order of their first claim."""
    c = RP.court_claims(*_replayed(spark, d))
    return c.groupBy("agent").agg(F.min("ord").alias("first"), F.count("*").alias("claims"), F.count_if("passed").alias("passed"))


def contract_checks(spark, d):
    return RP.contract(_replayed(spark, d)[1])


def _surfaces(docs: DataFrame) -> DataFrame:
    """repo, bundle_no, protected, surface: files that a proof's target and paths stand in; the target's file counts as such, exposed if the proof names a route."""
    target = docs.where("doc.top_hit <> ''").select("repo", "bundle_no", T.relpath_of(F.col("doc.top_hit")).alias("protected"), F.lit(1).alias("own"), (F.size("doc.routes") > 0).alias("routed"))
    path = docs.select("repo", "bundle_no", F.explode(F.array_distinct(F.flatten("doc.paths"))).alias("label"), (F.size("doc.routes") > 0).alias("routed")).select("repo", "bundle_no", T.relpath_of(F.col("label")).alias("protected"), F.lit(0).alias("own"), "routed")
    both = target.unionByName(path).where("repo is not null and protected <> ''").groupBy("repo", "bundle_no", "protected").agg(F.max("own").alias("own"), F.max("routed").alias("routed"))
    return both.select("repo", "bundle_no", "protected", F.when(F.col("own") == 0, "proof_supporting_path").when(F.col("routed"), "route_exposed_target").otherwise("proved_target_file").alias("surface"))


def _touched(spark, d, docs: DataFrame) -> DataFrame:
    """run_no, relpath, bundle_no, protected, surface: changed files that are, or end in, a protected path of their repository.

    The suffixes of each changed path are enumerated, which turns the test into an equi-join; a run meets no bundle but those it touches."""
    runs = table(spark, d, "engineering_runs").select("run_no", T.repository_key(F.col("repo_root")).alias("repo"), F.explode("changed_files").alias("file"))
    runs = runs.select("run_no", "repo", F.regexp_replace(F.regexp_replace(F.trim("file"), r"\\", "/"), r"^(?:\./)+", "").alias("relpath")).where("relpath <> ''").distinct()
    parts = F.split("relpath", "/")
    runs = runs.withColumn("protected", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))))
    return runs.join(_surfaces(docs), ["repo", "protected"]).select("run_no", "relpath", "bundle_no", "protected", "surface")


def pr_guard(spark, d):
    """Runs that change a protected file, per contract: fail if the contract no longer holds, else warn, and the exit codes for a guard that fails on failures or on warnings."""
    docs, replayed = _replayed(spark, d)
    broken = RP.contract(replayed).groupBy("bundle_no").agg((~F.bool_and("passed")).alias("broken"))
    hit = _touched(spark, d, docs).groupBy("run_no", "bundle_no").agg(F.count_distinct("relpath").alias("touched_files"), F.min("surface").alias("surface"))
    status = F.when(F.col("broken"), "fail").otherwise("warn")
    return hit.join(broken, "bundle_no").select("run_no", "bundle_no", "touched_files", "surface", status.alias("status"), (status == "fail").cast("int").alias("exit_on_fail"), F.lit(1).alias("exit_on_warn"))


def guard_annotations(spark, d):
    """Workflow annotations of the protected files that runs change, escaped."""
    docs, _ = checkpointed(RP.proof_docs(table(spark, d, "evidence_bundles"))), None
    hit = _touched(spark, d, docs).select("run_no", "relpath", "surface", "protected").distinct()
    line = F.concat(F.lit("::warning file="), F.col("relpath"), F.lit("::"), T.escaped(F.concat(F.col("surface"), F.lit(": "), F.col("protected")), True))
    return hit.select("run_no", "relpath", line.alias("annotation"))


def graph_delta(spark, d):
    """Steps of every proof's paths between the first and the latest index of its repository: preserved, removed, added or unresolved."""
    c, b = chunks(spark, d), table(spark, d, "evidence_bundles")
    docs = RP.proof_docs(b).where("repo is not null")
    steps = docs.select("bundle_no", "repo", F.explode("doc.paths").alias("p")).select("bundle_no", "repo", F.inline(F.transform(F.sequence(F.lit(1), F.greatest(F.size("p") - 1, F.lit(1))), lambda i: F.struct(F.get("p", i - 1).alias("a"), F.get("p", i).alias("b"))))).where("b is not null")
    steps = checkpointed(steps)
    none = F.array().cast("array<string>")

    def known(latest: bool, name: str) -> DataFrame:
        u = G.units(c, latest)
        e = RP.links(u, G.edges(u)).where("kind = 'route_path'").select("repo", "a", "b").distinct()
        return e.withColumn(name, F.lit(True))

    j = steps.join(known(False, "before"), ["repo", "a", "b"], "left").join(known(True, "after"), ["repo", "a", "b"], "left")
    was, now = F.col("before").isNotNull(), F.col("after").isNotNull()
    status = F.when(was & now, "preserved").when(was, "removed").when(now, "added").otherwise("unresolved")
    g = j.withColumn("status", status).groupBy("bundle_no").agg(*(F.count_if(F.col("status") == x).alias(x) for x in ("preserved", "removed", "added", "unresolved")))
    return g.withColumn("verdict", F.when(F.col("removed") + F.col("unresolved") > 0, "broken_path_found").otherwise("no_graph_delta"))


def proof_successors(spark, d):
    """Units of the latest index that may have taken the place of each proof's target in the first one."""
    c, docs = chunks(spark, d), checkpointed(RP.proof_docs(table(spark, d, "evidence_bundles")).where("repo is not null"))
    first, last = G.units(c, False), checkpointed(G.units(c))
    targets = docs.where("doc.top_hit <> ''").select("bundle_no", "repo", F.col("doc.top_hit").alias("target"))
    text = c.select(F.col("chunk_no").alias("node"), "text")
    shape = lambda u: u.select("repo", "node", T.label_of(F.col("relpath"), F.col("symbol_name")).alias("label"), "relpath", F.col("symbol_name").alias("symbol"), F.col("symbol_kind").alias("kind"), "calls")
    edges = checkpointed(G.edges(last))
    labels = shape(last).select("repo", "node", "label")
    literal = docs.select("bundle_no", "repo", F.explode("doc.routes").alias("route"))
    starts = literal.join(last.select("repo", F.col("node").alias("start"), F.col("route_path").alias("route")), ["repo", "route"]).select("bundle_no", "start")
    starts = checkpointed(starts.unionByName(literal.join(labels.select("repo", F.col("node").alias("start"), F.col("label").alias("route")), ["repo", "route"]).select("bundle_no", "start")).distinct())
    reached = starts.join(G.bounded_bfs(edges, starts.select("start", F.col("start").alias("node")).distinct(), 5, G.FANOUT_ROUTE), "start").select("bundle_no", "node", F.lit(True).alias("reached"), F.lit(False).alias("called"))
    steps = docs.select("bundle_no", "repo", F.col("doc.top_hit").alias("target"), F.explode("doc.paths").alias("p"))
    ahead = steps.select("bundle_no", "repo", F.get("p", (F.array_position("p", F.col("target")) - 2).cast("int")).alias("label")).where("label is not null").distinct()
    called = ahead.join(labels.withColumnRenamed("node", "source"), ["repo", "label"]).join(edges.where("label in ('calls', 'routes_to')").select("source", "target"), "source").select("bundle_no", F.col("target").alias("node"), F.lit(False).alias("reached"), F.lit(True).alias("called"))
    continued = checkpointed(reached.unionByName(called).groupBy("bundle_no", "node").agg(F.bool_or("reached").alias("reached"), F.bool_or("called").alias("called")))
    old = shape(first).join(targets.select("repo", F.col("target").alias("label")).distinct(), ["repo", "label"], "left_semi")
    new = shape(last).join(continued.select("node").distinct(), "node", "left_semi")
    with_text = lambda u: u.join(narrowed(text, u, ["node"]), "node")
    return V.successors(targets, with_text(old), with_text(new), continued)


def migration_ops(spark, d):
    """Replacements that would move each proof to its best successor: JSON pointers into the payload where the old target stands, and the new label."""
    b = table(spark, d, "evidence_bundles")
    best = checkpointed(proof_successors(spark, d).where("rank = 1").select("bundle_no", "target", "candidate"))
    few = b.join(best.select("bundle_no"), "bundle_no", "left_semi")
    rows = flatten_bundles(few, ("proof.supporting_paths.path", "evidence"))
    at = F.transform(F.split("pos_path", "[.]"), lambda p: (p.cast("int") - 1).cast("string"))
    path = F.concat(F.lit("/proof/supporting_paths/"), F.get(at, 0), F.lit("/path/"), F.get(at, 1))
    evidence = F.concat(F.lit("/evidence/"), F.get(at, 0), F.lit("/source_label"))
    held = F.when(F.col("child") == "evidence", members(F.col("value"), "source_label")["source_label"]).otherwise(F.col("value"))
    ops = rows.select(F.col("record_no").alias("bundle_no"), F.when(F.col("child") == "evidence", evidence).otherwise(path).alias("path"), held.alias("held")).join(best, "bundle_no").where("held = target").select("bundle_no", "path", F.col("candidate").alias("value"))
    return best.select("bundle_no", F.lit("/proof/top_hit").alias("path"), F.col("candidate").alias("value")).unionByName(ops).select("bundle_no", F.lit("replace").alias("op"), "path", "value")


def temporal_scorecard(spark, d):
    """Over all proofs: how many hold, broke, mended or never held, and of those that no longer hold how many have a successor."""
    s = temporal_status(spark, d).select("bundle_no", "status")
    best = proof_successors(spark, d).where("rank = 1").select("bundle_no", F.lit(True).alias("succeeded"))
    g = s.join(best, "bundle_no", "left").groupBy("status").agg(F.count("*").alias("proofs"), F.count_if("succeeded").alias("with_successor"))
    return g.withColumn("abstained", F.col("proofs") - F.col("with_successor"))


QUERIES = {f.__name__: f for f in (proof_replay, mutation_lab, mutation_detection, proof_scorecard, court_verdict, court_agents, contract_checks, temporal_status, pr_guard, guard_annotations, graph_delta, proof_successors, migration_ops, temporal_scorecard)}

# ---------------------------------------------------------------- comparison SQL
_FALSE = "('', 'false', '0', 'null')"
_PROOF = f"""pd AS (SELECT no AS bundle_no, {S.repo('b.repo_root')} AS rp, {_MEM('j', 'proof', 'status')}->>'$' AS status, coalesce({_MEM('j', 'proof', 'top_hit')}->>'$', '') AS top_hit, j FROM bd JOIN evidence_bundles b ON b.bundle_no = bd.no WHERE json_type(j) = 'OBJECT'),
  p0 AS (SELECT *, coalesce(rp, '') AS repo FROM pd),
  rl AS (SELECT bundle_no, r FROM (SELECT bundle_no, unnest({_LS(_MEM('j', 'proof', 'route_literals'))})->>'$' AS r FROM p0) WHERE r <> ''),
  pp AS (SELECT no AS bundle_no, outer_pos, v->>'$' AS x FROM {_INNER(_BR['proof.supporting_paths'], 'path')}),
  pc AS (SELECT no AS bundle_no, count(*) AS n FROM {_BR['proof.supporting_paths']} GROUP BY ALL),
  ep AS (SELECT no AS bundle_no, row_number() OVER (PARTITION BY no ORDER BY pos) AS i, coalesce({_X('source_label')}, '') AS label, coalesce({_X('snippet')}, '') AS snippet FROM {_BR['evidence']}),
  ge AS (SELECT no AS bundle_no, coalesce({_X('source')}, '') AS source, coalesce({_X('target')}, '') AS target, coalesce({_X('label')}, '') AS label, coalesce({_X('route')}, {_X('source')}, '') AS route FROM {_BR['proof.proof_graph.edges']}),
  da AS (SELECT no AS bundle_no, row_number() OVER (PARTITION BY no ORDER BY pos) AS i, coalesce({_X('candidate')}, '') AS candidate, lower(coalesce({_X('rejected')}, '')) NOT IN {_FALSE} AS rejected FROM {_BR['proof.decoy_audit']}),
  fp AS (SELECT no AS bundle_no, min(pos) AS f FROM {_BR['proof.supporting_paths']} GROUP BY ALL),
  mu AS (SELECT unnest({[RP.BASELINE, *RP.MUTATIONS]!r}) AS mutation),
  edges2 AS (SELECT bundle_no, mutation, ge.source, ge.target, ge.label, ge.route FROM ge, mu UNION ALL SELECT bundle_no, 'proof_graph_edge_unverified', '{RP._EDGE['source']}', '{RP._EDGE['target']}', '{RP._EDGE['label']}', '{RP._EDGE['route']}' FROM p0),
  cl AS (SELECT bundle_no, mutation, 'top_hit_exists' AS chk, 'label' AS kind, CASE WHEN mutation = 'top_hit_missing' THEN '{RP._TOP}' ELSE top_hit END AS a, '' AS b, '' AS snip FROM p0, mu
    UNION ALL SELECT bundle_no, mutation, 'evidence_fingerprints_match', 'text', label, '', CASE WHEN mutation = 'evidence_snippet_drift' AND i = 1 THEN '{RP._SNIPPET}' ELSE snippet END FROM ep JOIN p0 USING (bundle_no), mu WHERE label <> ''
    UNION ALL SELECT bundle_no, mutation, 'route_literals_exist', 'route', r, '', '' FROM rl, mu WHERE mutation <> 'route_anchor_missing' UNION ALL SELECT bundle_no, 'route_anchor_missing', 'route_literals_exist', 'route', '{RP._ROUTE}', '', '' FROM p0
    UNION ALL SELECT bundle_no, mutation, 'supporting_paths_exist', 'label', x, '', '' FROM pp JOIN p0 USING (bundle_no), mu UNION ALL SELECT bundle_no, 'supporting_path_missing', 'supporting_paths_exist', 'label', '{RP._NODE}', '', '' FROM fp JOIN p0 USING (bundle_no)
    UNION ALL SELECT bundle_no, mutation, 'proof_graph_edges_resolve', 'end', unnest([source, target]), '', '' FROM edges2 JOIN p0 USING (bundle_no)
    UNION ALL SELECT bundle_no, mutation, 'proof_graph_edges_verified', label, CASE WHEN label = 'anchors' THEN route ELSE source END, target, '' FROM edges2 JOIN p0 USING (bundle_no) WHERE label IN ('anchors', 'route_path')
    UNION ALL SELECT bundle_no, mutation, 'decoy_audit_still_rejected', CASE WHEN rejected AND NOT (mutation = 'decoy_audit_stale' AND i = 1) THEN 'label' ELSE 'open' END, candidate, '', '' FROM da JOIN p0 USING (bundle_no), mu)"""
_LABEL = "relpath || CASE WHEN symbol_name <> '' THEN ':' || symbol_name ELSE '' END"
_TRIM = lambda x: f"regexp_replace(replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '^\\s+|\\s+$', '', 'g')"
_HELD = f"""lb AS (SELECT repo, label, coalesce(text, '') AS text FROM (SELECT repo, {_LABEL} AS label, text, row_number() OVER (PARTITION BY repo, {_LABEL} ORDER BY (text IS NULL), chunk_no DESC) AS rn FROM c WHERE repo IS NOT NULL) WHERE rn = 1),
  ul AS (SELECT repo, node, {_LABEL} AS label, route_path FROM u), rt AS (SELECT DISTINCT repo, route_path AS a FROM ul WHERE route_path <> ''),
  el AS (SELECT e.repo, s.label AS a, t.label AS b, s.route_path, e.label AS edge FROM e JOIN ul s ON s.repo = e.repo AND s.node = e.source JOIN ul t ON t.repo = e.repo AND t.node = e.target WHERE e.label IN ('routes_to', 'calls', 'imports')),
  lk AS (SELECT DISTINCT * FROM (SELECT repo, 'route_path' AS kind, a, b FROM el UNION ALL SELECT repo, 'route_path', b, a FROM el UNION ALL SELECT repo, 'anchors', route_path, label FROM ul WHERE route_path <> '' UNION ALL SELECT repo, 'anchors', route_path, b FROM el WHERE edge <> 'imports' AND route_path <> '')),
  st AS (SELECT cl.*, lb.text, rt.a AS routed, lk.b AS linked, {_TRIM('snip')} AS said, {_TRIM("coalesce(lb.text, '')")} AS now FROM cl JOIN p0 USING (bundle_no) LEFT JOIN lb ON lb.repo = p0.repo AND lb.label = cl.a LEFT JOIN rt ON rt.repo = p0.repo AND rt.a = cl.a LEFT JOIN lk ON lk.repo = p0.repo AND lk.kind = cl.kind AND lk.a = cl.a AND lk.b = cl.b WHERE NOT (cl.kind = 'end' AND cl.a = '')),
  bad AS (SELECT DISTINCT bundle_no, mutation, chk FROM st WHERE NOT CASE kind WHEN 'label' THEN text IS NOT NULL WHEN 'text' THEN text IS NOT NULL AND (said = '' OR CASE WHEN said LIKE '%...' THEN starts_with(now, regexp_replace(said, '\\s*\\.\\.\\.$', '')) ELSE said = now END) WHEN 'route' THEN routed IS NOT NULL WHEN 'end' THEN text IS NOT NULL OR routed IS NOT NULL WHEN 'open' THEN false ELSE linked IS NOT NULL END),
  rp AS (SELECT p0.bundle_no, mu.mutation, list_sort(list(chk) FILTER (chk IS NOT NULL)) AS failed FROM p0 CROSS JOIN mu LEFT JOIN bad ON bad.bundle_no = p0.bundle_no AND bad.mutation = mu.mutation GROUP BY ALL),
  rf AS (SELECT bundle_no, mutation, coalesce(failed, []) AS failed FROM rp), bs AS (SELECT bundle_no, failed AS base FROM rf WHERE mutation = '{RP.BASELINE}'),
  fu2 AS (SELECT bs.bundle_no, base, complete, status, top_hit, (SELECT count(*) FROM rl WHERE rl.bundle_no = bs.bundle_no) AS routes, (SELECT count(*) FROM da WHERE da.bundle_no = bs.bundle_no) AS decoys, coalesce((SELECT n FROM pc WHERE pc.bundle_no = bs.bundle_no), 0) AS paths
    FROM bs JOIN p0 USING (bundle_no) JOIN (SELECT bundle_no, bool_and(mutation = '{RP.BASELINE}' OR len(failed) > 0) AS complete FROM rf GROUP BY ALL) USING (bundle_no))"""
_REPLAY = S.with_(_DOCS, _E, _PROOF, _HELD)
_GRADE = lambda x, steps: "CASE " + " ".join(f"WHEN {x} >= {n} THEN '{g}'" for g, n in steps) + " ELSE 'F' END"
_W = RP.WEIGHTS
_CLAIMED = f"""ct AS (SELECT bundle_no, ord, agent, weight, passed FROM (SELECT *, unnest([{', '.join("{'ord': " + str(i) + f", 'agent': '{a}', 'weight': {w}, 'passed': {p}}}" for i, ((a, _, w), p) in enumerate(zip(RP.CLAIMS, ("coalesce(status = 'proved', false) AND top_hit <> ''", 'routes > 0 AND paths > 0', 'len(base) = 0', 'complete')), 1))}], recursive := true) FROM fu2))"""
_INV = "iv AS (SELECT * FROM (VALUES " + ", ".join(f"('{i}', '{lv}', {repr(c) if c else 'NULL'})" for i, lv, c in RP.INVARIANTS) + ") AS t(invariant, level, chk))"
_CHECKED = "cc AS (SELECT bundle_no, invariant, level, CASE WHEN chk IS NULL THEN len(base) = 0 ELSE NOT list_contains(base, chk) END AS passed FROM bs, iv)"
_RELPATH = lambda x: rf"regexp_replace(replace(split_part({x}, ':', 1), '\', '/'), '^(?:\./)+', '')"
_TOUCH = f"""sf AS (SELECT repo, bundle_no, protected, max(own) AS own, max(routed) AS routed FROM (SELECT rp AS repo, bundle_no, {_RELPATH('top_hit')} AS protected, 1 AS own, (SELECT count(*) FROM rl WHERE rl.bundle_no = p0.bundle_no) > 0 AS routed FROM p0 WHERE top_hit <> ''
    UNION ALL SELECT DISTINCT rp, bundle_no, {_RELPATH('x')}, 0, (SELECT count(*) FROM rl WHERE rl.bundle_no = p0.bundle_no) > 0 FROM pp JOIN p0 USING (bundle_no)) WHERE repo IS NOT NULL AND protected <> '' GROUP BY ALL),
  rn2 AS (SELECT DISTINCT run_no, repo, relpath FROM (SELECT run_no, {S.repo('repo_root')} AS repo, regexp_replace(replace(trim(file), '\\', '/'), '^(?:\\./)+', '') AS relpath FROM (SELECT run_no, repo_root, unnest(changed_files) AS file FROM engineering_runs)) WHERE relpath <> ''),
  tc AS (SELECT run_no, relpath, bundle_no, protected, CASE WHEN own = 0 THEN 'proof_supporting_path' WHEN routed THEN 'route_exposed_target' ELSE 'proved_target_file' END AS surface FROM rn2 JOIN sf USING (repo) WHERE relpath = protected OR ends_with(relpath, '/' || protected))"""
_FIRST = _REPLAY.replace("ORDER BY chunk_no DESC", "ORDER BY chunk_no").replace("(text IS NULL), chunk_no DESC", "(text IS NULL), chunk_no")
_EDGES_AT = lambda first: (S.with_(_E, _HELD.split("ul AS", 1)[0].replace("lb AS", "lb0 AS").rstrip(", \n") + ", ul AS" + _HELD.split("ul AS", 1)[1].split("st AS", 1)[0].rstrip(", \n"))).replace(*(("ORDER BY chunk_no DESC", "ORDER BY chunk_no") if first else ("", "")))
ORACLES = {
    "temporal_status": f"""SELECT bundle_no, CASE WHEN len(t) = 0 AND len(n) = 0 THEN 'valid_across_history' WHEN len(t) = 0 THEN 'regression_found' WHEN len(n) = 0 THEN 'recovered' ELSE 'always_failing' END AS status,
      array_to_string(list_filter(n, lambda x: NOT list_contains(t, x)), ',') AS broken, array_to_string(list_filter(t, lambda x: NOT list_contains(n, x)), ',') AS mended FROM ({_FIRST} SELECT bundle_no, base AS t FROM bs) a JOIN ({_REPLAY} SELECT bundle_no, base AS n FROM bs) b USING (bundle_no)""",
    "graph_delta": f"""WITH {_DOCS}, {_PROOF}, sq AS (SELECT bundle_no, rp AS repo, x AS a, lead(x) OVER (PARTITION BY bundle_no, outer_pos ORDER BY pos) AS b FROM (SELECT no AS bundle_no, outer_pos, pos, v->>'$' AS x FROM {_INNER(_BR['proof.supporting_paths'], 'path')}) JOIN p0 USING (bundle_no)),
      jn AS (SELECT sq.bundle_no, w.a IS NOT NULL AS was, n.a IS NOT NULL AS now FROM sq LEFT JOIN (SELECT DISTINCT repo, a, b FROM ({_EDGES_AT(True)} SELECT repo, a, b FROM lk WHERE kind = 'route_path')) w ON w.repo = sq.repo AND w.a = sq.a AND w.b = sq.b LEFT JOIN (SELECT DISTINCT repo, a, b FROM ({_EDGES_AT(False)} SELECT repo, a, b FROM lk WHERE kind = 'route_path')) n ON n.repo = sq.repo AND n.a = sq.a AND n.b = sq.b WHERE sq.b IS NOT NULL AND sq.repo IS NOT NULL)
      SELECT *, CASE WHEN removed + unresolved > 0 THEN 'broken_path_found' ELSE 'no_graph_delta' END AS verdict FROM (SELECT bundle_no, count(*) FILTER (was AND now) AS preserved, count(*) FILTER (was AND NOT now) AS removed, count(*) FILTER (now AND NOT was) AS added, count(*) FILTER (NOT was AND NOT now) AS unresolved FROM jn GROUP BY bundle_no)""",
    "proof_replay": _REPLAY + "SELECT bundle_no, unnest(base) AS check FROM bs",
    "mutation_lab": _REPLAY + f"SELECT bundle_no, mutation, array_to_string(failed, ',') AS failed FROM rf WHERE mutation <> '{RP.BASELINE}'",
    "mutation_detection": _REPLAY + f"SELECT mutation, count(*) AS bundles, count(*) FILTER (len(failed) > 0) AS detected, round(avg((len(failed) > 0)::INT), 3) AS rate, count(*) FILTER (len(base) = 0) AS valid_before, count(*) FILTER (len(list_filter(failed, lambda x: NOT list_contains(base, x))) > 0) AS newly_failed FROM rf JOIN bs USING (bundle_no) WHERE mutation <> '{RP.BASELINE}' GROUP BY ALL",
    "proof_scorecard": _REPLAY + f", s AS (SELECT bundle_no, (CASE WHEN coalesce(status = 'proved', false) THEN {_W['proof_proved']} ELSE 0 END + CASE WHEN len(base) = 0 THEN {_W['strict_replay_valid']} ELSE 0 END + CASE WHEN NOT list_contains(base, 'evidence_fingerprints_match') THEN {_W['evidence_fingerprints_match']} ELSE 0 END + CASE WHEN NOT list_contains(base, 'proof_graph_edges_verified') THEN {_W['proof_edges_verified']} ELSE 0 END + CASE WHEN decoys > 0 THEN {_W['decoy_audit_present']} ELSE 0 END + CASE WHEN complete THEN {_W['mutation_detection_complete']} ELSE 0 END)::INT AS score FROM fu2) SELECT bundle_no, score, {_GRADE('score', RP.GRADES)} AS grade, CASE WHEN score >= 85 THEN 'pass' WHEN score >= 70 THEN 'warn' ELSE 'fail' END AS status FROM s",
    "court_verdict": _REPLAY + f", {_CLAIMED}, s AS (SELECT bundle_no, round(sum(CASE WHEN passed THEN weight ELSE 0 END) * 100.0 / sum(weight))::INT AS score, count(*) FILTER (passed) AS passed_claims, bool_and(passed) AS allp FROM ct GROUP BY ALL) SELECT bundle_no, score, {_GRADE('score', RP.COURT_GRADES)} AS grade, passed_claims, (decoys + len(base))::INT AS challenges, len(base)::INT AS open_challenges, CASE WHEN allp AND len(base) = 0 AND score >= 90 THEN 'accepted' WHEN score >= 70 THEN 'needs_review' ELSE 'rejected' END AS status FROM s JOIN fu2 USING (bundle_no)",
    "court_agents": _REPLAY + f", {_CLAIMED} SELECT agent, min(ord)::INT AS first, count(*) AS claims, count(*) FILTER (passed) AS passed FROM ct GROUP BY ALL",
    "edge_between": S.with_(_DOCS, _E, _PROOF) + f""", sq AS (SELECT DISTINCT rp AS repo, a, b FROM (SELECT bundle_no, x AS a, lead(x) OVER (PARTITION BY bundle_no, outer_pos ORDER BY pos) AS b FROM pp2) JOIN p0 USING (bundle_no) WHERE b IS NOT NULL AND rp IS NOT NULL), un AS (SELECT repo, node, {_LABEL} AS l FROM u)
      SELECT repo, a, b, label, weight FROM (SELECT sq.*, eb.label, eb.weight, row_number() OVER (PARTITION BY sq.repo, a, b ORDER BY eb.weight DESC, eb.label DESC) AS rn FROM sq JOIN un s ON s.repo = sq.repo AND s.l = a JOIN un t ON t.repo = sq.repo AND t.l = b JOIN eb ON eb.source = s.node AND eb.target = t.node) WHERE rn = 1""".replace("pp2", f"(SELECT no AS bundle_no, outer_pos, pos, v->>'$' AS x FROM {_INNER(_BR['proof.supporting_paths'], 'path')})"),
    "find_chunk": S.with_(_DOCS, S.CHUNKS, _EV, _EVR) + f""", a AS (SELECT DISTINCT repo, label AS target FROM er WHERE label IS NOT NULL AND repo IS NOT NULL), k AS (SELECT repo, chunk_no, chunk_id, {_LABEL} AS lab, symbol_name FROM c WHERE repo IS NOT NULL),
      m AS (SELECT a.repo, target, chunk_no, CASE WHEN chunk_id = target THEN 1 WHEN lab = target THEN 2 ELSE 3 END AS priority FROM a JOIN k ON k.repo = a.repo AND (chunk_id = target OR lab = target OR lower(lab) = lower(target) OR (lower(symbol_name) = lower(target) AND symbol_name <> '')))
      SELECT repo, target, chunk_no, priority::INT AS priority FROM (SELECT *, row_number() OVER (PARTITION BY repo, target ORDER BY priority, chunk_no) AS rn FROM m) WHERE rn = 1""",
    "contract_checks": _REPLAY + f", {_INV}, {_CHECKED} SELECT * FROM cc",
    "pr_guard": _REPLAY + f", {_INV}, {_CHECKED}, {_TOUCH} SELECT run_no, bundle_no, count(DISTINCT relpath) AS touched_files, min(surface) AS surface, CASE WHEN min(ok::INT) = 0 THEN 'fail' ELSE 'warn' END AS status, (min(ok::INT) = 0)::INT AS exit_on_fail, 1 AS exit_on_warn FROM tc JOIN (SELECT bundle_no, bool_and(passed) AS ok FROM cc GROUP BY ALL) USING (bundle_no) GROUP BY run_no, bundle_no",
    "guard_annotations": S.with_(_DOCS, _PROOF, _TOUCH) + "SELECT DISTINCT run_no, relpath, '::warning file=' || relpath || '::' || replace(replace(replace(replace(replace(surface || ': ' || protected, '%', '%25'), chr(13), '%0D'), chr(10), '%0A'), ':', '%3A'), ',', '%2C') AS annotation FROM tc",
}
for _k, _v in ORACLES.items():
    ORACLES[_k] = _v.replace("\n, ", ",\n  ")
