"""Evidence queries over bundles, runs and events, with comparison SQL that reads the same JSON on its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from lodestone.functions import text as T
from lodestone.operators import evidence as V
from lodestone.operators.flatten import TABLES, flatten_bundles, flatten_runs
from lodestone.operators.lineage import narrowed
from lodestone.sources.tables import chunks, table

from . import sql as S


def _bundles(spark, d) -> DataFrame:
    return table(spark, d, "evidence_bundles")


def missing_refs(spark, d):
    """Evidence labels that name no current chunk of the bundle's repository."""
    b = _bundles(spark, d)
    e = V.with_repo(V.evidence_rows(b), b).where("label is not null")
    return e.join(V.current_labels(chunks(spark, d)), ["repo", "label"], "left_anti").select("bundle_no", "pos", "label")


def snippet_drift(spark, d):
    b = _bundles(spark, d)
    e = V.with_repo(V.evidence_rows(b), b)
    return V.snippet_drift(e, V.current_labels(chunks(spark, d), e))


def drift_diagnosis(spark, d):
    return V.drift_of(V.check_rows(_bundles(spark, d)))


def diagnostics(spark, d):
    b = _bundles(spark, d)
    return V.diagnostics(V.evidence_rows(b), V.edge_rows(b))


def adjacent_steps(spark, d):
    """Consecutive labels of every supporting path as edges."""
    rows = flatten_bundles(_bundles(spark, d), ("proof.supporting_paths.path",))
    p = rows.select("record_no", F.expr("cast(split(pos_path, '[.]')[0] as int)").alias("path"), F.expr("cast(split(pos_path, '[.]')[1] as int)").alias("pos"), "value")
    nxt = F.lead("value").over(W.partitionBy("record_no", "path").orderBy("pos"))
    return p.withColumn("target", nxt).where("target is not null").groupBy(F.col("value").alias("source"), "target").agg(F.count("*").alias("steps"))


def trace_steps(spark, d):
    """Steps of every run's timeline; whether the stored step number is its position."""
    rows = flatten_runs(table(spark, d, "engineering_runs"), ("timeline",))
    return rows.select(F.col("record_no").alias("run_no"), F.col("pos_path").cast("int").alias("pos"), F.get_json_object("value", "$.agent").alias("agent"), F.get_json_object("value", "$.status").alias("status"), F.coalesce(F.get_json_object("value", "$.step") == F.col("pos_path"), F.lit(False)).alias("in_place"))


def verifier_summary(spark, d):
    """Commands per run that passed, failed or gave no exit code, and what follows."""
    rows = flatten_runs(table(spark, d, "engineering_runs"), ("timeline.details.commands",))
    code = F.get_json_object("value", "$.exit_code")
    g = rows.groupBy(F.col("record_no").alias("run_no")).agg(F.count_if(code == "0").alias("passed"), F.count_if(code != "0").alias("failed"), F.count_if(code.isNull()).alias("missing"))
    return g.withColumn("verdict", F.when(F.col("failed") > 0, "failed").when(F.col("missing") > 0, "incomplete").otherwise("passed"))


def successor_jaccard(spark, d):
    """Files analysed again with another text: Jaccard similarity of the distinct tokens of both."""
    f = table(spark, d, "file_analysis").select("file_no", "repo_root", "relpath", "source_text")
    f = narrowed(f, f.groupBy("repo_root", "relpath").agg(F.count("*").alias("n")).where("n > 1"), ["repo_root", "relpath"])
    w = W.partitionBy("repo_root", "relpath").orderBy("file_no")
    twice = f.withColumn("before", F.lag("source_text").over(w)).where("before is not null and before <> source_text")
    a, b = F.array_distinct(T.tokenize(F.col("before"))), F.array_distinct(T.tokenize(F.col("source_text")))
    j = twice.select("file_no", a.alias("a"), b.alias("b"))
    return j.select("file_no", F.round(F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b")), 6).alias("jaccard"))


def first_failure(spark, d):
    """Per user, the first error event, the last event before it, and how many came before; sums combine map-side, no user's events meet in one window."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", F.struct("ts", "event_id").alias("at"))
    first = e.where("event_type = 'error'").groupBy("user_id").agg(F.min("at").alias("first"))
    before = e.join(first, "user_id").where("at < first").groupBy("user_id").agg(F.max("at").alias("last"), F.count("*").alias("before"))
    return first.join(before, "user_id", "left").select("user_id", F.col("first.event_id").alias("first_error"), F.col("last.event_id").alias("last_good"), F.coalesce("before", F.lit(0)).cast("int").alias("before"))


def regression_status(spark, d):
    """Whether a user's events turn to errors, fail from the start, or never fail."""
    e = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id")
    g = e.groupBy("user_id").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("first"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count("*").alias("n"))
    return g.select("user_id", "errors", F.when(F.col("errors") == 0, "valid_across_history").when(F.col("errors") == F.col("n"), "always_failing").when(F.col("first") == "error", "recovered").otherwise("regression_found").alias("status"))


def html_links(spark, d):
    """Links of stored HTML files, in order, first spelling only, without the static prefix."""
    f = table(spark, d, "file_analysis").where(F.lower(F.col("relpath")).endswith(".html"))
    raw = F.regexp_extract_all("source_text", F.lit(r"""(?i)(?:src|href)=['"]([^'"]+)['"]"""), F.lit(1))
    clean = F.transform(raw, lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), r"\\", "/"), "^/static/", ""))
    return f.select("file_no", F.posexplode(T.ordered_unique(clean)).alias("pos", "link"))


def css_imports(spark, d):
    f = table(spark, d, "file_analysis").where(F.lower(F.col("relpath")).endswith(".css"))
    raw = F.regexp_extract_all("source_text", F.lit(r"""(?i)@import\s+(?:url\()?['"]?([^'")]+)"""), F.lit(1))
    clean = F.transform(raw, lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), r"\\", "/"), "^/static/", ""))
    return f.select("file_no", F.posexplode(T.ordered_unique(clean)).alias("pos", "link"))


def ordered_dedupe(spark, d):
    """Call names of chunks without repeats in another case."""
    return chunks(spark, d).select("chunk_no", F.array_join(T.ordered_unique(F.concat("calls", "refs", "handler_names")), ",").alias("names"))


def impacted_files(spark, d):
    """Evidence files of each bundle with their symbols."""
    e = V.evidence_rows(_bundles(spark, d)).where("relpath is not null")
    return e.groupBy("bundle_no", "relpath").agg(F.count("*").alias("nodes"), F.array_join(F.array_sort(F.array_distinct(F.collect_list(F.coalesce("symbol_name", F.lit(""))))), ",").alias("symbols"))  # an evidence list


def run_pass_rate(spark, d):
    """Runs by execution mode; skipped and unknown ones stay out of the rate."""
    r = table(spark, d, "engineering_runs").select(F.coalesce("execution_mode", F.lit("?")).alias("mode"), F.lower(F.trim("status")).alias("s"))
    return r.groupBy("mode").agg(F.count("*").alias("runs"), F.count_if(F.col("s") == "completed").alias("completed"), F.round(F.avg(F.when(F.col("s").isin("completed", "failed"), (F.col("s") == "completed").cast("double"))), 5).alias("pass_rate"))


QUERIES = {f.__name__: f for f in (missing_refs, snippet_drift, drift_diagnosis, diagnostics, adjacent_steps, trace_steps, verifier_summary, successor_jaccard, first_failure, regression_status, html_links, css_imports, ordered_dedupe, impacted_files, run_pass_rate)}

# ---------------------------------------------------------------- comparison SQL
_IN = lambda x: f"CASE WHEN json_type({x}) = 'VARCHAR' AND json_valid({x}->>'$') THEN CAST({x}->>'$' AS JSON) ELSE {x} END"
_LS = lambda x: f"(CASE json_type({_IN(x)}) WHEN 'ARRAY' THEN json_extract({_IN(x)}, '$[*]') WHEN 'OBJECT' THEN [{_IN(x)}] END)"
_MEM = lambda x, *names: x if not names else _MEM(f"json_extract({_IN(x)}, '$.{names[0]}')", *names[1:])


def _doc(tab: str, key: str, col: str) -> str:
    return f"(SELECT {key} AS no, {_IN('j')} AS j FROM (SELECT {key}, {_IN('j')} AS j FROM (SELECT {key}, CASE WHEN json_valid({col}) THEN CAST({col} AS JSON) END AS j FROM {tab})) WHERE j IS NOT NULL)"


def _rows(source: str, list_sql: str, keep: str = "no") -> str:
    """keep, pos, v of the non-null elements of a list."""
    return f"(SELECT {keep}, pos, v FROM (SELECT {keep}, unnest(l) AS v, unnest(range(1, len(l) + 1)) AS pos FROM (SELECT {keep}, {list_sql} AS l FROM {source})) WHERE v IS NOT NULL AND json_type(v) <> 'NULL')"


_B, _R = _doc("evidence_bundles", "bundle_no", "payload"), _doc("engineering_runs", "run_no", "timeline")
_PATHS = {"evidence": ("evidence",), "graph_edges": ("graph_edges",), "proof.checks": ("proof", "checks"), "proof.supporting_paths": ("proof", "supporting_paths"), "proof.proof_graph.nodes": ("proof", "proof_graph", "nodes"), "proof.proof_graph.edges": ("proof", "proof_graph", "edges"), "proof.decoy_audit": ("proof", "decoy_audit")}
_BR = {c: _rows("bd", _LS(_MEM("j", *p))) for c, p in _PATHS.items()}
_INNER = lambda rows, name: f"(SELECT no, outer_pos, pos, v FROM (SELECT no, outer_pos, unnest(l) AS v, unnest(range(1, len(l) + 1)) AS pos FROM (SELECT no, pos AS outer_pos, {_LS(_MEM('v', name))} AS l FROM {rows})) WHERE v IS NOT NULL AND json_type(v) <> 'NULL')"
_STEPS = _rows("rd", _LS("j"))
_CMD = f"(SELECT no, a, pos, v FROM (SELECT no, a, unnest(l) AS v, unnest(range(1, len(l) + 1)) AS pos FROM (SELECT no, pos AS a, {_LS(_MEM('v', 'details', 'commands'))} AS l FROM {_STEPS})) WHERE v IS NOT NULL AND json_type(v) <> 'NULL')"
_FIND = _CMD.replace("commands", "findings")
_FAIL = f"(SELECT no, a, b, pos FROM (SELECT no, a, b, unnest(l) AS v, unnest(range(1, len(l) + 1)) AS pos FROM (SELECT no, a, pos AS b, {_LS(_MEM('v', 'failures'))} AS l FROM {_CMD})) WHERE v IS NOT NULL AND json_type(v) <> 'NULL')"
_DOCS = f"bd AS (SELECT * FROM {_B}), rd AS (SELECT * FROM {_R})"
P4 = "WITH " + _DOCS + " " + " UNION ALL ".join([
    *(f"SELECT 'bundle' AS record_kind, no AS record_no, '{c}' AS child, pos::VARCHAR AS pos_path FROM {r}" for c, r in _BR.items()),
    f"SELECT 'bundle', no, 'proof.supporting_paths.path', outer_pos || '.' || pos FROM {_INNER(_BR['proof.supporting_paths'], 'path')}", f"SELECT 'bundle', no, 'proof.proof_graph.nodes.roles', outer_pos || '.' || pos FROM {_INNER(_BR['proof.proof_graph.nodes'], 'roles')}",
    f"SELECT 'run', no, 'timeline', pos::VARCHAR FROM {_STEPS}", f"SELECT 'run', no, 'timeline.details.commands', a || '.' || pos FROM {_CMD}", f"SELECT 'run', no, 'timeline.details.findings', a || '.' || pos FROM {_FIND}", f"SELECT 'run', no, 'timeline.details.commands.failures', a || '.' || b || '.' || pos FROM {_FAIL}"])
_X = lambda name: f"({_MEM('v', name)}->>'$')"
_FAILS = f"(SELECT no, a, b, v, pos FROM (SELECT no, a, b, unnest(l) AS v, unnest(range(1, len(l) + 1)) AS pos FROM (SELECT no, a, pos AS b, {_LS(_MEM('v', 'failures'))} AS l FROM {_CMD})) WHERE v IS NOT NULL AND json_type(v) <> 'NULL')"
_NESTED = {
    "proof.supporting_paths.path": (_INNER(_BR["proof.supporting_paths"], "path"), "outer_pos::VARCHAR"), "proof.proof_graph.nodes.roles": (_INNER(_BR["proof.proof_graph.nodes"], "roles"), "outer_pos::VARCHAR"), "timeline": (_STEPS, "''"),
    "timeline.details.commands": (_CMD, "a::VARCHAR"), "timeline.details.findings": (_FIND, "a::VARCHAR"), "timeline.details.commands.failures": (_FAILS, "a || '.' || b"),
}


def _member(field: str) -> str:
    name, kind = field.split() if " " in field else (field, "string")
    if kind == "list":
        return f"CASE WHEN json_type({_MEM('v', name)}) = 'ARRAY' THEN array_to_string(list_transform(json_extract({_MEM('v', name)}, '$[*]'), lambda x: x->>'$'), ',') END AS {name}"
    return f"try_cast({_X(name)} AS {kind}) AS {name}" if kind in ("int", "double", "boolean") else f"{_X(name)} AS {name}"


def _table_sql(child: str, *fields: str) -> str:
    source, parent = _NESTED.get(child) or (_BR[child], "''")
    return f"WITH {_DOCS} SELECT no AS record_no, {parent} AS parent_path, pos::INT AS pos, {', '.join(map(_member, fields)) or 'v->>' + repr('$') + ' AS value'} FROM {source}"


_EV = f"ev AS (SELECT no AS bundle_no, pos::INT AS pos, {_X('source_label')} AS label, {_X('relpath')} AS relpath, {_X('symbol_name')} AS symbol_name, {_X('route_path')} AS route_path, try_cast({_X('score')} AS DOUBLE) AS score, {_X('snippet')} AS snippet, {_MEM('v', 'matched_terms')} AS mt FROM {_BR['evidence']})"
_EVR = f"er AS (SELECT ev.*, {S.repo('b.repo_root')} AS repo FROM ev JOIN evidence_bundles b USING (bundle_no))"
_NORM = lambda x: f"regexp_replace(replace({x}, chr(13) || chr(10), chr(10)), '^\\s+|\\s+$', '', 'g')"
_ED = f"ed AS (SELECT no AS bundle_no, pos, {_X('source')} AS source, {_X('target')} AS target, {_X('label')} AS label FROM {_BR['graph_edges']})"
_CK = f"ck AS (SELECT no AS bundle_no, {_X('name')} AS name, lower({_X('passed')}) = 'true' AS passed FROM {_BR['proof.checks']})"


def _unique(l: str) -> str:  # noqa: E741
    """First spelling of each trimmed, non-blank value."""
    clean = f"list_filter(list_transform({l}, lambda x: trim(x)), lambda x: x <> '')"
    lows = f"list_transform({clean}, lambda x: lower(x))"
    return f"list_transform(list_filter(list_transform({clean}, lambda x, i: {{'v': x, 'i': i}}), lambda s: list_position({lows}, lower(s.v)) = s.i), lambda s: s.v)"


_SEVERITY = "(VALUES " + ", ".join(f"('{n}', '{t}', '{s}')" for n, (t, s) in V.DRIFT.items()) + ") AS dm(name, type, severity)"
_LINKS = lambda ext, pattern, clean: f"SELECT file_no, (pos - 1)::INT AS pos, l[pos] AS link FROM (SELECT file_no, l, unnest(range(1, len(l) + 1)) AS pos FROM (SELECT file_no, {_unique(clean.replace('@', 'regexp_extract_all(source_text, ' + pattern + ', 1)'))} AS l FROM file_analysis WHERE lower(relpath) LIKE '%{ext}'))"
ORACLES = {
    "p4_found": P4,
    **{name: _table_sql(*spec) for name, spec in TABLES.items()},
    "p4_counts": f"SELECT record_kind, child, count(*) AS rows, count(DISTINCT record_no) AS records FROM ({P4}) GROUP BY ALL",
    "missing_refs": S.with_(_DOCS, S.CHUNKS, _EV, _EVR) + "SELECT bundle_no, pos, label FROM er WHERE label IS NOT NULL AND NOT EXISTS (SELECT 1 FROM c WHERE c.repo = er.repo AND c.relpath || CASE WHEN c.symbol_name <> '' THEN ':' || c.symbol_name ELSE '' END = er.label)",
    "snippet_drift": S.with_(_DOCS, S.CHUNKS, _EV, _EVR, "lb AS (SELECT repo, label, text FROM (SELECT repo, relpath || CASE WHEN symbol_name <> '' THEN ':' || symbol_name ELSE '' END AS label, text, row_number() OVER (PARTITION BY repo, relpath || CASE WHEN symbol_name <> '' THEN ':' || symbol_name ELSE '' END ORDER BY chunk_no DESC) AS rn FROM c WHERE repo IS NOT NULL) WHERE rn = 1)") + f"""SELECT bundle_no, pos, CASE WHEN x IS NULL THEN 'missing' WHEN s = x THEN 'same' WHEN st <> s AND starts_with(x, st) THEN 'cut' ELSE 'drift' END AS status
      FROM (SELECT bundle_no, pos, s, x, regexp_replace(s, '\\s*(?:\\.\\.\\.|…)$', '') AS st FROM (SELECT bundle_no, pos, {_NORM('snippet')} AS s, {_NORM('lb.text')} AS x FROM er LEFT JOIN lb ON lb.repo = er.repo AND lb.label = er.label WHERE er.label IS NOT NULL))""",
    "drift_diagnosis": S.with_(_DOCS, _CK) + f"SELECT DISTINCT bundle_no, coalesce(type, 'unknown_drift') AS type, coalesce(severity, 'unknown') AS severity FROM ck LEFT JOIN {_SEVERITY} USING (name) WHERE NOT passed UNION ALL SELECT bundle_no, 'none', 'none' FROM ck GROUP BY bundle_no HAVING bool_and(passed)",
    "diagnostics": S.with_(_DOCS, _EV, _ED) + """, tm AS (SELECT bundle_no, count(DISTINCT t) AS terms FROM (SELECT bundle_no, unnest(CASE WHEN json_type(mt) = 'ARRAY' THEN json_extract_string(mt, '$[*]') ELSE [] END) AS t FROM (SELECT *, row_number() OVER (PARTITION BY bundle_no ORDER BY pos) AS i FROM ev) WHERE i <= 4) GROUP BY ALL), g AS (SELECT bundle_no, count(*) AS hits, max(score) FILTER (i = 1) AS top, max(score) FILTER (i = 2) AS second, count(DISTINCT relpath) AS files, count(*) FILTER (symbol_name <> '') AS symbols, count(*) FILTER (route_path <> '') AS routes
        FROM (SELECT *, row_number() OVER (PARTITION BY bundle_no ORDER BY pos) AS i FROM ev) GROUP BY ALL), h AS (SELECT g.*, coalesce(n, 0) AS edges, least(12, coalesce(terms, 0)) AS terms FROM g LEFT JOIN tm USING (bundle_no) LEFT JOIN (SELECT bundle_no, count(*) AS n FROM ed GROUP BY ALL) USING (bundle_no)),
      k AS (SELECT bundle_no, hits, files, edges, terms, 280 + CASE WHEN coalesce(top, 0) >= 18 THEN 220 WHEN coalesce(top, 0) >= 10 THEN 140 ELSE 60 END + CASE WHEN greatest(0, coalesce(top, 0) - coalesce(second, 0)) >= 6 THEN 160 WHEN hits > 1 THEN 60 ELSE 0 END + least(140, 35 * terms) + least(120, 35 * edges) + CASE WHEN files >= 2 THEN 60 ELSE 0 END + CASE WHEN symbols > 0 THEN 60 ELSE 0 END + CASE WHEN routes > 0 THEN 40 ELSE 0 END AS m FROM h)
      SELECT bundle_no, hits, files, edges, terms::INT AS terms, ((least(1000, m) + 5) // 10) / 100.0::DOUBLE AS confidence, CASE WHEN m >= 720 THEN 'high' WHEN m >= 450 THEN 'medium' ELSE 'low' END AS level FROM k""",
    "adjacent_steps": S.with_(_DOCS) + f"SELECT source, target, count(*) AS steps FROM (SELECT v->>'$' AS source, lead(v->>'$') OVER (PARTITION BY no, outer_pos ORDER BY pos) AS target FROM {_INNER(_BR['proof.supporting_paths'], 'path')}) WHERE target IS NOT NULL GROUP BY ALL",
    "trace_steps": S.with_(_DOCS) + f"SELECT no AS run_no, pos::INT AS pos, {_X('agent')} AS agent, {_X('status')} AS status, coalesce({_X('step')} = pos::VARCHAR, false) AS in_place FROM {_STEPS}",
    "verifier_summary": S.with_(_DOCS) + f", g AS (SELECT no AS run_no, count(*) FILTER ({_X('exit_code')} = '0') AS passed, count(*) FILTER ({_X('exit_code')} <> '0') AS failed, count(*) FILTER ({_X('exit_code')} IS NULL) AS missing FROM {_CMD} GROUP BY ALL) SELECT *, CASE WHEN failed > 0 THEN 'failed' WHEN missing > 0 THEN 'incomplete' ELSE 'passed' END AS verdict FROM g",
    "successor_jaccard": f"SELECT file_no, round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))), 6) AS jaccard FROM (SELECT file_no, list_distinct({S.tok('before')}) AS a, list_distinct({S.tok('source_text')}) AS b FROM (SELECT *, lag(source_text) OVER (PARTITION BY repo_root, relpath ORDER BY file_no) AS before FROM file_analysis) WHERE before IS NOT NULL AND before <> source_text)",
    "first_failure": "SELECT user_id, event_id AS first_error, prev AS last_good, (i - 1)::INT AS before FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY i) AS k FROM (SELECT *, row_number() OVER w AS i, lag(event_id) OVER w AS prev FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE event_type = 'error') WHERE k = 1",
    "regression_status": "SELECT user_id, errors, CASE WHEN errors = 0 THEN 'valid_across_history' WHEN errors = n THEN 'always_failing' WHEN first = 'error' THEN 'recovered' ELSE 'regression_found' END AS status FROM (SELECT user_id, count(*) FILTER (event_type = 'error') AS errors, count(*) AS n, first(event_type ORDER BY ts, event_id) AS first FROM events GROUP BY ALL)",
    "html_links": _LINKS(".html", """'(?i)(?:src|href)=[''"]([^''"]+)[''"]'""", r"list_transform(@, lambda x: regexp_replace(replace(trim(x), chr(92), '/'), '^/static/', ''))"),
    "css_imports": _LINKS(".css", r"""'(?i)@import\s+(?:url\()?[''"]?([^''")]+)'""", r"list_transform(@, lambda x: regexp_replace(replace(trim(x), chr(92), '/'), '^/static/', ''))").replace("'@import", "'(?i)@import"),
    "ordered_dedupe": f"SELECT chunk_no, array_to_string({_unique('(calls || refs || handler_names)')}, ',') AS names FROM code_chunks",
    "impacted_files": S.with_(_DOCS, _EV) + "SELECT bundle_no, relpath, count(*) AS nodes, array_to_string(list_sort(list_distinct(list(coalesce(symbol_name, '')))), ',') AS symbols FROM ev WHERE relpath IS NOT NULL GROUP BY ALL",
    "run_pass_rate": "SELECT mode, count(*) AS runs, count(*) FILTER (s = 'completed') AS completed, round(avg(CASE WHEN s IN ('completed', 'failed') THEN (s = 'completed')::INT END), 5) AS pass_rate FROM (SELECT coalesce(execution_mode, '?') AS mode, lower(trim(status)) AS s FROM engineering_runs) GROUP BY ALL",
}
for _k, _v in ORACLES.items():  # a WITH list that ends in a line break may go on
    ORACLES[_k] = _v.replace("\n, ", ",\n  ")
