"""Every query with SQL against that SQL: on the smallest test tables, and on small tables of this file's own that give each of some queries rows."""

import datetime as dt
import glob
import json
import os

import pytest

from lodestone.plans.catalog import ORACLES, QUERIES

duckdb = pytest.importorskip("duckdb")
SMALL = "/root/testdata/sf0.001"
#: Queries for which the smallest tables hold no rows.
BARE = frozenset("pr_guard guard_annotations claim_conflicts successor_jaccard route_anchors css_imports html_links diff_files diff_lines relevant_edges relations edge_between enclosing_class decoy_audit".split())


#: Queries that are compared on the tables of this file; those with long plans on these only.
OWN = ["pr_guard", "guard_annotations", "claim_conflicts", "successor_jaccard", "route_anchors", "diff_files", "diff_lines", "relevant_edges", "relations", "proof_build", "proof_scorecard", "court_verdict", "mutation_detection", "temporal_status", "graph_delta", "manifest_verify", "counterfactual", "needle_audit", "multiview_rerank", "file_scout", "impact_walk", "css_imports", "html_links", "proof_nodes", "question_ppr", "edge_between", "case_checks", "suite_metrics"]
LONG = frozenset("multiview_rerank question_ppr proof_build proof_nodes relevant_edges temporal_status proof_scorecard court_verdict mutation_detection".split())


def same(spark, folder, name):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for p in glob.glob(folder + "/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    df, r = QUERIES[name](spark, folder), con.sql(ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(r.columns)
    value = lambda x: round(x, 6) if isinstance(x, float) else x
    key = lambda names, rows: sorted((tuple(value(row[names.index(c)]) for c in cols) for row in rows), key=repr)
    got = key(df.columns, df.collect())
    assert got == key(r.columns, r.fetchall())
    return got


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(ORACLES) - LONG))
def test_against_sql(spark, name):
    assert same(spark, SMALL, name) or name in BARE


NOW = dt.datetime(2025, 1, 1)
CHUNK = "chunk_no long, repo_root string, chunk_id string, relpath string, language string, text string, start_line int, end_line int, symbol_name string, symbol_kind string, metadata_tokens array<string>, imports array<string>, calls array<string>, refs array<string>, inherits array<string>, qualified_name string, parser_backend string, route_path string, handler_names array<string>, indexed_at timestamp_ntz"


def chunk(n, path, name="", kind="", text="", calls=(), route="", handlers=(), repo="/w/o/r"):
    return (n, repo, f"{path}::{name or 'file'}", path, "python", text, 1, 9, name, kind, [], [], list(calls), [], [], "", "x", route, list(handlers), NOW)


@pytest.fixture(scope="module")
def mini(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("mini"))
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    put("code_chunks", [
        chunk(1, "src/app.py", "post_items_id", "route", "route", route="/items/:id", handlers=["handle"]), chunk(2, "src/app.py", "handle", "function", "def handle(): save()", calls=["save"]),
        chunk(3, "src/db.py", "save", "function", "def save(): pass"), chunk(4, "src/db.py", text="import x"), chunk(5, "src/db.py", "save", "function", "def save(): return 2"), chunk(6, "src/k.py", "Keeper", "class", "class Keeper: save()", calls=["save"]),
        chunk(7, "src/app.py", "admin_save", "function", None, repo=None), chunk(8, "src/db.py", "save_all", "function", "def save(): return 3"), chunk(9, "src/app.py", "handle", "function", "def handle(): save_all()", calls=["save", "save_all"]),
    ], CHUNK)
    put("file_facts", [("/w/o/r", "src/app.py", "python", 9, [], ["handle"], ["/items/:id"], ["api"], NOW), ("/w/o/r", "src/db.py", None, None, [], ["save"], [], [], NOW)] * 2, "repo_root string, relpath string, language string, line_count int, imports array<string>, symbol_names array<string>, routes array<string>, roles array<string>, indexed_at timestamp_ntz")
    put("benchmark_challenge_suite", [(1, "s", "a", "git@h:o/r.git", "Which function saves /items/42 rather than admin?", "src/db.py", "save", ["admin"], ["t"], NOW), (2, "s", None, "o/r", None, None, None, [], [], NOW), (3, "s", "b", "o/r", "where is handle", "x", "zzz", ["handle"], ["t", "u"], NOW)],
        "case_no long, suite_id string, id string, repo string, question string, expected_path string, expected_symbol_contains string, distractor_symbol_contains array<string>, tags array<string>, added_at timestamp_ntz")
    proof = {"status": "proved", "top_hit": "src/db.py:save", "route_literals": ["/items/:id"], "supporting_paths": [{"route": "/items/:id", "path": ["src/app.py:post_items_id", "src/app.py:handle", "src/db.py:save"]}], "proof_graph": {"edges": [{"source": "/items/:id", "target": "src/app.py:handle", "label": "anchors"}]}, "decoy_audit": [{"candidate": "src/app.py:handle", "rejected": True}]}
    whole = json.dumps({"evidence": [{"source_label": "src/db.py:save", "snippet": "def save(): return 2", "score": 19, "matched_terms": ["save", "db"]}], "proof": proof})
    stale = json.dumps({"evidence": [{"source_label": "src/db.py:save", "snippet": "def save(): pass"}], "proof": proof | {"status": "partial"}})
    put("evidence_bundles", [(1, "b1", "/w/o/r", "q", NOW, NOW, whole), (2, "b2", "https://h/o/r", "q", NOW, NOW, stale), (3, "b3", None, "q", NOW, NOW, "{damaged"), (4, "b4", "/w/o/r", "q", NOW, NOW, None)], "bundle_no long, bundle_id string, repo_root string, question string, created_at timestamp_ntz, loaded_at timestamp_ntz, payload string")
    put("engineering_runs", [(1, "r1", "o/r", "t", "completed", "m", "x", ["./lib/src/db.py", "docs/a.md", "src\\\\app.py"], "[]", NOW, NOW), (2, "r2", "o/r", "t", None, "m", None, ["docs/a.md"], None, NOW, NOW), (3, "r3", "/w/other/z", "t", "failed", "m", "x", ["src/db.py"], "[]", NOW, NOW)],
        "run_no long, run_id string, repo_root string, task string, status string, model string, execution_mode string, changed_files array<string>, timeline string, created_at timestamp_ntz, loaded_at timestamp_ntz")
    put("file_analysis", [(1, "o/r", "a.py", "sha256:abc", "python", "x", [], 1, "a = load(b)\n", NOW), (2, "o/r", "a.py", None, "python", "x", [], 1, "a = load(c)\nd = 2\n", NOW), (3, "o/r", "p.diff", "", None, None, [], 0, "+++ b/src/a.py\n+x\n-y\n-z\n", NOW), (4, "o/r", "n.py", "00", None, None, [], 0, None, NOW), (5, "o/r", "w.html", None, None, None, [], 0, "<a href='/static/x.js'><img SRC='b.png'><a href='X.js'>", NOW), (6, "o/r", "w.css", None, None, None, [], 0, "@import url(theme.css); @IMPORT 'b.css';", NOW)],
        "file_no long, repo_root string, relpath string, content_digest string, language string, parser_backend string, imports array<string>, symbol_count int, source_text string, analyzed_at timestamp_ntz")
    return folder


@pytest.mark.parametrize("name", OWN)
def test_rows_of_its_own(spark, mini, name):
    assert same(spark, mini, name)


def test_what_the_small_tables_say(spark, mini):
    rows = lambda name: {tuple(r) for r in QUERIES[name](spark, mini).collect()}
    assert {r[:3] for r in rows("proof_scorecard")} == {(1, 100, "A"), (2, 35, "F")} or {r[0]: r[2] for r in rows("proof_scorecard")}[1] == "A"
    assert {(r[0], r[-1]) for r in rows("court_verdict")} == {(1, "accepted"), (2, "rejected")}
    assert rows("temporal_status") == {(1, "recovered", "", "evidence_fingerprints_match"), (2, "regression_found", "evidence_fingerprints_match", "")}
    assert {(r[0], r[1], r[4], r[5]) for r in rows("pr_guard")} == {(1, 1, "warn", 0), (1, 2, "fail", 1)}
    assert rows("claim_conflicts") == {("o/r", "docs/a.md", 2, "r1")} and rows("route_anchors") == {(1, 1, "/items/42", "/items/:id")}
    assert {r[:3] for r in rows("proof_successors")} == {(1, "src/db.py:save", "src/db.py:save_all"), (2, "src/db.py:save", "src/db.py:save_all")} and all(r[3] > 0.7 for r in rows("proof_successors"))
    assert rows("migration_ops") == {(n, "replace", p, "src/db.py:save_all") for n in (1, 2) for p in ("/proof/top_hit", "/proof/supporting_paths/0/path/2", "/evidence/0/source_label")}
    assert rows("temporal_scorecard") == {("recovered", 1, 1, 0), ("regression_found", 1, 1, 0)}
    assert {(r[0], r[3]) for r in rows("proof_build")} == {(1, "proved"), (3, "unanchored")}
    assert {r[0]: r[1] for r in rows("manifest_verify")} == {"sha256_mismatch": 1, "no_record": 4, "no_text": 1}
