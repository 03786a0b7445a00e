import copy
import json

from lodestone.operators import replay as RP

PROOF = {
    "status": "proved", "top_hit": "a.py:f", "route_literals": [], "supporting_paths": [{"path": ["a.py:f", "b.py:g"]}], "decoy_audit": [{"candidate": "b.py:g", "rejected": True}],
    "proof_graph": {"edges": [{"source": "/x", "target": "a.py:f", "label": "anchors"}, {"source": "b.py:g", "target": "a.py:f", "label": "route_path"}, {"source": "a.py:f", "target": "b.py:g", "label": "ranked_against"}]},
}
WHOLE = {"evidence": [{"source_label": "a.py:f", "snippet": "def f():\r\n    g()\n..."}, {"source_label": "b.py:g", "snippet": ""}], "proof": PROOF}


def parts(spark, *payloads):
    b = spark.createDataFrame([(i, "/w/o/r", p if p is None or isinstance(p, str) else json.dumps(p)) for i, p in enumerate(payloads)], "bundle_no long, repo_root string, payload string")
    labels = spark.createDataFrame([("o/r", "a.py:f", "def f():\n    g()\n    return 1\n"), ("o/r", "b.py:g", "def g(): pass"), ("w/other", "c.py:h", "x")], "repo string, label string, text string")
    units = spark.createDataFrame([("o/r", 1, "a.py", "f", "/x"), ("o/r", 2, "b.py", "g", "")], "repo string, node long, relpath string, symbol_name string, route_path string")
    edges = spark.createDataFrame([("o/r", 1, 2, "calls"), ("o/r", 2, 1, "references")], "repo string, source long, target long, label string")
    docs = RP.proof_docs(b)
    return docs, RP.replay(docs, labels, units, edges)


def replayed(spark, *payloads):
    return {(r.bundle_no, r.mutation): r.failed for r in parts(spark, *payloads)[1].collect()}


def test_every_mutation_fails_its_own_check_only(spark):
    got = replayed(spark, WHOLE)
    assert got == {
        (0, "baseline"): [], (0, "top_hit_missing"): ["top_hit_exists"], (0, "evidence_snippet_drift"): ["evidence_fingerprints_match"], (0, "route_anchor_missing"): ["route_literals_exist"], (0, "supporting_path_missing"): ["supporting_paths_exist"],
        (0, "proof_graph_edge_unverified"): ["proof_graph_edges_resolve", "proof_graph_edges_verified"], (0, "decoy_audit_stale"): ["decoy_audit_still_rejected"],
    }


def test_what_holds_nothing_to_mutate_is_not_detected(spark):
    bare = {"proof": {"status": "partial", "top_hit": "a.py:f"}}
    stale, other, edge = copy.deepcopy(WHOLE), copy.deepcopy(WHOLE), copy.deepcopy(WHOLE)
    stale["evidence"][0]["snippet"] = "def f(): return 2"
    other["proof"]["top_hit"] = "c.py:h"
    edge["proof"]["proof_graph"]["edges"][0]["target"] = "b.py:g"
    edge["proof"]["proof_graph"]["edges"][1]["source"] = "/x"
    got = replayed(spark, bare, stale, other, edge, {}, "{damaged", None, "[]")
    missed = [m for m in RP.MUTATIONS if not got[0, m]]
    assert missed == ["evidence_snippet_drift", "supporting_path_missing", "decoy_audit_stale"]
    assert got[1, "baseline"] == ["evidence_fingerprints_match"] and got[2, "baseline"] == ["top_hit_exists"] and got[3, "baseline"] == ["proof_graph_edges_verified"]
    assert got[4, "baseline"] == ["top_hit_exists"] and {n for n, _ in got} == {0, 1, 2, 3, 4}


def test_score_reads_status_replay_and_mutations(spark):
    partial, stale, bare = copy.deepcopy(WHOLE), copy.deepcopy(WHOLE), {"proof": {"status": "proved", "top_hit": "a.py:f"}}
    partial["proof"]["status"] = "partial"
    stale["evidence"][0]["snippet"] = "def f(): return 2"
    got = {r.bundle_no: (r.score, r.grade, r.status) for r in RP.scorecard(*parts(spark, WHOLE, partial, stale, bare, {}, "{damaged")).collect()}
    assert got == {0: (100, "A", "pass"), 1: (80, "C", "warn"), 2: (70, "C", "warn"), 3: (65, "F", "fail"), 4: (50, "F", "fail")}
