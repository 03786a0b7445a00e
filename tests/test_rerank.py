import pytest
from pyspark.sql import functions as F

from lodestone.operators import rerank as RR, retrieve as R


def plans(spark, *texts):
    q = spark.createDataFrame([(i, "o/r", t) for i, t in enumerate(texts)], "query_id long, repo string, question string")
    return {r.query_id: r for r in RR.query_plans(q).collect()}


def test_plans(spark):
    got = plans(spark, "Which function writes /api/chat?", "Where is the route for login?", "Which css style file?", "why does the error 500 appear", "which test file covers it", None, "浏览器页面", "where is pyproject configured")
    assert [got[i].intent for i in range(8)] == ["flow_trace", "api_lookup", "style_lookup", "code_search", "test_lookup", "code_search", "frontend_lookup", "config_lookup"]
    assert got[0].target == "function" and got[1].target == "route" and got[3].mode == "bug_localization" and got[5].roles == []
    assert got[2].roles == ["styles", "frontend"] and got[6].languages == ["javascript", "typescript", "html", "css"]


@pytest.mark.parametrize("text,name,out", [("the writer rather than the admin handler", "admin_write", True), ("not the legacy one", "legacy_write", True), ("the admin writer", "admin_write", False), ("save instead of load session", "load_session", True), ("", "x", False)])
def test_exclusion(spark, text, name, out):
    df = spark.createDataFrame([(text, name)], "low string, name string")
    from lodestone.functions.text import tokenize

    assert df.select(RR.excluded(F.col("low"), F.col("name"), tokenize(F.col("name")))).collect()[0][0] is out


def test_rules_fold_in_order(spark):
    assert RR.total_sql((("a", "2.0", False), ("b", "0.5", True)), "base") == "((((base) + CASE WHEN a THEN 2.0 ELSE 0.0 END)) * CASE WHEN b THEN 0.5 ELSE 1.0 END)"


def test_scout_takes_files_by_role_alone(spark):
    facts = spark.createDataFrame([("o/r", "a.py", ["os"], ["load"], [], ["api"], "python"), ("o/r", "b.py", [], [], [], ["api", "backend"], "python"), ("o/r", "c.py", [], [], [], [], None)], "repo string, relpath string, imports array<string>, symbol_names array<string>, routes array<string>, roles array<string>, language string")
    terms = spark.createDataFrame([(1, "o/r", "load"), (2, "o/r", "zzz")], "query_id long, repo string, term string")
    p = spark.createDataFrame([(1, "o/r", ["api", "backend"]), (2, "o/r", [])], "query_id long, repo string, roles array<string>")
    got = {(r.query_id, r.relpath): (r.score, r.matched) for r in R.file_scout(facts, terms, p).collect()}
    assert set(got) == {(1, "a.py"), (1, "b.py")} and got[1, "b.py"] == (4.5, 0) and got[1, "a.py"][1] == 1 and got[1, "a.py"][0] > 3.75


def test_pruned_bm25_equals_all_scores(spark):
    import random

    r = random.Random(5)
    words = ["the", "of"] + [f"w{i}" for i in range(40)]
    docs = [("o/r", "content", i, ["the"] * r.randint(0, 3) + [r.choice(words) for _ in range(r.randint(0, 12))]) for i in range(400)] + [("o/r", "content", 900 + i, ["the", "w1"]) for i in range(30)] + [(None, "content", 990, ["the"])]
    tokens = spark.createDataFrame(docs, "repo string, view string, doc_id long, tokens array<string>")
    terms = spark.createDataFrame([(q, "o/r", t) for q in range(30) for t in {"the", "of", *r.sample(words, 4)}] + [(99, "o/x", "the")], "query_id long, repo string, term string")
    for k in (1, 5):
        want = sorted(map(tuple, R.top_k(R.bm25(tokens, terms), k, "query_id", "view").select("query_id", "doc_id", "rank", "score").collect()))
        assert sorted(map(tuple, R.bm25_top(tokens, terms, k).select("query_id", "doc_id", "rank", "score").collect())) == want


def test_fusion_with_dense_scores(spark):
    s = "query_id long, doc_id long, score double"
    lexical = spark.createDataFrame([(1, 1, 1.0), (1, 2, 0.5), (2, 7, 0.4)], s)
    dense = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.8)], s)
    got = {(r.query_id, r.doc_id): r.score for r in R.fuse_dense(lexical, dense).collect()}
    assert got[2, 7] == 0.4 and got[1, 2] == round((1 / 32 + 1.2 / 31) / (2.2 / 31), 6) and got[1, 2] > got[1, 3] > got[1, 1]


def test_features_take_routes_and_boosts_from_candidates(spark):
    q = spark.createDataFrame([(1, "o/r", "which handler rather than the admin one serves /api/chat"), (2, "o/r", "load session")], "query_id long, repo string, question string")
    terms = spark.createDataFrame([(1, ["handler"]), (2, ["load", "session"])], "query_id long, terms array<string>")
    c = spark.createDataFrame([("o/r", "a.py", 5, "python", "route", "chat_admin", "/api/chat", 3, ["load"]), ("o/r", "b.py", 6, None, None, None, None, None, [])], "repo string, relpath string, chunk_no long, language string, symbol_kind string, symbol_name string, route_path string, start_line int, calls array<string>")
    roles = spark.createDataFrame([("o/r", "a.py", ["tests"])], "repo string, relpath string, file_roles array<string>")
    found = spark.createDataFrame([(1, 5, 1.0, 2.0), (1, 6, 1.0, 0.0), (2, 5, 3.0, 0.0)], "query_id long, doc_id long, score double, boost double")
    got = {(x.query_id, x.doc_id): x for x in RR.features(found, RR.query_plans(q), terms, c, roles).collect()}
    assert {k: (x.reachable, x.off_route, x.excluded, x.boost, x.test_file, x.calls_match) for k, x in got.items()} == {(1, 5): (True, False, True, 2.0, True, 0), (1, 6): (False, True, False, 0.0, False, 0), (2, 5): (False, True, False, 0.0, True, 1)}
    assert [(x.query_id, x["rank"]) for x in RR.reranked(RR.features(found.withColumn("score", F.lit(-90.0)), RR.query_plans(q), terms, c, roles).withColumns({"boost": F.lit(0.0), "roles_match": F.lit(False), "language_match": F.lit(False), "reachable": F.lit(False), "test_file": F.lit(False), "excluded": F.lit(True), "acts": F.lit(0), "calls_match": F.lit(0), "symbol": F.lit("")}), 5).collect()] == []
