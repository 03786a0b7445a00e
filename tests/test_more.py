import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators import evaluate as E, evidence as V, parse as P
from lodestone.sources import tables
from lodestone.streaming import events


def test_metrics_by_hand(spark):
    ranking = spark.createDataFrame([("m", 1, 10, 1), ("m", 1, 11, 2), ("m", 1, 12, 3)], "method string, query_id long, doc_id long, rank int")
    qrels = spark.createDataFrame([(1, 11, 1), (1, 12, 2), (2, 5, 1)], "query_id long, doc_id long, relevance int")
    got = {r.query_id: r for r in E.per_query(ranking, qrels, ("m",)).collect()}
    import math

    dcg, ideal = 1 / math.log2(3) + 3 / math.log2(4), 3 / math.log2(2) + 1 / math.log2(3)
    assert got[1].rank == 2 and got[1].mrr == 0.5 and abs(got[1].ndcg10 - dcg / ideal) < 1e-6 and abs(got[1].map100 - (1 / 2 + 2 / 3) / 2) < 1e-6
    assert got[2].rank is None and got[2].mrr == 0


def test_splits_are_disjoint_and_repeatable(spark):
    cases = spark.createDataFrame([(f"o/r{i % 9}",) for i in range(40)] + [(None,)], "repo string")
    a, b = (sorted(E.repository_splits(c).collect()) for c in (cases, cases.repartition(5)))
    assert a == b and len(a) == 9 and {r.split for r in a} == {"train", "dev", "test"}


def test_bootstrap_brackets_the_mean(spark):
    cases = spark.createDataFrame([(m, q, 0.5 if m == "b" else 0.6 + 0.01 * (q % 5)) for q in range(60) for m in ("b", "x")], "method string, query_id long, ndcg10 double")
    r = E.bootstrap(cases, "b", samples=200).collect()[0]
    assert 0.1 <= r.low <= 0.12 <= r.high <= 0.14


def test_python_extractor():
    backend, imports, symbols = P.analyse_python("import os\nfrom .a import b\n@app.route('/x/<id>', methods=['GET', 'POST'])\ndef h(q):\n    return save(q)\nclass C(Base):\n    def m(self): pass\n")
    assert backend == "python-ast" and imports == ["os", ".a"]
    assert [(s[0], s[1]) for s in symbols] == [("get_x_id", "route"), ("h", "function"), ("post_x_id", "route"), ("C", "class"), ("m", "function")]
    assert P.analyse_python("def f(:")[0] == "python-ast-error" and P.analyse_python(None)[2] == []


def test_python_route_methods():
    kinds = lambda text: [s[0] for s in P.analyse_python(text)[2] if s[1] == "route"]
    assert kinds("@app.get('/a_b/', methods=['POST'])\ndef f(): pass\n") == ["get_a_b"]
    assert kinds("@app.api_route('/', methods='PUT')\ndef f(): pass\n") == ["put_root"] and kinds("@app.route(rule='/x')\ndef f(): pass\n") == ["route_x"]


def test_javascript_extractor():
    text = "import a from 'x'\nconst fs = require('fs')\n\nexport async function handleChat(req) {\n  return send(load(req))\n}\nclass Store {}\nconst save = async (x) => persist(x)\napp.post('/api/chat', auth, handleChat);\nchatRouter.route('/b').get(listRequest)\n"
    backend, imports, symbols = P.analyse_javascript(text)
    assert backend == "regex-fallback" and imports == ["x", "fs"]
    assert [(s[0], s[1], s[7]) for s in symbols] == [("handleChat", "function", ""), ("Store", "class", ""), ("save", "function", ""), ("post_api_chat", "route", "/api/chat"), ("get_b", "route", "/b")]
    assert symbols[3][4] == ["auth", "handleChat"] and symbols[0][4][:2] == ["handleChat", "load"] and P.analyse_javascript(None)[2] == []
    assert P.analyse("css", "@import url(theme.css); @IMPORT 'b.css'")[1] == ["theme.css", "b.css"] and P.analyse("text", "x") == ("none", [], [])


def test_symbols_cut_their_snippets(spark):
    f = spark.createDataFrame([(1, "def f():\n    return 1\nx = 2\n", "python"), (2, None, "javascript"), (3, "a", None)], "k long, t string, lang string")
    got = P.symbols(f, "k", "t", "lang").collect()
    assert [(r.k, r.name, r.snippet) for r in got] == [(1, "f", "def f():\n    return 1")]
    assert P.symbol_chunks(P.symbols(f, "k", "t", "lang"), "k").count() == 1


def test_unified_diff(spark):
    df = spark.createDataFrame([("p", "a\nb\n", "a\nc\n"), ("p", "a", "a"), ("p", None, "x")], "p string, a string, b string")
    got = [r[0] for r in df.select(P.unified_diff(F.col("p"), F.col("a"), F.col("b"))).collect()]
    assert got[0] == "--- a/p\n+++ b/p\n@@ -1,2 +1,2 @@\n a\n-b\n+c" and got[1] == "" and got[2].endswith("+x")


def test_diff_paths(spark):
    d = "--- a/x\n+++ b/src/service.py\n+one\n-two\n+++ /dev/null\n"
    df = spark.createDataFrame([(1, d)], "k long, d string")
    assert df.select(P.diff_paths(F.col("d"))).collect()[0][0] == ["src/service.py"]
    assert [tuple(r) for r in P.diff_counts(df, "k", "d").collect()] == [(1, "src/service.py", 1, 1)]


def test_name_similarity():
    assert P.similarity("writeChat", "writeChat") == 1.0 and P.similarity("a", None) == 0.0


def test_drift_of(spark):
    c = spark.createDataFrame([(1, "route_anchor_present", False), (1, "graph_search_ran", True), (2, "graph_search_ran", True), (3, "odd", False)], "bundle_no long, name string, passed boolean")
    assert sorted(map(tuple, V.drift_of(c).collect())) == [(1, "route_anchor_missing", "high"), (2, "none", "none"), (3, "unknown_drift", "unknown")]


def test_json_lines_keep_other_line_ends(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(json.dumps({"id": "1", "text": "a b"}, ensure_ascii=False) + "\n", encoding="utf-8")
    rows = tables.json_lines(spark, str(tmp_path), "id string, text string").collect()
    assert len(rows) == 1 and rows[0].text == "a b"


def test_source_tree_and_decoding(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "pkg" / "a.py").write_bytes("x = '中'".encode("gb18030"))
    (tmp_path / "node_modules" / "b.js").write_text("1")
    (tmp_path / "c.bin").write_bytes(b"\0")
    df = tables.source_tree(spark, str(tmp_path)).withColumn("text", tables.decode_bytes(F.col("content")))
    assert [(r.relpath, r.language, r.text) for r in df.collect()] == [("pkg/a.py", "python", "x = '中'")]


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    e = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:20:00", "a"), (None, "b")], "ts string, event string").select(F.to_timestamp("ts").alias("ts"), "event", F.create_map(F.lit("k"), F.lit("v")).alias("payload"))
    events.append_audit(e, src)
    q = events.windowed_counts(events.audit_stream(spark, src)).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("w").where("event = 'a'").collect()[0]["n"] == 2
    files = str(tmp_path / "files")
    spark.createDataFrame([("a.py", "d1"), ("a.py", "d1"), ("b.py", "d2")], "relpath string, content_digest string").write.parquet(files)
    for _ in range(2):
        s = spark.readStream.schema("relpath string, content_digest string").parquet(files)
        events.refresh_index(s, str(tmp_path / "out"), str(tmp_path / f"cp{_}")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
