import json
import os

from pyspark.sql import functions as F

from lodestone.operators import parse as P, search as SE
from lodestone.sources import tables


def test_tree_order_blanks_and_limits(spark, tmp_path):
    for name, text in {"b/z.py": "x = 1", "a.py": "y = 2", "a/c.js": "f()", "blank.py": " \n\t", "logs/x.py": "z", "big.py": "x" * 900}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    paths = lambda **k: [r.relpath for r in tables.source_tree(spark, str(tmp_path), **k).collect()]
    assert sorted(paths(max_file_bytes=500)) == ["a.py", "a/c.js", "b/z.py"] and paths(max_file_bytes=500, max_files=2) == ["a/c.js", "a.py"] and "big.py" in paths(max_file_bytes=None)
    t = tables.source_tree(spark, str(tmp_path))
    a, b = (tables.tree_signature(x).collect()[0] for x in (t, t.repartition(3)))
    assert a == b and a.files == 4 and tables.tree_signature(t.where("relpath <> 'a.py'")).collect()[0].signature != a.signature


def test_index_is_stored_by_signature(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a"])], "n long, t array<string>")
    assert tables.load_index(spark, str(tmp_path), "s1", ("chunks",)) is None
    for _ in range(2):
        tables.save_index({"chunks": df}, str(tmp_path), "s1")
    assert [tuple(r) for r in tables.load_index(spark, str(tmp_path), "s1", ("chunks",))["chunks"].collect()] == [(1, ["a"])]
    assert tables.load_index(spark, str(tmp_path), "s1", ("chunks", "edges")) is None and tables.load_index(spark, str(tmp_path), "s2", ("chunks",)) is None


def test_run_listing(spark, tmp_path):
    for i, body in enumerate([json.dumps({"run_id": "r0", "status": "completed", "changed_files": ["a"], "timeline": [{"x": 1}, {"x": 2}]}), "{damaged", json.dumps({"task": "t"})]):
        (tmp_path / f"run_{i}").mkdir()
        (tmp_path / f"run_{i}" / "run.json").write_text(body)
        os.utime(tmp_path / f"run_{i}" / "run.json", (1000 + i, 1000 + i))
    got = tables.run_listing(spark, str(tmp_path)).collect()
    assert [(r.run_id, r.status, r.execution_mode, r.timeline_count) for r in got] == [("run_2", "", "local", 0), ("r0", "completed", "local", 2)]
    assert [r.run_id for r in tables.run_listing(spark, str(tmp_path), 1).collect()] == ["run_2"]


def test_record_shapes(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1}\n{"k": 2}\n')
    (tmp_path / "b.json").write_text('[{"k": 1}, {"k": 2}]')
    (tmp_path / "c.json").write_text('{"version": 3, "data": [{"k": 1}, {"k": 2}]}')
    for name in ("a.jsonl", "b.json", "c.json"):
        assert sorted(r.k for r in tables.json_records(spark, str(tmp_path / name)).collect()) == [1, 2]


def test_retrieval_records(spark, tmp_path):
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "corpus.jsonl").write_text('{"_id": "d1", "contents": "import os\\ndef load(x):\\n  return read(x)", "repo": "o/r"}\n{"text": "t", "symbol": "S", "metadata": "m"}\n')
    c = tables.ir_corpus(tables.ir_directory(spark, str(tmp_path), "corpus")).orderBy(F.col("title")).collect()
    assert (c[1].id, c[1].title, c[1].metadata, c[1].repository) == ("d1", "load", "o/r load read os", "o/r") and c[0].title == "S" and c[0].id.startswith("doc_")
    q = tables.ir_queries(spark.createDataFrame([("q1", None, "how", ["a", "b"]), (None, "where", None, None)], "qid string, text string, question string, candidate_ids array<string>")).collect()
    assert (q[0].id, q[0].text, q[0].candidate_ids) == ("q1", "how", ["a", "b"]) and q[1].text == "where" and q[1].candidate_ids == []
    j = tables.ir_qrels(spark.createDataFrame([("q", "d", None, 2), ("q", None, None, 1)], "query_id string, doc_id string, relevance double, score int")).collect()
    assert [tuple(r) for r in j] == [("q", "d", 2.0)]


def test_imported_cases(spark):
    rows = [("i1", "o/r", "fix it", "+++ b/src/a.py\n+++ /dev/null\n+++ b/src/b.py\n", None), ("i2", "o/r", "one", None, "x\\y.py"), ("i3", "o/r", " ", None, "z.py"), ("i4", "o/r", "none", "", None)]
    df = spark.createDataFrame(rows, "instance_id string, repo string, problem_statement string, patch string, expected_path string")
    cases, skipped = tables.imported_cases(df)
    assert sorted((r.id, r.expected_path) for r in cases.collect()) == [("i1__file_1", "src/a.py"), ("i1__file_2", "src/b.py"), ("i2", "x/y.py")]
    assert sorted(r.id for r in skipped.collect()) == ["i3", "i4"]
    assert [r.id for r in tables.imported_cases(df, 2)[0].collect()] == ["i1__file_1", "i1__file_2"]


def test_failure_logs(spark):
    log = 'File "a\\b.py", line 3\nsrc/x.py:12: error\nFAILED tests/t.py::test_a - assert 1\nFAILED tests/t.py::test_a - again\n'
    df = spark.createDataFrame([(log,), ("ModuleNotFoundError: x",), ("Timed out",), (None,)], "l string")
    got = df.select(P.failure_type(F.col("l")).alias("t"), P.referenced_files(F.col("l")).alias("f"), P.failed_tests(F.col("l")).alias("n")).collect()
    assert [r.t for r in got] == ["test_failure", "missing_dependency", "timeout", "unknown"] and got[0].f == ["src/x.py", "a/b.py"] and got[0].n == ["tests/t.py::test_a"]


def test_searches(spark):
    files = spark.createDataFrame([("r", "b.py", "Load the file\nload\n"), ("r", "a.py", "x\nLOAD now"), (None, "n.py", "load")], "repo string, relpath string, text string").where("repo is not null")
    asked = spark.createDataFrame([(1, ["load", "the file", "x"]), (2, ["q"]), (3, None)], "request int, terms array<string>")
    assert [(r.relpath, r.line_no, r.score) for r in SE.search_text(files, asked, 2).collect()] == [("b.py", 1, 3.5), ("a.py", 2, 1.0)]
    assert SE.search_text(files, asked.where("request > 1"), 2).count() == 0
    c = spark.createDataFrame([("r", 1, "a.py::0", "a.py", "Load"), ("r", 2, "a.py::file", "a.py", ""), ("r", 3, "x", "b.py", "load")], "repo string, chunk_no long, chunk_id string, relpath string, symbol_name string")
    t = spark.createDataFrame([("r", x) for x in ("a.py::file", "a.py:Load", "A.PY:load", "LOAD", "none")], "repo string, target string")
    assert {(r.target, r.chunk_no, r.priority) for r in SE.find_chunk(c, t).collect()} == {("a.py::file", 2, 1), ("a.py:Load", 1, 2), ("A.PY:load", 1, 3), ("LOAD", 1, 3)}
    d = spark.createDataFrame([("r", "src/a.py"), ("r", "Readme"), ("r", "api/b.py"), ("r", "src/c/d.py")], "repo string, relpath string")
    assert [(r.name, r.folder) for r in SE.list_directory(d, "").orderBy("rank").collect()] == [("api", True), ("src", True), ("Readme", False)]
    assert [r.name for r in SE.list_directory(d, "src/").orderBy("rank").collect()] == ["c", "a.py"]
    r = SE.read_lines(files, 2, 9).orderBy("relpath").collect()
    assert [(x.end_line, x.line_count, x.content) for x in r] == [(2, 2, "LOAD now"), (2, 2, "load")]
