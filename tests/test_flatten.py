import json

from lodestone.operators import flatten as N


def bundles(spark, *payloads):
    return spark.createDataFrame([(i, p, "x") for i, p in enumerate(payloads, 1)], "bundle_no long, payload string, child string")


def rows(df):
    return sorted((r.record_no, r.child, r.pos_path) for r in df.collect())


def test_positions_nulls_bare_objects_and_inner_json(spark):
    a = json.dumps({"evidence": [{"rank": 1}, None, {"rank": 3}], "graph_edges": {"source": "s"}, "proof": json.dumps({"supporting_paths": [{"path": ["a", None, "b"]}, {"path": None}]})})
    got = rows(N.flatten_bundles(bundles(spark, a, json.dumps(a))))
    one = [("evidence", "1"), ("evidence", "3"), ("graph_edges", "1"), ("proof.supporting_paths", "1"), ("proof.supporting_paths", "2"), ("proof.supporting_paths.path", "1.1"), ("proof.supporting_paths.path", "1.3")]
    assert got == sorted((n, *x) for n in (1, 2) for x in one)


def test_invalid_and_absent_payloads_give_no_rows(spark):
    bad = [None, "", "  ", '{"evidence": [1', '{"evidence": [1]} x', '{"evidence": [1]},{}', '{"evidence": [1]}]', "null", "3", "[]"]
    assert rows(N.flatten_bundles(bundles(spark, *bad))) == []


def test_runs_and_child_table(spark):
    t = json.dumps([{"details": {"commands": {"command": "c", "failures": ["f1", "f2"]}}}, {"details": '{"findings": [{"note": 1}]}'}])
    runs = spark.createDataFrame([(7, t)], "run_no long, timeline string")
    assert rows(N.flatten_runs(runs)) == [(7, "timeline", "1"), (7, "timeline", "2"), (7, "timeline.details.commands", "1.1"), (7, "timeline.details.commands.failures", "1.1.1"), (7, "timeline.details.commands.failures", "1.1.2"), (7, "timeline.details.findings", "2.1")]
    c = N.child_table(N.flatten_runs(runs), "timeline.details.commands", "command").collect()
    assert [(r.record_no, r.parent_pos, r.pos, r.command) for r in c] == [(7, [1], 1, "c")]


def test_empty_table(spark):
    assert N.flatten_bundles(spark.createDataFrame([], "bundle_no long, payload string")).count() == 0


def test_members_named_twice_count_as_their_last(spark):
    twice = '{"evidence": [{"rank": 1, "rank": 2}], "graph_edges": [1], "graph_edges": [{"source": "s"}, {"source": "t"}]}'
    flat = N.flatten_bundles(bundles(spark, twice, '{"evidence": [{"x": 1, "x": 2}]}'))
    assert rows(flat) == [(1, "evidence", "1"), (1, "graph_edges", "1"), (1, "graph_edges", "2"), (2, "evidence", "1")]
    assert [r.rank for r in N.typed_table(flat, "evidence", "rank int").orderBy("record_no").collect()] == [2, None]


def test_only_strict_json_counts(spark):
    loose = ["{'evidence': [1]}", '{"evidence": [NaN]}', '{"evidence": [01]}', '{evidence: [1]}', '{"evidence": ["\t"]}', '{"evidence": [1,]}', '{"evidence": [1]} // x', '{"evidence": ["\\x"]}']
    assert rows(N.flatten_bundles(bundles(spark, *loose))) == []


def test_child_tables_link_to_their_parents(spark):
    p = json.dumps({"proof": {"supporting_paths": [{"route": "/a", "depth": 2, "path": ["x", "y"]}, {"route": None, "path": "odd"}]}})
    flat = N.flatten_bundles(bundles(spark, p))
    assert sorted(map(tuple, N.typed_table(flat, "proof.supporting_paths", "route", "depth int").collect())) == [(1, "", 1, "/a", 2), (1, "", 2, None, None)]
    assert sorted(map(tuple, N.typed_table(flat, "proof.supporting_paths.path").collect())) == [(1, "1", 1, "x"), (1, "1", 2, "y")]
    assert set(N.TABLES) <= set(N.QUERIES)
