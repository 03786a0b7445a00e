"""Routes that a question names: every pair that matches by SQL is found, whatever part of the route is open and whatever signs it has."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.plans.catalog import QUERIES
from lodestone.plans.retrieval import _MATCH

from .test_sql import CHUNK, NOW, chunk, duckdb, same

#: Routes and whether /acme/v1.0/items/42 fills them.
ROUTES = {
    "/:org/v1.0/items/:id": True, "/a:rest/v1.0/items/:id": True, "/:a/:b/:c/:d/": True, "/acme/v1.0/items/:id?": True, "/acme/v1.0/items/:id(\\d+)": True, "/acme/v:n(.*)": True, "/acme/(v1|v2).0/items/:id": True, "/acme/v1.0/items/42": True,
    "/acme/v1.0/:id": False, "/acme/v1.0/items/{id}": False, "/:org/v1.0/items/:id(\\D+)": False, "/acme/v1.0/items/:id*": False, "/acme/v1.0/items/:id([z-a]": False, ":org/v1.0/items/:id": False, "acme": False, "/": False,
}
BROKEN = ("/acme/v1.0/items/:id*", "/acme/v1.0/items/:id([z-a]")  # errors in SQL


def test_routes_are_filled_and_share_a_key(spark):
    df = spark.createDataFrame([(r, "/acme/v1.0/items/42") for r in ROUTES], "r string, q string")
    got = df.select("r", T.route_matches(F.col("r"), F.col("q")).alias("m"), F.array_contains(T.literal_keys(F.col("q")), T.route_key(F.col("r"))).alias("k")).collect()
    assert {r.r: r.m for r in got} == ROUTES and all(r.k for r in got if r.m)
    by_sql = lambda r: bool(duckdb.sql(f"select {_MATCH('r', 'q')} from (select '{r}' as r, '/acme/v1.0/items/42' as q)").fetchall()[0][0])
    assert {r: by_sql(r) for r in ROUTES if r not in BROKEN} == {r: m for r, m in ROUTES.items() if r not in BROKEN}


@pytest.fixture(scope="module")
def routed(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("routed"))
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    sane = [r for r in ROUTES if r not in BROKEN]
    put("code_chunks", [chunk(i, "src/app.py", f"get_{i}", "route", "route", route=r, handlers=["handle"]) for i, r in enumerate(sane, 10)] + [chunk(1, "src/app.py", "handle", "function", "def handle(): save()", calls=["save"]), chunk(2, "src/db.py", "save", "function", "def save(): pass")], CHUNK)
    put("file_facts", [("/w/o/r", p, "python", 9, [], [], [], [], NOW) for p in ("src/app.py", "src/db.py")], "repo_root string, relpath string, language string, line_count int, imports array<string>, symbol_names array<string>, routes array<string>, roles array<string>, indexed_at timestamp_ntz")
    put("benchmark_challenge_suite", [(1, "s", "a", "o/r", "Which function does save for /acme/v1.0/items/42", "x", "y", [], [], NOW)], "case_no long, suite_id string, id string, repo string, question string, expected_path string, expected_symbol_contains string, distractor_symbol_contains array<string>, tags array<string>, added_at timestamp_ntz")
    return folder, {i for i, r in enumerate(sane, 10) if ROUTES[r]}


def test_proof_build_has_all_anchors(spark, routed):
    folder, wanted = routed
    assert same(spark, folder, "proof_build")
    assert QUERIES["proof_build"](spark, folder).collect()[0]["anchors"] == len(wanted)


def test_proof_nodes_has_all_anchors(spark, routed):
    folder, wanted = routed
    assert same(spark, folder, "proof_nodes")
    assert {r["node"] for r in QUERIES["proof_nodes"](spark, folder).collect() if "route_anchor" in r["roles"]} == wanted
