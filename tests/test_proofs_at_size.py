"""Queries over the candidates' graph: units are written once, and what routes reach is not multiplied by the questions."""

import os

import pytest

from lodestone.plans import retrieval as RT
from lodestone.plans.catalog import QUERIES

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_units_are_found_once(spark, monkeypatch):
    """every join of the graph reads the units."""
    seen, edges = [], RT.G.edges
    monkeypatch.setattr(RT.G, "edges", lambda u: seen.append(plan(u)) or edges(u))
    QUERIES["explored_neighbors"](spark, SMALL)
    assert seen and all("max_by" not in x for x in seen)


@pytest.mark.parametrize("name", ["proof_build", "decoy_audit"])
def test_reached_nodes_are_only_looked_up(spark, monkeypatch, name):
    """F8, F17: a question's candidates are looked for among the nodes that its routes reach; no row for each question and node."""
    df = QUERIES[name](spark, SMALL)
    joins = [x for x in plan(df).splitlines() if "Join " in x and "(start#" in x]
    assert joins and all("LeftSemi" in x for x in joins if "Inner" not in x) and any("LeftSemi" in x for x in joins)


def test_files_are_dealt_once_and_not_written(spark, monkeypatch):
    """words and names of files come from one shuffle by repository, and paths from the blocks."""

    def write(*_):
        raise AssertionError("files written")

    monkeypatch.setattr(RT.R, "checkpointed", write)
    df = QUERIES["file_scout"](spark, SMALL)
    assert df.columns == ["query_id", "relpath", "rank", "score", "matched"] and df.count()
