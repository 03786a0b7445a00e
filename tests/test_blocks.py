"""Rankings by blocks: the same as row by row, and without a row per question and document."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import blocks as BL, evaluate as E, index as I, retrieve as R
from lodestone.plans import evaluation as EV
from lodestone.plans.catalog import QUERIES
from lodestone.sources.tables import chunks, keyed, questions, table

SMALL = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


def test_tokens_are_those_of_the_columns(spark):
    rows = [("parseHTTPQueries running ties series a-b/c.D_e",), ("页面样式 chat-stream X_页 İK",), ("",), (None,), ("a" * 50 + "Bing _ __s ies",)]
    got = spark.createDataFrame(rows, "x string").select("x", T.tokenize(F.col("x")).alias("t")).collect()
    assert len(got) == 5 and all(r.t == [y for t in BL.raw_tokens(r.x) for y in BL.spelled(t)] for r in got)


def test_an_empty_stored_token_is_no_document(spark):
    docs = spark.createDataFrame([("r", 1, "save", ["", "save"]), ("r", 2, None, []), (None, 3, "save", [])], "repo string, doc_id long, said string, stored array<string>")
    got = {(r.doc_id, r.tid, r.packed & 255, r.packed >> 8 & 0xFFFFFF, r.packed >> 32) for r in BL.token_rows(docs.where("repo is not null"), {"chunk": (("said",), ("stored",))}, ["save"]).collect()}
    assert got == {(1, -1, 4, 0, 3), (1, 0, 4, 2, 3), (2, -1, 4, 0, 0)}


@tables
def test_fused_as_row_by_row(spark, monkeypatch):
    """Several blocks a repository give what ranking all pairs as rows gives."""
    monkeypatch.setattr(BL, "BLOCK", 4)
    terms = I.query_terms(questions(spark, SMALL), expand=True)
    c, facts = chunks(spark, SMALL), table(spark, SMALL, "file_facts")
    whole = lambda df: sorted(map(tuple, df.select("query_id", "doc_id", "rank", "score").collect()))
    want = whole(R.top_k(R.fuse(R.contributions(R.bm25(I.view_tokens(c, facts), terms))), 9, "query_id"))
    assert whole(BL.ranked_blocks(I.chunk_texts(c, facts, I.VIEW_TEXTS), terms, BL.fusion_top(9), "query_id long, doc_id long, rank int, score double")) == want


#: Queries that made a row of every question and document with one of its terms.
PAIRED = ["view_contributions", "candidate_union", "file_scout", "eval_per_query"]


@tables
@pytest.mark.parametrize("name", PAIRED)
def test_no_row_per_question_and_document(spark, monkeypatch, name):
    def rows(*_):
        raise AssertionError("pairs as rows")

    for f in ("bm25", "narrowed"):
        monkeypatch.setattr(R, f, rows)
    assert QUERIES[name](spark, SMALL).columns


EVALUATED = ["ablation_variants", "eval_by_method", "eval_by_repo", "eval_per_query", "paired_deltas", "bootstrap_ci"]


@tables
@pytest.mark.parametrize("name", EVALUATED)
def test_no_rows_of_rankings_or_grades(spark, monkeypatch, name):
    """metrics are found where the rankings are."""

    def rows(*_):
        raise AssertionError("rankings as rows")

    for f in ("rankings", "qrels"):
        monkeypatch.setattr(EV, f, rows)
    assert QUERIES[name](spark, SMALL).columns


@tables
def test_metrics_as_of_rows(spark):
    whole = lambda df: sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=repr)
    want = whole(E.per_query(EV.rankings(spark, SMALL), EV.qrels(spark, SMALL), tuple(EV.VARIANTS)))
    assert want and whole(EV._cases(spark, SMALL)) == want


def test_one_row_per_document(spark):
    """Bytes of a document's words say what rows of them say, but for words that only other repositories ask for."""
    docs = spark.createDataFrame([("r", 1, "saveAll 页面样式K-load save", ["", "save"]), ("s", 2, None, []), ("t", 3, "save", [])], "repo string, doc_id long, said string, stored array<string>")
    spec, words = {"chunk": (("said",), ("stored",)), "symbol": (("said",), ())}, ["save", "load", "页面"]
    want = {(r.repo, r.doc_id, r.tid, r.packed) for r in BL.token_rows(docs, spec, words).collect() if r.repo == "s" or r.repo == "r" and r.tid != 1}
    got = BL.token_rows(docs, spec, words, {"r": np.array([0, 2]), "s": np.array([], dtype=int)}, True).collect()
    assert len(got) == 2 and {(r.repo, r.doc_id, t, p) for r in got for t, p in zip(np.frombuffer(r.tid, np.int32).tolist(), np.frombuffer(r.packed, np.int64).tolist())} == want and len(want) == 6


def test_keys_are_found_once_per_root(spark):
    roots = ["/srv/O/r.git", "https://h/o/r/tree/main?x", "git@h:o/r", "", None, "one"] * 3
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(roots)], "n long, repo_root string")
    got = keyed(rows, rows.select("repo_root").distinct())
    assert got.columns == ["n", "repo_root", "repo"] and sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.withColumn("repo", T.repository_key(F.col("repo_root"))).collect()))
