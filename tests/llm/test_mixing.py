import os

import pytest

from lodestone.llm.mixing import mix
from lodestone.llm.tokens import VOCABULARY

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")


def test_shares_caps_and_missing_sources(spark):
    docs = [(i, "word " * (5 + i % 40), "a" if i % 3 else "b", "z") for i in range(900)] + [(9001, None, "a", "z"), (9002, "", "a", "z"), (9003, "x y", None, "z"), (9004, "x y", "other", "z")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, rate string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("none", 0.2, 3)], "source string, target_share double, max_repeats int")
    copies, report = mix(df, targets)
    r = {x.source: x for x in report.collect()}
    assert abs(r["a"].actual_share - 0.625) < 0.01 and abs(r["b"].actual_share - 0.375) < 0.01 and r["none"].docs == 0
    c = copies.collect()
    assert len(c) == 900 and all(x.copies <= (1 if x.source == "a" else 2) for x in c) and not {9001, 9002, 9003, 9004} & {x.doc_id for x in c}


def test_empty_documents(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    copies, report = mix(df, targets)
    assert copies.count() == 0 and report.collect()[0].actual_share == 0.0


def test_shares_meet_their_targets_to_a_documents_size_within_caps(spark):
    docs = [(None if i % 50 == 0 else i, "word " * (3 + (i * 7919) % 90), "abc"[i % 3], "z") for i in range(600)] + [(1, "twice told", "a", "z")] * 2
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, row string")
    targets = spark.createDataFrame([("a", 0.55, 2), ("b", 0.35, 1), ("c", 0.1, 5)], "source string, target_share double, max_repeats int")
    copies, report = mix(df, targets)
    r = {x.source: x for x in report.collect()}
    total = sum(x.used_tokens for x in r.values())
    for s, share, cap in (("a", 0.55, 2), ("b", 0.35, 1), ("c", 0.1, 5)):
        assert abs(r[s].used_tokens - share * total) <= 6 and r[s].most_copies <= cap
    assert r["a"].used_tokens == 2 * r["a"].tokens or r["b"].used_tokens == r["b"].tokens or r["c"].used_tokens == 5 * r["c"].tokens
    got = copies.collect()
    assert len(got) == 602 and sum(x.copies * x.n_tokens for x in got) == total
