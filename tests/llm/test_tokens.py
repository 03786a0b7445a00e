import os
import random

import pytest

from lodestone.llm.tokens import VOCABULARY, codec, encode_texts

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")


def test_tree_equals_flat():
    c, rng = codec(VOCABULARY), random.Random(4)
    bits = ["a", "b", " ", "  ", "\n", "'s", "é", "日", "1", "23", "!", "_", " the", "x" * 50, "🙂", "\t", "aaaa"]
    for _ in range(1500):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 60)))
        assert c.tree(text, rng.choice([1, 3, 10])) == c.flat(text)


def test_long_unsplit_words():
    c = codec(VOCABULARY)
    for word in ("ab" * 30_000, " " * 20_000 + "x", "日本" * 9_000, "0" * 30_000):
        assert c.tree(word, 4000) == c.flat(word)


def test_round_trip_and_operator(spark):
    long = "word " * 9000 + "end"
    df = spark.createDataFrame([(1, "hello world", 1), (2, "", 1), (3, None, 1), (4, long, 1), (5, "<|endoftext|>", 1)], "doc_id long, text string, ids int")
    got = {r.doc_id: r.ids for r in encode_texts(df).collect()}
    c = codec(VOCABULARY)
    assert got[2] == [] and got[3] == [] and got[4] == c.flat(long) and 50256 not in got[5]
    assert b"".join(c.bytes[i] for i in got[1]) == b"hello world"
    sizes = {r.doc_id: r.n_tokens for r in encode_texts(df, counts=True, leaf=7).collect()}
    assert sizes == {k: len(v) for k, v in got.items()}
    assert encode_texts(df.limit(0)).count() == 0


def test_rows_that_share_a_key_stay_apart_and_bad_bytes_are_replaced(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(7, "a b " * 2000), (7, "c d " * 3000), (None, "x")], "doc_id long, text string")
    c = codec(VOCABULARY)
    assert sorted(len(r.ids) for r in encode_texts(df).collect()) == sorted(len(c.flat(t)) for t in ("a b " * 2000, "c d " * 3000, "x"))
    bad = spark.range(1).select(F.col("id").alias("doc_id"), F.expr("cast(unhex('61ff62') as string)").alias("text"))
    assert encode_texts(bad).collect()[0].ids == c.flat("a\ufffdb")


def test_many_leaves_go_to_threads():
    c = codec(VOCABULARY)
    text = "".join(f"word{i} naïve 日本 " for i in range(9000))
    assert c.tree(text) == c.flat(text)
