import pytest

from lodestone.llm.quality import text_quality, text_stats

PROSE = [
    "The reviewer rewrites the file overview before anyone edits a file, and the label stays partial. It was not what we wanted.", "Ohne Cache verwirft der Planer die Kante zwischen zwei Dateien, weil die Namen fast gleich sind.", "实际上，第二位审阅者改写了两个版本之间的差异，虽然分数并不支持。没有缓存时，重放步骤保留了答案背后的证据。",
    "user: how does the planner know which file it should open first?\nagent: it asks the index, and the index answers with what it has seen.", "## Heading\nThe graph walk rejects an edge that nobody asked for, so the score drops a little.\n- one\n- two\nAfter that it is not the same as before, which is what we see in the log.", "Kutsal ormanda yaşlı bilge sessizce yürüdü. Akşam olunca köylüler ateşin çevresinde toplandı.",
]
OTHER = {
    "list": "- about 75 of the edges\n- expand_frame\n- narrow\n- every anchored path\n- freeze_local_span\n- a missing import", "table": "a;b;c\nx1;0.2;7788\ny2;0.9;12\nz3;;5604\nw4;1;2", "junk": "batch " * 200,
}


@pytest.mark.parametrize("text", PROSE)
def test_prose(text):
    assert text_stats(text)["kind"] == "prose"


@pytest.mark.parametrize("kind", OTHER)
def test_other_kinds(kind):
    assert text_stats(OTHER[kind])["kind"] == kind
    assert text_stats("After the last refresh, the planner has never touched it.\n\n" + OTHER[kind])["kind"] != "prose" or kind == "junk"


def test_statistics():
    s = text_stats("one two\none two\nthree.")
    assert s["words"] == 5 and s["lines"] == 3 and abs(s["line_end_share"] - 1 / 3) < 1e-6 and s["duplicate_line_share"] > 0.3 and s["mean_word_length"] == 3.4


def test_operator(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, " \n\t", "a"), (4, PROSE[0], "a"), (5, "~" * 300_000, "a")], "doc_id long, text string, kind string")
    assert {r.doc_id: r.kind for r in text_quality(df).collect()} == {1: None, 2: None, 3: None, 4: "prose", 5: "junk"}
    assert text_quality(df.limit(0)).count() == 0


def test_repetition_decides():
    from lodestone.llm.quality import text_stats as stats

    sentence = "The reviewer rewrites the file overview before anyone edits a file.\n"
    s = stats(sentence * 5)
    assert s["duplicate_line_share"] > 0.6 and s["kind"] == "junk"
    s = stats(f"{sentence}It was late.\n\n" * 6)
    assert s["duplicate_paragraph_share"] > 0.6 and s["kind"] == "junk"
    s = stats("Home » Share » Close » Home » Share » Close » Next » Home » Share » Close » Prev » Home » Share » Close")
    assert s["top_ngram_share"] > 0.25 and s["kind"] == "junk"
    assert abs(stats("a b a b a b a b")["top_ngram_share"] - 0.75) < 1e-6 and stats("one two three four")["top_ngram_share"] == 0.0


def test_wrapped_sentences_of_a_language_without_a_list():
    wrapped = "Kutsal ormanda yaşlı bilge sessizce yürüdü ve\nkimse onu görmedi. Akşam olunca köylüler\nateşin çevresinde toplandı. Herkes onun\ndöneceğini biliyordu."
    assert text_stats(wrapped)["kind"] == "prose"
