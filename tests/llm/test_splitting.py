from hypothesis import given, settings, strategies as st

from lodestone.llm.splitting import split_pieces, split_text


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab \n.é日;"), max_size=3000), st.integers(60, 200), st.integers(0, 20))
def test_pieces_rebuild_the_text(text, limit, overlap):
    spans = split_text(text, limit, overlap)
    assert "".join(text[a + (overlap if i else 0) : b] for i, (a, b) in enumerate(spans)) == text
    assert all(b - a <= limit for a, b in spans) and all(y[0] == x[1] - overlap for x, y in zip(spans, spans[1:]))


def test_cuts_prefer_blank_lines():
    text = "\n\n".join("def f%d():\n    return %d\n    pass" % (i, i) for i in range(40))
    assert all(text[b - 2 : b] == "\n\n" for _, b in split_text(text, 400, 20)[:-1])


def test_long_line_without_places():
    spans = split_text("x" * 100_000)
    assert spans[-1][1] == 100_000 and all(b - a <= 4000 for a, b in spans)


def test_operator(spark):
    body = "\n".join(f"line {i}" for i in range(900))
    rows = [(1, body, 5, 904, "f", 1), (2, None, 1, 1, "g", 1), (3, "", 1, 1, "", 1), (4, body, 904, 5, None, 1), (5, body, None, None, "h", 1), (6, "é" * 4000, 1, 1, "", 1), (7, "🙂" * 4001, 1, None, "", 1)]
    df = spark.createDataFrame(rows, "chunk_no long, text string, start_line int, end_line int, symbol_name string, pieces int")
    got = split_pieces(df).collect()
    assert {r.chunk_no for r in got} == {1, 4, 5, 7}
    one = sorted((r for r in got if r.chunk_no == 1), key=lambda r: r.piece_no)
    assert one[0].start_line == 5 and one[-1].end_line == 904 and one[1].text[:200] == one[0].text[-200:] and one[0].symbol_name == "f"
    assert all(r.start_line is None for r in got if r.chunk_no == 5)
    assert split_pieces(df.limit(0)).count() == 0
