"""Round trip, sizes and boundaries of the recursive bisection."""

import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from orelode.llm import bisection as b

PARTS = ["def f(x):\n", "    return 1\n", "\n", "\r\n", " ", "word", "x" * 40, "é", "e\u0301", " \u0301", ",\u0300", "\n\u0308", "😀", ";", "class A:\n", "\t"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=200).map("".join), st.integers(8, 300), st.integers(0, 7))
def test_round_trip_and_sizes(text, capacity, overlap):
    cuts = b.bisect(text, capacity, overlap)
    if len(text) <= capacity:
        assert cuts == []
        return
    assert "".join(text[s:e] for _, s, e in cuts) == text
    assert all(0 < e - o <= capacity and s - o <= overlap for o, s, e in cuts)
    if capacity - overlap >= 12:  # otherwise there may be no other place
        assert all(text[s - 1 : s + 1] != "\r\n" and not unicodedata.combining(text[s]) for _, s, _ in cuts[1:])


def test_cuts_at_the_strongest_boundary():
    text = "a = 1\n" * 30 + "\n\ndef f():\n" + "    b = 2\n" * 30
    (_, _, end), (start, *_rest) = b.bisect(text, 320)
    assert text[end:].startswith("def f") and start == end


def test_no_boundary_and_very_long():
    cuts = b.bisect("x" * 1_000_000, 6000, 400)
    assert all(s - o == 400 for o, s, _ in cuts[1:]) and cuts[-1][2] == 1_000_000


def test_functions_count_lines_by_newline_only():
    text = "x = 1\r\ry = 2\n@deco\nasync def f():\r\n    def g(): pass\r\n    return 1\n"
    assert b.functions_of(text) == [(3, "async def f():\r\n    def g(): pass\r\n    return 1"), (4, "    def g(): pass\r")]
    assert b.functions_of("def f(:") == [] and b.functions_of("\0") == []


def test_split_oversized(spark):
    body = "def f():\n" + "    a = 1  # é\n" * 50
    rows = [(1, "Python ", body, "c"), (2, "java", body, "c"), (3, "python", "def (" + body, "c"), (4, None, None, "c"), (5, "python", "", "c"), (1, "Python", body, "c")]
    got = b.split_oversized(spark.createDataFrame(rows, "file_id bigint, language string, content string, piece string"), 300, 40)
    found = sorted((r["file_id"], r["start_line"]) for r in got.where("piece_no = 0").collect())
    assert found == [(1, 0), (1, 0), (1, 1), (1, 1), (2, 0), (3, 0)]
    assert got.where("n_chars > 300 or length(piece) <> n_chars").count() == 0
    one = [r for r in got.where("file_id = 2").orderBy("piece_no").collect()]
    assert "".join(r["piece"][r["overlap"] :] for r in one) == body
    assert b.split_oversized(spark.createDataFrame([], "file_id bigint, language string, content string"), 300, 40).count() == 0
