import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.split import LEVELS, BoundaryIndex, cut_level, split_oversized, split_text

PATTERNS = {4: r"\s*\n\s*\n\s*", 3: r"\s*\n\s*", 2: r"\s*\n\s*|(?<=[.!?])\s+", 1: r"\s+"}


def brute_level(text, limit):
    for level in (4, 3, 2, 1):
        if max(len(p) for p in re.split(PATTERNS[level], text.strip())) <= limit:
            return level
    return 0


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab. \n\t", min_size=1, max_size=120), st.integers(4, 30))
def test_level_matches_brute_force(text, limit):
    if len(text) > limit and text.strip():
        assert cut_level(text, limit) == brute_level(text, limit)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab.! \n", max_size=300), st.integers(10, 60), st.integers(0, 4))
def test_pieces_cover_overlap_and_keep_the_limit(text, limit, overlap):
    pieces = split_text(text, limit, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(b - a <= limit for a, b, _ in pieces)
    assert all(second[0] == first[1] - overlap for first, second in zip(pieces, pieces[1:]))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab. \n", min_size=5, max_size=200), st.data())
def test_range_maximum(text, data):
    import numpy as np

    index = BoundaryIndex(text)
    n = len(index.begins)
    if n:
        lo = data.draw(st.integers(0, n - 1))
        hi = data.draw(st.integers(lo + 1, n))
        values = index.table[0] // (n + 1)
        best = max(range(lo, hi), key=lambda i: (values[i], i))
        strength, where = index.strongest(np.array([lo]), np.array([hi]))
        assert (strength[0], where[0]) == (values[best], best)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab.! \n", max_size=300), st.integers(10, 60), st.integers(0, 4))
def test_cuts_are_the_strongest_of_the_whole_window(text, limit, overlap):
    index = BoundaryIndex(text)
    bounds = [(int(s) // (len(index.begins) + 1), int(at)) for s, at in zip(index.table[0], index.begins)]
    for start, end, strength in split_text(text, limit, overlap)[:-1]:
        window = [(s, at) for s, at in bounds if start + overlap < at <= start + limit]
        assert (strength, end) == max(window, default=(0, start + limit))


def test_a_paragraph_break_early_in_the_window_is_cut_at():
    text = "a b. " * 2_000 + "\n\n" + "c d. " * 5_000
    assert cut_level(text, 30_000) == 4 and [p[2] for p in split_text(text)] == [4, 5]


def test_mixed_line_ends():
    words = "abc " * 9
    assert cut_level(f"{words}\r\n{words}", 40) == 3 and cut_level(f"{words}\r\n \r\n{words}", 40) == 4
    assert cut_level(f"{words}\r{words}", 40) == 3 and cut_level(f"{words}\r\r{words}", 40) == 4


def test_operator(spark):
    schema = "chunk_id bigint, text string, id string, piece string, cut_at int"
    big = "word " * 30 + "\n\n" + "x" * 90 + " end"
    rows = [(1, big, "a", "b", 1), (1, big, "a", "b", 2), (2, "short", "", "", 0), (3, None, None, None, None), (4, "y" * 300, "", "", 0), (None, big, "", "", 0), (5, "", "", "", 0)]
    got = split_oversized(spark.createDataFrame(rows, schema), "chunk_id", "text", 100, 10).collect()
    assert {r["id"]: r["cut_at"] for r in got} == {1: "word", 4: "none"}
    one = sorted((r["piece_no"], r["piece"]) for r in got if r["id"] == 1)
    assert one[0][1] + "".join(p[10:] for _, p in one[1:]) == big
    assert split_oversized(spark.createDataFrame([], schema), "chunk_id", "text").count() == 0
    assert LEVELS[cut_level("z" * 31_000 + "。" + "z" * 10, 30_000)] == "none"
