import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm.split import spans, split_texts


def _check(text, limit, overlap):
    s = spans(text, limit, overlap)
    assert s[0][0] == 0 and s[-1][1] == len(text)
    assert all(b - a <= limit for a, b in s)
    for (a, b), (c, d) in zip(s, s[1:]):
        assert a < c <= b < d and b - c <= overlap
    if len(text) <= limit:
        assert len(s) == 1
    return s


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab .,\n\r;!Á "), max_size=400), st.integers(20, 60), st.integers(0, 9))
def test_any_text(text, limit, overlap):
    _check(text, limit, overlap)


def test_least_number_of_pieces_without_boundaries():
    for n in (4000, 4001, 7800, 7801, 11600, 11601, 100_000):
        assert len(_check("x" * n, 4000, 200)) == (1 if n <= 4000 else 1 + -(-(n - 4000) // 3800))


def test_paragraphs_are_preferred_and_balanced():
    text = ("One sentence of some length here. " * 20 + "\n\n") * 14
    s = _check(text, 4000, 200)
    assert all(text[:b].endswith("\n\n") for _, b in s[:-1])
    sizes = [b - a for a, b in s]
    assert max(sizes) < 1.6 * min(sizes)


def test_line_ends_are_not_torn():
    text = "ab\r\n" * 3000
    assert all(text[b - 2 : b] == "\r\n" for _, b in _check(text, 4000, 200)[:-1])


def test_wide_texts_of_many_lengths():
    rnd = random.Random(1)
    for _ in range(200):
        _check("".join(rnd.choice("xxxxx xx. \n") for _ in range(rnd.randrange(3000))), 200, 20)


def test_table(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "a " * 4000, 0), (3, "a " * 4000, 0)], "doc_id bigint, source_text string, piece int")
    rows = split_texts(df, "doc_id", "source_text").collect()
    assert [r for r in rows if r["doc_id"] == 1] == [] and [r["piece"] for r in rows if r["doc_id"] == 2] == [""]
    assert {len([r for r in rows if r["doc_id"] == 3])} == {6}
    assert split_texts(df.limit(0), "doc_id", "source_text").isEmpty()
    with pytest.raises(ValueError):
        split_texts(df, "doc_id", "source_text", 100, 60)


def test_a_boundary_far_from_the_target_is_better_than_a_hard_cut():
    text = "ab " * 430 + "x" * 2400 + " cd" * 430
    s = _check(text, 4000, 200)
    assert len(s) == 2 and all(text[b - 1] == " " or text[b : b + 1] == " " for _, b in s[:-1])
    # with one piece more, the cuts avoid the run
    text = "ab " * 100 + "x" * 3600 + " cd" * 1230
    assert all(text[b - 1] == " " for _, b in _check(text, 4000, 200)[:-1])
