import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import encoding as e

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def enc():
    with open(e.DEFAULT_VOCABULARY, "rb") as f:
        return e.Encoder(f.read())


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


CASES = ["", " ", "\n\n", "a", "Hello world", "<|endoftext|>", "it's we'll I'D", "  two  spaces ", "1234567890", "ｗｉｄｅ", "é́‍👩‍👩‍👧", "日本語テキスト", "\u0000\u0001", "x" * 5000, " " * 3000 + "y", "ab" * 3000, "=" * 4097, "퟿"]


@pytest.mark.parametrize("text", CASES)
def test_like_the_public_tokenizer(enc, public, text):
    assert enc.encode(text) == public(text)
    assert "".join(enc.decode(enc.encode(text))) == text


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(enc, public, text):
    assert enc.encode(text) == public(text)
    assert "".join(enc.decode(enc.encode(text))) == text


def test_streams_are_cut_where_they_are_stable(enc):
    rnd = random.Random(4)
    for alphabet in ("DRAGONSTIEabc ", "ab", "the ingation", "=-"):
        data = "".join(rnd.choice(alphabet) for _ in range(12_000)).encode()
        whole = enc.merge(data)
        for size in (1, 7, 800, 5000):
            chunks = [data[i : i + size] for i in range(0, len(data), size)]
            assert list(enc.stream(chunks)) == whole
            assert list(enc.stream(chunks, window=enc.lookahead + 512)) == whole


LONG = ["x" * 9000 + "1", " " * 9000 + "y", "\n" * 8195 + " y", " " * 8193, "'" * 8191 + "s", "'" * 8192 + "re x", "=" * 8190 + "'ll", " " + "ab" * 9000 + "  ", "7" * 20_000 + "é" * 9000 + "?!" * 9000, "a " * 9000, "日本" * 6000 + "\r\n" * 5000 + "'ve"]


@pytest.mark.parametrize("text", LONG)
@pytest.mark.parametrize("size", [1, 1000, 8192])
def test_chunks_and_runs_longer_than_the_window(enc, public, text, size):
    if size < 3:
        text = text[:20] + text[-8250:]
    chunks = [text[i : i + size] for i in range(0, len(text), size)]
    assert [i for group in enc.transduce(chunks) for i in group] == public(text)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="a'sre l1 \n=é", max_size=40), st.integers(1, 5))
def test_any_chunks(enc, public, text, size):
    assert [i for g in enc.transduce(text[i : i + size] for i in range(0, len(text), size)) for i in g] == public(text)


@pytest.mark.parametrize("piece", ["One run of words, and 12 numbers; it's long.\n", "x", " ", "qzxv"])
def test_memory_stays_flat(enc, piece):
    import tracemalloc

    chunk = (piece * (e.CHUNK // len(piece) + 1))[: e.CHUNK]

    def peak(n):
        tracemalloc.start()
        count = sum(sum(1 for _ in g) for g in enc.transduce(chunk for _ in range(n)))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return count, most

    enc.encode(chunk)
    (few, low), (many, high) = peak(2), peak(8)
    assert many > 3 * few and high < low + (1 << 20)


def test_whole_path_over_long_and_broken_texts(spark, public):
    texts = [None, "", "short", "é" * 70_000 + " end", "x" * 200_000, "  " * 40_000 + "y"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    assert {r["doc_id"]: list(r["ids"]) for r in e.token_ids(df).collect()} == {i: public(t or "") for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["n_tokens"] for r in e.token_counts(df, ["doc_id"]).collect()} == {i: len(public(t or "")) for i, t in enumerate(texts)}
    assert all(r["same"] for r in e.round_trip(df).collect())


def test_lookahead_of_a_small_list():
    import base64

    tokens = [bytes([i]) for i in range(256)] + [b"bc", b"ab", b"cd"]
    own = e.Encoder(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens)))
    # whether 'ab' is merged rests on a 'c' after it, for 'bc' comes first: two bytes after the left part
    assert own.lookahead == 2
    assert own.merge(b"abcd") == [ord("a"), 256, ord("d")]
    with pytest.raises(ValueError):
        e.Encoder(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate([bytes([i]) for i in range(256)] + [b"abc"]))).lookahead


def test_empty_null_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "a b", 5), (4, "a b", 5), (4, "a b", 5)], "doc_id bigint, text string, ids int")
    rows = [(r["doc_id"], list(r["ids"])) for r in e.token_ids(df).collect()]
    assert sorted(rows, key=str) == sorted([(1, []), (2, []), (None, [64, 275]), (4, [64, 275]), (4, [64, 275])], key=str)
    assert e.token_ids(df.limit(0)).isEmpty()
    assert {r["n_tokens"] for r in e.token_counts(df, ["doc_id"]).collect()} == {0, 2}


def test_bounded_cache(enc, monkeypatch):
    monkeypatch.setattr(e, "CACHE", 5)
    own = e.Encoder(b"\n".join(b"%s %d" % (__import__("base64").b64encode(t), i) for t, i in enc.ranks.items()))
    assert own.encode("one two three four five six seven") == enc.encode("one two three four five six seven") and len(own) <= 6
