import pytest

from graphloom.llm import one_form as o

WORDS = "hedge orchard bright census office terrace frames from fruit garden nectar pollen managed blossoms сад улей яблоня зимняя пчелиный рой садовый μέλισσα κήπου φύλλο ελιάς".split()


@pytest.fixture(scope="module")
def scores():
    import pyarrow as pa

    (b,) = o._bigrams([pa.record_batch({"t": WORDS * 5})])
    return o.Scores(dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist())))


def _c(*codes):
    return "".join(map(chr, codes))


CHANGED = [
    ("h" + _c(0x435) + "dge", "hedge"), ("o" + _c(0x0433) + "chard", "orchard"), ("bri" + _c(0x261) + "ht", "bright"), (_c(0x3F2) + "ensu" + _c(0x455), "census"),
    ("cafe" + _c(0x301), "caf\xe9"), (_c(0xFF46, 0xFF52, 0xFF55, 0xFF49, 0xFF54), "fruit"), ("o" + _c(0xFB03) + "ce", "office"), ("hed" + _c(0x200B) + "ge", "hedge"), ("a" + _c(0xA0) + "b", "a b"),
    ("a" + _c(0x3000) + "b", "a b"), ("fruit" + _c(0x2011) + "fly", "fruit-fly"), (_c(0x212A) + "iln", "Kiln"), ("Far " + _c(0x2163), "Far IV"), ("garden" + _c(0xFE0E), "garden"),
    (_c(0x441, 0x61, 0x434), _c(0x441, 0x430, 0x434)), (_c(0x3BC, 0x3AD, 0x3BB, 0x3B9, 0x3C3, 0x3C3, 0x61), _c(0x3BC, 0x3AD, 0x3BB, 0x3B9, 0x3C3, 0x3C3, 0x3B1)), ("nec" + _c(0xAD) + "tar", "nectar"),
    (_c(0x0628, 0x0627, 0x200C, 0x063A), _c(0x0628, 0x0627, 0x063A)), ("tab\there", "tab here"),
]
KEPT = [
    "", "plain text 12", "caf\xe9", _c(0x3B1) + "-pinene", _c(0x3A3) + "-trap", "CO" + _c(0x2082), "10" + _c(0x2075) + " cells", "m" + _c(0xB2), _c(0xBD) + " frame", _c(0x2116) + " 4 yard",
    "grower" + _c(0x2019) + "s", _c(0x201C) + "Old" + _c(0x201D), "May" + _c(0x2013) + "June", _c(0x0645, 0x06CC, 0x200C, 0x0631, 0x0648), _c(0x441, 0x430, 0x434) + " 5", _c(0x43E, 0x441, 0x430),
    _c(0x30AC) + " " + _c(0x306E, 0x5E7C, 0x866B), _c(0x3C6, 0x3CD, 0x3BB, 0x3BB, 0x3BF), "Br\xf8ndal", _c(0x2764, 0xFE0F),
]


@pytest.mark.parametrize("text, want", CHANGED)
def test_brought_to_one_form(scores, text, want):
    assert o.one_form(text, scores) == want
    assert o.one_form(want, scores) == want


@pytest.mark.parametrize("text", KEPT)
def test_left_alone(scores, text):
    assert o.one_form(text, scores) == text


OPENED = [0x2161, 0x2163, 0xFB00, 0xFB03, 0xFB06, 0x132, 0x1C4, 0x587, 0x958]  # one character, shown as several


@pytest.mark.parametrize("code", OPENED)
@pytest.mark.parametrize("after", [[0x200C], [0x200C, 0x200D], [0x200B, 0x200C], [0xFE0F]])
def test_nothing_shown_after_an_opened_sign(scores, code, after):
    text = "Far " + _c(code) + "{} barn"
    assert o.one_form(text.format(_c(*after)), scores) == o.one_form(text.format(""), scores)


def test_non_joiner_after_an_opened_arabic_letter(scores):
    alef, meem = _c(0x0627), _c(0x0645)
    assert o.characters(_c(0x0678, 0x200C) + meem) == o.characters(_c(0x064A, 0x0674, 0x200C) + meem) == _c(0x064A, 0x0674, 0x200C) + meem  # as if it had been written in two letters
    assert o.characters(_c(0x0678, 0x200C) + "b") == _c(0x064A, 0x0674) + "b"
    assert o.characters(alef + _c(0x200C) + meem) == alef + meem


def test_table(spark):
    rows = [("1", "h" + _c(0x435) + "dge", None), ("2", "", "hedge"), (None, "hedge", "a" + _c(0xA0)), ("1", "h" + _c(0x435) + "dge", None), ("3", "x" * 100_000 + _c(0x200B), "z")]
    df = spark.createDataFrame(rows + [("w", w, w) for w in WORDS], "entity_id string, mention_text string, evidence string").selectExpr("*", "5 as __odd2")
    got = o.consistent(df, ["mention_text", "evidence"])
    want = {("1", "hedge", None), ("2", "", "hedge"), (None, "hedge", "a "), ("3", "x" * 100_000, "z")} | {("w", w, w) for w in WORDS}
    out = got.select("entity_id", "mention_text_form", "evidence_form").collect()
    assert {tuple(r) for r in out} == want and len(out) == len(rows) + len(WORDS)
    assert o.consistent(df.limit(0), ["mention_text"]).isEmpty()


def test_all_bigrams_count(spark):
    """More pairs of Han letters than 200,000, each oftener than those of the one Latin word."""
    han = [chr(0x4E00 + i) for i in range(460)]
    rows = [(" ".join([a + b for b in han] * 2),) for a in han] + [("zq",)]
    got = o.bigram_scores(spark.createDataFrame(rows, "x string"), ["x"])
    assert len(got) > 460 * 460 and got["zq"] == 1 and got["^z"] == 1
