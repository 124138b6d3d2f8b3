import random

import pytest

from graphloom.llm import canonical as ca
from graphloom.llm import spam as sp

NAMES = [
    ("honey_colony", "honey_colony"), ("honey_colony", "bee nation"), ("orchard_cultivar", "Orchard cultivar"), ("orchard_cultivar", "fruit variety"), ("orchard_cultivar", "named apple sort"),
    ("irrigation_channel", "watering ditch"), ("valley_terrace", "bench plot"), ("brood_parasite", "larval freeloader"), ("late_frost", "killing cold snap"), ("market_town", "trading borough"),
    ("pollinates", "pollinates"), ("taught_in", "taught in"), ("drought_spell", "parched weeks"), ("pruning_tool", "secateurs"),
]
MEANT = [
    ("Honey_colony", "honey_colony"), ("\tnaed  appl  sort\xa0", "orchard_cultivar"), ("Plot bench", "valley_terrace"), ("DITCH.OF.WATERING", "irrigation_channel"), ("Orchard Cult.\n", "orchard_cultivar"),
    ("KÍ11ÍNG CO1D SNAP", "late_frost"), ("ＯｒｃｈａｒｄＣｕｌｔｉｖａｒ", "orchard_cultivar"), ("possible bee nation (?)", "honey_colony"), ("BOROUGHTRADING", "market_town"), ("Po11ínates", "pollinates"),
    ("TAUNHT IN", "taught_in"), ("LARVALFREELOADER", "brood_parasite"), ("local larval freeloader near a honey colony", "brood_parasite"), ("Parched_Weeks", "drought_spell"), ("secatres", "pruning_tool"),
    ("POSSIBLEBEENATION", "honey_colony"), ("NATIONBEE", "honey_colony"), ("Kind of Bee nation", "honey_colony"), ("polli.", "pollinates"), ("CUTIVARORCHARD", "orchard_cultivar"),
]
NONE = ["poem", "ice rink", "n/a", "-", "…", "42", "tram ticket", "Vulkanologie", "unknown", "chess opening", "​", "x" * 20_000]


@pytest.fixture(scope="module")
def matcher():
    return ca.Matcher(NAMES, ca.THRESHOLD)


@pytest.mark.parametrize("value, entry", MEANT + [(v, "") for v in NONE])
def test_meaning(matcher, value, entry):
    assert matcher[value].entry == entry


def test_ties_and_margins_show():
    own = ca.Matcher([("b", "long hive"), ("a", "Long Hive"), ("c", "long dive"), ("d", "frame")], ca.THRESHOLD)
    assert own["a long hive"] == ca.Choice("a", 1.0, "b", 1.0)
    assert own["long xive"].score == own["long xive"].next_score and own["long xive"].entry == "a"
    assert own["frame"].entry == "d" and own["frame"].score > own["frame"].next_score
    none = own["lo"]
    assert none.entry == "" and none.score == 0.0


def test_index_finds_what_a_walk_over_all_aliases_finds(matcher):
    rnd = random.Random(9)
    every = ca.Matcher(NAMES, ca.THRESHOLD)
    every.joined.near = lambda word, least: list(range(len(every.aliases)))
    every.single.near = lambda word, least: list(range(len(every.tokens)))
    for _ in range(400):
        w = list(rnd.choice(NAMES)[1])
        for _ in range(rnd.randrange(5)):
            w[rnd.randrange(len(w))] = rnd.choice("abcdeinorst _")
        assert matcher["".join(w)] == every["".join(w)]


def _osa(a, b):
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_distance_and_its_bounds():
    rnd = random.Random(3)
    for _ in range(2000):
        a, b = ("".join(rnd.choice("abcd") for _ in range(rnd.randrange(0, 12))) for _ in range(2))
        true, long = _osa(a, b), max(len(a), len(b))
        assert ca.distance(ca.Word(a), b) == true
        s = 1 - true / long if long else 0
        assert ca.similarity(ca.Word(a), ca.Word(b), 0.6) == pytest.approx(s if s >= 0.6 else 0)


def test_table(spark):
    df = spark.createDataFrame([("1", "Plot bench"), ("2", None), ("3", ""), ("1", "Plot bench"), ("4", "poem")], "id string, value string").selectExpr("*", "5 as other")
    rows = ca.map_values(df, "value", NAMES).collect()
    assert sorted((r["id"], r["type_id"] if r["type_id"] is not None else "-") for r in rows) == [("1", "valley_terrace"), ("1", "valley_terrace"), ("2", "-"), ("3", ""), ("4", "")]
    assert {r["type_id"] for r in ca.map_values(df, "value", []).collect()} == {None, ""}
    assert ca.map_values(df.limit(0), "value", NAMES).isEmpty()
    kinds = spark.createDataFrame([("a", "A b", ["x", None]), ("c", None, None), (None, "z", [])], "id string, label string, synonyms array<string>")
    assert set(ca.aliases_of(kinds, "id", ["label"], ["synonyms"])) == {("a", "a"), ("a", "A b"), ("a", "x"), ("c", "c")}


def _cues(lines):
    return "".join(f"{i + 1}\n00:00:{i % 60:02},000 --> 00:00:{i % 60:02},900\n{x}\n\n" for i, x in enumerate(lines))


NOUNS = "river garden teacher winter letter engine bridge window basket brother station valley lantern candle meadow".split()


def _speech(rnd, n=30):
    return [f"{rnd.choice(['The', 'A', 'Every', 'No'])} {rnd.choice(NOUNS)} {rnd.choice(['kept', 'saw', 'left', 'sold'])} the {rnd.choice(NOUNS)} {rnd.choice(['near', 'under', 'after'])} that {rnd.choice(NOUNS)}." for _ in range(n)]


SPAM = {
    "keywords": lambda r: [" ".join(r.choice(["loan", "buy", "cheap", "tyres", "online"]) for _ in range(9)) for _ in range(20)],
    "pairs": lambda r: [", ".join(f"{r.choice(['buy', 'best'])} {r.choice(['sofa', 'lamp'])}" for _ in range(5)) for _ in range(20)],
    "places": lambda r: [f"discount lamp {''.join(r.choice('abcdefgh') for _ in range(6))}" for _ in range(30)],
    "hidden": lambda r: ["​".join("tyres") + " deal, v.i.t.a.m.i.n.s deal, l04n deal, s o f a deal" for _ in range(15)],
    "sentences": lambda r: [f"{r.choice(['This', 'The', 'A'])} lamp {r.choice(['near', 'under'])} lamp lamp." for _ in range(25)],
    "links": lambda r: [f"https://www.{''.join(r.choice('abcdefgh') for _ in range(7))}.example/x" for _ in range(15)] + ["Lamp > www.abc.test/?id=5", "some dot invalid"],
    "navigation": lambda r: [x for _ in range(8) for x in ("Home", "Shop | Sitemap | Login | Tags | sofa", "Contact » Archive » Next")],
    "products": lambda r: [f"{r.choice(['Sofa', 'Lamp', 'Ring'])} {r.choice(['GAR', 'TIN'])}-{r.randrange(9999)} {r.randrange(400)}.99 EUR" for _ in range(25)],
    "hashtags": lambda r: [" ".join("#" + r.choice(["lamp", "lampbuy", "sofabest"]) for _ in range(6)) for _ in range(15)],
}
CLEAN = {
    "song": lambda r: [f"♪ {x} ♪" for x in _speech(r, 6) * 4],
    "chant": lambda r: ["Olano! Olano! Olano!", "Olano!", "15..."] * 8,
    "credits": lambda r: [x for _ in range(20) for x in (r.choice(["Music", "Sound", "Camera"]), "".join(r.choice("abcdefgh") for _ in range(9)).title() + " " + "".join(r.choice("ijklmno") for _ in range(8)).title())],
    "effects": lambda r: ["[thunder]", "[door creaks]", "(applause)", "*Engine starts*"] * 6,
    "lesson": lambda r: [x for n in NOUNS for x in (f"{n.title()}. {n}.", f"The {n} kept the garden.", "(lesson)")],
    "advert": lambda r: ["Corrected by Olan, visit www.abc.test", *_speech(r), "Get 20% off at www.abc.test today!"],
    "talk": lambda r: _speech(r) + ["The sofa is at www.abc.test, she said.", "I bought that lamp for $ 20 after the winter."] * 3,
}


def test_spam(spark):
    rnd = random.Random(11)
    rows, want = [], set()
    for i in range(400):
        rows.append((i, _cues(_speech(rnd)), rnd.choice(["en", "EN", "eng", None, "und"])))
    for k, (name, make) in enumerate({**SPAM, **CLEAN}.items()):
        for j in range(3):
            doc = 1000 + 10 * k + j
            rows.append((doc, _cues(make(rnd)), "en"))
            if name in SPAM:
                want.add(doc)
    mixed = _speech(rnd, 12)
    listed = SPAM["keywords"](rnd)
    rows += [(5001, _cues(mixed + listed * 2), "en"), (5002, _cues(_speech(rnd, 60) + listed[:10]), "en"), (5003, None, "en"), (5004, "", None), (5005, "1\n00:00:01,000 --> 00:00:02,000\n", "en"), (5001, _cues(mixed + listed * 2), "en")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").selectExpr("*", "1 as k", "2 as g")
    got = [r["doc_id"] for r in sp.spam(df).collect()]
    assert set(got) == want | {5001}
    scores = sp.spam_scores(df)
    assert {5003, 5004, 5005}.isdisjoint({r["doc_id"] for r in scores.collect()})
    assert sp.spam(df.limit(0)).isEmpty()
    # the languages 'fr' of two documents and null keys take part too
    few = df.unionByName(spark.createDataFrame([(None, _cues(SPAM["keywords"](rnd)), "fr"), (7001, _cues(_speech(rnd)), "fr")], "doc_id bigint, text string, lang string").selectExpr("*", "1 as k", "2 as g"))
    assert {r["doc_id"] for r in sp.spam(few).collect()} == want | {5001, None}


def _features(rnd):
    """Ordinary texts, spam, a text that lists much but speaks like the others, and one that lists less and is spam in all else."""
    rows = [(f"n{i}", "en", max(0.0, rnd.gauss(0.01, 0.02)), 0.0, rnd.gauss(0.81, 0.05), 0.0, min(1.0, rnd.gauss(0.93, 0.03))) for i in range(300)]
    rows += [(f"s{i}", "en", rnd.uniform(0.8, 1), rnd.uniform(0.2, 1), rnd.uniform(0.3, 0.6), rnd.uniform(0.5, 1), rnd.uniform(0, 0.1)) for i in range(40)]
    return rows + [("speaks", "en", 0.54, 0.0, 0.81, 0.0, 0.93), ("spam", "en", 0.46, 0.46, 0.3, 0.9, 0.0)]


def test_distance_and_direction_decide(spark, monkeypatch):
    df = spark.createDataFrame(_features(random.Random(5)), "k string, g string, " + ", ".join(f"{f} double" for f in sp.FEATURES))
    want = {f"s{i}" for i in range(40)}
    got = {r["k"] for r in sp.decided(df).where("spam").collect()}
    assert got == want | {"spam"}
    assert {r["k"] for r in df.where("listing > 0.5").collect()} == want | {"speaks"}
    # without the scatter the position is that of the listing share and its like, and the rows change
    monkeypatch.setattr(sp, "FLOOR", (1e-3, 1e3, 1e3, 1e3, 1e3))
    assert {r["k"] for r in sp.decided(df).where("spam").collect()} != got


def test_estimate_bears_spam_in_nearly_half_of_a_language(spark):
    rnd = random.Random(8)
    rows = _features(rnd)[:300] + [(f"x{i}", "en", 1.0, 1.0, 0.3, 0.9, 0.0) for i in range(250)]
    df = spark.createDataFrame(rows, "k string, g string, " + ", ".join(f"{f} double" for f in sp.FEATURES))
    centre, _ = sp.robust_estimates(df)["en"]
    assert abs(centre[0] - 0.01) < 0.05 and abs(centre[4] - 0.93) < 0.05
    assert sp.decided(df).where("spam").count() == 250
