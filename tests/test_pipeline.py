import json

import pytest
from pyspark.sql import functions as F

from graphloom.config import Settings
from graphloom.errors import GraphError, ResponseError
from graphloom.extract import ClientExtractor, RuleExtractor, TableExtractor, require_answers, requests
from graphloom.ontology import Ontology
from graphloom.operators import dot
from graphloom.plans.pipeline import Pipeline
from graphloom.sources.wire import parse, read_answer

from test_graph import CE, CR, E, R

ONTOLOGY = Ontology({"thing": {}}, {"links": {}})


class Stored(TableExtractor):
    """A fixed extraction; everything is cast to thing and links."""

    def __init__(self, spark, entities, relations):
        e = spark.createDataFrame([(d, i, x, m, "t", "", "", None) for d, i, x, m in entities], E)
        r = spark.createDataFrame([(d, i, x, s, t, f, "", None) for d, i, x, s, t, f in relations], R)
        super().__init__(e, r, None, None)

    cast = RuleExtractor.cast
    types = ("thing", "links")


def _docs(spark, *ids):
    return spark.createDataFrame([(d, f"text {d}") for d in ids], "doc_id bigint, text string")


def test_parallel_edges_are_kept(spark):
    x = Stored(spark, [(1, 0, "e1", "alpha"), (1, 1, "e2", "beta")], [(1, 0, "r1", "e1", "e2", "first"), (1, 1, "r2", "e1", "e2", "second")])
    res = Pipeline(x, ONTOLOGY, Settings(max_density=1.0)).run(_docs(spark, 1))
    assert res.quarantine.isEmpty()
    assert res.edges.count() == 2 and res.normalization.first()["note"] is None
    assert {r["node_context"] for r in res.nodes.collect()} == {"Context for alpha.", "Context for beta."}
    assert "links" in dot.dot_texts(dot.dot_lines(res.nodes, res.edges)).first()["dot"]
    run = res.runs.first()
    assert run["model"] == "gpt-4o-mini" and len(run["source_sha256"]) == len(run["prompt_sha256"]) == 64


def test_an_isolated_node_is_dropped(spark):
    x = Stored(spark, [(1, 0, "e1", "alpha"), (1, 1, "e2", "beta"), (1, 2, "e3", "isolated")], [(1, 0, "r1", "e1", "e2", "links")])
    res = Pipeline(x, ONTOLOGY).run(_docs(spark, 1))
    assert {r["entity_id"] for r in res.nodes.collect()} == {"e1", "e2"}
    assert [r["entity_id"] for r in res.fate_entities.where("not retained").collect()] == ["e3"]
    for policy, kept in (("preserve", 3), ("largest_component", 2)):
        assert Pipeline(x, ONTOLOGY, Settings(disconnected_policy=policy, context_policy="disabled")).run(_docs(spark, 1)).nodes.count() == kept
    out = Pipeline(x, ONTOLOGY, Settings(disconnected_policy="raise")).run(_docs(spark, 1))
    assert [(r["stage"], r["code"]) for r in out.quarantine.collect()] == [("normalization", "DISCONNECTED")]


def test_each_failure_is_a_row(spark):
    e = [(d, i, f"e{i}", f"m{i}") for d in (1, 2, 3) for i in range(3)] + [(3, 3, "e0", "again")]
    r = [(d, i, f"r{i}", f"e{i}", f"e{i + 1}", "l") for d in (1, 3) for i in range(2)] + [(2, 0, "r0", "e0", "zzz", "l")]
    docs = _docs(spark, 1, 2, 3, 5).union(spark.createDataFrame([(4, " 　")], "doc_id bigint, text string"))
    x = Stored(spark, e, r)
    res = Pipeline(x, ONTOLOGY, Settings(max_density=1.0)).run(docs)
    got = {(q["doc_id"], q["stage"], q["code"]) for q in res.quarantine.collect()}
    assert got == {(4, "input", "BLANK_TEXT"), (2, "extraction", "UNKNOWN_ENDPOINT"), (3, "extraction", "DUP_ENTITY")}
    assert {q["doc_id"] for q in res.runs.collect()} == {1, 5}  # a document without entities is an empty graph, not an error
    strict = Pipeline(x, ONTOLOGY, Settings(strict_validation=True)).run(docs)
    assert (5, "INVALID_GRAPH") in {(q["doc_id"], q["code"]) for q in strict.quarantine.collect()}
    with pytest.raises(GraphError):
        Pipeline(x, ONTOLOGY, on_error="raise").run(docs)
    with pytest.raises(ValueError):
        Pipeline(x, ONTOLOGY, on_error="other")


def test_castings_are_checked(spark):
    class Bad(Stored):
        def cast(self, docs, entities, relations):
            e, r = RuleExtractor.cast(self, docs, entities, relations)
            return e.withColumn("ontology_type", F.when(F.col("doc_id") == 1, "nope").otherwise("thing")), r

    x = Bad(spark, [(d, i, f"e{i}", "m") for d in (1, 2) for i in range(2)], [(d, 0, "r", "e0", "e1", "l") for d in (1, 2)])
    res = Pipeline(x, ONTOLOGY).run(_docs(spark, 1, 2))
    assert [(q["doc_id"], q["code"]) for q in res.quarantine.collect()] == [(1, "UNKNOWN_TYPE")]


ENTITY = {"id": "e1", "mention_text": "a", "free_type": "t", "description": "", "evidence": "", "confidence": None}
RELATION = {"id": "r1", "source_id": "e1", "target_id": "e1", "free_type": "t", "evidence": "", "confidence": 1}


def test_answers_are_read_strictly(spark):
    good = {"entities": [ENTITY], "relations": [RELATION], "notes": ""}
    assert read_answer(json.dumps(good), "extraction")[0]["entities"][0]["entity_id"] == "e1"
    for bad in (None, "", "[]", "{", json.dumps({"entities": [], "relations": []}), json.dumps(good | {"more": 1}), json.dumps(good | {"entities": [ENTITY | {"x": 1}]}), json.dumps(good | {"entities": [ENTITY | {"id": 5}]}), json.dumps(good | {"notes": 1}), json.dumps(good | {"relations": 1})):
        assert read_answer(bad, "extraction")[0] is None and read_answer(bad, "extraction")[1]
    cast = {"entities": [{"id": "e", "ontology_type": None, "canonical_name": "", "attributes": [{"key": "k", "value": "1"}, {"key": "k", "value": "2"}], "confidence": 0.5}], "relations": [], "notes": ""}
    df = spark.createDataFrame([(1, json.dumps(cast)), (2, "no")], "doc_id bigint, said string")
    rows = {r["doc_id"]: r for r in parse(df, "said", "casting").collect()}
    assert rows[1]["answer"]["entities"][0]["attributes"] == {"k": "2"} and rows[2]["answer"] is None and rows[2]["problem"]


class Client:
    def extract(self, payload):
        text = json.loads(payload)["source_text"]
        if text == "text 2":
            raise RuntimeError("no connection")
        es = [ENTITY | {"id": f"e{i}", "mention_text": w} for i, w in enumerate(["x", "y"])]
        return json.dumps({"entities": es, "relations": [RELATION | {"source_id": "e0", "target_id": "e1"}], "notes": ""})

    def cast(self, payload):
        data = json.loads(payload)
        assert list(data) == ["source_text", "free_extraction", "ontology"] and list(data["free_extraction"]) == ["entities", "relations", "notes"]
        e = [{"id": x["entity_id"], "ontology_type": "thing", "canonical_name": "", "attributes": [], "confidence": None} for x in data["free_extraction"]["entities"]]
        r = [{"id": x["relation_id"], "source_id": x["source_id"], "target_id": x["target_id"], "ontology_type": "links", "attributes": [], "confidence": None} for x in data["free_extraction"]["relations"]]
        return json.dumps({"entities": e, "relations": r, "notes": ""})

    def contexts(self, payload):
        data = json.loads(payload)
        assert list(data) == ["source_text", "nodes", "relations", "ontology", "context_config"] and len(data["relations"]) == 1
        nodes = data["nodes"]
        return json.dumps({"contexts": [{"id": n["id"], "summary": "It is.", "evidence": ["a", "b", "c"], "uncertainty": None} for n in nodes]})


def test_a_client_per_document(spark):
    x = ClientExtractor(Client)
    res = Pipeline(x, ONTOLOGY, Settings(max_density=1.0)).run(_docs(spark, 1, 2))
    assert {(q["doc_id"], q["code"]) for q in res.quarantine.collect()} == {(2, "BAD_ANSWER")}
    assert {r["entity_id"] for r in res.nodes.collect()} == {"e0", "e1"} and [r["doc_id"] for r in res.runs.collect()] == [1]
    assert all(len(r["evidence"]) == 2 and r["uncertainty"] == "" for r in res.contexts.collect())
    with pytest.raises(ResponseError, match="no connection|object"):
        require_answers(res.quarantine)


def test_rule_numbers_words_of_long_documents(spark):
    text = "Pollination matters. " * 30_000 + "orchards flourish " * 60_000
    e, r = RuleExtractor().extract(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id bigint, text string"))
    assert {(x["entity_id"], x["ord"]) for x in e.collect()} == {("pollination", 0), ("matters", 1), ("orchards", 60_000), ("flourish", 60_001)}
    assert r.count() == r.select("ord").distinct().count() == 30_000 + 120_000 - 1 and {x["source_id"] for x in r.where("ord < 3").collect()} == {"pollination"}


def test_scratch_tables_are_removed(spark):
    import os

    from graphloom.util import cut, scratch

    with scratch(spark):
        inner = cut(spark.range(3))
        path = inner.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
        assert inner.count() == 3 and os.path.exists(path)
    assert not os.path.exists(path)
    kept = cut(spark.range(2))
    with scratch(spark):
        pass
    assert kept.count() == 2


def test_requests(spark):
    r = requests(spark.createDataFrame([(1, "one two three")], "doc_id bigint, text string")).first()
    assert json.loads(r["payload"]) == {"source_text": "one two three", "extraction_density": {"entities_per_word": 0.1, "relations_per_entity": 2.0}, "target_counts": {"word_count": 3, "target_entity_count": 1, "target_relation_count": 2}}


def test_stream_of_documents(spark, tmp_path):
    import os

    from graphloom.util import cut
    from graphloom.streaming.batches import each_batch, run_stream
    from graphloom.streaming.counts import sessions, type_counts, without_copies

    src = tmp_path / "in"
    spark.createDataFrame([(1, "Pollination matters. Orchards flourish, orchards flower."), (2, "")], "doc_id bigint, text string").write.parquet(str(src / "a"))
    stream = spark.readStream.schema("doc_id bigint, text string").parquet(str(src / "*"))
    spark.range(1).transform(cut)  # sets the folder
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(os.listdir(folder))
    run_stream(stream, Pipeline(RuleExtractor(), ONTOLOGY, Settings(context_policy="disabled")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert set(os.listdir(folder)) == before
    assert {r["doc_id"] for r in spark.read.parquet(str(tmp_path / "out" / "runs")).collect()} == {1}
    assert {r["code"] for r in spark.read.parquet(str(tmp_path / "out" / "quarantine")).collect()} == {"BLANK_TEXT"}
    each_batch(stream, lambda b: b.select("doc_id"), str(tmp_path / "o2"), str(tmp_path / "cp2")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "o2")).count() == 2
    ev = tmp_path / "ev"
    spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,id) as t, 'k' as kind, id % 2 as u from range(30)").write.parquet(str(ev / "a"))
    events = spark.readStream.schema("t timestamp, kind string, u bigint").parquet(str(ev / "*"))
    for name, df, mode in (("counts", type_counts(events, "t", "kind"), "complete"), ("slide", type_counts(events, "t", "kind", slide="12 hours"), "complete"), ("once", without_copies(events, ["u"], "t"), "append")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert sorted(r["n"] for r in spark.table("counts").collect()) == [6, 24]
    assert spark.table("once").count() == 2
    assert sessions(events, "u", "t").isStreaming


def test_levels(spark):
    from graphloom.operators import abstraction

    v = spark.createDataFrame([(i, [float(i % 2), 1.0 - i % 2]) for i in range(20)] + [(99, None), (98, [0.0, 0.0])], "id int, v array<float>")
    members, centres = abstraction.clusters(v, "v", 2)
    got = abstraction.recognise(v, "v", centres, 0.5)
    assert got.where("id < 90").select("id", "concept_id").join(members, ["id", "concept_id"]).count() == 20
    assert got.where("id >= 98 and concept_id is null").count() == 2
    nodes = spark.createDataFrame([(1, x) for x in "abcd"], "doc_id bigint, entity_id string")
    edges = spark.createDataFrame([(1, "a", "b", "t"), (1, "a", "c", "t"), (1, "b", "d", None), (1, "a", "d", "t")], "doc_id bigint, source_id string, target_id string, type string")
    of = spark.createDataFrame([(1, "a", "x"), (1, "b", "x"), (1, "c", "y"), (1, "d", None), (1, "zz", "y")], "doc_id bigint, entity_id string, concept_id string")
    n, e, lineage = abstraction.lift(nodes, edges, of, 2)
    assert {tuple(r) for r in n.collect()} == {(1, "2:x", 2), (1, "2:y", 1)}
    assert {tuple(r) for r in e.collect()} == {(1, "2:x", "2:y", "t", 1)}
    assert lineage.count() == 3
    up = spark.createDataFrame([("x", "top"), ("y", "top"), ("top", None)], "concept_id string, parent string")
    n, e, lineage = abstraction.levels(nodes, edges, of, up)
    assert {tuple(r) for r in n.where("level > 0").collect()} == {(1, 1, "1:x"), (1, 1, "1:y"), (2, 1, "2:top")}
    assert {(r["level"], r["n_base"]) for r in e.where("level > 0").collect()} == {(1, 1)} and lineage.count() == 3 + 2
    with pytest.raises(RuntimeError):
        abstraction.levels(nodes, edges, of, spark.createDataFrame([("x", "y"), ("y", "x")], "concept_id string, parent string"))
    f = spark.createDataFrame([(1, "p", 3), (1, "q", 4), (2, "z", 1)], "doc_id bigint, motif string, n bigint")
    assert {r["doc_id"]: list(r["vector"]) for r in abstraction.motif_vectors(f, ["p", "q", "r"]).collect()} == {1: [0.6, 0.8, 0.0], 2: [0.0, 0.0, 0.0]}


def test_model_client():
    from types import SimpleNamespace

    from graphloom.config import Density
    from graphloom.errors import MissingDependency
    from graphloom.prompts import Prompt
    from graphloom.sources.model import ModelClient, responses_sender

    prompt = Prompt.default().render(ONTOLOGY, Density())
    sent = []

    def send(system, user, which):
        sent.append((system, user, which))
        return "{}" if "none" not in user else None

    c = ModelClient(send, prompt, ONTOLOGY.prompt_schema())
    assert c.extract('{"source_text":"é","n":0.1}') == "{}" and sent[-1] == (prompt.free_extraction_system, '{"source_text": "é", "n": 0.1}', "extraction")
    c.cast(json.dumps({"source_text": "x", "ontology": ONTOLOGY.prompt_schema()}))
    assert json.loads(sent[-1][1])["ontology"] == ONTOLOGY.prompt_schema() and sent[-1][2] == "casting"
    with pytest.raises(ValueError):
        c.cast(json.dumps({"ontology": {}}))
    c.contexts(json.dumps({"nodes": [{"id": "é"}]}))
    assert '"id": "é"' in sent[-1][1]
    with pytest.raises(ResponseError):
        c.extract('"none"')
    with pytest.raises(ValueError):
        ModelClient(send, Prompt.default(), {})
    pytest.importorskip("pydantic")
    said = {"entities": [ENTITY], "relations": [RELATION | {"confidence": 1.0}], "notes": ""}
    asked = {}

    def ask(**given):
        asked.update(given)
        return SimpleNamespace(output_parsed=given["text_format"].model_validate(said) if given["model"] == "m" else None)

    fake = SimpleNamespace(responses=SimpleNamespace(parse=ask))
    assert read_answer(responses_sender("m", fake)("a", "b", "extraction"), "extraction")[0]["notes"] == ""
    assert [x["role"] for x in asked["input"]] == ["system", "user"] and responses_sender("n", fake)("a", "b", "extraction") is None
    form = asked["text_format"]
    for bad in (said | {"more": 1}, {k: v for k, v in said.items() if k != "notes"}, said | {"entities": [ENTITY | {"id": 5}]}):
        with pytest.raises(ValueError):
            form.model_validate(bad)
    try:
        import openai  # noqa: F401
    except ImportError:
        with pytest.raises(MissingDependency):
            responses_sender("m")
