import json

import pytest

from graphloom.config import ContextSettings, Density, Settings
from graphloom.errors import RenderError
from graphloom.ontology import Ontology, closure, domain_range_audit, inverse_edges
from graphloom.prompts import Prompt, block
from graphloom.sources import files

ONTOLOGY = {"ontology": {"id": "o", "version": "1"}, "entity_types": {"thing": {"label": "Thing"}, "sub": {"parent": "thing", "synonyms": ["s"]}}, "relation_types": {"links": {"domain": "thing", "range": "thing", "inverse": "linked"}}, "dropped": 1}


def test_settings_round_trip():
    s = Settings.from_mapping({"model": "test-model", "extraction_density": {"relations_per_entity": 1}, "node_context": {"max_sentences": 2}, "strict_validation": "false"})
    assert (s.model, s.extraction_density, s.node_context.max_sentences, s.strict_validation) == ("test-model", Density(0.1, 1.0), 2, True)
    assert Settings.from_mapping(s.to_mapping()) == s
    assert json.loads(json.dumps(s.to_mapping()))["prompt_template_path"] is None
    for bad in ({"model": " "}, {"disconnected_policy": "x"}, {"context_policy": "per_node"}):
        with pytest.raises(ValueError):
            Settings(**bad)


def test_density_and_context_settings(tmp_path):
    (tmp_path / "d.json").write_text('{"entities_per_word": 0.05, "relations_per_entity": 1}')
    d = Density.load(tmp_path / "d.json")
    assert Density.parse(d.text()) == d == Density(0.05, 1.0)
    with pytest.raises(ValueError):
        Density.parse("[1]")
    with pytest.raises(ValueError):
        Density(-1)
    with pytest.raises(ValueError):
        ContextSettings(max_sentences=0)
    assert ContextSettings.from_mapping(ContextSettings(2, 1, False, False).to_mapping()) == ContextSettings(2, 1, False, False)


def test_prompt(tmp_path):
    o = Ontology.from_mapping(ONTOLOGY)
    p = Prompt.default()
    r = p.render(o, Density(0.05, 1.0), "m")
    assert r.rendered and not p.rendered
    assert r.free_extraction_system.startswith(p.free_extraction_system + "\n\nRUNTIME EXTRACTION DENSITY\n")
    assert r.free_extraction_system.endswith(block({"entity_type_ids": ["sub", "thing"], "relation_type_ids": ["links"]}))
    assert r.ontology_casting_system.endswith(block({"metadata": {"id": "o", "version": "1"}, **o.prompt_schema()}))
    assert r.render_context["ontology"] == {"id": "o", "version": "1"} and list(r.render_context) == ["template_name", "template_version", "ontology", "entity_type_ids", "relation_type_ids", "extraction_density", "node_context", "model"]
    with pytest.raises(ValueError):
        r.render(o, Density())
    assert Prompt.parse(r.text()) == r
    for name in ("new/p.yaml", "other/p.json"):
        path = r.save(tmp_path / name)
        assert path.read_text().endswith("\n") and Prompt.load(path) == r
    assert list(json.loads((tmp_path / "other" / "p.json").read_text())) == sorted(r.to_mapping())
    with pytest.raises(ValueError, match="free_extraction_system, ontology_casting_system"):
        Prompt.from_mapping({"name": "n", "version": "v"})
    with pytest.raises(ValueError):
        Prompt(" ", "1", "a", "b")
    with pytest.raises(ValueError):
        Prompt.parse("[]", "yaml")
    assert Prompt("n", "1", "a", "b", " ").node_context_system == p.node_context_system
    assert len(r.sha256()) == 64 and r.sha256() != p.sha256()


def test_ontology(spark, tmp_path):
    import yaml

    (tmp_path / "o.yaml").write_text(yaml.safe_dump(ONTOLOGY))
    o = files.load_ontology(tmp_path / "o.yaml")
    assert o == Ontology.from_mapping(ONTOLOGY) and set(o.prompt_schema()) == {"entity_types", "relation_types"}
    (tmp_path / "e.yaml").write_text("")
    assert Ontology.from_yaml(tmp_path / "e.yaml") == Ontology()
    (tmp_path / "l.yaml").write_text("- 1")
    with pytest.raises(ValueError):
        Ontology.from_yaml(tmp_path / "l.yaml")
    kinds, ties = o.tables(spark)
    assert kinds.where("id = 'sub'").first().asDict() == {"id": "sub", "label": None, "parent": "thing", "description": None, "abstract": False, "synonyms": ["s"], "examples": [], "attributes": []}
    assert ties.first().domain_id == "thing"
    assert set(Ontology.from_tables(kinds, ties).entity_types) == {"thing", "sub"}


def test_closure_and_audit(spark):
    kinds = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("l", "m"), ("m", "l")], "id string, parent string")
    got = {tuple(r) for r in closure(kinds).collect()}
    assert {("c", "a", 2), ("c", "b", 1), ("c", "c", 0), ("x", "x", 0), ("l", "m", 1), ("m", "l", 1)} <= got and ("x", "y", 1) not in got
    ties = spark.createDataFrame([("r", "a", "b", "r2"), ("free", None, None, None)], "id string, domain_id string, range_id string, inverse string")
    e = spark.createDataFrame([(1, "1", "c"), (1, "2", "a"), (1, "3", None)], "doc_id bigint, entity_id string, ontology_type string")
    r = spark.createDataFrame([(1, "p", "1", "2", "r"), (1, "q", "2", "1", "r"), (1, "s", "2", "2", "free"), (1, "t", "1", "3", "r")], "doc_id bigint, relation_id string, source_id string, target_id string, ontology_type string")
    assert {(x["relation_id"], x["domain_ok"], x["range_ok"]) for x in domain_range_audit(e, r, kinds, ties).collect()} == {("p", True, False), ("q", True, True), ("s", True, True)}
    assert {tuple(x) for x in inverse_edges(r.where("relation_id = 'p'"), ties).collect()} == {(1, "p~inverse", "2", "1", "r2")}


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo é", encoding="utf-8")
    (tmp_path / "b.txt").write_text("")
    assert files.load_text(tmp_path / "a.txt") == "one\ntwo é"
    assert {r["text"] for r in files.load_texts(spark, str(tmp_path)).collect()} <= {"one\ntwo é", ""}
    assert files.write_dot("graph {}\n", tmp_path / "new" / "g.dot").read_text() == "graph {}\n"
    df = spark.createDataFrame([(1, None)], "doc_id bigint, x string")
    assert files.to_json(df).first()[0] == '{"doc_id":1,"x":null}'
    files.write_tables({"t": df}, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "t")).count() == 1


def test_render(spark, tmp_path):
    good, bad = tmp_path / "good", tmp_path / "bad"
    good.write_text('#!/bin/sh\nout=""\nfor a in "$@"; do out="$a"; done\n{ echo "$1"; cat; } > "$out"\n')
    bad.write_text("#!/bin/sh\necho broken >&2\nexit 3\n")
    for f in (good, bad):
        f.chmod(0o755)
    assert files.render("graph {}", tmp_path / "x" / "g.svg", command=str(good)).read_text() == "-Tsvg\ngraph {}"
    assert files.render("graph {}", tmp_path / "plain", command=str(good)).read_text().startswith("-Tpng")
    with pytest.raises(RenderError, match="broken"):
        files.render("graph {}", tmp_path / "g.png", command=str(bad))
    rows = files.render_all(spark.createDataFrame([(1, "graph {}")], "doc_id bigint, dot string"), str(tmp_path / "all"), command=str(bad)).collect()
    assert rows[0]["path"] is None and "broken" in rows[0]["error"]


def test_closure_raises_beyond_its_limit(spark):
    kinds = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "c")], "id string, parent string")
    assert {(r["ancestor"], r["depth"]) for r in closure(kinds, max_depth=3).where("id = 'd'").collect()} == {("d", 0), ("c", 1), ("b", 2), ("a", 3)}
    with pytest.raises(RuntimeError):
        closure(kinds, max_depth=2)
