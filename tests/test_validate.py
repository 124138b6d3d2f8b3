from graphloom.config import ContextSettings
from graphloom.operators import context, validate

from test_graph import CE, CR, E, R

KINDS = "id string, label string"


def _codes(df):
    return [(r["code"], r["subject"], r["detail"]) for r in df.orderBy("doc_id", "rank", "ord", "code").collect()]


def test_extraction_issues(spark):
    e = spark.createDataFrame([(1, i, x, "m", "t", "", "", None) for i, x in enumerate(["b", "a", "a", "b", None, None])], E)
    r = spark.createDataFrame([(1, 0, "r1", "a", "z", "", "", None), (1, 1, "r1", "y", "x", "", "", None), (1, 2, "r2", "a", None, "", "", None)], R)
    got = validate.extraction_issues(e, r)
    assert _codes(got) == [("DUP_ENTITY", "", "a, b"), ("DUP_RELATION", "", "r1"), ("UNKNOWN_ENDPOINT", "r1", "z"), ("UNKNOWN_ENDPOINT", "r1", "x, y"), ("UNKNOWN_ENDPOINT", "r2", "")]
    texts = [r["text"] for r in validate.texts(got).orderBy("rank", "ord").collect()]
    assert texts[0] == "duplicate entity ids: a, b" and texts[2] == "relation 'r1' references unknown endpoint(s): z"
    assert validate.first_issues(got).collect()[0]["code"] == "DUP_ENTITY"
    assert validate.extraction_issues(e.limit(0), r.limit(0)).isEmpty()


def test_casting_issues(spark):
    e = spark.createDataFrame([(1, i, x, "m", "t", "", "", None) for i, x in enumerate("abc")], E)
    r = spark.createDataFrame([(1, 0, "r1", "a", "b", "", "", None), (1, 1, "r2", "b", "c", "", "", None)], R)
    ce = spark.createDataFrame([(1, 0, "a", "thing", "", {}, None), (1, 1, "b", None, "", {}, None), (1, 2, "b", "odd'", "", {}, None), (1, 3, "x", "thing", "", {}, None)], CE)
    cr = spark.createDataFrame([(1, 0, "r1", "b", "a", "nope", {}, None), (1, 1, "r2", "b", "c", "links", {}, None)], CR)
    kinds, ties = spark.createDataFrame([("thing", "")], KINDS), spark.createDataFrame([("links", "")], KINDS)
    got = validate.casting_issues(e, r, ce, cr, kinds, ties)
    assert _codes(got) == [
        ("CAST_ENTITY_IDS", "", "missing=c; extra=x; repeated=b"), ("NO_TYPE", "b", ""), ("UNKNOWN_TYPE", "b", "odd'"), ("ENDPOINT_CHANGED", "r1", ""), ("UNKNOWN_TYPE", "r1", "nope"),
    ]
    texts = {r["code"]: r["text"] for r in validate.texts(got.where("rank < 3")).collect()}
    assert texts["CAST_ENTITY_IDS"] == "entity casting ids do not exactly match extraction (missing=['c'], extra=['x'])"
    assert texts["UNKNOWN_TYPE"] == "entity 'b' has unknown ontology type \"odd'\""
    assert "NO_TYPE" not in {c for c, *_ in _codes(validate.casting_issues(e, r, ce, cr, kinds, ties, require_types=False))}


def test_context_issues(spark):
    nodes = spark.createDataFrame([(1, i, x) for i, x in enumerate("abcdefg")], "doc_id bigint, ord int, entity_id string")
    rows = [
        ("a", "Fine.", ["x"]), ("a", "Again.", []), ("zz", "Who?", []), ("b", " \u3000", []), ("c", "One. Two! Three? Four.", []),
        ("d", "Fine.", ["1", "2", "3"]), ("e", "Ok.", []), ("g", None, None),
    ]
    contexts = spark.createDataFrame([(1, i, *r, "") for i, r in enumerate(rows)], "doc_id bigint, ord int, entity_id string, summary string, evidence array<string>, uncertainty string")
    got = _codes(validate.context_issues(contexts, nodes))
    assert got == [("CTX_DUP", "a", ""), ("CTX_UNKNOWN", "zz", ""), ("CTX_EMPTY", "b", ""), ("CTX_SENTENCES", "c", ""), ("CTX_EVIDENCE_MANY", "d", ""), ("CTX_EMPTY", "g", ""), ("CTX_MISSING", "", "f")]
    off = _codes(validate.context_issues(contexts, nodes, ContextSettings(include_evidence=False)))
    assert ("CTX_EVIDENCE_OFF", "d", "") in off and ("CTX_EVIDENCE_OFF", "a", "") in off
    cut = {r["entity_id"]: r for r in context.trimmed(contexts.where("ord <> 1"), ContextSettings(max_evidence_items=2)).collect()}
    assert cut["d"]["evidence"] == ["1", "2"] and cut["g"]["evidence"] == []
    assert all(r["evidence"] == [] for r in context.trimmed(contexts, ContextSettings(max_evidence_items=0)).collect())
