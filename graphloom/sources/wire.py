"""Records as extractors write them: strict JSON objects, checked field by field, to the record tables.

Wire objects call the key `id`; attributes are lists of {key, value} objects, of which the last of equal keys counts.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from graphloom import schemas as S
from graphloom.errors import MissingDependency

_STR, _NUM, _OPT_STR = (str,), (int, float, type(None)), (str, type(None))
# Fixed formats: field -> admitted kinds. Every field must be there, no other may be.
FORMS = {
    "entity": {"id": _STR, "mention_text": _STR, "free_type": _STR, "description": _STR, "evidence": _STR, "confidence": _NUM},
    "relation": {"id": _STR, "source_id": _STR, "target_id": _STR, "free_type": _STR, "evidence": _STR, "confidence": _NUM},
    "cast_entity": {"id": _STR, "ontology_type": _OPT_STR, "canonical_name": _STR, "attributes": (list,), "confidence": _NUM},
    "cast_relation": {"id": _STR, "source_id": _STR, "target_id": _STR, "ontology_type": _OPT_STR, "attributes": (list,), "confidence": _NUM},
    "attribute": {"key": _STR, "value": _STR},
    "context": {"id": _STR, "summary": _STR, "evidence": (list,), "uncertainty": _OPT_STR},
}
PASSES = {
    "extraction": ({"entities": "entity", "relations": "relation"}, S.EXTRACTION),
    "casting": ({"entities": "cast_entity", "relations": "cast_relation"}, S.CASTING),
    "contexts": ({"contexts": "context"}, T.StructType([T.StructField("contexts", T.ArrayType(S.NODE_CONTEXT))])),
}
_KEYS = {"entity": "entity_id", "relation": "relation_id", "cast_entity": "entity_id", "cast_relation": "relation_id", "context": "entity_id"}


def _check(item, form: str) -> dict:
    spec = FORMS[form]
    if not isinstance(item, dict):
        raise ValueError(f"{form}: not an object")
    if wrong := sorted(set(item) ^ set(spec)):
        raise ValueError(f"{form}: missing or extra {', '.join(wrong)}")
    for k, kinds in spec.items():
        if not isinstance(item[k], kinds) or isinstance(item[k], bool):
            raise ValueError(f"{form}: {k} is of the wrong kind")
    out = dict(item)
    if form in _KEYS:
        out[_KEYS[form]] = out.pop("id")
    if "attributes" in out:
        out["attributes"] = {a["key"]: a["value"] for a in (_check(a, "attribute") for a in out["attributes"])}
    if "confidence" in out and out["confidence"] is not None:
        out["confidence"] = float(out["confidence"])
    if form == "context" and not all(isinstance(e, str) for e in out["evidence"]):
        raise ValueError("context: evidence is of the wrong kind")
    return out


def read_answer(text: str | None, which: str) -> tuple[dict | None, str | None]:
    """(answer, None), or (None, what is wrong with it)."""
    lists, _ = PASSES[which]
    try:
        data = json.loads(text) if text else None
        if not isinstance(data, dict):
            raise ValueError("no answer" if data is None else "not an object")
        notes = which != "contexts"
        if set(data) != {*lists, *(["notes"] if notes else [])}:
            raise ValueError(f"missing or extra {', '.join(sorted(set(data) ^ {*lists, *(['notes'] if notes else [])}))}")
        out = {k: [_check(x, form) for x in data[k]] for k, form in lists.items() if isinstance(data[k], list)}
        if len(out) < len(lists) or notes and not isinstance(data["notes"], str):
            raise ValueError("a field is of the wrong kind")
        return out | ({"notes": data["notes"]} if notes else {}), None
    except ValueError as e:
        return None, str(e)


def _plain(value, kind: T.DataType):
    """A parsed value as Arrow takes it: maps as lists of entries."""
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        return {f.name: _plain(value.get(f.name), f.dataType) for f in kind.fields}
    if isinstance(kind, T.ArrayType):
        return [_plain(v, kind.elementType) for v in value]
    return list(value.items()) if isinstance(kind, T.MapType) else value


def parse(df: DataFrame, column: str, which: str) -> DataFrame:
    """`df` with `answer` (the parsed struct, null if refused) and `problem` (null if accepted) instead of the JSON column.

    Spark's own from_json ignores extra keys and fills missing ones with null, so the check is done on the Python side, in Arrow batches.
    """
    kept, kind = [c for c in df.columns if c != column], PASSES[which][1]
    arrow = to_arrow_type(kind)

    def run(batches):
        for b in batches:
            got = [read_answer(t, which) for t in b.column(len(kept)).to_pylist()]
            answers = pa.array([_plain(a, kind) for a, _ in got], arrow)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], answers, pa.array([p for _, p in got], pa.string())], names=[*kept, "answer", "problem"])

    rows = df.select(*kept, column)
    schema = T.StructType([*rows.schema.fields[: len(kept)], T.StructField("answer", kind), T.StructField("problem", T.StringType())])
    return rows.mapInArrow(run, schema)


def answer_model(which: str):
    """The form of a pass's answer as a class of the public `pydantic` package, which refuses other fields; it is what a client of structured answers asks for."""
    try:
        from pydantic import ConfigDict, create_model
    except ImportError as e:
        raise MissingDependency("pydantic is needed for structured answers") from e

    made: dict = {}

    def model(form: str):
        if form not in made:
            made[form] = create_model(form.title().replace("_", ""), __config__=ConfigDict(extra="forbid", strict=True), **{k: (kind_of(k, kinds), ...) for k, kinds in FORMS[form].items()})
        return made[form]

    def kind_of(name, kinds):
        if kinds == (list,):
            return list[model("attribute")] if name == "attributes" else list[str]
        return {_STR: str, _NUM: float | None, _OPT_STR: str | None}[kinds]

    lists, _ = PASSES[which]
    notes = {} if which == "contexts" else {"notes": (str, ...)}
    return create_model(which.title(), __config__=ConfigDict(extra="forbid", strict=True), **{k: (list[model(form)], ...) for k, form in lists.items()}, **notes)


def explode_records(answers: DataFrame, field: str) -> DataFrame:
    """(doc_id, ord, record..): the records of one list of `answer`, ord being their position."""
    rows = answers.where("answer is not null").select("doc_id", F.posexplode(f"answer.{field}").alias("ord", "r"))
    return rows.select("doc_id", "ord", "r.*")
