"""The pipeline's table of runs as a query."""

import hashlib

import pytest
from conftest import DATA

from graphloom.config import Settings
from graphloom.ontology import Ontology
from graphloom.plans import level_queries as q
from graphloom.plans.graph_queries import Tables
from graphloom.prompts import Prompt


def test_runs_of_the_documents_that_come_through(spark):
    if not DATA.exists():
        pytest.skip("no test tables here")
    t, s = Tables(spark, str(DATA)), Settings()
    texts = {r["doc_id"]: r["source_text"] for r in t.texts().collect()}
    lost = {r["doc_id"] for r in q.pipeline_quarantine(spark, str(DATA)).collect()}
    prompt = Prompt.default().render(Ontology.from_tables(t.kinds, t.ties), s.extraction_density, s.model, s.node_context).sha256()
    rows = q.pipeline_run_metadata(spark, str(DATA)).collect()
    got = {r["doc_id"]: (r["model"], r["source_sha256"], r["prompt_sha256"]) for r in rows}
    assert lost and len(got) == len(rows)
    assert got == {d: (s.model, hashlib.sha256(x.encode()).hexdigest(), prompt) for d, x in texts.items() if d not in lost}
