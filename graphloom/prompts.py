"""Versioned prompts of the three passes, and their rendering with an ontology, densities and context settings."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from graphloom.codec import Stored, encode
from graphloom.config import ContextSettings, Density
from graphloom.ontology import Ontology

DEFAULT_NAME, DEFAULT_VERSION = "ontology-graph-extraction", "0.4.0"
# Our own wording; a template file replaces it.
EXTRACT = (
    "Read the text and name the few entities and relations that explain what it describes. Choose short types of your own for them; no fixed "
    "vocabulary applies in this pass. Each relation joins two of the entities you named and cites words of the text as evidence. Leave out "
    "entities without a supported relation, and never add a relation only to join parts. Number ids e1, e2, ... and r1, r2, ... ."
)
CAST = (
    "Map each extracted entity and relation to one type of the given ontology, by its exact id. Keep every id and both ends of every relation, "
    "add nothing and drop nothing. Where no type is justified, give null. Canonical names stay close to the text; details go into attributes."
)
CONTEXT = (
    "For each node of the graph write a short explanation from the text alone: what it is, and how its incoming and outgoing relations tie it to the "
    "rest. Return one object for every node id and no others. Stay within the sentence limit, quote evidence where asked, and say so where the text is unclear."
)

# Headings and lead-ins of the blocks that follow each prompt, with the data each block shows.
BLOCKS = {
    "free_extraction_system": [
        ("RUNTIME EXTRACTION DENSITY\nUse these as approximate effort targets for this document; do not invent unsupported entities or relations to hit a quota:\n", "density"),
        ("ONTOLOGY AWARENESS FOR LATER CASTING\nPass 1 remains free-form and must not force mentions into these identifiers, but the following vocabulary will be used in pass 2:\n", "ids"),
    ],
    "ontology_casting_system": [
        ("RUNTIME EXTRACTION DENSITY REFERENCE\nThe first pass was configured with these approximate targets. Do not add or remove graph objects during casting:\n", "density"),
        ("TARGET ONTOLOGY\nUse only the exact identifiers in this ontology:\n", "vocabulary"),
    ],
    "node_context_system": [
        ("RUNTIME NODE-CONTEXT CONFIGURATION\n", "context"),
        ("TARGET ONTOLOGY\nUse the exact ontology identifiers supplied in the graph payload; do not introduce new entities or relations.\n", "vocabulary"),
    ],
}


def block(data: Mapping) -> str:
    """JSON as it stands in prompts."""
    return encode(data, "json")


@dataclass(frozen=True)
class Prompt(Stored):
    """The prompts of the three passes, as a template or rendered: prompts are the keys of BLOCKS, in the order of the passes.

    Blank texts are refused; only the last prompt, when blank, is our own.
    """

    name: str
    version: str
    free_extraction_system: str
    ontology_casting_system: str
    node_context_system: str = CONTEXT
    rendered: bool = False
    render_context: Mapping = field(default_factory=dict)

    def __post_init__(self):
        blank = [k for k in ("name", "version", *BLOCKS) if not getattr(self, k).strip()]
        if blank == ["node_context_system"]:
            object.__setattr__(self, blank[0], CONTEXT)
        elif blank:
            raise ValueError(f"blank in the prompt: {', '.join(blank)}")

    @classmethod
    def taken(cls) -> Mapping:
        return dict.fromkeys(("name", "version", *BLOCKS), str) | {"rendered": bool, "render_context": lambda x: dict(x or {})}

    @classmethod
    def default(cls) -> Prompt:
        return cls(DEFAULT_NAME, DEFAULT_VERSION, EXTRACT, CAST)

    def render(self, ontology: Ontology, density: Density, model: str | None = None, context: ContextSettings | None = None) -> Prompt:
        """Each prompt with its blocks, and what they were made of; a rendered prompt is not rendered again."""
        if self.rendered:
            raise ValueError("the prompt is rendered already")
        ids = {"entity_type_ids": sorted(ontology.entity_types), "relation_type_ids": sorted(ontology.relation_types)}
        shown = {"density": density.to_mapping(), "ids": ids, "context": (context or ContextSettings()).to_mapping(), "vocabulary": {"metadata": dict(ontology.metadata), **ontology.prompt_schema()}}
        made = {k: "\n\n".join([getattr(self, k), *(lead + block(shown[what]) for lead, what in parts)]) for k, parts in BLOCKS.items()}
        about = {"template_name": self.name, "template_version": self.version, "ontology": {k: ontology.metadata.get(k) for k in ("id", "version")}, **ids}
        return replace(self, **made, rendered=True, render_context={**about, "extraction_density": shown["density"], "node_context": shown["context"], "model": model})

    def sha256(self) -> str:
        """Digest of the three prompts, joined in the order of the passes."""
        return hashlib.sha256("".join(getattr(self, k) for k in BLOCKS).encode()).hexdigest()
