"""Settings of the pipeline. They live on the driver and enter plans as literals."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from pathlib import Path

from graphloom.codec import Stored

# Names of settings, their defaults and the policies.
DEFAULT_MODEL = "gpt-4o-mini"
POLICIES = ("largest_component", "raise", "preserve")
CONTEXT_POLICIES = ("all_nodes", "disabled")
CONTEXT_ALIASES = {"per_node": "all_nodes", "none": "disabled"}  # accepted by the pipeline, not by its settings


def _require(ok: bool, text: str) -> None:
    if not ok:
        raise ValueError(text)


@dataclass(frozen=True)
class Density(Stored):
    """How many entities and relations to aim for."""

    entities_per_word: float = 0.1
    relations_per_entity: float = 2.0

    def __post_init__(self):
        for f in fields(self):
            _require(getattr(self, f.name) >= 0, f"{f.name} is below 0")

    @classmethod
    def taken(cls) -> Mapping:
        return {f.name: float for f in fields(cls)}


@dataclass(frozen=True)
class ContextSettings(Stored):
    """Limits on the contexts of nodes."""

    max_sentences: int = 3
    max_evidence_items: int = 2
    include_evidence: bool = True
    include_uncertainty: bool = True

    def __post_init__(self):
        _require(self.max_sentences > 0, "max_sentences is below 1")
        _require(self.max_evidence_items >= 0, "max_evidence_items is below 0")

    @classmethod
    def taken(cls) -> Mapping:
        """bool("false") is True, as for any text that isn't empty."""
        return {"max_sentences": int, "max_evidence_items": int, "include_evidence": bool, "include_uncertainty": bool}


@dataclass(frozen=True)
class Limits:
    """Thresholds of the graph validator."""

    max_density: float = 0.40
    max_degree_fraction: float = 0.50
    max_hub_nodes: int = 0

    def __post_init__(self):
        for name in ("max_density", "max_degree_fraction"):
            _require(0 < getattr(self, name) <= 1, f"{name} is not above 0 and up to 1")
        _require(self.max_hub_nodes >= 0, "max_hub_nodes is below 0")


@dataclass(frozen=True)
class Settings(Stored):
    """All settings of a pipeline."""

    model: str = DEFAULT_MODEL
    extraction_density: Density = field(default_factory=Density)
    node_context: ContextSettings = field(default_factory=ContextSettings)
    prompt_template_path: str | Path | None = None
    prompt_snapshot_path: str | Path | None = None
    disconnected_policy: str = "largest_component"
    context_policy: str = "all_nodes"
    strict_validation: bool = False
    max_density: float = 0.40
    max_degree_fraction: float = 0.50
    max_hub_nodes: int = 0

    def __post_init__(self):
        _require(self.model.strip() != "", "a model must be named")
        for name, known in (("disconnected_policy", POLICIES), ("context_policy", CONTEXT_POLICIES)):
            _require(getattr(self, name) in known, f"{name} is none of {known}")

    @property
    def limits(self) -> Limits:
        return Limits(self.max_density, self.max_degree_fraction, self.max_hub_nodes)

    @classmethod
    def taken(cls) -> Mapping:
        kinds = {"model": str, "extraction_density": Density.from_mapping, "node_context": ContextSettings.from_mapping, "strict_validation": bool, "max_hub_nodes": int}
        return kinds | dict.fromkeys(("disconnected_policy", "context_policy"), str) | dict.fromkeys(("max_density", "max_degree_fraction"), float) | dict.fromkeys(("prompt_template_path", "prompt_snapshot_path"), lambda p: p)

    def to_mapping(self) -> dict:
        out = {}
        for f in fields(self):
            value = getattr(self, f.name)
            out[f.name] = value.to_mapping() if hasattr(value, "to_mapping") else str(value) if isinstance(value, Path) else value
        return out
