"""Settings and prompts as text: one reader and one writer for every kind of file, chosen by its suffix."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import MISSING, asdict, fields
from pathlib import Path

from graphloom.errors import MissingDependency


def yaml_module():
    try:
        import yaml
    except ImportError as e:
        raise MissingDependency("PyYAML is needed for YAML") from e
    return yaml


def decode(text: str, kind: str, what: str = "text") -> Mapping:
    """The mapping that a JSON or YAML text holds; anything else is refused. An empty YAML text is an empty mapping."""
    data = json.loads(text) if kind == "json" else yaml_module().safe_load(text) or {}
    if not isinstance(data, Mapping):
        raise ValueError(f"{what}: a mapping is wanted, not {type(data).__name__}")
    return data


def encode(data: Mapping, kind: str, indent: int = 2) -> str:
    """JSON with sorted keys, or YAML in the given order; characters as they are."""
    if kind == "json":
        return json.dumps(data, ensure_ascii=False, indent=indent, sort_keys=True)
    return yaml_module().safe_dump(dict(data), allow_unicode=True, sort_keys=False)


def kind_of(path) -> str:
    return "json" if Path(path).suffix.lower() == ".json" else "yaml"


class Stored:
    """A dataclass that is written to and read from text. `taken` says how values of a mapping are read: field -> function; other keys are dropped."""

    @classmethod
    def taken(cls) -> Mapping:
        raise NotImplementedError

    @classmethod
    def from_mapping(cls, data: Mapping):
        """Fields without a default must be there."""
        if lost := sorted(f.name for f in fields(cls) if f.default is MISSING and f.default_factory is MISSING and f.name not in data):
            raise ValueError(f"{cls.__name__} lacks {', '.join(lost)}")
        return cls(**{k: read(data[k]) for k, read in cls.taken().items() if k in data})

    def to_mapping(self) -> dict:
        return asdict(self)

    @classmethod
    def parse(cls, text: str, kind: str = "json"):
        return cls.from_mapping(decode(text, kind, cls.__name__))

    def text(self, kind: str = "json", indent: int = 2) -> str:
        return encode(self.to_mapping(), kind, indent)

    @classmethod
    def load(cls, path):
        """From a .json file, or from YAML under any other suffix."""
        return cls.parse(Path(path).read_text(encoding="utf-8"), kind_of(path))

    def save(self, path, indent: int = 2) -> Path:
        """To a .json file, or as YAML under any other suffix; folders are made, the text ends with a line feed."""
        path, text = Path(path), self.text(kind_of(path), indent)
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text if text.endswith("\n") else text + "\n", encoding="utf-8")
        return path
