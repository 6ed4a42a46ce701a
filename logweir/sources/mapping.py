"""Field mappings: which fields can be searched, and how their values become tokens.

A mapping file is YAML or JSON::

    mapping-list:
      - {name: service, type: keyword, size: 64}
      - {name: message, types: [{type: text}, {title: keyword, type: keyword, size: 18}]}
      - {name: process, type: object, mapping-list: [{name: tags, type: tags}]}
      - {name: spans, type: nested, mapping-list: [{name: span_id, type: keyword}]}
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

KINDS = ("keyword", "text", "path", "object", "tags", "nested", "exists", "noop")
#: Kinds whose fields have tokens of their own.
SEARCHED = ("keyword", "text", "path", "exists")
#: The bytes of a token and of a text field that are indexed by default.
TOKEN_BYTES, TEXT_BYTES = 72, 32768
BUILT_IN = ("_all_", "_exists_", "_index")


class MappingError(ValueError):
    pass


@dataclass(frozen=True)
class Field:
    """title: the name in queries; source: the name in documents; size: the most bytes of a value, 0 for the default."""

    title: str
    kind: str
    source: str = ""
    size: int = 0
    parent: str = ""
    parent_kind: str = ""

    @property
    def name(self) -> str:
        return self.source or self.title


@dataclass(frozen=True)
class Mapping:
    """Fields by title; ``auto`` takes any field as a keyword."""

    fields: dict[str, Field] = field(default_factory=dict)
    auto: bool = False

    def kind(self, title: str) -> str:
        if title in BUILT_IN:
            return "keyword"
        if title in self.fields:
            return self.fields[title].kind
        for f in self.fields.values():  # the keys of tags are fields of their own
            if f.kind == "tags" and title.startswith(f.title + "."):
                return "keyword"
        return "keyword" if self.auto else "noop"

    def searched(self) -> list[Field]:
        return [f for f in self.fields.values() if f.kind in SEARCHED]

    def of_kind(self, kind: str) -> list[Field]:
        return [f for f in self.fields.values() if f.kind == kind]

    def to_json(self) -> str:
        return json.dumps({t: f.kind for t, f in sorted(self.fields.items())})


AUTO = Mapping(auto=True)


def _read(entries: list[dict], prefix: str, parent: str, parent_kind: str, out: dict[str, Field]) -> None:
    for e in entries:
        name = e.get("name")
        if not name:
            raise MappingError("a field has no name")
        own = prefix + name
        kinds = e.get("types") or [{"type": e.get("type", "keyword"), "size": e.get("size", 0)}]
        titles: set[str] = set()
        for k in kinds:
            kind = k.get("type")
            if kind not in KINDS:
                raise MappingError(f'field "{own}": unknown type "{kind}"')
            if e.get("types") and kind in ("object", "tags", "nested"):
                raise MappingError(f'field "{own}": type "{kind}" stands alone')
            title = own + (f".{k['title']}" if k.get("title") else "")
            if title in titles or title in out:
                raise MappingError(f'field "{title}" occurs twice')
            titles.add(title)
            out[title] = Field(title, kind, own, int(k.get("size") or 0), parent, parent_kind)
            if kind in ("object", "nested"):
                below = (own, "nested") if kind == "nested" else (parent, parent_kind)
                _read(e.get("mapping-list") or [], own + ".", *below, out)


def from_dict(spec: dict) -> Mapping:
    out: dict[str, Field] = {}
    _read(spec.get("mapping-list") or [], "", "", "", out)
    return Mapping(out)


def load(path: str) -> Mapping:
    """The mapping in a file; ``auto`` for the one that takes everything."""
    if path == "auto":
        return AUTO
    text = Path(path).read_text()
    if path.endswith(".json"):
        return from_dict(json.loads(text))
    import yaml

    return from_dict(yaml.safe_load(text))


class Reloading:
    """A mapping that is read again when its file has changed and ``seconds`` have passed."""

    def __init__(self, path: str, seconds: float = 30.0):
        self.path, self.seconds = path, seconds
        self._text, self._at, self._mapping = None, 0.0, None

    def get(self, now: float) -> Mapping:
        if self._mapping is None or now - self._at >= self.seconds:
            self._at = now
            text = Path(self.path).read_text()
            if text != self._text:
                self._text, self._mapping = text, load(self.path)
        return self._mapping
