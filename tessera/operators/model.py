"""The query value: scope, predicate tree, sort and page, with a JSON form of its own."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, is_dataclass

MAX_DEPTH = 64


class InvalidScope(ValueError):
    """A folder scope that is empty or not absolute."""


class PredicateTooDeep(ValueError):
    """A predicate nested beyond MAX_DEPTH."""


@dataclass(frozen=True)
class Folder:
    path: str
    recursive: bool = True


@dataclass(frozen=True)
class Everywhere:
    pass


@dataclass(frozen=True)
class Equal:
    value: float


@dataclass(frozen=True)
class AtLeast:
    value: float


@dataclass(frozen=True)
class AtMost:
    value: float


@dataclass(frozen=True)
class Between:
    low: float
    high: float


@dataclass(frozen=True)
class All:
    pass


@dataclass(frozen=True)
class And:
    parts: tuple = ()


@dataclass(frozen=True)
class Or:
    parts: tuple = ()


@dataclass(frozen=True)
class Not:
    inner: object


@dataclass(frozen=True)
class Width:
    test: object


@dataclass(frozen=True)
class Height:
    test: object


@dataclass(frozen=True)
class FileSize:
    test: object


@dataclass(frozen=True)
class Megapixels:
    test: object


@dataclass(frozen=True)
class AspectRatio:
    test: object


@dataclass(frozen=True)
class ExactDimensions:
    width: int
    height: int


@dataclass(frozen=True)
class FileExtension:
    values: tuple = ()


@dataclass(frozen=True)
class CaptureDate:
    start: float | None = None
    end: float | None = None


@dataclass(frozen=True)
class ModifiedDate:
    start: float | None = None
    end: float | None = None


@dataclass(frozen=True)
class CameraMake:
    value: str


@dataclass(frozen=True)
class CameraModel:
    value: str


@dataclass(frozen=True)
class FilenameText:
    text: str


@dataclass(frozen=True)
class HasDuplicates:
    pass


@dataclass(frozen=True)
class Sort:
    by: str = "name"  # name, captureDate, modifiedDate, size, width, height
    ascending: bool = True


@dataclass(frozen=True)
class SearchQuery:
    scope: object = field(default_factory=Everywhere)
    predicate: object = field(default_factory=All)
    sort: Sort = field(default_factory=Sort)
    limit: int | None = None
    offset: int | None = None


KINDS = {c.__name__: c for c in (Folder, Everywhere, Equal, AtLeast, AtMost, Between, All, And, Or, Not, Width, Height, FileSize, Megapixels, AspectRatio, ExactDimensions, FileExtension, CaptureDate, ModifiedDate, CameraMake, CameraModel, FilenameText, HasDuplicates, Sort, SearchQuery)}


def _plain(x):
    if is_dataclass(x):
        return {"kind": type(x).__name__} | {f.name: _plain(getattr(x, f.name)) for f in fields(x)}
    return [_plain(y) for y in x] if isinstance(x, tuple) else x


def _value(x):
    if isinstance(x, dict):
        return KINDS[x["kind"]](**{k: _value(v) for k, v in x.items() if k != "kind"})
    return tuple(_value(y) for y in x) if isinstance(x, list) else x


def to_json(query: SearchQuery) -> str:
    return json.dumps(_plain(query), sort_keys=True)


def from_json(text: str) -> SearchQuery:
    return _value(json.loads(text))
