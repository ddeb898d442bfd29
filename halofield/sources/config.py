"""Strict configurations: dataclasses from JSON, unknown keys rejected, old names accepted, ${NAME} filled in."""

from __future__ import annotations

import dataclasses
import json
import re
from typing import TypeVar

T = TypeVar("T")


def fill(text: str, values: dict[str, str]) -> str:
    """text with ${NAME} replaced; a name without a value is an error."""

    def one(m: re.Match) -> str:
        if m[1] not in values:
            raise ValueError(f"no value for {m[0]}")
        return values[m[1]]

    return re.sub(r"\$\{(\w+)\}", one, text)


def parse(kind: type[T], text: str, aliases: dict[str, str] | None = None, values: dict[str, str] | None = None) -> T:
    """A dataclass from a JSON object; nested dataclasses from nested objects."""
    return build(kind, json.loads(fill(text, values or {})), aliases or {})


def build(kind: type[T], given: dict, aliases: dict[str, str]) -> T:
    fields = {f.name: f for f in dataclasses.fields(kind)}
    out = {}
    for k, v in given.items():
        name = aliases.get(k, k)
        if name not in fields:
            raise ValueError(f"unknown key {k}")
        if name in out:
            raise ValueError(f"key {k} given twice")
        inner = fields[name].default_factory if dataclasses.is_dataclass(fields[name].default_factory) else None
        out[name] = build(inner, v, aliases) if inner and isinstance(v, dict) else v
    missing = [n for n, f in fields.items() if n not in out and f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING]
    if missing:
        raise ValueError(f"missing key {missing[0]}")
    return kind(**out)
