"""Declared field types: ``int | null``, ``list[str]``, ``enum[a, b]`` and the like."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass

from pyspark.sql import types as T

SCALARS: dict[str, tuple[T.DataType, str]] = {
    "str": (T.StringType(), "string"),
    "int": (T.LongType(), "integer"),
    "float": (T.DoubleType(), "number"),
    "bool": (T.BooleanType(), "boolean"),
    "url": (T.StringType(), "string"),
    "datetime": (T.StringType(), "string"),
}
ORDERED = ("int", "float", "datetime")
TEXTUAL = ("str", "url", "enum")


@dataclass(frozen=True)
class FieldType:
    """One declared type; ``base`` is ``enum`` for enumerations and ``str`` for lists."""

    base: str
    nullable: bool = False
    is_list: bool = False
    members: tuple[str, ...] = ()

    @property
    def spark(self) -> T.DataType:
        return T.ArrayType(T.StringType(), False) if self.is_list else T.StringType() if self.base == "enum" else SCALARS[self.base][0]

    @property
    def name(self) -> str:
        core = "list[str]" if self.is_list else f"enum[{', '.join(self.members)}]" if self.base == "enum" else self.base
        return core + " | null" * self.nullable

    def operators(self) -> list[str]:
        """Filter operators that the type allows; the grammar and the API description share them."""
        out = ["eq", "ne", "in", "isnull"]
        if self.is_list or self.base in ("str", "url"):
            out.append("contains")
        if not self.is_list and self.base in ORDERED:
            out += ["gt", "gte", "lt", "lte"]
        return out


def parse_type(text: str) -> FieldType:
    """A declared type; ``null`` (lower case) or ``none`` (any case) beside it makes it nullable."""
    parts = [p.strip() for p in text.split("|")]
    core = [p for p in parts if p.lower() not in ("null", "none", "")]
    nullable = any(p == "null" or p.lower() == "none" for p in parts)
    if len(core) != 1:
        raise ValueError(f"one type is needed, with or without null: {text!r}")
    kind = core[0]
    if kind in SCALARS:
        return FieldType(kind, nullable)
    if re.fullmatch(r"list\[\s*str\s*\]", kind):
        return FieldType("str", nullable, is_list=True)
    if found := re.fullmatch(r"enum\[([^\]]+)\]", kind):
        members = tuple(m.strip() for m in found[1].split(",") if m.strip())
        if members:
            return FieldType("enum", nullable, members=members)
    raise ValueError(f"unknown type {kind!r}; valid: {', '.join(SCALARS)}, list[str], enum[...]")


def parse_fields(text: str) -> dict[str, tuple[FieldType, str]]:
    """``name: type description, ...`` -> type and description of each field, split by the grammar of types."""
    kind = r"(?:list\[\s*str\s*\]|enum\[[^\]]+\]|[a-z]+)(?:\s*\|\s*(?:null|[Nn]one))?"
    out = {}
    for part in re.split(r",(?![^\[]*\])", text):
        if part.strip():
            found = re.fullmatch(rf"\s*(\w+)\s*:\s*({kind})\s*(.*)", part, re.DOTALL)
            if not found:
                raise ValueError(f"not a field: {part.strip()!r}")
            out[found[1]] = parse_type(found[2]), found[3].strip()
    return out


def json_schema(source: str, fields: dict[str, FieldType], version: str) -> dict:
    def one(ft: FieldType) -> dict:
        kind = {"type": "array", "items": {"type": "string"}} if ft.is_list else {"type": "string" if ft.base == "enum" else SCALARS[ft.base][1]}
        return {"anyOf": [kind, {"type": "null"}], "default": None} if ft.nullable else kind

    return {"title": source, "type": "object", "properties": {n: one(ft) for n, ft in fields.items()}, "required": [n for n, ft in fields.items() if not ft.nullable], "x-schema-version": version}


def schema_hash(schema: dict) -> str:
    return hashlib.sha256(json.dumps(schema, sort_keys=True).encode()).hexdigest()[:16]


def bumped(version: str, major: bool) -> str:
    first, second, *_ = (int(x) for x in version.split("."))
    return f"{first + 1}.0.0" if major else f"{first}.{second + 1}.0"
