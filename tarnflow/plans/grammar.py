"""The flat query grammar: parameters -> filters, search, sort, paging and projection."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from tarnflow.functions.casts import CastError, cast_literal
from tarnflow.functions.types import FieldType

OPERATORS = ("eq", "ne", "gt", "gte", "lt", "lte", "contains", "in", "isnull")
CONTROLS = ("sort", "fields", "limit", "offset", "q")
MAX_LIMIT = 1000


class QueryError(ValueError):
    """A parameter that cannot be taken, with its code."""

    def __init__(self, message: str, param: str, code: str, expected_type: str | None = None, detail: Any = None):
        super().__init__(message)
        self.message, self.param, self.code, self.expected_type, self.detail = message, param, code, expected_type, detail

    def as_dict(self) -> dict:
        out = {"error": self.message, "param": self.param, "code": self.code}
        return out | {k: v for k, v in (("expected_type", self.expected_type), ("detail", self.detail)) if v is not None}


@dataclass(frozen=True)
class Filter:
    field: str
    op: str
    value: Any


@dataclass
class Query:
    filters: list[Filter] = field(default_factory=list)
    sort: list[tuple[str, bool]] = field(default_factory=list)  # (field, descending)
    fields: list[str] | None = None
    limit: int | None = None
    offset: int = 0
    q: str = ""

    def echo(self) -> dict:
        """The query in its canonical spelling."""
        out: dict[str, Any] = {f.field + ("" if f.op == "eq" else f"__{f.op}"): f.value for f in self.filters}
        if self.q:
            out["q"] = self.q
        if self.sort:
            out["sort"] = ",".join("-" * down + name for name, down in self.sort)
        if self.fields is not None:
            out["fields"] = ",".join(self.fields)
        return out | ({"limit": self.limit} if self.limit is not None else {}) | ({"offset": self.offset} if self.offset else {})


def parse_query(params: dict[str, Any], schema: dict[str, FieldType], lookup_params: set[str] = frozenset()) -> tuple[Query, dict]:
    """(query, lookup arguments).  In order of precedence: control words, ``field__op``, lookup parameters, fields."""
    query, arguments = Query(), {}
    for key, raw in params.items():
        name, split, op = key.rpartition("__")
        if key in CONTROLS:
            _control(query, key, raw, schema)
        elif split and name:
            if op not in OPERATORS:
                raise QueryError(f"unknown operator {op!r}", key, "unknown_operator", detail=list(OPERATORS))
            if name not in schema:
                raise QueryError(f"unknown field {name!r}", key, "unknown_field", detail=sorted(schema))
            query.filters.append(_filter(key, name, op, raw, schema[name]))
        elif key in lookup_params:
            arguments[key] = raw
        elif key in schema:
            query.filters.append(_filter(key, key, "eq", raw, schema[key]))
        else:
            raise QueryError(f"unknown parameter {key!r}", key, "unknown_parameter", detail=sorted({*schema, *lookup_params, *CONTROLS}))
    return query, arguments


def _filter(key: str, name: str, op: str, raw: Any, ft: FieldType) -> Filter:
    if op not in ft.operators():
        raise QueryError(f"{op} does not go with {ft.name}", key, "operator_not_supported_for_type", ft.name)
    try:
        if op == "isnull":
            value = {"true": True, "1": True, "false": False, "0": False}[str(raw).strip().lower()]
        elif op == "in":
            value = [cast_literal(x, ft) for x in (raw if isinstance(raw, (list, tuple)) else str(raw).split(","))]
        else:
            value = cast_literal(raw, ft)
    except KeyError:
        raise QueryError("isnull takes true or false", key, "invalid_value", "bool") from None
    except CastError as e:
        raise QueryError(f"invalid value for {name}: {e}", key, "invalid_value", ft.name) from None
    return Filter(name, op, value)


def _control(query: Query, key: str, raw: Any, schema: dict[str, FieldType]) -> None:
    if key == "q":
        query.q = str(raw)
    elif key in ("limit", "offset"):
        try:
            n = int(str(raw))
        except ValueError:
            raise QueryError(f"{key} takes a whole number", key, "invalid_control", "int") from None
        if n < 0 or key == "limit" and n > MAX_LIMIT:
            raise QueryError(f"{key} is out of range", key, "invalid_control", "int", f"0..{MAX_LIMIT}" if key == "limit" else ">= 0")
        setattr(query, key, n)
    else:
        names = [x.strip() for x in (raw if isinstance(raw, (list, tuple)) else str(raw).split(",")) if str(x).strip()]
        for name in names:
            if name.lstrip("-" if key == "sort" else "") not in schema:
                raise QueryError(f"unknown field {name!r}", key, "invalid_control", detail=sorted(schema))
        if key == "sort":
            query.sort = [(n.lstrip("-"), n.startswith("-")) for n in names]
        else:
            query.fields = list(dict.fromkeys(names))
