"""The query layer behind HTTP, tool calls and the command line: requests in, envelopes out."""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tarnflow.functions.types import SCALARS, FieldType, json_schema, parse_type
from tarnflow.plans.ask import compile_question
from tarnflow.plans.grammar import CONTROLS, MAX_LIMIT, Query, QueryError, parse_query
from tarnflow.plans.planner import envelope

#: Status of a lookup -> HTTP status.
LOOKUP_STATUS = {"ok": 200, "not_found": 200, "error": 400, "blocked": 502, "broken": 503}


@dataclass
class Source:
    """A named table of items with declared types; with ``lookup`` the items of a request's parameters.

    ``lookup`` takes the session and the parameters and gives status, error, url
    and items, as :func:`tarnflow.plans.lookups.lookup_one` does.
    """

    name: str
    fields: dict[str, FieldType]
    load: Callable[[SparkSession], DataFrame] | None
    ordinal: list[str] = field(default_factory=list)
    version: str = "1.0.0"
    lookup_params: frozenset[str] = frozenset()
    lookup: Callable[[SparkSession, dict], dict] | None = None


def query_source(spark: SparkSession, source: Source, params: dict[str, Any], base: dict | None = None) -> dict:
    """The envelope of a request; that of a lookup has its status, and its error where there is one."""
    query, arguments = parse_query(params, source.fields, set(source.lookup_params))
    if source.lookup:
        return _looked_up(spark, source, query, arguments, base or {})
    return envelope({"source": source.name, "schema_version": source.version, **(base or {})}, source.load(spark), query, source.fields, source.ordinal)


def _looked_up(spark: SparkSession, source: Source, query: Query, arguments: dict, base: dict) -> dict:
    got = source.lookup(spark, arguments)
    about = {"source": source.name, "schema_version": source.version, "params": arguments, "url": got["url"], "status": got["status"]}
    about |= {"error": got["error"]} if got["error"] else {}
    meta = {"cached": got.get("cached", False)} | ({"healed_fields": got["healed"]} if got.get("healed") else {})
    about |= base | {"_meta": meta | base.get("_meta", {})}
    if not got["items"]:
        return about | {"count": 0, "returned": 0, "items": [], "_query": query.echo()}
    kind = T.StructType([T.StructField(n, ft.spark) for n, ft in source.fields.items()] + [T.StructField("_at", T.LongType())])
    items = spark.createDataFrame([(*(r[n] for n in source.fields), i) for i, r in enumerate(got["items"])], kind)
    return envelope(about, items, query, source.fields, ["_at"])


def http_status(body: dict) -> int:
    """The HTTP status of a request's envelope."""
    return LOOKUP_STATUS[body["status"]] if "params" in body else 200


def handle(spark: SparkSession, sources: dict[str, Source], target: str, complete: Callable[[str], str] | None = None) -> tuple[int, dict]:
    """(status, body) of ``GET /v1/SOURCE``, ``/v1/SOURCE/schema``, ``/v1/SOURCE/ask?q=``, ``/openapi.json`` and ``/healthz``."""
    url = urlsplit(target)
    params = {k: v[0] for k, v in parse_qs(url.query).items()}
    parts = [p for p in url.path.split("/") if p]
    if parts == ["healthz"]:
        return 200, {"ok": True, "sources": sorted(sources)}
    if parts == ["openapi.json"]:
        return 200, openapi(sources)
    if len(parts) < 2 or parts[0] != "v1" or parts[1] not in sources:
        return 404, {"error": "unknown source", "code": "not_found"}
    source, what = sources[parts[1]], parts[2] if len(parts) > 2 else ""
    try:
        if what == "schema":
            return 200, json_schema(source.name, source.fields, source.version)
        if what == "ask" and complete:
            got = compile_question(complete, params.get("q", ""), source.fields, set(source.lookup_params))
            if got.error or got.query is None:
                return 400, got.error or {"error": "no query", "code": "invalid_value"}
            body = query_source(spark, source, got.params, {"_meta": {"question": params.get("q", ""), "compiled_rounds": got.rounds}})
            return http_status(body), body
        if what:
            return 404, {"error": "unknown path", "code": "not_found"}
        body = query_source(spark, source, params)
        return http_status(body), body
    except QueryError as e:
        return 400, e.as_dict()


def openapi(sources: dict[str, Source]) -> dict:
    """An OpenAPI description; a field's operators come from the same table that the grammar checks."""
    text = {"type": "string"}
    controls = {"limit": {"type": "integer", "minimum": 0, "maximum": MAX_LIMIT}, "offset": {"type": "integer", "minimum": 0}}
    error = {"type": "object", "properties": {k: text for k in ("error", "param", "code", "expected_type", "detail")}}

    def param(name: str, schema: dict, about: str = "", required: bool = False) -> dict:
        return {"name": name, "in": "query", "required": required, "schema": schema} | ({"description": about} if about else {})

    def field_param(name: str, ft: FieldType) -> dict:
        kind = {"type": "string", "enum": list(ft.members)} if ft.members else text if ft.is_list else {"type": SCALARS[ft.base][1]}
        return param(name, kind, f"{ft.name}; {', '.join(f'{name}__{op}' for op in ft.operators())}")

    paths = {}
    for s in sources.values():
        wanted = [param(p, text, required=True) for p in sorted(s.lookup_params)]
        asked = wanted + [field_param(n, ft) for n, ft in s.fields.items() if n not in s.lookup_params] + [param(c, controls.get(c, text)) for c in CONTROLS]
        row = json_schema(s.name, s.fields, s.version)
        whole = {"type": "object", "properties": {"source": text, "schema_version": text, "count": {"type": "integer"}, "returned": {"type": "integer"}, "items": {"type": "array", "items": row}}}
        answers = {"200": {"description": "items", "content": {"application/json": {"schema": whole}}}, "400": {"$ref": "#/components/responses/InvalidQuery"}}
        answers |= {str(code): {"description": status} for status, code in LOOKUP_STATUS.items() if code >= 500} if s.lookup_params else {}
        paths[f"/v1/{s.name}"] = {"get": {"parameters": asked, "responses": answers}}
        paths[f"/v1/{s.name}/schema"] = {"get": {"responses": {"200": {"description": "JSON schema of an item"}}}}
    invalid = {"description": "a query that cannot be taken", "content": {"application/json": {"schema": error}}}
    return {"openapi": "3.1.0", "info": {"title": "tarnflow", "version": "1"}, "components": {"responses": {"InvalidQuery": invalid}}, "paths": paths}


def tools(sources: dict[str, Source]) -> list[dict]:
    """Tool descriptions for a model: list, schema, data and one lookup for each source with parameters."""
    text = {"type": "string"}
    out = [{"name": "list_sources", "inputSchema": {"type": "object"}}, {"name": "get_schema", "inputSchema": {"type": "object", "properties": {"source": text}, "required": ["source"]}}, {"name": "get_data", "inputSchema": {"type": "object", "properties": {"source": text, "filter": {"type": "object"}, **{c: text for c in CONTROLS}}, "required": ["source"]}}]
    return out + [{"name": f"lookup_{s.name}", "inputSchema": {"type": "object", "properties": {p: text for p in s.lookup_params}, "required": sorted(s.lookup_params)}} for s in sources.values() if s.lookup_params]


def call_tool(spark: SparkSession, sources: dict[str, Source], name: str, args: dict[str, Any]) -> dict:
    """The answer of a tool; the ``filter`` object is flattened, controls beside it win."""
    if name == "list_sources":
        return {"sources": sorted(sources)}
    key = name.removeprefix("lookup_") if name.startswith("lookup_") else args.get("source")
    if key not in sources:
        return {"error": "unknown source", "code": "not_found"}
    if name == "get_schema":
        return json_schema(key, sources[key].fields, sources[key].version)
    try:
        flat = dict(args.get("filter") or {}) | {k: v for k, v in args.items() if k in CONTROLS or k in sources[key].lookup_params}
        return query_source(spark, sources[key], flat)
    except QueryError as e:
        return e.as_dict()


def serve_tools(spark: SparkSession, sources: dict[str, Source], lines, write: Callable[[str], Any]) -> None:
    """The tool protocol over lines of JSON: initialize, tools/list, tools/call, ping."""
    for line in lines:
        try:
            message = json.loads(line)
        except ValueError:
            continue
        method, params = message.get("method"), message.get("params") or {}
        result: dict | None = {"initialize": {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "tarnflow", "version": "1"}}, "ping": {}, "tools/list": {"tools": tools(sources)}}.get(method)
        if method == "tools/call":
            answer = call_tool(spark, sources, params.get("name", ""), params.get("arguments") or {})
            result = {"content": [{"type": "text", "text": json.dumps(answer, default=str)}], "isError": "error" in answer}
        if "id" in message:
            body = {"result": result} if result is not None else {"error": {"code": -32601, "message": "unknown method"}}
            write(json.dumps({"jsonrpc": "2.0", "id": message["id"], **body}) + "\n")


def main(argv: list[str] | None = None) -> int:
    """``python -m tarnflow.surfaces PATH --field 'name: type' ... key=value ...``: query a Parquet table."""
    parser = argparse.ArgumentParser(description=main.__doc__)
    parser.add_argument("path")
    parser.add_argument("--field", action="append", default=[], help="name: type")
    parser.add_argument("params", nargs="*")
    args = parser.parse_args(argv)
    fields = {n.strip(): parse_type(t) for n, _, t in (f.partition(":") for f in args.field)}
    spark = SparkSession.builder.getOrCreate()
    try:
        out = query_source(spark, Source("table", fields, lambda s: s.read.parquet(args.path)), dict(p.split("=", 1) for p in args.params))
    except QueryError as e:
        print(json.dumps(e.as_dict()))
        return 2
    print(json.dumps(out, default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
