"""A parsed query as a DataFrame plan: filters, search, stable order, paging, projection.

Predicates on plain columns are built so that they reach the Parquet scan;
sorting with a limit becomes a top-k.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnflow.functions.types import ORDERED, TEXTUAL, FieldType
from tarnflow.plans.grammar import Filter, Query, QueryError, parse_query

#: Rows of an answer to a request without a limit.
PAGE = 10_000


def _is_time(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.TimestampType, T.TimestampNTZType))


def _as_time(df: DataFrame, name: str) -> Column:
    """A datetime field as a timestamp without zone (text is parsed; what cannot be is null)."""
    if _is_time(df, name):
        return F.col(name)
    zoned = F.col(name).rlike(r"[+-]\d{2}:\d{2}$")
    return F.when(zoned, F.convert_timezone(None, F.lit("UTC"), F.col(name).try_cast("timestamp").cast("timestamp_ntz"))).otherwise(F.col(name).try_cast("timestamp_ntz"))


def _as_text(df: DataFrame, name: str) -> Column:
    """A datetime field as the canonical text that equality compares."""
    if not _is_time(df, name):
        return F.col(name)
    return F.concat(F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss"), F.regexp_replace(F.date_format(name, ".SSSSSS"), r"^\.0+$", ""))


def predicate(df: DataFrame, f: Filter, ft: FieldType) -> Column:
    """True where the row matches; null values match nothing but ``isnull``."""
    col = F.col(f.field)
    if f.op == "isnull":
        return col.isNull() if f.value else col.isNotNull()
    if ft.is_list:
        # a list equals no text; contains asks for an exact element
        return F.array_contains(col, f.value) if f.op == "contains" else col.isNotNull() if f.op == "ne" else F.lit(False)
    if f.op == "contains":
        return F.lower(col).contains(f.value.lower())
    if f.op in ("eq", "ne", "in"):
        if ft.base == "datetime":
            col = _as_text(df, f.field)
        return col.isin(f.value) if f.op == "in" else col == F.lit(f.value) if f.op == "eq" else col != F.lit(f.value)
    value = F.lit(f.value)
    if ft.base == "datetime":
        if not _is_time(df, f.field) and (f.value[-6] in "+-" and f.value[-3] == ":"):
            value = F.convert_timezone(None, F.lit("UTC"), F.lit(f.value).cast("timestamp").cast("timestamp_ntz"))
        elif f.value[-6:-5] in ("+", "-") and f.value[-3:-2] == ":" and "T" in f.value:
            raise QueryError("the field has no time zone", f.field, "invalid_value", ft.name)
        else:
            value = F.lit(f.value).cast("timestamp_ntz")
        col = _as_time(df, f.field)
    out = {"gt": col > value, "gte": col >= value, "lt": col < value, "lte": col <= value}[f.op]
    return out & ~F.isnan(F.col(f.field)) if ft.base == "float" and f.op in ("gt", "gte") else out


def search(needle: str, schema: dict[str, FieldType]) -> Column:
    """The text occurs in any textual field, whatever the case."""
    low = needle.lower()
    tests = [F.exists(n, lambda x: F.lower(x).contains(low)) if ft.is_list else F.lower(F.col(n)).contains(low) for n, ft in schema.items() if ft.is_list or ft.base in TEXTUAL]
    return reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests], F.lit(False))


def sort_key(df: DataFrame, name: str, ft: FieldType) -> Column:
    if ft.is_list:
        return F.array_join(name, ",")
    if ft.base == "datetime":
        return F.when(F.col(name).isNotNull(), F.coalesce(_as_time(df, name), F.lit("1970-01-01").cast("timestamp_ntz")))
    return F.col(name) if ft.base in ORDERED else F.lower(F.col(name).cast("string"))


def matched(df: DataFrame, query: Query, schema: dict[str, FieldType]) -> DataFrame:
    """The rows that all filters and the search take."""
    for f in query.filters:
        df = df.where(predicate(df, f, schema[f.field]))
    return df.where(search(query.q, schema)) if query.q else df


def plan(df: DataFrame, query: Query, schema: dict[str, FieldType], ordinal: list[str] = ()) -> DataFrame:
    """Filter, search, sort, page, project.  ``ordinal``: columns of the input order, which decides ties."""
    out = matched(df, query, schema)
    keys = []
    for name, down in query.sort:
        key = sort_key(df, name, schema[name])
        keys.append(key.desc_nulls_last() if down else key.asc_nulls_last())
    if keys or ordinal and (query.offset or query.limit is not None):
        out = out.orderBy(*keys, *ordinal)
    if query.offset:
        out = out.offset(query.offset)
    if query.limit is not None:
        out = out.limit(query.limit)
    return out.select(*(query.fields if query.fields is not None else schema))


def drop_all_null(df: DataFrame, fields: list[str]) -> DataFrame:
    """Rows with a value in any of the fields (an empty list is a value)."""
    return df.na.drop(how="all", subset=fields)


def run_query(df: DataFrame, params: dict[str, Any], schema: dict[str, FieldType], ordinal: list[str] = ()) -> DataFrame:
    return plan(df, parse_query(params, schema)[0], schema, ordinal)


def envelope(base: dict, df: DataFrame, query: Query, schema: dict[str, FieldType], ordinal: list[str] = (), most: int = PAGE) -> dict:
    """The base with count (matched), returned, items and _query; one page of rows reaches the driver.

    Without a limit the page has up to ``most`` rows; if more match,
    ``next_offset`` tells where the next page starts.  All rows of a large table
    are written from :func:`plan`.
    """
    page = query if query.limit is not None else replace(query, limit=most)
    rows = plan(df, replace(page, fields=None) if query.fields == [] else page, schema, ordinal).collect()
    items = [{} if query.fields == [] else r.asDict(recursive=True) for r in rows]
    short = query.limit is None and len(items) < most and (items or not query.offset)
    count = query.offset + len(items) if short else matched(df, query, schema).count()
    out = base | {"count": count, "returned": len(items), "items": items, "_query": query.echo()}
    after = query.offset + len(items)
    return out | {"next_offset": after} if query.limit is None and items and after < count else out
