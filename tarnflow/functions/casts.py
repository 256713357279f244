"""Lenient casts of raw text to declared types, as Column expressions, and the same for a driver's literals."""

from __future__ import annotations

import re
from datetime import datetime
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tarnflow.functions.types import FieldType

# Spellings of booleans, month names, accepted date layouts, currency signs, starts of relative addresses.
TRUE, FALSE = ("true", "yes", "1", "y", "on"), ("false", "no", "0", "n", "off")
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
DATE_LAYOUTS = ("%Y-%m-%d", "%Y-%m-%d %H:%M:%S", "%d %b %Y", "%b %d, %Y")
CURRENCY = "$€£"
ADDRESS_STARTS = ("http://", "https://", "/", "./", "../", "#", "?", "mailto:")
INT_TEXT, FLOAT_TEXT = r"[-+]?\d[\d,]*", r"[-+]?\d[\d,]*(?:\.\d+)?"
_ISO = r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2})(?:(:\d{2})(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?)?$"


class CastError(ValueError):
    """Text that does not fit the declared type."""


def collapsed(text: Column) -> Column:
    """White space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def _found(text: Column, pattern: str) -> Column:
    return F.replace(F.nullif(F.regexp_extract(text, pattern, 0), F.lit("")), F.lit(","), F.lit(""))


def to_int(text: Column) -> Column:
    """The whole text as a number, else the first number in it; beyond 64 bits null."""
    plain = F.replace(F.trim(text), F.lit(","), F.lit(""))
    return F.when(plain.rlike(r"^[-+]?\d+$"), plain.try_cast("long")).otherwise(_found(text, INT_TEXT).try_cast("long"))


def to_float(text: Column) -> Column:
    plain = F.regexp_replace(F.replace(F.trim(text), F.lit(","), F.lit("")), f"^[{CURRENCY}]+", "")
    strict = plain.rlike(r"(?i)^[-+]?(\d+\.?\d*([eE][-+]?\d+)?|\.\d+([eE][-+]?\d+)?|inf|infinity|nan)$")
    return F.when(strict, plain.try_cast("double")).otherwise(_found(text, FLOAT_TEXT).try_cast("double"))


def to_bool(text: Column) -> Column:
    plain = F.lower(F.trim(text))
    return F.when(plain.isin(*TRUE), F.lit(True)).when(plain.isin(*FALSE), F.lit(False))


def to_datetime(text: Column) -> Column:
    """Canonical ISO text, or null."""
    plain = F.trim(text)
    part = lambda i: F.regexp_extract(plain, _ISO, i)
    day_first, month_first = r"^(\d{1,2}) ([A-Za-z]{3}) (\d{4})$", r"^([A-Za-z]{3}) (\d{1,2}), (\d{4})$"
    month = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS, 1) for x in (m, f"{i:02d}")])
    named = lambda p, d, m: F.concat_ws("-", F.regexp_extract(plain, p, 3), month[F.lower(F.regexp_extract(plain, p, m))], F.lpad(F.regexp_extract(plain, p, d), 2, "0"))
    compact = F.regexp_replace(plain, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    day = F.when(plain.rlike(_ISO), part(1)).when(plain.rlike(day_first), named(day_first, 1, 2)).when(plain.rlike(month_first), named(month_first, 2, 1)).when(plain.rlike(r"^\d{8}$"), compact)
    iso = plain.rlike(_ISO)
    clock = F.when(iso & (part(2) != ""), F.concat(part(2), F.when(part(3) != "", part(3)).otherwise(F.lit(":00")))).otherwise(F.lit("00:00:00"))
    fraction = F.when(iso & (part(4) != ""), F.rpad(part(4), 7, "0")).otherwise(F.lit(""))
    zone = F.when(iso, F.regexp_replace(part(5), "^Z$", "+00:00")).otherwise(F.lit(""))
    valid = F.concat(day, F.lit(" "), clock).try_cast("timestamp_ntz").isNotNull()
    return F.when(valid, F.concat(day, F.lit("T"), clock, F.when(fraction.rlike("^[.]0*$"), F.lit("")).otherwise(fraction), zone))


def absolute(raw: str | None, base: str | None) -> str | None:
    """An absolute http(s) address, or None."""
    text = (raw or "").strip()
    if not text or re.search(r"\s", text) or not (text.startswith(ADDRESS_STARTS) or "://" in text):
        return None
    try:
        out = urljoin(base or "", text)
        parts = urlsplit(out)
    except ValueError:
        return None
    return out if parts.scheme in ("http", "https") and parts.netloc else None


@F.pandas_udf(StringType())
def resolve_url(raw: pd.Series, base: pd.Series) -> pd.Series:
    """Address resolution has no built-in function; Arrow batches."""
    return pd.Series([absolute(r, b) for r, b in zip(raw, base)], dtype=object)


def cast_column(text: Column, ft: FieldType, base: Column | None = None) -> Column:
    """The value of raw text (an array of texts for lists) or null where it is blank or does not fit."""
    if ft.is_list:
        return F.filter(F.transform(text, collapsed), lambda x: x != "")
    if ft.base == "url":
        return resolve_url(text, F.lit("") if base is None else base)
    if ft.base == "enum":
        return F.create_map(*[F.lit(x) for m in reversed(ft.members) for x in (m.lower(), m)])[F.lower(collapsed(text))] if len({m.lower() for m in ft.members}) == len(ft.members) else F.coalesce(*[F.when(F.lower(collapsed(text)) == m.lower(), F.lit(m)) for m in ft.members])
    if ft.base == "str":
        return F.nullif(collapsed(text), F.lit(""))
    return {"int": to_int, "float": to_float, "bool": to_bool, "datetime": to_datetime}[ft.base](text)


def cast_failed(text: Column, value: Column, ft: FieldType) -> Column:
    """Whether raw text does not fit: a blank one where a value is required, or one that casts to nothing."""
    if ft.is_list:
        return F.lit(False)
    blank = F.coalesce(collapsed(text), F.lit("")) == ""
    return F.when(blank, F.lit(not ft.nullable)).otherwise(value.isNull())


def cast_literal(raw, ft: FieldType, base: str = ""):
    """A driver's literal by the same rules; raises :class:`CastError`."""
    text = re.sub(r"\s+", " ", "" if raw is None else str(raw)).strip()
    if not text:
        raise CastError("required")
    if ft.base == "str":
        return text
    if ft.base == "enum":
        for m in ft.members:
            if m.lower() == text.lower():
                return m
    elif ft.base == "int":
        plain = text.replace(",", "")
        if re.fullmatch(r"[-+]?\d+", plain) or (found := re.search(INT_TEXT, text)):
            return int(plain if re.fullmatch(r"[-+]?\d+", plain) else found[0].replace(",", ""))
    elif ft.base == "float":
        plain = text.replace(",", "").lstrip(CURRENCY)
        try:
            return float(plain)
        except ValueError:
            if found := re.search(FLOAT_TEXT, text):
                return float(found[0].replace(",", ""))
    elif ft.base == "bool":
        if text.lower() in TRUE + FALSE:
            return text.lower() in TRUE
    elif ft.base == "url":
        if out := absolute(text, base):
            return out
    elif ft.base == "datetime":
        try:
            return datetime.fromisoformat(text).isoformat()
        except ValueError:
            for layout in DATE_LAYOUTS:
                try:
                    return datetime.strptime(text, layout).isoformat()
                except ValueError:
                    continue
    raise CastError(f"{text!r} is no {ft.name}")
