"""Canonical JSON as columns: rows that differ give texts that differ, and any engine that follows these rules gives the same text.

Objects have their names in order and no spaces.  Texts are escaped to printable ASCII (``\\uXXXX`` in lower case, pairs of them beyond the basic
plane).  Null is ``null`` and nothing else is.  Whole numbers and decimals are their digits; a double is its shortest digits without trailing
zeros, ``e`` and the power of ten (12.5 is ``125e-1``), so no engine's way of printing matters; not-a-number and the infinities are texts.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Json(NamedTuple):
    """A column that holds JSON already."""

    column: Column


#: The short escapes of JSON, by code.
SHORT = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r", 34: '\\"', 92: "\\\\"}


def _unit(code: Column) -> Column:
    return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(code)), 4, "0"))


def _escaped(c: Column) -> Column:
    code = F.ascii(c)
    out = F.when(code.between(32, 126) & ~code.isin(34, 92), c)
    for n, text in SHORT.items():
        out = out.when(code == n, text)
    rest = code - 0x10000
    return out.when(code < 0x10000, _unit(code)).otherwise(F.concat(_unit(F.shiftright(rest, 10) + 0xD800), _unit(rest.bitwiseAND(0x3FF) + 0xDC00)))


def text(s: Column) -> Column:
    """A text in quotes; null stays null."""
    plain = F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    slow = F.array_join(F.transform(F.regexp_extract_all(s, F.lit("(?s)(.)"), F.lit(1)), _escaped), "")
    return F.concat(F.lit('"'), F.when(F.regexp_like(s, F.lit("[^\\x20-\\x7E]")), slow).otherwise(plain), F.lit('"'))


def double(x: Column) -> Column:
    s = x.cast("double").cast("string")
    mantissa = F.substring_index(s, "E", 1)  # texts are cut rather than matched: each of the parts is read several times
    whole, part = F.ltrim(F.substring_index(mantissa, ".", 1), F.lit("-")), F.substring_index(mantissa, ".", -1)
    digits = F.ltrim(F.concat(whole, part), F.lit("0"))
    short = F.rtrim(digits, F.lit("0"))
    power = F.when(s.contains("E"), F.substring_index(s, "E", -1).try_cast("int")).otherwise(0) - F.length(part) + F.length(digits) - F.length(short)
    number = F.concat(F.when(s.startswith("-"), "-").otherwise(""), F.when(short == "", "0e0").otherwise(F.concat(short, F.lit("e"), power.cast("string"))))
    return F.when(s.isin("NaN", "Infinity", "-Infinity"), F.concat(F.lit('"'), s, F.lit('"'))).otherwise(number)


def number(x: Column) -> Json:
    """A double for an object; plain columns there are texts, whole numbers, decimals or booleans."""
    return Json(double(x))


def value(c: Column | Json | dict) -> Column:
    """Any atomic column but a double, JSON, or an object of such; never null."""
    if isinstance(c, dict):
        return obj(c)
    if isinstance(c, Json):
        return F.coalesce(c.column, F.lit("null"))
    kind = F.typeof(c)
    digits = kind.isin("tinyint", "smallint", "int", "bigint", "boolean") | kind.startswith("decimal")
    bare = F.raise_error(F.lit("doubles are to be given as number(...)")).cast("string")
    return F.when(c.isNull(), "null").when(digits, c.cast("string")).when(kind.isin("double", "float"), bare).otherwise(text(c.cast("string")))


def texts(items: Column) -> Json:
    """An array of texts, in its order."""
    return Json(F.concat(F.lit("["), F.array_join(F.transform(items, lambda x: F.coalesce(text(x), F.lit("null"))), ","), F.lit("]")))


def doubles_by_name(entries: Column) -> Json:
    """A map from text to double as an object, by name."""
    pairs = F.transform(F.array_sort(F.map_entries(entries)), lambda e: F.concat(text(e["key"]), F.lit(":"), F.coalesce(double(e["value"]), F.lit("null"))))
    return Json(F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")))


def obj(fields: dict) -> Column:
    """An object; names are plain ASCII."""
    parts = [F.concat(F.lit(f'"{k}":'), value(v)) for k, v in sorted(fields.items())]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def canonical(**fields: Column | Json | dict) -> Column:
    return obj(fields)
