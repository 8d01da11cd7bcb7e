"""Loose JSON values: lists that may be single values, keys with two names, dotted paths, and what counts as missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def listed(json: Column) -> Column:
    """The elements of a JSON array, or a single value as the only one; empty for null."""
    many = F.from_json(json, "array<string>")
    return F.when(F.coalesce(json, F.lit("")) == "", F.array().cast("array<string>")).when(json.startswith("["), many).otherwise(F.array(json))


def either(json: str, *keys: str) -> Column:
    """The value of the first of these keys that has one."""
    return F.coalesce(*(F.get_json_object(json, f"$.{k}") for k in keys))


def dotted(json: str, path: str, fallback: str) -> Column:
    """The value at `a.b.c`, or the fallback."""
    return F.coalesce(F.get_json_object(json, f"$.{path}"), F.lit(fallback))


def truthy(json: Column) -> Column:
    """Whether a JSON value counts: not null, zero, false, an empty text, list or map."""
    number = json.try_cast("double")
    return F.coalesce(~json.isin("", "false", "[]", "{}") & F.coalesce(number != 0, F.lit(True)), F.lit(False))
