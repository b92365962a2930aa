"""JSON held in texts: decoding with defaults, objects inside answers, leaves by path."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def string_list(text: Column) -> Column:
    """A JSON or single-quoted list of strings; anything else is an empty list."""
    read = F.when(F.rlike(text, F.lit(r"(?s)^\s*\[")), F.from_json(text, "array<string>"))
    return F.coalesce(read, F.array().cast("array<string>"))


def object_in(text: Column) -> Column:
    """The widest ``{...}`` of an answer that parses, or the whole text, as a variant object."""
    inner = F.try_parse_json(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")))
    whole = F.try_parse_json(text)
    found = F.coalesce(inner, whole)
    return F.when(F.startswith(F.schema_of_variant(found), F.lit("OBJECT")), found)


def repaired(text: Column) -> Column:
    """(status, value): ``ok`` as it is or without code fences, ``repaired`` from the widest
    braces, ``failed``."""
    bare = F.trim(F.regexp_replace(text, r"(?m)^\s*```(?:json)?\s*$", ""))
    whole = F.try_parse_json(F.nullif(bare, F.lit("")))
    inner = F.try_parse_json(F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit("")))
    status = F.when(whole.isNotNull(), "ok").when(inner.isNotNull(), "repaired").otherwise("failed")
    return F.struct(status.alias("status"), F.to_json(F.coalesce(whole, inner)).alias("value"))


def _leaves(value, path: str, out: list[tuple[str, str]]) -> None:
    if isinstance(value, dict) and value:
        for key, inner in value.items():
            _leaves(inner, f"{path}.{key}" if path else key, out)
    elif isinstance(value, list) and value:
        for i, inner in enumerate(value):
            _leaves(inner, f"{path}[{i}]", out)
    elif value is None:
        out.append((path or "$", ""))
    elif isinstance(value, (dict, list)):
        out.append((path or "$", "{}" if isinstance(value, dict) else "[]"))
    else:
        out.append((path or "$", str(value)))


def leaves(text: Column) -> Column:
    """(path, value) of all leaves of a JSON text of any depth; null where it does not parse."""

    @F.arrow_udf("array<struct<path:string,value:string>>")
    def flatten(batch: pa.Array) -> pa.Array:
        rows = []
        for t in batch.to_pylist():
            try:
                out: list[tuple[str, str]] = []
                _leaves(json.loads(t), "", out)
                rows.append([{"path": p, "value": v} for p, v in out])
            except (TypeError, ValueError):
                rows.append(None)
        return pa.array(rows, pa.list_(pa.struct([("path", pa.string()), ("value", pa.string())])))

    return flatten(text)
