"""Operator 7: tool-call linking for chat formatting, in DataFrame functions only.

Calls and results meet in a hash join on the call's identifier. A call may name one call that
it follows; levels come from pointer doubling, so a chain of n calls takes log2(n) joins, and
(level, id) orders calls topologically. Arguments are checked against the JSON schema of their
tool, which is compiled to one expression on variants: nested objects and lists, types, required
and optional members, enumerations, and bounds of numbers, texts and lists. Each call with its
result becomes one canonical JSON object: keys sorted, no spaces.

No conversation is gathered into one row: each call is a row with its level, so a conversation
of any length is spread over tasks.

Defined results: of calls, or results, that repeat an identifier the smallest by content
counts; a call without result is ``unanswered``, a result without call is an ``orphan``, and rows
without identifier are left out. Calls that follow each other in a circle have no level; one
that follows an unknown call has level 0. Arguments that are null or no JSON object are invalid, and
so is a tool without schema. Turns that neither call nor answer are rows of status ``context``
with their role and text. Texts of any length are taken whole. An empty table gives no rows. Only the
columns named are read.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: The most characters or items that a schema may allow.
MOST = (1 << 31) - 1


def levels(calls: DataFrame) -> DataFrame:
    """(call_id, level) for calls (call_id, parent_id): 0 for those that follow none."""
    known = calls.select(F.col("call_id").alias("parent_id")).distinct()
    steps = calls.select("call_id", "parent_id").join(known.withColumn("is_known", F.lit(True)), "parent_id", "left")
    steps = steps.select("call_id", F.when(F.col("is_known"), F.col("parent_id")).alias("up"))
    steps = common.checkpoint(steps.withColumn("level", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long")), in_loop=True)
    for _ in range(math.ceil(math.log2(steps.count() + 1)) + 1):
        if steps.where("up is not null").isEmpty():
            break
        above = steps.select(F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("level").alias("more"))
        steps = steps.join(above, "up", "left").select(
            "call_id", F.col("next").alias("up"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level")
        )
        steps = common.checkpoint(steps, in_loop=True)
    # After as many doublings as any chain needs, only circles are left.
    return steps.select("call_id", F.when(F.col("up").isNull(), F.col("level")).alias("level"))


# What variants call the types of JSON schemas.
TYPES = {"string": "STRING", "boolean": "BOOLEAN", "integer": "BIGINT", "object": "OBJECT", "array": "ARRAY", "null": "VOID"}


def _is(value: Column, kind: str) -> Column:
    """Whether a variant is of a type; integers are numbers, and whole numbers are integers."""
    said = F.schema_of_variant(value)
    number = F.rlike(said, F.lit(r"^(?:BIGINT|DECIMAL|DOUBLE|FLOAT)"))
    if kind == "number":
        return number
    if kind == "integer":
        whole = F.try_variant_get(value, "$", "double")
        return (said == "BIGINT") | (number & (whole == F.floor(whole)))
    return F.startswith(said, F.lit(TYPES[kind]))


def faults(value: Column, schema: dict, path: str = "") -> Column:
    """What is wrong with a variant under a JSON schema, as texts ``kind:path``, unsorted.

    Kinds are type, enum, range (minimum, maximum), length (of texts and lists), missing and
    unknown; the path of a list's items is that of the list with ``[]``.
    """
    none = F.array().cast("array<string>")
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    told: list[Column] = []

    def fault(kind: str, wrong: Column, at: str = path) -> Column:
        return F.when(F.coalesce(wrong, F.lit(False)), F.array(F.lit(f"{kind}:{at or '$'}"))).otherwise(none)

    if "enum" in schema:
        allowed = F.array(*[F.lit(json.dumps(x, ensure_ascii=False, separators=(",", ":"))) for x in schema["enum"]])
        told.append(fault("enum", ~F.array_contains(allowed, F.to_json(value))))
    number, text = F.try_variant_get(value, "$", "double"), F.try_variant_get(value, "$", "string")
    if "minimum" in schema or "maximum" in schema:
        low, high = schema.get("minimum", float("-inf")), schema.get("maximum", float("inf"))
        told.append(fault("range", _is(value, "number") & ~number.between(F.lit(float(low)), F.lit(float(high)))))
    if "minLength" in schema or "maxLength" in schema:
        told.append(fault("length", _is(value, "string") & ~F.char_length(text).between(schema.get("minLength", 0), schema.get("maxLength", MOST))))
    items = F.try_variant_get(value, "$", "array<variant>")
    if "minItems" in schema or "maxItems" in schema:
        told.append(fault("length", _is(value, "array") & ~F.size(items).between(schema.get("minItems", 0), schema.get("maxItems", MOST))))
    if "items" in schema:
        own = F.array_distinct(F.flatten(F.transform(items, lambda x: faults(x, schema["items"], f"{path}[]"))))
        told.append(F.when(_is(value, "array"), own).otherwise(none))
    if "properties" in schema:
        told.append(F.when(_is(value, "object"), _members(value, schema, path)).otherwise(none))
    every = F.concat(none, *told)
    if not kinds:
        return every
    fits = F.lit(False)
    for kind in kinds:
        fits = fits | _is(value, kind)
    return F.when(fits, every).otherwise(F.array(F.lit(f"type:{path or '$'}")))


def _members(value: Column, schema: dict, path: str) -> Column:
    """The faults of an object's members; without additionalProperties others are unknown."""
    below = f"{path}." if path else ""
    known = F.array(*[F.lit(k) for k in schema["properties"]])

    def of(fields: Column) -> Column:
        told = [F.array().cast("array<string>")]
        for name, inner in schema["properties"].items():
            absent = F.array(F.lit(f"missing:{below}{name}")) if name in schema.get("required", []) else F.array().cast("array<string>")
            there = F.map_contains_key(fields, name)
            told.append(F.when(there, faults(F.element_at(fields, name), inner, f"{below}{name}")).otherwise(absent))
        if not schema.get("additionalProperties", False):
            told.append(F.transform(F.array_except(F.map_keys(fields), known), lambda k: F.concat(F.lit(f"unknown:{below}"), k)))
        return F.concat(*told)

    return F.transform(F.array(value.cast("map<string,variant>")), of)[0]


def checked(tool: Column, arguments: Column, schemas: dict[str, dict]) -> Column:
    """The sorted faults of a call's arguments; ``schema`` without a schema, ``object`` without an object."""
    is_object = F.coalesce(_is(arguments, "object"), F.lit(False))
    out = F.when(~F.coalesce(tool.isin(list(schemas)), F.lit(False)), F.array(F.lit("schema"))).when(~is_object, F.array(F.lit("object")))
    for name, schema in schemas.items():
        out = out.when(tool == name, F.array_sort(F.coalesce(faults(arguments, schema), F.array().cast("array<string>"))))
    return out


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict], context: DataFrame | None = None) -> DataFrame:
    """One row a call, one for each orphan result, and one for each row of ``context``.

    ``calls`` has call_id, parent_id, tool and arguments (JSON text); ``results`` has call_id and
    content; ``context`` has call_id, role and text; ``schemas`` gives each tool's JSON schema.
    Returns call_id, status (linked, unanswered, orphan, context), level, valid, faults and message.
    """
    own = calls.where("call_id is not null").groupBy("call_id").agg(F.min(F.struct("tool", "arguments", "parent_id")).alias("c"))
    own = own.select("call_id", "c.tool", "c.arguments", "c.parent_id")
    given = results.where("call_id is not null").groupBy("call_id").agg(F.min("content").alias("content"), F.lit(True).alias("answered"))
    placed = own.join(levels(own), "call_id").withColumn("called", F.lit(True))
    parsed = placed.withColumn("parsed", F.try_parse_json("arguments"))
    both = parsed.withColumn("faults", checked(F.col("tool"), F.col("parsed"), schemas)).join(given, "call_id", "full_outer")
    status = F.when(F.col("called").isNull(), "orphan").when(F.col("answered"), "linked").otherwise("unanswered")
    valid = F.when(F.col("called"), F.size("faults") == 0)
    whole = F.to_json(
        F.struct(
            F.when(valid, F.col("parsed")).alias("arguments"),
            F.col("call_id").alias("id"),
            "level",
            F.col("content").alias("result"),
            status.alias("status"),
            "tool",
        )
    )
    told = both.select("call_id", status.alias("status"), "level", valid.alias("valid"), "faults", whole.alias("message"))
    if context is None:
        return told
    said = context.where("call_id is not null").groupBy("call_id").agg(F.min(F.struct("role", "text")).alias("c"))
    shown = F.to_json(F.struct(F.col("c.text").alias("context"), F.col("call_id").alias("id"), F.col("c.role").alias("role"), F.lit("context").alias("status")))
    none = [F.lit(None).cast(told.schema[c].dataType).alias(c) for c in ("level", "valid", "faults")]
    return told.unionByName(said.select("call_id", F.lit("context").alias("status"), *none, shown.alias("message")))


#: The tools that ``conversation_calls`` writes calls of, with their schemas.
TOOLS = {
    "reply": {
        "type": "object",
        "properties": {"text": {"type": "string"}, "turn": {"type": "integer", "minimum": 0}},
        "required": ["text", "turn"],
    }
}


def conversation_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and other turns of plain conversations (conv_id, turn, role, text).

    A user's turn calls the tool ``reply``, an assistant's turn answers the turn before it, and
    a user's turn follows the one two turns earlier.
    """
    rows = turns.select("conv_id", "turn", "role", "text").where("conv_id is not null and turn is not null")

    def name(back: int) -> Column:
        return F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - back).cast("string"))

    calls = rows.where("role = 'user'").select(
        name(0).alias("call_id"),
        name(2).alias("parent_id"),
        F.lit("reply").alias("tool"),
        F.to_json(F.struct(F.col("turn"), F.col("text"))).alias("arguments"),
    )
    results = rows.where("role = 'assistant'").select(name(1).alias("call_id"), F.col("text").alias("content"))
    others = rows.where("role is null or role not in ('user', 'assistant')").select(name(0).alias("call_id"), "role", "text")
    return calls, results, others
