"""The part of JSON Schema that properties use."""

from __future__ import annotations

import json
from typing import Any

import pandas as pd

_TYPES = {
    "object": lambda v: isinstance(v, dict), "array": lambda v: isinstance(v, list), "string": lambda v: isinstance(v, str),
    "boolean": lambda v: isinstance(v, bool), "null": lambda v: v is None,
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "integer": lambda v: not isinstance(v, bool) and (isinstance(v, int) or isinstance(v, float) and v.is_integer()),
}


def _equal(a: Any, b: Any) -> bool:
    return type(a) is not bool and type(b) is not bool and a == b or a is b or json.dumps(a, sort_keys=True) == json.dumps(b, sort_keys=True)


def check(schema: Any, value: Any, path: str = "$") -> str | None:
    """The first failure as ``$.path: what``, None if the value meets the schema.

    Keywords are looked at in a fixed order: type, const, enum, bounds, lengths, required, properties, other
    properties, item counts, items, then allOf, anyOf, oneOf and not.
    """
    if isinstance(schema, bool):
        return None if schema else f"{path}: nothing is allowed here"
    kinds = schema.get("type")
    if kinds is not None:
        kinds = [kinds] if isinstance(kinds, str) else kinds
        if not any(k in _TYPES and _TYPES[k](value) for k in kinds):
            return f"{path}: expected {' or '.join(kinds)}"
    if "const" in schema and not _equal(schema["const"], value):
        return f"{path}: must be {json.dumps(schema['const'])}"
    if "enum" in schema and not any(_equal(e, value) for e in schema["enum"]):
        return f"{path}: must be one of {', '.join(json.dumps(e) for e in schema['enum'])}"
    if _TYPES["number"](value):
        if "minimum" in schema and value < schema["minimum"]:
            return f"{path}: must be at least {schema['minimum']}"
        if "maximum" in schema and value > schema["maximum"]:
            return f"{path}: must be at most {schema['maximum']}"
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            return f"{path}: shorter than {schema['minLength']}"
        if "maxLength" in schema and len(value) > schema["maxLength"]:
            return f"{path}: longer than {schema['maxLength']}"
    if isinstance(value, dict):
        for key in schema.get("required", []):
            if key not in value:
                return f"{path}: {key} is required"
        known = schema.get("properties", {})
        for key, sub in known.items():
            if key in value and (why := check(sub, value[key], f"{path}.{key}")):
                return why
        more = schema.get("additionalProperties", True)
        for key in value:
            if key not in known:
                if more is False:
                    return f"{path}: {key} is not allowed"
                if isinstance(more, dict) and (why := check(more, value[key], f"{path}.{key}")):
                    return why
    if isinstance(value, list):
        if len(value) < schema.get("minItems", 0):
            return f"{path}: fewer than {schema['minItems']} items"
        if "maxItems" in schema and len(value) > schema["maxItems"]:
            return f"{path}: more than {schema['maxItems']} items"
        if "items" in schema:
            for i, item in enumerate(value):
                if why := check(schema["items"], item, f"{path}[{i}]"):
                    return why
    for sub in schema.get("allOf", []):
        if why := check(sub, value, path):
            return why
    if "anyOf" in schema and all(check(s, value, path) for s in schema["anyOf"]):
        return f"{path}: meets none of anyOf"
    if "oneOf" in schema and (n := sum(check(s, value, path) is None for s in schema["oneOf"])) != 1:
        return f"{path}: meets {n} of oneOf, not one"
    if "not" in schema and check(schema["not"], value, path) is None:
        return f"{path}: meets what it must not"
    return None


def json_schema_check(schema: str, document: str) -> str | None:
    """``check`` over texts; null in, null out."""
    if schema is None or document is None:
        return None
    try:
        value = json.loads(document)
    except ValueError:
        return "$: not JSON"
    return check(json.loads(schema), value)


def register(spark) -> None:
    """json_schema_check(schema, document) for SQL, run over Arrow batches."""
    from pyspark.sql import functions as F

    @F.pandas_udf("string")
    def udf(schema: pd.Series, document: pd.Series) -> pd.Series:
        return pd.Series([json_schema_check(s, d) for s, d in zip(schema, document)], dtype=object)

    spark.udf.register("json_schema_check", udf)
