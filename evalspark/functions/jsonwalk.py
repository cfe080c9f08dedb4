"""Walks over JSON: forbidden values, named fields, conformance to a schema."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.hashing import json_number
from evalspark.functions.text import normalize_key


#: A text of JSON, without recursion and so of any length, and what may follow if it is a key; or another scalar.
_TEXT = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_TOKEN = _TEXT + r"\s*+:?+|true|false|null|-?[0-9][0-9.eE+-]*+"
# Fixed value: names in brackets.
BRACKETED = r"\[([^\]]+)\]"


def scalars(json_col: Column | str) -> Column:
    """All scalars of a JSON text at any depth, as Python prints them; null where the text isn't JSON.

    One pass over the text finds its tokens: a text is read as a whole, so
    nothing within it counts, and one before a colon is a key.
    """
    text = F.col(json_col) if isinstance(json_col, str) else json_col
    tokens = F.filter(F.regexp_extract_all(text, F.lit(_TOKEN), 0), lambda t: ~t.endswith(":"))
    read = F.from_json(F.concat(F.lit("["), F.array_join(tokens, ","), F.lit("]")), "array<string>")
    shown = lambda t, v: F.when(t.startswith('"'), v).when(t == "true", "True").when(t == "false", "False").when(t == "null", "None").when(t.rlike("[.eE]"), json_number(t.try_cast("double"))).when(t == "-0", "0").otherwise(t)
    return F.when(F.try_parse_json(text).isNotNull(), F.zip_with(tokens, read, shown))


def forbidden_value(json_col: Column | str, forbidden: list[str]) -> Column:
    """Whether a scalar anywhere in the JSON, keys apart, is one of the forbidden texts."""
    return F.coalesce(F.arrays_overlap(scalars(json_col), F.array(*map(F.lit, forbidden)).cast("array<string>")), F.lit(False))


def has_forbidden_value(df: DataFrame, key: str, json_col: str, forbidden: list[str]) -> DataFrame:
    """(key, forbidden) for each row of df: one scan, at any depth."""
    return df.select(key, forbidden_value(json_col, forbidden).alias("forbidden"))


def query_fields(text: Column) -> Column:
    """Normalised last parts of the names a query mentions, sorted and distinct.

    Names stand in brackets; where the whole text is JSON, they are also the
    texts under the keys field and value_field at any depth.  The walk reads the
    JSON printed without white space: there a quote after { or , opens a key, as
    quotes within texts are escaped.
    """
    text = F.coalesce(text, F.lit(""))
    listed = F.regexp_extract_all(text, F.lit(BRACKETED), 1)
    printed = F.coalesce(F.to_json(F.try_parse_json(text)), F.lit(""))
    keyed = F.regexp_extract_all(printed, F.lit(rf'[{{,]"(?:field|value_field)":({_TEXT})'), 1)
    read = F.transform(keyed, lambda x: F.get_json_object(F.concat(F.lit('{"v":'), x, F.lit("}")), "$.v"))
    names = F.transform(F.concat(listed, read), lambda n: normalize_key(F.substring_index(n, ".", -1)))
    return F.array_sort(F.array_distinct(F.filter(names, lambda n: n != "")))


_TYPES = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN", "null": "VOID"}
#: Bounds: for each keyword what it measures, and when the measure breaks it.
_BOUNDS = {
    "minLength": ("length", lambda x, n: x < n), "maxLength": ("length", lambda x, n: x > n),
    "minimum": ("number", lambda x, n: x < n), "maximum": ("number", lambda x, n: x > n),
    "exclusiveMinimum": ("number", lambda x, n: x <= n), "exclusiveMaximum": ("number", lambda x, n: x >= n),
    "multipleOf": ("number", lambda x, n: F.abs(x / n - F.round(x / n)) > 1e-9),
    "minItems": ("items", lambda x, n: x < n), "maxItems": ("items", lambda x, n: x > n),
    "minProperties": ("names", lambda x, n: x < n), "maxProperties": ("names", lambda x, n: x > n),
}
_KNOWN = {"type", "required", "properties", "additionalProperties", "enum", "const", "pattern", "items", "allOf", "anyOf", "oneOf", "not", "$schema", "title", "description", *_BOUNDS}


def schema_errors(json_col: Column, schema: dict[str, Any]) -> Column:
    """An array of the places where a JSON text breaks the schema; an unknown keyword raises ValueError at once."""
    value = F.try_parse_json(json_col)
    return F.when(value.isNull(), F.array(F.lit("$: not JSON"))).otherwise(_errors(value, schema, "$"))


def _errors(value: Column, schema: dict[str, Any], path: str) -> Column:
    if unknown := set(schema) - _KNOWN:
        raise ValueError(f"schema keywords not supported: {sorted(unknown)}")
    kind = F.schema_of_variant(value)
    checks: list[Column] = []
    error = lambda bad, what: F.when(F.coalesce(bad, F.lit(False)), F.array(F.lit(f"{path}: {what}"))).otherwise(F.array().cast("array<string>"))
    is_object, is_array, is_text = kind.startswith("OBJECT"), kind.startswith("ARRAY"), kind == "STRING"
    number = F.try_variant_get(value, "$", "double")
    is_number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    tests = {"object": is_object, "array": is_array, "number": is_number, "integer": is_number & (number == F.floor(number))} | {k: kind == v for k, v in _TYPES.items() if k != "integer"}
    if "type" in schema:
        wanted = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        good = F.lit(False)
        for name in wanted:
            good = good | tests[name]
        checks.append(error(~good, "type"))
    text = F.try_variant_get(value, "$", "string")
    for key, values in (("enum", schema.get("enum")), ("const", [schema["const"]] if "const" in schema else None)):
        if values is not None:
            checks.append(error(~F.coalesce(F.to_json(value).isin([json.dumps(v, ensure_ascii=False) for v in values]), F.lit(False)), key))
    names = F.json_object_keys(F.to_json(value))
    items = F.try_variant_get(value, "$", "array<variant>")
    # Each measure is null, and breaks nothing, where the value isn't of its type.
    measures = {"length": F.when(is_text, F.length(text)), "number": F.when(is_number, number), "items": F.when(is_array, F.size(items)), "names": F.when(is_object, F.size(names))}
    checks += [error(broken(measures[what], F.lit(schema[key])), key) for key, (what, broken) in _BOUNDS.items() if key in schema]
    if "pattern" in schema:
        checks.append(error(is_text & ~text.rlike(f"(?U){schema['pattern']}"), "pattern"))
    fits = lambda key: [F.size(_errors(value, inner, path)) == 0 for inner in schema[key]]
    count = lambda tests: sum((t.cast("int") for t in tests), F.lit(0))
    checks += [_errors(value, inner, path) for inner in schema.get("allOf", [])]
    if "anyOf" in schema:
        checks.append(error(count(fits("anyOf")) == 0, "anyOf"))
    if "oneOf" in schema:
        checks.append(error(count(fits("oneOf")) != 1, "oneOf"))
    if "not" in schema:
        checks.append(error(F.size(_errors(value, schema["not"], path)) == 0, "not"))
    for name in schema.get("required", []):
        checks.append(error(is_object & ~F.array_contains(names, name), f"required {name}"))
    if schema.get("additionalProperties") is False:
        extra = F.array_except(names, F.array(*[F.lit(n) for n in schema.get("properties", {})]).cast("array<string>"))
        checks.append(error(is_object & (F.size(extra) > 0), "additionalProperties"))
    for name, inner in schema.get("properties", {}).items():
        field = F.try_variant_get(value, f"$.{name}", "variant")
        checks.append(F.when(is_object & F.array_contains(names, name), _errors(field, inner, f"{path}.{name}")).otherwise(F.array().cast("array<string>")))
    if "items" in schema:
        checks.append(F.when(is_array, F.flatten(F.transform(items, lambda v: _errors(v, schema["items"], f"{path}[]")))).otherwise(F.array().cast("array<string>")))
    return F.concat(*checks) if checks else F.array().cast("array<string>")
