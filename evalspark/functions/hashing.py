"""Identities: SHA-256 over canonical JSON."""

from __future__ import annotations

import dataclasses
import enum
import hashlib
import json
from collections.abc import Callable, Iterable, Mapping
from datetime import date
from decimal import Decimal
from functools import singledispatch
from pathlib import PurePath
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


@singledispatch
def canonical_value(value: Any) -> Any:
    """JSON's types for any nesting of mappings, sequences, sets and scalars; a rule for each type that JSON lacks."""
    if dataclasses.is_dataclass(value) and not isinstance(value, type):
        return {f.name: canonical_value(getattr(value, f.name)) for f in dataclasses.fields(value)}
    return value


canonical_value.register(Mapping, lambda v: {str(k): canonical_value(x) for k, x in v.items()})
for _kind in (list, tuple):
    canonical_value.register(_kind, lambda v: [canonical_value(x) for x in v])
for _kind in (set, frozenset):
    canonical_value.register(_kind, lambda v: [json.loads(x) for x in sorted(map(canonical_json, v))])
for _kind in (Decimal, PurePath):
    canonical_value.register(_kind, str)
canonical_value.register(date, lambda v: v.isoformat())
canonical_value.register(bytes, lambda v: v.decode())
canonical_value.register(enum.Enum, lambda v: canonical_value(v.value))


def canonical_json(value: Any) -> str:
    """Sorted keys, no white space, characters unescaped; NaN and infinities are refused."""
    return json.dumps(canonical_value(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def content_hash(value: Any) -> str:
    return "sha256:" + hashlib.sha256(canonical_json(value).encode()).hexdigest()


def content_hash_of_lists(value: Mapping[str, Any], lists: Mapping[str, Iterable[str]]) -> str:
    """content_hash of value with lists beside its own keys; their items are canonical JSON already and are taken one at a time."""
    digest, between = hashlib.sha256(), "{"
    for k in sorted({*value, *lists}):
        digest.update(f"{between}{canonical_json(k)}:".encode())
        between = ","
        if k not in lists:
            digest.update(canonical_json(value[k]).encode())
            continue
        digest.update(b"[")
        for i, item in enumerate(lists[k]):
            digest.update(f"{',' if i else ''}{item}".encode())
        digest.update(b"]")
    digest.update(b"}" if between == "," else b"{}")
    return "sha256:" + digest.hexdigest()


def sha256_of(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def json_text(x: Column) -> Column:
    """A string as JSON text, as canonical_json prints it."""
    return F.regexp_replace(F.to_json(F.struct(x.alias("v"))), r'(?s)^\{"v":(.*)\}$', "$1")


def json_number(x: Column) -> Column:
    """A double as JSON text, as Python prints it: the fewest digits that give the same number.

    Numbers below 2.3e-308, which have fewer digits than others, may show more of them.
    """

    def shown(e: Column) -> Column:
        part = lambda i: F.regexp_extract(e, r"^(-?)([0-9])\.([0-9]+)e([+-][0-9]+)$", i)
        digits = F.concat(part(2), F.regexp_replace(part(3), "0+$", ""))
        return F.struct(part(1).alias("sign"), digits.alias("digits"), part(4).try_cast("int").alias("exponent"))

    def laid_out(p: Column) -> Column:
        digits, exponent = p["digits"], p["exponent"]
        fraction = F.when(F.length(digits) > exponent + 1, F.substring(digits, exponent + 2, F.length(digits))).otherwise("0")
        whole = F.concat(F.rpad(F.substring(digits, F.lit(1), exponent + 1), exponent + 1, F.lit("0")), F.lit("."), fraction)
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
        power = F.abs(exponent).cast("string")
        more = F.when(F.length(digits) > 1, F.concat(F.lit("."), F.substring(digits, 2, 20))).otherwise("")
        wide = F.concat(F.substring(digits, 1, 1), more, F.when(exponent < 0, "e-").otherwise("e+"), F.lpad(power, F.greatest(F.lit(2), F.length(power)), F.lit("0")))
        return F.concat(p["sign"], F.when(exponent.between(0, 15), whole).when(exponent.between(-4, -1), small).otherwise(wide))

    tries = [F.format_string(f"%.{n}e", x) for n in (14, 15, 16)]
    e = F.when(tries[0].cast("double") == x, tries[0]).when(tries[1].cast("double") == x, tries[1]).otherwise(tries[2])
    # Within an array's functions each part is worked out once, however often it is used.
    text = F.transform(F.transform(F.array(e), shown), laid_out)[0]
    return F.when(x == 0, F.when(x.cast("string").startswith("-"), "-0.0").otherwise("0.0")).otherwise(text)


def json_list(items: Column, one: Callable[[Column], Column] = json_text) -> Column:
    """An array as JSON text, each item by one; a null array is the empty one."""
    return F.concat(F.lit("["), F.coalesce(F.array_join(F.transform(items, one), ","), F.lit("")), F.lit("]"))


def content_hash_of(fields: dict[str, Column]) -> Column:
    """The hash of a flat object whose values are JSON text already; a null value is the JSON null."""
    parts = [F.concat(F.lit(json.dumps(k, ensure_ascii=False) + ":"), F.coalesce(fields[k], F.lit("null"))) for k in sorted(fields)]
    return sha256_of(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")))


def revision_identity(case: Column, revisions: Column) -> Column:
    """Of a case and an array of revision texts."""
    return content_hash_of({"case": json_text(case), "revisions": json_list(revisions)})


def context_fingerprint(context: Column) -> Column:
    return content_hash_of({"context": json_text(context)})


def source_hash(text: Column) -> Column:
    return content_hash_of({"source": json_text(text)})


def outcome_id(run: Column, evaluator: Column, version: Column) -> Column:
    """eval:run:evaluator:version of the stripped parts; an empty part raises an error."""
    from evalspark.functions.text import strip

    parts = [strip(x) for x in (run, evaluator, version)]
    empty = F.lit(False)
    for p in parts:
        empty = empty | F.coalesce(p == "", F.lit(True))
    return F.when(empty, F.raise_error(F.lit("an outcome id needs a run, an evaluator and a version"))).otherwise(F.concat_ws(":", F.lit("eval"), *parts))
