"""Strict JSON in Arrow-batched functions: response parsing and three normal forms for comparing values.

Three equalities exist side by side and must not be mixed:

* ``scoring_form``: numbers by decimal value (3 = 3.0), booleans apart from numbers, objects without order. For scoring.
* ``canonical_form``: textual, compact, sorted keys (25 and 25.0 differ). For leakage targets and tool schemas.
* ``loose_form``: as Python's ``==`` (true = 1 = 1.0). For alternatives, enums and constant definitions.

Each gives a string, so that comparing, joining and grouping stay in Catalyst.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from decimal import Context, Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WIDE = Context(prec=5000, Emax=10**9, Emin=-(10**9))


def _unique(pairs: list) -> dict:
    found: dict = {}
    for key, value in pairs:
        if key in found:
            raise ValueError(f"duplicate JSON key: {key}")
        found[key] = value
    return found


def _no_constant(name: str):
    raise ValueError(f"invalid JSON constant: {name}")


def strict_loads(text: str):
    """One JSON value and nothing else; repeated keys, NaN and infinities are errors."""
    return json.loads(text, object_pairs_hook=_unique, parse_constant=_no_constant)


def canonical(value) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def _form(value, number: Callable) -> str:
    if isinstance(value, bool | int | float):
        return number(value)
    if value is None:
        return "null"
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, list):
        return "[" + ",".join(_form(x, number) for x in value) + "]"
    return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_form(value[k], number)}" for k in sorted(value)) + "}"


def _decimal(value) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float) and not math.isfinite(value):
        return str(value)
    number = _WIDE.normalize(Decimal(str(value)))
    return str(number) if number else "0"


def _python_number(value) -> str:
    if isinstance(value, float) and not value.is_integer():
        return repr(value)
    return str(int(value))


def scoring(value) -> str:
    return _form(value, _decimal)


def loose(value) -> str:
    return _form(value, _python_number)


def finite(value) -> bool:
    """Are all numbers in it finite?"""
    if isinstance(value, float):
        return math.isfinite(value)
    if isinstance(value, list):
        return all(map(finite, value))
    return all(map(finite, value.values())) if isinstance(value, dict) else True


RESPONSE = T.StructType(
    [
        T.StructField("parse_success", T.BooleanType()),
        T.StructField("valid", T.BooleanType()),
        T.StructField("is_call", T.BooleanType()),
        T.StructField("tool_name", T.StringType()),
        T.StructField("arguments", T.StringType()),
        T.StructField("args_form", T.StringType()),
        T.StructField("arg_keys", T.ArrayType(T.StringType())),
        T.StructField("parse_error", T.StringType()),
    ]
)
#: ``json``: the text is one JSON value. ``tagged``: also a call block between tags, or plain prose as no call.
FORMATS = ("json", "tagged")

# The tags of a native call block and the characters with which prose can't start.
OPEN, CLOSE = "<tool_call>", "</tool_call>"
NOT_PROSE = '{["`<'


def _block(text: str) -> str:
    """What stands between the tags of a text's only call block."""
    opened, closed = OPEN[:-1], CLOSE[:-1]
    if text.count(opened) != 1 or text.count(closed) != 1 or OPEN not in text or CLOSE not in text:
        raise ValueError("expected one complete native tool-call block")
    start, end = text.index(OPEN), text.index(CLOSE)
    if end < start:
        raise ValueError("invalid native tool-call marker order")
    return text[start + len(OPEN) : end]


def parse_response(text: str | None, output_format: str) -> dict:
    """A model's raw response as a call, a refusal (JSON null, or prose where tagged), or an error."""
    out = {"parse_success": False, "valid": False, "is_call": False, "tool_name": None, "arguments": None, "args_form": None, "arg_keys": [], "parse_error": None}
    text = text.strip() if isinstance(text, str) else ""
    tagged = output_format == "tagged" and (OPEN[:-1] in text or CLOSE[:-1] in text)
    try:
        try:
            value = strict_loads(_block(text) if tagged else text)
        except json.JSONDecodeError:
            if output_format == "tagged" and not tagged and text and text[0] not in NOT_PROSE:
                return out | {"valid": True}
            raise
        if tagged and not isinstance(value, dict):
            raise ValueError("native tool-call block must contain a call object")
        out["parse_success"] = True
        if value is None:
            return out | {"valid": True}
        shaped = isinstance(value, dict) and set(value) == {"name", "arguments"} and isinstance(value["name"], str) and value["name"].strip() and isinstance(value["arguments"], dict)
        if not shaped:
            return out | {"parse_error": "invalid structured output"}
        if not finite(value["arguments"]):
            raise ValueError("arguments must contain only valid JSON values")
        return out | {"valid": True, "is_call": True, "tool_name": value["name"], "arguments": canonical(value["arguments"]), "args_form": scoring(value["arguments"]), "arg_keys": sorted(value["arguments"])}
    except (ValueError, RecursionError) as error:
        return out | {"parse_error": str(error)}


def response(text: Column, output_format: str = "json") -> Column:
    """``RESPONSE`` of each text."""
    if output_format not in FORMATS:
        raise ValueError(f"output_format must be one of {FORMATS}")

    @F.pandas_udf(RESPONSE)
    def parse(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_response(t, output_format) for t in texts], columns=RESPONSE.names)

    return parse(text)


def _text_function(make: Callable) -> Callable[[Column], Column]:
    def apply(column: Column) -> Column:
        @F.pandas_udf("string")
        def run(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: make(strict_loads(t)) if isinstance(t, str) else None)

        return run(column)

    return apply


canonical_form = _text_function(canonical)
scoring_form = _text_function(scoring)
loose_form = _text_function(loose)


def object_keys(column: Column) -> Column:
    """Top-level keys of JSON objects, sorted; empty for null."""
    return F.array_sort(F.coalesce(F.json_object_keys(column), F.array().cast("array<string>")))


@F.pandas_udf(T.MapType(T.StringType(), T.ArrayType(T.StringType())))
def alternatives(texts: pd.Series) -> pd.Series:
    """JSON object of lists as a map of loose forms; null where it is something else."""

    def one(text):
        value = strict_loads(text) if isinstance(text, str) else None
        if not isinstance(value, dict) or not all(isinstance(x, list) for x in value.values()):
            return None
        return {k: [loose(x) for x in v] for k, v in value.items()}

    return texts.map(one)


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def loose_members(texts: pd.Series) -> pd.Series:
    """A JSON object's members as loose forms; empty for null."""
    return texts.map(lambda t: {k: loose(v) for k, v in (strict_loads(t) or {}).items()} if isinstance(t, str) else {})
