"""Record rules: for each kind of record the violations as rows, and enforcement that raises the first."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.jsonx import finite, strict_loads
from ..functions.text import blank


@F.pandas_udf(T.StringType())
def json_kind(texts: pd.Series) -> pd.Series:
    """object, array, string, number, boolean or null of a strict JSON text with finite numbers; ``invalid`` else; null for null."""

    def one(text):
        if not isinstance(text, str):
            return None
        try:
            value = strict_loads(text)
        except (ValueError, RecursionError):
            return "invalid"
        if not finite(value):
            return "invalid"
        return {dict: "object", list: "array", str: "string", bool: "boolean", int: "number", float: "number", type(None): "null"}[type(value)]

    return texts.map(one)


def text_rule(name: str, field: str | None = None) -> tuple[str, Column]:
    return f"{field or name} must be a non-empty string", blank(F.col(name))


def tool_rules() -> list[tuple[str, Column]]:
    """For rows (name, description, parameters as JSON text)."""
    kind = json_kind("parameters")
    return [
        text_rule("name"),
        text_rule("description"),
        ("parameters must contain only valid JSON values", F.coalesce(kind == "invalid", F.lit(False))),
        ("parameters must be an object", F.coalesce(kind != "object", F.lit(True))),
        ("parameters.type must be 'object'", F.coalesce(F.get_json_object("parameters", "$.type") != "object", F.lit(True))),
        ("parameters.properties must be an object", F.coalesce(F.substring(F.get_json_object("parameters", "$.properties"), 1, 1) != "{", F.lit(True))),
    ]


def example_rules() -> list[tuple[str, Column]]:
    names = F.transform("available_tools", lambda t: t["name"])
    should = F.coalesce("should_call_tool", F.lit(False))
    none = F.col("expected_tool_name").isNull() & F.col("expected_arguments").isNull()
    tags, arguments = F.coalesce("tags", F.array().cast("array<string>")), json_kind("expected_arguments")
    return [
        *[text_rule(c) for c in ("id", "source", "language", "domain", "user_utterance")],
        ("dialect must be a non-empty string", F.col("dialect").isNotNull() & blank(F.col("dialect"))),
        ("available_tools must be a non-empty tuple", F.coalesce(F.size("available_tools") <= 0, F.lit(True))),
        ("available tool names must be unique", F.coalesce(F.size(F.array_distinct(names)) < F.size(names), F.lit(False))),
        ("should_call_tool must be a boolean", F.col("should_call_tool").isNull()),
        ("tool_name must be a non-empty string", should & blank(F.col("expected_tool_name"))),
        ("arguments must contain only valid JSON values", should & F.coalesce(arguments == "invalid", F.lit(False))),
        ("arguments must be an object", should & F.coalesce(arguments != "object", F.lit(True))),
        ("expected tool must be present in available_tools", should & ~F.coalesce(F.array_contains(names, F.col("expected_tool_name")), F.lit(False))),
        ("negative examples cannot include an expected tool call", ~should & ~none),
        ("tag must be a non-empty string", F.exists(tags, lambda t: blank(t))),
        ("tags must be unique", F.size(F.array_distinct(tags)) < F.size(tags)),
    ]


def _amount(name: str) -> tuple[str, Column]:
    c = F.col(name)
    return f"{name} must be a finite non-negative number", F.coalesce((c < 0) | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(False))


def prediction_rules() -> list[tuple[str, Column]]:
    return [
        *[text_rule(c) for c in ("example_id", "model_id", "model_revision", "prompt_version")],
        ("generated_text must be a string", F.col("generated_text").isNull()),
        ("generation_config must be an object", F.coalesce(json_kind("generation_config") != "object", F.lit(True))),
        ("latency_seconds must be a finite non-negative number", F.col("latency_seconds").isNull()),
        _amount("latency_seconds"),
        _amount("gpu_memory_mb"),
    ]


def result_rules() -> list[tuple[str, Column]]:
    exact = F.coalesce("exact_match", F.lit(False))
    return [
        text_rule("example_id"),
        ("result and prediction example IDs must match", ~F.col("example_id").eqNullSafe(F.col("prediction_example_id"))),
        ("tool_selection_correct must be a boolean", F.col("tool_selection_correct").isNull()),
        ("exact_match must be a boolean", F.col("exact_match").isNull()),
        ("exact_match needs a correct tool and no wrong arguments", exact & (~F.coalesce("tool_selection_correct", F.lit(False)) | ~F.coalesce("arguments_correct", F.lit(True)))),
    ]


def violations(rows: DataFrame, rules: list[tuple[str | Column, Column]], *keys: str) -> DataFrame:
    """(keys, rule, message): a row for each rule that a row breaks; rule is its place in the list."""
    marked = rows.select(*keys, F.array(*[F.when(broken, F.struct(F.lit(i).alias("rule"), (message if isinstance(message, Column) else F.lit(message)).alias("message"))) for i, (message, broken) in enumerate(rules)]).alias("v"))
    return marked.select(*keys, F.explode(F.filter("v", lambda x: x.isNotNull())).alias("v")).select(*keys, "v.rule", "v.message")


def enforce(rows: DataFrame, rules: list[tuple[str, Column]], order: str) -> DataFrame:
    """``rows``, or ValueError with the first violation by order and rule."""
    if first := violations(rows, rules, order).orderBy(order, "rule").limit(1).collect():
        raise ValueError(first[0].message)
    return rows
