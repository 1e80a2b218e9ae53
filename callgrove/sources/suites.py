"""Rows of corpora and labelled sets as the operators want them: JSON members as text, an ordinal, one shape for all suites."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.jsonx import canonical, strict_loads
from .readers import numbered_lines

TOOLS = "array<struct<name:string,description:string,parameters:string>>"
EXAMPLE = f"id string, source string, language string, domain string, user_utterance string, available_tools {TOOLS}, should_call_tool boolean, expected_tool_name string, expected_arguments string, dialect string"


def _example(text: str, source: str) -> dict:
    row = strict_loads(text)
    tools = [{"name": t["name"], "description": t["description"], "parameters": canonical(t["parameters"])} for t in row["available_tools"]]
    arguments = row.get("expected_arguments")
    return {
        "id": row["id"], "source": source, "language": row.get("language", "ar"), "domain": row.get("category", row.get("domain")), "user_utterance": row["user_utterance"], "available_tools": tools,
        "should_call_tool": row.get("should_call_tool"), "expected_tool_name": row.get("expected_tool_name"), "expected_arguments": None if arguments is None else canonical(arguments), "dialect": row.get("dialect"),
    }


def labelled_examples(spark: SparkSession, path: str, source: str = "manual") -> DataFrame:
    """(ord, ...) of a JSONL file of labelled or generated rows, in file order."""

    @F.pandas_udf(EXAMPLE)
    def parse(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_example(t, source) for t in texts])

    return numbered_lines(spark, path).select((F.col("line") - 1).cast("long").alias("ord"), parse("value").alias("e")).select("ord", "e.*")


def prefix_of_each(suites: dict[str, DataFrame], limit: int | None, only: str = "all") -> dict[str, DataFrame]:
    """All suites or one, each cut to its first ``limit`` rows where given."""
    chosen = suites if only == "all" else {only: suites[only]}
    return {k: v if limit is None else v.where(F.col("ord") < limit) for k, v in chosen.items()}
