"""Validator of hand-labelled sets: rules on rows, a JSON-Schema subset, rules between rows, category quotas.

A line becomes columns first: its members with their kinds, its tools with what is wrong with them, its arguments held against the called tool's schema. All
rules are Catalyst conditions over these columns, numbered in the order in which they apply; violations come as rows (line, rule, message), and the least
(line, rule) is the first failure. Rules between rows are grouped minima joined back.
"""

from __future__ import annotations

import json
from datetime import date

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.jsonx import canonical, finite, loose, object_keys
from ..functions.rules import Rule, first_broken, schema_error, value_error
from ..functions.text import blank
from ..sources.readers import numbered_lines
from ..sources.store import scratch
from .records import example_rules

# Categories, dialects, statuses and rows per category of each mode, the words for a relative day (whole words), the Arabic blocks.
CATEGORIES = ("direct_request", "dialect_request", "code_switching", "orthographic_noise", "distractor_tools", "multi_argument", "argument_normalization", "missing_required_input", "out_of_scope", "prompt_injection")
NEGATIVE = ("missing_required_input", "out_of_scope", "prompt_injection")
DIALECTS = ("msa", "egyptian", "levantine", "gulf", "iraqi", "maghrebi")
STATUS = {"template": "illustrative_not_gold", "pilot": "pilot_draft_not_gold", "draft": "draft_not_gold", "final": "native_speaker_reviewed"}
QUOTA = {"template": 1, "pilot": 3, "draft": 10, "final": 10}
RELATIVE_DAY = r"(?<![\p{L}\p{N}_])(?:بكرة|بكرا|بكره|غداً|غدا|باجر|باچر)(?![\p{L}\p{N}_])"
ARABIC = r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}]"

#: Numbers of the rules that others refer to. A tool has two: its schema, then its constancy.
DATE_FIXED, SAME_UTTERANCE, TOOLS, EXAMPLE, SAME_ID, AFTER = 70, 110, 1300, 1_000_000, 1_000_100, 1_000_200



def _texts(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


_KINDS = {str: "string", bool: "boolean", int: "number", float: "number", type(None): "null", list: "array", dict: "object"}


@F.pandas_udf(T.StructType([T.StructField("error", T.StringType()), T.StructField("members", T.MapType(T.StringType(), _texts("kind", "value")))]))
def _line(texts: pd.Series) -> pd.DataFrame:
    """A line's members: strings as they are, other values as JSON text."""
    found = []
    for text in texts:
        try:
            row = json.loads(text)
            error = None if isinstance(row, dict) else "row must be an object"
        except ValueError as problem:
            row, error = None, str(problem)
        members = {} if error else {k: {"kind": _KINDS[type(v)], "value": v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)} for k, v in row.items()}
        found.append({"error": error, "members": members})
    return pd.DataFrame(found, columns=["error", "members"])


@F.pandas_udf(T.StringType())
def _date_problem(texts: pd.Series) -> pd.Series:
    """Why a text is no ISO date; null if it is one."""

    def problem(text):
        try:
            date.fromisoformat(text)
        except (TypeError, ValueError) as error:
            return str(error)
        return None

    return texts.map(problem)


def _said(member: str):
    return Rule(lambda t: isinstance(t[member], str) and t[member].strip() != "", f"{member} must be a non-empty string")


TOOL_RULES = (
    Rule(lambda t: isinstance(t, dict) and set(t) == {"name", "description", "parameters"}, "tool needs name, description and parameters"),
    _said("name"),
    _said("description"),
    Rule(lambda t: isinstance(t["parameters"], dict), "parameters must be an object"),
    Rule(lambda t: finite(t["parameters"]), "parameters must contain only valid JSON values"),
    Rule(lambda t: t["parameters"].get("type") == "object", "parameters.type must be 'object'"),
    Rule(lambda t: isinstance(t["parameters"].get("properties"), dict), "parameters.properties must be an object"),
)


@F.pandas_udf(T.ArrayType(_texts("name", "description", "parameters", "definition", "shape", "schema")))
def _tools(texts: pd.Series) -> pd.Series:
    """The tools of a JSON list, with what is wrong with their shape and schema; null for what is no list."""

    def tool(value) -> dict:
        out = dict.fromkeys(("name", "description", "parameters", "definition", "shape", "schema"))
        out["shape"] = first_broken(value, TOOL_RULES, lambda _: ())
        if out["shape"] is None:
            out |= {"name": value["name"], "description": value["description"], "parameters": canonical(value["parameters"]), "definition": loose(value), "schema": schema_error(value["parameters"])}
        return out

    return texts.map(lambda t: [tool(x) for x in json.loads(t)] if isinstance(t, str) else None)


@F.pandas_udf(T.StringType())
def _misfit(arguments: pd.Series, parameters: pd.Series) -> pd.Series:
    """Why arguments don't fit a sound schema; null if they do, or if either is missing."""
    return pd.Series([value_error(json.loads(a), json.loads(p), "expected_arguments") if isinstance(a, str) and isinstance(p, str) else None for a, p in zip(arguments, parameters, strict=True)], dtype=object)


def _columns(lines: DataFrame) -> DataFrame:
    """A line's members as the columns that the rules speak of."""
    rows = lines.select("line", _line("value").alias("l")).select("line", "l.error", F.col("l.members").alias("m"))
    kind, value = lambda n: F.col("m")[n]["kind"], lambda n: F.col("m")[n]["value"]
    text = lambda n: F.when(kind(n) == "string", value(n))
    rows = rows.withColumns({n: text(n) for n in ("id", "category", "dialect", "review_status", "user_utterance", "reference_date")})
    rows = rows.withColumn("tools", _tools(F.when(kind("available_tools") == "array", value("available_tools"))))
    sound = F.coalesce(F.forall("tools", lambda t: t["shape"].isNull() & t["schema"].isNull()), F.lit(False))
    rows = rows.withColumns(
        {
            "available_tools": F.when(sound, F.transform("tools", lambda t: F.struct(t["name"], t["description"], t["parameters"]))),
            "should_call_tool": F.when(kind("should_call_tool") == "boolean", value("should_call_tool").cast("boolean")),
            # of another kind: a text that no tool has, so that it neither fits nor counts as missing
            "expected_tool_name": F.when(kind("expected_tool_name") == "string", value("expected_tool_name")).when(kind("expected_tool_name") != "null", F.lit("")),
            "expected_arguments": F.when(kind("expected_arguments") == "string", F.to_json(F.array(value("expected_arguments")))).when(kind("expected_arguments") != "null", value("expected_arguments")),
            "source": F.lit("labelled"),
            "language": F.lit("ar"),
            "domain": F.col("category"),
            "tags": F.array().cast("array<string>"),
        }
    )
    called = F.filter("available_tools", lambda t: t["name"] == F.col("expected_tool_name"))
    rows = rows.withColumn("called", F.when(F.col("should_call_tool") & (kind("expected_arguments") == "object"), F.try_element_at(called, F.lit(1))["parameters"]))
    return rows.withColumn("misfit", _misfit("expected_arguments", "called")).withColumn("date_problem", _date_problem("reference_date"))


def row_rules(mode: str) -> list[tuple[int, Column | str, Column]]:
    """(rule, message, broken) of a row's own rules, but for its tools'."""
    strict, c = mode != "template", F.col
    has = lambda n: F.array_contains(F.map_keys("m"), n)
    raw = lambda n: F.col("m")[n]["value"]
    names = {20: "category", 30: "dialect", 40: "review_status", 100: "user_utterance", 200: "available_tools"} | ({60: "reference_date"} if strict else {})
    late = ("id", "should_call_tool", "expected_tool_name", "expected_arguments")
    rules = [(10, c("error"), c("error").isNotNull())]
    rules += [(n, f"'{name}'", ~has(name)) for n, name in names.items()] + [(EXAMPLE + k, f"'{name}'", ~has(name)) for k, name in enumerate(late)]
    rules += [
        (21, F.concat(F.lit("unknown category: "), raw("category")), ~c("category").isin(*CATEGORIES) | c("category").isNull()),
        (31, F.concat(F.lit("unknown dialect: "), raw("dialect")), ~c("dialect").isin(*DIALECTS) | c("dialect").isNull()),
        (41, f"review_status must be {STATUS[mode]}", ~c("review_status").eqNullSafe(STATUS[mode])),
        (50, "language must be ar", (F.lit(strict) | has("language")) & ~raw("language").eqNullSafe("ar")),
        (80, "final cases cannot retain review_note", F.lit(mode == "final") & has("review_note")),
        (90, "review_note must be non-empty text", has("review_note") & (~c("m")["review_note"]["kind"].eqNullSafe("string") | blank(raw("review_note")))),
        (101, "user_utterance must contain Arabic text", ~F.coalesce(c("user_utterance").rlike(ARABIC), F.lit(False))),
        (201, "available_tools must be a list", c("tools").isNull()),
        (202, F.element_at(F.filter(F.transform("tools", lambda t: t["shape"]), lambda s: s.isNotNull()), 1), F.exists("tools", lambda t: t["shape"].isNotNull())),
    ]
    if strict:
        rules += [
            (61, F.coalesce("date_problem", F.lit("reference_date must be a date")), c("reference_date").isNull() | c("date_problem").isNotNull()),
            (120, "relative-date utterance must include reference_date", c("user_utterance").rlike(RELATIVE_DAY) & ~F.contains("user_utterance", "reference_date")),
        ]
    rules += [(EXAMPLE + 10 + k, message, broken) for k, (message, broken) in enumerate(example_rules())]
    keys, parameters = object_keys(c("expected_arguments")), c("called")
    required = F.coalesce(F.from_json(F.get_json_object(parameters, "$.required"), "array<string>"), F.array().cast("array<string>"))
    rules += [
        (AFTER, F.concat(F.lit("inconsistent positive/negative category: "), "category"), c("should_call_tool") == c("category").isin(*NEGATIVE)),
        (AFTER + 10, "positive case needs competing available tools", F.lit(strict) & c("should_call_tool") & (F.size("available_tools") < 2)),
        (AFTER + 20, "expected argument keys are not permitted by tool", parameters.isNotNull() & (F.size(F.array_except(keys, object_keys(F.get_json_object(parameters, "$.properties")))) > 0)),
        (AFTER + 30, "expected arguments omit required tool keys", parameters.isNotNull() & (F.size(F.array_except(required, keys)) > 0)),
        (AFTER + 40, c("misfit"), c("misfit").isNotNull()),
    ]
    return rules


def checked_rows(spark: SparkSession, path: str, mode: str = "template") -> DataFrame:
    """(line, rule, message, id, utterance, reference_date, category, tools): each row with its own first failure (null: none). Blank ids and bad dates are null."""
    if mode not in STATUS:
        raise ValueError(f"choose one validation mode of {tuple(STATUS)}")
    rows = _columns(numbered_lines(spark, path))
    as_column = lambda message: message if isinstance(message, Column) else F.lit(message)
    broken = [F.when(F.coalesce(condition, F.lit(False)), F.struct(F.lit(n).alias("rule"), as_column(message).alias("message"))) for n, message, condition in row_rules(mode)]
    schemas = F.transform("tools", lambda t, at: F.when(t["schema"].isNotNull(), F.struct((TOOLS + 2 * at).cast("int").alias("rule"), t["schema"].alias("message"))))
    found = F.array_min(F.filter(F.concat(F.array(*broken), F.coalesce(schemas, F.array().cast("array<struct<rule:int,message:string>>"))), lambda v: v.isNotNull()))
    rows = rows.withColumn("found", found)
    return rows.select("line", "found.rule", "found.message", F.when(~blank(F.col("id")), F.col("id")).alias("id"), F.col("user_utterance").alias("utterance"), F.when(F.col("date_problem").isNull(), F.col("reference_date")).alias("reference_date"), "category", F.transform("tools", lambda t: F.struct(t["name"].alias("name"), t["definition"].alias("definition"))).alias("tools"))


def between_rows(rows: DataFrame, mode: str = "final") -> DataFrame:
    """(line, rule, message) of rules between rows: against the first row that has the same id, utterance or tool, and (but for templates) the first date."""
    found = []
    for column, rule, message in (("utterance", SAME_UTTERANCE, F.lit("duplicate user_utterance")), ("id", SAME_ID, F.concat(F.lit("duplicate ID: "), F.col("id")))):
        first = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.min("line").alias("first"))
        found.append(rows.join(first, column).where("line > first").select("line", F.lit(rule).alias("rule"), message.alias("message")))
    if mode != "template":
        dated = rows.where("reference_date IS NOT NULL")
        first = dated.agg(F.min_by("reference_date", "line").alias("first"))  # one row
        found.append(dated.crossJoin(F.broadcast(first)).where("reference_date <> first").select("line", F.lit(DATE_FIXED).alias("rule"), F.lit("reference_date must be fixed across set").alias("message")))
    tools = rows.select("line", F.posexplode("tools").alias("at", "t")).select("line", "at", "t.name", "t.definition").where("definition IS NOT NULL")
    first = tools.groupBy("name").agg(F.min_by("definition", F.struct("line", "at")).alias("first"))
    found.append(tools.join(first, "name").where("definition <> first").select("line", (TOOLS + 2 * F.col("at") + 1).alias("rule"), F.concat(F.lit("tool definition changed: "), F.col("name")).alias("message")))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def violations(spark: SparkSession, path: str, mode: str = "template", rows: DataFrame | None = None) -> DataFrame:
    """(line, rule, message) of all lines' failures: each row's own first one, and all between rows."""
    rows = staged(checked_rows(spark, path, mode)) if rows is None else rows
    return rows.where("rule IS NOT NULL").select("line", "rule", "message").union(between_rows(rows, mode))


def staged(rows: DataFrame) -> DataFrame:
    """Written to the shared folder and read again: what several rules read is made once."""
    where = scratch(rows.sparkSession, "labelled").path("rows")
    rows.write.parquet(where)
    return rows.sparkSession.read.schema(rows.schema).parquet(where)


def category_quota(rows: DataFrame, categories: DataFrame, expected: int, key: str = "category") -> DataFrame:
    """(category, rows, ok): every category of the dimension, zero ones too."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    return categories.join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("rows"), (F.coalesce("n", F.lit(0)) == expected).alias("ok"))


def validate(spark: SparkSession, path: str, mode: str = "template") -> dict[str, int]:
    """Rows per category, or ValueError with the first failure. The file is parsed once."""
    rows = staged(checked_rows(spark, path, mode))
    if first := violations(spark, path, mode, rows).orderBy("line", "rule").limit(1).collect():
        raise ValueError(f"line {first[0].line}: {first[0].message}")
    dimension = spark.createDataFrame([(c,) for c in CATEGORIES], "category string")
    found = {r.category: r for r in category_quota(rows, dimension, QUOTA[mode]).collect()}
    if wrong := {c: found[c].rows for c in CATEGORIES if not found[c].ok}:
        raise ValueError(f"expected {QUOTA[mode]} per category, got {wrong}")
    return {c: found[c].rows for c in CATEGORIES}
