"""Queries over files and records made from the driver's tables: loaders, the validator, parser cases, resume, formats. Each has SQL that tells the rows without them."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.jsonx import response
from ..functions.text import token_lengths
from ..operators import corpus, labelled, metrics, ordinals, records, runs
from ..sources import benchmarks, suites
from ..sources.commits import CommitLog
from ..sources.ordered import part_paths, write_ordered
from ..sources.readers import digests, document_items, jsonl, numbered_lines, table
from ..sources.store import Store, scratch
from .design import table_design

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[function.__name__], SQL[function.__name__] = function, sql
        return function

    return add


def in_order(store: Store, name: str, rows: DataFrame, order: str) -> str:
    """(order, value) as lines of a folder of text files, whose names follow the order."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.select(order, "value").repartitionByRange(tasks, order).sortWithinPartitions(order).select("value").write.text(store.path(name))
    return store.path(name)


def in_brackets(rows: DataFrame, key: str, item: Column, opens: str, closes: str) -> DataFrame:
    """(key, value): items with what stands between them; the first and the last one carry the brackets."""
    ends = rows.agg(F.min(key).alias("a"), F.max(key).alias("b")).first()
    return rows.select(key, F.concat(F.when(F.col(key) == ends.a, opens).otherwise(""), item, F.when(F.col(key) == ends.b, closes).otherwise(",")).alias("value"))


def text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# ---------------------------------------------------------------- readers


@query("SELECT event_id, event_type FROM events")
def jsonl_rows(spark, sf_dir):
    """JSON lines with blank ones between."""
    lines = table(spark, sf_dir, "events").select(F.explode(F.array(F.to_json(F.struct("event_id", "event_type")), F.lit(" "))).alias("value"))
    store = scratch(spark, "lines")
    lines.write.text(store.path("events"))
    return jsonl(spark, store.path("events"), "event_id long, event_type string")


@query("SELECT 3 * (row_number() OVER (ORDER BY c_custkey) - 1) + 2 AS line, c_name AS value FROM customer")
def numbered_rows(spark, sf_dir):
    """Lines keep their numbers: one blank before and one after each."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("\n"), "c_name", F.lit("\r\n")).alias("value"))
    return numbered_lines(spark, in_order(scratch(spark, "lines"), "customers", rows, "c_custkey"))


def _grouped_document(store: Store, rows: DataFrame, group: str, key: str, item: Column) -> str:
    """One JSON object of lists, in as many files as there are partitions; rows with the same group stand in its list."""
    ends = rows.groupBy(group).agg(F.min(key).alias("a"), F.max(key).alias("b"))
    names = ends.agg(F.min(group).alias("a"), F.max(group).alias("b")).first()
    head = text(F.when(F.col(group) == names.a, "{").otherwise(""), '"', F.col(group), '":[')
    tail = F.when(F.col(group) == names.b, "]}").otherwise("],")
    value = F.concat(F.when(F.col(key) == F.col("a"), head).otherwise(""), item, F.when(F.col(key) == F.col("b"), tail).otherwise(","))
    return in_order(store, "tools.json", rows.join(ends, group).select(F.struct(group, key).alias("at"), value.alias("value")), "at")


def _tools_document(store: Store, nations: DataFrame) -> str:
    """The nations of each region as tools."""
    tool = text('{"name":"', F.col("n_name"), '","description":"d","parameters":{"type":"object","properties":{"k":{"type":"integer"}}}}')
    return _grouped_document(store, nations.select("n_regionkey", "n_nationkey", "n_name"), "n_regionkey", "n_nationkey", tool)


@query("SELECT CAST(row_number() OVER (ORDER BY c_nationkey, c_custkey) - 1 AS INT) AS ord, c_name AS name FROM customer")
def grouped_document(spark, sf_dir):
    """A document with the customers of each nation in a list, braces and quotes in their texts."""
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_name")
    item = F.to_json(F.struct(F.col("c_name").alias("name"), F.lit('a "}", [{').alias("note"), F.struct(F.col("c_custkey").alias("k")).alias("inner")))
    path = _grouped_document(scratch(spark, "document"), rows, "c_nationkey", "c_custkey", item)
    return document_items(spark, path).select("ord", F.get_json_object("item", "$.name").alias("name"))


@query("""WITH c AS (SELECT c_custkey, c_nationkey, c_custkey % 5 = 0 AS neg, row_number() OVER (ORDER BY c_custkey) - 1 AS ord, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)
SELECT CAST(ord AS INT) AS ord, 'q' || c_nationkey || CASE WHEN n > 1 THEN '::row-' || ord ELSE '' END AS id, 'NATION_' || (c_nationkey + 1) % 25 || '|NATION_' || c_nationkey AS tools, NOT neg AS should_call_tool,
CASE WHEN NOT neg THEN 'NATION_' || c_nationkey END AS expected_tool_name, CASE WHEN NOT neg THEN '{"k":' || c_custkey || '}' END AS expected_arguments FROM c""")
def loaded_examples(spark, sf_dir):
    """Customers as examples whose two tools are looked up by name, in order; ids repeat by nation and are repaired."""
    store, c, n = scratch(spark, "examples"), table(spark, sf_dir, "customer"), F.col("c_nationkey")
    negative = F.col("c_custkey") % 5 == 0
    call = F.when(negative, F.lit('"expected_function":null,"expected_arguments":null')).otherwise(text('"expected_function":"NATION_', n, '","expected_arguments":{ "k" : ', F.col("c_custkey"), "}"))
    item = text('{"id":"q', n, '","domain":"d","utterance":"u","is_negative":', negative, ",", call, ',"available_tools":["NATION_', (n + 1) % 25, '","NATION_', n, '"]}')
    examples = in_order(store, "examples.json", in_brackets(c, "c_custkey", item, "[", "]"), "c_custkey")
    rows = benchmarks.load_tool_examples(spark, examples, _tools_document(store, table(spark, sf_dir, "nation")), revision="r")
    return rows.select("ord", "id", F.array_join(F.col("available_tools.name"), "|").alias("tools"), "should_call_tool", "expected_tool_name", "expected_arguments")


@query("""WITH q AS (SELECT 0 AS part, c_custkey AS k, 'simple_python' AS domain, 's_' || c_custkey AS id FROM customer UNION ALL SELECT 1, n_nationkey, 'multiple', 'm_' || n_nationkey FROM nation),
o AS (SELECT *, row_number() OVER (ORDER BY part, k) - 1 AS ord FROM q)
SELECT CAST(ord AS INT) AS ord, id, domain, 'ask ' || k AS user_utterance, 'f.g' AS expected_tool_name, '{"k":' || k || '}' AS expected_arguments, 'object' AS kind, 'dict' AS inner_kind FROM o WHERE ord < (SELECT count(*) FROM q) - 5""")
def loaded_alternatives(spark, sf_dir):
    """Customers and nations as questions in two files, all but the last five; the first alternative represents, an empty one is left out."""
    store, total = scratch(spark, "questions"), 0
    for category, name, key, letter in (("simple_python", "customer", "c_custkey", "s"), ("multiple", "nation", "n_nationkey", "m")):
        rows, k = table(spark, sf_dir, name), F.col(key)
        total += rows.count()
        ident = text('{"id":"', F.lit(letter), "_", k, '",')
        ask = text(ident, '"question":[[{"role":"user","content":"ask ', k, '"}]],"function":[{"name":"f.g","description":"d","parameters":{"type":"dict","properties":{"k":{"type":"dict"}}}}]}')
        answer = text(ident, '"ground_truth":[{"f.g":{"k":[', k, ',"x"],"z":["",1]}}]}')
        in_order(store, f"BFCL_v4_{category}.json", rows.select(key, ask.alias("value")), key)
        in_order(store, f"possible_answer/BFCL_v4_{category}.json", rows.select(key, answer.alias("value")), key)
    out = benchmarks.load_alternatives(spark, store.base, revision="r", limit=total - 5)
    parameters = F.col("available_tools")[0]["parameters"]
    return out.select("ord", "id", "domain", "user_utterance", "expected_tool_name", "expected_arguments", F.get_json_object(parameters, "$.type").alias("kind"), F.get_json_object(parameters, "$.properties.k.type").alias("inner_kind"))


# ---------------------------------------------------------------- the validator

_TOOL = {"name": "book", "description": "d", "parameters": {"type": "object", "properties": {"place": {"type": "string", "enum": ["north", "south"]}, "seats": {"type": "integer", "minimum": 2}, "when": {"type": "string", "format": "date"}}, "required": ["place"], "additionalProperties": False}}
_OTHER = _TOOL | {"name": "cancel"}
_SOUND = {"category": "code_switching", "dialect": "msa", "review_status": "native_speaker_reviewed", "language": "ar", "reference_date": "2027-03-04", "available_tools": [_TOOL, _OTHER], "should_call_tool": True, "expected_tool_name": "book", "expected_arguments": {"place": "north"}}
_GONE = object()
#: For each line by its number's rest: what is changed, the rule it breaks and that rule's message. Rest 0 and those beyond the list are sound.
_CHANGES: list[tuple[dict, int, str]] = [
    ({"category": _GONE}, 20, "'category'"),
    ({"category": "sports"}, 21, "unknown category: sports"),
    ({"dialect": "norse"}, 31, "unknown dialect: norse"),
    ({"review_status": "draft_not_gold"}, 41, "review_status must be native_speaker_reviewed"),
    ({"language": _GONE}, 50, "language must be ar"),
    ({"reference_date": "soon"}, 61, "Invalid isoformat string: 'soon'"),
    ({"reference_date": "2027-03-05"}, labelled.DATE_FIXED, "reference_date must be fixed across set"),
    ({"review_note": "seen"}, 80, "final cases cannot retain review_note"),
    ({"user_utterance": "latin {n}"}, 101, "user_utterance must contain Arabic text"),
    ({"user_utterance": "نص 0"}, labelled.SAME_UTTERANCE, "duplicate user_utterance"),
    ({"user_utterance": "غدا {n}"}, 120, "relative-date utterance must include reference_date"),
    ({"available_tools": {}}, 201, "available_tools must be a list"),
    ({"available_tools": [{"name": "x"}]}, 202, "tool needs name, description and parameters"),
    ({"available_tools": [_TOOL | {"name": "open", "parameters": _TOOL["parameters"] | {"additionalProperties": True}}]}, labelled.TOOLS, "object schema must forbid additionalProperties"),
    ({"available_tools": [_TOOL, _OTHER | {"description": "new"}]}, labelled.TOOLS + 3, "tool definition changed: cancel"),
    ({"id": _GONE}, labelled.EXAMPLE, "'id'"),
    ({"id": " "}, labelled.EXAMPLE + 10, "id must be a non-empty string"),
    ({"available_tools": []}, labelled.EXAMPLE + 16, "available_tools must be a non-empty tuple"),
    ({"available_tools": [_TOOL, _TOOL]}, labelled.EXAMPLE + 17, "available tool names must be unique"),
    ({"should_call_tool": "yes"}, labelled.EXAMPLE + 18, "should_call_tool must be a boolean"),
    ({"expected_arguments": []}, labelled.EXAMPLE + 21, "arguments must be an object"),
    ({"expected_tool_name": "cook"}, labelled.EXAMPLE + 22, "expected tool must be present in available_tools"),
    ({"should_call_tool": False}, labelled.EXAMPLE + 23, "negative examples cannot include an expected tool call"),
    ({"id": "c0"}, labelled.SAME_ID, "duplicate ID: c0"),
    ({"category": "out_of_scope"}, labelled.AFTER, "inconsistent positive/negative category: out_of_scope"),
    ({"available_tools": [_TOOL]}, labelled.AFTER + 10, "positive case needs competing available tools"),
    ({"expected_arguments": {"place": "north", "colour": 1}}, labelled.AFTER + 20, "expected argument keys are not permitted by tool"),
    ({"expected_arguments": {"seats": 2}}, labelled.AFTER + 30, "expected arguments omit required tool keys"),
    ({"expected_arguments": {"place": "west"}}, labelled.AFTER + 40, "expected_arguments.place violates tool schema"),
    ({"expected_arguments": {"place": "south", "seats": 1}}, labelled.AFTER + 40, "expected_arguments.seats is below schema minimum"),
    ({"expected_arguments": {"place": "south", "when": "20270304"}}, labelled.AFTER + 40, "expected_arguments.when must use YYYY-MM-DD"),
]
_REST = len(_CHANGES) + 3
_BROKEN_SQL = ", ".join("({}, {}, '{}')".format(k + 1, rule, message.replace("'", "''")) for k, (_, rule, message) in enumerate(_CHANGES))


def _labelled_lines(customers: DataFrame) -> DataFrame:
    """A labelled set: a line for each customer, changed by its number's rest."""
    n = F.col("c_custkey")
    line = None
    for k, change in enumerate([{}, *(c for c, _, _ in _CHANGES)]):
        row = {x: v for x, v in ({"id": "c{n}", "user_utterance": "نص {n}"} | _SOUND | change).items() if v is not _GONE}
        made = F.replace(F.lit(json.dumps(row, ensure_ascii=False)), F.lit("{n}"), n.cast("string"))
        line = F.when(n % _REST == k, made) if line is None else line.when(n % _REST == k, made)
    sound = F.replace(F.lit(json.dumps({"id": "c{n}", "user_utterance": "نص {n}"} | _SOUND, ensure_ascii=False)), F.lit("{n}"), n.cast("string"))
    return customers.select("c_custkey", line.otherwise(sound).alias("value"))


@query(f"SELECT c_custkey + 1 AS line, rule, message FROM customer JOIN (VALUES {_BROKEN_SQL}) v(k, rule, message) ON c_custkey % {_REST} = k")
def labelled_violations(spark, sf_dir):
    """A set in which each line breaks one rule of the final mode, or none."""
    path = in_order(scratch(spark, "labelled"), "set.jsonl", _labelled_lines(table(spark, sf_dir, "customer")), "c_custkey")
    return labelled.violations(spark, path, "final")


@query("SELECT n_nationkey AS ord, 'c' || n_nationkey AS id, 'code_switching' AS domain, 'book|cancel' AS tools, '{\"place\":\"north\"}' AS expected_arguments FROM nation")
def labelled_suite(spark, sf_dir):
    """A labelled set as a suite: the shape that scoring wants."""
    rows = _labelled_lines(table(spark, sf_dir, "nation").select((F.col("n_nationkey") * _REST).alias("c_custkey"), "n_nationkey")).withColumn("value", F.regexp_replace("value", '"c[0-9]+"', '"c0"'))
    rows = rows.withColumn("value", F.regexp_replace("value", '"c0"', text('"c', F.expr(f"cast(c_custkey / {_REST} as int)"), '"')))
    path = in_order(scratch(spark, "suite"), "set.jsonl", rows, "c_custkey")
    found = suites.labelled_examples(spark, path)
    return found.select(F.col("ord").cast("int").alias("ord"), "id", "domain", F.array_join(F.col("available_tools.name"), "|").alias("tools"), "expected_arguments")


# ---------------------------------------------------------------- responses and records

_FRAMES = ["{}", "<tool_call>{}</tool_call>", "Look: <tool_call>\n{}\n</tool_call>", "<tool_call>{}", "{}</tool_call>", "</tool_call>{}<tool_call>", "<tool_call>{}</tool_call><tool_call>{}</tool_call>", "Say {}"]
_CONTENTS = ['{"name":"f","arguments":{"a":1}}', "null", "7", '["f"]', "{}", '{"name":"f","arguments":{},"id":1}', '{"name":"f","name":"f","arguments":{}}', '{"name":"f","arguments":{"a":NaN}}', '{"name":"f"', '{"name":" ","arguments":{}}', ""]


@query("""WITH e AS (SELECT event_id, event_id % 8 AS f, event_id // 8 % 11 AS c FROM events), k AS (SELECT *, CASE WHEN c = 0 THEN 'call' WHEN c = 1 THEN 'null' WHEN c IN (2, 3) THEN 'other' WHEN c IN (4, 5, 9) THEN 'object' ELSE 'broken' END AS kind FROM e)
SELECT event_id, (f = 0 AND kind <> 'broken') OR (f IN (1, 2) AND kind IN ('call', 'object')) AS parse_success, (f = 0 AND kind IN ('call', 'null')) OR (f IN (1, 2) AND kind = 'call') OR f = 7 AS valid, f IN (0, 1, 2) AND kind = 'call' AS is_call,
CASE WHEN f IN (0, 1, 2) AND kind = 'call' THEN 'f' END AS tool_name, CASE WHEN f IN (0, 1, 2) AND kind = 'call' THEN '{"a":1}' END AS arguments,
CASE WHEN f IN (3, 4, 6) THEN 'one block' WHEN f = 5 THEN 'order' WHEN f IN (1, 2) AND kind IN ('null', 'other') THEN 'call object' WHEN (f = 0 AND kind IN ('other', 'object')) OR (f IN (1, 2) AND kind = 'object') THEN 'shape' WHEN f < 3 AND c = 6 THEN 'duplicate' WHEN f < 3 AND c = 7 THEN 'constant' WHEN f < 3 AND kind = 'broken' THEN 'syntax' END AS error FROM k""")
def response_cases(spark, sf_dir):
    """Every content in every frame of tags, by the event's number."""
    e = table(spark, sf_dir, "events").select("event_id")
    of = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))
    said = F.replace(of(_FRAMES, F.col("event_id") % 8), F.lit("{}"), of(_CONTENTS, F.floor(F.col("event_id") / 8) % 11))
    rows = e.select("event_id", response(said, "tagged").alias("r")).select("event_id", "r.*")
    messages = {"expected one complete": "one block", "invalid native tool-call marker": "order", "native tool-call block must": "call object", "invalid structured": "shape", "duplicate JSON key: name": "duplicate", "invalid JSON constant: NaN": "constant"}
    error = F.when(F.col("parse_error").isNull(), F.lit(None).cast("string"))
    for start, name in messages.items():
        error = error.when(F.col("parse_error").startswith(start), F.lit(name))
    return rows.select("event_id", "parse_success", "valid", "is_call", "tool_name", "arguments", error.otherwise(F.lit("syntax")).alias("error"))


@query("""WITH e AS (SELECT event_id, event_id % 6 AS k FROM events) SELECT message, count(*) AS n FROM e JOIN (VALUES (1, 'name must be a non-empty string'), (2, 'parameters must contain only valid JSON values'), (2, 'parameters must be an object'), (2, 'parameters.type must be ''object'''), (2, 'parameters.properties must be an object'),
(3, 'parameters must be an object'), (3, 'parameters.type must be ''object'''), (3, 'parameters.properties must be an object'), (4, 'parameters.type must be ''object'''), (5, 'parameters.properties must be an object')) v(k, message) USING (k) GROUP BY message""")
def tool_violations(spark, sf_dir):
    """Tool records with faults: a blank name, a constant that is no JSON, a list, another type, no properties."""
    k, good = F.col("event_id") % 6, '{"type":"object","properties":{}}'
    parameters = F.when(k == 2, F.lit('{"type":NaN}')).when(k == 3, F.lit("[]")).when(k == 4, F.lit('{"type":"array","properties":{}}')).when(k == 5, F.lit('{"type":"object"}')).otherwise(F.lit(good))
    rows = table(spark, sf_dir, "events").select("event_id", F.when(k == 1, F.lit(" ")).otherwise(F.lit("t")).alias("name"), F.lit("d").alias("description"), parameters.alias("parameters"))
    return records.violations(rows, records.tool_rules(), "event_id").groupBy("message").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT event_id, event_id % 8 AS k FROM events) SELECT message, count(*) AS n FROM e JOIN (VALUES (1, 'available tool names must be unique'), (2, 'tool_name must be a non-empty string'), (2, 'expected tool must be present in available_tools'), (3, 'arguments must be an object'),
(4, 'expected tool must be present in available_tools'), (5, 'negative examples cannot include an expected tool call'), (6, 'tags must be unique'), (7, 'dialect must be a non-empty string')) v(k, message) USING (k) GROUP BY message""")
def example_violations(spark, sf_dir):
    """Example records, each with one fault or none."""
    k = F.col("event_id") % 8
    tool = lambda name: F.struct(name.alias("name"), F.lit("d").alias("description"), F.lit("{}").alias("parameters"))
    rows = table(spark, sf_dir, "events").select(
        "event_id", *[F.lit("x").alias(c) for c in ("id", "source", "language", "domain", "user_utterance")], F.array(tool(F.lit("a")), tool(F.when(k == 1, "a").otherwise("b"))).alias("available_tools"), (k != 5).alias("should_call_tool"),
        F.when(k == 2, F.lit(None)).when(k == 4, "c").otherwise("a").alias("expected_tool_name"), F.when(k == 3, "[1]").otherwise("{}").alias("expected_arguments"), F.when(k == 7, " ").alias("dialect"), F.when(k == 6, F.array(F.lit("t"), F.lit("t"))).alias("tags"),
    )
    return records.violations(rows, records.example_rules(), "event_id").groupBy("message").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT event_id, event_id % 4 AS k FROM events) SELECT message, count(*) AS n FROM e JOIN (VALUES (1, 'result and prediction example IDs must match'), (2, 'exact_match must be a boolean'), (3, 'exact_match needs a correct tool and no wrong arguments')) v(k, message) USING (k) GROUP BY message""")
def result_violations(spark, sf_dir):
    k, i = F.col("event_id") % 4, F.col("event_id").cast("string")
    rows = table(spark, sf_dir, "events").select("event_id", i.alias("example_id"), F.when(k == 1, "other").otherwise(i).alias("prediction_example_id"), F.lit(True).alias("tool_selection_correct"), (k != 3).alias("arguments_correct"), F.when(k != 2, F.lit(True)).alias("exact_match"))
    return records.violations(rows, records.result_rules(), "event_id").groupBy("message").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- runs


@query("""WITH c AS (SELECT 'c' || c_custkey AS id, row_number() OVER (ORDER BY c_custkey) - 1 AS ord, count(*) OVER () AS n FROM customer) SELECT id, CAST(ord AS INT) AS ord FROM c WHERE ord >= n // 2""")
def resumed_run(spark, sf_dir):
    """Half of the predictions are committed in three batches; a fourth was written, but its writer died before the log had it. What is left to do."""
    customers = ordinals.with_ordinals(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")
    examples = customers.select("ord", text("c", F.col("c_custkey")).alias("id"))
    half = examples.count() // 2
    said = examples.where(F.col("ord") < half).select("ord", F.col("id").alias("example_id"), *[F.lit(v).alias(n) for n, v in (("generated_text", "a\u2028b"), ("model_id", "m"), ("model_revision", "r"), ("prompt_version", "p"), ("generation_config", '{"n":1}'))], F.lit(1.5).alias("latency_seconds"), F.lit(None).cast("double").alias("gpu_memory_mb"))
    store = scratch(spark, "run")
    log = CommitLog(store, "s.base.raw.jsonl")
    for batch in range(3):
        runs.append_predictions(said.where(F.floor(F.col("ord") * 3 / half) == batch), log, batch)
    store.write("s.base.raw.jsonl/part-000003-lost/part-00000.txt", b"not a prediction")
    done = runs.read_predictions(spark, store.path("s.base.raw.jsonl"), examples, model_id="m", model_revision="r", prompt_version="p", generation={"n": 1.0})
    return runs.pending(examples, done).select("id", F.col("ord").cast("int").alias("ord"))


@query("""SELECT event_id AS ord, CAST(event_id // 2 AS VARCHAR) AS prediction_id, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN NULL ELSE 'no tool' END AS called, event_id % 3 = 0 AS ok FROM events WHERE event_id < (SELECT count(*) FROM events) - 7""")
def metric_results(spark, sf_dir):
    """Source rows by position with what was called, and a metric's own answer for each; the last seven source rows have no prediction."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id") % 3
    n = e.count()
    source = e.select(F.col("event_id").alias("ord"), F.to_json(F.struct(F.when(k == 2, F.lit("none")).otherwise(F.col("event_type")).alias("want"))).alias("row"))
    scored = e.where(F.col("event_id") < n - 7).select(F.col("event_id").alias("ord"), F.floor(F.col("event_id") / 2).cast("string").alias("id"), F.when(k == 0, F.col("event_type")).alias("tool_name"), F.lit(None).cast("string").alias("arguments"), F.when(k == 2, F.lit("bad")).alias("parse_error"))
    pairs = runs.metric_inputs(source, scored)
    answers = runs.official_results(pairs, lambda row, said: {"ok": row["want"] == said["function_called"]})
    called = F.when(F.col("function_called") == runs.INVALID, F.lit("no tool")).otherwise(F.col("function_called"))
    return pairs.select("ord", "prediction_id", called.alias("called")).join(answers.select(F.col("source_row_index").alias("ord"), (F.get_json_object("result", "$.ok") == "true").alias("ok")), "ord")


@query("""WITH e AS (SELECT event_id % 3 = 0 AS ok, event_id % 7 AS n FROM events WHERE event_id < (SELECT count(*) FROM events) - 7) SELECT count(*) AS answers, round(avg(CAST(ok AS INT)), 9) AS accuracy, count(*) FILTER (ok) AS measured, round(avg(n / 8) FILTER (ok), 9) AS size FROM e""")
def metric_summary(spark, sf_dir):
    """A metric over the answers of every row, merged from tasks' states: the share that is right, and the mean of a member that only right answers have."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id") % 3
    source = e.select(F.col("event_id").alias("ord"), F.to_json(F.struct(F.col("event_type").alias("want"), (F.col("event_id") % 7).alias("n"))).alias("row"))
    scored = e.where(F.col("event_id") < e.count() - 7).select(F.col("event_id").alias("ord"), F.col("event_id").cast("string").alias("id"), F.when(k == 0, F.col("event_type")).otherwise(F.lit("none")).alias("tool_name"), F.lit("{}").alias("arguments"), F.when(k == 2, F.lit("bad")).alias("parse_error"))

    def answer(row: dict, said: dict) -> dict:
        ok = row["want"] == said["function_called"]
        return {"ok": ok, "note": "text"} | ({"size": row["n"] / 8} if ok else {})

    found = metrics.aggregated(runs.official_results(runs.metric_inputs(source, scored), answer), metrics.member_means())
    of = lambda path, kind: F.get_json_object("result", f"$.{path}").cast(kind)
    return found.select(of("ok.n", "long").alias("answers"), F.round(of("ok.mean", "double"), 9).alias("accuracy"), of("size.n", "long").alias("measured"), F.round(of("size.mean", "double"), 9).alias("size"))


@query("""WITH o AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, sha256(string_agg(o_orderkey || ' ' || o_orderpriority || chr(10), '' ORDER BY o_orderkey)) AS actual FROM orders GROUP BY 1)
SELECT 'month=' || month AS path, source, actual FROM o, (VALUES ('run'), ('audit')) s(source) WHERE source = 'audit' AND CAST(right(month, 2) AS INT) % 3 = 0 UNION ALL SELECT 'month=none', 'run', NULL""")
def digest_differences(spark, sf_dir):
    """Orders written as a file for each month, and what two lists of digests say of them: one is wrong about every third month, one names a month without a file."""
    orders = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderkey", text(F.col("o_orderkey"), " ", F.col("o_orderpriority")).alias("value"))
    store = scratch(spark, "months")
    orders.repartition("month").sortWithinPartitions("month", "o_orderkey").select("month", "value").write.partitionBy("month").text(store.path("orders"))
    path = F.regexp_extract("path", "(month=[^/]+)/", 1)
    actual = digests(spark, store.path("orders"), pattern="*.txt", recursive=True).select(path.alias("path"), "sha256")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "value"))), lambda x: F.concat(x["value"], F.lit("\n")))
    right = orders.groupBy("month").agg(F.sha2(F.array_join(lines, ""), 256).alias("sha256")).select(text("month=", F.col("month")).alias("path"), "sha256")
    off = F.substring("path", -2, 2).cast("int") % 3 == 0
    missing = table(spark, sf_dir, "orders").limit(1).select(F.lit("month=none").alias("path"), F.lit("run").alias("source"), F.lit("0").alias("sha256"))
    expected = right.select("path", F.lit("run").alias("source"), "sha256").union(right.select("path", F.lit("audit"), F.when(off, F.lit("0")).otherwise(F.col("sha256")))).union(missing)
    return runs.digest_differences(actual, expected).select("path", "source", "actual")


@query("""SELECT event_id, sha256('p' || event_id) AS prompt_sha256, CAST(event_id % 4 + 1 AS INT) AS output_tokens, event_id % 4 = 3 AND event_id % 5 <> 0 AS hit_token_limit FROM events""")
def prediction_enrichment(spark, sf_dir):
    n = F.col("event_id")
    ids = F.concat(F.array_repeat(F.lit(7), (n % 4).cast("int")), F.array(F.when(n % 5 == 0, F.lit(2)).otherwise(F.lit(9))))
    return runs.prediction_lines(table(spark, sf_dir, "events").select("event_id", text("p", n).alias("prompt"), ids.alias("output_ids")), max_new_tokens=4, eos=2)


@query("""SELECT event_id AS ord, '[{"role":"user","content":"' || event_type || '"}] [{"type":"function","function":{"name":"t","description":"d","parameters":"{}"}}]' AS prompt FROM events""")
def rendered_prompts(spark, sf_dir):
    """A template sees the user's message and the tools, nothing else."""
    tools = F.array(F.struct(F.lit("t").alias("name"), F.lit("d").alias("description"), F.lit("{}").alias("parameters")))
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("ord"), F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("user_utterance"), tools.alias("available_tools"), F.lit("GOLD").alias("expected_tool_name"))
    return runs.rendered_prompts(rows, lambda messages, tools: f"{messages} {tools}").select("ord", "prompt")


@query("SELECT doc_id, CAST(length(text) AS BIGINT) AS n FROM documents")
def rendered_lengths(spark, sf_dir):
    """Lengths by a tokenizer's hook; here a token is a character."""
    return table(spark, sf_dir, "documents").select("doc_id", token_lengths(F.col("text"), lambda texts: [len(t) for t in texts]).alias("n"))


@query("""SELECT o_orderpriority AS suite, count(*) AS n, CAST(min(o) AS INT) AS first, CAST(max(o) AS INT) AS last FROM (SELECT o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS o FROM orders) WHERE o < 50 GROUP BY 1""")
def suite_prefixes(spark, sf_dir):
    """The first fifty of each suite; priorities are the suites."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("o_orderpriority").orderBy("o_orderkey")) - 1
    orders = table(spark, sf_dir, "orders").select("o_orderpriority", place.alias("ord"))
    names = [r[0] for r in orders.select("o_orderpriority").distinct().orderBy("o_orderpriority").collect()]  # five priorities
    parts = suites.prefix_of_each({name: orders.where(F.col("o_orderpriority") == name) for name in names}, 50)
    out = None
    for name, rows in parts.items():
        mine = rows.agg(F.lit(name).alias("suite"), F.count("*").alias("n"), F.min("ord").alias("first"), F.max("ord").alias("last"))
        out = mine if out is None else out.union(mine)
    return out


@query("""WITH r AS (SELECT c_custkey % 10 AS category, CASE WHEN c_acctbal < -900 THEN 'draft' ELSE 'ok' END AS status, CASE WHEN c_acctbal > 9000 THEN 'see ' || c_name END AS note, c_nationkey // 25 AS day FROM customer), q AS (SELECT category, count(*) AS n FROM r GROUP BY category)
SELECT count(*) = 100 AS hundred_rows, count(*) FILTER (status <> 'ok') = 0 AS all_reviewed, count(note) = 0 AS no_notes, (SELECT count(*) = 10 AND min(n) = 10 AND max(n) = 10 FROM q) AS ten_of_each_category, count(DISTINCT day) = 1 AS one_date FROM r""")
def labelled_gates(spark, sf_dir):
    """The gates before training, over all customers as a labelled set."""
    category = F.element_at(F.array(*map(F.lit, labelled.CATEGORIES)), (F.col("c_custkey") % 10 + 1).cast("int"))
    status = F.when(F.col("c_acctbal") < -900, "draft_not_gold").otherwise("native_speaker_reviewed")
    note = F.when(F.col("c_acctbal") > 9000, text("see ", F.col("c_name")))
    day = F.date_format(F.date_add(F.lit("2027-03-04").cast("date"), F.floor(F.col("c_nationkey") / 25).cast("int")), "yyyy-MM-dd")
    return runs.training_gates(table(spark, sf_dir, "customer").select(category.alias("category"), status.alias("review_status"), note.alias("review_note"), day.alias("reference_date")))


# ---------------------------------------------------------------- the corpus


#: The corpus's coordinates out of the tables: tools t, dialects d, the calls c with what they offer, the requests without a call k.
_CORPUS = """t AS (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS task, lower(n_name) AS tool, count(*) OVER () AS tools FROM nation), d AS (SELECT row_number() OVER (ORDER BY r_regionkey) - 1 AS d, r_name AS dialect FROM region),
s AS (SELECT *, CASE WHEN task IN (1, 4) THEN 'validation' ELSE 'train' END AS split FROM t), p AS (SELECT split, list(task ORDER BY task) AS own FROM s GROUP BY split),
c AS (SELECT task, tool, s.split, d, dialect, v, v % 20 AS form, list_filter(own, lambda x: x <> task) AS others FROM s JOIN p ON s.split = p.split, d, (SELECT unnest(range(100)) AS v)),
k AS (SELECT i, d, dialect, form, CASE WHEN form >= 8 THEN 'validation' ELSE 'train' END AS split FROM (SELECT unnest(range(10)) AS i), d, (SELECT unnest(range(10)) AS form))"""


def _corpus_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.corpus(spark, table_design(spark, sf_dir))


@query(f"WITH {_CORPUS}, a AS (SELECT dialect, split, true AS should_call_tool FROM c UNION ALL SELECT dialect, split, false FROM k) SELECT dialect, split, should_call_tool, count(*) AS n, count(*) AS prompts FROM a GROUP BY ALL")
def corpus_counts(spark, sf_dir):
    """Regions as dialects, nations as tools, orders as values: rows and different prompts by dialect, split and sign."""
    return _corpus_of(spark, sf_dir).groupBy("dialect", "split", "should_call_tool").agg(F.count("*").alias("n"), F.count_distinct("user_utterance").alias("prompts"))


@query(f"""WITH {_CORPUS}, o AS (SELECT o_custkey % (SELECT count(*) FROM nation) AS task, o_orderkey AS nth, '"c' || o_custkey || '"' AS j0, CAST(o_orderkey % 11 AS VARCHAR) AS j1,
'"' || CASE WHEN o_custkey % (SELECT count(*) FROM nation) % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE o_orderpriority END || '"' AS j2 FROM orders),
e AS (SELECT task, nth, unnest(CASE WHEN task = 2 THEN [{{'slot': 0, 'j': j0 || ',"number":' || j1}}, {{'slot': 2, 'j': j2}}] ELSE [{{'slot': 0, 'j': j0}}, {{'slot': 1, 'j': j1}}, {{'slot': 2, 'j': j2}}] END) AS x FROM o),
g AS (SELECT task, x.slot AS slot, x.j AS j, row_number() OVER (PARTITION BY task, x.slot ORDER BY min(nth)) - 1 AS i FROM e GROUP BY task, x.slot, x.j),
z AS (SELECT task, count(*) FILTER (slot = 0) AS n0, greatest(1, count(*) FILTER (slot = 1)) AS n1, count(*) FILTER (slot = 2) AS n2 FROM g GROUP BY task),
q AS (SELECT c.*, n0, n1, n2, (2 * v * (n0 * n1 * n2 - 1) + 99) // 198 AS pick FROM c JOIN z USING (task))
SELECT q.tool, q.dialect, CAST(v AS INT) AS v, 'TR-' || CASE WHEN (q.task * (SELECT count(*) FROM d) + d) * 100 + v + 1 < 10000 THEN lpad(CAST((q.task * (SELECT count(*) FROM d) + d) * 100 + v + 1 AS VARCHAR), 4, '0') ELSE CAST((q.task * (SELECT count(*) FROM d) + d) * 100 + v + 1 AS VARCHAR) END AS id,
'{{"customer":' || a.j || CASE WHEN q.task = 2 THEN '' ELSE ',"number":' || b.j END || ',"' || CASE WHEN q.task % 3 = 0 THEN 'visit_date_iso' ELSE 'priority' END || '":' || w.j || '}}' AS arguments
FROM q JOIN g a ON a.task = q.task AND a.slot = 0 AND a.i = pick // (n1 * n2) % n0 LEFT JOIN g b ON b.task = q.task AND b.slot = 1 AND b.i = pick // n2 % n1 JOIN g w ON w.task = q.task AND w.slot = 2 AND w.i = pick % n2""")
def corpus_arguments(spark, sf_dir):
    """Every call's arguments: evenly spaced value combinations, decoded."""
    rows = corpus.call_rows(spark, table_design(spark, sf_dir))
    return rows.select(F.col("expected_tool_name").alias("tool"), "dialect", F.col("generation_coordinates.values").alias("v"), "id", F.col("expected_arguments").alias("arguments"))


@query(f"""WITH {_CORPUS}, n AS (SELECT (SELECT count(*) FROM c) AS calls, (SELECT count(*) FROM k) AS idle, (SELECT count(*) FROM orders) > 0 AS ok) SELECT 'expected ' || calls || ' calls and ' || idle || ' no-call examples' AS gate, ok FROM n UNION ALL SELECT gate, ok FROM n, (VALUES ('expected unique synthetic prompts'), ('one language'), ('all dialects'),
('every expected argument must appear in its user prompt'), ('expected tool must be available in its prompt'), ('every prompt must offer two distinct tools'), ('message target must match the expected call'), ('no-call rows must have a plain assistant response'), ('balanced distractors'), ('balanced tool positions'), ('prompt variation counts must match the design')) g(gate)""")
def corpus_gates(spark, sf_dir):
    design = table_design(spark, sf_dir)
    return corpus.gates(corpus.corpus(spark, design), design)


@query(f"""WITH {_CORPUS}, m AS (SELECT tool, others[(d * 100 + v) % len(others) + 1] AS other, count(*) AS n FROM c GROUP BY ALL), b AS (SELECT tool, count(*) AS competitors, max(n) - min(n) AS spread FROM m GROUP BY tool), f AS (SELECT tool, count(*) FILTER ((d + v + task) % 2 = 0) AS first FROM c GROUP BY tool)
SELECT tool AS expected_tool_name, competitors, spread, first FROM b JOIN f USING (tool)""")
def corpus_balance(spark, sf_dir):
    """How often each tool meets which other, and stands first."""
    rows = _corpus_of(spark, sf_dir)
    return corpus.distractor_balance(rows).join(corpus.position_balance(rows), "expected_tool_name")


@query(f"WITH {_CORPUS}, a AS (SELECT dialect, split FROM c UNION ALL SELECT dialect, split FROM k) SELECT dialect, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'validation') AS validation FROM a GROUP BY dialect UNION ALL SELECT 'none', 0, 0")
def corpus_dialects(spark, sf_dir):
    """Rows by dialect and split, a dialect without rows among them."""
    design = table_design(spark, sf_dir)
    return corpus.dialect_counts(corpus.corpus(spark, design), [*design["dialects"], "none"], pivot=True)


@query(f"WITH {_CORPUS} SELECT count(*) FILTER (form = 17) AS orthographic_hamza_variation, count(*) FILTER (form = 18) AS code_switching, count(*) FILTER (form = 19 AND task % 3 = 0) AS normalized_date_surface FROM c")
def corpus_features(spark, sf_dir):
    return corpus.prompt_features(_corpus_of(spark, sf_dir))


@query(f"WITH {_CORPUS} SELECT 'function' AS kind, 2 AS tools, 2 AS messages, (SELECT count(*) FROM c) + (SELECT count(*) FROM k) AS n")
def corpus_training_format(spark, sf_dir):
    rows = corpus.training_format(_corpus_of(spark, sf_dir))
    return rows.groupBy(F.col("tools")[0]["type"].alias("kind"), F.size("tools").alias("tools"), F.size("messages").alias("messages")).agg(F.count("*").alias("n"))


@query(f"WITH {_CORPUS}, n AS (SELECT (SELECT count(*) FROM c) + (SELECT count(*) FROM k) AS n) SELECT n AS lines, n AS ids, CAST(1 AS BIGINT) AS first_ord, n AS last_ord FROM n")
def corpus_lines(spark, sf_dir):
    """The corpus as JSON lines, in order, with their own ids."""
    lines = corpus.json_lines(_corpus_of(spark, sf_dir))
    return lines.agg(F.count("*").alias("lines"), F.count_distinct(F.get_json_object("value", "$.id")).alias("ids"), F.min("ord").cast("long").alias("first_ord"), F.max("ord").cast("long").alias("last_ord"))


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderkey || ' ' || o_orderpriority || chr(10) AS line FROM orders)
SELECT count(*) AS lines, CAST(sum(strlen(line)) AS BIGINT) AS bytes, sha256(string_agg(line, '' ORDER BY k)) AS sha256, min(k) AS first, max(k) AS last, true AS in_order, (SELECT count(*) FROM orders) AS numbered FROM o""")
def ordered_parts(spark, sf_dir):
    """Orders as lines in parts side by side: what the manifest says of them, the digest of the parts joined, and how many lines stand there as read again."""
    key, store = F.col("o_orderkey"), scratch(spark, "ordered")
    found = write_ordered(table(spark, sf_dir, "orders").select(key.alias("ord"), text(key, " ", F.col("o_orderpriority")).alias("value")), store, "parts")
    parts, paths = found["parts"], part_paths(store, "parts")
    whole = store.concatenate(paths, "whole.txt")
    ranges = all(a["last"] < b["first"] for a, b in zip(parts, parts[1:], strict=False))
    right = all(a["last"] < b["first"] for a, b in zip(parts, parts[1:], strict=False)) and [store.sha256(f"parts/{p['file']}") for p in parts] == [p["sha256"] for p in parts]
    lines = numbered_lines(spark, paths) if paths else spark.createDataFrame([], "line long, value string")
    ends = [F.lit(p).cast("long") for p in ((parts[0]["first"], parts[-1]["last"]) if parts else (None, None))]
    facts = {"lines": F.lit(found["lines"]).cast("long"), "bytes": F.lit(found["bytes"]).cast("long"), "sha256": F.lit(whole), "first": ends[0], "last": ends[1], "in_order": F.lit(right)}
    return lines.agg(F.count("*").alias("numbered")).select(*[c.alias(k) for k, c in facts.items()], "numbered")
