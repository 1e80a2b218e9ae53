"""Leakage audit between training and evaluation rows: prompts, tools, schemas, expected calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.jsonx import alternatives, canonical_form, loose_members
from ..functions.text import normalized_prompt
from ..sources.store import Store


def tool_parts(rows: DataFrame) -> DataFrame:
    """(name, schema, properties) of all tools in rows' available_tools; schema is the canonical text of the whole definition."""
    tools = rows.select(F.explode("available_tools").alias("t")).select("t.name", "t.description", "t.parameters").distinct()
    head = F.to_json(F.struct("name", "description"), {"ignoreNullFields": "false"})
    whole = F.concat(F.expr("left(h, length(h) - 1)"), F.lit(',"parameters":'), F.col("parameters"), F.lit("}"))
    tools = tools.withColumn("h", head).withColumn("whole", whole)
    return tools.select("name", canonical_form(F.col("whole")).alias("schema"), F.coalesce(F.json_object_keys(F.get_json_object("parameters", "$.properties")), F.array().cast("array<string>")).alias("properties"))


def expected_calls(rows: DataFrame) -> DataFrame:
    """Distinct (tool, args) of rows that should call a tool; args as canonical text."""
    calls = rows.where("should_call_tool AND expected_tool_name IS NOT NULL AND expected_tool_name <> ''")
    return calls.select(F.col("expected_tool_name").alias("tool"), canonical_form(F.coalesce("expected_arguments", F.lit("null"))).alias("args")).distinct()


def exact_overlap(train: DataFrame, evaluation: DataFrame) -> DataFrame:
    return evaluation.join(train.select("user_utterance").distinct(), "user_utterance", "left_semi")


def normalized_overlap(train: DataFrame, evaluation: DataFrame) -> DataFrame:
    key = normalized_prompt(F.col("user_utterance"))
    return evaluation.withColumn("audit_key", key).join(train.select(key.alias("audit_key")).distinct(), "audit_key", "left_semi").drop("audit_key")


def target_overlap(train: DataFrame, evaluation: DataFrame) -> DataFrame:
    """Evaluation rows whose expected call, with textually equal arguments, some training row expects."""
    keyed = evaluation.withColumn("audit_args", canonical_form(F.coalesce("expected_arguments", F.lit("null"))))
    calls = expected_calls(train)
    return keyed.join(calls, (keyed["expected_tool_name"] == calls["tool"]) & (keyed["audit_args"] == calls["args"]), "left_semi").drop("audit_args")


def _call_arguments(calls: DataFrame) -> DataFrame:
    """(tool, call, key, value): a row for each argument of a call; one without arguments has the pair of empty texts, which no argument has."""
    each = F.transform(F.map_entries(loose_members(F.col("args"))), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    return calls.select("tool", F.col("args").alias("call"), F.explode(F.concat(each, F.array(F.struct(F.lit("").alias("key"), F.lit("").alias("value"))))).alias("e")).select("tool", "call", "e.*")


def probe_pairs(calls: DataFrame, wanted: DataFrame, *, block: int = 2000) -> DataFrame:
    """(id, tool, call) of calls and answers worth a full test: an inverted index over the answers, asked with each call's rarest argument.

    calls: tool, args (canonical text), distinct. wanted: id, tool, choices (map of loose forms). An answer that permits a call lists every argument of it, so one argument
    is enough to find it; taken is the one that the fewest answers list (on equal numbers the first by name and value), and a call with an argument that none lists is out. An
    argument that more than ``block`` answers list is cut into salted parts of about that size, to each of which its calls go.
    """
    listed = F.flatten(F.transform(F.map_entries("choices"), lambda e: F.transform(F.array_distinct(e["value"]), lambda v: F.struct(e["key"].alias("key"), v.alias("value")))))
    none = F.array(F.struct(F.lit("").alias("key"), F.lit("").alias("value")))
    index = wanted.select("id", "tool", F.explode(F.concat(listed, none)).alias("e")).select("id", "tool", "e.*")
    sizes = index.groupBy("tool", "key", "value").agg(F.count("*").alias("n"))
    met = _call_arguments(calls).join(sizes, ["tool", "key", "value"], "left")
    # every call has the empty pair, which all its tool's answers list: it serves only where there is no other
    best = F.min(F.when(F.col("key") != "", F.struct("n", "key", "value")).when(F.col("value") != "", F.struct("n", "key", "value")))
    chosen = met.groupBy("tool", "call").agg(best.alias("best"), F.count_if(F.col("n").isNull()).alias("unlisted"), F.max(F.when((F.col("key") == "") & (F.col("value") == ""), F.col("n"))).alias("all")).where("unlisted = 0")
    probes = chosen.select("tool", "call", F.coalesce("best", F.struct(F.col("all").alias("n"), F.lit("").alias("key"), F.lit("").alias("value"))).alias("p")).select("tool", "call", "p.*")
    parts = F.floor((F.col("n") - 1) / block) + 1
    probes = probes.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("n")
    salted = index.join(sizes, ["tool", "key", "value"]).withColumn("part", F.pmod(F.xxhash64("id"), parts)).drop("n")
    return salted.join(probes, ["tool", "key", "value", "part"]).select("id", "tool", "call")


def alternatives_overlap(train: DataFrame, evaluation: DataFrame, answers: DataFrame, *, block: int = 2000) -> DataFrame:
    """Evaluation rows for which some training call is a permitted answer.

    answers: id, tool, n_calls, choices (JSON object: argument to its list of alternatives). Calls find answers by their rarest argument (``probe_pairs``), and what they
    find is tested in full.
    """
    wanted = evaluation.where("expected_tool_name IS NOT NULL AND expected_tool_name <> ''").select("id", F.col("expected_tool_name").alias("tool"))
    wanted = wanted.join(answers.where("n_calls = 1").select("id", "tool", alternatives(F.col("choices")).alias("choices")), ["id", "tool"]).where("choices IS NOT NULL")
    pairs = probe_pairs(expected_calls(train), wanted, block=block).join(wanted, ["id", "tool"]).withColumn("args", loose_members(F.col("call")))
    known = F.forall(F.map_entries("args"), lambda e: F.coalesce(F.array_contains(F.try_element_at("choices", e["key"]), e["value"]), F.lit(False)))
    optional = F.forall(F.map_entries("choices"), lambda e: F.map_contains_key("args", e["key"]) | F.array_contains(e["value"], '""'))
    return evaluation.join(pairs.where(known & optional).select("id").distinct(), "id", "left_semi")


def structural_overlap(train: DataFrame, evaluation: DataFrame) -> DataFrame:
    """One row: shared tool names and property names (sorted), and how many whole definitions are shared."""
    left, right = tool_parts(train), tool_parts(evaluation)

    def shared(pick):
        return pick(left).distinct().join(pick(right).distinct(), "x", "left_semi")

    names = shared(lambda t: t.select(F.col("name").alias("x"))).select(F.lit("n").alias("kind"), "x")
    schemas = shared(lambda t: t.select(F.col("schema").alias("x"))).select(F.lit("s").alias("kind"), "x")
    properties = shared(lambda t: t.select(F.explode("properties").alias("x"))).select(F.lit("p").alias("kind"), "x")
    of = lambda kind: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("x"))))
    return names.union(schemas).union(properties).agg(of("n").alias("tool_names"), F.count_if(F.col("kind") == "s").alias("complete_tool_schemas"), of("p").alias("property_names"))


def audit_group(train: DataFrame, evaluation: DataFrame, *, answers: DataFrame | None = None, order: str = "ord") -> DataFrame:
    """One row: examples, the blockers (lists of ids in order, shared names, a number of definitions), the property diagnostic, passed."""
    targets = target_overlap(train, evaluation) if answers is None else alternatives_overlap(train, evaluation, answers)
    hits = {"exact_prompts": exact_overlap(train, evaluation), "normalized_prompts": normalized_overlap(train, evaluation), "expected_calls": targets}
    listed = None
    for name, rows in hits.items():
        mine = rows.select(F.lit(name).alias("kind"), F.struct(F.col(order).alias("o"), "id").alias("s"))
        listed = mine if listed is None else listed.union(mine)
    of = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("s")))), lambda s: s["id"])
    lists = listed.agg(*[of(k).alias(k) for k in hits]).withColumn("one", F.lit(1))
    size = evaluation.agg(F.count("*").alias("examples")).withColumn("one", F.lit(1))
    row = size.join(lists, "one").join(structural_overlap(train, evaluation).withColumn("one", F.lit(1)), "one").drop("one")
    empty = (F.size("exact_prompts") == 0) & (F.size("normalized_prompts") == 0) & (F.size("tool_names") == 0) & (F.col("complete_tool_schemas") == 0) & (F.size("expected_calls") == 0)
    return row.select("examples", "exact_prompts", "normalized_prompts", "tool_names", "complete_tool_schemas", "expected_calls", "property_names", empty.alias("passed"))


def audit(train: DataFrame, groups: dict[str, tuple[DataFrame, DataFrame | None]]) -> DataFrame:
    """A row for each named group of evaluation rows (with answers where they have alternatives); the audit passes if all do."""
    train = train.cache()
    out = None
    for name, (rows, answers) in groups.items():
        mine = audit_group(train, rows, answers=answers).select(F.lit(name).alias("name"), "*")
        out = mine if out is None else out.union(mine)
    return out


def report(rows: DataFrame, path: str, **facts: object) -> dict:
    """Writes an audit's rows (one per group) as a JSON document with a status, beside facts such as digests and revisions. The path may be on any file system."""
    groups = {}
    for row in rows.collect():  # one row for each group
        found = row.asDict()
        blockers = {k: found[k] for k in ("exact_prompts", "normalized_prompts", "tool_names", "complete_tool_schemas", "expected_calls")}
        groups[found["name"]] = {"examples": found["examples"], "blockers": blockers, "property_name_overlap_diagnostic": found["property_names"], "passed": found["passed"]}
    out = {"status": "passed" if all(g["passed"] for g in groups.values()) else "blocked", **facts, "evaluation_groups": groups}
    folder, _, name = path.rpartition("/")
    Store(rows.sparkSession, folder or ".").put(name, out)
    return out
