"""Leakage audit: each blocker, and what must not count."""

import itertools
import json
import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from callgrove.functions.jsonx import alternatives, loose
from callgrove.functions.text import normalize_prompt, normalized_prompt
from callgrove.operators import audit as A

TOOL = "array<struct<name:string,description:string,parameters:string>>"
DDL = f"ord long, id string, user_utterance string, available_tools {TOOL}, should_call_tool boolean, expected_tool_name string, expected_arguments string"


def tool(name, *properties):
    return (name, "d", json.dumps({"type": "object", "properties": {p: {"type": "string"} for p in properties}}))


def rows(spark, *items):
    return spark.createDataFrame([(i, f"e{i}", *x) for i, x in enumerate(items)], DDL)


def test_group(spark):
    train = rows(spark, ("Hello there", [tool("a", "x")], True, "a", '{"n": 25}'), ("عمّان", [tool("b", "y")], False, None, None))
    held = rows(
        spark,
        ("Hello there", [tool("c", "x")], True, "a", '{"n":25}'),
        ("HELLO — there!", [tool("a", "x")], True, "a", '{"n": 25.0}'),
        ("عمان", [tool("d", "z")], False, None, None),
    )
    row = A.audit_group(train, held).collect()[0]
    assert row.exact_prompts == ["e0"] and row.normalized_prompts == ["e0", "e1"] and row.expected_calls == ["e0"]
    assert row.tool_names == ["a"] and row.complete_tool_schemas == 1 and row.property_names == ["x"] and row.examples == 3 and row.passed is False


def test_properties_alone_do_not_block(spark):
    train = rows(spark, ("one", [tool("a", "x")], True, "a", "{}"))
    held = rows(spark, ("two", [tool("b", "x")], True, "b", "{}"))
    row = A.audit_group(train, held).collect()[0]
    assert row.property_names == ["x"] and row.passed is True


def test_alternatives(spark):
    train = rows(spark, ("q", [tool("t", "a")], True, "t", '{"a": 1}'), ("r", [tool("t", "a")], True, "t", '{"a": 3, "b": "u"}'))
    cases = [('{"a":[1.0,2]}', True), ('{"a":[true],"c":["",4]}', True), ('{"a":[1],"c":[4]}', False), ('{"a":[3],"b":["v"]}', False), ('{"a":[3],"b":["u"]}', True), ('{"b":["u"]}', False)]
    held = rows(spark, *[(f"p{i}", [tool("t", "a")], True, "t", "{}") for i in range(len(cases))])
    answers = spark.createDataFrame([(f"e{i}", "t", 1, c) for i, (c, _) in enumerate(cases)], "id string, tool string, n_calls int, choices string")
    found = {r.id for r in A.alternatives_overlap(train, held, answers).collect()}
    assert found == {f"e{i}" for i, (_, hit) in enumerate(cases) if hit}


def test_marks_become_spaces():
    assert normalize_prompt("عمّان") == "عم ان" and normalize_prompt("Straße  Ⅳ!") == "strasse iv"


def test_empty_sides(spark):
    none = rows(spark, ("x", [tool("a", "x")], True, "a", "{}")).limit(0)
    row = A.audit_group(none, none).collect()[0]
    assert row.examples == 0 and row.passed is True


def test_named_groups(spark):
    train = rows(spark, ("one", [tool("a", "x")], True, "a", "{}"))
    held = rows(spark, ("one", [tool("b", "z")], False, None, None))
    found = {r.name: r.passed for r in A.audit(train, {"g": (held, None), "h": (train.limit(0), None)}).collect()}
    assert found == {"g": False, "h": True}


def test_normalized_prompt_is_the_same_inside_and_outside_ascii(spark):
    texts = ["".join(map(chr, range(128))), "A-b_C  d\n\te!", "", " ", "\x1c x \x1f", "a\x00b\x7fc", "Straße", "ﬁ \u00a0x", "line\nline\r\n", None]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.n for r in frame.select("i", normalized_prompt(F.col("t")).alias("n")).collect()}
    assert got == {i: None if t is None else normalize_prompt(t) for i, t in enumerate(texts)}


def test_alternatives_against_all_pairs(spark):
    """Random calls and answers: the join on the first argument finds what testing all pairs finds, calls without arguments too."""
    rng = random.Random(1)
    calls = [(f"t{i}", rng.choice("fg"), {k: rng.choice([1, 1.0, "a", True]) for k in rng.sample("abc", rng.randrange(4))}) for i in range(60)]
    wanted = [(f"e{i}", rng.choice("fg"), {k: rng.sample([1, "a", "", 2], rng.randrange(1, 4)) for k in rng.sample("abc", rng.randrange(4))}) for i in range(60)]
    ddl = "id string, should_call_tool boolean, expected_tool_name string, expected_arguments string"
    train = spark.createDataFrame([(i, True, t, json.dumps(a)) for i, t, a in calls], ddl)
    held = spark.createDataFrame([(i, True, t, "{}") for i, t, _ in wanted], ddl)
    answers = spark.createDataFrame([(i, t, 1, json.dumps(c)) for i, t, c in wanted], "id string, tool string, n_calls int, choices string")
    fits = lambda args, choices: all(k in choices and v in choices[k] for k, v in args.items()) and all(k in args or "" in v for k, v in choices.items())
    want = {i for (i, t, c), (_, u, a) in itertools.product(wanted, calls) if t == u and fits(a, c)}
    assert {r.id for r in A.alternatives_overlap(train, held, answers).collect()} == want and want


@st.composite
def _calls_and_answers(draw):
    values = st.sampled_from([0, 1, 1.0, True, "a", "", None, [1], {"x": 1.0}])
    names = st.sampled_from(["a", "b", "c", ""])
    tools = st.sampled_from(["f", "g"])
    calls = draw(st.lists(st.tuples(tools, st.dictionaries(names, values, max_size=3)), max_size=12))
    answers = draw(st.lists(st.tuples(tools, st.dictionaries(names, st.lists(values, min_size=1, max_size=3), max_size=3)), max_size=12))
    return calls, answers, draw(st.integers(1, 3))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(case=_calls_and_answers())
def test_rarest_argument_against_all_pairs(spark, case):
    """Whatever the salted parts' size; no arguments, empty names, nulls and nested values too."""
    calls, wanted, block = case
    same = lambda a, b: loose(a) == loose(b)
    fits = lambda args, choices: all(k in choices and any(same(v, x) for x in choices[k]) for k, v in args.items()) and all(k in args or "" in v for k, v in choices.items())
    ddl = "id string, should_call_tool boolean, expected_tool_name string, expected_arguments string"
    train = spark.createDataFrame([(f"t{i}", True, t, json.dumps(a)) for i, (t, a) in enumerate(calls)], ddl)
    held = spark.createDataFrame([(f"e{i}", True, t, "{}") for i, (t, _) in enumerate(wanted)], ddl)
    answers = spark.createDataFrame([(f"e{i}", t, 1, json.dumps(c)) for i, (t, c) in enumerate(wanted)], "id string, tool string, n_calls int, choices string")
    want = {f"e{i}" for i, (t, c) in enumerate(wanted) if any(t == u and fits(a, c) for u, a in calls)}
    assert {r.id for r in A.alternatives_overlap(train, held, answers, block=block).collect()} == want


def test_a_constant_argument_does_not_meet_everything(spark):
    """The first argument by name is the same in all calls and answers: pairs stay linear, whichever name the telling argument has."""
    n = 3000
    i = F.col("id").cast("string")
    calls = spark.range(n).select(F.lit("t").alias("tool"), F.concat(F.lit('{"a":1,"b":'), i, F.lit(',"c":"x"}')).alias("args"))
    held = spark.range(n).select(i.alias("id"), F.lit("t").alias("expected_tool_name"))
    choices = F.concat(F.lit('{"a":[1],"b":['), i, F.lit(","), (F.col("id") + 1).cast("string"), F.lit('],"c":["x"]}'))
    answers = spark.range(n).select(i.alias("id"), F.lit("t").alias("tool"), F.lit(1).alias("n_calls"), choices.alias("choices"))
    wanted = answers.select("id", "tool", alternatives(F.col("choices")).alias("choices"))
    assert A.probe_pairs(calls, wanted).count() == 2 * n - 1
    train = calls.select(F.lit(True).alias("should_call_tool"), F.col("tool").alias("expected_tool_name"), F.col("args").alias("expected_arguments"))
    assert A.alternatives_overlap(train, held, answers).count() == n


def test_hot_arguments_are_cut(spark):
    """One value that all answers list: its parts are all asked, and none holds them all."""
    wanted = spark.range(500).select(F.col("id").cast("string").alias("id"), F.lit("t").alias("tool"), F.create_map(F.lit("a"), F.array(F.lit("1"))).alias("choices"))
    calls = spark.createDataFrame([("t", '{"a":1}'), ("t", '{"a":1.0}'), ("t", '{"a":1,"z":2}')], "tool string, args string")
    assert A.probe_pairs(calls, wanted, block=50).count() == A.probe_pairs(calls, wanted).count() == 1000
