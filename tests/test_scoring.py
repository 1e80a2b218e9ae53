"""Parsing contract, value equality, golden counts and rates, verdict."""

import json
import random

import pytest
from pyspark.sql import functions as F

from callgrove.functions.jsonx import canonical, loose, parse_response, scoring
from callgrove.operators import scoring as S
from callgrove.operators.verdict import comparison

EX = "id string, should_call_tool boolean, expected_tool_name string, expected_arguments string, domain string, ord long"
PR = "example_id string, generated_text string, latency_seconds double, gpu_memory_mb double"


def scored(spark, cases, output_format="json"):
    ex = spark.createDataFrame([(str(i), a is not None, "weather" if a is not None else None, a, "d", i) for i, (a, _) in enumerate(cases)], EX)
    pr = spark.createDataFrame([(str(i), t, 1.0, None) for i, (_, t) in enumerate(cases)], PR)
    return S.score_examples(ex, pr, output_format=output_format, keep=("ord", "domain"))


def call(arguments, name="weather"):
    return json.dumps({"name": name, "arguments": arguments}, ensure_ascii=False)


#: What can be wrong with a response to a wanted call (f with two arguments), and what the scorer has to say: parsed, structured, should-call, tool, arguments, key tp, fp, fn.
WANTED = {"near": "بحر", "guests": 4}
KINDS = {
    "same": (call(WANTED, "f"), "TTTTT", (2, 0, 0)),
    "other order": ('{"arguments": {"guests": 4, "near": "بحر"}, "name": "f"}', "TTTTT", (2, 0, 0)),
    "same number": (call(WANTED | {"guests": 4.0}, "f"), "TTTTT", (2, 0, 0)),
    "other tool": (call(WANTED, "g"), "TTTFT", (2, 0, 0)),
    "less": (call({"guests": 4}, "f"), "TTTTF", (1, 0, 1)),
    "more": (call(WANTED | {"late": True}, "f"), "TTTTF", (2, 1, 0)),
    "other value": (call(WANTED | {"near": "جبل"}, "f"), "TTTTF", (2, 0, 0)),
    "cut off": (call(WANTED, "f")[:20], "FFFFF", (0, 0, 2)),
    "refusal": ("null", "TTFFF", (0, 0, 2)),
    "no call's shape": ('["f"]', "TFFFF", (0, 0, 2)),
}
#: The same for a wanted refusal; no arguments to judge.
REFUSED = {"refusal": ("null", "TTTT"), "call": (call(WANTED, "f"), "TTFF"), "text": ('"no"', "TFFF")}


def test_counts_of_every_mixture(spark):
    """Rows drawn from all kinds: the 15 counts and 11 rates are those of adding the kinds up."""
    rng = random.Random(4)
    drawn = [(True, *KINDS[rng.choice(list(KINDS))]) for _ in range(70)] + [(False, *REFUSED[rng.choice(list(REFUSED))], (0, 0, 0)) for _ in range(30)]
    rng.shuffle(drawn)
    ex = spark.createDataFrame([(str(i), wanted, "f" if wanted else None, json.dumps(WANTED, ensure_ascii=False) if wanted else None, "d", i) for i, (wanted, *_) in enumerate(drawn)], EX)
    pr = spark.createDataFrame([(str(i), text, 1.0, None) for i, (_, text, *_) in enumerate(drawn)], PR)
    counts = S.score_counts(S.score_examples(ex, pr, keep=("ord", "domain")))
    n = lambda which, at: sum(flags[at] == "T" for wanted, _, flags, _ in drawn if which in (None, wanted))
    both = lambda wanted, *at: sum(w == wanted and all(f[i] == "T" for i in at) for w, _, f, _ in drawn)
    keys = [sum(k[i] for w, _, _, k in drawn if w) for i in range(3)]
    pos, neg = sum(w for w, *_ in drawn), sum(not w for w, *_ in drawn)
    want = [len(drawn), pos, neg, n(None, 0), n(None, 1), n(None, 2), n(True, 3), n(True, 4), both(True, 3, 4), both(True, 3, 4) + n(False, 3), n(False, 3), sum(f == "TTFF" and not w for w, _, f, _ in drawn), *keys]
    row = counts.collect()[0]
    assert list(row) == want
    rates = list(S.score_rates(counts).collect()[0])
    tp, fp, fn = keys
    assert rates == pytest.approx([want[3] / 100, want[4] / 100, want[5] / 100, want[6] / pos, want[7] / pos, want[8] / pos, tp / (tp + fp), tp / (tp + fn), 2 * tp / (2 * tp + fp + fn), want[10] / neg, want[11] / neg])


def test_golden_counts(spark):
    """The counts of a set of nine wanted calls and three refusals, of which four are right."""
    rows = ["same", "other order", "same", "other tool", "less", "more", "other value", "cut off", "refusal"]
    one = {"near": "بحر"}
    args = [WANTED, WANTED, one, one, WANTED, one, one, one, one]
    texts = [call(WANTED, "f"), KINDS["other order"][0], call(one, "f"), call(one, "g"), call({"guests": 4}, "f"), call(one | {"late": 1}, "f"), call({"near": "جبل"}, "f"), call(one, "f")[:12], "null"]
    ex = spark.createDataFrame([(r + str(i), True, "f", json.dumps(a, ensure_ascii=False), "d", i) for i, (r, a) in enumerate(zip(rows, args, strict=True))] + [(k, False, None, None, "d", 9 + i) for i, k in enumerate(REFUSED)], EX)
    pr = spark.createDataFrame([(r + str(i), t, 1.0, None) for i, (r, t) in enumerate(zip(rows, texts, strict=True))] + [(k, t, 1.0, None) for k, (t, _) in REFUSED.items()], PR)
    assert list(S.score_counts(S.score_examples(ex, pr)).collect()[0]) == [12, 9, 3, 11, 10, 8, 6, 4, 3, 4, 1, 1, 9, 1, 3]


def test_empty_denominators_are_zero(spark):
    rates = S.score_rates(S.score_counts(scored(spark, [(None, "null")]))).collect()[0]
    assert rates.tool_name_accuracy == 0.0 and rates.argument_key_f1 == 0.0 and rates.negative_case_accuracy == 1.0


#: What stands in a block or alone: what it is. A call, a refusal, other JSON, or no strict JSON.
CONTENT = {'{"name": "f", "arguments": {}}': "call", "null": "null", "7": "other", '["f"]': "other", "{}": "other", '{"name": "f", "arguments": {}, "id": 1}': "other", '{"name": " ", "arguments": {}}': "other", '{"name": "f"': "broken", '{"name": "f", "name": "f", "arguments": {}}': "broken", '{"name": "f", "arguments": {"x": NaN}}': "broken", "": "broken"}
#: How blocks can stand in a text, and whether there is one whole block.
FRAMES = {"<tool_call>{}</tool_call>": True, "I look.\n<tool_call>\n{}\n</tool_call> Done.": True, "<tool_call>{}": False, "{}</tool_call>": False, "</tool_call>{}<tool_call>": False, "<tool_call>{0}</tool_call><tool_call>{0}</tool_call>": False, '<tool_call id="1">{}</tool_call>': False, "<tool_call>{}</tool_call >": False}
PROSE = {"Which one?": True, "نعم": True, "`f`": False, '"quoted" start': False, "[see] here": False, "{so}": False, "<b>no</b>": False, "  padded prose ": True}


def said(text):
    out = parse_response(text, "tagged")
    return out["parse_success"], out["valid"], out["is_call"], out["parse_error"] is not None


def test_tagged_responses_by_grammar():
    """Every content in every frame: only one whole block around a call object is a call; nothing else between tags is taken for anything."""
    for frame, whole in FRAMES.items():
        for content, kind in CONTENT.items():
            text, json_object = frame.format(content), content.startswith("{") and kind != "broken"
            want = (True, True, True, False) if whole and kind == "call" else (whole and json_object, False, False, True)
            assert said(text) == want, text
    for content, kind in CONTENT.items():  # without tags
        assert said(content) == {"call": (True, True, True, False), "null": (True, True, False, False), "other": (True, False, False, True), "broken": (False, False, False, True)}[kind], content
    for text, fine in PROSE.items():
        assert said(text) == (False, fine, False, not fine), text


def test_prose_counts_as_refusal_only_where_tagged(spark):
    for output_format, right in (("tagged", True), ("json", False)):
        row = scored(spark, [(None, "Which one?")], output_format).collect()[0]
        assert (row.exact_match, row.valid_structured_output, row.parse_error is None) == (right, False, right)


@pytest.mark.parametrize(("text", "success", "valid", "error"), [
    ("123 apples", False, True, False), ("123", True, False, True), ("NaN foo", False, False, True), ("﻿{}", False, True, False), ('{"name":"t","arguments":{"a":1e999}}', True, False, True), ("null", True, True, False),
])
def test_prose_numbers_and_overflow(text, success, valid, error):
    out = parse_response(text, "tagged")
    assert (out["parse_success"], out["valid"], out["parse_error"] is not None) == (success, valid, error)


def test_duplicate_key_is_named():
    assert parse_response('{"name":"w","arguments":{"city":1,"city":2}}', "json")["parse_error"] == "duplicate JSON key: city"


def test_three_equalities():
    assert scoring(3) == scoring(3.0) != scoring(True) and scoring({"a": 1, "b": [1.50]}) == scoring({"b": [1.5], "a": 1.0}) and scoring(-0.0) == scoring(0)
    assert scoring(10**40 + 1) != scoring(10**40) and scoring("a ") != scoring("a") and scoring([1, 2]) != scoring([2, 1])
    assert canonical(25) != canonical(25.0) and canonical({"b": "é", "a": 1}) == '{"a":1,"b":"é"}'
    assert loose(True) == loose(1) == loose(1.0) != loose("1")


@pytest.mark.parametrize(("wanted", "got", "right"), [({"n": 3}, {"n": 3.0}, True), ({"n": 3}, {"n": True}, False), ({"n": True}, {"n": 1}, False), ({"c": "عَمَّان"}, {"c": "عمان"}, False), ({"c": "a"}, {"c": " a "}, False)])
def test_value_equality(spark, wanted, got, right):
    assert scored(spark, [(json.dumps(wanted), call(got))]).collect()[0].exact_match is right


def test_id_checks(spark):
    ex = spark.createDataFrame([("a", False, None, None, "d", 0), ("b", False, None, None, "d", 1)], EX)
    with pytest.raises(ValueError, match="IDs must match"):
        S.score_examples(ex, spark.createDataFrame([("a", "null", 1.0, None)], PR))
    with pytest.raises(ValueError, match="duplicate"):
        S.score_examples(ex, spark.createDataFrame([("a", "null", 1.0, None)] * 2 + [("b", "null", 1.0, None)], PR))
    with pytest.raises(ValueError, match="output_format"):
        S.score_examples(ex, spark.createDataFrame([("a", "null", 1.0, None)], PR), output_format="xml", check=False)


def test_categories_and_totals(spark):
    rows = scored(spark, [(None, "null"), (None, '"x"')])
    found = S.category_accuracy(rows).collect()
    assert [(r.domain, r.correct, r.total) for r in found] == [("d", 1, 2)]
    pr = spark.createDataFrame([("a", "", 1.5, None), ("b", "", 2.0, 7.0)], PR)
    assert tuple(S.inference_totals(pr).collect()[0]) == (3.5, 7.0)
    with pytest.raises(Exception, match="no predictions"):
        S.inference_totals(pr.limit(0)).collect()


@pytest.mark.parametrize(("exact", "no_call", "english", "complete", "success"), [(0.85, 0.9, 0.78, True, True), (0.85, 0.9, 0.77, True, False), (0.85, 0.9, 0.78, False, None), (0.85, 0.89, 0.78, True, False), (0.85, 0.9, None, True, None)])
def test_verdict_boundaries(spark, exact, no_call, english, complete, success):
    rates = spark.createDataFrame([("base", 0.8, 0.9), ("adapter", exact, no_call)], "variant string, exact_tool_call_accuracy double, negative_case_accuracy double")
    other = spark.createDataFrame([("base", 0.8), ("adapter", english)], "variant string, accuracy double") if english else None
    assert comparison(rates, other, complete=complete).collect()[0].success is success


def test_published_verdict(spark):
    rates = spark.createDataFrame([("base", 58 / 70, 17 / 30), ("adapter", 53 / 70, 17 / 30)], "variant string, exact_tool_call_accuracy double, negative_case_accuracy double")
    english = spark.createDataFrame([("base", 469 / 500), ("adapter", 457 / 500)], "variant string, accuracy double")
    row = comparison(rates, english, complete=True).collect()[0]
    assert row.call_change_percentage_points == pytest.approx(-7.142857) and row.relative_error_reduction == pytest.approx(-5 / 12) and row.english_change_percentage_points == pytest.approx(-2.4) and row.success is False


def test_perfect_base_has_no_relative(spark):
    rates = spark.createDataFrame([("base", 1.0, 1.0), ("adapter", 1.0, 1.0)], "variant string, exact_tool_call_accuracy double, negative_case_accuracy double")
    assert comparison(rates, complete=False).select(F.col("relative_error_reduction")).collect()[0][0] is None
