"""The validator of labelled sets. A sound set is made by rule; each rule then has an edit that breaks it and nothing before it."""

import json
import random
import re

import pytest

from callgrove.functions.rules import FORMATS, schema_error, value_error
from callgrove.operators import labelled as L

LETTERS = "ابتثجحخدذرزسشصضطظعغفقكلمنهوي"
PARAMETERS = {
    "type": "object",
    "properties": {"place": {"type": "string", "enum": ["north", "south"]}, "seats": {"type": "integer", "minimum": 2}, "when": {"type": "string", "format": "date"}},
    "required": ["place"],
    "additionalProperties": False,
}


def tool(name):
    return {"name": name, "description": f"{name} something", "parameters": json.loads(json.dumps(PARAMETERS))}


def sound(mode):
    """A valid set: line n has its own words, every category its quota."""
    out = []
    for n, category in enumerate(c for c in L.CATEGORIES for _ in range(L.QUOTA[mode])):
        calls = category not in L.NEGATIVE
        words = "".join(LETTERS[(n // 28**k) % 28] for k in range(3))
        row = {"id": f"case-{n:03}", "category": category, "dialect": L.DIALECTS[n % 6], "review_status": L.STATUS[mode], "user_utterance": f"{words} {words}", "available_tools": [tool("book"), tool("cancel")], "should_call_tool": calls}
        row |= {"expected_tool_name": "book" if calls else None, "expected_arguments": {"place": "north", "seats": 2 + n % 3} if calls else None}
        out.append(row if mode == "template" else row | {"language": "ar", "reference_date": "2027-03-04"})
    return out


@pytest.fixture
def write(tmp_path):
    def put(rows, end="\n"):
        path = tmp_path / "set.jsonl"
        path.write_text("".join((r if isinstance(r, str) else json.dumps(r, ensure_ascii=False)) + end for r in rows), encoding="utf-8")
        return str(path)

    return put


@pytest.mark.parametrize(("mode", "end"), [("template", "\n"), ("pilot", "\r\n"), ("draft", "\n"), ("final", "\n\n")])
def test_sound_sets(spark, write, mode, end):
    assert L.validate(spark, write(sound(mode), end), mode) == dict.fromkeys(L.CATEGORIES, L.QUOTA[mode])


def with_(**members):
    return lambda row: row | members


def without(member):
    return lambda row: {k: v for k, v in row.items() if k != member}


def first_tool(**members):
    return lambda row: row | {"available_tools": [row["available_tools"][0] | members, *row["available_tools"][1:]]}


def schema(**members):
    return first_tool(parameters=PARAMETERS | members)


#: rule, mode, edit of one row, what its message has
BROKEN = [
    (10, "template", lambda _: "{", "Expecting"),
    (10, "template", lambda _: "[1]", "row must be an object"),
    *[(n, "pilot", without(m), f"'{m}'") for n, m in ((20, "category"), (30, "dialect"), (40, "review_status"), (60, "reference_date"), (100, "user_utterance"), (200, "available_tools"), (L.EXAMPLE, "id"), (L.EXAMPLE + 1, "should_call_tool"), (L.EXAMPLE + 2, "expected_tool_name"), (L.EXAMPLE + 3, "expected_arguments"))],
    (21, "template", with_(category="sports"), "unknown category: sports"),
    (21, "template", with_(category=7), "unknown category: 7"),
    (31, "template", with_(dialect=None), "unknown dialect"),
    (41, "final", with_(review_status="draft_not_gold"), "native_speaker_reviewed"),
    (50, "draft", without("language"), "language must be ar"),
    (50, "template", with_(language="en"), "language must be ar"),
    (61, "pilot", with_(reference_date="4 March"), "Invalid isoformat"),
    (61, "pilot", with_(reference_date=20270304), "fromisoformat"),
    (L.DATE_FIXED, "pilot", with_(reference_date="2027-03-05"), "reference_date must be fixed"),
    (80, "final", with_(review_note="seen"), "cannot retain review_note"),
    (90, "template", with_(review_note="\t"), "review_note must be non-empty"),
    (101, "template", with_(user_utterance="latin only"), "Arabic text"),
    (L.SAME_UTTERANCE, "template", with_(user_utterance="ااا ااا"), "duplicate user_utterance"),
    (120, "draft", with_(user_utterance="سفر باجر"), "relative-date"),
    (201, "template", with_(available_tools={"book": 1}), "available_tools must be a list"),
    (202, "template", first_tool(extra=1), "name, description and parameters"),
    (202, "template", first_tool(name=""), "name must be"),
    (202, "template", first_tool(parameters=PARAMETERS | {"type": "array"}), "parameters.type"),
    (L.TOOLS, "template", schema(additionalProperties=True), "additionalProperties"),
    (L.TOOLS, "template", schema(required=["place", "place"]), "required keys"),
    (L.TOOLS, "template", schema(properties=PARAMETERS["properties"] | {"x": {"type": "list"}}), "unsupported tool schema type: list"),
    (L.TOOLS + 1, "template", first_tool(description="something else"), "tool definition changed: book"),
    (L.EXAMPLE + 10, "template", with_(id=" "), "id must be"),
    (L.EXAMPLE + 16, "template", with_(available_tools=[]), "available_tools must be"),
    (L.EXAMPLE + 17, "template", lambda r: r | {"available_tools": [r["available_tools"][0]] * 2}, "names must be unique"),
    (L.EXAMPLE + 18, "template", with_(should_call_tool="yes"), "must be a boolean"),
    (L.EXAMPLE + 21, "template", with_(expected_arguments=["north"]), "arguments must be an object"),
    (L.EXAMPLE + 22, "template", with_(expected_tool_name="cook"), "present in available_tools"),
    (L.EXAMPLE + 23, "template", with_(should_call_tool=False), "negative examples"),
    (L.SAME_ID, "template", with_(id="case-000"), "duplicate ID: case-000"),
    (L.AFTER, "template", with_(category="out_of_scope"), "positive/negative category"),
    (L.AFTER + 10, "pilot", lambda r: r | {"available_tools": r["available_tools"][:1]}, "competing"),
    (L.AFTER + 20, "template", with_(expected_arguments={"place": "north", "colour": "red"}), "not permitted"),
    (L.AFTER + 30, "template", with_(expected_arguments={"seats": 3}), "omit required"),
    (L.AFTER + 40, "template", with_(expected_arguments={"place": "west"}), "expected_arguments.place violates"),
    (L.AFTER + 40, "template", with_(expected_arguments={"place": "south", "seats": 1}), "seats is below"),
    (L.AFTER + 40, "template", with_(expected_arguments={"place": "south", "when": "20270304"}), "when must use YYYY-MM-DD"),
]


@pytest.mark.parametrize("mode", list(L.STATUS))
def test_each_rule_is_the_first_failure_of_its_row(spark, write, mode):
    """All edits of a mode in one file, a row each (the sound set repeated under other ids and words); nothing else fails."""
    edits = [x for x in BROKEN if x[1] == mode]
    rows = sound(mode)
    base = next(r for r in rows if r["should_call_tool"])
    more = [base | {"id": f"edit-{k}", "user_utterance": f"{base['user_utterance']} {'و' * (k + 1)}"} for k in range(len(edits))]
    lines = [*rows, *(edit(row) for row, (_, _, edit, _) in zip(more, edits, strict=True))]
    found = {}
    for v in L.violations(spark, write(lines), mode).orderBy("line", "rule").collect():
        found.setdefault(v.line, v)
    assert sorted(found) == list(range(len(rows) + 1, len(lines) + 1))
    for k, (rule, _, _, says) in enumerate(edits):
        got = found[len(rows) + 1 + k]
        assert got.rule == rule and says in got.message, (rule, says, got)


def test_least_line_then_least_rule_is_raised(spark, write):
    rows = sound("template")
    rows[6] |= {"dialect": "latin"}
    rows[3] |= {"user_utterance": "none", "dialect": "norse"}
    with pytest.raises(ValueError, match="^line 5: unknown dialect: norse$"):  # a blank line counts
        L.validate(spark, write(["", *rows]))


def test_quota_mode_and_bytes(spark, write, tmp_path):
    with pytest.raises(ValueError, match=re.escape("expected 1 per category, got {'out_of_scope': 0}")):
        L.validate(spark, write([r for r in sound("template") if r["category"] != "out_of_scope"]))
    with pytest.raises(ValueError, match="validation mode"):
        L.validate(spark, write(sound("template")), "gold")
    (tmp_path / "bad").write_bytes(b'{"id": "\xc3\x28"}\n')
    with pytest.raises(Exception, match="UTF-8"):
        L.validate(spark, str(tmp_path / "bad"))


def test_relative_days_are_whole_words(spark):
    said = {"غدا": True, "موعد غداً؟": True, "غداء": False, "ابكرة": False, "بكرة،": True, "x_بكرا": False, "": False}
    got = spark.createDataFrame([(t,) for t in said], "t string").selectExpr("t", f"t rlike '{L.RELATIVE_DAY}' as hit".replace("\\", "\\\\"))
    assert {r.t: r.hit for r in got.collect()} == said


def random_schema(rng, depth=0):
    kind = rng.choice(["string", "integer", "number", "boolean", "null", *(["array", "object"] if depth < 3 else [])])
    out = {"type": kind}
    if kind == "array":
        out["items"] = random_schema(rng, depth + 1)
    elif kind == "object":
        out["properties"] = {f"p{k}": random_schema(rng, depth + 1) for k in range(rng.randrange(4))}
        out |= {"required": [p for p in out["properties"] if rng.random() < 0.5], "additionalProperties": False}
    elif kind in ("integer", "number") and rng.random() < 0.5:
        out["minimum"] = rng.randrange(5)
    elif kind == "string" and rng.random() < 0.5:
        out["format"] = rng.choice(list(FORMATS))
    return out


def fitting(rng, s):
    if s["type"] == "array":
        return [fitting(rng, s["items"]) for _ in range(rng.randrange(3))]
    if s["type"] == "object":
        return {p: fitting(rng, c) for p, c in s["properties"].items() if p in s["required"] or rng.random() < 0.7}
    return {"string": {"date": "2027-03-04", "time": "07:30"}.get(s.get("format"), "text"), "integer": 7, "number": 7.5, "boolean": True, "null": None}[s["type"]]


def spoiled(rng, value, s):
    """A value that no longer fits, changed in one place."""
    if s["type"] == "object" and value and rng.random() < 0.7:
        p = rng.choice(list(value))
        return value | {p: spoiled(rng, value[p], s["properties"][p])}
    if s["type"] == "array" and value and rng.random() < 0.7:
        return [spoiled(rng, value[0], s["items"]), *value[1:]]
    if s["type"] == "object" and rng.random() < 0.5:
        return value | {"unknown": 1}
    if "minimum" in s and rng.random() < 0.5:
        return s["minimum"] - 1
    if "format" in s and rng.random() < 0.5:
        return rng.choice(["", "7:30", "2027-3-4", "073000", "20270304"])
    return {"boolean": 1, "integer": True, "number": False, "string": 5, "null": 0, "array": {}, "object": []}[s["type"]]


def test_random_schemas_and_values():
    rng = random.Random(7)
    for _ in range(600):
        s = random_schema(rng)
        assert schema_error(s) is None
        value = fitting(rng, s)
        assert value_error(value, s, "v") is None
        assert value_error(spoiled(rng, value, s), s, "v").startswith(("v", "Invalid isoformat"))


@pytest.mark.parametrize(
    ("broken", "says"),
    [(5, "must be an object"), ({}, "type: None"), ({"type": ["string"]}, "unsupported"), ({"type": "object", "properties": {" ": {"type": "null"}}, "additionalProperties": False}, "named properties"), ({"type": "array"}, "must be an object"), ({"type": "array", "items": {"type": "object", "properties": {}}}, "additionalProperties"), ({"type": "null", "description": 1}, "description"), ({"type": "null", "enum": []}, "enum"), ({"type": "integer", "format": "date"}, "format"), ({"type": "string", "minimum": 1}, "minimum"), ({"type": "number", "minimum": True}, "minimum")],
)
def test_unsupported_schemas(broken, says):
    assert says in schema_error(broken) and says in schema_error({"type": "array", "items": broken})


def test_quota_reports_zero_groups(spark):
    rows = spark.createDataFrame([("a",), ("a",)], "category string")
    dims = spark.createDataFrame([("a",), ("b",)], "category string")
    assert {(r.category, r.rows, r.ok) for r in L.category_quota(rows, dims, 2).collect()} == {("a", 2, True), ("b", 0, False)}
