"""Rules as data: a walker over nested values, and the two rule tables of tool schemas (a subset of JSON Schema) and of values against them."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import date, time
from typing import Any, NamedTuple

from .jsonx import loose


class Rule(NamedTuple):
    """``holds`` of a node, or else it ``says`` (a text, or a function of the node). ``late``: asked after what is below the node."""

    holds: Callable[[Any], bool]
    says: str | Callable[[Any], str]
    late: bool = False


def first_broken(node: Any, rules: Iterable[Rule], below: Callable[[Any], Iterable[Any]]) -> str | None:
    """The message of the first broken rule in a walk through ``node`` and what is below it; None if all hold."""
    for late in (False, True):
        if late:
            for child in below(node):
                if (found := first_broken(child, rules, below)) is not None:
                    return found
        for rule in rules:
            if rule.late == late and not rule.holds(node):
                return rule.says if isinstance(rule.says, str) else rule.says(node)
    return None


def _number(value: Any) -> bool:
    return isinstance(value, int | float) and not isinstance(value, bool)


#: What a value of each type is; the keys are the types that a schema can name.
TYPES: dict[str, Callable[[Any], bool]] = {
    "string": lambda v: isinstance(v, str),
    "integer": lambda v: _number(v) and isinstance(v, int),
    "number": _number,
    "boolean": lambda v: v is True or v is False,
    "null": lambda v: v is None,
    "array": lambda v: isinstance(v, list),
    "object": lambda v: isinstance(v, dict),
}
# How dates and times are written, by the name of the format.
FORMATS: dict[str, tuple[str, Callable[[str], str]]] = {
    "date": ("YYYY-MM-DD", lambda text: date.fromisoformat(text).isoformat()),
    "time": ("HH:MM", lambda text: time.fromisoformat(text).strftime("%H:%M")),
}


def _is(kind: str, test: Callable[[dict], bool]) -> Callable[[dict], bool]:
    """A test for schemas of one type only."""
    return lambda schema: schema.get("type") != kind or test(schema)


def _if(member: str, test: Callable[[dict, Any], bool]) -> Callable[[dict], bool]:
    """A test for schemas that have a member."""
    return lambda schema: member not in schema or test(schema, schema[member])


def _declared(schema: dict) -> bool:
    names = schema.get("required", [])
    return isinstance(names, list) and all(isinstance(n, str) for n in names) and sorted(set(names)) == sorted(names) and set(names) <= set(schema["properties"])


# The messages of both tables.
SCHEMA_RULES = (
    Rule(lambda s: isinstance(s, dict), "tool schema must be an object"),
    Rule(lambda s: isinstance(s.get("type"), str) and s["type"] in TYPES, lambda s: f"unsupported tool schema type: {s.get('type')}"),
    Rule(_is("object", lambda s: isinstance(s.get("properties"), dict) and all(map(str.strip, s["properties"]))), "object schema needs named properties"),
    Rule(_is("object", _declared), "required keys must be unique declared properties", late=True),
    Rule(_is("object", lambda s: s.get("additionalProperties") is False), "object schema must forbid additionalProperties", late=True),
    Rule(_if("description", lambda _, v: isinstance(v, str)), "schema description must be a string", late=True),
    Rule(_if("enum", lambda _, v: isinstance(v, list) and v != []), "schema enum must be a non-empty list", late=True),
    Rule(_if("format", lambda s, v: s["type"] == "string" and isinstance(v, str) and v in FORMATS), "unsupported schema format", late=True),
    Rule(_if("minimum", lambda s, v: s["type"] in ("integer", "number") and _number(v)), "invalid schema minimum", late=True),
)


def _schemas_below(schema: dict) -> Iterable[Any]:
    return {"object": lambda: schema["properties"].values(), "array": lambda: [schema.get("items")]}.get(schema["type"], list)()


def schema_error(schema: Any) -> str | None:
    """Why a parameter schema is outside the supported subset; None if it isn't."""
    return first_broken(schema, SCHEMA_RULES, _schemas_below)


class Place(NamedTuple):
    """A value with its schema and the path to it."""

    value: Any
    schema: dict
    path: str


def _written(place: Place) -> str | None:
    """What is wrong with a date's or time's form."""
    if "format" not in place.schema:
        return None
    form, write = FORMATS[place.schema["format"]]
    try:
        return None if write(place.value) == place.value else f"{place.path} must use {form}"
    except ValueError as error:
        return str(error)


VALUE_RULES = (
    Rule(lambda p: TYPES[p.schema["type"]](p.value) and ("enum" not in p.schema or loose(p.value) in map(loose, p.schema["enum"])), lambda p: f"{p.path} violates tool schema"),
    Rule(lambda p: "minimum" not in p.schema or p.value >= p.schema["minimum"], lambda p: f"{p.path} is below schema minimum"),
    Rule(lambda p: _written(p) is None, lambda p: str(_written(p))),
    Rule(lambda p: p.schema["type"] != "object" or set(p.value) <= set(p.schema["properties"]), lambda p: f"{p.path} has undeclared keys"),
    Rule(lambda p: p.schema["type"] != "object" or set(p.schema.get("required", ())) <= set(p.value), lambda p: f"{p.path} omits required keys"),
)


def _values_below(place: Place) -> Iterable[Place]:
    if place.schema["type"] == "array":
        return [Place(item, place.schema["items"], place.path) for item in place.value]
    if place.schema["type"] == "object":
        return [Place(item, place.schema["properties"][name], f"{place.path}.{name}") for name, item in place.value.items()]
    return []


def value_error(value: Any, schema: dict, path: str) -> str | None:
    """Why a value doesn't fit a supported schema; None if it does."""
    return first_broken(Place(value, schema, path), VALUE_RULES, _values_below)
