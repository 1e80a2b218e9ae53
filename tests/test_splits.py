"""Files in splits of any size against the same files read at once."""

import io
import json
import random

import pytest

from callgrove.functions.jsonx import canonical, strict_loads
from callgrove.sources import readers, splits


@pytest.fixture
def cuts(spark):
    """Sets the size of splits; the usual one comes back."""
    keys = {"spark.sql.files.maxPartitionBytes": spark.conf.get("spark.sql.files.maxPartitionBytes"), "spark.sql.files.openCostInBytes": spark.conf.get("spark.sql.files.openCostInBytes"), "spark.sql.files.minPartitionNum": None}

    def cut(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        spark.conf.set("spark.sql.files.minPartitionNum", "1")

    yield cut
    for key, value in keys.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)



def universal(raw):
    """Lines as Python's universal newlines have them."""
    return [x.removesuffix("\n") for x in io.TextIOWrapper(io.BytesIO(raw), encoding="utf-8", newline=None)]


RAW = [b"", b"\n", b"a", b"a\n", b"a\r\n", b"a\rb", b"a\r\r\n\nb\r", "﻿é\nü\r\n\U0001f642\U0001f642\r\rx\x85y z\n".encode(), b"\r\n" * 9, ("long " * 200 + "\n").encode() * 3]


@pytest.mark.parametrize("size", [24, 90, 1 << 20])
def test_numbered_lines(spark, tmp_path, cuts, size):
    cuts(size)
    rng = random.Random(size)
    texts = [*RAW, "".join(rng.choice(["a", "é", "\U0001f642", "\n", "\r", "\r\n", " ", "語"]) for _ in range(150)).encode()]
    for k, raw in enumerate(texts[:: 1 if size > 24 else 3]):
        path = tmp_path / f"{size}-{k}.txt"
        path.write_bytes(raw)
        got = sorted((r.line, r.value) for r in splits.numbered(spark, str(path)).collect())
        assert got == list(enumerate(universal(raw), 1)), raw


def test_lines_of_a_folder_go_on_and_bad_bytes_are_an_error(spark, tmp_path, cuts):
    cuts(16)
    for name, raw in (("b", b"3\n4"), ("a", b"1\n2\n"), ("c", b"5\n")):
        (tmp_path / "f").mkdir(exist_ok=True)
        (tmp_path / "f" / name).write_bytes(raw)
    assert sorted((r.line, r.value) for r in splits.numbered(spark, str(tmp_path / "f")).collect()) == [(i, str(i)) for i in range(1, 6)]
    (tmp_path / "bad").write_bytes(b"fine\n\xff\xfe\nfine\n")
    with pytest.raises(Exception, match="invalid UTF-8"):
        splits.numbered(spark, str(tmp_path / "bad")).collect()


def test_a_larger_file_takes_many_tasks(spark, tmp_path, cuts):
    path = tmp_path / "large.txt"
    path.write_bytes(b"".join(b"%d %s\r\n" % (i, b"x" * (i % 50)) for i in range(60_000)))
    cuts(1 << 17)
    found = splits.numbered(spark, str(path))
    assert found.rdd.getNumPartitions() > 10
    assert found.selectExpr("count(*) n", "count_if(cast(split(value, ' ')[0] as long) + 1 <> line) bad").first().asDict() == {"n": 60_000, "bad": 0}


# ---------------------------------------------------------------- JSON documents


def at_once(text):
    value = strict_loads(text)
    if isinstance(value, dict):
        assert all(isinstance(x, list) for x in value.values())
        value = [x for group in value.values() for x in group]
    assert isinstance(value, list) and all(isinstance(x, dict) for x in value)
    return [canonical(x) for x in value]


def random_value(rng, deep):
    kind = rng.randrange(7 if deep else 4)
    if kind < 2:
        return "".join(rng.choice(['"', "\\", "}", "{", "[", "]", ",", ":", "é", "\n", "a", "\U0001f642", "\\\\"]) for _ in range(rng.randrange(8)))
    if kind < 4:
        return rng.choice([1, -2.5, None, True, 10**20])
    return [random_value(rng, deep - 1) for _ in range(rng.randrange(4))] if kind == 4 else {f"k{i}" + rng.choice(["", '"', "}"]): random_value(rng, deep - 1) for i in range(rng.randrange(4))}


def random_document(rng):
    objects = lambda: [{"n": random_value(rng, 3), **random_object(rng)} for _ in range(rng.randrange(5))]
    value = objects() if rng.random() < 0.4 else {f"g{i}" + rng.choice(["", "[", '"', "\\"]): objects() for i in range(rng.randrange(5))}
    return json.dumps(value, ensure_ascii=rng.random() < 0.3, indent=rng.choice([None, None, 1])) + rng.choice(["", "\n", "  \n"])


def random_object(rng):
    return {f"m{i}": random_value(rng, 2) for i in range(rng.randrange(3))}


@pytest.mark.parametrize("seed", range(4))
def test_documents_are_cut_as_if_read_at_once(spark, tmp_path, cuts, seed):
    rng = random.Random(seed)
    size, chunk = rng.choice([(40, 1), (70, 20), (1 << 20, 1), (1 << 20, 1 << 20)])
    cuts(size)
    text = random_document(rng)
    path = tmp_path / "d.json"
    path.write_text(text, encoding="utf-8")
    got = sorted((r.ord, r.item) for r in splits.elements(spark, str(path), chunk=chunk).collect())
    assert got == list(enumerate(at_once(text))), text


def test_cuts_at_every_place(tmp_path):
    """The automaton alone: every way to enter a chunk, at every cut behind a closing brace, without Spark."""
    import numpy as np

    rng = random.Random(40)
    for _ in range(300):
        text = random_document(rng).encode()
        data = np.frombuffer(text, np.uint8)
        marks = splits._quotes(data)
        open_ = [int(m) % 2 for m in marks]
        places = [i + 1 for i, b in enumerate(text) if b == 0x7D]
        for a, b in zip([0, *places], [*places, len(text)], strict=True):
            if a < b:
                mine = splits._quotes(data[a:b]) + open_[a]
                assert (mine % 2).tolist() == open_[a:b]


@pytest.mark.parametrize(("text", "message"), [('"}"', "list or grouped"), ('{"a":{"b":1}}', "tool groups must be lists"), ('[{"a":1},2]', "list or grouped"), ('[{"a":1},]', "missing between commas"), ('{"a":[],"a":[{}]}', "duplicate JSON key: a"), ('[{"a":1,"a":2}]', "duplicate JSON key"), ('[{"a":1}', "complete JSON"), ('[{"a":1}]]', "JSON|Extra"), ('[{"a":1} {"b":2}]', "Extra data"), ('{"a":[{}],}', "JSON|Expecting|expected"), ('{"a":[{}] "b":[]}', "delimiter|Expecting"), ("[{}}", "JSON|delimiter|Expecting"), ("", "JSON|Expecting")])
def test_what_is_no_such_document(spark, tmp_path, cuts, text, message):
    cuts(1 << 20)
    path = tmp_path / "d.json"
    path.write_text(text, encoding="utf-8")
    with pytest.raises(Exception, match=message):
        splits.elements(spark, str(path), chunk=3).collect()


def test_empty_lists_have_no_number(spark, tmp_path, cuts):
    cuts(30)
    path = tmp_path / "d.json"
    path.write_text('{"a": [], "b": [{"x": 1}, {"x": 2}], "c": [ ], "d": [{"x": 3}]}', encoding="utf-8")
    assert sorted((r.ord, r.item) for r in splits.elements(spark, str(path), chunk=4).collect()) == [(0, '{"x":1}'), (1, '{"x":2}'), (2, '{"x":3}')]
    for text in ("[]", "{}", " [ ] ", '{"a":[]}'):
        path.write_text(text, encoding="utf-8")
        assert readers.document_items(spark, str(path)).count() == 0
