"""Ordered lines in parts: the bytes of the one file, whatever the parts; their manifest; the corpus writer on a URI."""

import hashlib

import pytest
from pyspark.sql import functions as F

from callgrove.sources.ordered import part_paths, write_ordered
from callgrove.sources.store import Store


def check(store, name, manifest, rows):
    want = [(None if o is None else o, (v or "").encode() + b"\n") for o, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))]
    got = [open(p.removeprefix("file:"), "rb").read() for p in part_paths(store, name)]
    assert b"".join(got) == b"".join(line for _, line in want)
    assert [hashlib.sha256(g).hexdigest() for g in got] == [p["sha256"] for p in manifest["parts"]] and [len(g) for g in got] == [p["bytes"] for p in manifest["parts"]]
    at = 0
    for part in manifest["parts"]:
        assert (part["first"], part["last"]) == (want[at][0], want[at + part["lines"] - 1][0])
        at += part["lines"]
    assert at == len(rows) == manifest["lines"] and manifest == store.document(f"{name}/_manifest.json")
    whole = store.concatenate(part_paths(store, name), f"{name}.txt")
    assert whole == hashlib.sha256(b"".join(got)).hexdigest() == store.sha256(f"{name}.txt") == store.sha256(*[f"{name}/{p['file']}" for p in manifest["parts"]])


@pytest.mark.parametrize("tasks", [1, 3, 20])
def test_parts_are_the_one_file(spark, tmp_path, tasks):
    """Ties, nulls, empty and non-ASCII values, negative keys; more tasks than ranges."""
    rows = [((i * 37) % 200 - 50, f"é{i}") for i in range(300)] + [(7, None), (7, ""), (None, "first"), (2**40, "last")]
    store = Store(spark, "file:" + str(tmp_path))
    frame = spark.createDataFrame(rows, "ord long, value string").repartition(5)
    check(store, "out", write_ordered(frame, store, "out", tasks=tasks), rows)
    with pytest.raises(ValueError, match="already"):
        write_ordered(frame, store, "out")


def test_long_parts_keep_their_order(spark, tmp_path):
    """Parts of many batches."""
    store = Store(spark, str(tmp_path))
    found = write_ordered(spark.range(200_000).select(F.pmod(F.col("id") * 7919, F.lit(200_000)).alias("k"), F.lpad(F.pmod(F.col("id") * 7919, F.lit(200_000)).cast("string"), 6, "0").alias("v")), store, "n", order="k", value="v", tasks=2)
    store.concatenate(part_paths(store, "n"), "n.txt")
    assert (tmp_path / "n.txt").read_text() == "".join(f"{i:06d}\n" for i in range(200_000)) and found["bytes"] == 1_400_000 and len(found["parts"]) == 2


def test_no_rows(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert write_ordered(spark.createDataFrame([], "ord long, value string"), store, "none")["parts"] == []
    assert part_paths(store, "none") == [] and store.concatenate([], "none.txt") == hashlib.sha256(b"").hexdigest() and (tmp_path / "none.txt").read_bytes() == b""
