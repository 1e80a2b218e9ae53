"""Ordered lines written side by side: range-sorted part files whose names follow the order, and a manifest of their ranges, sizes and digests.

A task sorts a range of the order, and describes what it writes while it writes it: first and last key, lines, bytes, SHA-256. Both come from the same attempt of a task, so a task
that is repeated can't leave a description of other lines. The manifest is published last; without it a folder isn't whole. Its own digest is the SHA-256 over the parts' digests, in
order, as it can be made without reading the lines again; it is not that of the joined file, which ``Store.concatenate`` gives.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import Store

MANIFEST = "_manifest.json"


def write_ordered(rows: DataFrame, store: Store, name: str, *, order: str = "ord", value: str = "value", tasks: int | None = None) -> dict:
    """Writes ``value`` as lines in the order of the integer column ``order`` (equal ones by value) into a new folder of the store; returns the manifest.

    A null value is an empty line, a null order comes first. Without rows there are no parts. ``lines`` and ``bytes`` (of UTF-8, line ends included) are sums over the parts.
    """
    if store.exists(name):
        raise ValueError(f"{store.path(name)} is there already")
    spark = rows.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = T.StructType([T.StructField("at", T.LongType()), T.StructField("value", T.StringType()), T.StructField("kind", T.StringType())])

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, lines, size, first, last = hashlib.sha256(), 0, 0, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.column(0)
            first, last = at[0].as_py() if not lines else first, at[batch.num_rows - 1].as_py()
            for text in batch.column(1):
                line = (text.as_py() or "").encode() + b"\n"
                digest.update(line)
                size += len(line)
            lines += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(["lines"] * batch.num_rows)], names=schema.names)
        if lines:
            facts = {"part": TaskContext.get().partitionId(), "first": first, "last": last, "lines": lines, "bytes": size, "sha256": digest.hexdigest()}
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([json.dumps(facts)]), pa.array(["facts"])], names=schema.names)

    ranged = rows.select(F.col(order).cast("long").alias("at"), F.col(value).alias("value")).repartitionByRange(tasks, "at").sortWithinPartitions("at", "value")
    both = ranged.mapInArrow(described, schema).sortWithinPartitions("kind", "at", "value")
    both.select("value", "kind").write.partitionBy("kind").text(store.path(name))
    facts = []
    if store.names(f"{name}/kind=facts/part-*"):
        facts = sorted((json.loads(r.value) for r in spark.read.text(store.path(f"{name}/kind=facts")).collect()), key=lambda f: f["part"])  # one for each part
    files = {int(re.match(r"part-(\d+)", file)[1]): file for file in store.names(f"{name}/kind=lines/part-*")}
    parts = [{"file": f"kind=lines/{files[f['part']]}", **{k: v for k, v in f.items() if k != "part"}} for f in facts]
    found = {"parts": parts, "lines": sum(p["lines"] for p in parts), "bytes": sum(p["bytes"] for p in parts), "parts_sha256": hashlib.sha256("".join(p["sha256"] for p in parts).encode()).hexdigest()}
    store.put(f"{name}/{MANIFEST}", found)
    return found


def part_paths(store: Store, name: str) -> list[str]:
    """The whole paths of a folder's parts, in order; an error without a manifest."""
    return [store.path(f"{name}/{p['file']}") for p in store.document(f"{name}/{MANIFEST}")["parts"]]
