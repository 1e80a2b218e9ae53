"""Rows appended durably to a folder on any file system: parts, and a log that says which of them count.

A batch is written as a part of its own (by as many tasks as it has partitions), and then an entry of the log with the next number is published by a rename that fails if the
number is taken. A part counts once its entry stands; whatever a writer that died left before that is never read. Entries count up to the first missing number, so a reader sees the
longest prefix of whole batches, and of two writers only one gets a number.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Store


class CommitLog:
    def __init__(self, store: Store, name: str):
        self.store, self.name = store, name

    def exists(self) -> bool:
        return self.store.exists(f"{self.name}/_log")

    def entries(self) -> list[dict]:
        """Of all batches that count, in order."""
        there = set(self.store.names(f"{self.name}/_log/*.json")) if self.exists() else set()
        out = []
        while (file := f"{len(out):06d}.json") in there:
            out.append(json.loads(self.store.read(f"{self.name}/_log/{file}")))
        return out

    def paths(self) -> list[str]:
        """The parts that count; their names sort in the order of commits."""
        return [self.store.path(f"{self.name}/{e['part']}") for e in self.entries()]

    def append(self, rows: DataFrame, order: str, expected: int | None = None) -> int:
        """Commits (order, value) as lines in this order; returns how many. expected: the log's length when the batch was made; another one means another writer."""
        number = len(self.entries())
        if expected is not None and expected != number:
            raise ValueError(f"{self.store.path(self.name)} has {number} batches, not {expected}: there is another writer")
        part = f"part-{number:06d}-{uuid.uuid4().hex[:12]}"
        tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        where = self.store.path(f"{self.name}/{part}")
        rows.select(order, "value").repartitionByRange(tasks, order).sortWithinPartitions(order).select("value").write.text(where)
        n = rows.sparkSession.read.text(where).agg(F.count("*")).first()[0]
        self.store.publish(f"{self.name}/_log/{number:06d}.json", json.dumps({"part": part, "rows": n}).encode())
        return n
