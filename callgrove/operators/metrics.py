"""Metrics of one's own over any number of rows: a state that is begun, fed with Arrow batches, merged and finished.

Each task feeds one state with its rows; states are merged in rounds of ever fewer tasks, and the last of them finishes. Only states move: they are pickled, at most
``MAX_STATE_BYTES`` each, and a task takes them one after another. The driver sees the finished answer alone. A lost executor repeats its tasks.
"""

from __future__ import annotations

import json
import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Of one pickled state; a larger one is an error, as it would grow with the rows.
MAX_STATE_BYTES = 8 << 20


@dataclass(frozen=True)
class Metric:
    """``merge`` has to be associative and commutative, with ``init()`` as its neutral state; then the answer doesn't depend on how rows are dealt to tasks.

    init: () -> state. update: (state, batch) -> state. merge: (state, state) -> state. finish: state -> a JSON value.
    """

    init: Callable[[], Any]
    update: Callable[[Any, pa.RecordBatch], Any]
    merge: Callable[[Any, Any], Any]
    finish: Callable[[Any], Any]


def _packed(state: Any, most: int) -> bytes:
    data = pickle.dumps(state)
    if len(data) > most:
        raise ValueError(f"a metric's state takes {len(data)} bytes, more than {most}")
    return data


def _one(data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["state"])


def aggregated(rows: DataFrame, metric: Metric, *, fan: int = 16, most: int = MAX_STATE_BYTES) -> DataFrame:
    """One row (result): the metric's answer over ``rows`` as JSON text; without rows that of ``init()``. Lazy.

    fan: how many states a task merges in a round, as a rule; more where ``rows`` has more partitions than ``spark.sql.shuffle.partitions``.
    """

    def fed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, any_ = metric.init(), False
        for batch in batches:
            state, any_ = metric.update(state, batch), True
        if any_:
            yield _one(_packed(state, most))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            for data in batch.column(0):
                more = pickle.loads(data.as_py())
                state = more if state is None else metric.merge(state, more)
        if state is not None:
            yield _one(_packed(state, most))

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in merged(batches):
            yield pa.RecordBatch.from_arrays([pa.array([json.dumps(metric.finish(pickle.loads(batch.column(0)[0].as_py())), ensure_ascii=False)])], names=["result"])

    states = rows.mapInArrow(fed, "state binary").union(rows.sparkSession.range(1).select(F.lit(_packed(metric.init(), most)).alias("state")))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while tasks > 1:
        tasks = -(-tasks // fan)
        if tasks > 1:
            states = states.repartition(tasks).mapInArrow(merged, "state binary")
    return states.repartition(1).mapInArrow(finished, "result string")


def metric_of(rows: DataFrame, metric: Metric, **options: int) -> Any:
    """The answer itself."""
    return json.loads(aggregated(rows, metric, **options).first().result)


def member_means(column: str = "result") -> Metric:
    """Of each numeric or boolean top-level member of JSON objects: {member: {"n": rows that have it, "mean": their mean}}.

    Sums are exact fractions, so that the last digit doesn't depend on the order either. Other members, null texts and texts that are no object count for nothing; numbers that
    aren't finite are an error.
    """

    def update(state: dict, batch: pa.RecordBatch) -> dict:
        for text in batch.column(batch.schema.get_field_index(column)).to_pylist():
            found = None if text is None else json.loads(text)
            for name, value in found.items() if isinstance(found, dict) else ():
                if isinstance(value, bool | int | float):
                    if not math.isfinite(value):
                        raise ValueError(f"{name} is not finite")
                    n, total = state.get(name, (0, Fraction()))
                    state[name] = n + 1, total + Fraction(value)
        return state

    def merge(a: dict, b: dict) -> dict:
        return {k: (a.get(k, (0, 0))[0] + b.get(k, (0, 0))[0], a.get(k, (0, Fraction()))[1] + b.get(k, (0, Fraction()))[1]) for k in a.keys() | b.keys()}

    return Metric(dict, update, merge, lambda state: {k: {"n": n, "mean": float(total / n)} for k, (n, total) in sorted(state.items())})
