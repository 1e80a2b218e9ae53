"""Rows at ranks against a full sort."""

import random

import pytest
from pyspark.sql import functions as F

from callgrove.operators import ordinals


@pytest.mark.parametrize("kind", ["spread", "tied", "equal", "skewed"])
def test_rows_at_ranks(spark, monkeypatch, kind):
    """Small samples, so that ranges are uneven; keys with nulls, ties and a value that most rows have."""
    monkeypatch.setattr(ordinals, "_SIDE", 3)
    monkeypatch.setattr(ordinals, "_DRAWN", 4)
    rng = random.Random(kind)
    make = {"spread": lambda i: i * 7919 % 5000, "tied": lambda i: rng.choice([None, 1, 2, 3]), "equal": lambda i: 4, "skewed": lambda i: 100 if rng.random() < 0.9 else rng.randrange(300)}[kind]
    rows = [(make(i), rng.choice(["a", "b", None]), i, 1) for i in range(5000)]
    frame = spark.createDataFrame(rows, "k int, s string, i long, rank__x int").repartition(5)
    ranks = [0, 1, 77, 2500, 2501, 4998, 4999]
    got = {r.ord: r for r in ordinals.rows_at(frame, ranks, "k", "s").collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    assert {o: (r.k, r.s) for o, r in got.items()} == {o: order[o][:2] for o in ranks}
    assert len({r.i for r in got.values()}) == len(ranks)
    again = {r.ord: r.i for r in ordinals.rows_at(frame.repartition(2), ranks, "k", "s").collect()}
    assert again == {o: r.i for o, r in got.items()}


def test_ranks_are_checked_and_little_is_numbered(spark, monkeypatch):
    frame = spark.range(200_000).withColumn("k", F.col("id") * 31 % 200_003)
    seen = []
    monkeypatch.setattr(ordinals, "with_ordinals", lambda rows, *o, real=ordinals.with_ordinals, **k: seen.append(rows.count()) or real(rows, *o, **k))
    got = ordinals.rows_at(frame, [5, 100_000], "k").collect()
    want = sorted(i * 31 % 200_003 for i in range(200_000))
    assert {r.ord: r.k for r in got} == {5: want[5], 100_000: want[100_000]} and seen[0] < 3000
    with pytest.raises(ValueError, match="between 0 and"):
        ordinals.rows_at(frame, [200_000], "k")
    assert ordinals.rows_at(frame.limit(10), [], "k").count() == 0
