"""Codebooks against Lloyd's rounds with every distance computed, in Python's whole numbers."""

import hashlib
import math
import random
from pathlib import Path

import pyarrow.parquet as pq
import pytest

from callgrove.llm.vector_codes import largest, op13, vector_codes

DDL = "vec_id long, embedding array<double>, label int, code string, moved long"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, y, "theirs", 5) for i, v, y in rows], DDL).repartition(3)


def brute(rows, parts=8, entries=16, rounds=6, scale=4096):
    good = [(i, v, y) for i, v, y in rows if v and len(v) % parts == 0 and all(x is not None and math.isfinite(x) for x in v)]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not good:
        return {}, None
    good = [r for r in good if len(r[1]) == len(good[0][1])]
    most = largest(len(good[0][1]))
    width = len(good[0][1]) // parts
    whole = [[max(-most, min(most, math.floor(scale * x))) for x in v] for _, v, _ in good]
    cut = [[tuple(w[p * width : (p + 1) * width]) for p in range(parts)] for w in whole]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def far(a, b):
        return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def codes():
        return [[min(range(len(books[p])), key=lambda e, p=p, c=c: (far(c[p], books[p][e]), e)) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        at = codes()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [c[p] for c, k in zip(cut, at, strict=True) if k[p] == e]
                if own:
                    books[p][e] = tuple(sum(x) // len(own) for x in zip(*own, strict=True))
    at = codes()
    errors = [sum(far(c[p], books[p][k[p]]) for p in range(parts)) for c, k in zip(cut, at, strict=True)]
    total = {}
    for (_, _, y), e in zip(good, errors, strict=True):
        total[y] = total.get(y, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((str(i), "".join(f"{x:02x}" for x in k), e, total[y]) for (i, _, y), k, e in zip(good, at, errors, strict=True)), sha


def got(df):
    rows = df.collect()
    return sorted((str(r.vec_id), r.code, r.error, r.label_error) for r in rows), {r.codebooks_sha256 for r in rows}


@pytest.mark.parametrize("kind", ["spread", "ties", "clumps"])
def test_rounds_are_those_of_brute_force(spark, kind):
    rng = random.Random(kind)
    heart = [[rng.gauss(0, 0.4) for _ in range(16)] for _ in range(5)]
    make = {
        "spread": lambda: [rng.gauss(0, 0.3) for _ in range(16)],
        "ties": lambda: [rng.randrange(-2, 3) / 4096 for _ in range(16)],  # many equal distances, many equal parts
        "clumps": lambda: [x + rng.gauss(0, 0.01) for x in rng.choice(heart)],
    }[kind]
    rows = [(i, make(), rng.choice([0, 1, 2, None])) for i in rng.sample(range(2000), 300)]
    for groups in (1, 4, 16):
        want, sha = brute(rows)
        assert got(vector_codes(frame(spark, rows), groups=groups)) == (want, {sha})


def test_bounds_spare_distances(spark):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(32)], 0) for i in range(2000)]
    looked: list[int] = []
    vector_codes(frame(spark, rows), looked=looked).count()
    assert len(looked) == 6 and looked[0] == 2000 * 8 * 16
    assert max(looked[1:]) < looked[0] and looked[-1] < 0.7 * looked[0]


def test_odd_vectors(spark):
    rng = random.Random(2)
    nan, inf = float("nan"), float("inf")
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)], i % 2) for i in range(40)]
    rows += [(None, [0.1] * 8, None), (7, [0.2] * 8, 1), (7, [0.2] * 8, 1), (100, None, 0), (101, [], 0), (102, [0.1] * 7, 0), (103, [0.1] * 16, 0), (104, [0.1] * 7 + [nan], 0), (105, [inf] + [0.0] * 7, 0), (106, [None] + [0.0] * 7, 0), (107, [1e300, -1e300, 3e38, -0.0, 1e-320, 5e4, -5e4, 0.0], 1), (108, [0.0] * 8, 0)]
    want, sha = brute(rows)
    assert got(vector_codes(frame(spark, rows))) == (want, {sha})


def test_few_and_no_vectors(spark):
    rows = [(3, [0.5] * 8, None), (1, [0.25, -0.25] * 4, 4), (1, [0.25, -0.25] * 4, 4)]
    want, sha = brute(rows)
    assert got(vector_codes(frame(spark, rows))) == (want, {sha})
    for none in ([], [(1, None, 1), (2, [1.0], 1)]):
        empty = vector_codes(frame(spark, none) if none else frame(spark, rows).limit(0))
        assert empty.count() == 0 and empty.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]


def test_given_table(spark, sf_dir):
    table = pq.read_table(Path(sf_dir) / "embeddings.parquet").to_pylist()
    want, sha = brute([(r["vec_id"], r["embedding"], r["label"]) for r in table])
    assert got(op13(spark, sf_dir)) == (want, {sha})
