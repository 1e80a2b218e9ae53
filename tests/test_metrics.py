"""Metrics from merged states: the same answer however rows are dealt, nothing without rows, states bounded."""

import json
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from callgrove.operators import metrics as M
from callgrove.operators import runs

TEXTS = ['{"a":0.1,"b":true}', '{"a":0.2,"c":"x"}', '{"a":1e300,"b":false}', None, "[1]", '{"a":-1e300}', '{"b":true,"d":{"a":9}}', "null", '{"a":3}'] * 40


def results(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, result string")


def test_means_do_not_depend_on_the_partitions(spark):
    rows = results(spark)
    found = [M.metric_of(dealt, M.member_means(), fan=fan) for dealt, fan in ((rows.coalesce(1), 16), (rows.repartition(7, "i"), 2), (rows.repartition(23), 3), (rows.orderBy(F.desc("i")), 16))]
    members = [json.loads(t) for t in TEXTS if t and t.startswith("{")]
    numbers = {k: [Fraction(m[k]) for m in members if k in m] for k in ("a", "b")}
    assert found == [{k: {"n": len(v), "mean": float(sum(v) / len(v))} for k, v in numbers.items()}] * 4


def test_no_rows(spark):
    assert M.metric_of(results(spark).limit(0), M.member_means()) == {}
    assert M.metric_of(results(spark).where("i < 0"), M.Metric(lambda: 0, lambda n, b: n + b.num_rows, lambda a, b: a + b, lambda n: {"n": n})) == {"n": 0}


def test_a_state_of_ones_own_is_merged_in_rounds(spark):
    """Distinct remainders and a maximum, over more partitions than a task merges."""
    metric = M.Metric(set, lambda s, b: s | {x % 11 for x in b.column("id").to_pylist()}, lambda a, b: a | b, sorted)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        answer = M.aggregated(spark.range(0, 5000, 1, 30), metric, fan=2)
        plan = answer._jdf.queryExecution().executedPlan().toString()
        assert json.loads(answer.first().result) == list(range(11))
        assert plan.count("MapInArrow") >= 5  # fed, merged in 5, 3 and 2 tasks, finished
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_states_are_bounded(spark):
    grows = M.Metric(list, lambda s, b: s + b.column("id").to_pylist(), lambda a, b: a + b, len)
    with pytest.raises(Exception, match="more than 1000"):
        M.metric_of(spark.range(10_000), grows, most=1000)


def test_official_metrics_by_states(spark):
    source = spark.createDataFrame([(i, json.dumps({"want": "f" if i % 2 else "g"})) for i in range(10)], "ord long, row string")
    scored = spark.createDataFrame([(i, f"e{i}", "f", "{}", None if i < 6 else "bad") for i in range(8)], "ord long, id string, tool_name string, arguments string, parse_error string")
    answer = lambda row, said: {"valid": row["want"] == said["function_called"]}
    assert runs.official_metrics(source, scored, evaluate_response=answer, compute_metrics=M.member_means()) == {"valid": {"n": 8, "mean": 3 / 8}}
