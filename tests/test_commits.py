"""Batches that are committed whole or not at all, whenever their writer dies."""

import json

import pytest
from pyspark.sql import functions as F

from callgrove.operators import runs
from callgrove.sources.commits import CommitLog
from callgrove.sources.store import Store


class Died(Exception):
    pass


def batch(spark, *numbers):
    return spark.createDataFrame([(n, f"row {n}") for n in numbers], "ord long, value string").repartition(3)


def lines(spark, log):
    return [r.value for p in log.paths() for r in spark.read.text(p).select("value", F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("at")).orderBy("f", "at").collect()]


@pytest.mark.parametrize("dies", ["before the part", "behind the part", "behind the draft", "behind the entry"])
@pytest.mark.parametrize("scheme", ["", "file://"])
def test_a_dead_writer_loses_and_doubles_nothing(spark, tmp_path, monkeypatch, dies, scheme):
    store = Store(spark, scheme + str(tmp_path))
    log = CommitLog(store, "log.jsonl")
    assert not log.exists() and log.entries() == []
    assert log.append(batch(spark, 1, 0, 2), "ord", 0) == 3
    real = Store._renamed

    def publish(self, name, content):
        if dies == "behind the part":
            raise Died
        if dies == "behind the draft":
            (tmp_path / "log.jsonl" / "_log" / ".000001.json.dead").write_bytes(content)
            raise Died
        real(self, name, content, replace=False)
        raise Died

    if dies != "before the part":
        monkeypatch.setattr(Store, "publish", publish)
        with pytest.raises(Died):
            log.append(batch(spark, 3, 4), "ord", 1)
        monkeypatch.undo()
    there = len(log.entries())
    assert there == (2 if dies == "behind the entry" else 1)
    if there == 1:
        log.append(batch(spark, 4, 3), "ord", there)
    assert lines(spark, log) == [f"row {n}" for n in range(5)]
    assert [e["rows"] for e in log.entries()] == [3, 2]


def test_two_writers_and_gaps(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    log = CommitLog(store, "log")
    log.append(batch(spark, 0), "ord", 0)
    with pytest.raises(ValueError, match="another writer"):
        log.append(batch(spark, 0), "ord", 0)
    with pytest.raises(ValueError, match="there already"):
        store.publish("log/_log/000000.json", b"{}")
    store.write("log/_log/000002.json", json.dumps({"part": "nowhere", "rows": 1}).encode())  # beyond a gap
    assert len(log.entries()) == 1 and lines(spark, log) == ["row 0"]


def test_a_run_goes_on_in_batches(spark, tmp_path):
    """``evaluate`` on a URI: the second attempt asks only for what the first one, which died, hadn't saved."""
    tool = [("f", "d", '{"type":"object","properties":{}}')]
    ddl = "ord long, id string, source string, language string, domain string, user_utterance string, available_tools array<struct<name:string,description:string,parameters:string>>, should_call_tool boolean, expected_tool_name string, expected_arguments string, dialect string, tags array<string>"
    suite = spark.createDataFrame([(i, f"e{i}", "s", "ar", "d", "u", tool, True, "f", "{}", None, []) for i in range(7)], ddl)
    experiment = runs.Experiment("m", "r", "p", {"base": "m", "adapter": "m+a"}, {"s": 7}, verdict_suite="s")
    asked = []

    def generate(suite_, variant, rows):
        ids = [r.ord for r in rows.orderBy("ord").collect()]
        asked.append((variant, ids))
        if len(asked) == 3:
            raise Died
        made = [(o, f"e{o}", '<tool_call>{"name":"f","arguments":{}}</tool_call>', experiment.variants[variant], "r", "p", "{}", 1.0, None) for o in ids]
        return spark.createDataFrame(made, "ord long, " + runs.PREDICTION)

    output = f"file://{tmp_path}/run"
    run = lambda: runs.evaluate(spark, output, {"s": suite}, experiment, settings={}, generation={}, generate=generate, every=3)
    with pytest.raises(Died):
        run()
    out = run()
    assert asked == [("base", [0, 1, 2]), ("base", [3, 4, 5]), ("base", [6]), ("base", [6]), ("adapter", [0, 1, 2]), ("adapter", [3, 4, 5]), ("adapter", [6])]
    assert out["evaluations"]["s"]["base"]["counts"]["exact_match"] == 7 and out["evaluations"]["s"]["complete"]
    assert Store(spark, output).document("summary.json") == json.loads(json.dumps(out))
