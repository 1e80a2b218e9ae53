"""Readers, loaders, record rules, runs, ordinals, streams."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from callgrove.operators import ordinals, records, runs
from callgrove.sources import benchmarks as B
from callgrove.sources import readers as R
from callgrove.sources.commits import CommitLog
from callgrove.sources.store import Store
from callgrove.streaming import resume


def dump(path, value, lines=False):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(json.dumps(v, ensure_ascii=False) for v in value) + "\n" if lines else json.dumps(value, ensure_ascii=False), encoding="utf-8")
    return str(path)


def tools(*names):
    return [{"name": n, "description": n.upper(), "parameters": {"type": "object", "properties": {}}} for n in names]


def example(i, **more):
    return {"id": i, "domain": "d", "utterance": "نص", "is_negative": False, "expected_function": "b", "expected_arguments": {"x": 1}, "available_tools": ["b", "a"]} | more


def test_tool_examples(spark, tmp_path):
    t = dump(tmp_path / "tools.json", {"g": tools("a"), "h": tools("b")})
    e = dump(tmp_path / "examples.json", [example("q-1"), example("q-2"), example("q-2", is_negative=True, expected_function=None, expected_arguments=None)])
    rows = B.load_tool_examples(spark, e, t, revision="r").orderBy("ord").collect()
    assert [r.id for r in rows] == ["q-1", "q-2::row-1", "q-2::row-2"]
    assert [x.name for x in rows[0].available_tools] == ["b", "a"] and rows[0].expected_arguments == '{"x":1}'
    assert [r.should_call_tool for r in rows] == [True, True, False] and rows[2].expected_arguments is None
    with pytest.raises(ValueError, match="invalid is_negative for q-1"):
        B.load_tool_examples(spark, dump(tmp_path / "bad.json", [example("q-1", is_negative="no")]), t, revision="r")
    with pytest.raises(KeyError):
        B.load_tool_examples(spark, dump(tmp_path / "bad.json", [example("q", available_tools=["z"])]), t, revision="r")
    with pytest.raises(ValueError, match="duplicate tool name"):
        B.load_tool_examples(spark, e, dump(tmp_path / "two.json", tools("a", "a")), revision="r")
    with pytest.raises(ValueError, match="revision"):
        B.load_tool_examples(spark, e, t, revision=" ")


def question(i, kind="dict"):
    return {"id": i, "question": [[{"role": "user", "content": f"ask {i}"}]], "function": [{"name": "f", "description": "d", "parameters": {"type": kind, "properties": {"o": {"type": "dict"}}}}]}


def answer(i, choices=None):
    return {"id": i, "ground_truth": [{"f": choices or {"city": ["Paris", "paris"], "unit": ["", "C"]}}]}


def benchmark(tmp_path, simple, multiple, answers):
    dump(tmp_path / "BFCL_v4_simple_python.json", simple, True)
    dump(tmp_path / "possible_answer/BFCL_v4_simple_python.json", answers, True)
    if multiple is not None:
        dump(tmp_path / "BFCL_v4_multiple.json", multiple, True)
        dump(tmp_path / "possible_answer/BFCL_v4_multiple.json", [answer(q["id"]) for q in multiple], True)
    return str(tmp_path)


def test_alternatives(spark, tmp_path):
    folder = benchmark(tmp_path, [question("s_0"), question("s_1")], [question("m_0")], [answer("s_0"), answer("s_1"), answer("extra")])
    rows = B.load_alternatives(spark, folder, revision="r", limit=3).orderBy("ord").collect()
    assert [r.id for r in rows] == ["s_0", "s_1", "m_0"] and rows[0].expected_arguments == '{"city":"Paris"}'
    made = json.loads(rows[0].available_tools[0].parameters)
    assert made["type"] == "object" and made["properties"]["o"]["type"] == "dict" and '"type": "dict"' in rows[0].prompt
    with pytest.raises(ValueError, match="requested 9 examples, found 3"):
        B.load_alternatives(spark, folder, revision="r", limit=9)
    with pytest.raises(ValueError, match="supported categories"):
        B.load_alternatives(spark, folder, revision="r", categories=("live",))
    with pytest.raises(ValueError, match="positive"):
        B.load_alternatives(spark, folder, revision="r", limit=0)


def test_alternatives_limit_leaves_later_files_closed(spark, tmp_path):
    folder = benchmark(tmp_path, [question("s_0"), question("s_1")], None, [answer("s_0"), answer("s_1")])
    assert B.load_alternatives(spark, folder, revision="r", limit=1).count() == 1


@pytest.mark.parametrize(("answers", "message"), [([answer("s_0"), answer("s_0")], "duplicate answer"), ([answer("z")], "unmatched ID: s_0"), ([answer("s_0", {"a": []})], "invalid alternatives"), ([{"id": "s_0", "ground_truth": [{}, {}]}], "unsupported answer shape")])
def test_alternatives_errors(spark, tmp_path, answers, message):
    folder = benchmark(tmp_path, [question("s_0")], None, answers)
    with pytest.raises(ValueError, match=message):
        B.load_alternatives(spark, folder, revision="r", limit=1, categories=("simple_python",))


def test_readers(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"a": 1}\n\n  \n{"a": 2}\n', encoding="utf-8")
    assert R.jsonl(spark, str(path)).count() == 2 and [r.a for r in R.jsonl(spark, str(path), "a int").collect()] == [1, 2]
    assert sorted(r.line for r in R.numbered_lines(spark, str(path)).collect()) == [1, 4]
    assert R.digests(spark, str(path)).collect()[0].sha256 == hashlib.sha256(path.read_bytes()).hexdigest()
    with pytest.raises(Exception, match="list or grouped"):
        R.document_items(spark, dump(tmp_path / "x.json", 3)).collect()


def test_record_rules(spark):
    ddl = "name string, description string, parameters string"
    good = '{"type":"object","properties":{}}'
    rows = [("a", "d", good), (" ", "d", good), ("a", "d", "[]"), ("a", "d", '{"type":"array","properties":{}}'), ("a", "d", '{"type":"object"}'), ("a", "d", '{"a":NaN}')]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord int, " + ddl)
    first = {r.ord: r.message for r in records.violations(frame, records.tool_rules(), "ord").orderBy(F.desc("rule")).collect()}
    assert 0 not in first and first[1].startswith("name") and first[2] == "parameters must be an object" and "type" in first[3] and "properties" in first[4] and first[5] == "parameters must contain only valid JSON values"
    with pytest.raises(ValueError, match="name must be"):
        records.enforce(frame, records.tool_rules(), "ord")


def test_example_rules(spark):
    tool = "array<struct<name:string,description:string,parameters:string>>"
    ddl = f"ord int, id string, source string, language string, domain string, user_utterance string, available_tools {tool}, should_call_tool boolean, expected_tool_name string, expected_arguments string, dialect string, tags array<string>"
    t = [("a", "d", "{}")]
    good = ("i", "s", "ar", "d", "u", t, True, "a", "{}", None, ["x"])
    bad = {1: (8, "[]"), 2: (7, "b"), 3: (5, []), 4: (5, t * 2), 5: (10, ["x", "x"]), 6: (9, " "), 7: (6, False)}
    rows = [(0, *good)] + [(k, *[v if i == at else x for i, x in enumerate(good)]) for k, (at, v) in bad.items()]
    found = {r.ord for r in records.violations(spark.createDataFrame(rows, ddl), records.example_rules(), "ord").collect()}
    assert found == set(bad)


def test_run_record_and_resume(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.pin("run.json", {"a": 1})
    store.pin("run.json", {"a": 1.0})
    with pytest.raises(ValueError, match="different run"):
        store.pin("run.json", {"a": 2})
    store.put("run.json", {"é": [1]})
    assert store.document("run.json") == {"é": [1]} and store.names("*.json") == ["run.json"] and store.names("*.none") == [] and not store.exists("other")
    examples = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "ord long, id string")
    settings = {"model_id": "m", "model_revision": "r", "prompt_version": "p", "generation": {"n": 5}}
    file = str(tmp_path / "p.jsonl")
    assert runs.read_predictions(spark, file, examples, **settings).count() == 0
    made = spark.createDataFrame([(0, "a", "t x", "m", "r", "p", '{"n": 5}', 1.0, None), (1, "b", "", "m", "r", "p", '{"n": 5}', 1.0, 2.0)], "ord long, " + runs.PREDICTION)
    assert runs.append_predictions(made, CommitLog(store, "p.jsonl"), 0) == 2
    done = runs.read_predictions(spark, file, examples, **settings)
    assert [r.generated_text for r in done.orderBy("ord").collect()] == ["t x", ""]
    assert [r.id for r in runs.pending(examples, done).collect()] == ["c"]
    with pytest.raises(ValueError, match="metadata differs"):
        runs.read_predictions(spark, file, examples, **settings | {"model_id": "z"})
    with pytest.raises(ValueError, match="unchanged prefix"):
        runs.read_predictions(spark, file, examples.where("ord > 0"), **settings)


def test_bad_prediction_lines(spark, tmp_path):
    examples = spark.createDataFrame([(0, "a"), (1, "b")], "ord long, id string")
    good = {"example_id": "a", "generated_text": "", "model_id": "m", "model_revision": "r", "prompt_version": "p", "generation_config": {}, "latency_seconds": 1, "gpu_memory_mb": None}
    settings = {"model_id": "m", "model_revision": "r", "prompt_version": "p", "generation": {}}
    for line, says in [("{", "Expecting"), ("", "Expecting"), ("[1]", "list indices"), (json.dumps({k: v for k, v in good.items() if k != "gpu_memory_mb"}), "missing member: 'gpu_memory_mb'"), (json.dumps(good | {"latency_seconds": "1"}), "latency_seconds has a wrong type"), (json.dumps(good | {"latency_seconds": -1}), "finite non-negative"), (json.dumps(good | {"generation_config": []}), "generation_config has")]:
        path = tmp_path / "bad.jsonl"
        path.write_text(json.dumps(good) + "\n" + line + "\n", encoding="utf-8")
        with pytest.raises(ValueError, match=f"line 2 of .*{says}"):
            runs.read_predictions(spark, str(path), examples, **settings)


def test_digest_gates(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"x")
    right, store = hashlib.sha256(b"x").hexdigest(), Store(spark, str(tmp_path))
    runs.require_digests(store, {"f": right}, {"f": right})
    with pytest.raises(ValueError, match="hash mismatch: f"):
        runs.require_digests(store, {"f": right}, {"f": "0"})
    assert runs.verified_source(store, "f", right) == b"x"
    with pytest.raises(ValueError, match="source hash mismatch"):
        runs.verified_source(store, "f", "0")
    assert runs.optimizer_steps(5280) == 990


EXPERIMENT = runs.Experiment("m", "r", "p", {"base": "m", "adapter": "m+a"}, {"s": 2, "t": 2}, {"t": {"x": 2}}, {"rev": "1"}, "s", "t")


def suite(spark, domains, choices=None):
    ddl = "id string, should_call_tool boolean, expected_tool_name string, expected_arguments string, domain string, ord long, choices string, ground_truth string"
    return spark.createDataFrame([(f"{d}{i}", True, "f", '{"a":1}', d, i, choices, "{}") for i, d in enumerate(domains)], ddl)


def test_digests_are_made_in_executors_or_streamed(spark, tmp_path, monkeypatch):
    """The same digests for small and large files, names with spaces and folders too; missing files differ, the first path in order is the error."""
    content = {"a.bin": b"", "b c.bin": bytes(range(256)) * 40, "sub/d é.txt": "é\n".encode(), "z.bin": b"z" * 70_000, "_h.txt": b"h", "x{1}.txt": b"x", "sub/.k": b"k"}
    for name, data in content.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    store, want = Store(spark, str(tmp_path)), {n: hashlib.sha256(d).hexdigest() for n, d in content.items()}
    for limit in (0, 20_000, 1 << 20):
        assert {r.path: r.sha256 for r in R.named_digests(store, [*want, "none", "sub"], whole_bytes=limit).collect()} == want
    assert R.named_digests(store, []).count() == 0
    monkeypatch.setattr(Store, "read", lambda *_: pytest.fail("a file came to the driver"))
    runs.require_digests(store, want, want)
    runs.require_digests(store)
    for maps, first in (((want | {"z.bin": "0"}, want | {"b c.bin": "0"}), "b c.bin"), ((want | {"none": "0"},), "none"), ((want, {"a.bin": None}), "a.bin")):
        with pytest.raises(ValueError, match=f"hash mismatch: {first}"):
            runs.require_digests(store, *maps)


def test_load_inputs_stops_at_the_first_difference(spark, tmp_path):
    dump(tmp_path / "data/train.jsonl", [1], True)
    dump(tmp_path / "bench/f.json", 2)
    digest = lambda name: hashlib.sha256((tmp_path / name).read_bytes()).hexdigest()
    run = {"model_id": "m", "model_revision": "r", "train_sha256": digest("data/train.jsonl")}
    report = {"status": "passed", "train_sha256": run["train_sha256"], "rev": "1", "files": {"bench/f.json": digest("bench/f.json")}}
    suites = {"s": lambda: suite(spark, "ab"), "t": lambda: suite(spark, "xx")}

    def load(run=run, report=report, suites=suites, **more):
        dump(tmp_path / "run/run.json", run)
        dump(tmp_path / "reports/leakage_audit.json", report)
        return runs.load_inputs(spark, str(tmp_path), str(tmp_path / "run"), EXPERIMENT, suites, hashed={"train_sha256": "data/train.jsonl"}, listed=("files",), **more)

    found, frames = load()
    assert found == run and set(frames) == {"s", "t"}

    def broken():
        raise ValueError("set is invalid")

    for arguments, says in [
        ({"run": run | {"model_revision": "z"}, "report": report | {"status": "blocked"}}, "pinned base"),
        ({"report": report | {"status": "blocked", "train_sha256": "0"}}, "not passed"),
        ({"report": report | {"train_sha256": "0", "rev": "2"}}, "hash mismatch: data/train.jsonl"),
        ({"report": report | {"rev": "2", "files": {"bench/f.json": "0"}}}, "revisions"),
        ({"report": report | {"files": {"bench/f.json": "0"}}, "checks": (broken,)}, "hash mismatch: bench/f.json"),
        ({"checks": (broken,), "suites": suites | {"t": lambda: suite(spark, "xy")}}, "set is invalid"),
        ({"suites": suites | {"t": lambda: suite(spark, "xy"), "s": lambda: suite(spark, "a")}}, "by domain"),
        ({"suites": suites | {"s": lambda: suite(spark, "a")}}, "counts differ"),
    ]:
        with pytest.raises(ValueError, match=says):
            load(**arguments)


def test_evaluate_from_nothing_to_summary(spark, tmp_path):
    suites = {"s": suite(spark, "ab"), "t": suite(spark, "xx", '{"a":[1,2]}')}
    call = lambda n: json.dumps({"name": "f", "arguments": {"a": n}})

    def generate(name, variant, pending):
        text = F.when(F.lit(variant == "base") & (F.col("ord") == 0), F.lit("prose")).otherwise(F.lit(call(1 if name == "s" else 2)))
        return pending.select("ord", F.col("id").alias("example_id"), text.alias("generated_text"), F.lit(EXPERIMENT.variants[variant]).alias("model_id"), F.lit("r").alias("model_revision"), F.lit("p").alias("prompt_version"), F.lit('{"n":1}').alias("generation_config"), F.lit(1.5).alias("latency_seconds"), F.lit(None).cast("double").alias("gpu_memory_mb"))

    out = str(tmp_path / "out")
    go = lambda **more: runs.evaluate(spark, out, suites, EXPERIMENT, settings={"k": 1}, generation={"n": 1}, **more)
    with pytest.raises(ValueError, match="incomplete"):
        go(score_only=True, generate=generate)
    first = go(generate=generate)
    assert first == go(score_only=True) == json.loads((tmp_path / "out/summary.json").read_text())
    s, t = first["evaluations"]["s"], first["evaluations"]["t"]
    assert s["complete"] and s["base"]["rates"]["exact_tool_call_accuracy"] == 0.5 and s["adapter"]["categories"]["a"]["correct"] == 1 and s["base"]["inference"]["generation_seconds"] == 3.0
    assert t["adapter"]["accuracy"] == {"correct": 2, "total": 2, "accuracy": 1.0} and t["adapter"]["rates"]["exact_tool_call_accuracy"] == 0.0 and first["verdict"]["success"] is True
    assert spark.read.json(out + "/s.paired").count() == 2
    with pytest.raises(ValueError, match="different run"):
        runs.evaluate(spark, out, suites, EXPERIMENT, settings={"k": 2}, generation={"n": 1})
    (tmp_path / "out/run.json").unlink()
    with pytest.raises(ValueError, match="without a run record"):
        go(score_only=True)


def test_metric_hooks(spark):
    scored = spark.createDataFrame([(0, "a", "t", '{"x":1}', None), (1, "a", None, None, None), (2, "c", None, None, "bad")], "ord long, id string, tool_name string, arguments string, parse_error string")
    source = spark.createDataFrame([(i, json.dumps({"want": w})) for i, w in enumerate(["t", None, None, "beyond"])], "ord long, row string")
    answer = lambda row, response: {"ok": row["want"] == response["function_called"], "args": response["arguments"]}
    count = lambda rows: {"right": rows.where(F.get_json_object("result", "$.ok") == "true").count(), "rows": rows.count()}
    assert runs.official_metrics(source, scored, evaluate_response=answer, compute_metrics=count) == {"right": 2, "rows": 3}
    with pytest.raises(ValueError, match="fewer source rows"):
        runs.official_metrics(source.limit(1), scored, evaluate_response=answer, compute_metrics=count)


def test_training_gates_and_lengths(spark):
    from callgrove.operators.labelled import CATEGORIES

    ddl = "category string, review_status string, review_note string, reference_date string"
    good = [(c, "native_speaker_reviewed", " ", "2027-01-01") for c in CATEGORIES for _ in range(10)]
    gates = lambda rows: {k for k, v in runs.training_gates(spark.createDataFrame(rows, ddl)).collect()[0].asDict().items() if not v}
    assert gates(good) == set()
    assert gates([(*good[0][:1], None, *good[0][2:]), *good[1:]]) == {"all_reviewed"}
    assert gates([("other", *good[0][1:]), *good[1:]]) == {"ten_of_each_category"}
    assert gates([(*good[0][:3], None), *good[1:]]) == {"one_date"}
    assert gates([(*good[0][:2], "todo", good[0][3]), *good]) == {"hundred_rows", "no_notes", "ten_of_each_category"}
    lengths = spark.createDataFrame([(3,), (512,)], "length int")
    assert runs.require_lengths(lengths) == 512 and runs.require_lengths(lengths.limit(0)) == 0
    with pytest.raises(ValueError, match="512 tokens, more than 511"):
        runs.require_lengths(lengths, 511)


def test_prompts_carry_no_labels(spark):
    ddl = "ord long, id string, user_utterance string, available_tools array<struct<name:string,description:string,parameters:string>>, expected_tool_name string"
    rows = spark.createDataFrame([(0, "a", "u", [("t", "d", "{}")], "GOLD")], ddl)
    prompt = runs.rendered_prompts(rows, lambda messages, tools: messages + tools).collect()[0].prompt
    assert "GOLD" not in prompt and '"type":"function"' in prompt


def test_summary(spark, tmp_path):
    ex = spark.createDataFrame([("a", False, None, None, "d", 0), ("b", True, "t", "{}", "e", 1)], "id string, should_call_tool boolean, expected_tool_name string, expected_arguments string, domain string, ord long")
    pr = "example_id string, generated_text string, latency_seconds double, gpu_memory_mb double"
    base = spark.createDataFrame([("a", "no", 1.0, None), ("b", "no", 1.0, None)], pr)
    adapter = spark.createDataFrame([("a", "no", 1.0, None), ("b", '<tool_call>{"name":"t","arguments":{}}</tool_call>', 1.0, None)], pr)
    out = runs.summarize({"s": ex}, {("s", "base"): base, ("s", "adapter"): adapter}, full={"s": 2}, verdict_suite="s")
    row = out["verdict"].collect()[0]
    assert row.improvement is True and row.success is None
    assert out["s.paired"].count() == 2
    runs.write_summary({k: v for k, v in out.items() if k.endswith("rates")}, str(tmp_path / "out"))
    assert (tmp_path / "out/s.base.rates").is_dir()


def test_default_alternatives_and_metric_inputs(spark):
    scored = spark.createDataFrame([(0, "a", "t", '{"x":1}', None), (1, "b", None, None, None), (2, "c", None, None, "bad")], "ord long, id string, tool_name string, arguments string, parse_error string")
    ex = spark.createDataFrame([(i, "t", '{"x":[1.0],"y":["",2]}', "{}") for i in "abc"], "id string, expected_tool_name string, choices string, ground_truth string")
    assert {r.id: r.valid for r in runs.alternatives_accuracy(scored, ex).collect()} == {"a": True, "b": False, "c": False}
    assert [r.valid for r in runs.alternatives_accuracy(scored.limit(1), ex, lambda t, a, g: False).collect()] == [False]
    called = {r.ord: r.function_called for r in runs.metric_inputs(scored.select("ord"), scored).collect()}
    assert called == {0: "t", 1: None, 2: runs.INVALID}


def test_ordinals(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 3).alias("tie"))
    got = ordinals.with_ordinals(rows, "k").collect()
    assert all(r.ord == r.k for r in got)
    assert sorted(r.ord for r in ordinals.with_ordinals(rows, "tie").collect()) == list(range(1000))
    assert [r.k for r in ordinals.prefix(rows, 3, "k").orderBy("ord").collect()] == [0, 1, 2]
    with pytest.raises(Exception, match="requested 2000 rows, found 1000"):
        ordinals.prefix(rows, 2000, "k").collect()
    assert sorted(r.k for r in ordinals.even_sample(rows, 100, "k").collect()) == [round(i * 999 / 99) for i in range(100)]


def test_streams(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame([("a", "null"), ("b", "prose")], "example_id string, generated_text string").write.parquet(folder)
    stream = resume.stream_table(spark, folder, "example_id string, generated_text string")
    got = resume.drained(resume.scored_responses(stream), "parsed").select("example_id", "parsed.valid").collect()
    assert sorted(map(tuple, got)) == [("a", True), ("b", True)]
    query = resume.append_batches(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
