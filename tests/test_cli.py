"""The commands, on one small set from generation to scores."""

import json

from callgrove.__main__ import main
from callgrove.sources.suites import labelled_examples, prefix_of_each


def test_generate_audit_score(spark, tmp_path, capsys):
    assert main(["generate", str(tmp_path)]) == 0
    assert json.loads(capsys.readouterr().out)["row_count"] == 6600
    train, held = tmp_path / "training.train.jsonl", tmp_path / "held.jsonl"
    lines = (tmp_path / "training.validation.jsonl").read_text(encoding="utf-8").splitlines()
    held.write_text("\n".join(lines[:20] + lines[-5:]) + "\n", encoding="utf-8")
    assert main(["audit", "--train", str(train), "--evaluation", str(held), "--output", str(tmp_path / "audit.json")]) == 0
    report = json.loads((tmp_path / "audit.json").read_text())
    group = report["evaluation_groups"][str(held)]
    assert report["status"] == "passed" and group["examples"] == 25 and group["property_name_overlap_diagnostic"]
    rows = [json.loads(x) for x in held.read_text(encoding="utf-8").splitlines()]
    right = [f'<tool_call>{json.dumps({"name": r["expected_tool_name"], "arguments": r["expected_arguments"]})}</tool_call>' if r["should_call_tool"] else "لا" for r in rows]
    (tmp_path / "p.jsonl").write_text("".join(json.dumps({"example_id": r["id"], "generated_text": t}) + "\n" for r, t in zip(rows, right, strict=True)))
    capsys.readouterr()
    assert main(["score", str(held), str(tmp_path / "p.jsonl")]) == 0
    found = json.loads(capsys.readouterr().out)
    assert found["rates"]["exact_tool_call_accuracy"] == 1.0 and found["counts"]["negative_case_correct"] == 5
    same = tmp_path / "same.json"
    assert main(["audit", "--train", str(train), str(held), "--evaluation", str(held), "--output", str(same)]) == 0
    assert json.loads(same.read_text())["status"] == "blocked"
    suites = {"a": labelled_examples(spark, str(held)), "b": labelled_examples(spark, str(train))}
    assert {k: v.count() for k, v in prefix_of_each(suites, 3).items()} == {"a": 3, "b": 3} and list(prefix_of_each(suites, None, "a")) == ["a"]


def test_errors_are_told(tmp_path, capsys):
    (tmp_path / "x.jsonl").write_text("{}\n")
    assert main(["validate", str(tmp_path / "x.jsonl")]) == 1
    assert "line 1" in capsys.readouterr().err
