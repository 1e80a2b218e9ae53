"""python -m callgrove COMMAND: generate a corpus, validate a labelled set, audit leakage, score predictions, evaluate a paired run."""

from __future__ import annotations

import argparse
import json
import sys


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("callgrove").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def generate(args: argparse.Namespace) -> None:
    from .operators import corpus
    from .plans.design import made_design

    if args.design:
        with open(args.design, encoding="utf-8") as file:
            design = json.load(file)
    else:
        design = made_design()
    print(json.dumps(corpus.generate(_session(), design, args.output), ensure_ascii=False, indent=2))


def validate(args: argparse.Namespace) -> None:
    from .operators import labelled

    counts = labelled.validate(_session(), args.path, args.mode)
    print(f"Valid set: {args.path} ({sum(counts.values())} cases; {counts})")


def audit(args: argparse.Namespace) -> None:
    from .operators import audit as operator
    from .sources.store import Store
    from .sources.suites import labelled_examples

    spark = _session()
    train = labelled_examples(spark, args.train[0])
    for path in args.train[1:]:
        train = train.unionByName(labelled_examples(spark, path))
    groups = {path: (labelled_examples(spark, path), None) for path in args.evaluation}
    facts = {"file_sha256": {p: Store(spark, p.rpartition("/")[0] or ".").sha256(p.rpartition("/")[2]) for p in [*args.train, *args.evaluation]}}
    print(f"Leakage audit {operator.report(operator.audit(train, groups), args.output, **facts)['status']}")


def score(args: argparse.Namespace) -> None:
    from .operators import scoring
    from .sources.suites import labelled_examples

    spark = _session()
    predictions = spark.read.schema("example_id string, generated_text string").option("mode", "FAILFAST").json(args.predictions)
    counts = scoring.score_counts(scoring.score_examples(labelled_examples(spark, args.examples), predictions, output_format=args.format))
    row, rates = counts.collect()[0].asDict(), scoring.score_rates(counts).collect()[0].asDict()
    print(json.dumps({"counts": row, "rates": rates}, indent=2))


def evaluate(args: argparse.Namespace) -> None:
    """Scores complete saved predictions of both variants, as a config file names them; inference itself is a hook of the library."""
    from .operators.runs import Experiment, evaluate
    from .sources.store import Store
    from .sources.suites import labelled_examples, prefix_of_each

    spark = _session()
    folder, _, name = args.config.rpartition("/")
    config = Store(spark, folder or ".").document(name)
    suites = prefix_of_each({s: labelled_examples(spark, path) for s, path in config["suites"].items()}, args.limit, args.suite)
    out = evaluate(spark, args.output, suites, Experiment(**config["experiment"]), settings=config.get("settings", {}), generation=config["generation"], score_only=True, output_format=args.format)
    print(json.dumps(out, ensure_ascii=False, indent=2))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="callgrove", description=__doc__)
    commands = parser.add_subparsers(required=True)
    for function, options in (
        (generate, [(("output",), {}), (("--design",), {})]),
        (validate, [(("path",), {}), (("--mode",), {"default": "template", "choices": ["template", "pilot", "draft", "final"]})]),
        (audit, [(("--train",), {"nargs": "+", "required": True}), (("--evaluation",), {"nargs": "+", "required": True}), (("--output",), {"required": True})]),
        (score, [(("examples",), {}), (("predictions",), {}), (("--format",), {"default": "tagged", "choices": ["json", "tagged"]})]),
        (evaluate, [(("config",), {}), (("output",), {}), (("--suite",), {"default": "all"}), (("--limit",), {"type": int}), (("--format",), {"default": "tagged", "choices": ["json", "tagged"]})]),
    ):
        command = commands.add_parser(function.__name__)
        for names, values in options:
            command.add_argument(*names, **values)
        command.set_defaults(run=function)
    args = parser.parse_args(argv)
    try:
        args.run(args)
    except (OSError, UnicodeError, ValueError) as error:
        print(error, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
