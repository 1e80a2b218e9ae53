"""Scoring of raw responses: per-example columns, 15 counts, 11 rates, categories, inference totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsonx import object_keys, response, scoring_form


def require_same_ids(examples: DataFrame, predictions: DataFrame, left: str = "id", right: str = "example_id") -> None:
    """Both sides have each id once, and the same ids; else ValueError."""
    sides = examples.select(F.col(left).alias("k"), F.lit(1).alias("a"), F.lit(0).alias("b")).union(predictions.select(F.col(right).alias("k"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    found = sides.groupBy("k").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).agg(F.max(F.greatest("a", "b")).alias("most"), F.min(F.least("a", "b")).alias("least")).collect()[0]
    if (found.most or 0) > 1:
        raise ValueError("duplicate example or prediction ID")
    if found.least == 0:
        raise ValueError("example and prediction IDs must match")


def score_examples(examples: DataFrame, predictions: DataFrame, *, output_format: str = "json", check: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per example: what was parsed and what of it is right.

    examples: id, should_call_tool, expected_tool_name, expected_arguments (JSON), and the columns to ``keep``. predictions: example_id,
    generated_text. Both sides' texts become comparable forms before they meet, so the join is a plain equi-join.
    """
    parsed = predictions.select("example_id", response(F.col("generated_text"), output_format).alias("r"))
    if check:
        require_same_ids(examples, predictions)
    wanted = examples.select("id", "should_call_tool", "expected_tool_name", F.when(F.col("should_call_tool"), F.col("expected_arguments")).alias("expected_arguments"), *keep)
    wanted = wanted.withColumn("expected_form", scoring_form(F.col("expected_arguments"))).withColumn("expected_keys", object_keys(F.col("expected_arguments")))
    rows = wanted.join(parsed, F.col("id") == F.col("example_id")).drop("example_id")
    call, should = F.col("r.is_call"), F.col("should_call_tool")
    should_call_correct = F.col("r.valid") & (call == should)
    tool_correct = F.when(call & should, F.col("r.tool_name") == F.col("expected_tool_name")).otherwise(should_call_correct & ~should)
    arguments_correct = F.when(should, F.when(call, F.col("r.args_form") == F.col("expected_form")).otherwise(F.lit(False)))
    keys, expected = F.col("r.arg_keys"), F.col("expected_keys")
    return rows.select(
        "id",
        "should_call_tool",
        *keep,
        F.col("r.parse_success").alias("parse_success"),
        (F.col("r.valid") & F.col("r.parse_success")).alias("valid_structured_output"),
        call.alias("is_call"),
        F.col("r.tool_name").alias("tool_name"),
        F.col("r.arguments").alias("arguments"),
        F.col("r.parse_error").alias("parse_error"),
        should_call_correct.alias("should_call_correct"),
        tool_correct.alias("tool_selection_correct"),
        arguments_correct.alias("arguments_correct"),
        (tool_correct & F.coalesce(arguments_correct, F.lit(True))).alias("exact_match"),
        F.size(F.array_intersect(keys, expected)).alias("argument_key_tp"),
        F.when(should, F.size(F.array_except(keys, expected))).otherwise(0).alias("argument_key_fp"),
        F.size(F.array_except(expected, keys)).alias("argument_key_fn"),
    )


def _sums() -> dict[str, Column]:
    pos, neg = F.col("should_call_tool"), ~F.col("should_call_tool")
    return {
        "examples": F.count("*"),
        "positive_examples": F.count_if(pos),
        "negative_examples": F.count_if(neg),
        "parse_success": F.count_if("parse_success"),
        "valid_structured_output": F.count_if("valid_structured_output"),
        "should_call_correct": F.count_if("should_call_correct"),
        "tool_name_correct": F.count_if(pos & F.col("tool_selection_correct")),
        "exact_arguments_correct": F.count_if(pos & F.col("arguments_correct")),
        "exact_tool_calls_correct": F.count_if(pos & F.col("exact_match")),
        "exact_match": F.count_if("exact_match"),
        "negative_case_correct": F.count_if(neg & F.col("exact_match")),
        "false_calls": F.count_if(neg & F.col("is_call")),
        **{k: F.coalesce(F.sum(F.when(pos, F.col(k))), F.lit(0)) for k in ("argument_key_tp", "argument_key_fp", "argument_key_fn")},
    }


def score_counts(scored: DataFrame, *by: str) -> DataFrame:
    """The 15 counts, one row (or one for each group)."""
    return scored.groupBy(*by).agg(*[c.cast("long").alias(k) for k, c in _sums().items()])


def rate(numerator: Column, denominator: Column) -> Column:
    """0.0 where the denominator is 0."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def score_rates(counts: DataFrame, *by: str) -> DataFrame:
    """The 11 rates of ``score_counts``' rows."""
    c = F.col
    tp, fp, fn = c("argument_key_tp"), c("argument_key_fp"), c("argument_key_fn")
    return counts.select(
        *by,
        rate(c("parse_success"), c("examples")).alias("parse_success"),
        rate(c("valid_structured_output"), c("examples")).alias("valid_structured_output"),
        rate(c("should_call_correct"), c("examples")).alias("should_call_accuracy"),
        rate(c("tool_name_correct"), c("positive_examples")).alias("tool_name_accuracy"),
        rate(c("exact_arguments_correct"), c("positive_examples")).alias("exact_argument_accuracy"),
        rate(c("exact_tool_calls_correct"), c("positive_examples")).alias("exact_tool_call_accuracy"),
        rate(tp, tp + fp).alias("argument_key_precision"),
        rate(tp, tp + fn).alias("argument_key_recall"),
        rate(2 * tp, 2 * tp + fp + fn).alias("argument_key_f1"),
        rate(c("negative_case_correct"), c("negative_examples")).alias("negative_case_accuracy"),
        rate(c("false_calls"), c("negative_examples")).alias("false_call_rate"),
    )


def category_accuracy(scored: DataFrame, *, category: str = "domain", order: str = "ord") -> DataFrame:
    """Exact matches and rows for each category, in the order in which categories first occur."""
    return scored.groupBy(category).agg(F.count_if("exact_match").alias("correct"), F.count("*").alias("total"), F.min(order).alias("first_ord")).orderBy("first_ord")


def inference_totals(predictions: DataFrame) -> DataFrame:
    """Seconds in all and the greatest memory; an empty input is an error, as a maximum of nothing."""
    sums = predictions.agg(F.count("*").alias("n"), F.sum("latency_seconds").alias("generation_seconds"), F.max(F.coalesce("gpu_memory_mb", F.lit(0.0))).alias("peak_allocated_gpu_mb"))
    return sums.select(F.when(F.col("n") > 0, F.col("generation_seconds")).otherwise(F.raise_error(F.lit("no predictions")).cast("double")).alias("generation_seconds"), "peak_allocated_gpu_mb")


def accuracy(checked: DataFrame, valid: str = "valid") -> DataFrame:
    """correct, total and their quotient; an empty input is an error."""
    sums = checked.agg(F.count_if(valid).alias("correct"), F.count("*").alias("total"))
    return sums.withColumn("accuracy", F.col("correct") / F.when(F.col("total") > 0, F.col("total")).otherwise(F.raise_error(F.lit("division by zero")).cast("long")))
