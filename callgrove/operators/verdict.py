"""Paired comparison of two variants with an explicit acceptance verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The acceptance rule.
LEAST_GAIN, LEAST_RELATIVE, LEAST_ENGLISH, TOLERANCE = 0.05, 0.25, -0.02, 1e-12


def verdict_columns(base_exact: Column, new_exact: Column, base_no_call: Column, new_no_call: Column, base_english: Column, new_english: Column, complete: Column) -> list[Column]:
    """Changes, the three criteria and success (null unless complete and with both English values)."""
    gain = new_exact - base_exact
    error = 1 - base_exact
    relative = F.when(error != 0, F.try_divide(gain, error))
    english = new_english - base_english
    improved = (gain >= LEAST_GAIN - TOLERANCE) | F.coalesce(relative >= LEAST_RELATIVE - TOLERANCE, F.lit(False))
    kept, no_call = english >= LEAST_ENGLISH - TOLERANCE, new_no_call >= base_no_call
    return [
        (100 * gain).alias("call_change_percentage_points"),
        relative.alias("relative_error_reduction"),
        (100 * (new_no_call - base_no_call)).alias("no_call_change_percentage_points"),
        (100 * english).alias("english_change_percentage_points"),
        improved.alias("improvement"),
        kept.alias("english_preservation"),
        no_call.alias("no_call_preservation"),
        F.when(complete & english.isNotNull(), improved & kept & no_call).alias("success"),
    ]


def comparison(rates: DataFrame, english: DataFrame | None = None, *, complete: bool) -> DataFrame:
    """One row from rates (variant, exact_tool_call_accuracy, negative_case_accuracy) and English accuracies (variant, accuracy); variants: base, adapter."""
    of = lambda variant, name: F.max(F.when(F.col("variant") == variant, F.col(name)))
    row = rates.agg(*[of(v, c).alias(f"{v}_{n}") for v in ("base", "adapter") for n, c in (("exact", "exact_tool_call_accuracy"), ("no_call", "negative_case_accuracy"))])
    if english is None:
        row = row.select("*", F.lit(None).cast("double").alias("base_english"), F.lit(None).cast("double").alias("adapter_english"))
    else:
        other = english.agg(of("base", "accuracy").alias("base_english"), of("adapter", "accuracy").alias("adapter_english"))
        row = row.withColumn("one", F.lit(1)).join(other.withColumn("one", F.lit(1)), "one").drop("one")  # one row each
    c = F.col
    return row.select(*verdict_columns(c("base_exact"), c("adapter_exact"), c("base_no_call"), c("adapter_no_call"), c("base_english"), c("adapter_english"), F.lit(complete)))


def paired(examples: DataFrame, base: DataFrame, adapter: DataFrame, key: str = "id") -> DataFrame:
    """Each example with both variants' results, as structs, in the examples' order where they have an ``ord``."""
    b = base.select(key, F.struct(*[c for c in base.columns if c != key]).alias("base"))
    a = adapter.select(key, F.struct(*[c for c in adapter.columns if c != key]).alias("adapter"))
    return examples.join(b, key).join(a, key)
