"""The operators over the driver's tables, each with the SQL that gives the same rows.

``events`` serve as tool calls: the type is the tool, the properties are its arguments. Responses are made from them by ``event_id % 8``: exact; other
key order and 3.0 for 3; wrong tool; missing key; extra key; wrong value; malformed; prose. One event in five expects no call.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import bare_alef, normalized_prompt
from ..operators import audit, labelled, ordinals, records, runs, scoring, verdict
from ..sources import benchmarks
from ..sources.benchmarks import repaired_ids
from ..sources.readers import table
from ..streaming.resume import windowed_counts
from . import made

Query = Callable[[SparkSession, str], DataFrame]

# ---------------------------------------------------------------- events as calls


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    should = F.col("event_id") % 5 != 0
    return e.select(F.col("event_id").alias("ord"), F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("domain"), should.alias("should_call_tool"), F.when(should, F.col("event_type")).alias("expected_tool_name"), F.when(should, F.col("props")).alias("expected_arguments"))


def predictions(spark: SparkSession, sf_dir: str, kind: Column | None = None) -> DataFrame:
    kind = F.col("event_id") % 8 if kind is None else kind
    k = F.get_json_object("props", "$.k")
    call = lambda tool, args: F.concat(F.lit('{"name":"'), tool, F.lit('","arguments":{'), args, F.lit("}}"))
    own = F.concat(F.lit('"k": '), k)
    t = F.col("event_type")
    text = F.when(kind == 0, call(t, own)).when(kind == 1, F.concat(F.lit('{"arguments":{"k":'), k, F.lit('.0},"name":"'), t, F.lit('"}'))).when(kind == 2, call(F.lit("other"), own))
    text = text.when(kind == 3, call(t, F.lit(""))).when(kind == 4, call(t, F.concat(own, F.lit(',"z":1')))).when(kind == 5, call(t, F.concat(F.lit('"k":'), (k.cast("long") + 1).cast("string"))))
    text = text.when(kind == 6, F.concat(F.lit('{"name":"'), t, F.lit('",'))).otherwise(F.lit("No tool is needed here."))
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").cast("string").alias("example_id"), text.alias("generated_text"), F.abs("value").alias("latency_seconds"), F.lit(None).cast("double").alias("gpu_memory_mb"))


def _scored(spark: SparkSession, sf_dir: str, kind: Column | None = None, check: bool = False) -> DataFrame:
    # ids are equal by construction here; score_counts has the check that a run's own files get
    return scoring.score_examples(examples(spark, sf_dir), predictions(spark, sf_dir, kind), output_format="tagged", check=check, keep=("ord", "domain"))


def _flags(kind: str = "event_id % 8") -> str:
    return f"""
f AS (
  SELECT event_id, event_type AS domain, value, pos, m, m < 6 AS is_call, CASE WHEN pos THEN m < 6 ELSE m = 7 END AS sc,
         CASE WHEN pos THEN m IN (0, 1, 3, 4, 5) ELSE m = 7 END AS tool, CASE WHEN pos THEN m IN (0, 1, 2) END AS args,
         CASE WHEN pos THEN m IN (0, 1) ELSE m = 7 END AS exact,
         CAST(pos AND m IN (0, 1, 2, 4, 5) AS INT) AS tp, CAST(pos AND m = 4 AS INT) AS fp, CAST(pos AND m IN (3, 6, 7) AS INT) AS fn
  FROM (SELECT *, event_id % 5 <> 0 AS pos, {kind} AS m FROM events)
)"""


_COUNTS = """
count(*) AS examples, count(*) FILTER (pos) AS positive_examples, count(*) FILTER (NOT pos) AS negative_examples,
count(*) FILTER (m < 6) AS parse_success, count(*) FILTER (m < 6) AS valid_structured_output, count(*) FILTER (sc) AS should_call_correct,
count(*) FILTER (pos AND tool) AS tool_name_correct, count(*) FILTER (pos AND args) AS exact_arguments_correct,
count(*) FILTER (pos AND exact) AS exact_tool_calls_correct, count(*) FILTER (exact) AS exact_match,
count(*) FILTER (NOT pos AND exact) AS negative_case_correct, count(*) FILTER (NOT pos AND is_call) AS false_calls,
CAST(sum(tp) AS BIGINT) AS argument_key_tp, CAST(sum(fp) AS BIGINT) AS argument_key_fp, CAST(sum(fn) AS BIGINT) AS argument_key_fn"""

_RATES = """
parse_success / examples AS parse_success, valid_structured_output / examples AS valid_structured_output, should_call_correct / examples AS should_call_accuracy,
tool_name_correct / positive_examples AS tool_name_accuracy, exact_arguments_correct / positive_examples AS exact_argument_accuracy,
exact_tool_calls_correct / positive_examples AS exact_tool_call_accuracy, argument_key_tp / (argument_key_tp + argument_key_fp) AS argument_key_precision,
argument_key_tp / (argument_key_tp + argument_key_fn) AS argument_key_recall, 2 * argument_key_tp / (2 * argument_key_tp + argument_key_fp + argument_key_fn) AS argument_key_f1,
negative_case_correct / negative_examples AS negative_case_accuracy, false_calls / negative_examples AS false_call_rate"""


def score_counts(spark, sf_dir):
    return scoring.score_counts(_scored(spark, sf_dir, check=True))


def score_rates(spark, sf_dir):
    return scoring.score_rates(score_counts(spark, sf_dir))


def scored_examples(spark, sf_dir):
    return _scored(spark, sf_dir).select("id", "parse_success", "valid_structured_output", "is_call", "should_call_correct", "tool_selection_correct", "arguments_correct", "exact_match", "argument_key_tp", "argument_key_fp", "argument_key_fn", F.col("parse_error").isNotNull().alias("has_error"))


def score_by_category(spark, sf_dir):
    return scoring.category_accuracy(_scored(spark, sf_dir))


def argument_key_prf(spark, sf_dir):
    return scoring.score_rates(scoring.score_counts(_scored(spark, sf_dir), "domain"), "domain").select("domain", "argument_key_precision", "argument_key_recall", "argument_key_f1")


def _variant_rates(spark, sf_dir):
    kinds = {"base": F.col("event_id") % 8, "adapter": (F.col("event_id") * 3 + 1) % 8}
    parts = [scoring.score_rates(scoring.score_counts(_scored(spark, sf_dir, k))).select(F.lit(v).alias("variant"), "exact_tool_call_accuracy", "negative_case_accuracy", F.col("should_call_accuracy").alias("accuracy")) for v, k in kinds.items()]
    return parts[0].union(parts[1])


def paired_verdict(spark, sf_dir):
    rates = _variant_rates(spark, sf_dir)
    out = verdict.comparison(rates, rates.select("variant", "accuracy"), complete=True)
    return out.select(*[F.round(c, 9).alias(c) if c.endswith(("points", "reduction")) else F.col(c) for c in out.columns])


def paired_examples(spark, sf_dir):
    kinds = {"base": F.col("event_id") % 8, "adapter": (F.col("event_id") * 3 + 1) % 8}
    sides = {v: _scored(spark, sf_dir, k).select("id", "exact_match") for v, k in kinds.items()}
    return verdict.paired(examples(spark, sf_dir), sides["base"], sides["adapter"]).groupBy(F.col("base.exact_match").alias("base_exact"), F.col("adapter.exact_match").alias("adapter_exact")).agg(F.count("*").alias("n"))


def latency_summary(spark, sf_dir):
    p = predictions(spark, sf_dir)
    out = scoring.inference_totals(p.withColumn("latency_seconds", F.round("latency_seconds", 2).cast("decimal(18,2)")))
    return out.select(F.col("generation_seconds").cast("decimal(28,2)").cast("string").alias("generation_seconds"), "peak_allocated_gpu_mb")


def alternatives_accuracy(spark, sf_dir):
    ex = examples(spark, sf_dir).where("should_call_tool")
    k = F.get_json_object("expected_arguments", "$.k")
    ex = ex.withColumn("choices", F.concat(F.lit('{"k":['), k, F.lit(","), (k.cast("long") + 1).cast("string"), F.lit('],"z":["",1]}'))).withColumn("ground_truth", F.col("choices"))
    checked = runs.alternatives_accuracy(_scored(spark, sf_dir).where("should_call_tool"), ex)
    return scoring.accuracy(checked)


# ---------------------------------------------------------------- leakage


def _prompts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("id"), F.col("text").alias("user_utterance"))
    return d.where("doc_id % 5 <> 0"), d.where("doc_id % 5 = 0")


def exact_prompt_overlap(spark, sf_dir):
    train, held = _prompts(spark, sf_dir)
    return audit.exact_overlap(train, held).select("id")


def normalized_prompt_overlap(spark, sf_dir):
    train, held = _prompts(spark, sf_dir)
    return audit.normalized_overlap(train, held.withColumn("user_utterance", F.concat(F.upper("user_utterance"), F.lit("!")))).select("id")


def normalized_prompts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(normalized_prompt(F.col("text")), 256).alias("normalized_sha256"))


def _split_calls(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select("event_id", F.col("event_id").cast("string").alias("id"), F.lit(True).alias("should_call_tool"), F.col("event_type").alias("expected_tool_name"), F.concat(F.lit('{"k": '), (F.get_json_object("props", "$.k").cast("long") + F.col("user_id")).cast("string"), F.lit("}")).alias("expected_arguments"))
    return rows.where("event_id % 5 <> 0"), rows.where("event_id % 5 = 0")


def target_overlap(spark, sf_dir):
    train, held = _split_calls(spark, sf_dir)
    return audit.target_overlap(train, held).select("id")


def alternatives_overlap(spark, sf_dir):
    train, held = _split_calls(spark, sf_dir)
    k = F.get_json_object("expected_arguments", "$.k")
    answers = held.select("id", F.col("expected_tool_name").alias("tool"), F.lit(1).alias("n_calls"), F.concat(F.lit('{"k":['), k, F.lit(","), (k.cast("long") + 1).cast("string"), F.lit('],"z":["",1]}')).alias("choices"))
    return audit.alternatives_overlap(train, held, answers).select("id")


def _tools(rows: DataFrame) -> DataFrame:
    parameters = F.concat(F.lit('{"type":"object","properties":{"k":{"type":"integer"},"'), F.col("part"), F.lit('":{"type":"string"}}}'))
    return rows.select(F.array(F.struct(F.concat(F.lit("tool_"), F.col("part")).alias("name"), F.lit("made").alias("description"), parameters.alias("parameters"))).alias("available_tools"))


def structural_overlap(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("part"))
    return audit.structural_overlap(_tools(parts.where("p_partkey % 3 <> 0")), _tools(parts.where("p_partkey % 3 = 0"))).select(F.array_join("tool_names", ",").alias("tool_names"), "complete_tool_schemas", F.array_join("property_names", ",").alias("property_names"))


# ---------------------------------------------------------------- loaders, order, validation


def duplicate_id_repair(spark, sf_dir):
    return repaired_ids(table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("id"), F.col("event_id").alias("ord")))


def ordered_lookup(spark, sf_dir):
    """Names looked up in order: each order's parts by line."""
    asked = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey").alias("at"), F.col("l_partkey").alias("p_partkey"))
    found = benchmarks.ordered_lookup(asked, table(spark, sf_dir, "part"), "l_orderkey", "p_partkey", "at", "p_name", out="names")
    return found.select("l_orderkey", F.array_join("names", "|").alias("names"))


def prefix_limit(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey")
    return ordinals.prefix(o, 500, "o_orderpriority", "o_orderkey")


def even_sample(spark, sf_dir):
    return ordinals.even_sample(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), 100, "o_orderkey").select("ord", "o_orderkey")


def category_quota(spark, sf_dir):
    dims = spark.createDataFrame([(x,) for x in ("de", "en", "es", "fr", "it")], "category string")
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("category"))
    return labelled.category_quota(rows, dims, 100)


def first_violation(spark, sf_dir):
    """For each conversation the first broken rule: unknown role, first turn not the user's or system's, a text seen before in the corpus."""
    c = table(spark, sf_dir, "conversations")
    seen = c.groupBy("text").agg(F.min(F.struct("conv_id", "turn")).alias("first"))
    marked = c.join(seen, "text")
    rules = [
        ("unknown role", ~F.col("role").isin("user", "assistant", "system")),
        ("conversation must not start with the assistant", (F.col("turn") == 0) & (F.col("role") == "assistant")),
        ("text must be a non-empty string", F.trim("text") == ""),
        ("text must have at most 1500 characters", F.length("text") > 1500),
        ("duplicate text", F.struct("conv_id", "turn") != F.col("first")),
    ]
    found = records.violations(marked, rules, "conv_id", "turn")
    first = found.groupBy("conv_id").agg(F.min(F.struct("turn", "rule", "message")).alias("v"))
    return first.select("conv_id", "v.turn", "v.message")


def bare_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(bare_alef(F.concat(F.lit("أإآ "), F.col("text"))), 256).alias("bare_sha256"))


def prediction_violations(spark, sf_dir):
    p = predictions(spark, sf_dir).select("example_id", F.when(F.col("example_id").cast("long") % 7 != 0, F.lit("m")).alias("model_id"), F.lit("r").alias("model_revision"), F.when(F.col("example_id").cast("long") % 11 == 0, F.lit("  ")).otherwise("p").alias("prompt_version"), "generated_text", F.lit("{}").alias("generation_config"), F.when(F.col("example_id").cast("long") % 13 == 0, -1.0).otherwise(1.0).alias("latency_seconds"), "gpu_memory_mb")
    return records.violations(p, records.prediction_rules(), "example_id").groupBy("message").agg(F.count("*").alias("n"))


def windowed_events(spark, sf_dir):
    return windowed_counts(table(spark, sf_dir, "events"), width="1 day")


QUERIES: dict[str, Query] = made.QUERIES | {f.__name__: f for f in (score_counts, score_rates, scored_examples, score_by_category, argument_key_prf, paired_verdict, paired_examples, latency_summary, alternatives_accuracy, exact_prompt_overlap, normalized_prompt_overlap, normalized_prompts, target_overlap, alternatives_overlap, structural_overlap, duplicate_id_repair, ordered_lookup, prefix_limit, even_sample, category_quota, first_violation, bare_text, prediction_violations, windowed_events)}

_N1 = r"trim(regexp_replace(regexp_replace(replace(lower(nfc_normalize({0})), 'ß', 'ss'), '[\p{{M}}\p{{P}}\p{{S}}]', ' ', 'g'), '[\s\p{{Z}}]+', ' ', 'g'))"
_BOTH = f"WITH {_flags().strip()}, {_flags('(event_id * 3 + 1) % 8').strip().replace('f AS', 'g AS', 1)}"

SQL: dict[str, str] = made.SQL | {
    "score_counts": f"WITH {_flags()} SELECT {_COUNTS} FROM f",
    "score_rates": f"WITH {_flags()}, c AS (SELECT {_COUNTS} FROM f) SELECT {_RATES} FROM c",
    "scored_examples": f"WITH {_flags()} SELECT CAST(event_id AS VARCHAR) AS id, m < 6 AS parse_success, m < 6 AS valid_structured_output, is_call, sc AS should_call_correct, tool AS tool_selection_correct, args AS arguments_correct, exact AS exact_match, CAST(tp AS INT) AS argument_key_tp, CAST(fp AS INT) AS argument_key_fp, CAST(fn AS INT) AS argument_key_fn, m = 6 AS has_error FROM f",
    "score_by_category": f"WITH {_flags()} SELECT domain, count(*) FILTER (exact) AS correct, count(*) AS total, min(event_id) AS first_ord FROM f GROUP BY domain",
    "argument_key_prf": f"WITH {_flags()} SELECT domain, sum(tp) / sum(tp + fp) AS argument_key_precision, sum(tp) / sum(tp + fn) AS argument_key_recall, 2 * sum(tp) / sum(2 * tp + fp + fn) AS argument_key_f1 FROM f GROUP BY domain",
    "paired_verdict": f"""{_BOTH},
b AS (SELECT count(*) FILTER (pos AND exact) / count(*) FILTER (pos) AS e, count(*) FILTER (NOT pos AND exact) / count(*) FILTER (NOT pos) AS n, count(*) FILTER (sc) / count(*) AS s FROM f),
a AS (SELECT count(*) FILTER (pos AND exact) / count(*) FILTER (pos) AS e, count(*) FILTER (NOT pos AND exact) / count(*) FILTER (NOT pos) AS n, count(*) FILTER (sc) / count(*) AS s FROM g),
v AS (SELECT a.e - b.e AS gain, (a.e - b.e) / nullif(1 - b.e, 0) AS relative, a.n - b.n AS idle, a.s - b.s AS english FROM a, b)
SELECT round(100 * gain, 9) AS call_change_percentage_points, round(relative, 9) AS relative_error_reduction, round(100 * idle, 9) AS no_call_change_percentage_points,
round(100 * english, 9) AS english_change_percentage_points, gain >= 0.05 - 1e-12 OR coalesce(relative >= 0.25 - 1e-12, false) AS improvement, english >= -0.02 - 1e-12 AS english_preservation, idle >= 0 AS no_call_preservation,
(gain >= 0.05 - 1e-12 OR coalesce(relative >= 0.25 - 1e-12, false)) AND english >= -0.02 - 1e-12 AND idle >= 0 AS success FROM v""",
    "paired_examples": f"{_BOTH} SELECT f.exact AS base_exact, g.exact AS adapter_exact, count(*) AS n FROM f JOIN g USING (event_id) GROUP BY 1, 2",
    "latency_summary": "SELECT CAST(sum(CAST(round(abs(value), 2) AS DECIMAL(18, 2))) AS VARCHAR) AS generation_seconds, CAST(0 AS DOUBLE) AS peak_allocated_gpu_mb FROM events",
    "alternatives_accuracy": f"WITH {_flags()} SELECT count(*) FILTER (m IN (0, 1, 4, 5)) AS correct, count(*) AS total, count(*) FILTER (m IN (0, 1, 4, 5)) / count(*) AS accuracy FROM f WHERE pos",
    "exact_prompt_overlap": "SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE doc_id % 5 = 0 AND text IN (SELECT text FROM documents WHERE doc_id % 5 <> 0)",
    "normalized_prompt_overlap": f"SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE doc_id % 5 = 0 AND {_N1.format("upper(text) || '!'")} IN (SELECT {_N1.format('text')} FROM documents WHERE doc_id % 5 <> 0)",
    "normalized_prompts": f"SELECT doc_id, sha256({_N1.format('text')}) AS normalized_sha256 FROM documents",
    "target_overlap": "WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) + user_id AS k FROM events) SELECT CAST(event_id AS VARCHAR) AS id FROM e WHERE event_id % 5 = 0 AND EXISTS (SELECT 1 FROM e t WHERE t.event_id % 5 <> 0 AND t.event_type = e.event_type AND t.k = e.k)",
    "alternatives_overlap": "WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) + user_id AS k FROM events), t AS (SELECT DISTINCT event_type, k FROM e WHERE event_id % 5 <> 0) SELECT CAST(event_id AS VARCHAR) AS id FROM e WHERE event_id % 5 = 0 AND (EXISTS (SELECT 1 FROM t WHERE t.event_type = e.event_type AND t.k = e.k) OR EXISTS (SELECT 1 FROM t WHERE t.event_type = e.event_type AND t.k = e.k + 1))",
    "structural_overlap": "WITH o AS (SELECT DISTINCT p_brand AS b FROM part WHERE p_partkey % 3 <> 0 INTERSECT SELECT DISTINCT p_brand FROM part WHERE p_partkey % 3 = 0) SELECT string_agg('tool_' || b, ',' ORDER BY 'tool_' || b) AS tool_names, count(*) AS complete_tool_schemas, (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT b AS x FROM o UNION SELECT 'k')) AS property_names FROM o",
    "duplicate_id_repair": "SELECT CASE WHEN count(*) OVER (PARTITION BY user_id) = 1 THEN CAST(user_id AS VARCHAR) ELSE user_id || '::row-' || event_id END AS id, event_id AS ord FROM events",
    "ordered_lookup": "SELECT l_orderkey, string_agg(p_name, '|' ORDER BY l_linenumber, p_partkey, p_name) AS names FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey",
    "prefix_limit": "SELECT o_orderpriority, o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_orderkey) - 1 AS ord FROM orders ORDER BY o_orderpriority, o_orderkey LIMIT 500",
    "even_sample": "WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS ord, count(*) OVER () AS n FROM orders) SELECT ord, o_orderkey FROM o WHERE n <= 100 OR ord IN (SELECT (2 * i * ((SELECT count(*) FROM orders) - 1) + 99) // 198 FROM range(100) t(i))",
    "category_quota": "SELECT category, count(lang) AS rows, count(lang) = 100 AS ok FROM (VALUES ('de'), ('en'), ('es'), ('fr'), ('it')) d(category) LEFT JOIN documents ON lang = category GROUP BY category",
    "first_violation": """WITH c AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY conv_id, turn) AS rn FROM conversations),
v AS (SELECT conv_id, turn, CASE WHEN role NOT IN ('user', 'assistant', 'system') THEN 'unknown role' WHEN turn = 0 AND role = 'assistant' THEN 'conversation must not start with the assistant' WHEN trim(text) = '' THEN 'text must be a non-empty string' WHEN length(text) > 1500 THEN 'text must have at most 1500 characters' WHEN rn > 1 THEN 'duplicate text' END AS message FROM c)
SELECT conv_id, min(turn) AS turn, arg_min(message, turn) AS message FROM v WHERE message IS NOT NULL GROUP BY conv_id""",
    "bare_text": "SELECT doc_id, sha256(translate('أإآ ' || text, 'أإآ', 'ااا')) AS bare_sha256 FROM documents",
    "prediction_violations": """SELECT message, count(*) AS n FROM (SELECT 'model_id must be a non-empty string' AS message FROM events WHERE event_id % 7 = 0
UNION ALL SELECT 'prompt_version must be a non-empty string' FROM events WHERE event_id % 11 = 0 UNION ALL SELECT 'latency_seconds must be a finite non-negative number' FROM events WHERE event_id % 13 = 0) GROUP BY message""",
    "windowed_events": "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
