"""Preference formatting: chosen and rejected conversations as one prompt and two masked completions.

Method. The two sides of a pair are aligned turn by turn (an equi-join on pair and place, no conversation is gathered). The first
place at which role or text differ, or one side ends, is the minimum of a grouped aggregation: the longest common turn prefix is what stands
before it. Each prefix turn is rendered once, as ``prompt``; each later turn as ``chosen`` or ``rejected``. Rows are segments in order: what a
row renders, where it starts in its part, and its mask: 1 for what is trained on (what the assistant says after the prefix, with its end
mark), 0 for all else. Concatenating a part's segments gives its text.

Starts are running sums of lengths. They are made in two steps, so that one long conversation isn't sorted in a task: sums of blocks
of turns, running sums of these, and running sums within a block. ``rendered`` gathers whole texts where conversations are known to be of
bounded size.

Edge cases. Turns with null pair, side or place are left out. A null role counts as ``user``, a null text as empty. Of turns with the same
pair, side and place the least role and text holds, repeated ones once. A pair with one side only has status ``unpaired`` and all its turns in
the prompt; equal sides give ``identical``, no completion rows. Sides that differ from the start give an empty prompt, without rows. Unknown roles are rendered
by their name. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Turns of a block in the two-step running sums.
BLOCK = 256

# The marks around a turn.
START, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit(MIDDLE), text, F.lit(END))


def preference_segments(turns: DataFrame) -> DataFrame:
    """(pair_id, part, seq, role, segment, start, mask_from, mask_length, status) from rows (pair_id, side, turn, role, text).

    side: ``chosen`` or ``rejected``. part: ``prompt``, ``chosen`` or ``rejected``. seq: the turn's place in its side, from 0. start: the segment's place in its part, in characters;
    mask_from and mask_length: what of the segment is trained on.
    """
    clean = turns.where(F.col("pair_id").isNotNull() & F.col("turn").isNotNull() & F.col("side").isin("chosen", "rejected"))
    clean = clean.select("pair_id", "side", "turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    clean = clean.groupBy("pair_id", "side", "turn").agg(F.min(F.struct("role", "text")).alias("t"))
    sides = clean.groupBy("pair_id", "turn").agg(F.max(F.when(F.col("side") == "chosen", F.col("t"))).alias("c"), F.max(F.when(F.col("side") == "rejected", F.col("t"))).alias("r"))
    differs = ~F.col("c").eqNullSafe(F.col("r"))
    pairs = sides.groupBy("pair_id").agg(F.min(F.when(differs, F.col("turn"))).alias("cut"), F.bool_or(F.col("c").isNotNull()).alias("has_c"), F.bool_or(F.col("r").isNotNull()).alias("has_r"))
    status = F.when(~F.col("has_c") | ~F.col("has_r"), "unpaired").when(F.col("cut").isNull(), "identical").otherwise("paired")
    pairs = pairs.select("pair_id", F.when(F.col("has_c") & F.col("has_r"), F.col("cut")).alias("cut"), status.alias("status"))
    rows = sides.join(pairs, "pair_id")
    shared = F.col("cut").isNull() | (F.col("turn") < F.col("cut"))
    entry = lambda part, t: F.struct(F.lit(part).alias("part"), F.col(t)["role"].alias("role"), F.col(t)["text"].alias("text"))
    parts = F.when(shared, F.array(F.when(F.col("c").isNotNull(), entry("prompt", "c")).otherwise(entry("prompt", "r")))).otherwise(F.filter(F.array(F.when(F.col("c").isNotNull(), entry("chosen", "c")), F.when(F.col("r").isNotNull(), entry("rejected", "r"))), lambda x: x.isNotNull()))
    out = rows.select("pair_id", "turn", "status", F.explode(parts).alias("p")).select("pair_id", "status", "turn", "p.part", "p.role", "p.text")
    out = out.withColumn("segment", render(F.col("role"), F.col("text"))).withColumn("size", F.length("segment").cast("long")).withColumn("block", F.floor(F.col("turn") / BLOCK))
    # running sums in two steps
    blocks = out.groupBy("pair_id", "part", "block").agg(F.sum("size").alias("chars"), F.count("*").alias("turns"))
    before = Window.partitionBy("pair_id", "part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("pair_id", "part", "block", F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("chars"), F.coalesce(F.sum("turns").over(before), F.lit(0)).alias("turns"))
    inside = Window.partitionBy("pair_id", "part", "block").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0))).withColumn("seq", F.coalesce(F.count("*").over(inside), F.lit(0)))
    out = out.join(blocks, ["pair_id", "part", "block"])
    trained = (F.col("part") != "prompt") & (F.col("role") == "assistant")
    head = F.length(F.lit(START)) + F.length("role") + F.length(F.lit(MIDDLE))
    return out.select("pair_id", "part", (F.col("seq") + F.col("turns")).alias("seq"), "role", "segment", (F.col("start") + F.col("chars")).alias("start"), F.when(trained, head).otherwise(0).cast("long").alias("mask_from"), F.when(trained, F.col("size") - head).otherwise(0).cast("long").alias("mask_length"), "status")


def rendered(segments: DataFrame) -> DataFrame:
    """(pair_id, status, prompt, chosen, rejected, chosen_spans, rejected_spans): whole texts and their trained spans. For conversations of bounded size."""
    whole = segments.groupBy("pair_id", "status", "part").agg(F.array_sort(F.collect_list(F.struct("seq", "segment", (F.col("start") + F.col("mask_from")).alias("a"), (F.col("start") + F.col("mask_from") + F.col("mask_length")).alias("b")))).alias("s"))
    text, spans = F.array_join("s.segment", ""), F.filter(F.transform("s", lambda x: F.struct(x["a"].alias("start"), x["b"].alias("end"))), lambda x: x["start"] < x["end"])
    pick = lambda part, value: F.max(F.when(F.col("part") == part, value))
    return whole.withColumn("t", text).withColumn("m", spans).groupBy("pair_id", "status").agg(*[F.coalesce(pick(p, F.col("t")), F.lit("")).alias(p) for p in ("prompt", "chosen", "rejected")], *[F.coalesce(pick(p, F.col("m")), F.array().cast("array<struct<start:bigint,end:bigint>>")).alias(f"{p}_spans") for p in ("chosen", "rejected")])


def paired_turns(conversations: DataFrame) -> DataFrame:
    """Two sides for each conversation that has a partner (the lowest bit of its id flipped): its own turns as chosen; as rejected the same up to its
    last assistant turn, and there the partner's last assistant turn. Without a partner's answer there is no rejected side."""
    told = conversations.select("conv_id", "turn", "role", "text")
    last = told.where((F.col("role") == "assistant") & F.col("turn").isNotNull()).groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("l")).select("conv_id", F.col("l.turn").alias("last"), F.col("l.text").alias("answer"))
    other = last.select(F.col("conv_id").bitwiseXOR(F.lit(1).cast("long")).alias("conv_id"), F.col("answer").alias("other"), F.lit(True).alias("has"))
    joined = told.join(last, "conv_id", "left").join(other, "conv_id", "left")
    chosen = F.struct(F.lit("chosen").alias("side"), F.col("text").alias("text"))
    rejected = F.when(F.coalesce("has", F.lit(False)) & (F.col("turn") <= F.col("last")), F.struct(F.lit("rejected").alias("side"), F.when(F.col("turn") == F.col("last"), F.col("other")).otherwise(F.col("text")).alias("text")))
    out = joined.select(F.col("conv_id").alias("pair_id"), "turn", "role", F.explode(F.filter(F.array(chosen, rejected), lambda x: x.isNotNull())).alias("s"))
    return out.select("pair_id", "s.side", "turn", "role", "s.text")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = preference_segments(paired_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return out.select("pair_id", "status", "part", "seq", "role", "start", F.length("segment").cast("long").alias("length"), "mask_from", "mask_length", F.sha2(F.col("segment").cast("binary"), 256).alias("segment_sha256"))


OP1_SQL = r"""
WITH t AS (
  SELECT conv_id AS id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text, role AS raw FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
),
d AS (SELECT id, turn, min({'role': role, 'text': text}) AS t FROM t GROUP BY id, turn),
last AS (SELECT id, max({'turn': turn, 'text': text}) AS l FROM t WHERE raw = 'assistant' GROUP BY id),
j AS (
  SELECT t.id, t.turn, t.role, t.text, a.l.turn AS last, b.l.text AS other, b.id IS NOT NULL AS has
  FROM t LEFT JOIN last a ON a.id = t.id LEFT JOIN last b ON b.id = xor(t.id, 1)
),
c AS (SELECT id, turn, min({'role': role, 'text': text}) AS x FROM j GROUP BY id, turn),
r AS (SELECT id, turn, min({'role': role, 'text': CASE WHEN turn = last THEN other ELSE text END}) AS x FROM j WHERE has AND turn <= last GROUP BY id, turn),
s AS (SELECT coalesce(c.id, r.id) AS id, coalesce(c.turn, r.turn) AS turn, c.x AS c, r.x AS r FROM c FULL JOIN r ON c.id = r.id AND c.turn = r.turn),
p AS (
  SELECT id, min(CASE WHEN c IS DISTINCT FROM r THEN turn END) AS cut, bool_or(c IS NOT NULL) AS hc, bool_or(r IS NOT NULL) AS hr FROM s GROUP BY id
),
q AS (
  SELECT s.*, CASE WHEN hc AND hr THEN cut END AS cut, CASE WHEN NOT hc OR NOT hr THEN 'unpaired' WHEN cut IS NULL THEN 'identical' ELSE 'paired' END AS status
  FROM s JOIN p USING (id)
),
u AS (
  SELECT id, status, turn, 'prompt' AS part, coalesce(c, r) AS x FROM q WHERE cut IS NULL OR turn < cut
  UNION ALL SELECT id, status, turn, 'chosen', c FROM q WHERE turn >= cut AND c IS NOT NULL
  UNION ALL SELECT id, status, turn, 'rejected', r FROM q WHERE turn >= cut AND r IS NOT NULL
),
v AS (SELECT id, status, turn, part, x.role AS role, '<|im_start|>' || x.role || chr(10) || x.text || '<|im_end|>' || chr(10) AS seg FROM u)
SELECT id AS pair_id, status, part, row_number() OVER w - 1 AS seq, role,
       CAST(sum(length(seg)) OVER w - length(seg) AS BIGINT) AS start, length(seg) AS length,
       CASE WHEN part <> 'prompt' AND role = 'assistant' THEN 13 + length(role) ELSE 0 END AS mask_from,
       CASE WHEN part <> 'prompt' AND role = 'assistant' THEN length(seg) - 13 - length(role) ELSE 0 END AS mask_length,
       sha256(seg) AS segment_sha256
FROM v WINDOW w AS (PARTITION BY id, part ORDER BY turn)
"""
