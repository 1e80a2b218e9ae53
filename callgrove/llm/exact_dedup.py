"""Exact duplicates: group by a 128-bit content hash, keep the smallest id, compare bytes inside groups.

Plan. One scan computes the normalised text's MD5 next to the id; hash, id and a count are all that the grouping
shuffles (partial aggregation first, so a group of copies that holds a third of the rows arrives as a few rows).
Only rows of groups with two or more members carry their text into the byte comparison: each is joined to the text of
its group's first row, a plain equi-join whose hot keys Spark splits. Rows that differ from it (a collision) are grouped
again by hash and text, which is exact.

Edge cases. Null text counts as empty; empty texts are copies of each other. Null ids come after all others. Of repeated
rows with the same id and text one stays, the one whose other columns have the least hash. An empty table gives an empty result. Columns that the operator adds start
with ``dedup_`` and replace none of the input's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stages


def normalised(text: Column) -> Column:
    """Every run of the six ASCII white-space bytes as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_dedup(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", content_hash: Callable[[Column], Column] = F.md5) -> DataFrame:
    """``docs`` with dedup_keep_id, dedup_group_size, dedup_kept and dedup_sha256.

    content_hash: any hash of the normalised text; a weak one costs time, not correctness.
    """
    stages = Stages(docs.sparkSession, "exact")
    docs = docs.drop("dedup_keep_id", "dedup_group_size", "dedup_kept", "dedup_sha256")
    base, ident = docs.columns, F.col(doc_id)
    bytes_ = normalised(F.col(text)).cast("binary")
    keyed = docs.withColumn("dedup__hash", content_hash(bytes_))
    ids = keyed.select("dedup__hash", F.struct(ident.isNull().alias("n"), ident.alias("id")).alias("i"))
    per_id = ids.groupBy("dedup__hash", "i").agg(F.count("*").alias("c"))
    groups = per_id.groupBy("dedup__hash").agg(F.min(F.struct("i", "c")).alias("m"), F.sum("c").alias("dedup__size"))
    groups = stages.put(groups.select("dedup__hash", F.col("m.i.id").alias("dedup_keep_id"), F.col("m.c").alias("dedup__twins"), "dedup__size"), "groups")

    # the digest is made before the join, so rows without copies needn't carry their text for it
    joined = keyed.withColumn("dedup_sha256", F.sha2(bytes_, 256)).join(groups, "dedup__hash")
    single = joined.where("dedup__size = 1").withColumn("dedup_group_size", F.lit(1).cast("long")).withColumn("dedup_kept", F.lit(True))

    # the byte comparison: members against the text of their group's first row
    members = stages.put(joined.where("dedup__size > 1").withColumn("dedup__text", normalised(F.col(text))), "members")
    is_first = ident.eqNullSafe(F.col("dedup_keep_id"))
    # staged, so that the join has plain exchanges on both sides, whose hot keys Spark can split
    first = stages.put(members.where(is_first).groupBy("dedup__hash").agg(F.min("dedup__text").alias("dedup__first")), "first")
    compared = members.join(first, "dedup__hash").withColumn("dedup__equal", F.col("dedup__text") == F.col("dedup__first")).drop("dedup__first")
    odd = stages.put(compared.where("not dedup__equal"), "odd")
    fewer = odd.groupBy("dedup__hash").agg(F.count("*").alias("dedup__odd"))
    same = compared.where("dedup__equal").join(fewer, "dedup__hash", "left")
    same = same.withColumn("dedup_group_size", F.col("dedup__size") - F.coalesce("dedup__odd", F.lit(0))).withColumn("dedup_kept", is_first)
    # collisions: hash and text together are exact
    again = odd.groupBy("dedup__hash", "dedup__text").agg(F.min(F.struct(ident.isNull(), ident.alias("id"))).alias("m"), F.count("*").alias("dedup_group_size"))
    other = odd.drop("dedup_keep_id").join(again.select("dedup__hash", "dedup__text", F.col("m.id").alias("dedup_keep_id"), "dedup_group_size"), ["dedup__hash", "dedup__text"]).withColumn("dedup_kept", is_first)

    result = [*base, "dedup_keep_id", "dedup_group_size", "dedup_kept", "dedup_sha256"]
    # repeated rows of one id and text: one of them stays. Only such rows meet the window.
    alone = same.where("dedup__twins = 1 or not dedup_kept")
    marked = [*result, "dedup__hash"]
    twins = same.where("dedup__twins > 1 and dedup_kept").select(marked).union(other.where("dedup_kept").select(marked))
    rest_of_row = F.xxhash64(*[c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind])
    order = Window.partitionBy("dedup__hash", "dedup_sha256", "dedup_keep_id").orderBy(rest_of_row)
    twins = twins.withColumn("dedup_kept", F.row_number().over(order) == 1)
    rest = other.where("not dedup_kept")
    out = single.select(result)
    for part in (alone, twins, rest):
        out = out.union(part.select(result))
    return out


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", F.col("dedup_keep_id").alias("keep_id"), F.col("dedup_group_size").alias("group_size"), F.col("dedup_kept").alias("kept"), F.col("dedup_sha256").alias("text_sha256"))


OP3_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM t
"""
