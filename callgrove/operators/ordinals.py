"""Ordinals over a whole table without a single task (a range sort, counts per range, and places inside them), and rows at given ranks without ordinals of all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.store import shared_dir


def with_ordinals(rows: DataFrame, *order: str | Column, name: str = "ord") -> DataFrame:
    """``rows`` with their 0-based place in this order. Ties get places in some order, the same whenever the result is read."""
    spark = rows.sparkSession
    if not spark.sparkContext.getCheckpointDir():  # the shared folder; one of our own only where none is set
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    ranged = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("ord__part", F.spark_partition_id()).checkpoint()
    inside = F.row_number().over(Window.partitionBy("ord__part").orderBy(*order))
    parts = ranged.groupBy("ord__part").agg(F.count("*").alias("ord__n"))
    before = F.coalesce(F.sum("ord__n").over(Window.orderBy("ord__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
    parts = parts.select("ord__part", before.alias("ord__before"))
    return ranged.withColumn("ord__at", inside).join(F.broadcast(parts), "ord__part").withColumn(name, F.col("ord__before") + F.col("ord__at") - 1).drop("ord__part", "ord__at", "ord__before")


def prefix(rows: DataFrame, limit: int, *order: str | Column, name: str = "ord") -> DataFrame:
    """The first ``limit`` rows in this order, numbered from 0; fewer are an error when the result is read. The rows of a top-k, so numbering them is cheap."""
    if limit < 1:
        raise ValueError("limit must be positive")
    numbered = rows.orderBy(*order).limit(limit).withColumn(name, (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))
    total = F.count("*").over(Window.partitionBy(F.lit(1)))
    checked = numbered.withColumn("prefix__n", total)
    short = F.when(F.col("prefix__n") < limit, F.raise_error(F.format_string("requested %d rows, found %d", F.lit(limit), F.col("prefix__n"))).cast("long"))
    return checked.withColumn(name, F.coalesce(short, F.col(name))).drop("prefix__n")


#: Ranges that order statistics are looked for in (the square of this), and keys that are sampled for each.
_SIDE, _DRAWN = 32, 40


def _bound(key: Column, bounds: list, kind: T.StructType) -> Column:
    """How many of the bounds, sorted, are less than the key, by two looks at a few of them."""
    at = lambda row: F.struct(*[F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in kind])
    groups = [bounds[i : i + _SIDE] for i in range(0, len(bounds), _SIDE)]
    less = lambda rows: F.size(F.filter(rows, lambda b: b < key))
    coarse = less(F.array(*[at(g[-1]) for g in groups]))
    inside = F.element_at(F.array(*[F.array(*map(at, g)) for g in groups], F.array(*map(at, groups[-1]))), coarse + 1)
    return F.when(coarse < len(groups), coarse * _SIDE + less(inside)).otherwise(len(bounds))


def rows_at(rows: DataFrame, ranks: list[int], *order: str, name: str = "ord") -> DataFrame:
    """The rows at these 0-based ranks in the order of some columns (nulls first), with their ranks. Ties are ordered by a hash of the whole row.

    A multi-select: a bounded sample of keys cuts the order into about a thousand ranges, a grouped count tells how many rows each has, and only ranges that hold one of the ranks are numbered. So rows aren't
    sorted as a whole, and what is read besides the keys is about as many thousandths of them as there are ranks. The sample decides how even the ranges are, never the result.
    """
    n, wanted = rows.count(), sorted(set(ranks))
    if wanted and not 0 <= wanted[0] <= wanted[-1] < n:
        raise ValueError(f"ranks must be between 0 and {n - 1}")
    key, most = F.struct(*order), _DRAWN * _SIDE * _SIDE
    drawn = rows.select(key.alias("k"))
    if n > most:
        drawn = drawn.sample(min(1.0, 1.5 * most / n), seed=1)
    found = drawn.limit(most).groupBy("k").agg(F.count("*").alias("n")).orderBy("k").collect()
    total, bounds, upto, step = sum(r.n for r in found), [], 0, 0
    for r in found[:-1]:
        upto += r.n
        if upto * _SIDE * _SIDE >= (step + 1) * total:
            step = upto * _SIDE * _SIDE // total
            bounds.append(r.k)
    part = _bound(key, bounds, rows.select(key.alias("k")).schema["k"].dataType) if bounds else F.lit(0)
    sizes = {r.part: r.n for r in rows.select(part.alias("part")).groupBy("part").agg(F.count("*").alias("n")).collect()}
    before, starts = 0, {}
    for p in sorted(sizes):
        starts[p], before = before, before + sizes[p]
    held = {p: [r for r in wanted if a <= r < a + sizes[p]] for p, a in starts.items()}
    used = [p for p in starts if held[p]]
    picked, numbered = [], 0  # places among the rows of used ranges
    for p in used:
        picked += [(numbered + r - starts[p], r) for r in held[p]]
        numbered += sizes[p]
    some = with_ordinals(rows.where(part.isin(used)).withColumn("rank__tie", F.xxhash64(*rows.columns)), *order, "rank__tie", name="rank__at").drop("rank__tie")
    return some.join(F.broadcast(rows.sparkSession.createDataFrame(picked, f"rank__at long, `{name}` long")), "rank__at").drop("rank__at")


def even_sample(rows: DataFrame, size: int, *order: str) -> DataFrame:
    """``size`` evenly spaced rows in this order, the first and the last among them (all rows if they are fewer). Only the ranges that hold one are numbered."""
    n = rows.count()
    if n <= size:
        return with_ordinals(rows, *order)
    return rows_at(rows, [(2 * i * (n - 1) + (size - 1)) // (2 * (size - 1)) for i in range(size)], *order)
