"""Near-duplicate vectors by a pivot-permutation index.

Method. Reference points (pivots) are a bounded sample of the vectors, thinned so that no two lie within twice the threshold's angle:
a crowded region has few of them, however many vectors it holds. Each vector is described by its nearest pivots in order. An
inverted list for each pivot holds the vectors that have it among their first ``near``; vectors that share at least ``shared`` pivots, or
one that is the nearest of either, are candidates, found list by list, and are verified by their cosine in double precision.

Balls. Before indexing, vectors that lie within ``ball`` degrees (by default half the angle of the threshold) of another one are put into its ball, first within a batch, then
across batches by their first pivot. Any two members of a ball are within the threshold, so a group of near copies that holds a third
of all rows is indexed as a few balls with weights and its pairs are never made. Two balls are compared by the angle between their
centres and their radii: if all their members must link, or none can, nothing more is done; else the members are compared, in blocks of
``MEMBERS`` by as many, each pair of blocks a task's group of its own.

Lists longer than ``block`` vectors are cut into blocks, and pairs of blocks are separate tasks, so no list is gathered in one. A pair that
shares several lists is reported by the least of them. A task gives numbers of links and what hangs together, not the linked pairs, so
a crowded list costs its comparisons and no more rows than it has vectors. The number of pivots grows with the square root of the number of vectors, the lists'
total work thus as its power 1.5, but a crowded region that balls don't shrink is compared in full; broadcast are pivots only (at most ``max_pivots`` vectors and ``PIVOT_BYTES``).

Edge cases. Vectors that are null, empty, zero or have null or non-finite components link with nothing; vectors of different
lengths don't link. Repeated rows are vectors of their own, linked with each other. Rows with a null id take part. An
empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stages, arrow_out, connected_components, frees_memory, partitions

_ITEM = pa.schema([("uid", pa.int64()), ("leader", pa.int64()), ("angle", pa.float64()), ("v", pa.list_(pa.float64())), ("top", pa.list_(pa.int32())), ("weight", pa.int64()), ("radius", pa.float64())])
_ITEM_DDL = "uid long, leader long, angle double, v array<double>, top array<int>, weight long, radius double"
_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("sure", pa.bool_()), ("n", pa.int64())])

#: Angles are known to about this much.
TINY = 1e-7
#: Bytes of the pivots that are broadcast, whatever the vectors' length; four times as many are looked at to find them.
PIVOT_BYTES = 32 << 20
#: Members of a ball in one block of a comparison with another ball.
MEMBERS = 4096
#: Centres of one pivot that are merged in one go.
MERGED = 4000
#: A list is cut into at most four blocks as long as these have no more vectors: each block travels once for every other one.
LONGEST = 16_384


def matrix(column: pa.Array) -> np.ndarray:
    """Equal lists of numbers as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def unit(x: np.ndarray) -> np.ndarray:
    """Vectors of length 1. The largest component is brought to between 1/2 and 1 first, by a power of two, so that no square over- or underflows."""
    _, power = np.frexp(np.abs(x).max(axis=1, keepdims=True, initial=0.0))
    x = np.ldexp(x, -power)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1, 1))


def thinned(x: np.ndarray, apart: float, most: int) -> np.ndarray:
    """Of unit vectors, in order, those with no earlier kept one within ``apart``; at most ``most``."""
    kept, bound = np.empty((0, x.shape[1])), math.cos(apart)
    for at in range(0, len(x), 1024):
        some = x[at : at + 1024]
        some = some[(some @ kept.T < bound).all(axis=1)]
        near = some @ some.T >= bound
        free = np.ones(len(some), bool)
        for k in range(len(some)):
            if free[k]:
                free[k + 1 :] &= ~near[k, k + 1 :]
        kept = np.concatenate([kept, some[free]])[:most]
        if len(kept) == most:
            break
    return kept


def nearest(x: np.ndarray, pivots: np.ndarray, near: int) -> np.ndarray:
    """The ordered nearest pivots of unit vectors; of equally near ones the first."""
    near = min(near, len(pivots))
    sims = x @ pivots.T
    some = np.argpartition(-sims, near - 1, axis=1)[:, :near] if near < len(pivots) else np.tile(np.arange(len(pivots)), (len(x), 1))
    return np.take_along_axis(some, np.lexsort((some, -np.take_along_axis(sims, some, 1))), 1).astype(np.int32)


def into_balls(x: np.ndarray, groups: np.ndarray, radius: np.ndarray, ball: float) -> tuple[np.ndarray, np.ndarray]:
    """Index of each vector's centre among the vectors of its group, and the angle to it. A vector joins the first centre within reach."""
    leader, angle = np.arange(len(x)), np.zeros(len(x))
    order = np.argsort(groups, kind="stable")
    for members in np.split(order, np.flatnonzero(np.diff(groups[order])) + 1):
        while len(members) > 1:
            far = angles(x[members] @ x[members[0]])
            far[0] = 0
            inside = far + radius[members] <= ball
            inside[0] = True
            leader[members[inside]], angle[members[inside]] = members[0], far[inside]
            members = members[~inside]
    return leader, angle


def _first_balls(batches: Iterator[pa.RecordBatch], shared, near: int, ball: float) -> Iterator[pa.RecordBatch]:
    pivots = shared.value
    for batch in batches:
        if not batch.num_rows:
            continue
        x = unit(matrix(batch.column(1)))
        yield _items(batch.column(0).to_numpy(), batch.column(1), x, nearest(x, pivots, near), np.ones(len(x), np.int64), np.zeros(len(x)), ball)


def _items(uid: np.ndarray, vectors: pa.Array, x: np.ndarray, top: np.ndarray, weight: np.ndarray, radius: np.ndarray, ball: float, part: np.ndarray | None = None) -> pa.RecordBatch:
    groups = top[:, 0] if part is None else np.unique(np.stack([top[:, 0], part], 1), axis=0, return_inverse=True)[1].reshape(-1)
    leader, angle = into_balls(x, groups, radius, ball)
    own = leader == np.arange(len(x))
    sums = np.bincount(leader, weight, minlength=len(x)).astype(np.int64)
    reach = np.zeros(len(x))
    np.maximum.at(reach, leader, angle + radius)
    mask = pa.array(own)
    pick = lambda values: pa.compute.if_else(mask, values, pa.nulls(len(x), values.type))
    tops = pa.FixedSizeListArray.from_arrays(pa.array(top.reshape(-1)), top.shape[1]).cast(pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array(uid), pa.array(uid[leader]), pa.array(angle), pick(vectors.cast(pa.list_(pa.float64()))), pick(tops), pick(pa.array(sums)), pick(pa.array(reach))], schema=_ITEM)


def _merged_balls(batches: Iterator[pa.RecordBatch], ball: float) -> Iterator[pa.RecordBatch]:
    for table in _by_partition(batches):
        yield _items(table.column(0).to_numpy(), table.column(3), unit(matrix(table.column(3))), matrix(table.column(4)).astype(np.int32), table.column(5).to_numpy(), table.column(6).to_numpy(), ball, table.column(7).to_numpy())


def _by_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def hanging_together(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewer edges with the same components: each end to the least of its component. Few edges stay as they are."""
    ends, at = np.unique(np.r_[a, b], return_inverse=True)
    if len(a) <= 2 * len(ends):
        return a, b
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(ends))
    while True:
        least = np.minimum(root[a], root[b])
        now = root.copy()
        np.minimum.at(now, a, least)
        np.minimum.at(now, b, least)
        np.minimum.at(now, root[a], least)
        np.minimum.at(now, root[b], least)
        now = now[now]
        if (now == root).all():
            break
        root = now
    own = np.flatnonzero(root != np.arange(len(ends)))
    return ends[root[own]], ends[own]


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: int, rows: int = 16_384) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by their first ``keys`` columns, runs of whole groups with about ``rows`` rows; a larger group comes alone."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        changes = np.zeros(size - 1, bool)
        for k in range(keys):
            changes |= np.diff(table.column(k).to_numpy()) != 0
        cut = 1 + int(np.flatnonzero(changes)[-1]) if changes.any() else 0
        if cut:
            yield table.slice(0, cut)
        held, size = [table.slice(cut)], size - cut
    yield from _by_partition(iter(held))


@frees_memory
def _candidates(batches: Iterator[pa.RecordBatch], shared: int, limit: float, cosine: float) -> Iterator[pa.RecordBatch]:
    """pivot, i, j, block, uid, v, top, radius, weight: pairs of a list's blocks i and j, verified by centres and radii.

    Gives (a, null, true, links of a), (a, b, true, 0) for what hangs together, and (a, b, false, 0) for balls whose members decide.
    """
    for table in _whole_groups(batches, 3):
        pivot, i, j, block, uid = (table.column(k).to_numpy() for k in range(5))
        x, top, radius, weight = unit(matrix(table.column(5))), matrix(table.column(6)).astype(np.int64), table.column(7).to_numpy(), table.column(8).to_numpy()
        rank = np.ones(top.shape[1], np.float32)
        rank[0] = shared = min(shared, top.shape[1])  # the product of two weights over common pivots is ``shared`` also where one is a nearest one
        order = np.lexsort((j, i, pivot))
        cuts = np.flatnonzero((np.diff(pivot[order]) != 0) | (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0)) + 1
        for members in np.split(order, cuts):
            first = members[0]
            same = i[first] == j[first]
            left = members if same else members[block[members] == i[first]]
            right = members if same else members[block[members] == j[first]]
            if not len(left) or not len(right):
                continue
            links = np.zeros(len(x))
            ones, others, unsure = [], [], []
            table_of = None
            widest = math.cos(min(math.pi, limit + 2 * TINY + radius[left].max() + radius[right].max())) if radius[members].any() else cosine
            for at in range(0, len(left), 1024):
                some = left[at : at + 1024]
                sims = x[some] @ x[right].T
                hit = sims >= min(widest, cosine)
                if same:
                    hit &= np.arange(at, at + len(some))[:, None] < np.arange(len(right))
                a, b = np.nonzero(hit)
                if not len(a):
                    continue
                if len(a) > 20_000:
                    if table_of is None:
                        names, inverse = np.unique(top[members], return_inverse=True)
                        held = np.zeros((len(members), len(names)), np.float32)
                        held[np.repeat(np.arange(len(members)), top.shape[1]), inverse.reshape(-1)] = np.tile(rank, len(members))
                        place = np.empty(len(x), np.int64)
                        place[members] = np.arange(len(members))
                        lower = int(np.searchsorted(names, pivot[first]))
                        table_of = held, place, lower
                    held, place, lower = table_of
                    u, v = held[place[some]], held[place[right]]
                    good = (u @ v.T >= shared) & (u[:, :lower] @ v[:, :lower].T == 0)
                    good = good[a, b]
                else:
                    ta, tb = top[some[a]], top[right[b]]
                    common = ta[:, :, None] == tb[:, None, :]
                    score = (common * rank[None, :, None] * rank[None, None, :]).sum((1, 2))
                    good = (score >= shared) & (np.where(common.any(2), ta, np.iinfo(np.int64).max).min(1) == pivot[first])
                a, b = a[good], b[good]
                near = sims[a, b]
                a, b = some[a], right[b]
                reach = radius[a] + radius[b]
                points = reach == 0
                far = angles(near)
                sure = np.where(points, near >= cosine, far + reach <= limit - TINY)
                doubt = ~sure & ~points & (far - reach <= limit + TINY)
                unsure.append((uid[a[doubt]], uid[b[doubt]]))
                a, b = a[sure], b[sure]
                links += np.bincount(a, weight[b], minlength=len(x)) + np.bincount(b, weight[a], minlength=len(x))
                a, b = hanging_together(uid[a], uid[b])
                ones.append(a)
                others.append(b)
            if not ones:
                continue
            linked = np.flatnonzero(links)
            a, b = hanging_together(np.concatenate(ones), np.concatenate(others))
            c, d = (np.concatenate(part) for part in zip(*unsure, strict=True))
            n = len(linked), len(a), len(c)
            yield arrow_out(
                _PAIR,
                a=np.r_[uid[linked], np.minimum(a, b), np.minimum(c, d)],
                b=pa.array(np.r_[uid[linked], np.maximum(a, b), np.maximum(c, d)], mask=np.arange(sum(n)) < n[0]),
                sure=np.arange(sum(n)) < n[0] + n[1],
                n=np.r_[links[linked], np.zeros(n[1] + n[2])].astype(np.int64),
            )


@frees_memory
def _members_compared(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """a, b, i, j, side, uid, v: block i of a ball's members and block j of another's; (a, b, uid, n) for those with links to the other block."""
    for table in _whole_groups(batches, 4):
        a, b, i, j, side, uid = (table.column(k).to_numpy(zero_copy_only=False) for k in range(6))
        x = unit(matrix(table.column(6)))
        order = np.lexsort((j, i, b, a))
        changes = np.diff(a[order]) != 0
        for key in (b, i, j):
            changes |= np.diff(key[order]) != 0
        for members in np.split(order, np.flatnonzero(changes) + 1):
            left, right = members[~side[members]], members[side[members]]
            n_left, n_right = np.zeros(len(left), np.int64), np.zeros(len(right), np.int64)
            for at in range(0, len(left), 1024):
                hit = x[left[at : at + 1024]] @ x[right].T >= cosine
                n_left[at : at + 1024] = hit.sum(1)
                n_right += hit.sum(0)
            who, n = np.r_[left, right], np.r_[n_left, n_right]
            who, n = who[n > 0], n[n > 0]
            yield pa.RecordBatch.from_arrays([pa.array(a[who]), pa.array(b[who]), pa.array(uid[who]), pa.array(n)], names=["a", "b", "uid", "n"])


def embedding_dedup(vectors: DataFrame, *, cosine: float = 0.9, near: int = 12, shared: int = 2, ball: float | None = None, block: int = 2000, min_pivots: int = 64, max_pivots: int = 65_536, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """``vectors`` with near_links (vectors linked directly), near_component (least id reachable, itself included) and near_kept."""
    spark = vectors.sparkSession
    stages = Stages(spark, "vectors")
    vectors = vectors.drop("near_links", "near_component", "near_kept")
    limit = math.acos(cosine)
    ball = min(math.inf if ball is None else math.radians(ball), limit / 2 - 1e-6)
    value = F.col("v")
    rows = stages.put(vectors.withColumn("near__uid", F.monotonically_increasing_id()), "rows")
    usable = rows.select(F.col("near__uid").alias("uid"), F.col(vector).cast("array<double>").alias("v"))
    usable = usable.where(F.col("v").isNotNull() & F.coalesce(F.forall(value, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False)) & F.coalesce(F.exists(value, lambda c: c != 0), F.lit(False)))
    kinds = [r["d"] for r in usable.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").collect()]
    counts, edges = [], []
    for size in kinds:
        mine = usable.where(F.size("v") == size)
        n = mine.count()
        pivots = max(min_pivots, min(max_pivots, PIVOT_BYTES // (8 * max(1, size)), 2 * math.isqrt(n)))
        points = mine.orderBy(F.xxhash64("uid"), "uid").limit(4 * pivots).select("v").toArrow().column(0).combine_chunks()
        held = spark.sparkContext.broadcast(thinned(unit(matrix(points)), min(2 * limit, math.pi / 2), pivots))
        first = stages.put(mine.mapInArrow(partial(_first_balls, shared=held, near=near, ball=ball), _ITEM_DDL), "balls")
        centres = first.where("v is not null").withColumn("pivot", F.col("top")[0])
        parts = centres.groupBy("pivot").agg(F.ceil(F.count("*") / MERGED).alias("parts"))
        centres = centres.join(parts, "pivot").select(*first.columns, F.pmod(F.xxhash64("uid"), F.col("parts")).alias("part"))
        second = stages.put(centres.repartition(partitions(spark), F.col("top")[0], "part").mapInArrow(partial(_merged_balls, ball=ball), _ITEM_DDL), "balls")
        balls = second.where("v is not null").select("uid", "v", "top", "weight", "radius")
        posts = balls.select(F.explode("top").alias("pivot"), "uid", "v", "top", "radius", "weight")
        blocks = posts.groupBy("pivot").agg(F.least(F.ceil(F.count("*") / block), F.greatest(F.lit(4), F.ceil(F.count("*") / LONGEST))).cast("int").alias("blocks"))
        posts = posts.join(blocks, "pivot").withColumn("block", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
        tasks = posts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("pivot", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "uid", "v", "top", "radius", "weight")
        pairs = tasks.repartition(2 * partitions(spark), "pivot", "i", "j").sortWithinPartitions("pivot", "i", "j").mapInArrow(partial(_candidates, shared=shared, limit=limit, cosine=cosine), "a long, b long, sure boolean, n long")
        pairs = stages.put(pairs, "pairs")
        # each vector's ball
        member = first.select("uid", F.col("leader").alias("centre")).join(second.select(F.col("uid").alias("centre"), F.col("leader").alias("ball")), "centre").select("uid", "ball")
        member = stages.put(member, "members")
        sure = pairs.where("sure and b is not null").select("a", "b")
        linked = pairs.where("b is null").groupBy("a").agg(F.sum("n").alias("more")).select(F.col("a").alias("ball"), "more")
        # balls that may or may not link: their members are compared
        doubt = pairs.where("not sure").select("a", "b")
        parts = balls.select("uid", F.ceil(F.col("weight") / MEMBERS).cast("int").alias("parts"))
        doubt = doubt.join(parts.select(F.col("uid").alias("a"), F.col("parts").alias("in_a")), "a").join(parts.select(F.col("uid").alias("b"), F.col("parts").alias("in_b")), "b")
        sides = doubt.select("a", "b", F.col("a").alias("ball"), F.lit(False).alias("side"), F.col("in_a").alias("own"), F.col("in_b").alias("others")).union(doubt.select("a", "b", F.col("b").alias("ball"), F.lit(True).alias("side"), F.col("in_b").alias("own"), F.col("in_a").alias("others")))
        asked = sides.join(member, "ball").join(mine, "uid").withColumn("mine", F.pmod(F.xxhash64("uid"), F.col("own")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
        asked = asked.select("a", "b", F.when(F.col("side"), F.col("other")).otherwise(F.col("mine")).alias("i"), F.when(F.col("side"), F.col("mine")).otherwise(F.col("other")).alias("j"), "side", "uid", "v")
        settled = stages.put(asked.repartition(2 * partitions(spark), "a", "b", "i", "j").sortWithinPartitions("a", "b", "i", "j").mapInArrow(partial(_members_compared, cosine=cosine), "a long, b long, uid long, n long"), "settled")
        own = settled.groupBy("uid").agg(F.sum("n").alias("own"))
        counted = member.join(balls.select(F.col("uid").alias("ball"), "weight"), "ball").join(linked, "ball", "left").join(own, "uid", "left")
        counts.append(counted.select("uid", "ball", (F.col("weight") - 1 + F.coalesce("more", F.lit(0)) + F.coalesce("own", F.lit(0))).alias("links")))
        edges.append(sure.union(settled.select("a", "b").distinct()))
    if not kinds:
        return rows.drop("near__uid").select("*", F.lit(0).cast("long").alias("near_links"), F.col(vec_id).alias("near_component"), F.lit(True).alias("near_kept"))
    counted, linked = counts[0], edges[0]
    for more in counts[1:]:
        counted = counted.union(more)
    for more in edges[1:]:
        linked = linked.union(more)
    found = connected_components(linked, stages, "a", "b").select(F.col("node").alias("ball"), "component")
    placed = counted.join(found, "ball", "left").select(F.col("uid").alias("near__uid"), F.coalesce("component", "ball").alias("root"), "links")
    named = stages.put(rows.select("near__uid", vec_id).join(placed, "near__uid"), "placed")
    least = named.groupBy("root").agg(F.min(vec_id).alias("near_component"))
    done = named.join(least, "root").select("near__uid", F.col("links").alias("near_links"), "near_component")
    out = rows.join(done, "near__uid", "left").drop("near__uid")
    out = out.withColumn("near_links", F.coalesce("near_links", F.lit(0).cast("long"))).withColumn("near_component", F.coalesce("near_component", vec_id))
    return out.withColumn("near_kept", F.col(vec_id).eqNullSafe(F.col("near_component")))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), cosine=0.9)
    return out.select("vec_id", F.col("near_links").alias("n_links"), F.col("near_component").alias("component_id"), F.col("near_kept").alias("kept"))


#: All pairs. The index is approximate; where it misses a link, the rows differ.
OP9_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
n AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS norm FROM v WHERE list_inner_product(e, e) > 0),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM n x JOIN n y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_inner_product(x.e, y.e) / (x.norm * y.norm) >= 0.9),
r(vec_id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.root = l.a),
c AS (SELECT vec_id, min(root) AS component_id FROM r GROUP BY vec_id),
k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT c.vec_id, coalesce(k.n, 0) AS n_links, c.component_id, c.vec_id = c.component_id AS kept FROM c LEFT JOIN k ON k.a = c.vec_id
"""
