"""N-gram Jaccard join by vertical partitioning: near duplicates over sets of word n-grams, exact at any threshold.

Method. The global n-gram order is cut into fragments (ranges of the n-gram's hash). Each fragment sees its slice of
every set and nothing else; what it counts is summed per document or per pair:

1. Fragments count in how many different sets each n-gram occurs. N-grams of one set only cannot overlap with
   anything; a set with more of them than the threshold leaves room for has no partner and is out. The others keep their
   shared n-grams, each with its frequency.
2. A set's first ``slack + 1`` n-grams, rarest first, are its prefix; two sets that link share an n-gram of both
   prefixes (prefix filter) and have sizes within the threshold (length bands).
3. Candidate pairs are verified by fragments again: a task holds one vertical slice of the sets of some pairs and counts
   partial overlaps; the partial counts are summed per pair.

Copies (equal sets) are collapsed before, so no pair of copies is ever made. Within the sets that share a prefix n-gram,
every set is first compared with one of them only; components are drawn from these links, and then only pairs of
different components are left to compare, all of them. So a large group of near copies costs one comparison a member,
and no component is missed. A set that meets very many others is salted over several tasks.

Cost. Texts are hashed once and never shuffled; the largest shuffle holds 6 bytes per distinct n-gram of a document.
The fragments' number follows the session's shuffle partitions, so a fragment's memory stays the same as both grow.

Equality of n-grams is that of 48-bit (pairs) and 64-bit (sets) hashes, which aren't linear in a word's bytes; two different n-grams of a pair of documents with
10,000 n-grams each fall together with a chance of 4e-7.

Edge cases. Null and empty texts and texts without words have an empty set and link with nothing: their component is
their own id. Texts shorter than an n-gram are one n-gram as a whole. Rows with a null id are returned with their
component: the smallest id linked, or null. Repeated rows are copies of each other. An empty table gives no rows.
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

from .common import U64, Stages, connected_components, frees_memory, mix, partitions, shingle_sets, text_batches, text_slices

#: Bits of an n-gram's hash that travel.
BITS = 48

_BLOB = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("key", pa.int64()), ("key2", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("ns", pa.binary()), ("counts", pa.binary()), ("tokens", pa.binary()), ("dfs", pa.binary())])
_BLOB_DDL = "part int, doc_id long, key long, key2 long, n long, keys binary, ns binary, counts binary, tokens binary, dfs binary"
_SETS_DDL = "doc_id long, key long, key2 long, n long, own long, tokens binary, prefix array<long>"
_SETS = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("key2", pa.int64()), ("n", pa.int64()), ("own", pa.int64()), ("tokens", pa.binary()), ("prefix", pa.list_(pa.int64()))])


def pack(tokens: np.ndarray) -> bytes:
    """48-bit numbers in six bytes each."""
    return np.ascontiguousarray(tokens.view(np.uint16).reshape(-1, 4)[:, :3]).tobytes()


def unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 4), np.uint16)
    out[:, :3] = np.frombuffer(raw, np.uint16).reshape(-1, 3)
    return out.view(U64).reshape(-1)


def slack(n: np.ndarray | int, percent: int):
    """How many n-grams of a set of n its partner may lack."""
    return n - -(-percent * n // 100)


def _by_part(parts: np.ndarray, n_parts: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(parts.astype(np.uint16 if n_parts <= 65536 else np.int64), kind="stable")
    return order, np.searchsorted(parts[order], np.arange(n_parts + 1))


@frees_memory
def _cut(batches: Iterator[pa.RecordBatch], words: int, fragments: int) -> Iterator[pa.RecordBatch]:
    """Sets of n-grams cut into fragments; and a row per document."""
    shift = U64(64 - int(math.log2(fragments)))
    for batch in batches:
        ids = batch.column(0)
        for a, b, data, offsets in text_slices(batch, "text"):
            sets = shingle_sets(data, offsets, words)
            n = np.array([len(s) for s in sets], np.int64)
            flat = np.concatenate(sets) if sets else np.zeros(0, U64)
            ends = np.cumsum(n)
            sums = np.concatenate([[U64(0)], np.cumsum(mix(flat.copy()), dtype=U64)])
            more = np.concatenate([[U64(0)], np.cumsum(mix(flat * U64(0x9E3779B97F4A7C15) + U64(1)), dtype=U64)])
            key = mix(sums[ends] - sums[ends - n] + n.astype(U64)).view(np.int64)
            key2 = mix(more[ends] - more[ends - n] + n.astype(U64)).view(np.int64)
            rows = b - a
            nulls = pa.nulls(rows, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array((key % fragments).astype(np.int32)), ids.slice(a, rows), pa.array(key), pa.array(key2), pa.array(n), *[nulls] * 5], schema=_BLOB)
            if not len(flat):
                continue
            frag = (flat >> shift).astype(np.int64) if fragments > 1 else np.zeros(len(flat), np.int64)
            doc = np.repeat(np.arange(rows), n)
            order, at = _by_part(frag, fragments)
            tokens, doc = (flat >> U64(64 - BITS))[order], doc[order]
            out = {k: [] for k in ("part", "keys", "ns", "counts", "tokens")}
            for f in range(fragments):
                lo, hi = at[f], at[f + 1]
                if lo == hi:
                    continue
                first = np.flatnonzero(np.r_[True, doc[lo + 1 : hi] != doc[lo : hi - 1]])
                d = doc[lo:hi][first]
                out["part"].append(f)
                out["keys"].append(key[d].tobytes())
                out["ns"].append(n[d].astype(np.uint32).tobytes())
                out["counts"].append(np.diff(np.r_[first, hi - lo]).astype(np.uint32).tobytes())
                out["tokens"].append(pack(tokens[lo:hi]))
            k = len(out["part"])
            none = pa.nulls(k, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(out["part"], pa.int32()), none, none, none, none, *[pa.array(out[c], pa.binary()) for c in ("keys", "ns", "counts", "tokens")], pa.nulls(k, pa.binary())], schema=_BLOB)


def _collected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | dict[int, list[tuple[bytes, ...]]]]:
    """Rows of documents pass; blobs are gathered by part and come last."""
    held: dict[int, list[tuple[bytes, ...]]] = {}
    for batch in batches:
        blob = batch.column(5).is_valid()
        docs = batch.filter(pa.compute.invert(blob))
        if docs.num_rows:
            yield docs
        blobs = batch.filter(blob)
        for part, *values in zip(*(blobs.column(i).to_pylist() for i in (0, 5, 6, 7, 8, 9)), strict=True):
            held.setdefault(part, []).append(tuple(values))
    yield held


def _segments(blobs: list[tuple[bytes, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    keys = np.frombuffer(b"".join(x[0] for x in blobs), np.int64)
    ns = np.frombuffer(b"".join(x[1] for x in blobs), np.uint32)
    counts = np.frombuffer(b"".join(x[2] for x in blobs), np.uint32).astype(np.int64)
    return keys, ns, counts, unpack(b"".join(x[3] for x in blobs))


@frees_memory
def _count(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Of each fragment the n-grams that several different sets hold, dealt by set."""
    for item in _collected(batches):
        if isinstance(item, pa.RecordBatch):
            yield item
            continue
        for part in list(item):
            keys, ns, counts, tokens = _segments(item.pop(part))
            _, first = np.unique(keys, return_index=True)  # copies count once
            chosen = np.zeros(len(keys), bool)
            chosen[first] = True
            tokens = tokens[np.repeat(chosen, counts)]
            keys, ns, counts = keys[chosen], ns[chosen], counts[chosen]
            order = np.argsort(tokens)
            edges = np.flatnonzero(np.r_[True, np.diff(tokens[order]) != 0, True])
            df = np.empty(len(tokens), np.uint32)
            df[order] = np.repeat(np.diff(edges), np.diff(edges))
            shared = df > 1
            segment = np.repeat(np.arange(len(keys)), counts)[shared]
            tokens, df = tokens[shared], df[shared]
            # sets without shared n-grams here need no row: what they lack counts against them
            by, at = _by_part(keys[segment] % buckets, buckets)
            segment, tokens, df = segment[by], tokens[by], df[by]
            rows = {c: [] for c in ("part", "keys", "ns", "counts", "tokens", "dfs")}
            for b in range(buckets):
                lo, hi = at[b], at[b + 1]
                if lo == hi:
                    continue
                start = np.flatnonzero(np.r_[True, segment[lo + 1 : hi] != segment[lo : hi - 1]])
                s = segment[lo:hi][start]
                rows["part"].append(b)
                rows["keys"].append(keys[s].tobytes())
                rows["ns"].append(ns[s].tobytes())
                rows["counts"].append(np.diff(np.r_[start, hi - lo]).astype(np.uint32).tobytes())
                rows["tokens"].append(pack(tokens[lo:hi]))
                rows["dfs"].append(df[lo:hi].tobytes())
            k = len(rows["part"])
            none = pa.nulls(k, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(rows["part"], pa.int32()), none, none, none, none, *[pa.array(rows[c], pa.binary()) for c in ("keys", "ns", "counts", "tokens", "dfs")]], schema=_BLOB)


@frees_memory
def _gather(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Sets whose shared n-grams leave room for a partner, with their prefixes; rows of documents pass."""
    for item in _collected(batches):
        if isinstance(item, pa.RecordBatch):
            k = item.num_rows
            yield pa.RecordBatch.from_arrays([*item.columns[1:5], pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.list_(pa.int64()))], schema=_SETS)
            continue
        for part in list(item):
            blobs = item.pop(part)
            keys, ns, counts, tokens = _segments(blobs)
            df = np.frombuffer(b"".join(x[4] for x in blobs), np.uint32)
            del blobs
            order = np.argsort(keys, kind="stable")
            starts = np.cumsum(counts) - counts
            edges = np.flatnonzero(np.r_[True, np.diff(keys[order]) != 0, True])
            rows = {c: [] for c in ("key", "n", "own", "tokens", "prefix")}
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                segs = order[lo:hi]
                n, m = int(ns[segs[0]]), int(counts[segs].sum())
                room = slack(n, percent) - (n - m)
                if room < 0:
                    continue
                at = np.concatenate([np.arange(starts[s], starts[s] + counts[s]) for s in segs])
                mine, rare = tokens[at], df[at]
                first = np.lexsort((mine, rare))[: room + 1]
                rows["key"].append(int(keys[segs[0]]))
                rows["n"].append(n)
                rows["own"].append(n - m)
                rows["tokens"].append(np.sort(mine).tobytes())
                rows["prefix"].append(mine[first].view(np.int64))
                if len(rows["key"]) == 2000:
                    yield _sets(rows)
                    rows = {c: [] for c in rows}
            if rows["key"]:
                yield _sets(rows)


def _sets(rows: dict[str, list]) -> pa.RecordBatch:
    k = len(rows["key"])
    none = pa.nulls(k, pa.int64())
    return pa.RecordBatch.from_arrays([none, pa.array(rows["key"], pa.int64()), none, pa.array(rows["n"], pa.int64()), pa.array(rows["own"], pa.int64()), pa.array(rows["tokens"], pa.binary()), pa.array(rows["prefix"], pa.list_(pa.int64()))], schema=_SETS)


_TASK = pa.schema([("part", pa.int32()), ("x", pa.int64()), ("y", pa.int64()), ("nx", pa.int64()), ("ny", pa.int64()), ("tokens", pa.binary())])
_TASK_DDL = "part int, x long, y long, nx long, ny long, tokens binary"
_OVERLAP = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("nx", pa.int64()), ("ny", pa.int64()), ("o", pa.int64())])


@frees_memory
def _slices(batches: Iterator[pa.RecordBatch], vertical: int) -> Iterator[pa.RecordBatch]:
    """(group, key, tokens) to one row for each vertical slice."""
    bounds = (np.arange(1, vertical, dtype=np.float64) * (2.0**BITS / vertical)).astype(U64)
    for batch in batches:
        part, keys, out = [], [], []
        for g, key, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            tokens = np.frombuffer(raw, U64)
            cuts = [0, *np.searchsorted(tokens, bounds).tolist(), len(tokens)]
            for v in range(vertical):
                if cuts[v] < cuts[v + 1]:
                    part.append(g * vertical + v)
                    keys.append(key)
                    out.append(pack(tokens[cuts[v] : cuts[v + 1]]))
        k = len(part)
        none = pa.nulls(k, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(keys, pa.int64()), none, none, none, pa.array(out, pa.binary())], schema=_TASK)


@frees_memory
def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial overlaps of the pairs in a slice."""
    slices: dict[tuple[int, int], np.ndarray] = {}
    pairs = []
    for batch in batches:
        has = batch.column(5).is_valid()
        sets = batch.filter(has)
        for part, key, raw in zip(sets.column(0).to_pylist(), sets.column(1).to_pylist(), sets.column(5).to_pylist(), strict=True):
            slices[part, key] = unpack(raw)
        pairs.append(batch.filter(pa.compute.invert(has)))
    for batch in pairs:
        if not batch.num_rows:
            continue
        counts = np.zeros(batch.num_rows, np.int64)
        for i, (part, x, y) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 2)), strict=True)):
            s, t = slices.get((part, x)), slices.get((part, y))
            if s is None or t is None:
                continue
            if len(s) > len(t):
                s, t = t, s
            at = t.searchsorted(s)
            at[at == len(t)] = 0
            counts[i] = np.count_nonzero(t[at] == s)
        yield pa.RecordBatch.from_arrays([*batch.columns[1:5], pa.array(counts)], schema=_OVERLAP)


def verified(pairs: DataFrame, sets: DataFrame, percent: int, *, vertical: int = 4, per_salt: int = 2000) -> DataFrame:
    """Those of ``pairs`` (x, y, nx, ny, distinct) whose similarity reaches the threshold, with the overlap o."""
    spark = pairs.sparkSession
    tasks = partitions(spark)
    groups = 8 * tasks
    met = pairs.groupBy("x").agg(F.count("*").alias("met"))
    dealt = pairs.join(met, "x").withColumn("g", F.pmod(F.xxhash64("x", F.pmod(F.xxhash64("y"), F.ceil(F.col("met") / per_salt))), F.lit(groups)).cast("int")).drop("met")
    asked = dealt.select("g", F.explode(F.array("x", "y")).alias("key")).distinct()
    slices = asked.join(sets.select("key", "tokens"), "key").select("g", "key", "tokens").mapInArrow(partial(_slices, vertical=vertical), _TASK_DDL)
    rows = dealt.select(F.explode(F.sequence(F.lit(0), F.lit(vertical - 1))).alias("v"), "*").select((F.col("g") * vertical + F.col("v")).alias("part"), "x", "y", "nx", "ny", F.lit(None).cast("binary").alias("tokens"))
    partial_counts = slices.union(rows).repartition(2 * tasks, "part").mapInArrow(_overlaps, "x long, y long, nx long, ny long, o long")
    total = partial_counts.groupBy("x", "y", "nx", "ny").agg(F.sum("o").alias("o"))
    return total.where(100 * F.col("o") >= percent * (F.col("nx") + F.col("ny") - F.col("o")))


def ngram_components(docs: DataFrame, *, words: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id", fragments: int | None = None, vertical: int = 4) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id): documents linked by n-gram Jaccard similarity >= percent / 100.

    class_id is the smallest id with the same set; component_id the smallest id reachable by links. One row for each row of docs.
    """
    spark = docs.sparkSession
    stages = Stages(spark, "ngram")
    text_batches(spark)
    parts = fragments or max(32, 1 << math.ceil(math.log2(partitions(spark))))
    parts = 1 << max(0, math.ceil(math.log2(parts)))
    cut = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(partial(_cut, words=words, fragments=parts), _BLOB_DDL)
    counted = cut.repartition(parts, "part").mapInArrow(partial(_count, buckets=parts), _BLOB_DDL)
    both = stages.put(counted.repartition(parts, "part").mapInArrow(partial(_gather, percent=percent), _SETS_DDL), "sets")
    rows = both.where("tokens is null").select("doc_id", "key", "key2", "n")
    sets = both.where("tokens is not null").select("key", "n", "own", "tokens", "prefix")

    # a little wider than the threshold's ratio, so that rounding never puts linked sizes two bands apart
    band = F.floor(F.log(F.col("n").cast("double")) / (math.log(100 / percent) * (1 + 1e-9))) if percent < 100 else F.col("n")
    posts = sets.select("key", "n", "own", band.alias("band"), F.posexplode("prefix").alias("at", "token"))
    shared = posts.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
    # at: the n-gram's place in its set, rarest first, after those that no other set has
    posts = stages.put(posts.join(shared, "token").select("token", F.struct("key", "n", "own", (F.col("own") + F.col("at")).alias("at")).alias("s"), "band"), "posts")
    reach = posts.select("token", "s", "band", F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("b"))

    def candidates(pairs: DataFrame) -> DataFrame:
        """Pairs of structs p, q whose sizes, and the places of the n-gram they share, leave room for a link; least key first."""
        total = F.col("p.n") + F.col("q.n")
        overlap = F.ceil(percent * total / (100 + percent) - 1e-9)
        room = (100 * F.least("p.n", "q.n") >= percent * F.greatest("p.n", "q.n")) & (F.col("p.at") <= F.col("p.n") - overlap) & (F.col("q.at") <= F.col("q.n") - overlap)
        x, y = F.when(F.col("p.key") < F.col("q.key"), F.col("p")).otherwise(F.col("q")), F.when(F.col("p.key") < F.col("q.key"), F.col("q")).otherwise(F.col("p"))
        return pairs.where(room & (F.col("p.key") != F.col("q.key"))).select(x["key"].alias("x"), y["key"].alias("y"), x["n"].alias("nx"), y["n"].alias("ny")).distinct()

    # each set with one set of its n-gram and band, and of the band below: that with the fewest n-grams of its own,
    # which is the most likely to be what the others were made from
    pivots = stages.put(posts.groupBy("token", F.col("band").alias("b")).agg(F.min(F.struct("s.own", "s")).alias("p")).select("token", "b", F.col("p.s").alias("p")), "pivots")
    tested = stages.put(candidates(reach.join(pivots, ["token", "b"]).select("p", F.col("s").alias("q"))), "star")
    links = stages.put(verified(tested, sets, percent, vertical=vertical).select("x", "y"), "links")
    found = connected_components(links, stages, "x", "y")

    # what is left: pairs of different components that share a prefix n-gram
    label = found.select(F.col("node").alias("key"), F.col("component").alias("c"))
    named = reach.withColumn("key", F.col("s.key")).join(label, "key", "left").withColumn("c", F.coalesce("c", "key"))
    mixed = stages.put(named.groupBy("token", "b").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi").select("token", "b"), "mixed")
    named = stages.put(named.join(mixed, ["token", "b"]).select("token", "b", "band", "s", "c"), "named")
    left = named.where("band = b").select("token", "b", F.col("s").alias("p"), F.col("c").alias("cp"))
    right = named.select("token", "b", F.col("s").alias("q"), F.col("c").alias("cq"), "band")
    rest = left.join(right, ["token", "b"]).where((F.col("cp") != F.col("cq")) & ((F.col("band") != F.col("b")) | (F.col("p.key") < F.col("q.key"))))
    rest = stages.put(candidates(rest).join(tested.select("x", "y"), ["x", "y"], "left_anti"), "rest")
    more = stages.put(verified(rest, sets, percent, vertical=vertical).select("x", "y"), "links")
    stages.drop(posts, named, tested, rest)
    final = connected_components(links.union(more), stages, "x", "y")

    classes = rows.groupBy("key", "key2", "n").agg(F.min("doc_id").alias("class_id"))
    classes = classes.join(final.select(F.col("node").alias("key"), F.col("component").alias("root")), "key", "left")
    roots = classes.where("root is not null").groupBy("root").agg(F.min("class_id").alias("component"))
    classes = classes.join(roots, "root", "left").select("key", "key2", "n", "class_id", F.coalesce("component", "class_id").alias("component_id"))
    out = rows.where("n > 0").join(classes, ["key", "key2", "n"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "class_id")
    none = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id"))
    return out.union(none)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, percent=90).select("doc_id", "n_shingles", "component_id")


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
),
g AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                                    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w
),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS gram FROM g),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o, any_value(x.n) AS na, any_value(y.n) AS nb
  FROM t x JOIN t y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id
),
l AS (SELECT a, b FROM p WHERE 100 * o >= 90 * (na + nb - o)),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.root = l.a)
SELECT g.doc_id, len(g.s) AS n_shingles, c.component_id
FROM g JOIN (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
"""
