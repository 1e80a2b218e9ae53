"""What several operators share: staged tables, byte-level text tools and connected components."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress
from functools import cache, partial, wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64

# ---------------------------------------------------------------- staged tables


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, a temporary one in local mode (tests), else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: on a cluster it has to name a folder that driver and executors share")
    return (found or _own_dir()).rstrip("/")


@cache
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="callgrove-")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit; then the folder's owner cleans up
        return


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Stages:
    """Tables written to the shared folder to cut lineage. A lost executor loses nothing of them.

    ``put`` writes and reads back; ``drop`` removes a table that no later plan reads. What is left goes at
    interpreter exit, because a returned DataFrame is lazy and may still read it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        atexit.register(_remove, spark, self.base)

    def put(self, df: DataFrame, label: str = "t") -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}-{label}"
        before = self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")  # the plan's shuffle files go once the table stands
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stage_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            if path := getattr(df, "_stage_path", None):
                _remove(self.spark, path)


def text_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Batches of texts to Python of at most ``rows`` rows from now on: the default of 10,000 is made for narrow rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


_TABLES: list[Callable] = []


def frees_memory(function: Callable | None = None, *, keeps: Callable | None = None) -> Callable:
    """For functions over Arrow batches: when a task is done, its worker gives free memory back before the next one.

    keeps: a cached function whose tables serve one task after the other; they go when the worker turns to another function.
    """
    if function is None:
        _TABLES.append(keeps)
        return partial(frees_memory, keeps=keeps)

    @wraps(function)
    def run(*args, **options):
        for table in _TABLES:
            if table is not keeps:
                table.cache_clear()
        try:
            yield from function(*args, **options)
        finally:
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return run


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- bytes of a batch of texts

_MIX1, _MIX2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64's); x is overwritten."""
    x ^= x >> U64(30)
    x *= _MIX1
    x ^= x >> U64(27)
    x *= _MIX2
    x ^= x >> U64(31)
    return x


BYTE_CODE = mix(np.arange(1, 257, dtype=U64) * U64(0xD1B54A32D192ED03))
#: The same with A-Z as a-z.
BYTE_CODE_LOWER = BYTE_CODE.copy()
BYTE_CODE_LOWER[65:91] = BYTE_CODE[97:123]
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True

_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = -(-n // (1 << 18)) << 18
        with np.errstate(over="ignore"):
            up, down = np.full(size, BASE, U64), np.full(size, BASE_INV, U64)
            up[0] = down[0] = 1
            np.multiply.accumulate(up, out=up)
            np.multiply.accumulate(down, out=down)
        _POWERS[:] = [up, down]
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix_hashes(data: np.ndarray, codes: np.ndarray = BYTE_CODE) -> np.ndarray:
    """P with P[j]-P[i] = sum of code(data[k]) * BASE**k over i <= k < j."""
    out = np.zeros(len(data) + 1, U64)
    up, _ = powers(len(data) + 1)
    np.multiply(codes[data], up[:-1], out=out[1:])
    np.add.accumulate(out, out=out)
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes of data[start:end], independent of where the span lies."""
    _, down = powers(len(prefix))
    return (prefix[ends] - prefix[starts]) * down[starts]


def text_slices(batch: pa.RecordBatch, column: str, max_bytes: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about max_bytes of text; a longer row comes alone. Null is empty."""
    col = batch.column(batch.schema.get_field_index(column))
    if len(col) == 0:
        return
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    buffers = col.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(col):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + max_bytes, "right")) - 1)
        end = min(end, len(col))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of the maximal runs without white space bytes; runs never cross rows."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~IS_SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[firsts] = solid[firsts]
    stops = solid.copy()
    stops[:-1] &= ~solid[1:]
    lasts = firsts_end = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    stops[lasts] = solid[firsts_end]
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def _eights(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of each data[start:end], eight to a number (the last filled up with zeros); how many numbers each has, and where its first one is."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    counts = np.maximum((ends - starts + 7) // 8, 1)
    at = np.repeat(starts, counts) + 8 * runs(counts)
    left = np.repeat(ends, counts) - at
    eights = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))[at] & _FIRST_BYTES[np.minimum(left, 8)]
    return eights, counts, np.cumsum(counts) - counts


def _hashed(eights: np.ndarray, counts: np.ndarray, heads: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    if not len(heads):
        return np.zeros(0, U64)
    key = mix((runs(counts) + 1).astype(U64) * U64(BASE))
    return mix(np.add.reduceat(mix(eights ^ key), heads) + sizes.astype(U64) * U64(BASE))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, *, fold: bool = False) -> np.ndarray:
    """64-bit hashes of data[start:end] (fold: A-Z as a-z). Each eight bytes are mixed with their place before they are summed, so that the
    hash isn't linear in the bytes: strings that collide under any polynomial modulo 2**64 (Thue-Morse's) don't here."""
    eights, counts, heads = _eights(_FOLD[data] if fold else data, starts, ends)
    return _hashed(eights, counts, heads, ends - starts)


def word_kinds(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word of each kind, and the kind of each word; words are of a kind if all their bytes are equal.

    Kinds are found by hash; each word is then compared with the first of its kind, and those that differ get kinds of their own.
    """
    eights, counts, heads = _eights(data, starts, ends)
    _, first, kind = np.unique(_hashed(eights, counts, heads, ends - starts), return_index=True, return_inverse=True)
    rep = first[kind]
    wrong = (ends - starts) != (ends - starts)[rep]
    like = np.flatnonzero(~wrong)
    at = runs(counts[like])
    unequal = eights[np.repeat(heads[like], counts[like]) + at] != eights[np.repeat(heads[rep[like]], counts[like]) + at]
    wrong[like[np.repeat(np.arange(len(like)), counts[like])[unequal]]] = True
    if wrong.any():
        own: dict[bytes, int] = {}
        more = []
        for w in np.flatnonzero(wrong).tolist():
            word = data[starts[w] : ends[w]].tobytes()
            if word not in own:
                own[word] = len(first) + len(more)
                more.append(w)
            kind[w] = own[word]
        first = np.r_[first, np.array(more, first.dtype)]
    return first, kind


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """For each row the sorted distinct 64-bit hashes of its runs of ``words`` lower-cased words; of fewer words, the whole as one."""
    starts, ends, rows = words_of(data, offsets)
    h = word_hashes(data, starts, ends, fold=True)
    bounds = np.searchsorted(rows, np.arange(len(offsets)))
    if len(h) >= words:
        grams = np.zeros(len(h) - words + 1, U64)
        for k in range(words):
            grams *= U64(BASE)
            grams += h[k : len(h) - words + 1 + k]
        grams = mix(grams)
    else:
        grams = np.zeros(0, U64)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= words:
            g = np.sort(grams[a : b - words + 1])
            keep = np.empty(len(g), bool)
            keep[0] = True
            np.not_equal(g[1:], g[:-1], out=keep[1:])
            out.append(g[keep])
        elif b > a:
            x = b - a
            for w in h[a:b].tolist():
                x = (x * BASE + w) % (1 << 64)
            out.append(mix(np.array([x], U64)))
        else:
            out.append(np.zeros(0, U64))
    return out


def arrow_out(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def runs(sizes: np.ndarray) -> np.ndarray:
    """0, 1, .. size - 1 for each size."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


class IntTable:
    """Values (0 or more) of whole numbers. Two slots for each key; whoever has no place in the first goes to the second, and the few left to a sorted rest."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, bits: int = 19):
        self.bits = bits
        self.keys, self.values = np.full((2, 1 << bits), -1, np.int64), np.full((2, 1 << bits), -1, np.int32)
        rest = np.arange(len(keys))
        for side in (0, 1):
            slot = self._slots(keys[rest])[side]
            _, first = np.unique(slot, return_index=True)
            self.keys[side, slot[first]], self.values[side, slot[first]] = keys[rest[first]], values[rest[first]]
            rest = np.delete(rest, first)
        order = rest[np.argsort(keys[rest])]
        self.rest_keys, self.rest_values = keys[order], values[order]

    def _slots(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = key.astype(U64) * U64(BASE)
        return (h >> U64(64 - self.bits)).astype(np.int32), ((h >> U64(64 - 2 * self.bits)) & U64((1 << self.bits) - 1)).astype(np.int32)

    def get(self, key: np.ndarray) -> np.ndarray:
        """-1 for keys that aren't there."""
        one, two = self._slots(key)
        out = np.where(self.keys[0, one] == key, self.values[0, one], np.int32(-1))
        left = np.flatnonzero(out < 0)
        slot, left_key = two[left], key[left]
        out[left] = np.where(self.keys[1, slot] == left_key, self.values[1, slot], np.int32(-1))
        if len(self.rest_keys):
            left = left[out[left] < 0]
            at = np.minimum(np.searchsorted(self.rest_keys, key[left]), len(self.rest_keys) - 1)
            out[left] = np.where(self.rest_keys[at] == key[left], self.rest_values[at], np.int32(-1))
        return out


# ---------------------------------------------------------------- connected components


def connected_components(edges: DataFrame, stages: Stages, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every end of ``edges``; component is the smallest node reachable.

    Large-star and small-star steps: each is one grouped minimum and one join, so no neighbourhood is gathered in a
    task, and the number of rounds grows with the logarithm of a component's size. Edges with a null end are ignored.
    """
    kind = edges.schema[a].dataType
    now = stages.put(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct(), "edges")
    last = None
    while True:
        # large star: every larger neighbour of u, and u, points to the least of u's neighbourhood
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small star: the smaller neighbours of u, and u, point to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        nxt = stages.put(small, "edges")
        mark = nxt.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).collect()[0]
        stages.drop(now)
        now, same, last = nxt, mark == last, mark
        if same:
            break
    roots = now.select(F.col("v").alias("u"), "v").distinct()
    return now.union(roots).select(F.col("u").cast(kind).alias("node"), F.col("v").cast(kind).alias("component"))
