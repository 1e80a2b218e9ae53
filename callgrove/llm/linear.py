"""Hashed text features and small logistic models, shared by the classifiers."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_CODE_LOWER, U64, frees_memory, mix, prefix_hashes, span_hashes, text_batches, text_slices

#: Buckets of hashed features: 2 ** FEATURE_BITS.
FEATURE_BITS = 18
#: Bytes of a longer word's beginnings that are features too.
STEMS = (4, 5)

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MARK = ~(_LETTER | _SPACE)
_MARK[48:58] = False


def _runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the runs of true bytes; runs never cross rows."""
    begins, stops = member.copy(), member.copy()
    begins[1:] &= ~member[:-1]
    stops[:-1] &= ~member[1:]
    filled = offsets[:-1] < offsets[1:]
    begins[offsets[:-1][filled]] = member[offsets[:-1][filled]]
    stops[offsets[1:][filled] - 1] = member[offsets[1:][filled] - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(offsets, starts, "right") - 1


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket), each once: the words of each text, the beginnings of longer ones, and bins of how it is written (capitals, marks, repetition, length)."""
    rows_n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts, ends, rows = _runs(_LETTER[data], offsets)
    prefix = prefix_hashes(data, BYTE_CODE_LOWER)
    h = mix(span_hashes(prefix, starts, ends) + (ends - starts).astype(U64))
    pairs = np.unique((rows << FEATURE_BITS) | (h >> U64(64 - FEATURE_BITS)).astype(np.int64))
    stems = []
    for size in STEMS:
        long = np.flatnonzero(ends - starts > size)
        stem = mix(span_hashes(prefix, starts[long], starts[long] + size) ^ U64(0xA5A5A5A5A5A5A500 + size))
        stems.append(np.unique((rows[long] << FEATURE_BITS) | (stem >> U64(64 - FEATURE_BITS)).astype(np.int64)))
    words = np.bincount(rows, minlength=rows_n)
    kinds = np.bincount(pairs >> FEATURE_BITS, minlength=rows_n)
    size = np.maximum(1, np.diff(offsets))
    sums = lambda table: np.diff(np.r_[0, np.cumsum(table[data], dtype=np.int64)][offsets])
    stats = np.stack([sums(_UPPER) / size, sums(_MARK) / size, kinds / np.maximum(1, words), np.log2(1 + words) / 16, sums(_SPACE) / size, (words > 0) * size / np.maximum(1, words) / 32])
    bins = np.minimum((stats * 16).astype(np.int64), 20)
    some = np.flatnonzero(np.diff(offsets) > 0)
    extra = [(some << FEATURE_BITS) | (mix((bins[k][some] + 32 * (k + 1)).astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(64 - FEATURE_BITS)).astype(np.int64) for k in range(len(bins))]
    pairs = np.unique(np.concatenate([pairs, *stems, *extra]))
    return pairs >> FEATURE_BITS, pairs & ((1 << FEATURE_BITS) - 1)


_SAMPLE_DDL = "key long, buckets binary"


@frees_memory
def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in text_slices(batch, "text"):
            rows, buckets = features(data, offsets)
            cuts = np.searchsorted(rows, np.arange(b - a + 1))
            narrow = buckets.astype(np.int32)
            lists = [narrow[x:y].tobytes() for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(lists, pa.binary())], names=["key", "buckets"])


def labelled_sample(docs: DataFrame, labels: DataFrame, columns: list[str], *, max_rows: int, text: str, doc_id: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, targets) of at most max_rows labelled documents, those with the least hash of their id.

    Rows of ``labels`` with a null id or label are left out. Of documents with the same id the one with the least features (as bytes) is used,
    chosen before anything is collected: the sample is bounded by max_rows, so it can be broadcast and its features come to the driver.
    """
    known = labels.select(F.col(doc_id).cast("long").alias("key"), *columns).dropna().groupBy("key").agg(*[F.max(c).alias(c) for c in columns])
    chosen = known.orderBy(F.xxhash64("key"), "key").limit(max_rows).collect()
    targets = {r.key: [float(r[c]) for c in columns] for r in chosen}
    spark = docs.sparkSession
    keys = spark.createDataFrame([(k,) for k in targets], "key long")
    found = docs.select(F.col(doc_id).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(keys), "key")
    got = found.mapInArrow(_sample_features, _SAMPLE_DDL).groupBy("key").agg(F.min("buckets").alias("buckets")).toArrow()
    got = got.take(pa.array(np.argsort(got.column("key").to_numpy(), kind="stable")))
    order = got.column("key").to_pylist()
    rows = np.repeat(np.arange(len(order), dtype=np.int32), pa.compute.binary_length(got.column("buckets")).to_numpy() // 4)
    buckets = np.frombuffer(b"".join(x.as_buffer() for x in got.column("buckets")), np.int32)
    return rows, buckets, np.array([targets[k] for k in order], float).reshape(len(order), len(columns))


def _sums(at: np.ndarray, size: int, weights: np.ndarray | None = None, of: np.ndarray | None = None, step: int = 1 << 18) -> np.ndarray:
    """np.bincount of ``at``, weighted by ``weights[of]`` where given, part by part: its wide copies stay small."""
    out = np.zeros(size)
    for i in range(0, len(at), step):
        out += np.bincount(at[i : i + step], None if weights is None else weights[of[i : i + step]], minlength=size)
    return out


class Logistic:
    """A logistic model over present buckets and a few dense inputs, fitted by full-batch Adam with L2."""

    def __init__(self, max_features: int = 4000, least_rows: int = 3, least_gap: float = 4.0, steps: int = 200, l2: float = 1e-4, rate: float = 0.1):
        self.max_features, self.least_rows, self.least_gap, self.steps, self.l2, self.rate = max_features, least_rows, least_gap, steps, l2, rate

    def fit(self, rows: np.ndarray, buckets: np.ndarray, dense: np.ndarray, y: np.ndarray) -> Logistic:
        n = len(y)
        self.weights = np.zeros(1 << FEATURE_BITS)
        self.dense = np.zeros(dense.shape[1])
        prior = (y.sum() + 0.5) / (n + 1)
        self.bias = float(np.log(prior / (1 - prior)))
        if n == 0 or y.min() == y.max():
            return self
        size = 1 << FEATURE_BITS
        seen = _sums(buckets, size)
        hits = _sums(buckets, size, y, rows)
        mean = y.mean()
        gap = np.abs(hits - seen * mean) / np.sqrt(np.maximum(seen, 1) * mean * (1 - mean))
        gap[seen < self.least_rows] = 0
        chosen = np.argsort(-gap, kind="stable")[: self.max_features]
        chosen = chosen[gap[chosen] > self.least_gap]
        slot = np.full(size, -1, np.int32)
        slot[chosen] = np.arange(len(chosen))
        keep = np.flatnonzero(slot[buckets] >= 0).astype(np.int32)
        r, c = rows[keep], slot[buckets[keep]]
        del keep
        w = np.zeros(len(chosen) + dense.shape[1] + 1)
        w[-1] = self.bias
        m, v = np.zeros_like(w), np.zeros_like(w)
        k = len(chosen)
        for step in range(1, self.steps + 1):
            p = self._sigmoid(_sums(r, n, w, c) + dense @ w[k:-1] + w[-1])
            d = (p - y) / n
            g = np.concatenate([_sums(c, k, d, r), d @ dense, [d.sum()]])
            g[:-1] += self.l2 * w[:-1]
            m = 0.9 * m + 0.1 * g
            v = 0.99 * v + 0.01 * g * g
            w -= self.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        self.weights[chosen], self.dense, self.bias = w[:k], w[k:-1], float(w[-1])
        return self

    @staticmethod
    def _sigmoid(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x, -35, 35)))

    def predict(self, rows: np.ndarray, buckets: np.ndarray, dense: np.ndarray, n: int) -> np.ndarray:
        return self._sigmoid(_sums(rows, n, self.weights, buckets) + dense @ self.dense + self.bias)


class Chain:
    """Logistic models one after the other; each also sees the probabilities of those before it.

    While fitting, a later model sees out-of-fold probabilities, made by models that didn't see the row.
    """

    def __init__(self, folds: int = 3, **options):
        self.folds, self.options, self.models = folds, options, []

    @staticmethod
    def _inputs(before: list[np.ndarray], n: int) -> np.ndarray:
        return np.stack([np.log(np.clip(p, 1e-6, 1 - 1e-6) / np.clip(1 - p, 1e-6, 1)) for p in before], axis=1) if before else np.zeros((n, 0))

    def fit(self, rows: np.ndarray, buckets: np.ndarray, targets: np.ndarray) -> Chain:
        n = len(targets)
        if len(buckets):  # features of too few rows are never chosen, in no fold either; they needn't be copied
            keep = (_sums(buckets, 1 << FEATURE_BITS) >= Logistic(**self.options).least_rows)[buckets]
            rows, buckets = rows[keep], buckets[keep]
            del keep
        fold = np.arange(n) % self.folds
        before: list[np.ndarray] = []
        for k in range(targets.shape[1]):
            dense, y = self._inputs(before, n), targets[:, k]
            self.models.append(Logistic(**self.options).fit(rows, buckets, dense, y))
            if k + 1 == targets.shape[1]:
                break
            out = np.zeros(n)
            for f in range(self.folds):
                train, test = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
                if not len(train) or not len(test):
                    out[test] = self.models[-1].predict(rows, buckets, dense, n)[test]
                    continue
                place = np.full(n, -1, np.int32)
                place[train] = np.arange(len(train))
                mine = (place >= 0)[rows]
                model = Logistic(**self.options).fit(place[rows[mine]], buckets[mine], dense[train], y[train])
                out[test] = model.predict(rows, buckets, dense, n)[test]
            before.append(out)
        return self

    def predict(self, rows: np.ndarray, buckets: np.ndarray, n: int) -> list[np.ndarray]:
        found: list[np.ndarray] = []
        for model in self.models:
            found.append(model.predict(rows, buckets, self._inputs(found, n), n))
        return found


@frees_memory
def _scored(batches: Iterator[pa.RecordBatch], shared, names: list[str], text: str) -> Iterator[pa.RecordBatch]:
    chain = shared.value
    for batch in batches:
        for a, b, data, offsets in text_slices(batch, text):
            rows, buckets = features(data, offsets)
            found = chain.predict(rows, buckets, b - a)
            yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns), *map(pa.array, found)], names=[*batch.schema.names, *names])


def with_probabilities(docs: DataFrame, chain: Chain, names: list[str], *, text: str) -> DataFrame:
    """``docs`` with a probability from each model of the chain."""
    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, *(T.StructField(x, T.DoubleType()) for x in names)])
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    text_batches(docs.sparkSession)
    return docs.mapInArrow(partial(_scored, shared=shared, names=names, text=text), schema)
