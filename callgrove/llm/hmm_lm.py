"""Language-model scoring by a hidden Markov model over all words of a corpus.

Method. A text is its words (A-Z lower-cased) and one end. Latent states follow each other and emit classes of words; a word has its class's emission times its share of the class,
by its count in the corpus: p(word | state) = p(class | state) * (c + 1) / (C + V + 1), C the count of all words of the class and V how many there are. A word's class is the last
bits of its hash, so that frequent words have a class almost to themselves, every word that was never seen has one too, and the states' parameters stay bounded (2**class_bits x states)
while counts cover each word of the whole corpus. The end is a class of its own. That is one proper distribution over texts. Baum-Welch: in each round every task runs forward and backward
over its texts with the model of the last round, and gives expected counts; a grouped sum adds them up and the model of the next round is made of them.
A bounded sample of texts only gives the point that these rounds start from. Scores are the exact log10 likelihood by scaled forward recursion over the whole text.

The base score is that of independent words: log10((c + 1) / (N + V + 1)) each.

At scale. Texts are read once, in slabs of about ``SLAB`` bytes: a row with each different word's hash and the texts as numbers of these words (the lowest bytes of all numbers first, then the next), written to the shared folder. Counts, rounds and
scores run on slabs. Words meet their counts by an equi-join of (word, slab) with the counted words, so what travels is each word once a slab, however often it stands there, and
nothing that grows with the corpus is broadcast or collected: the model is bounded by its parameters, sums are counted in Spark. A slab is put together with its words' counts
by slab. A single text longer than a slab is a slab of its own.

Words are told apart by 64-bit hashes that aren't linear in their bytes: among a thousand million different words two fall together with a chance of 3 %, and then share their count.

Edge cases. A null text is empty: the end alone. Rows with a null id are scored but never learnt from. Repeated rows count, and are scored, each. Without rows to learn from
the base score is 0 for each token and the model is uniform. Very long words are words as any. An empty table gives no rows. The result has the id and its own columns only.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, Stages, frees_memory, text_batches, text_slices, word_hashes, words_of
from .hmm import Hmm, first_model, improved

#: Bytes of text in a slab.
SLAB = 4 << 20
#: Of a text that the starting point is fitted on, so many tokens from a place told by its hash.
EXCERPT = 1000
_SLABS = "slab long, n_learn long, learn binary, spots binary, lengths binary, words binary, tokens binary"


@contextmanager
def _few_rows(spark: SparkSession, rows: int = 8) -> Iterator[None]:
    """Slabs are wide: few in an Arrow batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


# ---------------------------------------------------------------- texts as slabs


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list[pa.Array], np.ndarray, np.ndarray]]:
    """Runs of rows with about ``most`` bytes of text: their columns but the text, its bytes and its offsets."""
    rows: list[pa.RecordBatch] = []
    parts: list[np.ndarray] = []
    cuts: list[np.ndarray] = [np.zeros(1, np.int64)]
    size = 0

    def slab() -> tuple[list[pa.Array], np.ndarray, np.ndarray]:
        table = pa.Table.from_batches(rows).combine_chunks()
        made = [c.chunk(0) for c in table.columns], np.concatenate(parts), np.concatenate(cuts)
        rows.clear(), parts.clear()
        cuts[:] = [np.zeros(1, np.int64)]
        return made

    for batch in batches:
        others = batch.drop_columns(["text"])
        for row, end, data, offsets in text_slices(batch, "text", most):
            rows.append(others.slice(row, end - row))
            parts.append(data)
            cuts.append(offsets[1:] + size)
            size += len(data)
            if size >= most:
                yield slab()
                size = 0
    if rows:
        yield slab()


@frees_memory
def _slabs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    for number, ((ids, learn, spots), data, offsets) in enumerate(_gathered(batches, most)):
        starts, ends, rows = words_of(data, offsets)
        lengths = np.bincount(rows, minlength=len(ids)).astype("<i8")
        words, tokens, n = np.unique(word_hashes(data, starts, ends, fold=True), return_inverse=True, return_counts=True)
        del data, starts, ends, rows
        order = np.argsort(-n, kind="stable")  # frequent words have small numbers, whose upper bytes compress to nothing
        rank = np.empty(len(order), "<u4")
        rank[order] = np.arange(len(order))
        planes = np.ascontiguousarray(rank[tokens].view(np.uint8).reshape(-1, 4).T)
        blobs = [learn.to_numpy(zero_copy_only=False).astype(np.uint8), spots.to_numpy().astype("<i8"), lengths, words[order].astype("<u8"), planes]
        yield pa.RecordBatch.from_arrays([pa.array([part << 32 | number], pa.int64()), pa.array([int(blobs[0].sum())], pa.int64()), *(pa.array([b.tobytes()], pa.binary()) for b in blobs), pa.array([ids.to_pylist()], pa.list_(ids.type))], names=["slab", "n_learn", "learn", "spots", "lengths", "words", "tokens", "ids"])


class Slab:
    """A slab's row, decoded."""

    def __init__(self, row: dict):
        self.slab = row["slab"]
        self.learn = np.frombuffer(row["learn"], np.uint8).astype(bool)
        self.spots = np.frombuffer(row["spots"], "<i8")
        self.lengths = np.frombuffer(row["lengths"], "<i8")
        self.words = np.frombuffer(row["words"], "<u8")
        self.tokens = np.ascontiguousarray(np.frombuffer(row["tokens"], np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)

    def classes(self, bits: int, which: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Classes of the tokens of all (or some) texts with their ends, one text after the other, and where each begins."""
        which = np.ones(len(self.lengths), bool) if which is None else which
        bounds = np.r_[0, np.cumsum(self.lengths[which] + 1)]
        out = np.full(int(bounds[-1]), 1 << bits, np.int32)
        inside = np.ones(len(out), bool)
        inside[bounds[1:] - 1] = False
        tokens = self.tokens if which.all() else self.tokens[np.repeat(which, self.lengths)]
        out[inside] = (self.words & U64((1 << bits) - 1)).astype(np.int32)[tokens]
        return out, bounds


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[Slab]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Slab({n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)})


@frees_memory
def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n): how often each word stands in a slab's texts to learn from."""
    for slab in _each(batches):
        n = np.bincount(slab.tokens[np.repeat(slab.learn, slab.lengths)], minlength=len(slab.words))
        there = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(slab.words[there].view(np.int64)), pa.array(n[there].astype(np.int64))], names=["word", "n"])


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, slab, place): each word of a slab."""
    for slab in _each(batches):
        yield pa.RecordBatch.from_arrays([pa.array(slab.words.view(np.int64)), pa.array(np.full(len(slab.words), slab.slab)), pa.array(np.arange(len(slab.words), dtype=np.int32))], names=["word", "slab", "place"])


# ---------------------------------------------------------------- training


def _excerpts(batches: Iterator[pa.RecordBatch], bits: int, below: int) -> Iterator[pa.RecordBatch]:
    """(spot, classes): of texts to learn from whose hash is low, some tokens."""
    for slab in _each(batches):
        which = slab.learn & (slab.spots < below)
        classes, bounds = slab.classes(bits, which)
        out = []
        for spot, a, b in zip(slab.spots[which].tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            at = a + spot * 0x9E3779B1 % max(1, b - a - EXCERPT + 1)
            out.append((spot, classes[at : min(b, at + EXCERPT)].tobytes()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.int64()), pa.array([c for _, c in out], pa.binary())], names=["spot", "classes"])


@frees_memory
def _expected(batches: Iterator[pa.RecordBatch], shared, bits: int) -> Iterator[pa.RecordBatch]:
    """(row, k0, k1, ..): expected counts of this task. Rows: classes, the end, then moves from each state, then starts; the last one has the log10 likelihood."""
    model: Hmm = shared.value
    k, n_classes = model.k, (1 << bits) + 1
    total = np.zeros((n_classes + k + 2, k))
    for slab in _each(batches):
        if not slab.learn.any():
            continue
        starts, moves, emits, fit = model.expected(*slab.classes(bits, slab.learn))
        total[:n_classes] += emits
        total[n_classes : n_classes + k] += moves
        total[n_classes + k] += starts
        total[n_classes + k + 1, 0] += fit
    there = np.flatnonzero(total.any(1))
    yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), *(pa.array(total[there, j]) for j in range(k))], names=["row", *(f"k{j}" for j in range(k))])


def _summed(df: DataFrame, key: str, n: int) -> np.ndarray:
    """Rows of sums by a key below n, as a dense table; n is a parameter's size."""
    names = [c for c in df.columns if c != key]
    found = df.groupBy(key).agg(*(F.sum(c).alias(c) for c in names)).toArrow()
    out = np.zeros((n, len(names)))
    if found.num_rows:
        out[found.column(key).to_numpy()] = np.stack([found.column(c).to_numpy().astype(float) for c in names], 1)
    return out


class Trained:
    """Bounded by its parameters: the model, and for each class the logarithm of what shares are taken of. known: different tokens to learn from; total: all of them."""

    def __init__(self, hmm: Hmm, bits: int, mass: np.ndarray, total: int, known: int, ends: int):
        self.hmm, self.bits, self.mass, self.total, self.known, self.ends = hmm, bits, mass, total, known, ends

    def scores(self, slab: Slab, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """n_tokens, n_known, base_score, score of each text. counts: of the slab's words."""
        n = len(slab.lengths)
        row = np.repeat(np.arange(n), slab.lengths)
        sums = lambda values: np.bincount(row, values[slab.tokens], n)
        whole = self.total + self.known + 1
        base = sums(np.log10((counts + 1) / whole)) + np.log10((self.ends + 1) / whole)
        own = (slab.words & U64((1 << self.bits) - 1)).astype(np.int64)
        shares = sums(np.log10((counts + 1) / self.mass[own]))
        known = sums((counts > 0).astype(float)).astype(np.int64) + (self.ends > 0)
        return slab.lengths + 1, known, base, shares + self.hmm.log10(*slab.classes(self.bits))


def trained(slabs: DataFrame, counts: DataFrame, *, states: int, class_bits: int, rounds: int, sample_texts: int, shrink: float, fits: list[float] | None = None) -> Trained:
    """The model of all texts to learn from. fits: gets the corpus's log10 probability of classes at the start of each round."""
    spark = slabs.sparkSession
    n_classes = (1 << class_bits) + 1
    ends = slabs.agg(F.sum("n_learn")).first()[0] or 0
    by_class = counts.select((F.col("word").bitwiseAND((1 << class_bits) - 1)).cast("int").alias("row"), F.col("c"), F.lit(1).alias("v"))
    table = _summed(by_class, "row", n_classes)
    table[-1] = ends, ends > 0
    mass = table.sum(1) + 1  # one more for words of the class that were never seen
    mass[-1] = ends + 1
    common = mass / mass.sum()
    share = min(1.0, 4 * sample_texts / max(1, ends))
    with _few_rows(spark):
        drawn = slabs.mapInArrow(partial(_excerpts, bits=class_bits, below=int(share * (1 << 30))), "spot long, classes binary").orderBy("spot", "classes").limit(sample_texts).toArrow()
        texts = [np.frombuffer(c, np.int32) for c in drawn.column("classes").to_pylist()]
        model = first_model(np.concatenate([np.zeros(0, np.int32), *texts]), np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64), common, states, shrink)
        ddl = "row int, " + ", ".join(f"k{j} double" for j in range(states))
        for _ in range(rounds if ends else 0):
            sums = _summed(slabs.mapInArrow(partial(_expected, shared=spark.sparkContext.broadcast(model), bits=class_bits), ddl), "row", n_classes + states + 2)
            if fits is not None:
                fits.append(float(sums[-1, 0]))
            model = improved(sums[-2], sums[n_classes : n_classes + states], sums[:n_classes], common, shrink)
    total, known = table.sum(0)
    return Trained(model, class_bits, mass, int(total), int(known), int(ends))


# ---------------------------------------------------------------- scoring


def _scored(left: pa.Table, right: pa.Table, shared, schema: pa.Schema) -> pa.Table:
    """A slab and the counts of its words."""
    if not left.num_rows:
        return schema.empty_table()
    model: Trained = shared.value
    slab = Slab({n: left.column(n)[0].as_py() for n in ("slab", "learn", "spots", "lengths", "words", "tokens")})
    counts = np.zeros(len(slab.words))
    counts[right.column("place").to_numpy()] = right.column("c").to_numpy()
    n_tokens, known, base, score = model.scores(slab, counts)
    ids = left.column("ids").combine_chunks().flatten()
    return pa.Table.from_arrays([ids.cast(schema.field(0).type), pa.array(n_tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(ids), model.total), pa.int64()), pa.array(base), pa.array(score)], schema=schema)


def hmm_scores(docs: DataFrame, learn: Column, *, states: int = 8, class_bits: int = 15, rounds: int = 2, sample_texts: int = 512, shrink: float = 5.0, text: str = "text", doc_id: str = "doc_id", fits: list[float] | None = None) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every text, learnt from the rows where ``learn`` holds.

    sample_texts: how many texts (some tokens of each) the starting point is fitted on; the rounds after it run over the whole corpus. shrink: how many more times a class counts as
    met at random among the states.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    stages = Stages(spark, "lm")
    text_batches(spark)
    own = docs.schema[doc_id]
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(learn & F.col(doc_id).isNotNull(), F.lit(False)).alias("learn"), F.pmod(F.xxhash64(doc_id, F.length(text)), F.lit(1 << 30)).alias("spots"), F.col(text).alias("text"))
    schema = T.StructType([*T.StructType.fromDDL(_SLABS).fields, T.StructField("ids", T.ArrayType(own.dataType))])
    slabs = stages.put(rows.mapInArrow(partial(_slabs, most=SLAB), schema), "slabs")
    narrow = slabs.drop("ids")
    with _few_rows(spark):
        counts = stages.put(narrow.mapInArrow(_counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("c")), "counts")
        model = trained(narrow, counts, states=states, class_bits=class_bits, rounds=rounds, sample_texts=sample_texts, shrink=shrink, fits=fits)
        found = stages.put(narrow.mapInArrow(_asked, "word long, slab long, place int").join(counts, "word").select("slab", "place", "c"), "found")
    out = T.StructType([T.StructField(doc_id, own.dataType), *T.StructType.fromDDL("n_tokens long, n_known long, train_tokens long, base_score double, score double").fields])
    return slabs.groupBy("slab").cogroup(found.groupBy("slab")).applyInArrow(partial(_scored, shared=spark.sparkContext.broadcast(model), schema=to_arrow_schema(out)), out)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    out = hmm_scores(docs, ~held_out)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
