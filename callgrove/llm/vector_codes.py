"""Vectors as codes of small codebooks, which Yinyang Lloyd's rounds make.

Method. Components become whole numbers and vectors are cut into equal parts; each part position has a codebook, whose first entries are that part
of the vectors with the smallest ids. In every round each part goes to its nearest entry and each entry becomes the floor of its parts' mean. Yinyang: the
entries of a codebook are put into a few groups once. For each part the state keeps its entry, an upper bound of the distance to it, and one lower bound for each
group of the distance to any other entry there. When entries have moved, the upper bound grows by the drift of the own entry and a group's lower bound falls by the
largest drift in the group. Only where a group's bound no longer lies above the upper one (made exact first), its entries are scanned; in late rounds few are.
Bounds are floating point, rounded outwards; whatever is scanned is compared by exact squared distances in whole numbers, so ties go to the lower index as if
every distance had been computed: a group is passed over only if all its entries are strictly farther.

At scale. The state is a table in the shared folder, written anew in each round and dropped in the next, so a lost executor repeats tasks only and no vector is ever
shuffled. A round is one pass: its tasks write the new state and, as one more row, how the sums and counts of entries change by the parts that moved. These rows are
added up by a grouped sum; what reaches the driver, and what is broadcast, are the codebooks (parts x entries numbers of a part's width), whatever the number of vectors.

Edge cases. Vectors that are null, empty or hold null or non-finite components are left out, and so are those whose length isn't that of the
smallest id left with a length that the parts divide. A null id comes last in the order of ids; of repeated ids the lesser vector is first; repeated rows
count each. Components beyond 2**27 (x of 32,768; less for vectors of over 64 numbers) count as that, so that squares and sums stay within 64 bits. With
fewer vectors than entries, the codebooks have fewer entries. Errors of rows without a label add up together. An empty table gives no rows. The result has its own
columns only, so no name of the input can clash; join on the id for the others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Stages, frees_memory

FAR = np.iinfo(np.int64).max


def largest(length: int) -> int:
    """What a component may be so that squared distances of whole vectors, summed, stay within 63 bits."""
    return 1 << ((60 - max(6, (length - 1).bit_length())) // 2)


def whole(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x), held within what sums can take."""
    most = largest(x.shape[1])
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * x), -most, most).astype(np.int64)


def grouped(book: np.ndarray, groups: int) -> np.ndarray:
    """The group of each entry of a codebook, by a few rounds of k-means from entries evenly apart."""
    groups = min(groups, len(book))
    centres = book[np.arange(groups) * len(book) // groups].astype(float)
    for _ in range(5):
        of = ((book[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
        centres = np.stack([book[of == g].mean(0) if (of == g).any() else centres[g] for g in range(groups)])
    return of


def up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of each row to each entry."""
    return ((x[:, None, :] - entries[None]) ** 2).sum(-1)


class Round:
    """What a round's tasks need: codebooks (parts, entries, width), the groups of entries, and by how much entries have moved since the last round."""

    def __init__(self, books: np.ndarray, groups: np.ndarray, before: np.ndarray | None):
        self.books, self.groups, self.n_groups = books, groups, int(groups.max()) + 1
        moved = np.zeros(books.shape[:2]) if before is None else np.sqrt(((books - before) ** 2).sum(-1).astype(float))
        self.drift = moved
        self.group_drift = np.stack([np.where(groups == g, moved, 0).max(1) for g in range(self.n_groups)], 1)

    def first(self, part: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
        """Entry, squared distance, upper and lower bounds by a look at every entry."""
        d = distances(x, self.books[part])
        return *self._settled(part, d), d.size

    def _settled(self, part: int, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        rows, best = np.arange(len(d)), d.argmin(1)  # of equal ones the first
        near = d[rows, best]
        rest = d.copy()
        rest[rows, best] = FAR
        lower = np.stack([rest[:, self.groups[part] == g].min(1, initial=FAR) for g in range(self.n_groups)], 1)
        return best, near, up(np.sqrt(near.astype(float))), down(np.sqrt(lower.astype(float)))

    def next(self, part: int, x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Entry and bounds from those of the last round; how many distances it took."""
        book, group = self.books[part], self.groups[part]
        upper = up(upper + self.drift[part][code])
        lower = down(lower - self.group_drift[part])
        code, looked = code.copy(), 0
        some = np.flatnonzero((lower <= upper[:, None]).any(1))
        own = ((x[some] - book[code[some]]) ** 2).sum(1)
        upper[some] = up(np.sqrt(own.astype(float)))
        looked += len(some)
        fails = lower[some] <= upper[some, None]
        open_ = fails.any(1)
        some, own, fails = some[open_], own[open_], fails[open_]
        if not len(some):
            return code, upper, lower, looked
        d = np.full((len(some), len(book)), FAR)
        d[np.arange(len(some)), code[some]] = own
        for g in range(self.n_groups):
            rows, entries = np.flatnonzero(fails[:, g]), np.flatnonzero(group == g)
            if len(rows):
                d[rows[:, None], entries] = distances(x[some[rows]], book[entries])
                looked += len(rows) * len(entries)
        best, _, near, found = self._settled(part, d)
        # a group that wasn't scanned keeps its bound, but the entry that was left counts in it from now on
        left = np.where((group[code[some]][:, None] == np.arange(self.n_groups)) & (best != code[some])[:, None], down(np.sqrt(own.astype(float)))[:, None], np.float32(np.inf))
        lower[some] = np.where(fails, found, np.minimum(lower[some], left))
        code[some], upper[some] = best, near
        return code, upper, lower, looked


class Moved:
    """How sums and counts of entries change."""

    def __init__(self, parts: int, entries: int, width: int):
        self.sums = np.zeros((parts, entries, width + 1), np.int64)
        self.looked = 0

    def put(self, part: int, x: np.ndarray, code: np.ndarray, sign: int) -> None:
        np.add.at(self.sums[part, :, 0], code, sign)
        np.add.at(self.sums[part, :, 1:], code, sign * x)

    def row(self, schema: pa.Schema) -> pa.RecordBatch:
        flat = [*self.sums.reshape(-1).tolist(), self.looked]
        return pa.RecordBatch.from_arrays([pa.array([flat if f.name == "moved" else None], f.type) for f in schema], schema=schema)


def _blob(rows: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    rows = np.ascontiguousarray(rows)
    width = rows.dtype.itemsize * rows[0].size if len(rows) else 0
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * width).astype(np.int32)), pa.py_buffer(rows.tobytes())])


def _rows(column: pa.Array, dtype: type, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, *shape)


def _state(schema: pa.Schema, batch: pa.RecordBatch, x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> pa.RecordBatch:
    columns = [batch.column(0), batch.column(1), _blob(x.astype("<i4")), _blob(code.astype(np.uint8)), _blob(upper.astype("<f4")), _blob(lower.astype("<f4")), pa.nulls(len(x), schema.field("moved").type)]
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _output(batch: pa.RecordBatch) -> pa.Schema:
    names = [("v", pa.binary()), ("codes", pa.binary()), ("upper", pa.binary()), ("lower", pa.binary()), ("moved", pa.list_(pa.int64()))]
    return pa.schema([batch.schema.field(0), batch.schema.field(1), *(pa.field(n, t) for n, t in names)])


@frees_memory
def _started(batches: Iterator[pa.RecordBatch], shared, scale: float) -> Iterator[pa.RecordBatch]:
    now: Round = shared.value
    parts, entries, width = now.books.shape
    moved, schema = Moved(parts, entries, width), None
    for batch in batches:
        schema = _output(batch)
        x = whole(batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, parts * width), scale).reshape(-1, parts, width)
        code, upper, lower = np.zeros(x.shape[:2], np.int64), np.zeros(x.shape[:2], np.float32), np.zeros((*x.shape[:2], now.n_groups), np.float32)
        for p in range(parts):
            code[:, p], _, upper[:, p], lower[:, p], looked = now.first(p, x[:, p])
            moved.put(p, x[:, p], code[:, p], 1)
            moved.looked += looked
        yield _state(schema, batch, x, code, upper, lower)
    if schema:
        yield moved.row(schema)


@frees_memory
def _carried(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    now: Round = shared.value
    parts, entries, width = now.books.shape
    moved, schema = Moved(parts, entries, width), None
    for batch in batches:
        schema = _output(batch)
        x = _rows(batch.column(2), "<i4", parts, width).astype(np.int64)
        code = _rows(batch.column(3), np.uint8, parts).astype(np.int64)
        upper, lower = _rows(batch.column(4), "<f4", parts).copy(), _rows(batch.column(5), "<f4", parts, now.n_groups).copy()
        for p in range(parts):
            new, upper[:, p], lower[:, p], looked = now.next(p, x[:, p], code[:, p], upper[:, p], lower[:, p])
            change = np.flatnonzero(new != code[:, p])
            moved.put(p, x[change, p], code[change, p], -1)
            moved.put(p, x[change, p], new[change], 1)
            moved.looked += looked
            code[:, p] = new
        yield _state(schema, batch, x, code, upper, lower)
    if schema:
        yield moved.row(schema)


@frees_memory
def _finished(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    now: Round = shared.value
    parts, _, width = now.books.shape
    for batch in batches:
        x = _rows(batch.column(2), "<i4", parts, width).astype(np.int64)
        code = _rows(batch.column(3), np.uint8, parts).astype(np.int64)
        upper, lower = _rows(batch.column(4), "<f4", parts), _rows(batch.column(5), "<f4", parts, now.n_groups)
        error = np.zeros(len(x), np.int64)
        for p in range(parts):
            code[:, p] = now.next(p, x[:, p], code[:, p], upper[:, p], lower[:, p])[0]
            error += ((x[:, p] - now.books[p][code[:, p]]) ** 2).sum(1)
        digits = [c.hex() for c in _blob(code.astype(np.uint8)).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digits, pa.string()), pa.array(error)], names=[*batch.schema.names[:2], "code", "error"])


def _change(state: DataFrame) -> np.ndarray:
    """The tasks' rows of changes, added up."""
    each = state.where("moved is not null").select(F.posexplode("moved").alias("at", "value"))
    return np.array([r["s"] for r in each.groupBy("at").agg(F.sum("value").alias("s")).orderBy("at").collect()], np.int64)


def books_sha256(books: np.ndarray) -> str:
    """Of all components as decimal numbers by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def vector_codes(vectors: DataFrame, *, parts: int = 8, entries: int = 16, rounds: int = 6, groups: int = 4, scale: float = 4096.0, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label", looked: list[int] | None = None) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of every usable vector, the first two under their names in ``vectors``.

    code: the entry of each part, two hex digits each. error: squared distance of the whole numbers to their entries, over all parts. label_error: error summed
    over equal labels. entries: at most 256. looked: gets the number of distances that each round but the last computed.
    """
    if not 1 <= entries <= 256 or parts < 1 or rounds < 0:
        raise ValueError("entries must be 1 to 256, parts at least 1, rounds at least 0")
    spark = vectors.sparkSession
    stages = Stages(spark, "codes")
    usable = vectors.select(F.col(vec_id).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    usable = usable.where(F.coalesce(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False)) & (F.size("v") > 0) & (F.size("v") % parts == 0))
    order = (F.col("id").asc_nulls_last(), F.col("v"))
    out_names = [F.col("id").alias(vec_id), F.col("label").alias(label), "code", "error"]
    coded = T.StructType([usable.schema["id"], usable.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    length = usable.orderBy(*order).select(F.size("v").alias("n")).first()
    if length is None:
        return spark.createDataFrame([], coded).select(*out_names, F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    usable = usable.where(F.size("v") == length["n"])
    seeds = whole(np.array([r["v"] for r in usable.orderBy(*order).limit(entries).select("v").collect()], float), scale)
    books = seeds.reshape(len(seeds), parts, -1).transpose(1, 0, 2).copy()
    group = np.stack([grouped(b, groups) for b in books])
    schema = T.StructType([usable.schema["id"], usable.schema["label"], *(T.StructField(n, T.BinaryType()) for n in ("v", "codes", "upper", "lower")), T.StructField("moved", T.ArrayType(T.LongType()))])
    send = lambda before: spark.sparkContext.broadcast(Round(books, group, before))
    state = stages.put(usable.mapInArrow(partial(_started, shared=send(None), scale=scale), schema), "state")
    sums, held = np.zeros((parts, len(seeds), books.shape[2] + 1), np.int64), None
    for number in range(rounds):
        if number:
            new = stages.put(state.where("moved is null").select("id", "label", "v", "codes", "upper", "lower").mapInArrow(partial(_carried, shared=send(held)), schema), "state")
            stages.drop(state)
            state = new
        change = _change(state)
        sums += change[:-1].reshape(sums.shape)
        if looked is not None:
            looked.append(int(change[-1]))
        count, held = sums[:, :, :1], books
        books = np.where(count > 0, sums[:, :, 1:] // np.maximum(count, 1), books)
    rows = state.where("moved is null").select("id", "label", "v", "codes", "upper", "lower")
    done = stages.put(rows.mapInArrow(partial(_finished, shared=send(held)), coded), "coded")
    stages.drop(state)
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    total = done.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(19,0)")).cast("decimal(38,0)"), most).cast("long").alias("label_error")).withColumnRenamed("label", "label_")
    found = done.join(total, F.col("label").eqNullSafe(F.col("label_")))
    return found.select(*out_names, "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("label")


def _sql(rounds: int = 6) -> str:
    """Every distance computed, round by round."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, part, min({{'d': CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), 'e': entry}}) AS m FROM p JOIN b{r} USING (part) GROUP BY vec_id, part)")
        if r < rounds:
            steps.append(f"s{r} AS (SELECT part, m.e AS entry, pos, CAST(sum(x[pos]) AS BIGINT) AS s, count(*) AS n FROM a{r} JOIN p USING (vec_id, part), (SELECT unnest(range(1, 9)) AS pos) GROUP BY ALL)")
            steps.append(f"m{r} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS c FROM s{r} GROUP BY part, entry)")
            steps.append(f"b{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN m{r} m ON b.part = m.part AND b.entry = m.entry)")
    return f"""
WITH k AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
p AS MATERIALIZED (SELECT vec_id, part, w[part * 8 + 1:part * 8 + 8] AS x FROM k, (SELECT unnest(range(8)) AS part)),
b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c FROM p WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT 16)),
{(','+chr(10)).join(steps)},
f AS (SELECT vec_id, string_agg(printf('%02x', m.e), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id),
h AS (SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY part, entry, pos)) AS sha FROM (SELECT part, entry, pos, c[pos] AS y FROM b{rounds}, (SELECT unnest(range(1, 9)) AS pos)))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, sha AS codebooks_sha256 FROM f JOIN k USING (vec_id), h
"""


#: For vectors of 64 numbers, as the table has them.
OP13_SQL = _sql()
