"""Best-fit packing of tokenised documents into sequences, in bulk-synchronous rounds.

Method. A round has two tables: documents (pieces of at most a sequence's length) that have no place yet, and gaps of the sequences that are open.

1. Range-sort. Both tables are sorted by size over range partitions, and each row gets its rank there (its place in the partition, and the
   counts of the partitions before).
2. Conflicts are settled by rank. Row ``rank`` goes to lane ``rank mod lanes``: each lane gets every size and every gap in like shares, no gap is in
   two lanes, and equal sizes, however many, are spread over all lanes.
3. Successor sweep, one task a lane. From the largest size down, each document takes its successor among the lane's gaps, the smallest that is
   large enough, or opens a sequence. Documents of one size are alike, and so are sequences with one gap: the sweep moves such runs, so
   its work grows with the sizes that there are, and rows are placed by their rank in the run.
4. Gaps are updated. The emptiest sequences opened in the round (with a sixteenth free or more, and a quarter of the lane's documents at most) are taken
   apart again. Their documents and the gaps of the others make the next round, in fewer lanes; no more gaps come along than documents, the roomiest ones.

Rounds repeat until all documents left fit in one lane, where none is taken apart. A round has a quarter of the documents
of the one before, so rounds grow with the logarithm of the corpus, and a task has ``lane_rows`` rows or about so whatever its size. With one lane this is
best-fit decreasing; with more, each lane could waste a sequence or so, which the later rounds mend.

Only (row, size) pairs are sorted and dealt out. Tokens are made once, and meet their places in one join.

Tokens. The tokenizer normalises the text, which is then split by its own pattern; what one word gives doesn't depend on the others. So each different
word of a few megabytes is encoded once: its bytes are merged pair by pair by the file's ranks, all words side by side. Texts with characters or special strings outside the plain case go to the tokenizer as they are.

Edge cases. Null and empty texts give the end token alone. Repeated rows are packed each. Null ids are allowed. Pieces of length 0 go to sequence 0 at offset 0.
An empty table gives no rows.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache, cached_property, partial
from itertools import count

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, IntTable, Stages, frees_memory, partitions, runs, text_batches, word_kinds

DEFAULT_TOKENIZER = "word_bpe_49k.json"

# The split pattern in the tokenizer's file (its contractions stand in ``pattern_words`` too), and the characters for which normalising is lower-casing
# and white space alone (Latin letters in composed form, general punctuation and ASCII).
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PLAIN = r"[\t\n\r\x20-\x7E¡-¬®-įı-ſ‐-‧€]*"


_NONE = np.int32(1 << 30)


class Merges:
    """Byte-pair merging of many words side by side: of a word's pairs the first of the least rank is merged, again and again.

    Each merge looks at the whole word, so this is for words of up to the last of ``WIDTHS`` bytes.
    """

    WIDTHS = (4, 6, 8, 10, 13, 18, 32, 64)

    def __init__(self, model: dict):
        vocab = model["vocab"]
        self.mark = mark = model["end_of_word_suffix"]
        shown, spare = {}, 0  # the characters that stand for bytes
        for b in range(256):
            plain = 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255
            shown[b], spare = (chr(b), spare) if plain else (chr(256 + spare), spare + 1)
        self.inner = np.array([vocab[shown[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[shown[b] + mark] for b in range(256)], np.int32)
        pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.int64)
        _, first = np.unique(keys, return_index=True)
        self.ranks = IntTable(keys[first], first.astype(np.int32), 18)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        found = self.ranks.get((left.astype(np.int64) << 32) | right)
        found[found < 0] = _NONE
        return found

    def __call__(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words data[start:start + size] one after the other, and how many each has; none for longer words."""
        found, low, counts = [], 0, np.zeros(len(sizes), np.int64)
        for width in self.WIDTHS:  # words of like length together
            which = np.flatnonzero((sizes > low) & (sizes <= width))
            low, step = width, (1 << 20) // width
            for at in range(0, len(which), step):
                part = which[at : at + step]
                ids, counts[part] = self._merged(data, starts[part], sizes[part])
                found.append((part, ids))
        firsts = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int32)
        for part, ids in found:
            out[np.repeat(firsts[part], counts[part]) + runs(counts[part])] = ids
        return out, counts

    def _merged(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, width = len(sizes), int(sizes.max())
        there = np.arange(width + 1) < sizes[:, None]
        ids = np.full((n, width + 1), -1, np.int32)
        ids[there] = self.inner[data[(starts[:, None] + np.arange(width + 1))[there]]]
        ids[np.arange(n), sizes - 1] = self.last[data[starts + sizes - 1]]
        ranks = np.full((n, width + 1), _NONE, np.int32)
        pairs = there[:, 1:]
        ranks[:, :-1][pairs] = self.rank(ids[:, :-1][pairs], ids[:, 1:][pairs])
        todo, place = np.arange(n), np.arange(width)
        while len(todo):
            at = ranks[todo].argmin(1)
            best = ranks[todo, at]
            go = np.flatnonzero(best < _NONE)
            todo, at, best = todo[go], at[go], best[go]
            behind = place + (place > at[:, None])  # the pair's second part goes
            ids[todo, at] = self.made[best]
            ids[todo, :-1] = np.take_along_axis(ids[todo], behind, 1)
            ranks[todo, :-1] = np.take_along_axis(ranks[todo], behind, 1)
            here, right = ids[todo, at], ids[todo, at + 1]
            ranks[todo, at] = np.where(right < 0, _NONE, self.rank(here, right))
            inner = np.flatnonzero(at)
            rows, left = todo[inner], at[inner] - 1
            ranks[rows, left] = self.rank(ids[rows, left], here[inner])
        return ids[ids >= 0], (ids >= 0).sum(1)


@cache
def _kinds() -> np.ndarray:
    """Of each code point below 65,536: 0 white space, 1 letter, 2 number, 3 other."""
    kinds = np.full(1 << 16, 3, np.uint8)
    for c in range(1 << 16):
        kind = unicodedata.category(chr(c))[0]
        kinds[c] = 0 if chr(c).isspace() else {"L": 1, "N": 2}.get(kind, 3)
    return kinds


def pattern_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of what ``_PATTERN`` finds in UTF-8 bytes of lower-cased plain text (no code point above 65,535)."""
    n = len(data)
    kind = _kinds()[data]
    begins = np.ones(n, bool)
    wide = np.flatnonzero(data >= 0xC0)
    if len(wide):
        begins[(data & 0xC0) == 0x80] = False
        long = data[wide] >= 0xE0
        point = np.where(long, (data[wide] & 0x0F).astype(np.int32) << 12, (data[wide] & 0x1F).astype(np.int32) << 6)
        point += np.where(long, (data[wide + 1] & 0x3F).astype(np.int32) << 6, data[wide + 1] & 0x3F)
        point[long] += data[wide[long] + 2] & 0x3F
        kind[wide] = kind[wide + 1] = _kinds()[point]
        kind[wide[long] + 2] = kind[wide[long]]
    begins &= kind != 0
    begins[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    # contractions: an apostrophe alone before letters
    quote = np.flatnonzero((data == 0x27) & begins)
    quote = quote[quote + 1 < n]
    quote = quote[kind[quote + 1] == 1]
    one, two = data[quote + 1], data[np.minimum(quote + 2, n - 1)]
    pair = (one.astype(np.int32) << 8) | two
    size = np.where(np.isin(one, np.frombuffer(b"stmd", np.uint8)), 1, np.where(np.isin(pair, [0x7265, 0x7665, 0x6C6C]) & (quote + 2 < n), 2, 0))
    quote, size = quote[size > 0], size[size > 0]
    begins[quote + 1] = False
    rest = quote + 1 + size
    rest = rest[rest < n]
    begins[rest[kind[rest] == 1]] = True
    stops = np.ones(n, bool)
    stops[:-1] = begins[1:] | (kind[1:] == 0)
    stops &= kind != 0
    return np.flatnonzero(begins), np.flatnonzero(stops) + 1


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit numbers, by the tokenizer's file."""

    def __init__(self, path: str, end_id: int | None = 0, slab: int = 3 << 19):
        self.path, self.slab = path, slab
        self.end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
        self.plain = regex.compile(_PLAIN)
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        self.by_word = self._splits_by_word(made)
        self.merges = Merges(made["model"]) if self.by_word else None

    @cached_property
    def tokenizer(self):
        """For what isn't plain; most workers never need it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @staticmethod
    def _splits_by_word(made: dict) -> bool:
        """Is it of the kind that the tables here are made for?"""
        kinds = [x["type"] for x in (made.get("normalizer") or {}).get("normalizers", [])]
        steps = (made.get("pre_tokenizer") or {}).get("pretokenizers", [])
        pattern = steps[0].get("pattern", {}).get("Regex") if steps else None
        model = made["model"]
        pairs = model.get("type") == "BPE" and bool(model.get("end_of_word_suffix")) and not (model.get("ignore_merges") or model.get("dropout") or model.get("byte_fallback"))
        return pairs and kinds == ["NFC", "Replace", "Lowercase"] and pattern == _PATTERN and [x["type"] for x in steps[1:]] == ["ByteLevel"]

    def _encoded(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _plain_texts(self, texts: list[str]) -> list[bytes]:
        """Each different word of the texts once."""
        raw = [t.lower().encode() for t in texts]
        data = np.frombuffer(b"\n".join(raw), np.uint8)
        starts, ends = pattern_words(data)
        first, kind = word_kinds(data, starts, ends)
        ids, counts = self.merges(data, starts[first], (ends - starts)[first])
        if len(long := np.flatnonzero((ends - starts)[first] > Merges.WIDTHS[-1])):  # the tokenizer's own merging has no matrix of them
            alone = [np.frombuffer(self._encoded(data[starts[w] : ends[w]].tobytes().decode()), "<u4").astype(np.int32) for w in first[long]]
            at = (np.cumsum(counts) - counts)[long]
            counts[long] = [len(x) for x in alone]
            ids = np.insert(ids, np.repeat(at, counts[long]), np.concatenate(alone))
        size = counts[kind]
        upto = np.cumsum(size)
        flat = ids[np.repeat((np.cumsum(counts) - counts)[kind] - (upto - size), size) + np.arange(int(size.sum()))].astype("<u4")
        bounds = np.cumsum([0, *(len(r) + 1 for r in raw)])
        cuts = np.r_[0, upto][np.searchsorted(starts, bounds)].tolist()
        return [flat[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]

    def __call__(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text and the end's; texts of about ``slab`` characters share their words."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and size < self.slab:
                size += len(texts[end] or "")
                end += 1
            plain = [i for i in range(at, end) if texts[i] and self._is_plain(texts[i])]
            known = dict(zip(plain, self._plain_texts([texts[i] for i in plain]), strict=True)) if plain else {}
            for i in range(at, end):
                yield (known[i] if i in known else self._encoded(texts[i]) if texts[i] else b"") + self.end
            at = end

    def _is_plain(self, text: str) -> bool:
        return self.by_word and "<|" not in text and bool(self.plain.fullmatch(text))


@cache
def encoder(path: str, end_id: int | None) -> Encoder:
    """One for each Python worker; its tables serve all tasks there."""
    return Encoder(path, end_id)


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int32()))])
PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>"


@frees_memory(keeps=encoder)
def _pieces(batches: Iterator[pa.RecordBatch], path: str, end_id: int | None, size: int, emit_ids: bool) -> Iterator[pa.RecordBatch]:
    encode = encoder(path, end_id)
    for batch in batches:
        out: dict[str, list] = {c: [] for c in _PIECES.names}

        def rows(out=out) -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in _PIECES], schema=_PIECES)
            for values in out.values():
                values.clear()
            return made

        for doc_id, raw in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()), strict=True):
            for k, at in enumerate(range(0, max(1, len(raw)), 4 * size)):
                part = raw[at : at + 4 * size]
                out["doc_id"].append(doc_id)
                out["piece"].append(k)
                out["start"].append(at // 4)
                out["length"].append(len(part) // 4)
                out["ids_crc32"].append(zlib.crc32(part))
                out["ids"].append(np.frombuffer(part, np.int32) if emit_ids else None)
            if emit_ids and len(out["ids"]) >= 500:
                yield rows()
        yield rows()


def tokenized_pieces(docs: DataFrame, *, tokenizer: str, size: int, end_id: int | None = 0, emit_ids: bool = False, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids): documents as token ids, cut into pieces of at most ``size``."""
    text_batches(docs.sparkSession)
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(partial(_pieces, path=tokenizer, end_id=end_id, size=size, emit_ids=emit_ids), PIECES_DDL)


def sweep(sizes: np.ndarray, gaps: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Successor sweep: sequence and offset of each document, and what is free in each sequence in the end.

    sizes fall; gaps, of the sequences 0 .. len(gaps) - 1, fall too. More sequences are opened as need be.
    """
    n, opened = len(sizes), len(gaps)
    sequence, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    runs: dict[int, list[tuple[int, int]]] = {}  # gap -> runs of (first sequence, how many)
    known: list[int] = []  # the gaps that there are, rising

    def free(gap: int, first: int, many: int) -> None:
        if gap not in runs:
            runs[gap] = []
            insort(known, gap)
        runs[gap].append((first, many))

    heads = np.flatnonzero(np.r_[True, gaps[1:] != gaps[:-1]]) if opened else np.zeros(0, np.int64)
    for a, b in zip(heads.tolist(), [*heads[1:].tolist(), opened], strict=False):
        free(int(gaps[a]), a, b - a)
    heads = np.flatnonzero(np.r_[True, sizes[1:] != sizes[:-1]]) if n else np.zeros(0, np.int64)
    for at, end in zip(heads.tolist(), [*heads[1:].tolist(), n], strict=False):
        size = int(sizes[at])

        def take(first: int, many: int, gap: int, each: int, size: int = size) -> None:
            # ``each`` documents side by side in every one of ``many`` sequences
            nonlocal at
            which = np.arange(many * each)
            sequence[at : at + len(which)] = first + which // each
            offset[at : at + len(which)] = capacity - gap + which % each * size
            at += len(which)
            if gap - each * size:
                free(gap - each * size, first, many)

        while at < end and (i := bisect_left(known, size)) < len(known):
            gap = known[i]  # the successor
            fit = gap // size
            first, many = runs[gap].pop()
            if not runs[gap]:
                del runs[gap], known[i]
            whole = min(many, (end - at) // fit)
            if whole:
                take(first, whole, gap, fit)
            if whole < many and at < end:  # fewer than fit documents are left
                take(first + whole, 1, gap, end - at)
                whole += 1
            if whole < many:
                free(gap, first + whole, many - whole)
        if at < end:  # what finds no gap opens sequences
            fit = capacity // size
            if whole := (end - at) // fit:
                take(opened, whole, capacity, fit)
                opened += whole
            if at < end:
                take(opened, 1, capacity, end - at)
                opened += 1
    left = np.full(opened, capacity, np.int64)
    left[: len(gaps)] = gaps
    return sequence, offset, left - np.bincount(sequence, sizes, minlength=opened).astype(np.int64) if n else left


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a range partition with the partition and their place in it."""
    from pyspark import TaskContext

    part, seen = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seen, seen + n))], names=[*batch.schema.names, "part", "place"])
        seen += n


def _range_sorted(rows: DataFrame, stages: Stages) -> tuple[DataFrame, int]:
    """(id, size, rank) of rows (id, size), the largest first, and how many there are."""
    spark = rows.sparkSession
    order = [F.col("size").desc(), F.col("id")]
    sorted_ = stages.put(rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).mapInArrow(_numbered, "id long, size int, part int, place long"), "sorted")
    before, total = [], 0
    for part, n in sorted((r.part, r.n) for r in sorted_.groupBy("part").agg(F.count("*").alias("n")).collect()):  # a row for each partition
        before.append((part, total))
        total += n
    starts = F.broadcast(spark.createDataFrame(before, "part int, before long"))
    return sorted_.join(starts, "part").select("id", "size", (F.col("before") + F.col("place")).alias("rank")), total


_SWEPT = pa.schema([("row", pa.int64()), ("size", pa.int32()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("gap", pa.int32())])
_SWEPT_DDL = "row long, size int, sequence_id long, offset long, gap int"


def _lane(lane: int, kind: np.ndarray, ids: np.ndarray, sizes: np.ndarray, capacity: int, number: int, again: bool) -> pa.RecordBatch:
    """Documents with their places (null: taken apart again), then sequences with their gaps (row null)."""
    gap, doc = kind == 0, kind == 1
    sequence, offset, left = sweep(sizes[doc], sizes[gap], capacity)
    old, n = int(gap.sum()), int(doc.sum())
    names = np.r_[ids[gap], (number << 56) + (lane << 32) + np.arange(len(left) - old)]
    apart = np.zeros(len(left), bool)
    if again:
        loose = old + np.flatnonzero(left[old:] >= max(1, capacity // 16))
        loose = loose[np.argsort(-left[loose], kind="stable")]
        held = np.bincount(sequence, minlength=len(left))
        apart[loose[np.cumsum(held[loose]) <= n // 4]] = True
    placed, open_ = ~apart[sequence], ~apart & (left > 0)
    m = int(open_.sum())
    nothing = lambda values, ok: pa.array(values, mask=~ok)
    columns = [
        pa.concat_arrays([pa.array(ids[doc]), pa.nulls(m, pa.int64())]),
        pa.concat_arrays([pa.array(sizes[doc].astype(np.int32)), pa.nulls(m, pa.int32())]),
        pa.concat_arrays([nothing(names[sequence], placed), pa.array(names[open_])]),
        pa.concat_arrays([nothing(offset, placed), pa.nulls(m, pa.int64())]),
        pa.concat_arrays([pa.nulls(n, pa.int32()), pa.array(left[open_].astype(np.int32))]),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=_SWEPT)


def _swept(batches: Iterator[pa.RecordBatch], capacity: int, number: int, again: bool) -> Iterator[pa.RecordBatch]:
    """One lane after the other; rows come sorted by lane, kind (gaps first) and size."""
    held: list[list[np.ndarray]] = []
    now = None

    def done() -> pa.RecordBatch:
        return _lane(now, *(np.concatenate(x) for x in zip(*held, strict=True)), capacity, number, again)

    for batch in batches:
        lane, *columns = (batch.column(i).to_numpy() for i in range(4))
        cuts = [0, *(np.flatnonzero(lane[1:] != lane[:-1]) + 1).tolist(), len(lane)] if len(lane) else [0]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and lane[a] != now:
                yield done()
                held = []
            now = int(lane[a])
            held.append([c[a:b] for c in columns])
    if held:
        yield done()


def best_fit_packing(pieces: DataFrame, *, capacity: int, lane_rows: int = 50_000) -> DataFrame:
    """``pieces`` (any rows with a column length of at most ``capacity``) with sequence_id and offset. lane_rows: documents and gaps of a task.

    Input columns sequence_id and offset are replaced; all others pass through, whatever their names, but for pack__row, which is refused. A null length counts as 0: the row takes no
    room and stands at the start of sequence 0.
    """
    if "pack__row" in pieces.columns:
        raise ValueError("pack__row is a column of the packing's own; rename the input's")
    spark = pieces.sparkSession
    stages = Stages(spark, "packing")
    pieces = pieces.drop("sequence_id", "offset")
    held = stages.put(pieces.withColumn("pack__row", F.monotonically_increasing_id()), "pieces")  # numbered once: what is written stays
    docs = held.where("length > 0").select(F.col("pack__row").alias("id"), F.col("length").cast("int").alias("size"))
    gaps, placed = None, []
    for number in count():
        ranked, n = _range_sorted(docs, stages)
        if not n:
            break
        rows, lanes = ranked.withColumn("kind", F.lit(1)), -(-n // lane_rows)
        if gaps is not None:
            room, m = _range_sorted(gaps, stages)
            lanes = -(-(n + min(n, m)) // lane_rows)
            rows = rows.unionByName(room.where(F.col("rank") < n).withColumn("kind", F.lit(0)))
        dealt = rows.select((F.col("rank") % lanes).alias("lane"), "kind", "id", "size").repartition(lanes, "lane").sortWithinPartitions("lane", "kind", F.col("size").desc(), "id")
        swept = stages.put(dealt.mapInArrow(partial(_swept, capacity=capacity, number=number, again=lanes > 1), _SWEPT_DDL), "swept")
        placed.append(swept.where("row is not null and sequence_id is not null").select("row", "sequence_id", "offset"))
        if lanes == 1:
            break
        docs = swept.where("sequence_id is null").select(F.col("row").alias("id"), "size")
        least = docs.agg(F.min("size")).first()[0] or capacity + 1
        gaps = swept.where("row is null").where(F.col("gap") >= least).select(F.col("sequence_id").alias("id"), F.col("gap").alias("size"))
    if not placed:
        return held.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).drop("pack__row")
    where = placed[0]
    for more in placed[1:]:
        where = where.union(more)
    found = held.join(where.withColumnRenamed("row", "pack__row"), "pack__row", "left")
    return found.select(*pieces.columns, F.coalesce("sequence_id", F.lit(0)).alias("sequence_id"), F.coalesce("offset", F.lit(0)).alias("offset"))


def packed_sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids): whole sequences of pieces that carry their ids; each is at most the capacity long."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id"))).alias("p"))
    return parts.select("sequence_id", F.flatten(F.col("p.ids")).alias("ids"), F.col("p.doc_id").alias("doc_ids"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_TOKENIZER)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = tokenized_pieces(docs, tokenizer=default_tokenizer(), size=2048).drop("ids")
    return best_fit_packing(pieces, capacity=2048)
