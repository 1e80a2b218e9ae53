"""Repair of conversations by weighted finite-state composition.

Method. A conversation's turns, in order, are the input acceptor: one symbol a turn, made of its role's initial and its first fault (blank, duplicate, truncated). The
edit transducer keeps (K), reroles (R) or deletes (D) a turn, or inserts (I) one without reading; the grammar acceptor takes role initials ``(s?(ua)+)?``. The three are
composed lazily: arcs and steps of the product are made when a conversation first needs them and kept, so that all others only look them up. The shortest path is
taken over weights (cost, label string), compared in that order. Costs are found backwards in topological order (places fall; insertions at one place cost,
so they have an order too). At every state the least label among the arcs of least cost is kept; as a label tells the state that it leads to, following
these from the start gives the least string of all cheapest ones, without ever comparing whole strings.

At scale. Turns shrink to (conversation, turn, role, SHA-256 of the text, faults); equal ones become one row with a count before they shuffle. Earlier copies are found by a grouped
minimum and an equi-join. A range sort then cuts conversations wherever a partition ends, and each task gives a segment of symbols, a byte a turn; only these segments are
gathered by conversation, so a task holds no more of one than its audit, which has a letter for each turn and is one value of the result. Texts are shuffled once, to be
read in order behind their audit: they stream through a task, and none keeps a conversation. A SHA-256 of a whole conversation can only be taken in one sequence; ``repaired_turns``
gives the turns as rows instead.

Edge cases. A null role or text counts as one space: such a turn is blank, or has the initial of no role. Null turns come first; turns with equal numbers are ordered by role, then by
the SHA-256 of their text; repeated rows are duplicates of the first. Rows with a null conversation are one conversation. A conversation without rows after damage
has zeros, an empty audit and the hash of the empty string. An empty table gives no rows. Results have their own columns only, so no name of the input can clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Stages, frees_memory, partitions, text_batches

# What edits cost, the roles that an edit can give, and the white space.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
ROLES = {"u": "user", "a": "assistant"}
SPACE = " \t\n\x0b\x0c\r"

#: The grammar acceptor: what a role's initial leads to from each state; a path may end in the states of FINAL.
GRAMMAR = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FINAL = (0, 3)
_INITIALS = "?sua"
_OK, _CUT, _COPY, _BLANK = range(4)

# ---------------------------------------------------------------- the composition


@lru_cache(maxsize=None)
def arcs(symbol: int, state: int) -> tuple[tuple[str, int, int], ...]:
    """(label, cost, next state) of the edits that read this symbol; symbol -1: of those that read none."""
    out = GRAMMAR[state]
    if symbol < 0:
        return tuple(("I", INSERT, out[i]) for i in ROLES if i in out)
    fault, initial = divmod(symbol, 4)
    if fault >= _COPY:
        return (("D", DELETE, state),)
    more = TRUNCATED if fault == _CUT else 0
    kept = [("K", KEEP + more, out[_INITIALS[initial]])] if _INITIALS[initial] in out else []
    return (("D", DELETE, state), *kept, *(("R", REROLE + more, out[i]) for i in ROLES if i in out))


@lru_cache(maxsize=None)
def step(symbol: int, after: tuple[int, ...]) -> tuple[str, tuple[int, ...], int]:
    """From the costs to go behind a symbol (less their least) those before it: the label to follow in each state, these costs less their least, and that least.

    symbol -2: the end, where ``after`` is empty; the label is then ``.`` where the path stops.
    """
    if symbol == -2:
        taken = [[(".", 0)] if q in FINAL else [] for q in range(4)]
    else:
        taken = [[(label, cost + after[q2]) for label, cost, q2 in arcs(symbol, q)] for q in range(4)]
    best = [min((c for _, c in t), default=1 << 40) for t in taken]
    for _ in GRAMMAR:  # insertions at this place, one after the other
        best = [min([best[q], *(cost + best[q2] for _, cost, q2 in arcs(-1, q))]) for q in range(4)]
    labels = "".join(min([label for label, c in taken[q] if c == best[q]] + [label for label, cost, q2 in arcs(-1, q) if cost + best[q2] == best[q]]) for q in range(4))
    least = min(best)
    return labels, tuple(b - least for b in best), least


@lru_cache(maxsize=None)
def _leads(symbol: int, state: int, label: str) -> int:
    return next(q for x, _, q in arcs(-1 if label == "I" else symbol, state) if x == label)


def cheapest(codes: bytes) -> tuple[int, str]:
    """Cost and audit of the shortest path for a conversation's symbols."""
    labels, after, total = step(-2, ())
    chosen = [labels]
    for symbol in reversed(codes):
        labels, after, least = step(symbol, after)
        chosen.append(labels)
        total += least
    total += after[0]
    audit, state, at, n = [], 0, 0, len(codes)
    while (label := chosen[n - at][state]) != ".":
        audit.append(label)
        state = _leads(codes[at] if at < n else -1, state, label)
        at += label != "I"
    return total, "".join(audit)


_LEGAL = np.zeros((4, 4), bool)
_LEGAL[[1, 2, 3], [2, 3, 2]] = True


def report(codes: bytes) -> tuple[int, int, int, int, int, str]:
    """(blank, duplicate, truncated, illegal, cost, audit) of a conversation's symbols."""
    fault, initial = np.divmod(np.frombuffer(codes, np.uint8), 4)
    counts = np.bincount(fault, minlength=4)
    illegal = int((~_LEGAL[initial[:-1], initial[1:]]).sum())
    return int(counts[_BLANK]), int(counts[_COPY]), int(counts[_CUT]), illegal, *cheapest(codes)


_short_report = lru_cache(maxsize=50_000)(report)

# ---------------------------------------------------------------- turns as symbols


def _turns(rows: DataFrame, conv_id: str, turn: str, role: str, text: str, absent: Column) -> DataFrame:
    """Conversation, turn, role, text and whether the row is there at all, under names of our own."""
    clean = rows.select(F.col(conv_id).alias("id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"), absent.alias("absent"))
    return clean.withColumns({c: F.when(~F.col("absent"), F.col(c)) for c in ("turn", "role", "text")}).withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


def _symbols(turns: DataFrame, stages: Stages) -> DataFrame:
    """(id, turn, role, digest, symbol, copies): equal turns once; symbol is null for a row that isn't there."""
    tail = F.rtrim("text", F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    initial = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0)
    fault = F.when(tail == "", _BLANK).when(F.right(tail, F.lit(1)).isin(".", "!", "?"), _OK).otherwise(_CUT)
    slim = turns.select("id", "turn", "role", "digest", F.when(~F.col("absent"), fault * 4 + initial).cast("int").alias("symbol"))
    counted = stages.put(slim.groupBy(*slim.columns).agg(F.count("*").alias("copies")), "turns")
    first = counted.where(F.col("symbol") < 4 * _COPY).groupBy("id", "role", "digest").agg(F.min("turn").alias("first"), F.bool_or(F.col("turn").isNull()).alias("before"), F.count("*").alias("n")).where("n > 1")
    first = first.select(F.col("id").alias("of"), F.col("role").alias("said"), F.col("digest").alias("what"), "first", "before")
    met = counted.join(first, F.col("id").eqNullSafe(F.col("of")) & (F.col("role") == F.col("said")) & (F.col("digest") == F.col("what")), "left")
    again = F.coalesce(F.col("turn").isNotNull() & (F.col("before") | (F.col("turn") > F.col("first"))), F.lit(False))
    return met.select("id", "turn", "role", "digest", F.when(again & (F.col("symbol") < 4 * _COPY), 4 * _COPY + F.col("symbol") % 4).otherwise(F.col("symbol")).alias("symbol"), "copies")


_NONE = object()


def _segments(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Of turns in order, a row for each run of turns of one conversation: its symbols, its first and last turn and how many different ones."""
    part = TaskContext.get().partitionId()
    now, codes, first, last, different = _NONE, bytearray(), None, None, 0
    out: list[tuple] = []

    def rows() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        out.clear()
        return made

    for batch in batches:
        for key, turn, symbol, copies in zip(*(batch.column(i).to_pylist() for i in (0, 1, 4, 5)), strict=True):
            if key != now:
                if now is not _NONE:
                    out.append((now, part, bytes(codes), first, last, different))
                now, codes, first, last, different = key, bytearray(), None, None, 0
            if symbol is None:
                continue
            codes.append(symbol)
            if copies > 1:
                codes += bytes([symbol if symbol >= 4 * _BLANK else 4 * _COPY + symbol % 4]) * (copies - 1)
            if turn is not None and turn != last:
                different += 1
                last, first = turn, turn if first is None else first
        if len(out) > 4000:
            yield rows()
    if now is not _NONE:
        out.append((now, part, bytes(codes), first, last, different))
    if out:
        yield rows()


@frees_memory(keeps=_short_report)
def _reports(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for key, segments in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            codes = b"".join(s["codes"] for s in segments)
            dated = [s for s in segments if s["first"] is not None]
            gaps = 0
            if dated:
                shared = sum(a["last"] == b["first"] for a, b in zip(dated, dated[1:], strict=False))
                gaps = dated[-1]["last"] - dated[0]["first"] + 1 - sum(s["different"] for s in dated) + shared
            out.append((key, gaps, *(_short_report(codes) if len(codes) <= 64 else report(codes))))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _audited(turns: DataFrame, stages: Stages) -> DataFrame:
    spark = turns.sparkSession
    order = ("id", "turn", "role", "digest")
    sorted_ = _symbols(turns, stages).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    own = turns.schema["id"]
    piece = T.StructType([own, T.StructField("part", T.IntegerType()), T.StructField("codes", T.BinaryType()), T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("different", T.LongType())])
    pieces = sorted_.mapInArrow(partial(_segments, schema=_arrow(piece)), piece)
    gathered = pieces.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("part", "codes", "first", "last", "different"))).alias("s"))
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    told = T.StructType([own, *(T.StructField(n, T.LongType()) for n in names), T.StructField("audit", T.StringType())])
    return stages.put(gathered.mapInArrow(partial(_reports, schema=_arrow(told)), told), "reports")


# ---------------------------------------------------------------- the repaired conversations


@frees_memory
def _spoken(batches: Iterator[pa.RecordBatch], schema: pa.Schema, digest: bool) -> Iterator[pa.RecordBatch]:
    """Audits, each before its conversation's turns in order: the turns that stay, with their edits, or the conversation's hash."""
    now, audit, at, state, place, told = _NONE, "", 0, 0, 0, hashlib.sha256()
    out: list[tuple] = []

    def say(edit: str, turn: int | None, role: str, text: str) -> None:
        nonlocal place
        if digest:
            told.update(("\n" * (place > 0) + f"{role}:{text}").encode())
        else:
            out.append((now, place, edit, turn, role, text))
        place += 1

    def inserted() -> None:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            initial = next(i for i in ROLES if i in GRAMMAR[state])
            state, at = GRAMMAR[state][initial], at + 1
            say("I", None, ROLES[initial], "")

    def over() -> None:
        inserted()
        if digest and now is not _NONE:
            out.append((now, told.hexdigest()))

    def rows() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        out.clear()
        return made

    for batch in batches:
        for key, new, turn, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 3, 4)), strict=True):
            if new is not None:
                over()
                now, audit, at, state, place, told = key, new, 0, 0, 0, hashlib.sha256()
                continue
            if role is None:
                continue
            inserted()
            edit, at = audit[at], at + 1
            if edit == "K":
                state = GRAMMAR[state][role[0]]
                say("K", turn, role, text)
            elif edit == "R":
                initial = next(i for i in ROLES if i in GRAMMAR[state])
                state = GRAMMAR[state][initial]
                say("R", turn, ROLES[initial], text)
        if out:
            yield rows()
    over()
    if out:
        yield rows()


def _said(turns: DataFrame, reports: DataFrame, digest: bool) -> DataFrame:
    own = turns.schema["id"]
    fields = [T.StructField("repaired_sha256", T.StringType())] if digest else [T.StructField("place", T.LongType()), T.StructField("edit", T.StringType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]
    schema = T.StructType([own, *fields])
    heads = reports.select("id", "audit", F.lit(None).cast("long").alias("turn"), *(F.lit(None).cast("string").alias(c) for c in ("role", "text")), F.lit(None).cast("binary").alias("digest"), F.lit(0).alias("after"))
    read = heads.union(turns.select("id", F.lit(None).cast("string").alias("audit"), "turn", "role", "text", "digest", F.lit(1).alias("after")))
    read = read.repartition(partitions(turns.sparkSession), "id").sortWithinPartitions("id", "after", "turn", "role", "digest")
    return read.select("id", "audit", "turn", "role", "text").mapInArrow(partial(_spoken, schema=_arrow(schema), digest=digest), schema)


def repaired_turns(rows: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", absent: Column | None = None) -> DataFrame:
    """(conv_id, place, edit, turn, role, text): the turns of each repaired conversation from place 0 on; an inserted turn has no turn number. absent: rows that only name their conversation."""
    stages = Stages(rows.sparkSession, "repair")
    text_batches(rows.sparkSession)
    turns = _turns(rows, conv_id, turn, role, text, F.lit(False) if absent is None else absent)
    return _said(turns, _audited(turns, stages), digest=False).withColumnRenamed("id", conv_id)


def repair_reports(rows: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", absent: Column | None = None) -> DataFrame:
    """One row for each conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 (of ``role:text``, joined by line ends)."""
    stages = Stages(rows.sparkSession, "repair")
    text_batches(rows.sparkSession)
    turns = _turns(rows, conv_id, turn, role, text, F.lit(False) if absent is None else absent)
    reports = _audited(turns, stages)
    hashes = _said(turns, reports, digest=True).withColumnRenamed("id", "of")
    return reports.join(hashes, F.col("id").eqNullSafe(F.col("of"))).drop("of").withColumnRenamed("id", conv_id)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, absent): rows damaged by the CRC-32 of ``conv_id:turn``, in twentieths; a dropped row is marked absent, so that its conversation is kept."""
    told = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    kind = F.crc32(F.concat(told[0], F.lit(":"), told[1]).cast("binary")) % 20
    role = F.when(kind == 4, "user").otherwise(told[2])
    text = F.when(kind == 1, "").when(kind == 2, F.translate(told[3], ".!?", "")).otherwise(told[3])
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind == 0).alias("absent"), F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("again"))
    return rows.drop("again")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return repair_reports(rows, absent=F.col("absent"))
