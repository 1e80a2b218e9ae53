"""Large files read in splits: numbered lines, and the elements of one JSON document.

Spark's text reader cuts files into splits on any file system and gives each record, ended by a byte of our choice, to the split in which it begins. Records come in order within a
split, and know where it starts; so what a record's number, or a bracket's depth, needs from before is a prefix sum over splits, a row each. No task reads a whole file.

A folder of files is read as one, by their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.jsonx import canonical, strict_loads
from .store import Store, scratch

#: What a UTF-8 byte order mark has, which the reader leaves out.
_MARK = 3


def records(spark: SparkSession, path: str | list[str], end: str) -> DataFrame:
    """(file, size, block, value): what ``end`` ends, in the order of the file within each block."""
    found = spark.read.option("lineSep", end).text(path)
    return found.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"), "value")


def _before(parts: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """``parts``, a row for each split or piece of one, with running sums of what stands before."""
    window = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(*order, *(F.coalesce(F.sum(column).over(window), F.lit(0)).cast("long").alias(name) for name, column in sums.items()))


def _table_of(store: Store) -> Callable[[str, DataFrame], DataFrame]:
    """Writes tables to the store and reads them again; of a written one Spark knows the size, and broadcasts it only if that is small."""

    def put(name: str, rows: DataFrame) -> DataFrame:
        rows.write.parquet(store.path(name))
        return store.spark.read.schema(rows.schema).parquet(store.path(name))

    return put


# ---------------------------------------------------------------- numbered lines

_LINE = "file string, block long, nth long, value string"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The place of each line in its block; a record's inner carriage returns end lines too, and one before its end belongs to that."""
    now, nth = None, 0
    for batch in batches:
        out: list[tuple[str, int, int, str]] = []
        for file, block, value in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if (file, block) != now:
                now, nth = (file, block), 0
            for line in value.removesuffix("\r").split("\r"):
                out.append((file, block, nth, line))
                nth += 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["file", "block", "nth", "value"])


def numbered(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(line, value) of all lines, counted from 1; \\n, \\r and \\r\\n end a line, and nothing follows the last end. Invalid UTF-8 is an error when the result is read.

    Two passes over the file and no shuffle of lines: lines are counted by split, then numbered.
    """
    found = records(spark, path, "\n")
    returns = F.octet_length("value") - F.octet_length(F.translate("value", "\r", ""))
    lines = returns + 1 - F.endswith("value", F.lit("\r")).cast("int")
    put = _table_of(scratch(spark, "lines"))
    blocks = put("blocks", found.groupBy("file", "block").agg(F.sum(lines).alias("lines"), F.sum(F.octet_length("value") + 1).alias("bytes"), F.first("size").alias("size")))
    files = blocks.groupBy("file").agg(F.sum("bytes").alias("read"), F.first("size").alias("whole"), F.min("block").alias("head"))
    marked = files.where(F.col("whole") - F.col("read") >= _MARK - 1).select("file", F.col("head").alias("block"), F.lit(True).alias("marked"))
    before = put("before", _before(blocks, ["file", "block"], {"before": "lines"}).join(marked, ["file", "block"], "left"))
    sound = F.when(F.is_valid_utf8("value"), F.col("value")).otherwise(F.raise_error(F.lit("invalid UTF-8")).cast("string"))
    placed = found.select("file", "block", sound.alias("value")).mapInArrow(_counted, _LINE).join(before, ["file", "block"])
    text = F.when(F.coalesce("marked", F.lit(False)) & (F.col("nth") == 0), F.concat(F.lit("﻿"), F.col("value"))).otherwise(F.col("value"))
    return placed.select((F.col("before") + F.col("nth") + 1).alias("line"), text.alias("value"))


# ---------------------------------------------------------------- the elements of a JSON document

#: Bytes of a chunk, about.
CHUNK = 1 << 20
_KEY = ["file", "block", "seq"]
_CHUNKS = "file string, block long, seq int, data binary, size long, quotes int, outside int, inside int, first int"
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 13, 32]] = True
_STEP = np.zeros(256, np.int8)
_STEP[[0x5B, 0x7B]], _STEP[[0x5D, 0x7D]] = 1, -1


def _quotes(data: np.ndarray) -> np.ndarray:
    """How many quotes that open or close a string stand before each byte; escaped ones follow an odd run of backslashes."""
    at = np.flatnonzero(data == 0x22)
    solid = np.flatnonzero(np.r_[True, data != 0x5C])  # 0: the chunk's start, then the places after bytes that are no backslash
    run = at - solid[np.searchsorted(solid, at, "right") - 1]
    marks = np.zeros(len(data), np.int64)
    marks[at[run % 2 == 0]] = 1
    return np.cumsum(marks) - marks


def _chunk(key: tuple, seq: int, size: int, parts: list[bytes]) -> tuple:
    """A chunk and what it does to the lexer that enters it outside of a string, or inside: brackets count only outside."""
    raw = b"".join(parts)
    data = np.frombuffer(raw, np.uint8)
    marks = _quotes(data)
    steps = _STEP[data].astype(np.int64)
    even = marks % 2 == 0
    solid = np.flatnonzero(~_BLANK[data])
    return (*key, seq, raw, size, int(marks[-1]), int(steps[even].sum()), int(steps[~even].sum()), int(data[solid[0]]) if len(solid) else None)


def _chunked(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    """Records put together again, about so many bytes at a time; each gets its end back, the last of a file too."""
    now, seq, size, held, parts = None, 0, 0, 0, []
    types = (pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
    names = [x.split(" ")[0] for x in _CHUNKS.split(", ")]

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(_chunk(now, seq, size, parts), types, strict=True)], names=names)

    for batch in batches:
        for file, whole, block, value in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if (file, block) != now or held >= chunk:
                if parts:
                    yield row()
                seq = seq + 1 if (file, block) == now else 0
                now, size, held, parts = (file, block), whole, 0, []
            parts += (value, b"}")
            held += len(value) + 1
    if parts:
        yield row()


#: Pieces of slots: level 0 is what stands outside of all brackets, with them; level 1 members of a top-level object; level 2 the elements.
_PIECES = "file string, block long, seq int, level int, nth int, list int, data binary"


def _cut(batches: Iterator[pa.RecordBatch], grouped: bool) -> Iterator[pa.RecordBatch]:
    """Slots of a chunk whose state at its start is known. nth: slots of that level begun in the chunk up to this piece (0: it goes on); list: lists of elements begun."""
    depth_of = 2 if grouped else 1
    types = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
    for batch in batches:
        out: list[tuple] = []
        for file, block, seq, raw, quotes, depth in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            data = np.frombuffer(raw, np.uint8)
            if not len(data):
                continue
            text = (_quotes(data) + quotes) % 2 == 1
            steps = np.where(text, 0, _STEP[data]).astype(np.int64)
            after = depth + np.cumsum(steps)
            least = np.clip(np.minimum(after, after - steps), 0, depth_of)
            comma = (data == 0x2C) & ~text
            opens = (steps > 0) & (after == depth_of)
            lists = np.cumsum(opens)
            for level in range(depth_of + 1):
                mine = least == level
                name = level if grouped or not level else 2
                ends = comma & (after == level) if level else np.zeros(len(data), bool)
                # a slot begins behind a comma of its level, or behind the bracket that opens the level
                starts = ends | ((steps > 0) & (after == level)) if level else ends
                nth = np.cumsum(starts)
                keep = np.flatnonzero(mine & ~ends)
                for at in np.split(keep, np.flatnonzero(np.diff(nth[keep])) + 1) if len(keep) else []:
                    out.append((file, block, seq, name, int(nth[at[0]]), int(lists[at[0]]), data[at].tobytes()))
                begun = np.flatnonzero(starts)
                begun = begun[~np.isin(nth[begun], nth[keep])]  # slots without a byte here
                for n, list_ in zip(nth[begun].tolist(), lists[begun].tolist(), strict=True):
                    out.append((file, block, seq, name, n, list_, b""))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["file", "block", "seq", "level", "nth", "list", "data"])


@F.pandas_udf(T.StructType([T.StructField("name", T.StringType()), T.StructField("problem", T.StringType())]))
def _member(texts: pd.Series) -> pd.DataFrame:
    """A member's name, the lists' elements cut out; and what is wrong with it."""

    def one(text: bytes) -> tuple[str | None, str | None]:
        try:
            found = strict_loads("{" + text.decode() + "}")
        except ValueError as error:
            return None, str(error)
        if len(found) != 1:
            return None, "a member is expected between commas"
        (name, value), = found.items()
        return name, None if isinstance(value, list) else "tool groups must be lists"

    return pd.DataFrame([one(t) for t in texts], columns=["name", "problem"])


@F.pandas_udf(T.StringType())
def _element(texts: pd.Series) -> pd.Series:
    def one(text: bytes) -> str:
        value = strict_loads(text.decode())
        if not isinstance(value, dict):
            raise ValueError("tools must be a list or grouped object")
        return canonical(value)

    return texts.map(one)


def elements(spark: SparkSession, path: str | list[str], *, chunk: int = CHUNK) -> DataFrame:
    """(ord, item): the objects of a JSON list, or of an object's lists in their order, as canonical JSON text. Whatever is no such document is an error.

    The lexer's state is a depth and whether a string is open. A chunk's effect on it is known for both without the chunks before; running sums give every chunk the state that it starts with, and then each is
    cut by itself. Slots that go on over chunks are put together by their number.
    """
    put = _table_of(scratch(spark, "document"))
    read = records(spark, path, "}").select("file", "size", "block", F.col("value").cast("binary").alias("value"))
    chunks = put("chunks", read.mapInArrow(partial(_chunked, chunk=chunk), _CHUNKS))
    # a file's bytes tell whether its last record had an end, and whether a mark was left out
    told = chunks.select(*_KEY, F.octet_length("data").alias("n"), "size", "quotes", "outside", "inside", "first")
    files = told.groupBy("file").agg((F.sum("n") - F.first("size")).alias("more"), F.max(F.struct("block", "seq")).alias("last"))
    if files.where("more NOT IN (0, 1)").limit(1).count():
        raise ValueError("unexpected byte order mark")
    ends = files.where("more = 1").select("file", F.col("last.block").alias("block"), F.col("last.seq").alias("seq"), F.lit(1).alias("cut"))
    told = told.join(ends, _KEY, "left").withColumn("cut", F.coalesce("cut", F.lit(0)))
    quotes = _before(told, _KEY, {"before": "quotes"}).withColumn("open", F.col("before") % 2)
    # the end that isn't there closes nothing; it counts only outside of a string
    ended = (F.col("open") + F.col("quotes")) % 2 == 0
    told = told.join(quotes, _KEY).withColumn("step", F.when(F.col("open") == 0, F.col("outside")).otherwise(F.col("inside")) + F.when(ended, F.col("cut")).otherwise(0))
    state = put("state", told.select(*_KEY, "open", "step", "cut", "first", "quotes").join(_before(told, _KEY, {"depth": "step"}), _KEY))
    first = state.where("first is not null").agg(F.min_by("first", F.struct(*_KEY)).alias("b")).first()["b"]
    whole = state.agg(F.sum("step").alias("depth"), F.sum("quotes").alias("quotes")).first()
    if first is None or whole["depth"] or whole["quotes"] % 2:
        raise ValueError("the document isn't complete JSON")
    data = F.when(F.col("cut") == 1, F.expr("substring(data, 1, octet_length(data) - 1)")).otherwise(F.col("data"))
    entered = chunks.select(*_KEY, "data").join(state, _KEY).select(*_KEY, data.alias("data"), "open", "depth")
    grouped = first == 0x7B
    pieces = put("pieces", entered.mapInArrow(partial(_cut, grouped=grouped), _PIECES))
    begun = pieces.groupBy(*_KEY).agg(F.max(F.when(F.col("level") == 1, F.col("nth"))).alias("m"), F.max(F.when(F.col("level") == 2, F.col("nth"))).alias("e"), F.max("list").alias("l"))
    before = put("before", _before(begun, _KEY, {"members": "m", "elements": "e", "lists": "l"}))
    number = F.col("nth") + F.when(F.col("level") == 1, F.col("members")).when(F.col("level") == 2, F.col("elements")).otherwise(0)
    slots = pieces.join(before, _KEY).select("level", number.alias("slot"), (F.col("list") + F.col("lists")).alias("list"), F.struct(*_KEY, "data").alias("piece"))
    slots = slots.groupBy("level", "slot").agg(F.max("list").alias("list"), F.array_sort(F.collect_list("piece")).alias("p"))
    slots = put("slots", slots.select("level", "slot", "list", F.aggregate("p", F.lit(b""), lambda x, p: F.concat(x, p["data"])).alias("data")))
    blank = F.trim(F.translate(F.col("data").cast("string"), "\t\n\r", "   ")) == ""
    outside = slots.where("level = 0").first()
    if not isinstance(strict_loads(bytes(outside["data"] if outside else b"").decode()), dict if grouped else list):
        raise ValueError("tools must be a list or grouped object")
    if grouped:
        members = slots.where("level = 1")
        if members.count() > 1 or members.where(~blank).limit(1).count():
            known = members.select(_member("data").alias("m")).select("m.*")
            if bad := known.where("problem IS NOT NULL").limit(1).collect():
                raise ValueError(bad[0].problem)
            if again := known.groupBy("name").count().where("count > 1").limit(1).collect():
                raise ValueError(f"duplicate JSON key: {again[0].name}")
    found = slots.where("level = 2")
    empty = found.where(blank).join(found.groupBy("list").agg(F.count("*").alias("n")), "list")
    sizes = empty.agg(F.count("*").alias("all"), F.coalesce(F.max("n"), F.lit(1)).alias("most")).first()
    if sizes["most"] > 1:
        raise ValueError("an element is missing between commas")
    items = found.where(~blank)
    if sizes["all"] and grouped:  # empty lists have a slot, but no number
        from ..operators.ordinals import with_ordinals

        items = with_ordinals(items, "slot")
        place = F.col("ord")
    else:
        place = F.col("slot") - 1
    return items.select(place.cast("int").alias("ord"), _element("data").alias("item"))
