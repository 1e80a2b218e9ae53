"""Language identification by cross-parsing entropy against suffix automata of labelled text.

Method. For each language a suffix automaton is built over a sample of its labelled text; a path from its root spells a string
that occurs in that text. A document is parsed into phrases: each is the longest match that the automaton allows from where the
last one ended. The fewer phrases, the nearer the language. Phrase counts are normalised by the sample's size (a phrase costs
log2 of it in bits) and the document's length; the language with the least wins, on equal values the first in order.

The whole text is parsed as one. To let much of it advance side by side, two array lookups a character and language, it is dealt
into runs of ``RUN`` characters, each a head of ``HEAD`` and the rest: at first each run starts a phrase; a piece that the one before
leaves in another state than it began with is parsed again from there, until all agree. Two parses fall together at the first phrase
that both begin at one place, so that heads need a second look and few pieces more; what doesn't agree after ``ROUNDS`` looks is parsed from there to its end in one go. An automaton has at most
``2 * sample_chars`` states and ``3 * sample_chars`` edges, and is kept by its edges, so that its size doesn't follow the alphabet's; with all languages over ``max_bytes`` it is an error. A sample holds excerpts of the documents with the least hash of their id up to ``sample_chars``
characters (its bound is this parameter and doesn't depend on the corpus). An excerpt has at most a hundredth of the sample, more only
where a language has too few documents to fill it so, and starts at a place told by the hash. Every language with labelled text has a sample.

Characters: letters and the marks that combine with them are lower-cased, all else (white space, digits, punctuation) counts as one
separator, and letters that a language's sample lacks match nothing (a phrase of their own).

Edge cases. A text that is null, empty or without letters (Unicode category L, in every plane) is ``und`` with score 0. Rows of the labels' side with null text or language
are left out; without any, all documents are ``und``. Rows with a null id are predicted, and are never learnt from. Repeated rows
are predicted each. The score is the winner's share of the inverse normalised counts, from 1 / languages to 1.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import frees_memory, text_batches, text_slices
from .common import runs as run_index

#: Characters that advance as one run, those of its head, and how often pieces are looked at again before the rest of a text is parsed in one go.
RUN, HEAD, ROUNDS = 512, 64, 32
SAMPLE_CHARS = 40_000
#: Of the broadcast automata, of all languages together; more is an error.
MAX_BYTES = 512 << 20


def suffix_automaton(codes: np.ndarray) -> list[dict[int, int]]:
    """The minimal automaton of all substrings of a sequence of small numbers: the edges of each state (0 is none; 1 the root)."""
    nexts: list[dict[int, int]] = [{}, {}]
    link, length = [0, 0], [0, 0]
    last = 1
    for c in codes.tolist():
        now = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p and c not in nexts[p]:
            nexts[p][c] = now
            p = link[p]
        if not p:
            link[now] = 1
        else:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                clone = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = link[p]
                link[q] = link[now] = clone
        last = now
    return nexts


class Edges:
    """An automaton in two arrays whose size follows its edges, however many symbols there are.

    A state is a number of its own, its base; its edge by symbol c stands at base + c, where ``owner`` has the base and ``target`` the next state's. States with several edges
    are fitted, widest first, into the first gaps that take them; those with one edge stand behind, side by side: in falling order of their symbols all their bases differ.
    """

    def __init__(self, nexts: list[dict[int, int]], symbols: int):
        base = np.zeros(len(nexts), np.int64)
        taken, bases = 0, 1  # as bits: the places that have an edge, and the numbers that are a state's (0 is none's)
        for state in sorted((s for s, edges in enumerate(nexts) if len(edges) > 1), key=lambda s: -len(nexts[s])):
            clash, mine = bases, 0
            for c in nexts[state]:
                clash |= taken >> c
                mine |= 1 << c
            free = (~clash & (clash + 1)).bit_length() - 1
            base[state] = free
            taken |= mine << free
            bases |= 1 << free
        end = max(taken.bit_length(), bases.bit_length()) + symbols
        single = np.array([s for s, edges in enumerate(nexts) if len(edges) == 1], np.int64)
        by = np.array([next(iter(nexts[s])) for s in single.tolist()], np.int64)
        order = np.argsort(-by, kind="stable")
        base[single[order]] = end + np.arange(len(single)) - by[order]
        last = np.array([s for s, edges in enumerate(nexts) if s and not edges], np.int64)
        base[last] = end + len(single) + np.arange(len(last))
        size = int(base.max()) + symbols
        self.owner, self.target, self.root = np.zeros(size, np.int32), np.zeros(size, np.int32), int(base[1])
        source = np.repeat(np.arange(len(nexts)), [len(edges) for edges in nexts])
        symbol = np.array([c for edges in nexts for c in edges], np.int64)
        to = np.array([t for edges in nexts for t in edges.values()], np.int64)
        if len(source):
            self.owner[base[source] + symbol] = base[source]
            self.target[base[source] + symbol] = base[to]


def _lower(c: int) -> int:
    return ord(chr(c).lower()[0]) if unicodedata.category(chr(c))[0] in "LM" else 0


@cache
def _lower_table() -> np.ndarray:
    """Code point to lower-cased letter, 0 for what is no letter; for the first 65,536 code points."""
    return np.array([_lower(c) for c in range(1 << 16)], np.int64)


def letters(points: np.ndarray) -> np.ndarray:
    """Lower-cased letters and marks, 0 for all else. Beyond the first 65,536 code points the distinct ones are looked up."""
    wide = points >= 1 << 16
    out = _lower_table()[np.where(wide, 0, points)]
    if wide.any():
        there, inverse = np.unique(points[wide], return_inverse=True)
        out[wide] = np.array([_lower(c) for c in there.tolist()], np.int64)[inverse]
    return out


@cache
def _is_letter_table() -> np.ndarray:
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(1 << 16)])


def is_letter(points: np.ndarray) -> np.ndarray:
    """Where a letter stands; marks alone are none."""
    wide = points >= 1 << 16
    out = _is_letter_table()[np.where(wide, 0, points)]
    if wide.any():
        there, inverse = np.unique(points[wide], return_inverse=True)
        out[wide] = np.array([unicodedata.category(chr(c))[0] == "L" for c in there.tolist()])[inverse]
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


class Model:
    """Automata of several languages over one alphabet: code 0 is the separator, the last one what no sample has."""

    def __init__(self, samples: dict[str, list[str]], max_bytes: int = MAX_BYTES):
        self.langs = sorted(samples)
        texts = {lang: letters(code_points("\n".join(samples[lang]))) for lang in self.langs}
        known = np.unique(np.concatenate([np.zeros(1, np.int64), *texts.values()]))
        self.known, self.symbols = known, len(known) + 1
        owners, targets, sizes, at = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [], 0
        self.roots = []
        for lang in self.langs:
            codes = np.searchsorted(known, texts[lang])
            if len(codes):
                codes = codes[np.r_[True, (codes[1:] != 0) | (codes[:-1] != 0)]]  # separators once
            edges = Edges(suffix_automaton(codes), self.symbols)
            owners.append(np.where(edges.owner > 0, edges.owner + np.int32(at), 0))
            targets.append(np.where(edges.target > 0, edges.target + np.int32(at), 0))
            self.roots.append(edges.root + at)
            sizes.append(max(2, len(codes)))
            at += len(edges.owner)
            if 8 * at > max_bytes:
                raise ValueError(f"the languages' automata take over {max_bytes} bytes at {lang}, number {len(sizes)} of {len(self.langs)}: take a smaller sample_chars or allow more")
        self.owner, self.target = np.concatenate(owners).astype(np.int32), np.concatenate(targets).astype(np.int32)
        self.bits = np.log2(np.array(sizes, float)) if sizes else np.zeros(0)

    def step(self, state: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The states after a symbol, 0 where there is no such edge."""
        at = state + codes
        return self.target.take(at, mode="clip") * (self.owner.take(at, mode="clip") == state)  # all are in range, and clipping is the quicker way

    def codes(self, points: np.ndarray) -> np.ndarray:
        low = letters(points)
        at = np.searchsorted(self.known, low)
        at[at == len(self.known)] = 0
        return np.where(self.known[at] == low, at, self.symbols - 1).astype(np.int32)

    def phrases(self, codes: np.ndarray, place: np.ndarray) -> np.ndarray:
        """(texts, languages) numbers of phrases of each text codes[place[i]:place[i + 1]], parsed as one."""
        sizes = np.diff(place)
        pieces = sizes // RUN * 2 + (sizes % RUN > 0) + (sizes % RUN > HEAD)
        text, index = np.repeat(np.arange(len(sizes)), pieces), run_index(pieces)
        starts = place[text] + index // 2 * RUN + index % 2 * HEAD
        ends = np.minimum(starts + np.where(index % 2, RUN - HEAD, HEAD), place[text + 1])
        fresh = index == 0
        entry = np.tile(np.array(self.roots, np.int32), (len(text), 1))
        breaks, left = np.zeros(entry.shape, np.int64), entry.copy()
        heads, rests = np.flatnonzero(index % 2 == 0), np.flatnonzero(index % 2)
        breaks[heads], left[heads] = self.parse(codes, starts[heads], ends[heads], entry[heads])
        entry[rests] = left[rests - 1]
        breaks[rests], left[rests] = self.parse(codes, starts[rests], ends[rests], entry[rests])
        last = np.flatnonzero(np.r_[fresh[1:], np.ones(min(1, len(fresh)), bool)])
        for look in range(ROUNDS + 1):
            due = np.concatenate([entry[:1], left[:-1]])
            wrong = np.flatnonzero((due != entry).any(axis=1) & ~fresh)
            if not len(wrong):
                break
            if look < ROUNDS:
                entry[wrong] = due[wrong]
                breaks[wrong], left[wrong] = self.parse(codes, starts[wrong], ends[wrong], entry[wrong])
                continue
            first = wrong[np.r_[True, text[wrong[1:]] != text[wrong[:-1]]]]
            tails, states = self.parse(codes, starts[first], place[text[first] + 1], due[first])
            end = np.searchsorted(text, text[first], "right")
            after = np.repeat(first, end - first) + run_index(end - first)
            breaks[after] = 0
            breaks[first], left[end - 1] = tails, states
        total = np.zeros((len(sizes), len(self.roots)), np.int64)
        np.add.at(total, text, breaks)
        total[text[last]] += left[last] != np.array(self.roots, np.int32)  # the phrase that the end cuts off
        return total

    def parse(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each codes[start:end], begun in the states ``entry``: how many phrases end in it, and the states after it; (runs, languages)."""
        order = np.argsort(starts - ends, kind="stable")  # longest first, so that runs still open are a head
        starts, ends = starts[order], ends[order]
        sizes = ends - starts
        n = len(starts)
        roots = np.array(self.roots, np.int64)
        state = entry[order].T.astype(np.int64)  # as indexes
        count = np.zeros((len(roots), n), np.int32)
        open_ = np.searchsorted(-sizes, -np.arange(1, int(sizes.max(initial=0)) + 1), "right")
        for step, k in enumerate(open_.tolist()):
            c = codes[starts[:k] + step]
            s = self.step(state[:, :k], c)
            miss = np.flatnonzero(s == 0)
            if len(miss):
                lang, run = miss // k, miss % k
                root = roots[lang]
                again = self.step(root, c[run])
                lost = again == 0
                count[lang, run] += (state[lang, run] != root).astype(np.int32) + lost  # a symbol unknown at the root ends its phrase where it stands
                s.reshape(-1)[miss] = np.where(lost, root, again)
            state[:, :k] = s
        out, after = np.empty((n, len(roots)), np.int64), np.empty((n, len(roots)), np.int32)
        out[order], after[order] = count.T, state.T
        return out, after


@frees_memory
def _predict(batches: Iterator[pa.RecordBatch], shared, column: str = "text") -> Iterator[pa.RecordBatch]:
    model: Model = shared.value
    for batch in batches:
        for a, b, data, offsets in text_slices(batch, column, 2 << 20):
            n = b - a
            text = data.tobytes().decode("utf-8", "replace")
            lead = (data & 0xC0) != 0x80
            place = np.r_[0, np.cumsum(lead)][offsets]  # of each row in characters
            points = code_points(text)
            has = np.diff(np.r_[0, np.cumsum(is_letter(points))][place]) > 0
            lang, score = np.full(n, "und", object), np.zeros(n)
            if len(model.langs) and has.any():
                codes = model.codes(points)
                keep = np.r_[True, (codes[1:] != 0) | (codes[:-1] != 0)]
                keep[place[:-1][place[:-1] < len(codes)]] = True
                codes = codes[keep]
                place = np.r_[0, np.cumsum(keep)][place]
                sizes = np.diff(place)
                total = model.phrases(codes, place)
                cost = np.maximum(total, 1) * model.bits / np.maximum(sizes, 1)[:, None]
                best = cost.argmin(axis=1)
                share = (1 / cost) / (1 / cost).sum(axis=1, keepdims=True)
                lang[has] = np.array(model.langs, object)[best[has]]
                score[has] = share[np.arange(n), best][has]
            yield pa.RecordBatch.from_arrays([*(c.slice(a, n) for c in batch.columns), pa.array(lang.tolist(), pa.string()), pa.array(score)], names=[*batch.schema.names, "lang_pred", "lang_score"])


def labelled_samples(docs: DataFrame, learn: Column, *, sample_chars: int, text: str, lang: str, doc_id: str) -> dict[str, list[str]]:
    """For each language excerpts of the rows to learn from with the least hash of their id, up to ``sample_chars`` in all.

    Excerpts are as short as still fill the sample. A share of each language's rows by hash of the id that is expected to be enough is
    gathered; languages that it leaves short are read again with a larger share, at last with all rows.
    """
    known = docs.where(learn & F.col(lang).isNotNull() & F.col(doc_id).isNotNull() & (F.length(text) > 0))
    caps = [max(1, sample_chars // 100)]
    while caps[-1] < sample_chars:
        caps.append(min(sample_chars, 2 * caps[-1]))
    length = F.length(text)
    sums = [F.sum(F.least(length, F.lit(c))).alias(f"upto_{c}") for c in caps]
    fill: dict[str, tuple[int, int]] = {}  # the excerpts' size, and what all rows give by it
    for r in known.groupBy(F.col(lang).alias("lang")).agg(*sums).collect():
        fill[r.lang] = next(((c, r[f"upto_{c}"]) for c in caps if r[f"upto_{c}"] >= sample_chars), (caps[-1], r[f"upto_{caps[-1]}"]))
    spot = F.pmod(F.xxhash64(doc_id), F.lit(1 << 30))
    out: dict[str, list[str]] = {}
    short, more = list(fill), 4
    while short:
        share, size = F.lit(-1), F.lit(0)
        for name in short:
            cap, total = fill[name]
            share = F.when(F.col(lang) == name, int(min(1.0, more * sample_chars / total) * (1 << 30))).otherwise(share)
            size = F.when(F.col(lang) == name, cap).otherwise(size)
        start = F.pmod(F.xxhash64(spot), F.greatest(length - size, F.lit(0)) + 1).cast("int") + 1
        drawn = known.where(spot <= share).select(F.col(lang).alias("lang"), F.col(text).substr(start, size).alias("text"), spot.alias("spot"), F.col(doc_id).alias("id"))
        nth = F.row_number().over(Window.partitionBy("lang").orderBy("spot", "id", "text"))
        got = drawn.withColumn("nth", nth).where(F.col("nth") <= sample_chars).collect()  # each has a character at least, so that no more are used; rows that repeat an id share their spot
        used = dict.fromkeys(short, 0)
        out |= {name: [] for name in short}
        for r in sorted(got, key=lambda r: (r.spot, r.id, r.text)):
            if used[r.lang] < sample_chars:
                out[r.lang].append(r.text[: sample_chars - used[r.lang]])
                used[r.lang] += len(r.text)
        short = [name for name in short if used[name] < min(sample_chars, fill[name][1]) and more * sample_chars < fill[name][1]]
        more *= 16
    return {name: texts for name, texts in out.items() if texts}


def language_id(docs: DataFrame, learn: Column, *, sample_chars: int = SAMPLE_CHARS, max_bytes: int = MAX_BYTES, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with lang_pred and lang_score, learnt from the rows where ``learn`` holds."""
    spark = docs.sparkSession
    docs = docs.drop("lang_pred", "lang_score")
    model = Model(labelled_samples(docs, learn, sample_chars=sample_chars, text=text, lang=lang, doc_id=doc_id), max_bytes)
    shared = spark.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])
    text_batches(spark)
    return docs.mapInArrow(partial(_predict, shared=shared, column=text), schema)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    out = language_id(docs, ~held_out)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
