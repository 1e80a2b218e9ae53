"""Suffix-array dedup: remove every byte covered by a string of ``length`` bytes that also starts somewhere else.

Method: a sparse suffix array, sorted with hash-compared suffixes.

1. Anchors. Of every ``length`` consecutive bytes the k-gram with the least hash is an anchor (the leftmost of equal
   ones). Which one it is depends on those bytes only, so two equal strings of that length hold the same anchor at the
   same place. About one position in ``(length - k) / 2`` is an anchor; only these suffixes are sorted.
2. K-grams that occur once are dropped. For the others the text around the anchor is cut out, as far as a string of
   ``length`` bytes that holds the anchor can reach. Equal surroundings are kept once, with the list of their places.
3. Suffix sort. The suffixes of a k-gram's anchors are merge-sorted, once to the right and once to the left of the
   anchor. Two suffixes are compared by binary search for their common extension over prefix polynomial hashes, so a
   comparison takes O(log length) steps; all comparisons of a merge level run together. Next to a suffix stand those
   with the longest common extensions: the first of them whose extensions to both sides add up to ``length`` gives the
   farthest end of the repeat to that side. Anchors for which this isn't found among the nearest neighbours go through
   all offsets of their group by window hashes, which is exact too.
4. Collision verification. The order of neighbours and each repeat found are compared byte by byte; if any differs, the group is done again over
   the bytes themselves.

A text that occurs more than once is a repeat as a whole; one of its rows stands for all as a partner. Texts are told apart by 128 bits
of their SHA-256, for which, unlike MD5's, nobody can make two texts that agree.

K-grams with more than ``HOT`` places (a passage that a third of all documents share) aren't gathered in a task. Their surroundings are
cut into batches; each batch tells the hashes of its windows at every offset, each once, to tasks that own a range of hashes; these
answer which ones other batches have too, and the batch draws the ends of its repeats from the answers. What one passage's windows
cost is then one hash a batch, however many documents have it. Collision verification: the hashes on which ends rest are asked back from all batches
that have them, each shows its window's bytes once, and they are compared. If any two differ, the hot k-grams are sorted like all others.

Edge cases. Null text is empty. Texts shorter than ``length`` lose nothing. Repeated rows are copies and lose
everything if they are long enough. Null ids are allowed. An empty table gives no rows. In ``suffix_text`` a
character that a cut would split stays whole; ``suffix_bytes`` has exactly the bytes that remain.
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

from .common import BASE, U64, Stages, frees_memory, mix, partitions, powers, prefix_hashes, span_hashes, text_batches, text_slices

#: Neighbours that are tried on either side before a group's offsets are all tried.
NEIGHBOURS = 8
#: Places of one k-gram from which on its surroundings aren't gathered in one task.
HOT = 100_000

_ANCHORS = pa.schema([("th", pa.binary()), ("pos", pa.int32()), ("gram", pa.int64())])
_CONTEXTS = pa.schema([("gram", pa.int64()), ("left", pa.int32()), ("context", pa.binary()), ("ths", pa.binary()), ("places", pa.binary())])
_SPANS = pa.schema([("th", pa.binary()), ("a", pa.int32()), ("b", pa.int32())])


def gram_size(length: int) -> int:
    return max(1, length * 3 // 10)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place in the row and k-gram hash of each anchor."""
    k = gram_size(length)
    width = length - k + 1
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none
    prefix = prefix_hashes(data)
    at = np.arange(len(data) - k + 1)
    _, down = powers(len(prefix))
    grams = mix((prefix[k:] - prefix[:-k]) * down[: len(at)])
    packed = (grams & U64(0xFFFFFFFF00000000)) | at.astype(U64)
    full = -(-len(packed) // width) * width
    block = np.full(full, U64(0xFFFFFFFFFFFFFFFF))
    block[: len(packed)] = packed
    block = block.reshape(-1, width)
    ahead = np.minimum.accumulate(block, axis=1).reshape(-1)
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    n = len(data) - length + 1
    least = np.minimum(back[:n], ahead[width - 1 : width - 1 + n])
    del block, ahead, back, packed
    inside = np.zeros(n + 1, np.int32)  # windows that lie in one row
    firsts, lasts = offsets[:-1], offsets[1:] - length + 1
    ok = lasts > firsts
    np.add.at(inside, firsts[ok], 1)
    np.add.at(inside, lasts[ok], -1)
    chosen = (least[np.cumsum(inside[:n]) > 0] & U64(0xFFFFFFFF)).astype(np.int64)
    if not len(chosen):
        return none, none, none
    chosen = chosen[np.r_[True, chosen[1:] != chosen[:-1]]]
    rows = np.searchsorted(offsets, chosen, "right") - 1
    return rows, chosen - offsets[rows], grams[chosen].view(np.int64)


@frees_memory
def _anchors(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ths = batch.column(0)
        for a, b, data, offsets in text_slices(batch, "text", 1 << 19):
            rows, pos, grams = anchors(data, offsets, length)
            if len(rows):
                yield pa.RecordBatch.from_arrays([ths.slice(a, b - a).take(pa.array(rows)), pa.array(pos.astype(np.int32)), pa.array(grams)], schema=_ANCHORS)


@frees_memory
def _contexts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """th, text, places as array of (pos, gram): what stands around each anchor; equal ones of a batch once."""
    for batch in batches:
        for seen in _surroundings(batch, length, 4 << 20):
            yield _context_rows(seen)


def _surroundings(batch: pa.RecordBatch, length: int, most: int) -> Iterator[dict[tuple[int, int, bytes], list]]:
    """{(gram, bytes on the left, context): [texts' hashes, places]} of about ``most`` bytes."""
    reach = length - gram_size(length)
    seen: dict[tuple[int, int, bytes], list] = {}
    size = 0
    for th, text, places in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
        raw = text.as_buffer().to_pybytes()
        flat = places.values
        for pos, gram in zip(flat.field(0).to_pylist(), flat.field(1).to_pylist(), strict=True):
            a = max(0, pos - reach)
            key = gram, pos - a, raw[a : pos + length]
            item = seen.get(key)
            if item is None:
                seen[key] = item = [[], []]
                size += len(key[2])
            item[0].append(th)
            item[1].append(pos)
        if size > most:
            yield seen
            seen, size = {}, 0
    if seen:
        yield seen


def _context_rows(seen: dict) -> pa.RecordBatch:
    keys = list(seen)
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in keys], pa.int64()), pa.array([x[1] for x in keys], pa.int32()), pa.array([x[2] for x in keys], pa.binary()), pa.array([b"".join(v[0]) for v in seen.values()], pa.binary()), pa.array([np.array(v[1], np.int32).tobytes() for v in seen.values()], pa.binary())], schema=_CONTEXTS)


class Suffixes:
    """The surroundings of anchors in one buffer; group: equal for anchors of one k-gram, in order."""

    def __init__(self, contexts: list[bytes], left: np.ndarray, group: np.ndarray, least: int):
        self.raw = contexts
        self.data = np.frombuffer(b"".join(contexts), np.uint8)
        sizes = np.array([len(x) for x in contexts], np.int64)
        self.left, self.right, self.group, self.least = left.astype(np.int64), sizes - left, group, least
        self.base = np.cumsum(sizes) - sizes + self.left
        self.prefix = prefix_hashes(self.data)

    def common(self, a: np.ndarray, b: np.ndarray, way: int) -> np.ndarray:
        """Bytes that a and b have in common to the right (way 1) or left (-1) of the anchor, by binary search over hashes."""
        size = self.right if way > 0 else self.left
        hi = np.minimum(size[a], size[b])
        lo = np.minimum(self.least, hi) if way > 0 else np.zeros(len(a), np.int64)
        pa_, pb = self.base[a], self.base[b]
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            m = (lo[open_] + hi[open_] + 1) >> 1
            x, y = pa_[open_], pb[open_]
            if way > 0:
                same = span_hashes(self.prefix, x, x + m) == span_hashes(self.prefix, y, y + m)
            else:
                same = span_hashes(self.prefix, x - m, x) == span_hashes(self.prefix, y - m, y)
            lo[open_] = np.where(same, m, lo[open_])
            hi[open_] = np.where(same, hi[open_], m - 1)

    def less(self, a: np.ndarray, b: np.ndarray, way: int) -> np.ndarray:
        """Is suffix a before b? Of two with the same bytes the shorter, then the earlier, comes first."""
        n = self.common(a, b, way)
        size = self.right if way > 0 else self.left
        end_a, end_b = n == size[a], n == size[b]
        step = n if way > 0 else -n - 1
        top = len(self.data) - 1
        byte_a = self.data[np.clip(self.base[a] + step, 0, top)].astype(np.int64)
        byte_b = self.data[np.clip(self.base[b] + step, 0, top)].astype(np.int64)
        byte_a[end_a], byte_b[end_b] = -1, -1
        return (byte_a < byte_b) | ((byte_a == byte_b) & (a < b))

    def merge_sorted(self, way: int) -> np.ndarray:
        """The suffixes of each group in order, by merge sort from below; the merges of a level run side by side."""
        n = len(self.group)
        order = np.arange(n)
        first = np.searchsorted(self.group, self.group, "left")
        size = np.searchsorted(self.group, self.group, "right") - first
        width = 1
        while n and width < size.max():
            slot = np.flatnonzero(size > width)
            rank = slot - first[slot]
            run = rank // width
            other = (run ^ 1) * width  # the run to merge with
            lo = np.minimum(other, size[slot])
            hi = np.minimum(other + width, size[slot])
            lo0 = lo.copy()
            mine = order[slot]
            while True:  # how many of the other run come before
                go = np.flatnonzero(lo < hi)
                if not len(go):
                    break
                m = (lo[go] + hi[go]) >> 1
                before = self.less(order[first[slot[go]] + m], mine[go], way)
                lo[go] = np.where(before, m + 1, lo[go])
                hi[go] = np.where(before, hi[go], m)
            place = first[slot] + (run & ~1) * width + (rank - run * width) + (lo - lo0)
            order[place] = mine
            width *= 2
        return order


def _farthest(s: Suffixes, length: int, way: int, best: np.ndarray, partner: np.ndarray, wrong: np.ndarray) -> np.ndarray:
    """For each suffix the longest extension to one side with a partner whose extensions add up to length. Returns those not settled; marks in ``wrong`` those whose place in the order the bytes don't confirm."""
    order = s.merge_sorted(way)
    n = len(order)
    next_ = np.zeros(n, np.int64)
    if n > 1:
        same = np.flatnonzero(s.group[order[1:]] == s.group[order[:-1]])
        next_[same] = s.common(order[same], order[same + 1], way)
    wrong |= np.bincount(order, minlength=n) != 1
    # collision verification of the order: neighbours share what is said and then differ the right way
    for i in np.flatnonzero(s.group[order[1:]] == s.group[order[:-1]]).tolist():
        a, b, m = int(order[i]), int(order[i + 1]), int(next_[i])
        x, y, at, to = s.raw[a], s.raw[b], int(s.left[a]), int(s.left[b])
        if way > 0:
            right = x[at : at + m] == y[to : to + m] and x[at + m : at + m + 1] <= y[to + m : to + m + 1]
        else:
            right = x[at - m : at] == y[to - m : to] and x[max(0, at - m - 1) : at - m] <= y[max(0, to - m - 1) : to - m]
        wrong[[a, b]] |= not right
    unsettled = np.zeros(n, bool)
    rest = s.left if way > 0 else s.right
    for side in (1, -1):
        slot = np.arange(n)
        reach = np.full(n, 1 << 30)
        for step in range(1, NEIGHBOURS + 2):
            at = slot + side * step
            link = at - 1 if side > 0 else at
            ok = (at >= 0) & (at < n)
            slot, reach, at, link = slot[ok], reach[ok], at[ok], link[ok]
            reach = np.minimum(reach, next_[link])
            ok = (s.group[order[slot]] == s.group[order[at]]) & (reach + rest[order[slot]] >= length) & (reach > best[order[slot]])
            slot, reach, at = slot[ok], reach[ok], at[ok]
            if not len(slot):
                break
            if step > NEIGHBOURS:
                unsettled[order[slot]] = True
                break
            mine, other = order[slot], order[at]
            valid = s.common(mine, other, -way) + reach >= length
            best[mine[valid]] = reach[valid]
            partner[mine[valid]] = other[valid]
            slot, reach = slot[~valid], reach[~valid]
    return unsettled


def _all_offsets(s: Suffixes, length: int, members: np.ndarray, exact: bool, wrong: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same by the window hashes (exact: the bytes) of all offsets of the groups in question; equal hashes of unequal bytes are marked in ``wrong``."""
    window = lambda i, o: s.raw[i][int(s.left[i]) - o : int(s.left[i]) - o + length]
    left, right = np.zeros(len(members), np.int64), np.zeros(len(members), np.int64)
    for o in range(length - s.least + 1):
        has = np.flatnonzero((s.left[members] >= o) & (s.right[members] >= length - o))
        who = members[has]
        if len(who) < 2:
            continue
        if exact:
            names: dict = {}
            h = np.array([names.setdefault((int(s.group[i]), window(i, o)), len(names)) for i in who])
        else:
            h = mix(span_hashes(s.prefix, s.base[who] - o, s.base[who] - o + length) + s.group[who].astype(U64) * U64(BASE))
        _, first, inverse, counts = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        same = np.flatnonzero(counts[inverse] > 1)
        if not exact:
            for i in same.tolist():
                a, b = int(who[i]), int(who[first[inverse[i]]])
                if a != b and (s.group[a] != s.group[b] or window(a, o) != window(b, o)):
                    wrong[[a, b]] = True
        twice = has[same]
        left[twice] = np.maximum(left[twice], o)
        right[twice] = np.maximum(right[twice], length - o)
    return left, right


def repeats(contexts: list[bytes], left: np.ndarray, group: np.ndarray, times: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes to the left and right of each anchor that repeats cover; 0 and 0 without a repeat. group ascends; contexts of a group differ."""
    s = Suffixes(contexts, left, group, gram_size(length))
    n = len(contexts)
    best_r, best_l = np.zeros(n, np.int64), np.zeros(n, np.int64)
    copy = (times > 1) & (s.left + s.right >= length)
    best_r[copy], best_l[copy] = s.right[copy], s.left[copy]
    by_r, by_l = np.full(n, -1), np.full(n, -1)
    wrong = np.zeros(n, bool)
    late = _farthest(s, length, 1, best_r, by_r, wrong)
    late |= _farthest(s, length, -1, best_l, by_l, wrong)
    for i in np.flatnonzero(by_r >= 0).tolist():  # collision verification of what is removed
        j, r = int(by_r[i]), int(best_r[i])
        li, lj, need = int(s.left[i]), int(s.left[j]), max(0, length - r)
        wrong[i] |= s.raw[i][li - need : li + r] != s.raw[j][lj - need : lj + r]
    for i in np.flatnonzero(by_l >= 0).tolist():
        j, m = int(by_l[i]), int(best_l[i])
        li, lj, need = int(s.left[i]), int(s.left[j]), max(0, length - m)
        wrong[i] |= s.raw[i][li - m : li + need] != s.raw[j][lj - m : lj + need]
    for which, exact in ((late, False), (wrong, True)):
        if which.any():
            members = np.flatnonzero(np.isin(s.group, s.group[which]))
            more_l, more_r = _all_offsets(s, length, members, exact, wrong)
            keep = copy[members]
            more_l, more_r = np.where(keep, s.left[members], more_l), np.where(keep, s.right[members], more_r)
            best_l[members] = more_l if exact else np.maximum(best_l[members], more_l)
            best_r[members] = more_r if exact else np.maximum(best_r[members], more_r)
    found = (best_l > 0) | (best_r > 0)
    return np.where(found, best_l, 0), np.where(found, best_r, 0)


@frees_memory
def _sorted_repeats(batches: Iterator[pa.RecordBatch], length: int, chunk: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    held: dict[int, dict[tuple[int, bytes], list]] = {}
    for batch in batches:
        for gram, left, context, ths, places in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            item = held.setdefault(gram, {}).setdefault((left, context), [[], []])
            item[0].append(ths)
            item[1].append(places)
    todo, size = [], 0
    while held or todo:
        if held:
            _, group = held.popitem()
            todo.append(group)
            size += sum(len(c) for _, c in group)
        if todo and (size > chunk or not held):
            contexts = [c for g in todo for _, c in g]
            left = np.array([x for g in todo for x, _ in g], np.int64)
            group_of = np.repeat(np.arange(len(todo)), [len(g) for g in todo])
            values = [v for g in todo for v in g.values()]
            times = np.array([sum(len(p) for p in v[1]) // 4 for v in values])
            to_left, to_right = repeats(contexts, left, group_of, times, length)
            ths, a, b = [], [], []
            for i in np.flatnonzero(to_right > 0).tolist():
                pos = np.frombuffer(b"".join(values[i][1]), np.int32)
                raw = b"".join(values[i][0])
                ths += [raw[j : j + 16] for j in range(0, len(raw), 16)]
                a.append(pos - to_left[i])
                b.append(pos + to_right[i])
            if ths:
                yield pa.RecordBatch.from_arrays([pa.array(ths, pa.binary()), pa.array(np.concatenate(a).astype(np.int32)), pa.array(np.concatenate(b).astype(np.int32))], schema=_SPANS)
            todo, size = [], 0


_BATCH = pa.schema([("batch", pa.int64()), ("grams", pa.binary()), ("lefts", pa.binary()), ("sizes", pa.binary()), ("data", pa.binary()), ("owners", pa.binary()), ("ths", pa.binary()), ("places", pa.binary())])
_BATCH_DDL = "batch long, grams binary, lefts binary, sizes binary, data binary, owners binary, ths binary, places binary"
_HASHES = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), ("hashes", pa.binary())])


@frees_memory
def _hot_batches(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Surroundings of hot anchors in rows of about 1 MB, which are the batches from here on."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for seen in _surroundings(batch, length, 1 << 20):
            values = list(seen.values())
            owners = np.repeat(np.arange(len(values), dtype=np.int32), [len(v[1]) for v in values])
            numbers = lambda x, kind: np.array(list(x), kind).tobytes()
            columns = [number, numbers((k[0] for k in seen), np.int64), numbers((k[1] for k in seen), np.int32), numbers((len(k[2]) for k in seen), np.int32), b"".join(k[2] for k in seen), owners.tobytes(), b"".join(t for v in values for t in v[0]), numbers((p for v in values for p in v[1]), np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(columns, _BATCH, strict=True)], schema=_BATCH)
            number += 1


def _windows(row: dict, length: int, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each offset of a window before its anchor: which surroundings have it, and hashes of gram, offset and window (their last ``bits``)."""
    mask = U64((1 << bits) - 1)
    grams, lefts = np.frombuffer(row["grams"], np.int64), np.frombuffer(row["lefts"], np.int32).astype(np.int64)
    sizes = np.frombuffer(row["sizes"], np.int32).astype(np.int64)
    base = np.cumsum(sizes) - sizes + lefts
    prefix = prefix_hashes(np.frombuffer(row["data"], np.uint8))
    salt = mix(grams.view(U64).copy())
    for o in range(length - gram_size(length) + 1):
        has = np.flatnonzero((lefts >= o) & (sizes - lefts >= length - o))
        if len(has):
            yield o, has, mix(span_hashes(prefix, base[has] - o, base[has] - o + length) + salt[has] + U64(o + 1) * U64(BASE // 3)) & mask


def _by_bucket(hashes: np.ndarray, buckets: int, batch: int) -> pa.RecordBatch:
    """Sorted hashes of a batch as a row for each range."""
    part = ((hashes >> U64(32)) * U64(buckets)) >> U64(32)
    cuts = np.searchsorted(part, np.arange(buckets + 1))
    kept = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
    return pa.RecordBatch.from_arrays([pa.array(kept, pa.int32()), pa.array([batch] * len(kept), pa.int64()), pa.array([hashes[cuts[b] : cuts[b + 1]].tobytes() for b in kept], pa.binary())], schema=_HASHES)


@frees_memory
def _hot_windows(batches: Iterator[pa.RecordBatch], length: int, buckets: int, bits: int) -> Iterator[pa.RecordBatch]:
    """(bucket, batch, hashes): all window hashes of a batch, each once, dealt by their range."""
    for batch in batches:
        for row in batch.to_pylist():
            if hashes := [h for _, _, h in _windows(row, length, bits)]:
                yield _by_bucket(np.unique(np.concatenate(hashes)), buckets, row["batch"])


@frees_memory
def _hot_matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, batch, hashes): of each batch those that another batch has too."""
    held: dict[int, list[tuple[int, np.ndarray]]] = {}
    for batch in batches:
        for bucket, number, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            held.setdefault(bucket, []).append((number, np.frombuffer(raw, U64)))
    for bucket in list(held):
        items = held.pop(bucket)
        values, counts = np.unique(np.concatenate([h for _, h in items]), return_counts=True)
        values = values[counts > 1]
        for number, h in items:
            at = np.minimum(np.searchsorted(values, h), max(0, len(values) - 1))
            both = h[values[at] == h] if len(values) else h[:0]
            if len(both):
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([number], pa.int64()), pa.array([both.tobytes()], pa.binary())], schema=_HASHES)


def _hot_ends(row: dict, length: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What repeats cover to the left and right of each anchor of a batch, by the hashes that others have too; and the hashes that this rests on."""
    known = np.unique(np.frombuffer(b"".join(row["others"] or []), U64))
    owners = np.frombuffer(row["owners"], np.int32)
    n = len(row["lefts"]) // 4
    twice = np.bincount(owners, minlength=n) > 1
    left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    first, last = np.zeros(n, U64), np.zeros(n, U64)
    for o, has, h in _windows(row, length, bits):
        _, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
        hit = twice[has] | (counts[inverse] > 1)
        if len(known):
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit |= known[at] == h
        mine, rest = has[hit], h[hit]
        new = right[mine] == 0  # offsets rise: the first one reaches farthest to the right, the last one to the left
        right[mine[new]], last[mine[new]] = length - o, rest[new]
        left[mine], first[mine] = o, rest
    rests = (right > 0) & ~twice
    return left, right, np.unique(np.r_[first[rests], last[rests]])


@frees_memory
def _hot_spans(batches: Iterator[pa.RecordBatch], length: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Batches with the hashes that others have too: what repeats cover around each place."""
    for batch in batches:
        for row in batch.to_pylist():
            left, right, _ = _hot_ends(row, length, bits)
            owners = np.frombuffer(row["owners"], np.int32)
            found = np.flatnonzero(right[owners] > 0)
            if len(found):
                pos, ths = np.frombuffer(row["places"], np.int32).astype(np.int64)[found], row["ths"]
                yield pa.RecordBatch.from_arrays([pa.array([ths[16 * i : 16 * i + 16] for i in found.tolist()], pa.binary()), pa.array((pos - left[owners[found]]).astype(np.int32)), pa.array((pos + right[owners[found]]).astype(np.int32))], schema=_SPANS)


@frees_memory
def _hot_evidence(batches: Iterator[pa.RecordBatch], length: int, buckets: int, bits: int) -> Iterator[pa.RecordBatch]:
    """(bucket, batch, hashes): those on which the ends of a batch's repeats rest; batch -1."""
    for batch in batches:
        for row in batch.to_pylist():
            yield _by_bucket(_hot_ends(row, length, bits)[2], buckets, -1)


@frees_memory
def _hot_asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, batch, hashes): of what each batch has, that on which some end rests."""
    held: dict[int, list[tuple[int, np.ndarray]]] = {}
    for batch in batches:
        for bucket, number, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            held.setdefault(bucket, []).append((number, np.frombuffer(raw, U64)))
    for bucket in list(held):
        items = held.pop(bucket)
        asked = np.unique(np.concatenate([np.zeros(0, U64), *(h for number, h in items if number < 0)]))
        for number, h in items:
            both = h[np.isin(h, asked)]
            if number >= 0 and len(both):
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([number], pa.int64()), pa.array([both.tobytes()], pa.binary())], schema=_HASHES)


@frees_memory
def _hot_shown(batches: Iterator[pa.RecordBatch], length: int, bits: int) -> Iterator[pa.RecordBatch]:
    """(hash, window): the bytes behind the hashes that were asked for; all different ones."""
    for batch in batches:
        for row in batch.to_pylist():
            asked = np.unique(np.frombuffer(b"".join(row["others"] or []), U64))
            lefts, sizes = np.frombuffer(row["lefts"], np.int32).astype(np.int64), np.frombuffer(row["sizes"], np.int32).astype(np.int64)
            base, data = np.cumsum(sizes) - sizes + lefts, row["data"]
            seen: set[tuple[int, bytes]] = set()
            for o, has, h in _windows(row, length, bits):
                hit = np.flatnonzero(np.isin(h, asked))
                for i, x in zip(has[hit].tolist(), h[hit].tolist(), strict=True):
                    at = int(base[i]) - o
                    seen.add((x, data[at : at + length]))
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(np.array([x for x, _ in seen], U64).view(np.int64)), pa.array([w for _, w in seen], pa.binary())], names=["hash", "window"])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for a, b in spans:
        parts.append(raw[at:a])
        at = b
    return b"".join([*parts, raw[at:]])


def _whole_characters(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out = []
    for a, b in spans:
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


@frees_memory
def _cut_out(batches: Iterator[pa.RecordBatch], added: list[str], length: int, digest: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols = {c: batch.column(batch.schema.get_field_index(c)) for c in ("suffix__text", "suffix__copies", "suffix__a", "suffix__b")}
        out: dict[str, list] = {"n": [], "spans": [], "bytes": [], "text": []}
        for text, copies, a, b in zip(cols["suffix__text"], cols["suffix__copies"].to_pylist(), cols["suffix__a"].to_pylist(), cols["suffix__b"].to_pylist(), strict=True):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            spans = [(0, len(raw))] if copies > 1 and len(raw) >= length else merged(list(zip(a or (), b or (), strict=True)))
            kept = _without(raw, spans)
            out["n"].append(len(raw))
            out["spans"].append([{"start": x, "end": y} for x, y in spans])
            out["bytes"].append(hashlib.sha256(kept).hexdigest() if digest else kept)
            out["text"].append(_without(raw, _whole_characters(raw, spans)).decode("utf-8", "replace"))
        arrays = [batch.column(i) for i in range(batch.num_columns - 4)]
        names = batch.schema.names[:-4]
        arrays += [pa.array(out["n"], pa.int64()), pa.array(out["spans"], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(out["bytes"], pa.string() if digest else pa.binary()), pa.array(out["text"], pa.string())]
        yield pa.RecordBatch.from_arrays(arrays, names=[*names, *added])


def suffix_dedup(docs: DataFrame, *, length: int = 400, text: str = "text", doc_id: str = "doc_id", digest: bool = False, hot: int = HOT, window_bits: int = 64) -> DataFrame:
    """``docs`` with suffix_n_bytes, suffix_spans (what goes), suffix_bytes and suffix_text (what stays).

    window_bits: of the hashes that hot k-grams are told apart by; fewer cost time, not correctness.
    digest: instead of suffix_bytes only suffix_sha256, the SHA-256 of the bytes that stay.
    """
    spark = docs.sparkSession
    stages = Stages(spark, "suffix")
    text_batches(spark)
    docs = docs.drop("suffix_n_bytes", "suffix_spans", "suffix_bytes", "suffix_text", "suffix_sha256")
    whole = F.coalesce(F.col(text), F.lit(""))
    raw = docs.withColumn("suffix__th", F.unhex(F.substring(F.sha2(whole.cast("binary"), 256), 1, 32)))
    slim = raw.select(F.col("suffix__th").alias("th"), whole.alias("text"), F.struct(F.col(doc_id).isNull().alias("n"), F.col(doc_id).alias("id")).alias("id"))
    copies = stages.put(slim.groupBy("th").agg(F.count("*").alias("copies"), F.min("id").alias("first")).where("copies > 1"), "copies")
    places = stages.put(slim.where(F.octet_length("text") >= length).select("th", "text").mapInArrow(partial(_anchors, length=length), "th binary, pos int, gram long"), "anchors")
    # grams that only copies share count as shared too; that costs a little and changes nothing
    often = stages.put(places.groupBy("gram").agg(F.count("*").alias("c")).where("c > 1"), "often")
    # one row stands for its copies
    first = slim.join(copies.select("th", "first"), "th", "left").where(F.col("first").isNull() | (F.col("first") == F.col("id")))

    def around(grams: DataFrame) -> DataFrame:
        shared = places.join(grams, "gram").groupBy("th").agg(F.collect_set(F.struct("pos", "gram")).alias("places"))
        return first.join(shared, "th").select("th", "text", "places")

    def sorted_(grams: DataFrame) -> DataFrame:
        contexts = around(grams).mapInArrow(partial(_contexts, length=length), "gram long, left int, context binary, ths binary, places binary")
        return contexts.repartition(4 * partitions(spark), "gram").mapInArrow(partial(_sorted_repeats, length=length), "th binary, a int, b int")

    found = sorted_(often.where(F.col("c") <= hot))
    if often.where(F.col("c") > hot).limit(1).count():
        buckets, ddl, bits = 4 * partitions(spark), "bucket int, batch long, hashes binary", window_bits
        gathered = lambda rows: rows.groupBy("batch").agg(F.collect_list("hashes").alias("others"))
        hot_rows = stages.put(around(often.where(F.col("c") > hot)).mapInArrow(partial(_hot_batches, length=length), _BATCH_DDL), "hot")
        told = hot_rows.mapInArrow(partial(_hot_windows, length=length, buckets=buckets, bits=bits), ddl)
        answers = stages.put(gathered(told.repartition(buckets, "bucket").mapInArrow(_hot_matches, ddl)), "answers")
        answered = hot_rows.join(answers, "batch", "left")
        evidence = answered.mapInArrow(partial(_hot_evidence, length=length, buckets=buckets, bits=bits), ddl)
        asked = gathered(told.union(evidence).repartition(buckets, "bucket").mapInArrow(_hot_asked, ddl))
        shown = hot_rows.join(asked, "batch").mapInArrow(partial(_hot_shown, length=length, bits=bits), "hash long, window binary")
        if shown.groupBy("hash").agg(F.min("window").alias("a"), F.max("window").alias("b")).where("a <> b").limit(1).count():
            found = sorted_(often)
        else:
            found = found.union(answered.mapInArrow(partial(_hot_spans, length=length, bits=bits), "th binary, a int, b int"))
    spans = stages.put(found.groupBy("th").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b")), "spans")
    stages.drop(places)
    spans = spans.join(copies, "th", "left_anti")  # copies go as a whole
    joined = raw.join(copies.select(F.col("th").alias("suffix__th"), F.col("copies").alias("suffix__n")), "suffix__th", "left").join(spans.select(F.col("th").alias("suffix__th"), F.col("a").alias("suffix__a"), F.col("b").alias("suffix__b")), "suffix__th", "left")
    base = docs.columns
    ready = joined.select(*base, whole.alias("suffix__text"), F.coalesce("suffix__n", F.lit(1)).alias("suffix__copies"), "suffix__a", "suffix__b")
    spans_type = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    added = {"suffix_n_bytes": T.LongType(), "suffix_spans": spans_type}
    added |= {"suffix_sha256": T.StringType()} if digest else {"suffix_bytes": T.BinaryType()}
    added["suffix_text"] = T.StringType()
    schema = T.StructType([*docs.schema.fields, *(T.StructField(k, v) for k, v in added.items())])
    return ready.mapInArrow(partial(_cut_out, added=list(added), digest=digest, length=length), schema)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = suffix_dedup(docs, length=400, digest=True)
    removed = F.aggregate("suffix_spans", F.lit(0).cast("long"), lambda total, x: total + (x["end"] - x["start"]))
    return out.select("doc_id", F.col("suffix_n_bytes").alias("n_bytes"), removed.alias("n_removed"), F.size("suffix_spans").cast("long").alias("n_spans"), F.col("suffix_sha256").alias("kept_sha256"), F.col("suffix_text").alias("text"))


#: All windows of 400 bytes by their MD5, places side by side as runs; characters that a cut would split stay whole in ``text``.
OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b, hex(encode(coalesce(text, ''))) AS hx FROM documents),
w AS (SELECT rid, i, md5(array_slice(b, i + 1, i + 400)) AS h FROM (SELECT rid, b, unnest(range(octet_length(b) - 399)) AS i FROM d WHERE octet_length(b) >= 400)),
hit AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY h) AS c FROM w) WHERE c > 1),
runs AS (
  SELECT rid, min(i) AS a, max(i) + 400 AS e
  FROM (SELECT rid, i, sum(fresh) OVER (PARTITION BY rid ORDER BY i) AS g FROM (SELECT rid, i, CAST(coalesce(i > lag(i) OVER (PARTITION BY rid ORDER BY i) + 400, true) AS INT) AS fresh FROM hit)) GROUP BY rid, g
),
x AS (SELECT runs.rid, a, e, hx FROM runs JOIN d USING (rid)),
whole AS (
  SELECT rid, a + CASE WHEN substr(hx, 2 * a + 1, 2) NOT BETWEEN '80' AND 'BF' THEN 0 WHEN substr(hx, 2 * a + 3, 2) NOT BETWEEN '80' AND 'BF' THEN 1 WHEN substr(hx, 2 * a + 5, 2) NOT BETWEEN '80' AND 'BF' THEN 2 ELSE 3 END AS a,
         e - CASE WHEN substr(hx, 2 * e + 1, 2) NOT BETWEEN '80' AND 'BF' THEN 0 WHEN substr(hx, 2 * e - 1, 2) NOT BETWEEN '80' AND 'BF' THEN 1 WHEN substr(hx, 2 * e - 3, 2) NOT BETWEEN '80' AND 'BF' THEN 2 ELSE 3 END AS e FROM x
),
cut AS (SELECT rid, 'bytes' AS kind, a, e FROM runs UNION ALL SELECT rid, 'text', a, e FROM whole),
kept AS (
  SELECT rid, kind, string_agg(part, '' ORDER BY a) AS hx FROM (
    SELECT cut.rid, kind, a, substr(hx, 2 * coalesce(lag(e) OVER p, 0) + 1, 2 * (a - coalesce(lag(e) OVER p, 0))) AS part FROM cut JOIN d USING (rid) WINDOW p AS (PARTITION BY cut.rid, kind ORDER BY a)
    UNION ALL SELECT cut.rid, kind, max(e), substr(any_value(hx), 2 * max(e) + 1) FROM cut JOIN d USING (rid) GROUP BY cut.rid, kind
  ) GROUP BY rid, kind
)
SELECT d.doc_id, octet_length(d.b) AS n_bytes, CAST(coalesce(s.removed, 0) AS BIGINT) AS n_removed, coalesce(s.n, 0) AS n_spans, sha256(unhex(coalesce(k.hx, d.hx))) AS kept_sha256, decode(unhex(coalesce(t.hx, d.hx))) AS text
FROM d LEFT JOIN (SELECT rid, sum(e - a) AS removed, count(*) AS n FROM runs GROUP BY rid) s USING (rid)
LEFT JOIN (SELECT rid, hx FROM kept WHERE kind = 'bytes') k USING (rid) LEFT JOIN (SELECT rid, hx FROM kept WHERE kind = 'text') t USING (rid)
"""
