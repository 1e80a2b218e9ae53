"""SentencePiece encoding with Gumbel top-k sampling without replacement, and decoding.

Method: perturbed A-star search over the segmentation lattice. A text's segmentations into pieces are the paths of its lattice; a path's
probability is proportional to the exponentials of its pieces' weights. With an independent Gumbel value added to each path's log-probability, the
k greatest paths are k distinct segmentations sampled without replacement.

The queue. A node is a beginning of a path and stands for all paths that go on from it. Its location is their total log-probability (backward
sums over the lattice make it the sum of the steps' log-probabilities), its priority the greatest perturbed value among them. Taking the best node
off the queue opens it down to a leaf: the child that holds the greatest value is drawn by the children's
probabilities and has the node's own value, so it would be the next to be taken, and so on to the text's end; each of its siblings
gets a Gumbel value at its own location, bound from above by the node's, and joins the queue. That leaf is the next sample. Samples differ because
siblings share no path. The search ends with k leaves or an empty queue. The greatest priority left is the threshold kappa, and a sample's
inclusion score is the probability that its value exceeds kappa, 1 - exp(-exp(log_prob - kappa)), given as its logarithm.

The bound of the queue. No more nodes are kept than samples still to come, and one for kappa. A Gumbel value drawn from a 53-bit number is less
than ``NOISE`` above its location, and locations only fall along a path: siblings from that step on where
location + NOISE is below all that the queue keeps can't enter it, and aren't drawn. That is exact, and all texts of a batch are
searched side by side.

Lattices are built once for each different word of a batch (no piece goes over the mark that starts a word); pieces are found by a table of
their beginnings, byte by byte. Characters without a piece are spelled in byte pieces. Random numbers are a hash of seed, row key, sample and
place, so a row's samples don't depend on batches, partitions or retries.

Weights. A unigram model's scores are log-probabilities. A BPE model's are ranks; a piece of rank r weighs -log(1 + r).

Edge cases. Null and empty texts have one segmentation, without pieces, of probability one. Fewer than k segmentations: all of them, each once, with log
inclusion 0. Null row keys count as 0; repeated rows give the same samples. An empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BASE, U64, IntTable, frees_memory, mix, runs, text_batches, word_kinds

DEFAULT_MODEL = "piece_bpe_32k.model"
MARK = "▁".encode()
#: What a Gumbel value drawn by ``uniform`` exceeds its location by at most: -log(-log(1 - 2**-54)) is 37.43.
NOISE = 37.5
#: Sums over a lattice are carried per byte times SCALE, and put back to about one every RESCALE bytes.
SCALE, RESCALE = 20.0, 16


def uniform(seed: int, key: np.ndarray, stream: int, place: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1), a hash of all arguments."""
    x = key * U64(BASE)
    x += place * U64(0xD1B54A32D192ED03)
    x += U64((seed * 0x9E3779B1 + stream * 0x85EBCA77C2B2AE63) % (1 << 64))
    x = mix(x)
    x >>= U64(11)
    out = x.astype(float)
    out += 0.5
    out *= 2.0**-53
    return out


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece

        self.processor = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.vocab_size()
        scores = np.array([sp.get_score(i) for i in range(size)])
        plain = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        ranked = bool((scores[plain] == np.round(scores[plain])).all())
        self.weights = -np.log1p(np.abs(scores)) if ranked else scores.copy()
        self.byte_ids = np.full(256, sp.unk_id(), np.int32)
        self.bytes: list[bytes] = [b""] * size
        for i in range(size):
            if sp.is_byte(i):
                value = int(sp.id_to_piece(i)[3:5], 16)
                self.byte_ids[value], self.bytes[i] = i, bytes([value])
            elif not sp.is_control(i) and not sp.is_unknown(i):
                self.bytes[i] = sp.id_to_piece(i).encode()
        self.byte_weight = float(self.weights[plain].min()) - 10
        self.pool = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.sizes = np.array([len(x) for x in self.bytes], np.int64)
        self.at = np.cumsum(self.sizes) - self.sizes
        self.factor = np.exp(self.weights + self.sizes * math.log(SCALE))
        self.byte_factor = math.exp(self.byte_weight) * SCALE
        # states: all beginnings of pieces; 0 is the empty one, -1 none
        states: dict[bytes, int] = {b"": 0}
        for i in plain:
            raw = self.bytes[i]
            for n in range(1, len(raw) + 1):
                states.setdefault(raw[:n], len(states))
        self.piece = np.full(len(states) + 1, -1, np.int32)
        self.piece[[states[self.bytes[i]] for i in plain]] = plain
        self.goes_on = np.zeros(len(states) + 1, bool)
        names = list(states)[1:]
        parents = np.array([states[x[:-1]] for x in names], np.int64)
        self.goes_on[parents] = True
        self.table = IntTable((parents << 8) | np.array([x[-1] for x in names], np.int64), np.arange(1, len(states), dtype=np.int32))
        every = np.arange(256)
        self.one = self.next(np.zeros(256, np.int32), every.astype(np.uint8))
        self.two = np.full((256, 256), -1, np.int32)
        for b in np.flatnonzero(self.one >= 0).tolist():
            self.two[b] = self.next(np.full(256, self.one[b]), every.astype(np.uint8))

    def next(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The state after one more byte; -1 where no piece goes on so."""
        return self.table.get((state.astype(np.int64) << 8) | byte)


class Lattice:
    """Words side by side, longest first. Places are sorted by their distance to the word's end, then by word: ``off[d] + word`` has ``d`` bytes
    to go. For each place its edges (``first``), for each edge the place it leads to, its piece, its probability and the sum of probabilities up to it."""

    def __init__(self, vocabulary: Vocabulary, data: np.ndarray, ends: np.ndarray, sizes: np.ndarray):
        words, longest = len(sizes), int(sizes[0]) if len(sizes) else 0
        many = np.searchsorted(-sizes, -np.arange(longest + 1), "right").astype(np.int32)  # words with d bytes or more
        self.off = off = np.r_[0, np.cumsum(many)].astype(np.int32)
        total = int(off[-1])
        self.to_go = to_go = np.repeat(np.arange(longest + 1, dtype=np.int32), many)
        byte = np.zeros(total, np.uint8)
        place = np.arange(words, total, dtype=np.int32)
        byte[words:] = data[ends[place - off[to_go[words:]]] - to_go[words:]]
        lead = byte[words:]
        at = place[(lead & 0xC0) != 0x80]
        self.edges = edges = np.zeros(total, np.int32)
        spelled = np.zeros(total, bool)
        spelled[at] = True
        char = np.where(byte < 0xC0, 1, np.where(byte < 0xE0, 2, np.where(byte < 0xF0, 3, 4))).astype(np.int8)
        src, dst, piece, rank = [], [], [], []
        rem = to_go[at] - 1
        to = at - many[rem]
        state = vocabulary.one[byte[at]]
        size = 1
        while True:
            found = vocabulary.piece[state]
            whole = np.flatnonzero(found >= 0)
            here = at[whole]
            src.append(here)
            dst.append(to[whole])
            piece.append(found[whole])
            rank.append(edges[here])
            edges[here] += 1
            if size <= 4:
                spelled[here[char[here] == size]] = False
            on = np.flatnonzero(vocabulary.goes_on[state] & (rem > 0))
            if not len(on):
                break
            at, to, rem, state = at[on], to[on], rem[on] - 1, state[on]
            nxt = byte[to]
            state = vocabulary.two[byte[at], nxt] if size == 1 else vocabulary.next(state, nxt)
            to = to - many[rem]
            size += 1
        odd = np.flatnonzero(spelled).astype(np.int32)  # characters without a piece, byte by byte
        if len(odd):
            within = np.minimum(char[odd], to_go[odd])
            step = runs(within).astype(np.int32)
            left = np.repeat(to_go[odd], within) - step
            odd = off[left] + np.repeat(odd - off[to_go[odd]], within)
            src.append(odd)
            dst.append(off[left - 1] + odd - off[left])
            piece.append(vocabulary.byte_ids[byte[odd]])
            rank.append(edges[odd])
            edges[odd] += 1
        self.first = first = np.r_[0, np.cumsum(edges, dtype=np.int64)]
        src = np.concatenate(src)
        slot = first[src] + np.concatenate(rank)
        self.dst, self.piece = np.empty(len(src), np.int32), np.empty(len(src), np.int32)
        self.dst[slot], self.piece[slot] = np.concatenate(dst), np.concatenate(piece)
        p = vocabulary.factor[self.piece]
        if len(odd):
            p[slot[len(slot) - len(odd) :]] = vocabulary.byte_factor
        # backward sums, by the distance to the word's end; p becomes factor x sum behind it, then its share
        behind = np.zeros(total)
        behind[:words] = 1
        starts = first[off]
        for d in range(1, longest + 1):
            lo, hi = int(starts[d]), int(starts[d + 1])
            if lo == hi:
                continue
            value = p[lo:hi]
            value *= behind[self.dst[lo:hi]]
            a, b = int(off[d]), int(off[d + 1])
            own = edges[a:b]
            heads = first[a:b] - lo
            if own.all():
                behind[a:b] = np.add.reduceat(value, heads)
            else:
                behind[a:b][own > 0] = np.add.reduceat(value, heads[own > 0])
            if d > RESCALE:
                value /= np.repeat(behind[a:b], own)
            if d >= RESCALE and d % RESCALE == 0 and d < longest:
                if d == RESCALE:
                    p[:hi] /= np.repeat(behind[:b], edges[:b])
                n = int(many[d + 1])
                by = np.max([behind[off[c] : off[c] + n] for c in range(max(0, d - 3), d + 1)], axis=0)
                with np.errstate(over="ignore"):
                    for c in range(max(0, d - vocabulary.sizes.max() - 1), d + 1):
                        behind[off[c] : off[c] + n] /= by
        if longest <= RESCALE:
            p /= np.repeat(behind, edges)
        self.p = p
        self.upto = np.cumsum(p)
        filled = np.flatnonzero(edges)
        self.upto -= np.repeat(np.r_[0.0, self.upto[first[filled[1:]] - 1]] if len(filled) else np.zeros(0), edges[filled])
        self.upto[first[filled + 1] - 1] = np.inf  # the last edge takes what rounding leaves

    def log_p(self, edges: np.ndarray) -> np.ndarray:
        return np.log(np.maximum(self.p[edges], 1e-300))

    def walk(self, starts: np.ndarray, draw) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A way to the word's end from each place: how many steps it takes, then the place and edge of all steps in order. draw(which, bytes to go) gives uniforms."""
        words = int(self.off[1]) if len(self.off) > 1 else 0
        which = np.flatnonzero(starts >= words)
        now = starts[which]
        seen, steps = [], np.zeros(len(starts), np.int64)
        while len(which):
            u = draw(which, self.to_go[now])
            e = self.first[now]
            more = np.flatnonzero(self.upto[e] < u)
            while len(more):
                e[more] += 1
                more = more[self.upto[e[more]] < u[more]]
            seen.append((which, now, e))
            steps[which] += 1
            now = self.dst[e]
            on = np.flatnonzero(now >= words)
            which, now = which[on], now[on]
        at = np.cumsum(steps) - steps
        places, edges = np.empty(int(steps.sum()), np.int32), np.empty(int(steps.sum()), np.int32)
        for step, (w, n, e) in enumerate(seen):
            slot = at[w] + step
            places[slot], edges[slot] = n, e
        return steps, places, edges


class Paths:
    """One found path for each of some texts: cut tells where a text's steps stand; ``fresh`` is the step from which on the path is its own."""

    def __init__(self, cut: np.ndarray, places: np.ndarray, edges: np.ndarray, words: np.ndarray, fresh: np.ndarray):
        self.cut, self.places, self.edges, self.words, self.fresh = cut, places, edges, words, fresh


class Search:
    """The perturbed A-star search of many texts side by side; ``paths`` has a ``Paths`` for each round."""

    def __init__(self, lattice: Lattice, word_start: np.ndarray, word_end: np.ndarray, kind: np.ndarray, bounds: np.ndarray, keys: np.ndarray, seed: int):
        """word_start: place in the lattice by kind of word; word_end: last byte in its text, kind: of each word of the texts; bounds: the texts' words."""
        self.lattice, self.word_start, self.word_end, self.kind, self.bounds, self.keys, self.seed = lattice, word_start, word_end, kind, bounds, keys, seed
        self.n = len(bounds) - 1
        self.paths: list[Paths] = []
        none = np.zeros(0, np.int64)
        #: text, priority, location, and where the node leaves a path: round, step, edge
        self.queue = (none, np.zeros(0), np.zeros(0), none, none, none)

    def run(self, k: int) -> tuple[list[np.ndarray], np.ndarray]:
        """The texts' values by round (-inf: no more path), and kappa."""
        texts = np.arange(self.n)
        values = -np.log(-np.log(uniform(self.seed, self.keys, 1 << 20, np.zeros(self.n, U64))))
        found = [values.copy()]
        self._open(texts, values, np.zeros(self.n), None, k)
        for left in range(k - 1, -1, -1):
            kappa = np.full(self.n, -np.inf)
            text, priority = self.queue[:2]
            head = np.flatnonzero(np.r_[True, text[1:] != text[:-1]]) if len(text) else np.zeros(0, np.int64)
            kappa[text[head]] = priority[head]
            if not left or not len(head):
                break
            taken = [x[head] for x in self.queue]
            self.queue = tuple(np.delete(x, head) for x in self.queue)
            found.append(kappa.copy())
            self._open(taken[0], taken[1], taken[2], taken[3:], left)
        return found, kappa

    def _open(self, texts: np.ndarray, values: np.ndarray, location: np.ndarray, leaves, keep: int) -> None:
        """Opens a node of each of ``texts`` down to a leaf. leaves: the round, step and edge at which it leaves a path; None for the whole text."""
        lattice, n = self.lattice, len(texts)
        stream = 2 * len(self.paths)
        if leaves is None:
            first_word, head, gone = self.bounds[texts], np.zeros(n, np.int64), None
        else:
            gone, head, edge = leaves
            first_word = np.empty(n, np.int64)
            for r in np.unique(gone).tolist():
                mine, old = gone == r, self.paths[r]
                first_word[mine] = old.words[old.cut[texts[mine]] + head[mine]]
        size = self.bounds[texts + 1] - first_word
        word = np.repeat(first_word, size) + runs(size)
        own = np.repeat(np.arange(n), size)
        starts = self.word_start[self.kind[word]]
        if leaves is not None:
            starts[np.cumsum(size) - size] = lattice.dst[edge]  # the rest of the word in which the path is left
        key, end = self.keys[texts[own]], self.word_end[word]
        steps, places, edges = lattice.walk(starts, lambda which, to_go: uniform(self.seed, key[which], stream, (end[which] - to_go).astype(U64)))
        walked = np.bincount(own, steps, minlength=n).astype(np.int64)
        lead = head + (leaves is not None)
        length = lead + walked
        cut = np.zeros(self.n + 1, np.int64)
        cut[texts + 1] = length
        np.cumsum(cut, out=cut)
        whole = Paths(cut, np.empty(cut[-1], np.int32), np.empty(cut[-1], np.int32), np.empty(cut[-1], np.int32), np.zeros(self.n, np.int64))
        whole.fresh[texts] = lead
        to = np.repeat(cut[texts] + lead, walked) + runs(walked)
        whole.places[to], whole.edges[to], whole.words[to] = places, edges, np.repeat(word, steps)
        if leaves is not None:
            for r in np.unique(gone).tolist():
                mine, old = np.flatnonzero(gone == r), self.paths[r]
                span = head[mine] + 1  # up to the step at which it leaves
                to = np.repeat(cut[texts[mine]], span) + runs(span)
                at = np.repeat(old.cut[texts[mine]], span) + runs(span)
                whole.places[to], whole.edges[to], whole.words[to] = old.places[at], old.edges[at], old.words[at]
            whole.edges[cut[texts] + head] = edge
        self.paths.append(whole)
        self._siblings(whole, texts, values, location, walked, stream + 1, keep)

    def _siblings(self, path: Paths, texts: np.ndarray, values: np.ndarray, location: np.ndarray, walked: np.ndarray, stream: int, keep: int) -> None:
        """The siblings along the fresh part of the paths join the queue, as far as they can stay in it."""
        lattice = self.lattice
        todo, begin = np.flatnonzero(walked), np.zeros(len(texts), np.int64)
        at, reach, least = location.copy(), 4, self._least(keep)
        while len(todo):
            span = np.minimum(walked[todo] - begin[todo], reach)
            step = np.repeat(path.fresh[texts[todo]] + begin[todo], span) + runs(span)
            own = np.repeat(todo, span)
            place = path.cut[texts[own]] + step
            node, edge = path.places[place], path.edges[place]
            upto = np.r_[0.0, np.cumsum(lattice.log_p(edge))]
            tail = np.cumsum(span)
            here = np.repeat(at[todo] - upto[tail - span], span) + upto[:-1]  # the node's location
            begin[todo] += span
            at[todo] += upto[tail] - upto[tail - span]
            many = lattice.edges[node]
            rank = runs(many)
            other = np.repeat(lattice.first[node].astype(np.int32), many) + rank.astype(np.int32)
            which = np.repeat(np.arange(len(own), dtype=np.int32), many)
            share = lattice.p[other]
            real = np.flatnonzero((other != edge[which]) & (share > 0))
            which, other, rank = which[real], other[real], rank[real]
            spot = here[which] + np.log(share[real])
            text = texts[own[which]]
            noise = -np.log(-np.log(uniform(self.seed, self.keys[text], stream, (step[which] * 64 + rank).astype(U64))))
            enters = np.flatnonzero(spot + noise >= least[text])  # the bound from above only lowers a value
            which, text, spot = which[enters], text[enters], spot[enters]
            drawn = -np.logaddexp(-values[own[which]], -spot - noise[enters])
            new = (text, drawn, spot, np.full(len(text), len(self.paths) - 1), step[which], other[enters])
            queue = tuple(np.concatenate(x) for x in zip(self.queue, new, strict=True))
            order = np.lexsort((-queue[1], queue[0]))
            order = order[runs(np.bincount(queue[0], minlength=self.n)) < keep]
            self.queue = tuple(x[order] for x in queue)
            least = self._least(keep)
            todo = todo[(begin[todo] < walked[todo]) & (at[todo] + NOISE >= least[texts[todo]])]
            reach = min(64, reach * 16)

    def _least(self, keep: int) -> np.ndarray:
        """What a node has to reach to enter the queue of each text; -inf where there is room."""
        text = self.queue[0]
        last = np.flatnonzero(runs(np.bincount(text, minlength=self.n)) == keep - 1)
        out = np.full(self.n, -np.inf)
        out[text[last]] = self.queue[1][last]
        return out


def log_inclusion(log_p: float, kappa: float) -> float:
    if kappa == -math.inf:
        return 0.0
    x = log_p - kappa
    if x < -30:
        return x
    return math.log(-math.expm1(-math.exp(min(x, 50.0))))


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the texts, and starts, ends and rows of their words. A word: marks, then what stands before the next mark."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    bounds = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
    mark = np.zeros(len(data) + 3, bool)
    if len(data) >= 3:
        mark[: len(data) - 2] = (data[:-2] == MARK[0]) & (data[1:-1] == MARK[1]) & (data[2:] == MARK[2])
    begins = mark[: len(data)].copy()
    begins[3:] &= ~mark[: len(data)][:-3]
    begins[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
    starts = np.flatnonzero(begins)
    return data, starts, np.r_[starts[1:], len(data)], np.searchsorted(bounds, starts, "right") - 1


class Samples:
    """Segmentations of some normalised texts: the pieces of sample r of text i are pieces[r][cuts[r][i]:cuts[r][i + 1]]; value -inf: there is none."""

    def __init__(self, voc: Vocabulary, raw: list[bytes], keys: np.ndarray, k: int, seed: int):
        data, starts, ends, rows = _words(raw)
        first, kind = word_kinds(data, starts, ends)
        sizes = (ends - starts)[first]
        order = np.argsort(-sizes, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        sizes = sizes[order]
        lattice = Lattice(voc, data, ends[first][order], sizes)
        offset = np.cumsum([0, *map(len, raw)])[:-1]
        bounds = np.searchsorted(rows, np.arange(len(raw) + 1))
        search = Search(lattice, lattice.off[sizes] + np.arange(len(sizes), dtype=np.int32), ends - offset[rows], place[kind], bounds, keys, seed)
        self.values, self.kappa = search.run(k)
        self.pieces = [lattice.piece[p.edges] for p in search.paths]
        self.cuts = [p.cut for p in search.paths]
        self.log_probs = []
        for p in search.paths:
            upto = np.r_[0.0, np.cumsum(lattice.log_p(p.edges))]
            self.log_probs.append(upto[p.cut[1:]] - upto[p.cut[:-1]])


def normalized(voc: Vocabulary, texts: list[str | None]) -> list[bytes]:
    return [r.encode() if t else b"" for r, t in zip(voc.processor.normalize([t or "" for t in texts]), texts, strict=True)]


def sample_texts(voc: Vocabulary, texts: list[str | None], keys: np.ndarray, k: int, seed: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text its samples: (piece ids, log_prob, perturbed value, log inclusion), greatest value first."""
    found = Samples(voc, normalized(voc, texts), keys, k, seed)
    out: list[list] = [[] for _ in texts]
    for value, pieces, cut, log_p in zip(found.values, found.pieces, found.cuts, found.log_probs, strict=True):
        for i in np.flatnonzero(value > -np.inf).tolist():
            out[i].append((pieces[cut[i] : cut[i + 1]], float(log_p[i]), float(value[i]), log_inclusion(float(log_p[i]), float(found.kappa[i]))))
    return out


def decoded(voc: Vocabulary, ids: np.ndarray) -> bytes:
    """The normalised text (spaces as marks) that the pieces spell."""
    sizes = voc.sizes[ids]
    ends = np.cumsum(sizes)
    if not len(ids) or not ends[-1]:
        return b""
    return voc.pool[np.repeat(voc.at[ids] - (ends - sizes), sizes) + np.arange(int(ends[-1]))].tobytes()


def plain_text(raw: bytes) -> str:
    """Decoded bytes as text: marks are spaces, the first one stands for the start."""
    return raw.decode("utf-8", "replace").replace("▁", " ").removeprefix(" ")


_OUT = pa.schema([("row_key", pa.int64()), ("sample", pa.int32()), ("n_pieces", pa.int64()), ("log_prob", pa.float64()), ("perturbed", pa.float64()), ("log_inclusion", pa.float64()), ("ids_crc32", pa.int64()), ("decoded_crc32", pa.int64()), ("round_trip", pa.bool_()), ("ids", pa.list_(pa.int32()))])


@frees_memory
def _sampled(batches: Iterator[pa.RecordBatch], path: str, k: int, seed: int, emit_ids: bool, most: int = 3 << 20) -> Iterator[pa.RecordBatch]:
    voc = vocabulary(path)
    for batch in batches:
        ids_col, texts = batch.column(0), batch.column(1)
        sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        row = 0
        while row < batch.num_rows:
            end = max(row + 1, row + int(np.searchsorted(np.cumsum(sizes[row:]), most, "right")))
            raw = normalized(voc, texts.slice(row, end - row).to_pylist())
            row_keys = ids_col.slice(row, end - row)
            keys = pa.compute.fill_null(row_keys, 0).to_numpy().view(U64)
            found = Samples(voc, raw, keys, k, seed)
            for s, (value, pieces, cut, log_p) in enumerate(zip(found.values, found.pieces, found.cuts, found.log_probs, strict=True)):
                there = np.flatnonzero(value > -np.inf)
                spelled, ends = decoded(voc, pieces), np.r_[0, np.cumsum(voc.sizes[pieces])][cut]
                ids_crc, text_crc, same, ids = [], [], [], []
                for i in there.tolist():
                    own, text = pieces[cut[i] : cut[i + 1]], spelled[ends[i] : ends[i + 1]]
                    ids_crc.append(zlib.crc32(own))
                    text_crc.append(zlib.crc32(text))
                    same.append(text == raw[i])
                    ids.append(own if emit_ids else None)
                score = [log_inclusion(p, q) for p, q in zip(log_p[there].tolist(), found.kappa[there].tolist(), strict=True)]
                columns = (row_keys.take(pa.array(there)), np.full(len(there), s, np.int32), np.diff(cut)[there], log_p[there], value[there], score, ids_crc, text_crc, same, ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c for c, f in zip(columns, _OUT, strict=True)], schema=_OUT)
            row = end


def sample_segmentations(docs: DataFrame, *, model: str, k: int = 2, seed: int = 0, emit_ids: bool = True, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each text and sample: row_key, sample (0 has the greatest value), n_pieces, log_prob, perturbed, log_inclusion, ids_crc32, decoded_crc32, round_trip, ids."""
    text_batches(docs.sparkSession)
    slim = docs.select(F.col(key).cast("long").alias("row_key"), F.col(text).alias("text"))
    ddl = "row_key long, sample int, n_pieces long, log_prob double, perturbed double, log_inclusion double, ids_crc32 long, decoded_crc32 long, round_trip boolean, ids array<int>"
    return slim.mapInArrow(partial(_sampled, path=model, k=k, seed=seed, emit_ids=emit_ids), ddl)


def _texts(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    voc = vocabulary(path)
    for batch in batches:
        texts = [None if ids is None else plain_text(decoded(voc, np.array(ids, np.int64))) for ids in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*batch.schema.names[:-1], "decoded"])


def decode_pieces(rows: DataFrame, *, model: str, ids: str = "ids") -> DataFrame:
    """``rows`` with ``decoded``, the text that the pieces in ``ids`` spell; null for null."""
    from pyspark.sql import types as T

    schema = T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())])
    return rows.withColumn("sp__ids", F.col(ids)).mapInArrow(partial(_texts, path=model), schema)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_MODEL)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = sample_segmentations(docs, model=default_model(), k=2, seed=10, emit_ids=False)
    return out.drop("ids").withColumnRenamed("row_key", "doc_id")
