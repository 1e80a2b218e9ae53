"""Hidden Markov models over classes of words: exact scaled forward recursion, and Baum-Welch's expected counts.

Sequences lie one after the other in a flat array of classes. They are cut into chunks of at most ``CHUNK`` tokens, and many chunks advance side by side, so that one long text
doesn't take a step a token alone. That is exact: what a chunk does to the states' distribution is linear, so chunks of sequences that have several are first
run from every state at once; chaining these matrices gives the distribution with which each chunk starts, and backwards what comes after it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK, CELLS = 2048, 200_000
#: Steps from one scaling to the next; as many emissions multiplied stay far above the least double.
SCALED = 8


class Hmm:
    """start (K): probability of each state at a sequence's first token. moves (K, K). emits (classes, K): probability of each class in each state."""

    def __init__(self, start: np.ndarray, moves: np.ndarray, emits: np.ndarray):
        self.start, self.moves, self.emits = start, moves, emits
        self.k = len(start)

    # ------------------------------------------------ chunks side by side

    @staticmethod
    def _side_by_side(sizes: np.ndarray, cells: int) -> Iterator[np.ndarray]:
        """Chunks by falling size, as many at a time as have about ``cells`` tokens."""
        order, at = np.argsort(-sizes, kind="stable"), 0
        while at < len(order):
            some = order[at : at + max(1, cells // int(sizes[order[at]]))]
            yield some
            at += len(some)

    @staticmethod
    def _laid_out(classes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Classes by step and chunk, and how many chunks each step has (the first ones)."""
        steps = np.arange(int(sizes[0]))
        return classes[np.minimum(starts[None] + steps[:, None], len(classes) - 1)], np.searchsorted(-sizes, -steps, "left")

    def _matrices(self, classes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each chunk makes of each state before its first token: distributions (n, K, K) before the token after it, and natural logarithms of their weights."""
        k, n = self.k, len(starts)
        out, weight = np.empty((n, k, k)), np.empty((n, k))
        for some in self._side_by_side(sizes, CELLS // k):
            laid, active = self._laid_out(classes, starts[some], sizes[some])
            at, log = np.tile(np.eye(k), (len(some), 1, 1)), np.zeros((len(some), k))
            emitted = self.emits[laid]
            for t, m in enumerate(active.tolist()):
                a = at[:m] * emitted[t, :m, None, :]
                if t % SCALED == SCALED - 1:
                    z = a @ np.ones(k)
                    a /= z[:, :, None]
                    log[:m] += np.log(z)
                np.matmul(a.reshape(-1, k), self.moves, out=at[:m].reshape(-1, k))
            z = at.sum(2)
            out[some], weight[some] = at / z[:, :, None], log + np.log(z)
        return out, weight

    def _chunks(self, classes: np.ndarray, bounds: np.ndarray, both_ways: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all chunks: sequence, start, size, is it the sequence's last, distribution before its first token, message from behind its last one."""
        lengths = np.diff(bounds)
        many = -(-lengths // CHUNK)
        seq = np.repeat(np.arange(len(lengths)), many)
        place = np.arange(len(seq)) - np.repeat(np.cumsum(many) - many, many)
        starts = bounds[seq] + place * CHUNK
        sizes = np.minimum(CHUNK, bounds[seq + 1] - starts)
        last = place == many[seq] - 1
        before, behind = np.tile(self.start, (len(seq), 1)), np.ones((len(seq), self.k))
        if len(wide := np.flatnonzero(many[seq] > 1)):
            of = {c: i for i, c in enumerate(wide.tolist())}
            out, weight = self._matrices(classes, starts[wide], sizes[wide])
            for c in wide[~last[wide]].tolist():
                w = before[c] * np.exp(weight[of[c]] - weight[of[c]].max())
                q = w @ out[of[c]]
                before[c + 1] = q / q.sum()
            if both_ways:
                for c in wide[place[wide] > 0][::-1].tolist():
                    r = np.exp(weight[of[c]] - weight[of[c]].max()) * (out[of[c]] @ behind[c])
                    behind[c - 1] = r / r.max()
        return seq, starts, sizes, last, before, behind

    def _forward(self, emitted: np.ndarray, active: np.ndarray, sizes: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States after each token (steps, chunks, K), scaled now and then, and each chunk's log10 probability given what came before it."""
        q, one = before.copy(), np.ones(self.k)
        held, found = np.zeros_like(emitted), np.zeros(len(sizes))
        for t, m in enumerate(active.tolist()):
            a = np.multiply(q[:m], emitted[t, :m], out=held[t, :m])
            if t % SCALED == SCALED - 1:
                c = a @ one
                a /= c[:, None]
                found[:m] += np.log10(c)
            np.matmul(a, self.moves, out=q[:m])
        return held, found + np.log10(held[sizes - 1, np.arange(len(sizes))].sum(1))

    def _backward(self, emitted: np.ndarray, active: np.ndarray, behind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What follows each token, seen from its state and from the state after it; scaled now and then."""
        r = behind.copy()
        seen, ahead = np.zeros_like(emitted), np.zeros_like(emitted)
        back = np.ascontiguousarray(self.moves.T)
        for t in range(len(active) - 1, -1, -1):
            m = int(active[t])
            if t % SCALED == 0:
                r[:m] /= r[:m].max(1, keepdims=True)
            ahead[t, :m] = r[:m]
            message = np.matmul(r[:m], back, out=seen[t, :m])
            np.multiply(message, emitted[t, :m], out=r[:m])
        return seen, ahead

    # ------------------------------------------------ what others call

    def log10(self, classes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Exact log10 probability of each sequence classes[bounds[i]:bounds[i + 1]]; none may be empty."""
        seq, starts, sizes, _, before, _ = self._chunks(classes, bounds, False)
        found = np.zeros(len(seq))
        for some in self._side_by_side(sizes, CELLS):
            laid, active = self._laid_out(classes, starts[some], sizes[some])
            _, found[some] = self._forward(self.emits[laid], active, sizes[some], before[some])
        return np.bincount(seq, found, len(bounds) - 1)

    def expected(self, classes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected counts of starts (K), moves (K, K) and emissions (classes, K), and the sequences' log10 probability in all."""
        k = self.k
        starts_, moves, emits, total = np.zeros(k), np.zeros((k, k)), np.zeros(self.emits.shape), 0.0
        seq, starts, sizes, last, before, behind = self._chunks(classes, bounds, True)
        first = starts == bounds[seq]
        for some in self._side_by_side(sizes, CELLS):
            laid, active = self._laid_out(classes, starts[some], sizes[some])
            emitted = self.emits[laid]
            held, found = self._forward(emitted, active, sizes[some], before[some])
            total += float(found.sum())
            seen, ahead = self._backward(emitted, active, behind[some])
            share = np.multiply(held, seen, out=seen).reshape(-1, k)
            w = share @ np.ones(k)
            w[w == 0] = 1  # beyond a chunk's end
            share /= w[:, None]
            held.reshape(-1, k)[:] /= w[:, None]
            held[sizes[some] - 1, np.arange(len(some))] *= ~last[some][:, None]  # behind a sequence's last token nothing moves
            moves += held.reshape(-1, k).T @ ahead.reshape(-1, k)
            starts_ += seen[0][first[some]].sum(0)
            kinds = laid.reshape(-1)
            for j, column in enumerate(np.ascontiguousarray(share.T)):
                emits[:, j] += np.bincount(kinds, column, len(emits))
        return starts_, moves * self.moves, emits, total


def improved(starts: np.ndarray, moves: np.ndarray, emits: np.ndarray, common: np.ndarray, shrink: float) -> Hmm:
    """The model of these expected counts.

    A class's share of the states is drawn to that of all tokens as if it had been met ``shrink`` times more often at random, so that a rare word isn't
    tied to the state that it happened to be met in, and none is ruled out; ``common``, the classes' distribution, says how frequent it is. With shrink 0, and common that of the tokens counted, this is the plain estimate.
    """
    k = len(starts)
    start = (starts + 1 / k) / (starts.sum() + 1)
    steps = (moves + 1 / k) / (moves.sum(1, keepdims=True) + 1)
    weight = (emits.sum(0) + 1 / k) / (emits.sum() + 1)
    met = emits.sum(1, keepdims=True)
    share = np.divide(emits + shrink * weight, met + shrink, out=np.tile(weight, (len(emits), 1)), where=met + shrink > 0)
    own = common[:, None] * share
    return Hmm(start, steps, own / own.sum(0))


def first_model(classes: np.ndarray, bounds: np.ndarray, common: np.ndarray, states: int, shrink: float, seed: int = 0, rounds: int = 12) -> Hmm:
    """A point to start from: a mixture over the sequences as wholes parts them by what words they have; its components, with few moves between them, are refined as a hidden Markov model."""
    if len(bounds) < 2:
        return Hmm(np.full(states, 1 / states), np.full((states, states), 1 / states), np.repeat(common[:, None], states, 1))
    rng = np.random.default_rng(seed)
    seq = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    share = rng.dirichlet(np.full(states, 0.3), len(bounds) - 1)
    for _ in range(rounds):
        emits = np.stack([np.bincount(classes, share[seq, j], len(common)) for j in range(states)], 1)
        model = improved(share.sum(0), np.ones((states, states)), emits, common, shrink)
        fit = np.add.reduceat(np.log(model.emits)[classes], bounds[:-1], axis=0) + np.log(model.start)
        share = np.exp(fit - fit.max(1, keepdims=True))
        share /= share.sum(1, keepdims=True)
    moves = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    model = Hmm(model.start, moves, model.emits)
    for _ in range(rounds):
        starts, moves, emits, _ = model.expected(classes, bounds)
        model = improved(starts, moves, emits, common, shrink)
    return model
