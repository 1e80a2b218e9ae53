"""Hidden Markov scores: recursion and expected counts against sums over all state paths, the query against plain loops."""

import collections
import itertools
import math
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from callgrove.llm import common, hmm, hmm_lm

DDL = "doc_id long, text string, n_tokens string, learn boolean, slab int"


def model_of(rng, k, classes):
    return hmm.Hmm(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), np.ascontiguousarray(rng.dirichlet(np.ones(classes), k).T))


def by_paths(m, seq):
    total, starts, moves, emits = 0.0, np.zeros(m.k), np.zeros((m.k, m.k)), np.zeros(m.emits.shape)
    for path in itertools.product(range(m.k), repeat=len(seq)):
        p = m.start[path[0]] * math.prod(m.emits[c, z] for c, z in zip(seq, path, strict=True)) * math.prod(m.moves[a, b] for a, b in itertools.pairwise(path))
        total += p
        starts[path[0]] += p
        for a, b in itertools.pairwise(path):
            moves[a, b] += p
        for c, z in zip(seq, path, strict=True):
            emits[c, z] += p
    return math.log10(total), starts / total, moves / total, emits / total


@pytest.mark.parametrize("chunk", [1, 2, 3, 2048])
@pytest.mark.parametrize("cells", [1, 400_000])
def test_recursion_is_the_sum_over_paths(monkeypatch, chunk, cells):
    """Chunks of any size, side by side or alone."""
    monkeypatch.setattr(hmm, "CHUNK", chunk)
    monkeypatch.setattr(hmm, "CELLS", cells)
    rng = np.random.default_rng(chunk)
    m = model_of(rng, 3, 5)
    seqs = [rng.integers(0, 5, n) for n in (1, 7, 2, 5, 6, 1)]
    want = [by_paths(m, s.tolist()) for s in seqs]
    classes, bounds = np.concatenate(seqs), np.r_[0, np.cumsum([len(s) for s in seqs])]
    np.testing.assert_allclose(m.log10(classes, bounds), [w[0] for w in want], rtol=1e-12)
    starts, moves, emits, total = m.expected(classes, bounds)
    for got, k in ((starts, 1), (moves, 2), (emits, 3)):
        np.testing.assert_allclose(got, sum(w[k] for w in want), rtol=1e-10, atol=1e-14)
    assert math.isclose(total, sum(w[0] for w in want), rel_tol=1e-12)


def plain_log10(m, seq):
    q, out = m.start, 0.0
    for c in seq:
        a = q * m.emits[c]
        out += math.log10(a.sum())
        q = (a / a.sum()) @ m.moves
    return out


def test_long_sequences_with_rare_classes():
    rng = np.random.default_rng(1)
    m = model_of(rng, 4, 50)
    m.emits[7] = [1e-25, 1e-28, 1e-22, 1e-30]
    seqs = [rng.integers(0, 50, n) for n in (9000, 3, 4097, 2048, 2049)] + [np.full(5000, 7)]
    got = m.log10(np.concatenate(seqs), np.r_[0, np.cumsum([len(s) for s in seqs])])
    np.testing.assert_allclose(got, [plain_log10(m, s) for s in seqs], rtol=1e-11)


def test_rounds_find_the_states():
    """Texts drawn from a model with two clear states: likelihood rises in every round, nearly to that of the model itself."""
    rng = np.random.default_rng(3)
    truth = hmm.Hmm(np.array([0.5, 0.5]), np.array([[0.95, 0.05], [0.1, 0.9]]), np.array([[0.45, 0.02], [0.45, 0.02], [0.02, 0.45], [0.02, 0.45], [0.06, 0.06]]))
    seqs = []
    for _ in range(200):
        z = rng.integers(0, 2)
        seq = []
        for _ in range(60):
            seq.append(rng.choice(5, p=truth.emits[:, z]))
            z = rng.choice(2, p=truth.moves[z])
        seqs.append(np.array(seq))
    classes, bounds = np.concatenate(seqs), np.r_[0, np.cumsum([len(s) for s in seqs])]
    common_ = np.bincount(classes, minlength=5) / len(classes)
    now, fits = hmm.first_model(classes, bounds, common_, 2, 0.0, rounds=1), []
    for _ in range(60):
        starts, moves, emits, fit = now.expected(classes, bounds)
        fits.append(fit)
        now = hmm.improved(starts, moves, emits, common_, 0.0)
    assert all(b >= a - 0.5 for a, b in itertools.pairwise(fits)) and fits[-1] > truth.log10(classes, bounds).sum() - 5


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def base(rows, learn):
    """(n_tokens, n_known, N, base) of each row by plain counting."""
    c = collections.Counter()
    for i, t in rows:
        if learn(i):
            c.update([*words(t), None])
    n, v = sum(c.values()), len(c)
    score = lambda toks: sum(math.log10((c[w] + 1) / (n + v + 1)) for w in toks)
    return [(i, len(words(t)) + 1, sum(c[w] > 0 for w in [*words(t), None]), n, score([*words(t), None])) for i, t in rows], c


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", True, 3) for i, t in rows], DDL).repartition(3)


def test_given_table(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(Path(sf_dir) / "documents.parquet").to_pylist()]
    want, _ = base(rows, lambda i: zlib.crc32(str(i).encode()) % 7 != 2)
    got = {r.doc_id: r for r in hmm_lm.op11(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for i, n, known, total, score in want:
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 7 == 2, n, known, total)
        assert math.isclose(r.base_score, score, rel_tol=1e-9) and -math.inf < r.score < 0
    for held in (False, True):
        assert sum(r.score for r in got.values() if r.held_out == held) > sum(r.base_score for r in got.values() if r.held_out == held)


def test_scores_are_the_models(spark, monkeypatch):
    """Small slabs; shares of classes and the recursion, text by text, with the model that Spark's sums gave."""
    monkeypatch.setattr(hmm_lm, "SLAB", 500)
    kept = []
    monkeypatch.setattr(hmm_lm, "trained", lambda *a, real=hmm_lm.trained, **options: kept.append(real(*a, **options)) or kept[-1])
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["Ein", "wort", "la", "mot", "x", "ü", f"w{rng.randrange(300)}"]) for _ in range(rng.randrange(60)))) for i in range(150)]
    fits: list[float] = []
    got = {r.doc_id: r for r in hmm_lm.hmm_scores(table(spark, rows), F.col("doc_id") % 3 > 0, states=3, class_bits=5, rounds=3, sample_texts=20, fits=fits).collect()}
    assert len(fits) == 3 and fits[0] < fits[1] < fits[2]
    want, c = base(rows, lambda i: i % 3)
    model = kept[-1]

    def kind(w):
        raw = np.frombuffer(w.encode(), np.uint8)
        return 32 if w is None else int(common.word_hashes(raw, np.array([0]), np.array([len(raw)]))[0]) % 32

    mass = collections.Counter({k: 1 for k in range(32)})
    for w, n in c.items():
        if w is not None:
            mass[kind(w)] += n + 1
    for (i, text), (_, n, known, total, score) in zip(rows, want, strict=True):
        shares = sum(math.log10((c[w] + 1) / mass[kind(w)]) for w in words(text))
        exact = shares + plain_log10(model.hmm, [*map(kind, words(text)), 32])
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert math.isclose(r.base_score, score, rel_tol=1e-9) and math.isclose(r.score, exact, rel_tol=1e-9)
    np.testing.assert_allclose(model.hmm.emits.sum(0), 1)
    np.testing.assert_allclose(model.hmm.moves.sum(1), 1)


def test_counts_of_spark_are_those_of_one_pass(spark, monkeypatch):
    """A round over many slabs gives the expected counts of all texts at once."""
    monkeypatch.setattr(hmm_lm, "SLAB", 300)
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("abcdefg") for _ in range(rng.randrange(1, 40)))) for i in range(80)]
    seen = []
    monkeypatch.setattr(hmm_lm, "improved", lambda s, m, e, *a, real=hmm_lm.improved: seen.append((s, m, e)) or real(s, m, e, *a))
    first = []
    monkeypatch.setattr(hmm_lm, "first_model", lambda *a, real=hmm_lm.first_model: first.append(real(*a)) or first[-1])
    hmm_lm.hmm_scores(table(spark, rows), F.lit(True), states=2, class_bits=4, rounds=1).count()
    kind = lambda w: int(common.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)]))[0]) % 16
    seqs = [[*map(kind, t.split()), 16] for _, t in rows]
    want = first[0].expected(np.array(list(itertools.chain(*seqs)), np.int32), np.r_[0, np.cumsum([len(s) for s in seqs])])
    for got, exact in zip(seen[-1], want[:3], strict=True):
        np.testing.assert_allclose(got, exact, rtol=1e-9, atol=1e-12)


def test_odd_rows(spark):
    rows = [(None, "never learnt"), (1, None), (2, ""), (3, " \n\t"), (4, "Twice twice"), (4, "Twice twice"), (5, "x" * 200_000), (6, "wort " * 30_000), (7, " nbsp in\x0b  ")]
    got = hmm_lm.hmm_scores(table(spark, rows), F.col("doc_id") != 7).collect()
    assert hmm_lm.hmm_scores(table(spark, rows), F.lit(True)).columns == ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    want, _ = base(rows, lambda i: i is not None and i != 7)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    for r, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert r[:4] == w[:4] and math.isclose(r[4], w[4], rel_tol=1e-9) and math.isfinite(r[5])
    none = hmm_lm.hmm_scores(table(spark, rows), F.lit(False)).collect()
    assert all(r.base_score == 0 and r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in none) and len(none) == len(rows)
    assert hmm_lm.hmm_scores(table(spark, rows).limit(0), F.lit(True)).count() == 0
