"""Exact dedup, n-gram join, suffix dedup, embedding near-dedup against brute force, with the odd rows."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from callgrove.llm import ngram_join, suffix_dedup
from callgrove.llm.common import Stages, connected_components
from callgrove.llm.embedding_dedup import embedding_dedup
from callgrove.llm.exact_dedup import exact_dedup
from callgrove.llm.ngram_join import ngram_components
from callgrove.llm.suffix_dedup import suffix_dedup as cut

DOCS = "doc_id long, text string, lang string, first string, size int, copies string, key string, tokens string"
EXTRA = (None, "f", 1, "c", "k", "t")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, *EXTRA) for i, t in rows], DOCS).repartition(3)


def words(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


ODD = [(None, "alone without id"), (None, "a  b"), (900, None), (901, ""), (902, " \t\n"), (903, "solo"), (903, "solo"), (904, "A  b\tc"), (905, "A b c"), (906, "x" * 50_000)]


def components(links, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("weak", [False, True])
def test_exact(spark, weak):
    rng = random.Random(1)
    rows = [(i, words(rng, 3, 6)) for i in range(150)] + ODD
    hashed = (lambda b: F.md5(F.substring(F.md5(b), 1, 1))) if weak else F.md5  # weak: sixteen groups, full of collisions
    got = exact_dedup(docs(spark, rows), content_hash=hashed).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    assert len(got) == len(rows)
    for r in got:
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")
        ids = [i for i in groups[norm] if i is not None]
        assert (r.dedup_keep_id, r.dedup_group_size) == (min(ids) if ids else None, len(groups[norm]))
        assert r.dedup_sha256 == hashlib.sha256(norm.encode()).hexdigest() and r.key == "k" and r.size == 1
    kept = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in got if r.dedup_kept]
    assert sorted(kept) == sorted(groups)


def test_exact_empty_and_again(spark):
    none = docs(spark, ODD).limit(0)
    assert exact_dedup(none).count() == 0
    once = exact_dedup(docs(spark, ODD))
    assert exact_dedup(once.where("dedup_kept")).where("not dedup_kept").count() == 0


def jaccard_brute(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    ids = list(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: len(s) for i, s in sets.items()}, components(links, ids)


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (2, 50)])
def test_ngram_join(spark, n, percent):
    rng = random.Random(n)
    rows = []
    for _ in range(12):  # families of near copies, edited more and more
        base = words(rng, rng.randrange(5, 120)).split()
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(copy) // 12)):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy).title()))
    shared = words(rng, 30)
    rows += [(1000 + k, shared + " " + words(rng, 40)) for k in range(20)]  # a passage that many share
    rows += [(2000 + k, t) for k, t in enumerate([None, "", "one", "One", "one two", "a a a a a a", "a a a a"])]
    counts, want = jaccard_brute(rows, n, percent)
    got = ngram_components(docs(spark, rows), words=n, percent=percent, fragments=4).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (counts[i], want[i]) for i in counts}


def test_sizes_at_the_threshold_link(spark):
    """A set of 10 n-grams within one of 100 at a tenth: sizes exactly at the ratio."""
    long = [f"w{k}" for k in range(100)]
    got = ngram_components(docs(spark, [(1, " ".join(long)), (2, " ".join(long[:10])), (3, "other words")]), words=1, percent=10).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 3}


def test_ngram_join_odd_rows(spark):
    got = ngram_components(docs(spark, ODD)).collect()
    assert len(got) == len(ODD) and {r.component_id for r in got if r.doc_id == 903} == {903}
    assert {(r.n_shingles, r.component_id) for r in got if r.doc_id in (900, 901, 902)} == {(0, 900), (0, 901), (0, 902)}
    assert {r.component_id for r in got if r.doc_id in (904, 905)} == {904}
    assert ngram_components(docs(spark, ODD).limit(0)).count() == 0


def test_ngram_hot_family_makes_few_pairs(spark, monkeypatch):
    """Two hundred variants of one text, each with its own edits: comparisons stay near one a member."""
    rng = random.Random(5)
    base = words(rng, 200).split()
    rows = [(0, " ".join(base))]
    for k in range(1, 200):
        copy = list(base)
        for _ in range(rng.randrange(1, 8)):
            copy[rng.randrange(200)] = f"e{k}x{rng.randrange(10**6)}"
        rows.append((k, " ".join(copy)))
    seen = []
    real = ngram_join.verified
    monkeypatch.setattr(ngram_join, "verified", lambda pairs, *a, **k: (seen.append(pairs.count()), real(pairs, *a, **k))[1])
    got = {r.doc_id: r.component_id for r in ngram_components(docs(spark, rows), words=3, percent=90).collect()}
    assert got == jaccard_brute(rows, 3, 90)[1] and sum(seen) < 600


def suffix_brute(rows, length):
    raw = [(t or "").encode() for _, t in rows]
    seen = {}
    for b in raw:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append((bytes(c for c, g in zip(b, gone, strict=True) if not g), sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))))
    return out


def suffix_rows():
    rng = random.Random(3)
    letters = "abcdefghéß "
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passages = [text(n) for n in (39, 40, 41, 60, 150)]
    rows = [(i, text(rng.randrange(0, 90)) + rng.choice(passages) + text(rng.randrange(0, 90)) + rng.choice(passages) + text(5)) for i in range(60)]
    rows += [(100, "ab" * 60), (101, "x" * 200), (102, None), (103, ""), (104, passages[4]), (105, passages[4]), (106, text(39)), (107, "twice " + passages[3] + " and " + passages[3])]
    base = text(300)
    rows += [(200 + k, base[:k] + "Z" + base[k + 1 :]) for k in range(0, 300, 23)]
    return rows


def in_process(texts, length):
    """The operator's steps without Spark: anchors, groups, sorted repeats, spans."""
    k = suffix_dedup.gram_size(length)
    groups = {}
    for d, raw in enumerate(texts):
        _, pos, grams = suffix_dedup.anchors(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), length)
        for p, g in zip(pos.tolist(), grams.tolist(), strict=True):
            a = max(0, p - (length - k))
            groups.setdefault(g, {}).setdefault((p - a, raw[a : p + length]), []).append((d, p))
    names = [(i, *c) for i, g in enumerate(groups.values()) for c in g]
    places = [v for g in groups.values() for v in g.values()]
    left, right = suffix_dedup.repeats([c for _, _, c in names], np.array([x for _, x, _ in names]), np.array([i for i, *_ in names]), np.array([len(v) for v in places]), length)
    spans = {}
    for at, l, r in zip(places, left.tolist(), right.tolist(), strict=True):
        for d, p in at:
            if r:
                spans.setdefault(d, []).append((p - l, p + r))
    return [suffix_dedup._without(raw, m) for raw, m in ((t, suffix_dedup.merged(spans.get(d, []))) for d, t in enumerate(texts))]


@pytest.mark.parametrize(("hot", "bits"), [(20_000, 64), (5, 64), (1, 64), (1, 12)], ids=["sorted", "some hot", "all hot", "all hot, colliding hashes"])
def test_suffixes(spark, hot, bits):
    """Also where window hashes collide: the bytes behind them are compared, and the hot path is left."""
    rows = suffix_rows()
    got = {r.doc_id: r for r in cut(docs(spark, rows), length=40, hot=hot, window_bits=bits).collect()}
    for (i, t), (kept, spans) in zip(rows, suffix_brute(rows, 40), strict=True):
        assert (bytes(got[i].suffix_bytes), len(got[i].suffix_spans)) == (kept, spans), (i, t)
        assert got[i].suffix_text is not None and got[i].copies == "c"


@pytest.mark.parametrize("mode", ["plain", "no neighbours", "colliding hashes"])
def test_suffix_steps(monkeypatch, mode):
    """Also where the neighbours don't settle an anchor, and where hashes say equal of what isn't."""
    if mode == "no neighbours":
        monkeypatch.setattr(suffix_dedup, "NEIGHBOURS", 0)
    if mode == "colliding hashes":
        real = suffix_dedup.span_hashes
        monkeypatch.setattr(suffix_dedup, "span_hashes", lambda p, a, b: real(p, a, b) % np.uint64(7))
    rows = suffix_rows()
    assert in_process([(t or "").encode() for _, t in rows], 40) == [k for k, _ in suffix_brute(rows, 40)]


def test_suffix_odd_rows(spark):
    got = cut(docs(spark, ODD)).collect()
    assert len(got) == len(ODD)
    assert next(r for r in got if r.doc_id == 906).suffix_bytes == b""
    assert {bytes(r.suffix_bytes) for r in got if r.doc_id == 903} == {b"solo"}
    assert cut(docs(spark, ODD).limit(0)).count() == 0
    twice = cut(docs(spark, [(1, "é" * 300), (1, "é" * 300), (2, "unlike")])).collect()
    assert sorted(r.suffix_text for r in twice) == ["", "", "unlike"]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 450)] + [(500, k) for k in range(501, 700)] + [(3, 3), (None, 4)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long"), Stages(spark, "t")).collect()))
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == components(real, {n for e in real for n in e})


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "u") for i, v in rows], "vec_id long, embedding array<float>, label int, uid string").repartition(3)


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    rows, centres = [], rng.normal(size=(30, 16))
    for c in centres[:12]:
        rows += [c + rng.normal(size=16) * s for s in rng.uniform(0, 0.35, 25)]
    rows += list(rng.normal(size=(200, 16))) + [rows[0]] * 40
    x = np.array(rows, np.float32)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hit = unit @ unit.T >= 0.9
    np.fill_diagonal(hit, False)
    odd = [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] + [1.0] * 15), (5003, [float("inf")] + [1.0] * 15), (5004, []), (5005, [None] + [1.0] * 15), (5006, [1.0, 2.0]), (5007, [2.0, 4.0]), (None, [0.0, 1.0])]
    got = embedding_dedup(vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)] + odd), cosine=0.9, min_pivots=16).collect()
    assert len(got) == len(x) + len(odd)
    links = {r.vec_id: r.near_links for r in got}
    found = np.array([links[i] for i in range(len(x))])
    assert (found <= hit.sum(1)).all() and found.sum() >= 0.97 * hit.sum()
    assert {i: links[i] for i in range(5000, 5008)} == {**dict.fromkeys(range(5000, 5006), 0), 5006: 1, 5007: 1}
    comp = {r.vec_id: r.near_component for r in got}
    want = components([(int(a), int(b)) for a, b in zip(*np.nonzero(hit), strict=True)], range(len(x)))
    assert sum(comp[i] == want[i] for i in want) >= 0.97 * len(want)
    assert comp[5007] == 5006 and all(r.near_kept == (r.vec_id == r.near_component) for r in got if r.vec_id is not None)


@pytest.mark.parametrize("together", [0.995, 0.97, 0.9])
def test_embeddings_crowded(spark, together):
    """A third of all vectors lie close together, each with its own jitter: all their links are found."""
    rng = np.random.default_rng(7)
    n, d = 6000, 64
    x = rng.normal(size=(n, d))
    centre = rng.normal(size=d)
    x[::3] = centre / np.linalg.norm(centre) + x[::3] / np.sqrt(d) * np.sqrt(1 / together - 1)
    x = x.astype(np.float32)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.9).sum(1) - 1
    got = {r.vec_id: r for r in embedding_dedup(vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)]), cosine=0.9).collect()}
    found = np.array([got[i].near_links for i in range(n)])
    assert want.sum() > 10**6 and (found <= want).all() and found.sum() >= 0.999 * want.sum()
    crowd = np.flatnonzero(want > 100)
    assert len({got[int(i)].near_component for i in crowd}) == 1


def test_large_doubtful_balls_are_compared_in_blocks(spark, monkeypatch):
    """Two balls that may or may not link, with many blocks of members each: the same links as by brute force."""
    from callgrove.llm import embedding_dedup as module

    monkeypatch.setattr(module, "MEMBERS", 50)
    rng = np.random.default_rng(3)
    ends = np.zeros((2, 8))
    ends[0, 0], ends[1, 0], ends[1, 1] = 1, np.cos(0.45), np.sin(0.45)
    x = np.concatenate([c + rng.normal(size=(400, 8)) * 0.03 for c in ends]).astype(np.float32)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.9).sum(1) - 1
    got = {r.vec_id: r.near_links for r in embedding_dedup(vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)]), cosine=0.9, min_pivots=16).collect()}
    assert 399 < want.mean() < 799 and [got[i] for i in range(800)] == want.tolist()


def test_embeddings_empty(spark):
    assert embedding_dedup(vectors(spark, [(1, [1.0])]).limit(0)).count() == 0
    assert embedding_dedup(vectors(spark, [(1, None)])).collect()[0].near_component == 1
    twins = embedding_dedup(vectors(spark, [(7, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [1.0, 0.0])])).collect()
    assert {r.near_links for r in twins} == {2} and {r.near_component for r in twins} == {7}


def test_very_large_and_very_small_components_link(spark):
    rows = [(1, [1e200, 0.0]), (2, [1e200, 0.0]), (3, [1.0, 0.0]), (4, [1e-300, 1e-310]), (5, [0.0, 5e-324]), (6, [0.0, 1e308])]
    got = {r.vec_id: (r.near_links, r.near_component) for r in embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {**dict.fromkeys((1, 2, 3, 4), (3, 1)), **dict.fromkeys((5, 6), (1, 5))}
