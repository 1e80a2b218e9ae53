"""Packing, toxicity, quality, language identification, preference pairs, SentencePiece sampling, with the odd rows."""

import bisect
import collections
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from callgrove.llm import language_id, packing, preference, quality, sentencepiece_sampling, toxicity
from callgrove.llm.linear import Chain, features

DOCS = "doc_id long, text string, lang string, source string, length int, key string, y int, sequence_id string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s" if (i or 0) % 3 else None, 5, "k", 2, "q") for i, t, lang in rows], DOCS).repartition(3)


def prose(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


ODD = [(None, "text without id", "en"), (900, None, None), (901, "", "en"), (902, " \n", "en"), (903, "123 !!", "de"), (904, "twice", "en"), (904, "twice", "en"), (905, "wort " * 20_000, "de")]

# ---------------------------------------------------------------- packing


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_tokenizer())


@pytest.mark.parametrize("text", ["Hello, World!  it's we'll 'S 12a3", "naïve Ärger straße ſ", "Ünïcode é combining", "日本語 текст", "<|endoftext|> a", "a<|startoftext|>b", "tab\tnew\nline\r\x0b\x0c", "…‘x’ — “y”", " x y", "İstanbul ΣΑΣ", "''''s'd", "🙂🙂 ok", "_under_score__", "­ soft"])
def test_encoder_is_the_tokenizer(tokenizer, text):
    encode = packing.Encoder(packing.default_tokenizer(), None)
    assert np.frombuffer(next(encode([text])), np.uint32).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_encoder_on_random_text(tokenizer):
    rng = random.Random(0)
    encode = packing.Encoder(packing.default_tokenizer(), None)
    letters = "aAbB'''sstrevelmdé .,!?\n\t-_129ßÖ…²½ªµ×<|>"
    for _ in range(400):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(40)))
        assert np.frombuffer(next(encode([text])), np.uint32).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_merges_are_the_tokenizers(tokenizer):
    """Words of all lengths, those with one symbol again and again among them, and bytes that stand for no letter."""
    rng = random.Random(1)
    words = ["a" * n for n in range(1, 90)] + ["abab" * 30, "x" * 100_000, "abcde" * 5000 + " ab " + "edcba" * 4000, "ß" * 21, "…", "ſé"] + ["".join(rng.choice("etaoinshrdlué") for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    for slab in (1, 1 << 20):
        for word, ids in zip(words, packing.Encoder(packing.default_tokenizer(), None, slab)(words), strict=True):
            assert np.frombuffer(ids, np.uint32).tolist() == tokenizer.encode(word, add_special_tokens=False).ids, word


def best_fit_decreasing(sizes, capacity):
    gaps = []
    for s in sorted(sizes, reverse=True):
        at = bisect.bisect_left(gaps, s)
        bisect.insort(gaps, (gaps.pop(at) if at < len(gaps) else capacity) - s)
    return len(gaps)


def check_packing(rows, capacity, more=0):
    held = collections.defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and sum(n for _, n in parts) <= capacity
    assert 0 <= len(held) - best_fit_decreasing([r.length for r in rows], capacity) <= more


@pytest.mark.parametrize("seed", range(3))
def test_packing_sizes(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 7, 50, 64, rng.randrange(1, 65)]) for _ in range(500)] + [33] * 300  # one size holds a third of all
    pieces = spark.createDataFrame([(i, 0, n, "x") for i, n in enumerate(sizes)], "doc_id long, piece int, length long, offset string")
    got = packing.best_fit_packing(pieces, capacity=64).collect()
    assert len(got) == len(sizes)
    check_packing(got, 64)


@pytest.mark.parametrize("low, high", [(1, 65), (20, 40), (33, 64), (1, 9), (21, 22)])
def test_packing_in_rounds(spark, low, high):
    """Many lanes and rounds: as many sequences as best-fit decreasing, or one more in a hundred."""
    rng = random.Random(low)
    sizes = [rng.randrange(low, high) for _ in range(3000)]
    pieces = spark.createDataFrame([(i, 0, n, 9) for i, n in enumerate(sizes)], "doc_id long, piece int, length long, rank int")
    got = packing.best_fit_packing(pieces, capacity=64, lane_rows=150).collect()
    assert sorted((r.doc_id, r.length, r["rank"]) for r in got) == [(i, n, 9) for i, n in enumerate(sizes)]
    check_packing(got, 64, more=len({r.sequence_id for r in got}) // 100)


def test_sweep_is_best_fit():
    """One by one: each document goes to the smallest gap that holds it."""
    rng = random.Random(2)
    for _ in range(30):
        sizes, gaps = sorted((rng.randrange(1, 33) for _ in range(80)), reverse=True), sorted((rng.randrange(1, 33) for _ in range(rng.randrange(40))), reverse=True)
        sequence, offset, left = packing.sweep(np.array(sizes), np.array(gaps, np.int64), 32)
        want, start = sorted(gaps), [*gaps, *[32] * (len(left) - len(gaps))]
        for s in sizes:
            at = bisect.bisect_left(want, s)
            bisect.insort(want, (want.pop(at) if at < len(want) else 32) - s)
        assert sorted(left.tolist()) == want
        for q in range(len(left)):
            mine = sorted((int(offset[i]), sizes[i]) for i in np.flatnonzero(sequence == q))
            assert sum(n for _, n in mine) + left[q] == start[q] and [o for o, _ in mine] == [32 - start[q] + sum(n for _, n in mine[:i]) for i in range(len(mine))]


def test_packing_documents(spark, tokenizer):
    rng = random.Random(9)
    rows = [(i, prose(rng, ["alpha", "Beta", "gamma,"], rng.randrange(1, 90)), "en") for i in range(40)] + ODD
    pieces = packing.tokenized_pieces(docs(spark, rows), tokenizer=packing.default_tokenizer(), size=64, emit_ids=True)
    got = packing.best_fit_packing(pieces, capacity=64).collect()
    check_packing(got, 64)
    want = collections.Counter()
    for i, t, _ in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 64):
            part = np.array(ids[k : k + 64], np.uint32)
            want[i, k // 64, k, len(part), zlib.crc32(part.tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = packing.packed_sequences(packing.best_fit_packing(pieces, capacity=64)).collect()
    assert sum(len(s.ids) for s in sequences) == sum(r.length for r in got)
    assert packing.best_fit_packing(pieces.limit(0), capacity=64).count() == 0


# ---------------------------------------------------------------- classifiers


def labelled(rng, n):
    calm, harsh, junk = ["day", "tree", "river", "walks", "blue", "stone"], ["idiotic", "scummy"], ["BUY!!", "###"]
    rows, labels = [], []
    for i in range(n):
        low, toxic = i % 5 == 0, i % 7 == 0
        text = [rng.choice(calm) for _ in range(rng.randrange(20, 60))]
        text += [rng.choice(harsh)] * toxic + [rng.choice(junk) for _ in range(30)] * low
        rng.shuffle(text)
        rows.append((i, " ".join(text), "en"))
        labels.append((i, int(not low), int(toxic), "extra"))
    return rows, labels


LABELS = "doc_id long, quality int, toxic int, text string"


def test_toxicity(spark):
    rows, labels = labelled(random.Random(1), 600)
    known = spark.createDataFrame([x for x in labels if x[0] % 2] + [(None, 1, 1, ""), (3, None, None, ""), (99_999, 1, 1, "")], LABELS)
    out = toxicity.toxicity(docs(spark, rows + ODD), toxicity.chain_labels(known), categories=toxicity.CATEGORIES, reject="toxic").collect()
    assert len(out) == len(rows) + len(ODD) and out[0].key == "k"
    held = [r for r in out if r.doc_id is not None and r.doc_id < 600 and r.doc_id % 2 == 0]
    assert np.mean([r.tox_rejected == (r.doc_id % 7 == 0) for r in held]) > 0.98
    assert np.mean([(r.tox_low_quality >= 0.5) == (r.doc_id % 5 == 0) for r in held]) > 0.98
    assert not any(r.tox_rejected for r in out if r.doc_id in (900, 901, 902))


def test_toxicity_without_labels(spark):
    none = toxicity.chain_labels(spark.createDataFrame([], LABELS))
    out = toxicity.toxicity(docs(spark, ODD), none, categories=toxicity.CATEGORIES, reject="toxic", threshold=0.6).collect()
    assert {r.tox_toxic for r in out} == {0.5} and len(out) == len(ODD)
    assert toxicity.toxicity(docs(spark, ODD).limit(0), none, categories=toxicity.CATEGORIES, reject="toxic").count() == 0


def test_later_models_use_earlier_ones():
    rng = np.random.default_rng(0)
    n = 900
    first = rng.random(n) < 0.5
    rows, buckets = np.arange(n), np.where(first, 7, 9)
    second = first ^ (rng.random(n) < 0.02)
    chain = Chain().fit(rows, buckets, np.stack([first, second], 1).astype(float))
    assert chain.models[1].dense[0] > 0.05 and len(chain.models[0].dense) == 0


def dense_fit(x, y, options):
    """The same model by dense matrices: standard scores choose the columns, then Adam on the mean log loss with L2."""
    n = len(y)
    prior = (y.sum() + 0.5) / (n + 1)
    hits, seen, mean = x.T @ y, x.sum(0), y.mean()
    score = np.abs(hits - seen * mean) / np.sqrt(np.maximum(seen, 1) * mean * (1 - mean)) * (seen >= options["least_rows"])
    use = score > options["least_gap"]
    z = np.c_[x * use, options["extra"], np.ones(n)]
    w = np.zeros(z.shape[1])
    w[-1] = math.log(prior / (1 - prior))
    m = v = np.zeros_like(w)
    for step in range(1, 201):
        g = z.T @ (1 / (1 + np.exp(-(z @ w))) - y) / n + 1e-4 * np.r_[w[:-1], 0]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return w


def test_chain_against_dense_matrices():
    """Both models of a chain, the second with out-of-fold log-odds of the first, to 1e-6."""
    rng = np.random.default_rng(8)
    n, k = 300, 25
    x = (rng.random((n, k)) < 0.3).astype(float)
    first = (x[:, 0] + x[:, 1] + rng.normal(size=n) * 0.5 > 0.7).astype(float)
    second = (first + x[:, 2] + rng.normal(size=n) * 0.5 > 1).astype(float)
    rows, columns = np.nonzero(x)
    buckets = (columns * 1000 + 7).astype(np.int64)
    chain = Chain().fit(rows.astype(np.int32), buckets.astype(np.int32), np.stack([first, second], 1))
    got = chain.predict(rows, buckets, n)
    options = {"least_rows": 3, "least_gap": 4.0}
    sigmoid = lambda a: 1 / (1 + np.exp(-a))
    w1 = dense_fit(x, first, options | {"extra": np.zeros((n, 0))})
    p1 = sigmoid(np.c_[x, np.ones(n)] @ w1)
    assert np.allclose(got[0], p1, atol=1e-6)
    odds, out = lambda p: np.log(np.clip(p, 1e-6, 1 - 1e-6) / np.clip(1 - p, 1e-6, 1)), np.zeros(n)
    for f in range(3):
        train, test = np.arange(n) % 3 != f, np.arange(n) % 3 == f
        w = dense_fit(x[train], first[train], options | {"extra": np.zeros((int(train.sum()), 0))})
        out[test] = sigmoid(np.c_[x, np.ones(n)] @ w)[test]
    w2 = dense_fit(x, second, options | {"extra": odds(out)[:, None]})
    assert abs(w2[k]) > 0.05 and np.allclose(got[1], sigmoid(np.c_[x, odds(p1), np.ones(n)] @ w2), atol=1e-6)


def test_features_ignore_neighbours():
    texts = [b"one two", b"", b"two THREE", "é ß".encode()]
    whole = features(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    for i, t in enumerate(texts):
        alone = features(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[1]
        assert sorted(alone) == sorted(whole[1][whole[0] == i])


def test_quality(spark):
    rows, labels = labelled(random.Random(2), 600)
    known = spark.createDataFrame(labels[::2], LABELS)
    out = quality.quality(docs(spark, rows + ODD), known, host=F.col("source"), path=F.col("lang")).collect()
    assert len(out) == len(rows) + len(ODD)
    held = [r for r in out if r.doc_id is not None and r.doc_id < 600 and r.doc_id % 2]
    assert np.mean([r.quality_keep == (r.doc_id % 5 != 0) for r in held]) > 0.97
    assert all(0 < r.quality_p_path < 1 and 0 < r.quality_p_host < 1 for r in out)
    empty = spark.createDataFrame([], LABELS)
    assert {r.quality_p_doc for r in quality.quality(docs(spark, ODD), empty, host=F.col("source"), path=F.col("lang")).collect()} == {0.5}
    assert quality.quality(docs(spark, ODD).limit(0), empty, host=F.col("source"), path=F.col("lang")).count() == 0


def test_sparse_sites_shrink(spark):
    rows = [("big", "a", float(i % 10 < 9), 1.0) for i in range(400)] + [("bad", "a", float(i % 10 < 1), 1.0) for i in range(400)] + [("tiny", "a", 0.0, 1.0), (None, None, 1.0, 1.0), ("none", "x", 1.0, 0.0)]
    got = {r.host: r for r in quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, y double, w double")).collect()}
    p = {h: (r.s_host + r.k_host * r.prior) / (r.n_host + r.k_host) for h, r in got.items()}
    assert p["big"] > 0.85 and p["bad"] < 0.15 and 0.1 < p["tiny"] < 0.5 and None in got and "none" not in got


def strength_brute(sites, prior):
    """sites: [(n, s, prior)]"""
    spread = sum((s - n * p) ** 2 / n for n, s, p in sites)
    noise = sum(p * (1 - p) for _, _, p in sites)
    between = max((spread - noise) / sum(n for n, _, _ in sites), 1e-6)
    return min(max(noise / len(sites) / between - 1, 1.0), 1e6)


def test_posteriors_against_brute_force(spark):
    """Sites with many rows and with one, null ones, soft and hard evidence: rates, strengths and each document's posteriors, one by one."""
    rng = random.Random(11)
    rows, labels = labelled(rng, 400)
    site = {i: (None if i % 29 == 0 else f"h{min(i % 17, int(rng.expovariate(0.4)))}" if i % 7 else f"lone{i}", f"p{rng.randrange(1 + i % 4)}") for i, _, _ in rows}
    frame = spark.createDataFrame([(i, t, *site[i], "x", 0.5) for i, t, _ in rows], "doc_id long, text string, host string, path string, y string, n double")
    known = [x for x in labels if x[0] % 3]
    got = {r.doc_id: r for r in quality.quality(frame, spark.createDataFrame(known, LABELS), host=F.col("host"), path=F.col("path")).collect()}
    assert len(got) == 400 and all((r.host, r.path, r.y, r.n) == (*site[i], "x", 0.5) for i, r in got.items())
    label = {i: q for i, q, _, _ in known}
    y = {i: float(label.get(i, got[i].quality_p_doc)) for i in got}
    w = {i: 1.0 if i in label else 0.25 for i in got}
    paths, hosts = collections.defaultdict(lambda: [0.0, 0.0]), collections.defaultdict(lambda: [0.0, 0.0])
    for i in got:
        for level, key in ((paths, site[i]), (hosts, site[i][0])):
            level[key][0] += w[i]
            level[key][1] += w[i] * y[i]
    prior = (sum(s for _, s in hosts.values()) + 0.5) / (sum(n for n, _ in hosts.values()) + 1)
    k_host = strength_brute([(n, s, prior) for n, s in hosts.values()], prior)
    rate = {h: (s + k_host * prior) / (n + k_host) for h, (n, s) in hosts.items()}
    k_path = strength_brute([(n, s, rate[h]) for (h, _), (n, s) in paths.items()], prior)
    train = (sum(label.values()) + 0.5) / (len(label) + 1)
    logit = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    for i, r in got.items():
        (n, s), (nh, sh) = paths[site[i]], hosts[site[i][0]]
        p_host = (sh - w[i] * y[i] + k_host * prior) / (nh - w[i] + k_host)
        p_path = (s - w[i] * y[i] + k_path * p_host) / (n - w[i] + k_path)
        want = 1 / (1 + math.exp(-(logit(r.quality_p_doc) - logit(train) + logit(p_path))))
        assert (r.quality_p_host, r.quality_p_path, r.quality_posterior) == pytest.approx((p_host, p_path, want), abs=1e-9)


def test_site_prior_helps_where_words_dont(spark):
    """Documents whose words tell nothing: the site's record decides them, the classifier alone is at chance."""
    rng = random.Random(12)
    rows = [(i, prose(rng, ["day", "tree", "river"], 20), f"s{i % 40}") for i in range(1200)]
    good = {i: int(rng.random() < (0.95 if i % 40 < 20 else 0.05)) for i, _, _ in rows}
    frame = spark.createDataFrame(rows, "doc_id long, text string, host string")
    known = spark.createDataFrame([(i, good[i], 0, "") for i in good if i % 3], LABELS)
    held = [r for r in quality.quality(frame, known, host=F.col("host"), path=F.lit("")).collect() if r.doc_id % 3 == 0]
    with_site = np.mean([(r.quality_posterior >= 0.5) == good[r.doc_id] for r in held])
    without = np.mean([(r.quality_p_doc >= 0.5) == good[r.doc_id] for r in held])
    assert with_site > 0.88 and without < 0.65


def test_url_sites(spark):
    urls = ["https://WWW.a.example.com/en/825?page=2", "http://blog.a.example.com", "http://a.example.com/x", "not a url", None, ""]
    frame = spark.createDataFrame([(u,) for u in urls], "url string")
    host, path = quality.url_site(F.col("url"))
    assert [tuple(r) for r in frame.select(host, path).collect()][:3] == [("a.example.com", "en"), ("blog.a.example.com", ""), ("a.example.com", "x")]
    assert all(r[0] is None for r in frame.select(host, path).collect()[3:])


def test_sample_of_repeated_ids_is_bounded(spark):
    from callgrove.llm.linear import labelled_sample

    frame = spark.createDataFrame([(1, f"word{i}") for i in range(50)] + [(2, "two")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1)], "doc_id long, quality int")
    _, _, targets = labelled_sample(frame, labels, ["quality"], max_rows=10, text="text", doc_id="doc_id")
    assert targets.tolist() == [[1.0], [1.0]]


# ---------------------------------------------------------------- language


def longest_matches(text, sample):
    count, at = 0, 0
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at : at + n + 1] in sample:
            n += 1
        count, at = count + 1, at + n
    return count


def test_phrases_are_longest_matches():
    rng = random.Random(4)
    sample = "".join(rng.choice("abc") for _ in range(300))
    model = language_id.Model({"x": [sample], "y": ["".join(rng.choice("abd") for _ in range(200))]})
    texts = ["".join(rng.choice("abcdz") for _ in range(rng.randrange(1, 60))) for _ in range(50)]
    assert phrases(model, texts) == [longest_matches(t, sample) for t in texts]


def phrases(model, texts):
    codes = model.codes(language_id.code_points("".join(texts)))
    return model.phrases(codes, np.cumsum([0, *map(len, texts)]))[:, 0].tolist()


def test_long_texts_are_parsed_as_one():
    """Phrases cross the places where runs begin, also where two parses never fall together, and among other texts of any length."""
    rng = random.Random(5)
    sample = "".join(rng.choice("abc") for _ in range(400)) + "d" * 37
    model = language_id.Model({"x": [sample], "y": ["abcd"]})
    texts = ["".join(rng.choice("abcdz") for _ in range(n)) for n in (6000, 1, 512, 513, 1024)]
    texts += ["d" * 40_000, "", "abc" * 900 + "d" * 20_000 + "cab" * 700, "z" * 2000]
    assert phrases(model, texts) == [longest_matches(t, sample) for t in texts]
    assert model.phrases(np.zeros(0, np.int32), np.zeros(3, np.int64)).tolist() == [[0, 0]] * 2


def test_automata_are_bounded_by_their_edges():
    """A language with thousands of letters: small arrays, and the phrases are still the longest matches, for it and for its neighbours."""
    rng = np.random.default_rng(4)
    wide = "".join(chr(0x4E00 + c) for c in np.minimum(rng.zipf(1.1, 40_000), 20_000).tolist())
    narrow = "".join(rng.choice(list("abcde "), 40_000))
    model = language_id.Model({"wide": [wide], "narrow": [narrow]})
    assert model.symbols > 4_000 and model.owner.nbytes + model.target.nbytes < 4 << 20
    texts = [wide[100:400] + wide[90:120], "abcab" + wide[5:25] + "𝐀" + narrow[7:99], ""]
    texts = [" ".join(t.split()) for t in texts]
    codes = model.codes(language_id.code_points("".join(texts)))
    got = model.phrases(codes, np.cumsum([0, *map(len, texts)]))
    for lang, sample in (("wide", wide), ("narrow", narrow)):
        assert got[:, model.langs.index(lang)].tolist() == [longest_matches(t, " ".join(sample.split())) for t in texts]
    with pytest.raises(ValueError, match="sample_chars"):
        language_id.Model({"wide": [wide], "narrow": [narrow]}, max_bytes=1 << 20)


@pytest.mark.parametrize("symbols", [2, 3, 40])
def test_edges_are_those_of_the_automaton(symbols):
    rng = np.random.default_rng(symbols)
    nexts = language_id.suffix_automaton(rng.integers(0, symbols, 600))
    packed = language_id.Edges(nexts, symbols)
    state = {1: packed.root}  # of the automaton, found from the root on
    for s in (walk := [1]):
        for c in range(symbols):
            at = state[s] + c
            to = int(packed.target[at]) if packed.owner[at] == state[s] else 0
            assert (to > 0) == (c in nexts[s])
            if to and nexts[s][c] not in state:
                state[nexts[s][c]] = to
                walk.append(nexts[s][c])
            assert not to or state[nexts[s][c]] == to
    assert len(set(state.values())) == len(state) == len(nexts) - 1


def test_language(spark):
    rng = random.Random(6)
    banks = {"en": ["the", "river", "walks", "slowly"], "de": ["und", "fließt", "langsam", "weiter"], "fr": ["la", "rivière", "coule", "été"]}
    rows = [(i, prose(rng, banks[lang], 40), lang) for i, lang in enumerate(itertools.islice(itertools.cycle(banks), 120))]
    out = language_id.language_id(docs(spark, rows + ODD), F.col("doc_id") % 2 == 0, sample_chars=3000).collect()
    assert len(out) == len(rows) + len(ODD)
    assert all(r.lang_pred == r.lang and 0 <= r.lang_score <= 1 for r in out if r.doc_id is not None and r.doc_id < 120)
    assert {r.lang_pred for r in out if r.doc_id in (900, 901, 902, 903)} == {"und"} and {r.lang_pred for r in out if r.doc_id == 904} <= set(banks)
    nothing = language_id.language_id(docs(spark, ODD), F.lit(False)).collect()
    assert {(r.lang_pred, r.lang_score) for r in nothing} == {("und", 0.0)}
    assert language_id.language_id(docs(spark, ODD).limit(0), F.lit(True)).count() == 0


def test_language_samples_of_long_and_uneven_texts(spark):
    """Long texts, a huge one among short ones, tiny texts: every language has a full sample, from many documents."""
    rows = [(i, f"{i:03d} " * 10_000, "long") for i in range(100, 130)] + [(200 + i, f"{i:03d} " * 25, "mixed") for i in range(60)] + [(300, "zzz " * 100_000, "mixed")]
    rows += [(1000 + i, "ab", "tiny") for i in range(900)] + [(2000, "only one " * 5000, "one"), (2001, "few", "few")]
    got = language_id.labelled_samples(docs(spark, rows), F.lit(True), sample_chars=1000, text="text", lang="lang", doc_id="doc_id")
    assert {lang: sum(map(len, texts)) for lang, texts in got.items()} == {"long": 1000, "mixed": 1000, "tiny": 1000, "one": 1000, "few": 3}
    assert len(got["long"]) >= 20 and len(got["mixed"]) >= 40 and len(got["tiny"]) == 500
    assert sum(len(t) for t in got["mixed"] if "z" in t) <= 50


def test_wide_symbols_are_no_letters(spark):
    """Emoji and other symbols beyond the first 65,536 code points are und; letters there are letters, in lower case."""
    rows = [(i, "the river walks slowly " * 4, "en") for i in range(6)] + [(10, "🙂🙂 🚀", "en"), (11, "𝄞🂡", "en"), (12, "𐐀𐐨", "en")]
    got = {r.doc_id: r for r in language_id.language_id(docs(spark, rows), F.col("doc_id") < 6).collect()}
    assert [(got[i].lang_pred, got[i].lang_score) for i in (10, 11)] == [("und", 0.0)] * 2 and got[12].lang_pred == "en"
    marks = language_id.language_id(docs(spark, [*rows, (20, "\u0301\u0301", "en"), (21, "e\u0301", "en")]), F.col("doc_id") < 6).collect()
    assert {r.doc_id: r.lang_pred for r in marks if r.doc_id in (20, 21)} == {20: "und", 21: "en"}
    assert language_id.letters(language_id.code_points("A🙂𐐀𐐨")).tolist() == [ord("a"), 0, 0x10428, 0x10428]


# ---------------------------------------------------------------- preference pairs

TURNS = "pair_id long, side string, turn long, role string, text string, start int, cut string"


def turns(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS)


def brute_pair(chosen, rejected):
    n = 0
    while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
        n += 1
    show = lambda part: "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in part)
    return show(chosen[:n]), show(chosen[n:]), show(rejected[n:])


def test_preference_pairs(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for p in range(40):
        common = [("user" if k % 2 == 0 else "assistant", f"c{p} {k}") for k in range(rng.randrange(0, 6))]
        sides = {s: common + [(rng.choice(["user", "assistant"]), f"{rng.randrange(3)}") for _ in range(rng.randrange(0, 4))] for s in ("chosen", "rejected")}
        rows += [(p, s, k, r, t) for s, x in sides.items() for k, (r, t) in enumerate(x)]
        if all(sides.values()):
            want[p] = brute_pair(sides["chosen"], sides["rejected"])
    got = {r.pair_id: r for r in preference.rendered(preference.preference_segments(turns(spark, rows))).collect()}
    for p, texts in want.items():
        assert (got[p].prompt, got[p].chosen, got[p].rejected) == texts
        for part in ("chosen", "rejected"):
            trained = "".join(got[p][part][s.start : s.end] for s in got[p][f"{part}_spans"])
            said = [x.split("<|im_end|>\n")[0] for x in got[p][part].split("<|im_start|>assistant\n")[1:]]
            assert trained == "".join(x + "<|im_end|>\n" for x in said)


def test_preference_odd_rows(spark):
    long = [(5, s, k, "user", f"t{k}") for k in range(700) for s in ("chosen", "rejected")] + [(5, "chosen", 700, "assistant", "yes"), (5, "rejected", 700, "assistant", "no")]
    rows = [(1, "chosen", 0, "user", "a"), (2, "chosen", 0, None, None), (2, "rejected", 0, "user", ""), (None, "chosen", 0, "user", "x"), (3, None, 0, "user", "x"), (3, "chosen", None, "user", "x"), (4, "chosen", 0, "user", "b"), (4, "chosen", 0, "user", "a"), (4, "rejected", 0, "user", "z")]
    got = preference.preference_segments(turns(spark, rows + rows + long)).collect()
    status = {r.pair_id: r.status for r in got}
    assert status == {1: "unpaired", 2: "identical", 4: "paired", 5: "paired"}
    assert {r.part: r.segment for r in got if r.pair_id == 4}["chosen"] == "<|im_start|>user\na<|im_end|>\n"
    prompt = sorted((r.seq, r.start, len(r.segment)) for r in got if r.pair_id == 5 and r.part == "prompt")
    assert [s for s, _, _ in prompt] == list(range(700)) and all(a[1] + a[2] == b[1] for a, b in itertools.pairwise(prompt))
    assert {r.seq for r in got if r.pair_id == 5 and r.part != "prompt"} == {0}
    assert preference.preference_segments(turns(spark, rows).limit(0)).count() == 0


# ---------------------------------------------------------------- SentencePiece


@pytest.fixture(scope="module")
def voc():
    return sentencepiece_sampling.vocabulary(sentencepiece_sampling.default_model())


def all_paths(voc, text):
    data = ("▁" + text.replace(" ", "▁")).encode()
    pieces = {b: i for i, b in enumerate(voc.bytes) if b and not voc.processor.is_byte(i)}

    def go(at):
        if at == len(data):
            yield (), 0.0
        for end in range(at + 1, len(data) + 1):
            if (i := pieces.get(data[at:end])) is not None:
                for rest, w in go(end):
                    yield (i, *rest), w + float(voc.weights[i])

    found = dict(go(0))
    top = max(found.values())
    total = top + math.log(sum(math.exp(w - top) for w in found.values()))
    return {p: w - total for p, w in found.items()}


def samples(voc, texts, k, seed=0, first=0):
    return sentencepiece_sampling.sample_texts(voc, texts, np.arange(first, first + len(texts)).astype(np.uint64), k, seed)


@pytest.mark.parametrize("text", ["then", "a cat", "the then that"])
def test_sampling_distribution(voc, text):
    """First samples follow the paths' probabilities, second ones those without the first."""
    p = {x: math.exp(w) for x, w in all_paths(voc, text).items()}
    assert sum(p.values()) == pytest.approx(1)
    n = 3000
    found = samples(voc, [text] * n, 2)
    first = collections.Counter(tuple(s[0][0].tolist()) for s in found)
    second = collections.Counter(tuple(s[1][0].tolist()) for s in found)
    for x in sorted(p, key=p.get)[-4:]:
        later = sum(p[y] * p[x] / (1 - p[y]) for y in p if y != x)
        assert abs(first[x] / n - p[x]) < 4 * math.sqrt(p[x] / n) + 0.003
        assert abs(second[x] / n - later) < 4 * math.sqrt(later / n) + 0.003
    for s in found[:200]:
        assert tuple(s[0][0]) != tuple(s[1][0]) and s[0][2] >= s[1][2]
        assert s[0][1] == pytest.approx(math.log(p[tuple(s[0][0].tolist())]))


@pytest.mark.parametrize("k", [1, 2, 5, 40])
def test_samples_of_enumerated_paths(voc, k):
    """Distinct paths with their own probabilities, in falling order of value, and kappa below all of them."""
    texts = ["then", "a cat", "", "the then", "日", "x"]
    for text, got in zip(texts, samples(voc, texts, k, seed=k), strict=True):
        p = all_paths(voc, text) if text not in ("", "日") else None
        ids, values = [tuple(s[0].tolist()) for s in got], [s[2] for s in got]
        assert len(set(ids)) == len(ids) <= k and values == sorted(values, reverse=True)
        if p is not None:
            assert len(ids) == min(k, len(p)) and all(s[1] == pytest.approx(p[x]) for s, x in zip(got, ids, strict=True))
        assert all(s[3] <= 0 for s in got) and (p is None or len(p) > k or all(s[3] == 0 for s in got))


def test_queue_keeps_what_a_full_queue_would(voc, monkeypatch):
    """Siblings that aren't drawn couldn't have entered the queue."""
    rng = random.Random(3)
    texts = [prose(rng, ["then", "that", "Ωδ", "bcdfg", "a"], n) for n in (1, 2, 5, 40, 300)]
    short = samples(voc, texts, 4, seed=1)
    monkeypatch.setattr(sentencepiece_sampling, "NOISE", 1e9)
    for a, b in zip(short, samples(voc, texts, 4, seed=1), strict=True):
        assert [(s[0].tolist(), s[1:]) for s in a] == [(s[0].tolist(), s[1:]) for s in b]


def test_sampling_long_texts_and_words(voc):
    """20,000 words, one word of 5,000 characters, many characters without a piece: distinct samples that spell the text, with probabilities of their own steps."""
    rng = random.Random(5)
    texts = [prose(rng, ["alpha", "the", "Ωmega", "river"], 20_000), "".join(rng.choice("abcdefgh") for _ in range(5000)), "x" * 200, "\U00010348" * 400]
    for text, got, paths in zip(texts, samples(voc, texts, 3), (3, 3, 3, 1), strict=True):  # bytes alone give one path
        want = sentencepiece_sampling.normalized(voc, [text])[0]
        assert len({s[0].tobytes() for s in got}) == len(got) == paths and all(sentencepiece_sampling.decoded(voc, s[0]) == want for s in got)
        assert all(math.isfinite(x) for s in got for x in s[1:])


def test_inclusion_scores_are_unbiased(voc):
    """The sum of f / inclusion over the samples has the mean sum of f over all paths (Horvitz-Thompson), here 1 per path's probability."""
    p = all_paths(voc, "then")
    found = samples(voc, ["then"] * 4000, 2, seed=3)
    totals = [sum(math.exp(lp - q) for _, lp, _, q in s) for s in found]
    assert len(p) > 2 and np.mean(totals) == pytest.approx(1, abs=0.05)


def test_all_segmentations_once(voc):
    p = all_paths(voc, "then")
    found = samples(voc, ["then"], 1000)[0]
    assert {tuple(s[0].tolist()) for s in found} == set(p) and len(found) == len(p) and all(s[3] == 0 for s in found)


def test_sampling_rows(spark, voc):
    rng = random.Random(2)
    texts = ["x\ty\n\nz", "naïve ﬁ 日本語 🙂", "  two  spaces ", "a" * 300, "0123 abc,,,"]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(50 + i, prose(rng, ["alpha", "beta", "Gamma's"], 200), "en") for i in range(5)] + ODD
    model = sentencepiece_sampling.default_model()
    frame = sentencepiece_sampling.sample_segmentations(docs(spark, rows), model=model, k=3, seed=5)
    got = frame.collect()
    again = {(r.row_key, r.sample): r.ids_crc32 for r in sentencepiece_sampling.sample_segmentations(docs(spark, rows).repartition(1), model=model, k=3, seed=5).collect()}
    assert all(r.round_trip for r in got) and again == {(r.row_key, r.sample): r.ids_crc32 for r in got}
    by = collections.defaultdict(list)
    for r in got:
        by[r.row_key].append(r)
    assert {len(by[i]) for i in range(50, 55)} == {3} and len({r.ids_crc32 for r in by[50]}) == 3
    assert [(r.n_pieces, r.log_prob, r.log_inclusion) for r in by[900]] == [(0, 0.0, 0.0)]
    text = {i: t for i, t, _ in rows}
    for r in sentencepiece_sampling.decode_pieces(frame, model=model).collect():
        if r.row_key not in (None, 904, 905):
            assert r.decoded == (text[r.row_key] or "") == voc.processor.decode(r.ids)
    assert sentencepiece_sampling.sample_segmentations(docs(spark, rows).limit(0), model=model).count() == 0


def test_rows_that_repeat_an_id_do_not_all_reach_the_driver(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame as Frame

    rows = [(7, f"text {i % 50}", "xx") for i in range(2000)] + [(i, "other words", "yy") for i in range(5)]
    sizes = []
    monkeypatch.setattr(Frame, "collect", lambda self, real=Frame.collect: sizes.append(len(found := real(self))) or found)
    samples = language_id.labelled_samples(docs(spark, rows), F.lit(True), sample_chars=30, text="text", lang="lang", doc_id="doc_id")
    assert sum(map(len, samples["xx"])) == 30 and max(sizes) <= 60
    again = language_id.labelled_samples(docs(spark, rows).repartition(2), F.lit(True), sample_chars=30, text="text", lang="lang", doc_id="doc_id")
    assert again == samples
