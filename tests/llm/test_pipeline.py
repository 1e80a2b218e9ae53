"""The pipeline's stages against plain versions over the smallest tables, and what must hold of each stage's decisions."""

import collections
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline as P
from callgrove.llm import packing, registry

from .test_dedup import jaccard_brute, suffix_brute


@pytest.fixture(scope="module")
def steps(spark, sf_dir, tmp_path_factory):
    docs, found = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in P.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        found.append(docs)
    return found


@pytest.fixture(scope="module")
def source(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(frame):
    return {r.doc_id: r.text for r in frame.select("doc_id", "text").collect()}


def test_columns_and_order(steps, source):
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard_join", "suffix_array_dedup", "best_fit_packing"]
    assert all(f.columns == source.columns for f in steps[:4])


def test_toxicity(spark, sf_dir, steps, source):
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1").collect()}
    kept = set(texts(steps[0]))
    clean = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 0").collect()}
    assert len(clean & kept) >= 0.95 * len(clean) and len(toxic & kept) < 0.5 * len(toxic)  # 87 labels to learn from


def test_exact(steps):
    before, after = texts(steps[0]), texts(steps[1])
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    first = {}
    for i in sorted(before):
        first.setdefault(norm(before[i]), i)
    assert set(after) == set(first.values())


def test_near_copies(steps):
    rows = list(texts(steps[1]).items())
    _, component = jaccard_brute(rows, 5, 80)
    assert set(texts(steps[2])) == {i for i, _ in rows if component[i] == i}


def test_repeats(steps):
    rows = list(texts(steps[2]).items())
    after = texts(steps[3])
    for (i, t), (kept, spans) in zip(rows, suffix_brute(rows, P.PASSAGE_BYTES), strict=True):
        if spans == 0:
            assert after[i] == t
        else:  # a character that a cut would split stays whole
            assert 0 <= len(after[i].encode()) - len(kept) <= 6 * spans


def test_packing(steps):
    held = collections.defaultdict(int)
    for r in steps[4].collect():
        held[r.sequence_id] += r.length
    assert set(texts(steps[3])) == {r.doc_id for r in steps[4].select("doc_id").collect()} and max(held.values()) <= 2048


def test_packed_ids_are_the_texts(steps):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    parts = collections.defaultdict(dict)
    for r in steps[4].collect():
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, np.int32).tobytes()) == r.ids_crc32
        parts[r.doc_id][r.piece] = r.ids
    for i, t in texts(steps[3]).items():
        assert [x for _, ids in sorted(parts[i].items()) for x in ids] == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
    sequences = packing.packed_sequences(steps[4]).collect()
    assert sum(len(s.ids) for s in sequences) == sum(len(ids) for p in parts.values() for ids in p.values()) and max(len(s.ids) for s in sequences) <= 2048


def test_run_is_the_stages(spark, sf_dir, steps):
    key = lambda f: sorted(map(tuple, f.select("doc_id", "piece", "length", "ids_crc32").collect()))
    assert key(P.run(spark, sf_dir)) == key(steps[4])


def test_one_query_for_each_operator():
    numbers = [int(re.match(r"op(\d+)_", n)[1]) for n in registry.QUERIES]
    assert sorted(numbers) == list(range(1, 14)) and set(registry.SQL) <= set(registry.QUERIES)


ODD = [(1, "plain text of some words", "en", "s", 5), (1, "plain text of some words", "en", "s", 5), (2, None, None, None, None), (None, "no id here", "de", "s", 1), (3, "", "en", None, 0), (4, "ü" * 3000, "de", "s", 3000), (5, "ü" * 2999 + "x", "de", "s", 3000), (6, " \n\t", "xx", "s", 3)]


@pytest.mark.parametrize("stage", [f for _, f in P.STAGES], ids=[n for n, _ in P.STAGES])
def test_stages_take_odd_rows(spark, sf_dir, stage):
    ddl = "doc_id long, text string, lang string, source string, n_chars long"
    wide = spark.createDataFrame([(*r, "c", 1) for r in ODD], ddl + ", copies string, length int")
    got = stage(spark, wide, sf_dir)
    rows = got.collect()
    ids = {r.doc_id for r in rows}
    assert {1, 3, 4} <= ids or stage is P.drop_copies and {1, 2, 4} <= ids
    if stage is not P.pack:
        assert got.columns == wide.columns and all(r.copies == "c" for r in rows)
    if stage is P.drop_copies:
        assert sorted(i for i in (r.doc_id for r in rows) if i is not None) == [1, 2, 4, 5, 6] and None in ids
    if stage is P.cut_repeats:
        assert {r.text for r in rows if r.doc_id in (4, 5)} <= {"", "x", "üx"}
    assert stage(spark, wide.limit(0), sf_dir).count() == 0
