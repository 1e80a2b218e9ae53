"""Equality of words: strings that collide under every polynomial hash modulo 2**64, and hashes that are made to collide."""

import random
import zlib

import numpy as np
import pytest

from callgrove.llm import common, ngram_join, packing, sentencepiece_sampling


def thue_morse(n: int, a: str = "a", b: str = "b") -> tuple[str, str]:
    """The word of n letters, and its complement."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)


def spans(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ends = np.cumsum([len(w) for w in words]).astype(np.int64)
    return np.frombuffer(b"".join(words), np.uint8), np.r_[0, ends[:-1]].astype(np.int64), ends


def test_word_hashes_tell_what_polynomials_do_not():
    for n in (1024, 2048, 4096):
        one, two = (t.encode() for t in thue_morse(n))
        data, starts, ends = spans([one, two])
        old = common.span_hashes(common.prefix_hashes(data), starts, ends)
        assert old[0] == old[1]
        assert len(set(common.word_hashes(data, starts, ends).tolist())) == 2


def test_word_hashes_depend_on_bytes_only():
    rng = random.Random(3)
    words = ["".join(rng.choice("abAB") for _ in range(rng.randrange(1, 30))).encode() for _ in range(3000)]
    data, starts, ends = spans(words)
    for fold in (False, True):
        of = dict(zip(common.word_hashes(data, starts, ends, fold=fold).tolist(), words, strict=True))
        assert len(of) == len({w.lower() if fold else w for w in words})
    assert len(common.word_hashes(data, starts[:0], ends[:0])) == 0


@pytest.mark.parametrize("bits", [0, 3, 64])
def test_word_kinds_hold_bytes_against_each_other(monkeypatch, bits):
    """With hashes of no bits at all every word collides."""
    real = common._hashed
    monkeypatch.setattr(common, "_hashed", lambda *a: real(*a) & np.uint64((1 << bits) - 1))
    rng = random.Random(5)
    words = ["".join(rng.choice("xyz") for _ in range(rng.randrange(1, 20))).encode() for _ in range(500)]
    data, starts, ends = spans(words)
    first, kind = common.word_kinds(data, starts, ends)
    assert [words[first[k]] for k in kind] == words and len(first) == len(set(words))


def colliding(spark):
    rows = [(i * 10 + k, t) for i, n in enumerate((1024, 2048, 4096)) for k, t in enumerate((*thue_morse(n), "a plain row"))]
    return spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), dict(rows)


def test_packing_tells_colliding_words_apart(spark):
    from tokenizers import Tokenizer

    docs, texts = colliding(spark)
    made = Tokenizer.from_file(packing.default_tokenizer())
    for row in packing.tokenized_pieces(docs, tokenizer=packing.default_tokenizer(), size=1 << 20).collect():
        ids = [*made.encode(texts[row.doc_id], add_special_tokens=False).ids, 0]
        assert row.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_samples_of_colliding_words_spell_their_texts(spark):
    docs, _ = colliding(spark)
    rows = sentencepiece_sampling.sample_segmentations(docs, model=sentencepiece_sampling.default_model(), k=2, seed=1).collect()
    assert len(rows) == 18 and all(r.round_trip for r in rows)


def test_packing_takes_any_column_names(spark):
    rows = spark.createDataFrame([(1, "r", 5, 7), (2, None, None, 8), (3, "s", 6, 9)], "row long, lane string, length long, pack__id long")
    packed = {r["row"]: r for r in packing.best_fit_packing(rows, capacity=11).collect()}
    assert packed[1].sequence_id == packed[3].sequence_id and {packed[1].offset, packed[3].offset} == {0, 6}
    assert (packed[2].sequence_id, packed[2].offset, packed[2].lane) == (0, 0, None)
    with pytest.raises(ValueError, match="pack__row"):
        packing.best_fit_packing(rows.withColumnRenamed("row", "pack__row"), capacity=11)


def test_near_copies_of_colliding_words_do_not_link(spark):
    docs, texts = colliding(spark)
    found = {r.doc_id: r for r in ngram_join.ngram_components(docs, words=3, percent=90).collect()}
    assert all(found[i].component_id == min(j for j in texts if texts[j] == texts[i]) for i in texts)
