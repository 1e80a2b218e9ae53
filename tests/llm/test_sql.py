"""The queries against their SQL, over the smallest tables and over fixtures that have what these lack."""

import hashlib

import duckdb
import numpy as np
import pytest

from callgrove.llm import registry, suffix_dedup


def same(got, want):
    key = lambda rows: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows), key=repr)
    assert key(got) == key(want)


@pytest.mark.parametrize("name", list(registry.SQL))
def test_queries(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    frame = registry.QUERIES[name](spark, sf_dir)
    same([tuple(r) for r in frame.collect()], con.execute(f"select {', '.join(frame.columns)} from ({registry.SQL[name]})").fetchall())


def test_linked_vectors(spark, tmp_path):
    """Families of near copies, copies, and vectors that can't be compared; the tables have no links."""
    rng = np.random.default_rng(2)
    x = [c + rng.normal(size=16) * s for c in rng.normal(size=(12, 16)) for s in rng.uniform(0, 0.3, 15)]
    rows = [(i, [float(v) for v in e], 0) for i, e in enumerate([*x, x[0], x[0]])] + [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    frame = registry.QUERIES["op9_pivot_permutation_dedup"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = con.execute(f"select {', '.join(frame.columns)} from ({registry.SQL['op9_pivot_permutation_dedup']})").fetchall()
    assert sum(r[1] for r in want) > 500
    same([tuple(r) for r in frame.collect()], want)


def test_repeats_that_split_characters(spark, tmp_path):
    """Repeated runs that begin and end inside characters, side by side, in one text twice, and in copies."""
    rng = np.random.default_rng(5)
    prose = "".join(rng.choice(list("aé日🙂 "), 900).tolist())
    rows = [(1, "x" + prose), (2, "ç" + prose[:500] + "語"), (3, prose[300:] + prose[300:]), (4, "ab" * 700), (5, None), (6, ""), (7, "same " * 200), (8, "same " * 200), (9, prose[10:150])]
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    frame = suffix_dedup.op6(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    same([tuple(r) for r in frame.collect()], con.execute(f"select {', '.join(frame.columns)} from ({suffix_dedup.OP6_SQL})").fetchall())


def test_planted_passages(spark, tmp_path):
    """Passages of over 50 words that unlike documents share: those of 400 bytes and more go, shorter ones and clean documents stay whole."""
    rng = np.random.default_rng(6)
    prose = lambda n: " ".join("".join(rng.choice(list("abcdefghijklmnop"), 5)) for _ in range(n // 6 + 2))[:n]
    texts, gone = {}, {}
    for size in (320, 399, 400, 401, 900):
        passage = prose(size - 1) + "."
        assert len(passage.split()) > 50
        for mark in "ABCDE":  # unlike bytes on both sides, so that the repeat is the passage alone
            before, after = prose(int(rng.integers(0, 1500))) + mark, mark + prose(int(rng.integers(0, 1500)))
            k = len(texts)
            texts[k], gone[k] = before + passage + after, passage if size >= 400 else ""
    for k in range(100, 110):
        texts[k], gone[k] = prose(1500), ""
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in suffix_dedup.op6(spark, str(tmp_path)).collect()}
    assert got.keys() == texts.keys()
    for k, t in texts.items():
        kept = t.replace(gone[k], "") if gone[k] else t
        want = len(t), len(gone[k]), int(bool(gone[k])), hashlib.sha256(kept.encode()).hexdigest(), kept
        assert (got[k].n_bytes, got[k].n_removed, got[k].n_spans, got[k].kept_sha256, got[k].text) == want
