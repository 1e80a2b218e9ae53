"""From documents to packed training sequences: the stages of a small corpus pipeline.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all that its predecessor kept; its decisions take effect, and all
but the last return the columns of ``docs``. Columns that a stage doesn't know pass through it.

1. toxicity: documents that the classifier chain rejects go.
2. exact_dedup: of equal texts the one with the smallest id stays.
3. ngram_jaccard_join: of documents linked by five-word shingles at a similarity of 0.8 the one with the smallest id stays.
4. suffix_array_dedup: passages of ``PASSAGE_BYTES`` bytes or more that also start elsewhere are cut out (a document can become empty).
5. best_fit_packing: token ids in pieces with their place in sequences of 2048; ``packing.packed_sequences`` puts a sequence together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callgrove.llm.common import Stages
from callgrove.llm.exact_dedup import exact_dedup
from callgrove.llm.ngram_join import ngram_components
from callgrove.llm.packing import best_fit_packing, default_tokenizer, tokenized_pieces
from callgrove.llm.suffix_dedup import suffix_dedup
from callgrove.llm.toxicity import CATEGORIES, chain_labels, toxicity

#: Bytes of a repeated passage; fifty words of prose have more.
PASSAGE_BYTES = 200


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the chain doesn't call toxic. Null and empty texts have no toxic words and stay; repeated rows share their fate; without labels nothing is rejected unless half or more of all is toxic by prior."""
    labels = chain_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity(docs, labels, categories=CATEGORIES, reject="toxic").where("not tox_rejected").select(docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text (white space folded), that with the smallest id; null ids come last, null text counts as empty, of repeated rows one stays."""
    return exact_dedup(docs).where("dedup_kept").select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each component of near copies. A document is its id: rows with the same id stay or go together, null ids as one. Texts without words link with nothing and stay."""
    found = ngram_components(docs, words=5, percent=80)
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the passages that also start elsewhere. Texts without such a passage, null ones too, stay as they are; n_chars follows the text. Repeated rows are copies of each other and lose what is long enough."""
    cut = suffix_dedup(docs, length=PASSAGE_BYTES)
    changed = F.size("suffix_spans") > 0
    new = {"text": F.when(changed, F.col("suffix_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("suffix_text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return cut.withColumns(new).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with token ids and places. Null and empty texts are the end token alone; repeated rows are packed each; null ids are allowed."""
    pieces = tokenized_pieces(docs, tokenizer=default_tokenizer(), size=2048, emit_ids=True)
    return best_fit_packing(pieces, capacity=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("best_fit_packing", pack),
]

#: The stages can't be told in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage gives is written to the shared folder and read again."""
    stages = Stages(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        now = stages.put(stage(spark, docs, sf_dir), name)
        stages.drop(docs)
        docs = now
    return STAGES[-1][1](spark, docs, sf_dir)
