"""Toxicity by a classifier chain: categories are predicted one after the other, and later models see earlier ones' probabilities.

The categories are label columns, in the order of the chain. Each has a logistic model over hashed words and bins of how
the text is written; from the second on, its inputs include the earlier categories' log-odds. While fitting, these come
out-of-fold: from models that didn't see the row, so a later model learns from the same kind of input it gets when
predicting. Fitting uses at most ``max_rows`` labelled rows (those with the least hash of their id; the only bound, a
parameter); predicting is one scan of whole texts without a shuffle.

Edge cases. Null and empty texts have no words: they get the models' intercepts. Labels that are null, or of unknown documents,
are left out; of repeated labels the greatest holds. Without labels, or with one class only, the prior is predicted. Repeated rows
are scored each. Added columns start with ``tox_``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .linear import Chain, labelled_sample, with_probabilities

MAX_ROWS = 12_000
#: The labels' table has quality and toxic; low quality comes first in the chain.
CATEGORIES = ["low_quality", "toxic"]


def chain_labels(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")


def toxicity(docs: DataFrame, labels: DataFrame, *, categories: list[str], reject: str, threshold: float = 0.5, max_rows: int = MAX_ROWS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with tox_<category> for each category, and tox_rejected: is that of ``reject`` at the threshold or above?"""
    docs = docs.drop("tox_rejected", *[f"tox_{c}" for c in categories])
    rows, buckets, targets = labelled_sample(docs, labels, categories, max_rows=max_rows, text=text, doc_id=doc_id)
    chain = Chain().fit(rows, buckets, targets)
    scored = with_probabilities(docs, chain, [f"tox_{c}" for c in categories], text=text)
    return scored.withColumn("tox_rejected", F.col(f"tox_{reject}") >= threshold)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = chain_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = toxicity(docs, labels, categories=CATEGORIES, reject="toxic")
    return out.select("doc_id", F.col("tox_low_quality").alias("p_low_quality"), F.col("tox_toxic").alias("p_toxic"), F.col("tox_rejected").alias("toxic"))
