"""Quality by hierarchical empirical Bayes: a document classifier's evidence with the record of its host and of its path there.

Method. A logistic model over hashed words and writing habits gives each document's evidence. Every document then counts on its path and
host: with its label where it has one, else with the classifier's probability at a lower weight. Grouped sums (partial aggregation first,
so a host with a third of all rows arrives as a few rows) give each level's rate, shrunk towards the level above:

    host = (sum + k * global) / (weight + k)        path = (sum + k' * host) / (weight + k')

The strengths k and k' are estimated from the corpus by the method of moments: the less sites differ, the stronger the pull, and a sparse
site stays near its prior. A document's own part is taken out of its path and host before they judge it. Its posterior log-odds are
the classifier's log-odds, less the training prior's, plus the path posterior's: likelihood ratio times site prior.

Fitting uses at most ``max_rows`` labelled rows; all counts and strengths are over all documents. Sites meet documents in equi-joins by key.

Edge cases. Null text is empty; a null host or path is a site of its own. Documents without label count by the classifier. Null labels and labels of
unknown documents are left out, of repeated labels the greatest holds. Without any label the prior is one half. Repeated rows count each.
An empty table gives no rows. All columns of ``docs`` but the text stay; added columns start with ``quality_`` and replace none of other names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stages
from .linear import Chain, labelled_sample, with_probabilities

MAX_ROWS = 12_000


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _strength(sites: DataFrame, prior: Column) -> float:
    """How many rows the level above counts for, by the method of moments. sites: n (weight), s (sum) and what prior needs.

    Without differences between sites, the weighted spread of their rates around the prior has the mean sum(p (1 - p)); what it
    has beyond that comes from differences. One row of sums comes to the driver.
    """
    row = sites.agg(F.sum(F.pow(F.col("s") - F.col("n") * prior, 2) / F.col("n")).alias("spread"), F.sum(prior * (1 - prior)).alias("noise"), F.sum("n").alias("n"), F.avg(prior * (1 - prior)).alias("variance")).collect()[0]
    if not row.n:
        return 1.0
    between = max((row.spread - row.noise) / row.n, 1e-6)
    return min(max(row.variance / between - 1, 1.0), 1e6)


def site_posteriors(evidence: DataFrame) -> DataFrame:
    """(host, path, n, s, n_host, s_host, prior, k_host, k_path) from rows (host, path, y, w): all documents' evidence and weights."""
    paths = evidence.where("w > 0").groupBy("host", "path").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("y")).alias("s"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()[0]
    prior = ((total.s or 0) + 0.5) / ((total.n or 0) + 1)
    k_host = _strength(hosts, F.lit(prior))
    hosts = hosts.select(F.col("host").alias("h"), F.col("n").alias("n_host"), F.col("s").alias("s_host"), ((F.col("s") + k_host * prior) / (F.col("n") + k_host)).alias("p_host"))
    both = paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    k_path = _strength(both, F.col("p_host"))
    return both.select("host", "path", "n", "s", "n_host", "s_host", F.lit(prior).alias("prior"), F.lit(k_host).alias("k_host"), F.lit(k_path).alias("k_path"))


def quality(docs: DataFrame, labels: DataFrame, *, host: Column, path: Column, label: str = "quality", threshold: float = 0.5, soft_weight: float = 0.25, max_rows: int = MAX_ROWS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without its text, with quality_p_doc (classifier), quality_p_host, quality_p_path, quality_posterior and quality_keep.

    soft_weight: what a document without label counts for on its site.
    """
    stages = Stages(docs.sparkSession, "quality")
    added = ["quality_p_doc", "quality_p_host", "quality_p_path", "quality_posterior", "quality_keep"]
    docs = docs.drop(*added)
    base = [c for c in docs.columns if c != text]
    rows, buckets, targets = labelled_sample(docs, labels, [label], max_rows=max_rows, text=text, doc_id=doc_id)
    chain = Chain().fit(rows, buckets, targets)
    prior = (float(targets.sum()) + 0.5) / (len(targets) + 1)
    scored = with_probabilities(docs.withColumn("quality__host", host).withColumn("quality__path", path).select(*base, "quality__host", "quality__path", text), chain, ["quality_p_doc"], text=text).drop(text)
    known = labels.select(F.col(doc_id).alias("quality__id"), F.col(label).cast("double").alias("quality__label")).dropna().groupBy("quality__id").agg(F.max("quality__label").alias("quality__label"))
    scored = scored.join(known, F.col(doc_id) == F.col("quality__id"), "left").drop("quality__id")
    scored = scored.withColumn("quality__y", F.coalesce("quality__label", "quality_p_doc")).withColumn("quality__w", F.when(F.col("quality__label").isNull(), soft_weight).otherwise(1.0))
    scored = stages.put(scored, "scored")
    sites = stages.put(site_posteriors(scored.select(F.col("quality__host").alias("host"), F.col("quality__path").alias("path"), F.col("quality__y").alias("y"), F.col("quality__w").alias("w"))), "sites")
    sites = sites.select(*[F.col(c).alias(f"site__{c}") for c in sites.columns])
    joined = scored.join(sites, F.col("quality__host").eqNullSafe(F.col("site__host")) & F.col("quality__path").eqNullSafe(F.col("site__path")))
    site = lambda c: F.col(f"site__{c}")
    own_s, own_n = F.col("quality__w") * F.col("quality__y"), F.col("quality__w")  # out of what judges the document
    p_host = (site("s_host") - own_s + site("k_host") * site("prior")) / (site("n_host") - own_n + site("k_host"))
    joined = joined.withColumn("quality_p_host", p_host)
    p_path = (site("s") - own_s + site("k_path") * F.col("quality_p_host")) / (site("n") - own_n + site("k_path"))
    joined = joined.withColumn("quality_p_path", p_path)
    odds = _logit(F.col("quality_p_doc")) - _logit(F.lit(prior)) + _logit(F.col("quality_p_path"))
    joined = joined.withColumn("quality_posterior", 1 / (1 + F.exp(-odds)))
    return joined.withColumn("quality_keep", F.col("quality_posterior") >= threshold).select(*base, *added)


def url_site(url: Column) -> tuple[Column, Column]:
    """Host and path section of a URL, as ``host`` and ``path`` of ``quality``: the host in lower case without ``www.``, the path's first part (empty at the top). Null for what is no URL."""
    host = F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")
    return host, F.regexp_extract(F.try_parse_url(url, F.lit("PATH")), "^/([^/]*)", 1)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host: the document's source; path: its language section there (documents carry no URL)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = quality(docs, labels, host=F.col("source"), path=F.col("lang"))
    return out.select("doc_id", F.col("quality_p_doc").alias("p_doc"), F.col("quality_p_host").alias("p_host"), F.col("quality_p_path").alias("p_path"), F.col("quality_posterior").alias("posterior"), F.col("quality_keep").alias("keep"))
