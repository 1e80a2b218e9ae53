"""Queries and SQL of this subpackage, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conversation_repair, embedding_dedup, exact_dedup, hmm_lm, language_id, ngram_join, packing, preference, quality, sentencepiece_sampling, suffix_dedup, toxicity, vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_preference_format": preference.op1,
    "op2_quality_empirical_bayes": quality.op2,
    "op3_exact_dedup": exact_dedup.op3,
    "op4_best_fit_packing": packing.op4,
    "op5_ngram_jaccard_join": ngram_join.op5,
    "op6_suffix_array_dedup": suffix_dedup.op6,
    "op7_toxicity_chain": toxicity.op7,
    "op8_language_id": language_id.op8,
    "op9_pivot_permutation_dedup": embedding_dedup.op9,
    "op10_sentencepiece_gumbel": sentencepiece_sampling.op10,
    "op11_hidden_markov_scores": hmm_lm.op11,
    "op12_conversation_repair": conversation_repair.op12,
    "op13_yinyang_codebooks": vector_codes.op13,
}

SQL: dict[str, str] = {
    "op1_preference_format": preference.OP1_SQL,
    "op3_exact_dedup": exact_dedup.OP3_SQL,
    "op5_ngram_jaccard_join": ngram_join.OP5_SQL,
    "op6_suffix_array_dedup": suffix_dedup.OP6_SQL,
    "op9_pivot_permutation_dedup": embedding_dedup.OP9_SQL,
    "op13_yinyang_codebooks": vector_codes.OP13_SQL,
}
