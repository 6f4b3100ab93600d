"""Queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leafgrove.llm.bpe_codec import op2_bpe_codec
from leafgrove.llm.curve_packing import op5_curve_packing
from leafgrove.llm.embedding_dedup import OP10_SQL, op10_embedding_dedup
from leafgrove.llm.host_quality import OP8_SQL, op8_host_quality
from leafgrove.llm.line_dedup import op7_line_dedup
from leafgrove.llm.ngram_join import OP9_SQL, op9_ngram_join
from leafgrove.llm.suffix_tree_lm import op4_suffix_tree_lm
from leafgrove.llm.token_counts import op6_token_counts
from leafgrove.llm.toxicity import op1_toxicity
from leafgrove.llm.url_reputation import OP3_SQL, op3_url_reputation

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_bpe_codec": op2_bpe_codec,
    "op3_url_reputation": op3_url_reputation,
    "op4_suffix_tree_lm": op4_suffix_tree_lm,
    "op5_curve_packing": op5_curve_packing,
    "op6_token_counts": op6_token_counts,
    "op7_line_dedup": op7_line_dedup,
    "op8_host_quality": op8_host_quality,
    "op9_ngram_join": op9_ngram_join,
    "op10_embedding_dedup": op10_embedding_dedup,
}

ORACLE_SQL: dict[str, str] = {"op3_url_reputation": OP3_SQL, "op8_host_quality": OP8_SQL, "op9_ngram_join": OP9_SQL, "op10_embedding_dedup": OP10_SQL}
