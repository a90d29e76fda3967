"""Queries over the provided tables, one for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.llm.decontaminate import op1_spaced_seed_decontamination
from textloom.llm.jaccard_join import op4_token_group_join
from textloom.llm.language import op8_word_crf_language
from textloom.llm.line_rules import op7_line_crf_rules
from textloom.llm.mixing import op3_cube_mix
from textloom.llm.oracles import SQL
from textloom.llm.periodic import op13_all_lag_runs
from textloom.llm.quality_model import op6_attention_quality
from textloom.llm.sharding import op5_virtual_slots
from textloom.llm.substrings import op10_block_anchor_dedup
from textloom.llm.suffix_levels import op11_suffix_array_levels
from textloom.llm.url_filter import op2_segmented_url_bayes
from textloom.llm.whitening import op12_tsqr_jacobi_whitening
from textloom.llm.wrapper import op9_wrapper_extraction

_QUERIES = [
    op1_spaced_seed_decontamination, op2_segmented_url_bayes, op3_cube_mix, op4_token_group_join, op5_virtual_slots,
    op6_attention_quality, op7_line_crf_rules, op8_word_crf_language, op9_wrapper_extraction, op10_block_anchor_dedup,
    op11_suffix_array_levels, op12_tsqr_jacobi_whitening, op13_all_lag_runs,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query name to a function of (spark, sf_dir)."""
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL where an operator's result can be told by SQL on whole tables."""
    return dict(SQL)
