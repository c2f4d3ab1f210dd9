"""Queries of the operators, with DuckDB statements where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from candlewright.llm import (
    bpe, contamination, grammar, hard_negatives, labelling, licenses, lines, periodic, simhash, substrings, suffix_arrays, topk, warc)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": substrings.op1_substring_dedup,
    "op2_line_dedup": lines.op2_line_dedup,
    "op3_quality_classifier": labelling.op3_quality_classifier,
    "op4_token_ids": grammar.op4_token_ids,
    "op7_bpe_encode_decode": bpe.op7_bpe_encode_decode,
    "op5_simhash_near_dedup": simhash.op5_simhash_near_dedup,
    "op6_warc": warc.op6_warc,
    "op8_license_scan": licenses.op8_license_scan,
    "op9_benchmark_decontamination": contamination.op9_benchmark_decontamination,
    "op10_exact_top_k": topk.op10_exact_top_k,
    "op11_periodic_runs": periodic.op11_periodic_runs,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_suffix_array_dedup": suffix_arrays.op13_suffix_array_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": substrings.OP1_SQL,
    "op6_warc": warc.OP6_SQL,
    "op8_license_scan": licenses.OP8_SQL,
    "op10_exact_top_k": topk.OP10_SQL,
    "op12_hard_negatives": hard_negatives.OP12_SQL,
}
