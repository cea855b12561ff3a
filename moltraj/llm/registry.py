"""The queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from moltraj.llm import (
    decontaminate, line_dedup, packing, pages, periodic_runs, personal_data, quality, simhash, token_counts, token_store, top_products,
    toxicity, whitening,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        quality.op1_likelihood_ratio, token_counts.op2_whole_token_counts, pages.op3_template_slots, toxicity.op4_weak_supervision,
        simhash.op5_covering_simhash,
        line_dedup.op6_fuzzy_lines,
        personal_data.op7_anchor_expansion, decontaminate.op8_benchmark_windows, token_store.op9_orc_token_store,
        packing.op10_minimum_bin_slack, top_products.op11_norm_sorted_products, whitening.op12_spectral_whitening,
        periodic_runs.op13_recoloured_runs,
    )
}
ORACLES: dict[str, str] = {
    "op8_benchmark_windows": decontaminate.ORACLE_SQL, "op11_norm_sorted_products": top_products.ORACLE_SQL,
}
