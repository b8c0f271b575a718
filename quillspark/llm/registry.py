"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import decontaminate, html, knn, language, merkle, negatives, packing, quality, sharding, simhash, suffixes, token_files, transducer

QUERIES = {
    f.__name__: f
    for f in (
        packing.op1_best_fit_packing,
        token_files.op2_token_binary_output,
        suffixes.op3_suffix_array_dedup,
        sharding.op4_sharding,
        simhash.op5_simhash_near_dedup,
        quality.op6_quality_classifier,
        html.op7_html_extraction,
        decontaminate.op8_benchmark_decontamination,
        knn.op9_exact_topk,
        language.op10_language_id,
        merkle.op11_merkle_manifest,
        negatives.op12_hard_negatives,
        transducer.op13_bpe_transducer,
    )
}
ORACLES = {"op8_benchmark_decontamination": decontaminate.OP8_SQL, "op9_exact_topk": knn.OP9_SQL, "op11_merkle_manifest": merkle.OP11_SQL, "op12_hard_negatives": negatives.OP12_SQL}
