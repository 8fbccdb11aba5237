"""Queries of this subpackage for the driver, with SQL where it can express them."""

from __future__ import annotations

import corpus_pipeline
from tessera.llm import bpe, clustering, divergence, html, language, licenses, packing, quality, secrets, simhash, token_counts, token_files, topk


def queries() -> dict:
    return {
        "op1_quality_rules": quality.op1_quality_rules,
        "op2_best_fit_packing": packing.op2_best_fit_packing,
        "op3_token_counts": token_counts.op3_token_counts,
        "op4_license_scans": licenses.op4_license_scans,
        "op5_byte_bpe": bpe.op5_byte_bpe,
        "op6_simhash": simhash.op6_simhash,
        "op7_token_files": token_files.op7_token_files,
        "op8_html_extraction": html.op8_html_extraction,
        "op9_top_k": topk.op9_top_k,
        "op10_secret_scans": secrets.op10_secret_scans,
        "op11_source_divergence": divergence.op11_source_divergence,
        "op12_language_id": language.op12_language_id,
        "op13_centroid_clusters": clustering.op13_centroid_clusters,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality.OP1_SQL,
        "op9_top_k": topk.OP9_SQL,
        "op10_secret_scans": secrets.OP10_SQL,
        "op11_source_divergence": divergence.OP11_SQL,
        "op13_centroid_clusters": clustering.OP13_SQL,
    }
