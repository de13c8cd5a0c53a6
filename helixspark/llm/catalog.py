"""The queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from . import alignment, credentials, decontaminate, language_model, licenses, packing, ranked, resampling, search, simhash, suffixes, token_counts, toxicity


def queries() -> dict:
    return {
        "op1_token_counts": token_counts.op1_token_counts,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_license_scans": licenses.op3_license_scans,
        "op4_best_fit_packing": packing.op4_best_fit_packing,
        "op5_lm_scoring": language_model.op5_lm_scoring,
        "op6_simhash_near_dedup": simhash.op6_simhash_near_dedup,
        "op7_suffix_dedup": suffixes.op7_suffix_dedup,
        "op8_bm25_top_k": search.op8_bm25_top_k,
        "op9_quality_resampling": resampling.op9_quality_resampling,
        "op10_decontamination": decontaminate.op10_decontamination,
        "op11_secret_scans": credentials.op11_secret_scans,
        "op12_token_alignment": alignment.op12_token_alignment,
        "op13_ranked_search": ranked.op13_ranked_search,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_license_scans": licenses.op3_sql(), "op13_ranked_search": ranked.op13_sql()}
