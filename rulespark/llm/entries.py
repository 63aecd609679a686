"""The queries of this folder and their SQL."""

from __future__ import annotations

from . import decontaminate, langid, licenses, lmscore, nearest, ngram_join, packing, preference, sharding, toxicity


def queries() -> dict:
    return {
        "op1_license_scan": licenses.query,
        "op2_ngram_jaccard_join": ngram_join.query,
        "op3_benchmark_decontamination": decontaminate.query,
        "op4_lm_scoring": lmscore.query,
        "op5_packing": packing.query,
        "op6_toxicity": toxicity.query,
        "op7_language_id": langid.query,
        "op8_sharding": sharding.query,
        "op9_chat_formatting": preference.query,
        "op10_nearest_neighbours": nearest.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": licenses.sql(),
        "op9_chat_formatting": preference.SQL,
    }
