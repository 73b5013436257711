"""The registered queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, fingerprints, language_id, licenses, mixing, ngram_join, quality_rules, suffix_dedup, toxicity, warc


def queries() -> dict:
    return {
        "op1_fingerprints": fingerprints.op1_fingerprints,
        "op2_bpe": bpe.op2_bpe,
        "op3_warc": warc.op3_warc,
        "op4_ngram_join": ngram_join.op4_ngram_join,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_quality_rules": quality_rules.op6_quality_rules,
        "op7_mixing": mixing.op7_mixing,
        "op8_license_scan": licenses.op8_license_scan,
        "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
        "op10_language_id": language_id.op10_language_id,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_license_scan": licenses.op8_sql()}
