"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import context_mixing, decontamination, divergence, language, licenses, packing, pii, quality_model, quality_rules, shingle_join, simhash, spelling, token_counts

QUERIES = {
    "op1_pii": pii.query,
    "op2_token_counts": token_counts.query,
    "op3_simhash": simhash.query,
    "op4_language": language.query,
    "op5_licenses": licenses.query,
    "op6_decontamination": decontamination.query,
    "op7_quality_model": quality_model.query,
    "op8_quality_rules": quality_rules.query,
    "op9_context_mixing": context_mixing.query,
    "op10_packing": packing.query,
    "op11_shingle_join": shingle_join.query,
    "op12_spelling": spelling.query,
    "op13_divergence": divergence.query,
}
ORACLES = {"op5_licenses": licenses.ORACLE, "op8_quality_rules": quality_rules.ORACLE, "op11_shingle_join": shingle_join.ORACLE, "op13_divergence": divergence.ORACLE}
