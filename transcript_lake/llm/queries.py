"""The registered queries of this subpackage, and DuckDB SQL where it can express them."""

from __future__ import annotations

from transcript_lake.llm import binary, chains, counts, flac, html, jaccard, merkle, mixing, packing, pii, pitman_yor, resampling, rules

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_flac": flac.op2_flac,
    "op3_packing": packing.op3_packing,
    "op4_chains": chains.op4_chains,
    "op5_jaccard": jaccard.op5_jaccard,
    "op6_binary": binary.op6_binary,
    "op7_counts": counts.op7_counts,
    "op8_html": html.op8_html,
    "op9_rules": rules.op9_rules,
    "op10_mixing": mixing.op10_mixing,
    "op11_pitman_yor": pitman_yor.op11_pitman_yor,
    "op12_merkle": merkle.op12_merkle,
    "op13_resampling": resampling.op13_resampling,
}
ORACLES = {"op9_rules": rules.ORACLE, "op10_mixing": mixing.ORACLE, "op12_merkle": merkle.ORACLE, "op13_resampling": resampling.ORACLE}
