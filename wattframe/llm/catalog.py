"""Registered text queries and, where SQL can state them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wattframe.llm import decontaminate, jaccard, lines, manifest, mixing, pii, quotes, rans, repeats, rules, spelling, tokens, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": toxicity.query,
    "op2_rans_tokens": rans.query,
    "op3_maximal_repeats": repeats.query,
    "op4_quotation_links": quotes.query,
    "op5_string_tiling": decontaminate.query,
    "op6_raked_mixing": mixing.query,
    "op7_quality_rules": rules.query,
    "op8_jaccard_join": jaccard.query,
    "op9_skip_chain_pii": pii.query,
    "op10_token_counts": tokens.query,
    "op11_merkle_manifest": manifest.query,
    "op12_line_dedup": lines.query,
    "op13_spelling_variants": spelling.query,
}
ORACLES: dict[str, str] = {
    "op6_raked_mixing": mixing.SQL,
    "op7_quality_rules": rules.SQL,
    "op8_jaccard_join": jaccard.SQL,
    "op11_merkle_manifest": manifest.SQL,
    "op12_line_dedup": lines.SQL,
    "op13_spelling_variants": spelling.SQL,
}
