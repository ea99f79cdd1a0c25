"""The queries of this subpackage and their oracles, for the registry at the repository's top."""

from __future__ import annotations

from . import alignment, chat, decontaminate, iblt, langid, negatives, ngram, packing, simhash, suffix, tokencounts, urlfilter, warc

_MODULES = {
    "op1_elias_fano_lm": ngram,
    "op2_winnowing_decontamination": decontaminate,
    "op3_prefix_free_suffix": suffix,
    "op4_hierarchical_packing": packing,
    "op5_simhash_pivots": simhash,
    "op6_content_addressed_warc": warc,
    "op7_url_rules": urlfilter,
    "op8_bigru_language": langid,
    "op9_invertible_bloom": iblt,
    "op10_prefix_target_chat": chat,
    "op11_digest_cache_counts": tokencounts,
    "op12_hashed_pair_alignment": alignment,
    "op13_one_bit_negatives": negatives,
}


def queries() -> dict:
    return {name: module.query for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.ORACLE for name, module in _MODULES.items() if hasattr(module, "ORACLE")}
