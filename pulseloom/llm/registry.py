"""Queries of this subpackage, by name, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from . import decontam, langid, mtree, packing, pii, secrets, sharding, simhash, tokencount, warc

QUERIES = {
    "op1_bm25_packing": packing.op1_bm25_packing,
    "op2_wu_manber_decontamination": decontam.op2_wu_manber_decontamination,
    "op3_grammar_secrets": secrets.op3_grammar_secrets,
    "op4_mtree_top_k": mtree.op4_mtree_top_k,
    "op5_arc_to_warc": warc.op5_arc_to_warc,
    "op6_pretoken_counts": tokencount.op6_pretoken_counts,
    "op7_hypergeometric_shards": sharding.op7_hypergeometric_shards,
    "op8_gray_simhash": simhash.op8_gray_simhash,
    "op9_boosted_pii": pii.op9_boosted_pii,
    "op10_naive_bayes_language": langid.op10_naive_bayes_language,
}

ORACLES: dict[str, str] = {
    "op2_wu_manber_decontamination": decontam.ORACLE,
    "op4_mtree_top_k": mtree.ORACLE,
    "op5_arc_to_warc": warc.oracle(),
}
