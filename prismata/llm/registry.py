"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from prismata.llm import bpe, decontam, extract, fixity, langid, lm, minhash, quality, simhash, suffixdedup, trie, urlgraph, whiten


def queries() -> dict:
    return {"op1_langid": langid.op1_langid, "op2_suffix_dedup": suffixdedup.op2_suffix_dedup, "op3_url_graph": urlgraph.op3_url_graph, "op4_extract": extract.op4_extract, "op5_merkle_fixity": fixity.op5_merkle_fixity, "op6_simhash": simhash.op6_simhash, "op7_decontam": decontam.op7_decontam, "op8_bpe": bpe.op8_bpe, "op9_lm_score": lm.op9_lm_score, "op10_quality_rules": quality.op10_quality_rules, "op11_minhash": minhash.op11_minhash, "op12_prefix_trie": trie.op12_prefix_trie, "op13_whiten": whiten.op13_whiten}


def oracle_sql() -> dict[str, str]:
    return {"op3_url_graph": urlgraph.oracle(), "op5_merkle_fixity": fixity.ORACLE, "op7_decontam": decontam.ORACLE, "op10_quality_rules": quality.oracle(), "op12_prefix_trie": trie.ORACLE}
