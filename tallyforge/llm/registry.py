"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from tallyforge.llm import backoff, bpe, collocations, lines, minhash, mixing, pii, prefix_trie, quality, sharding, suffixes, token_counts, winnowing

QUERIES = {
    "op1_winnowing": winnowing.query,
    "op2_suffix_levels": suffixes.query,
    "op3_minhash_bayes": minhash.query,
    "op4_pii": pii.query,
    "op5_fuzzy_lines": lines.query,
    "op6_extendible_sharding": sharding.query,
    "op7_byte_bpe": bpe.query,
    "op8_temperature_mixing": mixing.query,
    "op9_quality_rules": quality.query,
    "op10_separator_scan": token_counts.query,
    "op11_prefix_trie": prefix_trie.query,
    "op12_backoff_scores": backoff.query,
    "op13_collocations": collocations.query,
    # Parts of operators that SQL can say, and a limit at which the test tables are split.
    "shards_of_64_kib": sharding.small_query,
    "pii_base": pii.base_query,
    "quality_base": quality.base_query,
    "backoff_base": backoff.base_query,
}

ORACLES: dict[str, str] = {
    "op2_suffix_levels": suffixes.ORACLE,
    "op3_minhash_bayes": minhash.ORACLE,
    "op5_fuzzy_lines": lines.ORACLE,
    "op6_extendible_sharding": sharding.ORACLE,
    "op8_temperature_mixing": mixing.ORACLE,
    "op11_prefix_trie": prefix_trie.ORACLE,
    "op13_collocations": collocations.ORACLE,
    "shards_of_64_kib": sharding.ORACLE.replace(str(sharding.LIMIT), str(sharding.SMALL_LIMIT)),
    "pii_base": pii.BASE_ORACLE,
    "quality_base": quality.BASE_ORACLE,
    "backoff_base": backoff.BASE_ORACLE,
}
