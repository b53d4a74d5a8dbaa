"""Queries and oracle SQL of this subpackage, by name."""

from __future__ import annotations

from tickloom.llm import chat_events, cuckoo_dedup, language_bayes, license_index, oracles, quality_fm, source_mix, spaced_seed, token_coder, token_groups, warc_index

QUERIES = {
    "op1_quality_fm": quality_fm.op1_quality_fm,
    "op2_chat_format": chat_events.op2_chat_format,
    "op3_language_id": language_bayes.op3_language_id,
    "op4_warc_archive": warc_index.op4_warc_archive,
    "op5_token_files": token_coder.op5_token_files,
    "op6_exact_dedup": cuckoo_dedup.op6_exact_dedup,
    "op7_spaced_seed_leaks": spaced_seed.op7_spaced_seed_leaks,
    "op8_jaccard_groups": token_groups.op8_jaccard_groups,
    "op9_licence_scan": license_index.op9_licence_scan,
    "op10_source_mix": source_mix.op10_source_mix,
}

ORACLES = {
    "op2_chat_format": chat_events.ORACLE,
    "op4_warc_archive": oracles.WARC,
    "op6_exact_dedup": cuckoo_dedup.ORACLE,
    "op8_jaccard_groups": oracles.JACCARD,
    "op9_licence_scan": license_index.oracle(),
    "op10_source_mix": oracles.MIX,
}
