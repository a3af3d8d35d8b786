"""The queries of this subpackage, by name, and their SQL where it can express them."""

from __future__ import annotations

from . import chat, hilbert, language, licences, mixing, packing, phrases, quality, repair, simhash, substring, toxicity, warc

QUERIES = {
    "op1_revisit_resolution": warc.op1_revisit_resolution,
    "op2_subsequence_kernel_toxicity": toxicity.op2_subsequence_kernel_toxicity,
    "op3_preference_formatting": chat.op3_preference_formatting,
    "op4_exact_complement_packing": packing.op4_exact_complement_packing,
    "op5_hilbert_neighbours": hilbert.op5_hilbert_neighbours,
    "op6_simhash_near_dedup": simhash.op6_simhash_near_dedup,
    "op7_weak_supervision_quality": quality.op7_weak_supervision_quality,
    "op8_licence_digests": licences.op8_licence_digests,
    "op9_seed_extend_substring_dedup": substring.op9_seed_extend_substring_dedup,
    "op10_curriculum_mix": mixing.op10_curriculum_mix,
    "op11_debruijn_collocations": phrases.op11_debruijn_collocations,
    "op12_nearest_centroid_language": language.op12_nearest_centroid_language,
    "op13_run_length_conversation_repair": repair.op13_run_length_conversation_repair,
}

ORACLE_SQL: dict[str, str] = {
    "op1_revisit_resolution": warc.ORACLE,
    "op3_preference_formatting": chat.ORACLE,
    "op8_licence_digests": licences.ORACLE,
    "op10_curriculum_mix": mixing.ORACLE,
    "op11_debruijn_collocations": phrases.ORACLE,
}
