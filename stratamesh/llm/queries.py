"""The queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

from . import decontaminate, jaccard, language, media, packing, pii, pitman_yor, sharding, substrings, url_filter

QUERIES = {
    "op1_language_id": language.op1_language_id,
    "op2_suffix_array_dedup": substrings.op2_suffix_array_dedup,
    "op3_media_chunks": media.op3_media_chunks,
    "op4_pitman_yor": pitman_yor.op4_pitman_yor,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_ngram_jaccard_join": jaccard.op7_ngram_jaccard_join,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_pii": pii.op9_pii,
    "op10_feistel_sharding": sharding.op10_feistel_sharding,
}

SQL = {
    "op5_decontaminate": decontaminate.SQL,
    "op6_url_filter": url_filter.SQL,
    "op7_ngram_jaccard_join": jaccard.SQL,
}
