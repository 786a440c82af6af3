"""The queries of this subpackage, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from . import bpe_codec, embedding_dedup, license_scan, packing, quality_rules, simhash_dedup, source_mixing, suffix_dedup, token_counts, url_filter

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_license_scan": license_scan.op2_license_scan,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_source_mixing": source_mixing.op4_source_mixing,
    "op5_packed_rows": packing.op5_packed_rows,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_simhash_dedup": simhash_dedup.op7_simhash_dedup,
    "op8_embedding_dedup": embedding_dedup.op8_embedding_dedup,
    "op9_bpe_codec": bpe_codec.op9_bpe_codec,
    "op10_token_counts": token_counts.op10_token_counts,
}

SQL = {"op1_quality_rules": quality_rules.SQL, "op6_url_filter": url_filter.SQL}
