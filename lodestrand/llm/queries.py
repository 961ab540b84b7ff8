"""The corpus operators' queries, each over its whole table, and their SQL."""

from __future__ import annotations

from . import chat_format, digest_index, hamming_search, hash_tree, line_crf, ngram_join, part_codes, piece_codec, source_mix, suffix_dedup, token_alignment, token_count, warc_bundles

QUERIES = {
    "op1_token_counts": token_count.op1_token_counts,
    "op2_hash_tree_shards": hash_tree.op2_hash_tree_shards,
    "op3_chat_format": chat_format.op3_chat_format,
    "op4_ngram_jaccard_join": ngram_join.op4_ngram_jaccard_join,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_line_crf_quality": line_crf.op6_line_crf_quality,
    "op7_hamming_topk": hamming_search.op7_hamming_topk,
    "op8_exact_dedup": digest_index.op8_exact_dedup,
    "op9_piece_codec": piece_codec.op9_piece_codec,
    "op10_source_mix": source_mix.op10_source_mix,
    "op11_warc_bundles": warc_bundles.op11_warc_bundles,
    "op12_part_codes": part_codes.op12_part_codes,
    "op13_token_alignment": token_alignment.op13_token_alignment,
}

SQL = {
    "op2_hash_tree_shards": hash_tree.oracle(),
    "op3_chat_format": chat_format.oracle(),
    "op7_hamming_topk": hamming_search.OP7_SQL,
    "op8_exact_dedup": digest_index.OP8_SQL,
    "op10_source_mix": source_mix.OP10_SQL,
    "op11_warc_bundles": warc_bundles.OP11_SQL,
    "op12_part_codes": part_codes.oracle(),
}
