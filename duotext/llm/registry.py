"""Queries of this package and their SQL."""

from __future__ import annotations

from . import centroids, chat, exact, lines, mixing, neardup, ngramjoin, packing, passages, quality, tokens, urls, whitening

QUERIES = {
    "op1_packing": packing.query_packing,
    "op2_mixing": mixing.query_mixing,
    "op3_urls": urls.query_urls,
    "op4_line_dedup": lines.query_line_dedup,
    "op5_passages": passages.query_passages,
    "op6_token_counts": tokens.query_token_counts,
    "op7_chat": chat.query_chat,
    "op8_quality": quality.query_quality,
    "op9_near_dedup": neardup.query_near_dedup,
    "op10_exact_dedup": exact.query_exact_dedup,
    "op11_ngram_join": ngramjoin.query_ngram_join,
    "op12_centroids": centroids.query_centroids,
    "op13_whitening": whitening.query_whitening,
}

ORACLES = {
    "op2_mixing": mixing.SQL_MIXING,
    "op3_urls": urls.SQL_URLS,
    "op4_line_dedup": lines.SQL_LINE_DEDUP,
    "op7_chat": chat.SQL_CHAT,
    "op9_near_dedup": neardup.SQL_NEAR_DEDUP,
    "op10_exact_dedup": exact.SQL_EXACT_DEDUP,
    "op11_ngram_join": ngramjoin.SQL_NGRAM_JOIN,
    "op12_centroids": centroids.SQL_CENTROIDS,
}
