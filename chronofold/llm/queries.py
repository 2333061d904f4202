"""The queries of this package and the SQL they are held against."""

from __future__ import annotations

from . import bpe, langid, licences, lmscore, mixing, ngramjoin, syncmers, topk, toxicity, urls

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_byte_bpe": bpe.op2_byte_bpe,
    "op3_url_filter": urls.op3_url_filter,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_syncmers": syncmers.op5_syncmers,
    "op6_ngram_jaccard": ngramjoin.op6_ngram_jaccard,
    "op7_top_k": topk.op7_top_k,
    "op8_lm_score": lmscore.op8_lm_score,
    "op9_language_id": langid.op9_language_id,
    "op10_licence_scan": licences.op10_licence_scan,
}

ORACLES = {
    "op1_mix_sources": mixing.ORACLE_SQL,
    "op3_url_filter": urls.ORACLE_SQL,
    "op6_ngram_jaccard": ngramjoin.ORACLE_SQL,
    "op7_top_k": topk.ORACLE_SQL,
    "op10_licence_scan": licences.ORACLE_SQL,
}
