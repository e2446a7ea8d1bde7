"""Queries of this subpackage, and SQL for those that SQL can express."""

from lodestone.llm import alignment, bestfit, exact_dedup, importance, packing, pieces, simhash, substrings, token_counts, topk, toxicity, urls, warc

QUERIES = {
    "op1_sentencepiece": pieces.op1_sentencepiece,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_warc": warc.op3_warc,
    "op4_topk": topk.op4_topk,
    "op5_simhash": simhash.op5_simhash,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_url_filters": urls.op8_url_filters,
    "op9_packing": packing.op9_packing,
    "op10_substrings": substrings.op10_substrings,
    "op11_alignment": alignment.op11_alignment,
    "op12_best_fit": bestfit.op12_best_fit,
    "op13_importance": importance.op13_importance,
}

ORACLE_SQL = {
    "op3_warc": warc.SQL,
    "op4_topk": topk.SQL,
    "op6_exact_dedup": exact_dedup.SQL,
    "op8_url_filters": urls.SQL,
    "op10_substrings": substrings.SQL,
    "op13_importance": importance.SQL,
}
