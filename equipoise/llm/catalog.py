"""Registered corpus queries and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from equipoise.llm import (
    alignment, bpe, exact_dedup, fill_middle, language_id, maxscore, mixing, ngram_join, packing, suffix_tree, toxicity, url_filter,
    warc)

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_suffix_tree": suffix_tree.op3_suffix_tree,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_language_id": language_id.op5_language_id,
    "op6_maxscore": maxscore.op6_maxscore,
    "op7_bpe": bpe.op7_bpe,
    "op8_ngram_join": ngram_join.op8_ngram_join,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_mixing": mixing.op10_mixing,
    "op11_packing": packing.op11_packing,
    "op12_alignment": alignment.op12_alignment,
    "op13_fill_middle": fill_middle.op13_fill_middle,
}

SQL = {
    "op1_warc": warc.SQL,
    "op2_exact_dedup": exact_dedup.SQL,
    "op6_maxscore": maxscore.SQL,
    "op9_url_filter": url_filter.SQL,
    "op13_fill_middle": fill_middle.SQL,
}
