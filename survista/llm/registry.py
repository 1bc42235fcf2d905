"""Queries and SQL of the corpus operators, as __spark_entry__ adds them."""

from __future__ import annotations

from survista.llm import chat, html, mixing, neardup, packing, pii, quality, secrets, substrings, topk

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_top_k": topk.op2_top_k,
    "op3_jaccard_join": neardup.op3_jaccard_join,
    "op4_secret_scan": secrets.op4_secret_scan,
    "op5_chat_format": chat.op5_chat_format,
    "op6_pii_surrogates": pii.op6_pii_surrogates,
    "op7_packing": packing.op7_packing,
    "op8_repeated_substrings": substrings.op8_repeated_substrings,
    "op9_html_extraction": html.op9_html_extraction,
    "op10_mixing": mixing.op10_mixing,
}

ORACLE = {
    "op1_quality_rules": quality.oracle(),
    "op2_top_k": topk.ORACLE,
    "op3_jaccard_join": neardup.oracle(),
    "op5_chat_format": chat.ORACLE,
    "op8_repeated_substrings": substrings.oracle(),
    "op10_mixing": mixing.ORACLE,
}
