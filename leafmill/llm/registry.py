"""The queries of this subpackage and the SQL that checks them, by name."""

from __future__ import annotations

from . import chat_format, exact_dedup, mixing, ngram_join, quality_classifier, quality_rules, sentencepiece_codec, sharding, site_style, toxicity

QUERIES = {
    "op1_ngram_jaccard_join": ngram_join.op1_ngram_jaccard_join,
    "op2_sentencepiece": sentencepiece_codec.op2_sentencepiece,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_mixing": mixing.op4_mixing,
    "op5_quality_classifier": quality_classifier.op5_quality_classifier,
    "op6_sharding": sharding.op6_sharding,
    "op7_chat_format": chat_format.op7_chat_format,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_html_extraction": site_style.op9_html_extraction,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
}

#: Where SQL cannot express a query (it searches, draws or learns), tests/llm compares it with brute force instead.
ORACLE_SQL = {
    "op7_chat_format": chat_format.ORACLE_SQL,
    "op10_exact_dedup": exact_dedup.ORACLE_SQL,
}
