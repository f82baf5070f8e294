"""The registered queries of this subpackage, and their SQL where it exists."""

from __future__ import annotations

from taskwatch.llm import (audit, bpe, chat, decontaminate, importance, licenses, linedup, mixing, pages, quality, simjoin,
                           tokens, toxicity)
from taskwatch.llm.sql import ORACLE  # noqa: F401

QUERIES = {
    "op1_quality_rules": quality.query,
    "op2_license_scan": licenses.query,
    "op3_chat_format": chat.query,
    "op4_decontamination": decontaminate.query,
    "op5_mixing": mixing.query,
    "op6_line_dedup": linedup.query,
    "op7_token_counts": tokens.query,
    "op8_toxicity": toxicity.query,
    "op9_html_text": pages.query,
    "op10_ngram_jaccard": simjoin.query,
    "op11_filter_audit": audit.query,
    "op12_bpe_codec": bpe.query,
    "op13_importance": importance.query,
}

