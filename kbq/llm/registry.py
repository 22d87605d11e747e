"""The registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from kbq.llm import chat_format, decontaminate, embedding_dups, html_extract, merkle, quality_rules, secret_scan, sentencepiece_bpe, simhash, substring_dedup, token_files, toxicity, whitening

_MODULES = [chat_format, decontaminate, embedding_dups, html_extract, merkle, quality_rules, secret_scan, sentencepiece_bpe, simhash, substring_dedup, token_files, toxicity, whitening]


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in vars(m).items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in getattr(m, "ORACLE_SQL", {}).items()}
