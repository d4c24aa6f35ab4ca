"""The queries of this subpackage, one for each operator, and the pipeline."""

from __future__ import annotations

from palimpsest.llm import bpe, chat, codebooks, decontam, lmscore, neardup_texts, neardup_vectors, quality, substrings, tokenpairs, toxicity, urlfilter, warc

MODULES = [bpe, warc, chat, decontam, lmscore, neardup_texts, neardup_vectors, quality, substrings, toxicity, tokenpairs, codebooks, urlfilter]


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
