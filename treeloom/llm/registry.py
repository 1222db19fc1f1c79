"""The queries of the corpus operators and their SQL."""

from __future__ import annotations

from treeloom.llm import chat, decontaminate, hosts, mixing, pii, quality, sharding, simhash, tokens, toxicity

MODULES = (toxicity, tokens, pii, chat, mixing, hosts, quality, decontaminate, simhash, sharding)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
