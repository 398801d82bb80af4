"""All core queries with their oracle SQL."""

from __future__ import annotations

from tesselle.plans import analytics, answers, corpus, documents, indexed, more, relational, retrieval, status, surface, texts

MODULES = [analytics, relational, retrieval, documents, more, texts, indexed, status, answers, corpus, surface]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: x for m in MODULES for k, x in m.SQL.items()}
