"""Registered queries over the given tables, and the DuckDB SQL that must agree with them."""

from __future__ import annotations


def queries() -> dict:
    from pagewarden.plans import box_queries, rule_queries, session_queries, text_queries

    return box_queries.QUERIES | session_queries.QUERIES | text_queries.QUERIES | rule_queries.QUERIES


def oracle_sql() -> dict:
    from pagewarden.plans import box_queries, rule_queries, session_queries, text_queries

    return box_queries.ORACLE_SQL | session_queries.ORACLE_SQL | text_queries.ORACLE_SQL | rule_queries.ORACLE_SQL
