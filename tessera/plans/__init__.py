"""Queries by name, each with the SQL that says the same where SQL can."""

from __future__ import annotations


def catalog() -> dict:
    """name -> (query, SQL or None)."""
    from . import relation_queries, report_queries, rule_queries, score_queries, statistic_queries, stream_queries, study_queries, tensor_queries, text_queries

    out: dict = {}
    for module in (text_queries, rule_queries, relation_queries, statistic_queries, score_queries, report_queries, stream_queries, tensor_queries, study_queries):
        out |= module.QUERIES
    return out
