"""All registered queries of the document engine and their DuckDB twins."""

from __future__ import annotations

from folioflow.plans import history_queries, relational_queries, retrieval_queries, stream_queries, text_queries

TOPICS = (history_queries, retrieval_queries, relational_queries, text_queries, stream_queries)


def flagship(spark, sf_dir):
    return retrieval_queries.Q["RET6_hybrid_search"](spark, sf_dir)


def queries():
    return {name: f for topic in TOPICS for name, f in topic.Q.items()}


def oracle_sql():
    return {name: sql for topic in TOPICS for name, sql in topic.S.items()}
