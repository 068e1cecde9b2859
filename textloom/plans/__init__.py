"""One query for each operator, with SQL that gives the same rows where SQL can."""

from . import generation_queries, relational_queries, source_queries, text_queries

QUERIES = text_queries.QUERIES | relational_queries.QUERIES | source_queries.QUERIES | generation_queries.QUERIES
ORACLES = text_queries.ORACLES | relational_queries.ORACLES | source_queries.ORACLES

__all__ = ["ORACLES", "QUERIES"]
