"""All queries of the library but the llm ones, and their SQL."""

from cratelake import ledger_queries, plan_queries, queries, review_queries

QUERIES = queries.QUERIES | review_queries.QUERIES | plan_queries.QUERIES | ledger_queries.QUERIES
ORACLE_SQL = queries.ORACLE_SQL | review_queries.ORACLE_SQL | plan_queries.ORACLE_SQL | ledger_queries.ORACLE_SQL
