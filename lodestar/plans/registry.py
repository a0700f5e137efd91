"""All registered queries and their SQL."""

from lodestar.plans import graph_queries, queries, text_queries  # noqa: F401  importing registers

QUERIES = dict(queries.QUERIES)
SQL = dict(queries.SQL)
