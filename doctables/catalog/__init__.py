"""Queries over the given tables, one per operator, and the SQL they must equal."""

from doctables.catalog import cell_queries, layout_queries, page_queries, relation_queries, rule_queries, service_queries, table_queries  # noqa: F401
from doctables.catalog.base import ORACLES, QUERIES  # noqa: F401
