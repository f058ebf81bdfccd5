"""All queries of the engine, and their SQL."""

from . import capped, contested, evidence, imports, integrity, queries, versions, worklists

QUERIES = queries.QUERIES | evidence.QUERIES | capped.QUERIES | versions.QUERIES | worklists.QUERIES | contested.QUERIES | integrity.QUERIES | imports.QUERIES
ORACLE_SQL = queries.ORACLE_SQL | evidence.ORACLE_SQL | capped.ORACLE_SQL | versions.ORACLE_SQL | worklists.ORACLE_SQL | contested.ORACLE_SQL | integrity.ORACLE_SQL | imports.ORACLE_SQL
