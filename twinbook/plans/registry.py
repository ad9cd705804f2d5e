"""All registered queries with their SQL, bound to the driver's tables."""

from __future__ import annotations

from . import books, catalogs, markets, matches, operations, oracles, projections, scans, titles

QUERIES = books.QUERIES | catalogs.QUERIES | scans.QUERIES | titles.QUERIES | markets.QUERIES | projections.QUERIES | matches.QUERIES | oracles.QUERIES | operations.QUERIES
ORACLE_SQL = books.ORACLE_SQL | catalogs.ORACLE_SQL | scans.ORACLE_SQL | titles.ORACLE_SQL | markets.ORACLE_SQL | projections.ORACLE_SQL | matches.ORACLE_SQL | oracles.ORACLE_SQL | operations.ORACLE_SQL
FLAGSHIP = "ladder_fill"
