"""Name -> query over the driver's tables, and the SQL that each is held against."""

from __future__ import annotations

from loomwork.plans import extraction, flows, history, matching, places, promotion, scalars, shown, spoken, uploads

_PARTS = (matching, scalars, history, extraction, promotion, shown, uploads, places, flows, spoken)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLE_SQL = {name: text for part in _PARTS for name, text in part.ORACLE_SQL.items()}
