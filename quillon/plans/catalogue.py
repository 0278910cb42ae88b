"""All analytics queries by name, with the SQL that each is checked against."""

from __future__ import annotations

from quillon.plans import answers, ingest, intake, library, pool, records, scaled, stats, writes
from quillon.streaming import events, tasks

_PARTS = (stats, ingest, answers, library, intake, pool, writes, events, tasks, scaled, records)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLE_SQL = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
