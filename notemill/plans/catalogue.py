"""All queries over the driver's tables, and each one in DuckDB SQL where SQL can express it."""

from __future__ import annotations

from notemill.plans import cleanup, cohorts, evaluation, formats, notes, profiling, streams

MODULES = (profiling, cohorts, cleanup, evaluation, notes, formats, streams)
QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
ORACLE_SQL = {name: q for m in MODULES for name, q in m.ORACLE_SQL.items()}
