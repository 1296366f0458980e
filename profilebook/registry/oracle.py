"""All oracle SQL, by query name."""

from __future__ import annotations

from profilebook.registry import oracle_basics, oracle_checks, oracle_columns, oracle_creation, oracle_export, oracle_master, oracle_refresh, oracle_search, oracle_stream, oracle_upsert

ORACLE: dict[str, str] = {}
ORACLE.update(oracle_search.oracle())
ORACLE.update(oracle_columns.oracle())
ORACLE.update(oracle_creation.oracle())
ORACLE.update(oracle_master.oracle())
ORACLE.update(oracle_upsert.oracle())
ORACLE.update(oracle_refresh.oracle())
ORACLE.update(oracle_export.oracle())
ORACLE.update(oracle_basics.oracle())
ORACLE.update(oracle_stream.oracle())
ORACLE.update(oracle_checks.oracle(ORACLE))
