"""Every query of the engine by name, and its SQL."""

from __future__ import annotations

from tracelake.plans import evidence_queries, gate, gate_sql, workloads

QUERIES = {**gate.QUERIES, **workloads.QUERIES, **evidence_queries.QUERIES}
ORACLE_SQL = {**gate_sql.ORACLE_SQL, **workloads.ORACLE_SQL, **evidence_queries.ORACLE_SQL}
