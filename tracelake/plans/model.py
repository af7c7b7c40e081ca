"""The data model: a group of runs as three DataFrames.

``nodes``: run_id, id, type, name, status, step_key, phase_key, t_start, t_end, duration_ms, cost_usd,
tokens_in, tokens_out. ``runs``: run_id, grp, task, started_at, ended_at, status. ``annotations``:
run_id, key, value (of the run). ``spans``: run_id, src, dst (marker to member). ``node_annotations``: run_id, id, key,
value (a VARIANT, of any JSON type). ``grp`` is
``baseline`` or ``candidate``; every operator keeps it as a grouping key, so both groups take one pass.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Model:
    runs: DataFrame
    nodes: DataFrame
    annotations: DataFrame
    spans: DataFrame | None = None
    node_annotations: DataFrame | None = None


OUTCOME = "verifier.pass"
NODE_COLUMNS = "run_id string, id string, type string, name string, status string, step_key string, phase_key string, t_start timestamp, t_end timestamp, duration_ms bigint, cost_usd double, tokens_in bigint, tokens_out bigint"
