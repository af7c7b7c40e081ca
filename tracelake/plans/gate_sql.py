"""The gate's queries as SQL that another engine can run on the same tables."""

from __future__ import annotations

from tracelake.operators.aggregate import METRICS
from tracelake.plans.thresholds import DEFAULT as TH
from tracelake.plans.views import VIEWS

ROW = ("occurrences", *METRICS)
QUANTILES = (("median", 0.5), ("p25", 0.25), ("p75", 0.75), ("p90", 0.9))


def stats(x: str, name: str, rounded: bool = False) -> str:
    """The statistics of x, flattened under a name."""
    q = [(f"coalesce(quantile_disc({x}, {v})::DOUBLE, 0)", k) for k, v in QUANTILES]
    return f"count({x}) AS {name}_n, " + ", ".join(f"{f'round({c}, 6)' if rounded else c} AS {name}_{k}" for c, k in q)


def _cols(names) -> list[str]:
    return [f"{m}_{k}" for m in names for k in ("n", "median", "p25", "p75", "p90")]


_SEVERITY = "CASE status WHEN 'error' THEN 7 WHEN 'running' THEN 3 WHEN 'pending' THEN 2 WHEN 'ok' THEN 1 ELSE 0 END"
_FOLDS = f"""
stepf AS (SELECT run_id, step_key AS key, arg_min(name, id) AS name, arg_max(status, {_SEVERITY}) AS worst, count(*)::DOUBLE AS occurrences, sum(duration_ms)::DOUBLE AS duration_ms,
  sum(coalesce(cost_usd, 0)) AS cost_usd, sum(coalesce(tokens_in, 0))::DOUBLE AS tokens_in, sum(coalesce(tokens_out, 0))::DOUBLE AS tokens_out FROM node WHERE step_key <> '' GROUP BY ALL),
mem AS (SELECT span.run_id, m.phase_key AS key, sum(coalesce(n.cost_usd, 0)) AS cost_usd, sum(coalesce(n.tokens_in, 0))::DOUBLE AS tokens_in, sum(coalesce(n.tokens_out, 0))::DOUBLE AS tokens_out
  FROM span JOIN node m ON m.run_id = span.run_id AND m.id = span.src JOIN node n ON n.run_id = span.run_id AND n.id = span.dst GROUP BY ALL),
phasef AS (SELECT o.run_id, o.key, name, worst, occurrences, duration_ms, coalesce(cost_usd, 0) AS cost_usd, coalesce(tokens_in, 0) AS tokens_in, coalesce(tokens_out, 0) AS tokens_out
  FROM (SELECT run_id, phase_key AS key, arg_min(name, id) AS name, arg_max(status, {_SEVERITY}) AS worst, count(*)::DOUBLE AS occurrences, sum((t_end - t_start) // 1000)::DOUBLE AS duration_ms FROM node WHERE phase_key <> '' GROUP BY ALL) o LEFT JOIN mem USING (run_id, key)),
sizes AS (SELECT count(*) FILTER (WHERE grp = 'baseline') AS b_runs, count(*) FILTER (WHERE grp = 'candidate') AS c_runs FROM runx)
"""


def _rows(fold: str, rounded: bool = False) -> str:
    rate = "count(*)::DOUBLE / any_value(runs)"
    return f"""SELECT grp, key, arg_min(name, run_id) AS name, count(*) AS present, count(*) FILTER (WHERE worst = 'error') AS error_runs, count(*) FILTER (WHERE worst = 'ok') AS ok_runs,
    {", ".join(stats(m, m, rounded) for m in ROW)}, any_value(runs) AS runs, {f"round({rate}, 6)" if rounded else rate} AS presence_rate
    FROM {fold} JOIN runx USING (run_id) JOIN (SELECT grp, count(*) AS runs FROM runx GROUP BY grp) USING (grp) GROUP BY grp, key"""


def _totals(rounded: bool = False) -> str:
    return f"SELECT grp, count(*) AS runs, count(*) FILTER (WHERE has_error) AS error_runs, {', '.join(stats(m, m, rounded) for m in (*METRICS, 'nodes'))} FROM cell GROUP BY grp"


def _annotations(rounded: bool = False) -> str:
    return f"SELECT grp, key, count(value) AS n, count(*) FILTER (WHERE value = 1) AS ones, bool_and(value IN (0, 1)) AS \"binary\", {stats('value', 'stats', rounded)} FROM ann JOIN runx USING (run_id) GROUP BY grp, key"


def _tasks(rounded: bool = False) -> str:
    return f"""SELECT grp, task, count(*) AS runs, {", ".join(stats(m, m, rounded) for m in METRICS)}, count(value) AS out_n, count(*) FILTER (WHERE value = 1) AS out_ones
    FROM cell LEFT JOIN (SELECT run_id, value FROM ann WHERE key = 'verifier.pass') USING (run_id) WHERE task <> '' GROUP BY grp, task"""


def wilson(s: str, n: str, z: float = TH.z) -> tuple[str, str]:
    p, m = f"({s}::DOUBLE / nullif({n}, 0))", f"nullif({n}, 0)::DOUBLE"
    centre, reach, scale = f"({p} + {z * z} / (2.0 * {m}))", f"({z} * sqrt({p} * (1 - {p}) / {m} + {z * z} / (4.0 * {m} * {m})))", f"(1 + {z * z} / {m})"
    return f"coalesce(greatest(({centre} - {reach}) / {scale}, 0), 0)", f"coalesce(least(({centre} + {reach}) / {scale}, 1), 1)"


def _short(bn: str, cn: str) -> str:
    k = TH.min_support
    return f"CASE WHEN {bn} < {k} AND {cn} < {k} THEN 'baseline n=' || {bn} || ' and candidate n=' || {cn} || ' below min support {k}' WHEN {bn} < {k} THEN 'baseline n=' || {bn} || ' below min support {k}' WHEN {cn} < {k} THEN 'candidate n=' || {cn} || ' below min support {k}' ELSE '' END"


def _finding(metric: str, verdict: str, b: str, c: str, delta: str, lo: str, hi: str, detail: str) -> str:
    return f"{{'metric': {metric}, 'verdict': {verdict}, 'baseline': ({b})::DOUBLE, 'candidate': ({c})::DOUBLE, 'delta': ({delta})::DOUBLE, 'band_lo': ({lo})::DOUBLE, 'band_hi': ({hi})::DOUBLE, 'detail': {detail}}}"


def _rate(metric: str, bs: str, bn: str, cs: str, cn: str, delta: float, note: str = "''", mirrored: bool = False) -> str:
    pb, pc = f"coalesce({bs}::DOUBLE / nullif({bn}, 0), 0)", f"coalesce({cs}::DOUBLE / nullif({cn}, 0), 0)"
    (bl, bh), (cl, ch) = wilson(bs, bn), wilson(cs, cn)
    few = f"({bn} < {TH.min_support} OR {cn} < {TH.min_support})"
    v = f"CASE WHEN {few} THEN 'insufficient' WHEN {bh} < {cl} AND {pc} - {pb} > {delta} THEN 'regression' WHEN {pc} - {pb} > {delta} THEN 'notable' WHEN {ch} < {bl} AND {pb} - {pc} > {delta} THEN 'improvement' ELSE 'ok' END"
    detail = f"CASE WHEN ({_short(bn, cn)}) = '' THEN {note} WHEN {note} = '' THEN ({_short(bn, cn)}) ELSE ({_short(bn, cn)}) || '; ' || {note} END"
    shown = (f"1 - {pb}", f"1 - {pc}", f"{pb} - {pc}", f"CASE WHEN {few} THEN 0 ELSE 1 - {bh} END", f"CASE WHEN {few} THEN 0 ELSE 1 - {bl} END") if mirrored else (pb, pc, f"{pc} - {pb}", f"CASE WHEN {few} THEN 0 ELSE {bl} END", f"CASE WHEN {few} THEN 0 ELSE {bh} END")
    return _finding(metric, v, *shown, detail)


def _metric(metric: str, b: str, c: str, better: bool = False) -> str:
    band = f"greatest({TH.metric_rel_delta} * abs({b}_median), {TH.iqr_factor} * ({b}_p75 - {b}_p25))"
    few = f"({b}_n < {TH.min_support} OR {c}_n < {TH.min_support})"
    up, down = ("improvement", "regression") if better else ("regression", "improvement")
    v = f"CASE WHEN {few} THEN 'insufficient' WHEN {c}_median > {b}_median + {band} THEN '{up}' WHEN {c}_median < {b}_median - {band} THEN '{down}' ELSE 'ok' END"
    return _finding(metric, v, f"{b}_median", f"{c}_median", f"{c}_median - {b}_median", f"CASE WHEN {few} THEN 0 ELSE {b}_median - {band} END", f"CASE WHEN {few} THEN 0 ELSE {b}_median + {band} END", _short(f"{b}_n", f"{c}_n"))


def _absent(metric: str, detail: str) -> str:
    return _finding(metric, "'insufficient'", "0", "0", "0", "0", "0", detail)


def _side(cte: str, cols: list[str], p: str, key: str = "") -> str:
    grp = {"b": "baseline", "c": "candidate"}[p]
    return f"(SELECT {key + ', ' if key else ''}true AS {p}_here, {', '.join(f'{x} AS {p}_{x}' for x in cols)} FROM {cte} WHERE grp = '{grp}')"


_OUT = ", ".join(["f.metric AS metric", "f.verdict AS verdict", *[f"round(f.{x}, 6) AS {x}" for x in ("baseline", "candidate", "delta", "band_lo", "band_hi")], "f.detail AS detail"])


def _total_findings() -> str:
    cols = ["runs", "error_runs", *_cols((*METRICS, "nodes"))]
    found = [_metric(f"'{m}'", f"b_{m}", f"c_{m}") for m in (*METRICS, "nodes")] + [_rate("'error_rate'", "b_error_runs", "b_runs", "c_error_runs", "c_runs", TH.error_rate_delta)]
    return f"SELECT 'total' AS scope, '' AS key, '' AS name, {_OUT} FROM (SELECT unnest([{', '.join(found)}]) AS f FROM {_side('tot', cols, 'b')} CROSS JOIN {_side('tot', cols, 'c')})"


def _annotation_findings() -> str:
    cols = ["n", "ones", '"binary"', *_cols(("stats",))]
    side = lambda p: _side("annt", cols, p, "key").replace(f'"binary" AS {p}_"binary"', f'"binary" AS {p}_binary')
    metric = "'ann:' || key"
    ones = "'ones ' || b_ones || '/' || b_n || ' -> ' || c_ones || '/' || c_n"
    f = f"CASE WHEN b_here IS NULL THEN {_absent(metric, _q('annotation absent in baseline'))} WHEN c_here IS NULL THEN {_absent(metric, _q('annotation absent in candidate'))} WHEN b_binary AND c_binary THEN {_rate(metric, '(b_n - b_ones)', 'b_n', '(c_n - c_ones)', 'c_n', TH.annotation_rate_delta, ones, True)} ELSE {_metric(metric, 'b_stats', 'c_stats', True)} END"
    return f"SELECT 'total' AS scope, key, name, {_OUT} FROM (SELECT '' AS key, '' AS name, {f.replace('|| key', '|| akey')} AS f FROM (SELECT * RENAME (key AS akey) FROM {side('b')} b FULL JOIN {side('c')} c USING (key)))"


def _q(s: str) -> str:
    return f"'{s}'"


def _coverage(rows: str) -> str:
    return f"SELECT coalesce(sum(b * c)::DOUBLE / nullif(sum(b), 0), 1) AS coverage FROM (SELECT key, max((grp = 'baseline')::INT) AS b, max((grp = 'candidate')::INT) AS c FROM {rows} GROUP BY key)"


def _row_findings(scope: str, rows: str, downgrade: bool) -> str:
    cols = ["name", "present", "error_runs", *_cols(ROW)]
    bp, cp = "coalesce(b_present, 0)", "coalesce(c_present, 0)"
    note = f"'present ' || {bp} || '/' || b_runs || ' -> ' || {cp} || '/' || c_runs"
    presence = _rate("'presence'", f"(b_runs - {bp})", "b_runs", f"(c_runs - {cp})", "c_runs", TH.presence_delta, note)
    errors = _rate("'error_rate'", "b_error_runs", bp, "c_error_runs", cp, TH.error_rate_delta)
    gone = _absent("'metrics'", "CASE WHEN b_here IS NULL THEN 'absent in baseline' ELSE 'absent in candidate' END")
    found = f"CASE WHEN b_here AND c_here THEN [{', '.join([presence, errors, *[_metric(_q(m), f'b_{m}', f'c_{m}') for m in ROW]])}] ELSE [{presence}, {gone}] END"
    shown = _OUT
    if downgrade:
        down = f"coverage < {TH.coverage_floor} AND f.verdict = 'regression'"
        low = f"printf('step alignment coverage %.2f below floor {TH.coverage_floor:.2f}', coverage)"
        shown = shown.replace("f.verdict AS verdict", f"CASE WHEN {down} THEN 'notable' ELSE f.verdict END AS verdict").replace("f.detail AS detail", f"CASE WHEN {down} THEN (CASE WHEN f.detail = '' THEN {low} ELSE f.detail || '; ' || {low} END) ELSE f.detail END AS detail")
    return f"SELECT '{scope}' AS scope, key, name, {shown} FROM (SELECT key, coalesce(nullif(b_name, ''), c_name, '') AS name, coverage, unnest({found}) AS f FROM {_side(rows, cols, 'b', 'key')} b FULL JOIN {_side(rows, cols, 'c', 'key')} c USING (key) CROSS JOIN sizes CROSS JOIN ({_coverage(rows)}))"


_STEP_ANNOTATIONS = f"""
sanns AS (SELECT run_id, step_key AS key, a.key AS annotation, sum(value) AS value FROM nann a JOIN node USING (run_id, id) WHERE step_key <> '' AND value IS NOT NULL GROUP BY run_id, step_key, a.key),
sann AS (SELECT grp, key, annotation, {stats('value', 'stats')} FROM sanns JOIN runx USING (run_id) GROUP BY grp, key, annotation)
"""


def _step_annotation_findings(specs: dict[str, bool]) -> str:
    """Annotations of the step keys that both groups have."""
    parts = []
    for key, better in specs.items():
        metric = _q(f"ann:{key}")
        f = f"CASE WHEN b_here IS NULL THEN {_absent(metric, _q('annotation absent in baseline'))} WHEN c_here IS NULL THEN {_absent(metric, _q('annotation absent in candidate'))} ELSE {_metric(metric, 'b_stats', 'c_stats', better)} END"
        side = lambda p: _side(f"(SELECT * FROM sann WHERE annotation = '{key}')", _cols(("stats",)), p, "key")
        down = f"coverage < {TH.coverage_floor} AND f.verdict = 'regression'"
        low = f"printf('step alignment coverage %.2f below floor {TH.coverage_floor:.2f}', coverage)"
        shown = _OUT.replace("f.verdict AS verdict", f"CASE WHEN {down} THEN 'notable' ELSE f.verdict END AS verdict").replace("f.detail AS detail", f"CASE WHEN {down} THEN (CASE WHEN f.detail = '' THEN {low} ELSE f.detail || '; ' || {low} END) ELSE f.detail END AS detail")
        names = "(SELECT key, coalesce(nullif(b.name, ''), c.name, '') AS name FROM (SELECT * FROM steps WHERE grp = 'baseline') b JOIN (SELECT * FROM steps WHERE grp = 'candidate') c USING (key))"
        parts.append(f"SELECT 'step' AS scope, key, name, {shown} FROM (SELECT key, name, coverage, {f} AS f FROM {names} JOIN ({side('b')} b FULL JOIN {side('c')} c USING (key)) USING (key) CROSS JOIN ({_coverage('steps')}))")
    return " UNION ALL ".join(parts)


_DELTAS = f"""
pairs AS (SELECT * FROM {_side("taskt", ["runs", *_cols(METRICS)], "b", "task")} b JOIN {_side("taskt", ["runs", *_cols(METRICS)], "c", "task")} c USING (task) WHERE b_runs >= {TH.min_support} AND c_runs >= {TH.min_support}),
deltas AS ({" UNION ALL ".join(f"SELECT '{m}' AS metric, c_{m}_median - b_{m}_median AS d FROM pairs WHERE b_{m}_n >= {TH.min_support} AND c_{m}_n >= {TH.min_support} AND c_{m}_median <> b_{m}_median" for m in METRICS)}),
signs AS (SELECT metric, (SELECT count(*) FROM pairs) AS matched, coalesce(nonzero, 0) AS nonzero, coalesce(positive, 0) AS positive FROM (SELECT unnest({list(METRICS)}) AS metric) LEFT JOIN (SELECT metric, count(*) AS nonzero, count(*) FILTER (WHERE d > 0) AS positive FROM deltas GROUP BY metric) USING (metric)
  WHERE (SELECT count(DISTINCT grp) FROM taskt) = 2)
"""


def _tail(s: str) -> str:
    """P(X >= s) of nonzero fair coins."""
    return f"(CASE WHEN {s} <= 0 THEN 1 WHEN {s} > nonzero THEN 0 ELSE least(1, list_sum(list_transform(range({s}, nonzero + 1), lambda k: exp(lgamma(nonzero + 1) - lgamma(k + 1) - lgamma(nonzero - k + 1) - nonzero * ln(2.0))))) END)::DOUBLE"


def _paired(tests: str) -> str:
    verdict = f"CASE WHEN matched < {TH.paired_min_tasks} THEN 'insufficient' WHEN round(p_up, 12) <= {TH.paired_alpha} THEN 'regression' WHEN round(p_down, 12) <= {TH.paired_alpha} THEN 'improvement' ELSE 'ok' END"
    return f"SELECT 'paired' AS scope, '' AS key, '' AS name, metric, {verdict} AS verdict, matched, nonzero, positive, w_plus, w_total, round(p_up, 6) AS p_up, round(p_down, 6) AS p_down FROM ({tests})"


_SIGN = f"SELECT *, positive::DOUBLE AS w_plus, nonzero::DOUBLE AS w_total, {_tail('positive')} AS p_up, {_tail('(nonzero - positive)')} AS p_down FROM signs"
#: By counting over all sign vectors.
_RANKS = """
SELECT s.*, coalesce(w_plus, 0) AS w_plus, coalesce(w_total, 0) AS w_total, coalesce(p_up, 1) AS p_up, coalesce(p_down, 1) AS p_down FROM signs s LEFT JOIN (
  SELECT metric, any_value(w_plus) AS w_plus, any_value(w_total) AS w_total, avg((w >= w_plus)::INT) AS p_up, avg((w <= w_plus)::INT) AS p_down FROM (
    SELECT metric, v, sum(CASE WHEN (v >> i) & 1 = 1 THEN r ELSE 0 END) AS w, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus, sum(r) AS w_total FROM (
      SELECT metric, d, r, i, unnest(range((2 ** n)::BIGINT)) AS v FROM (
        SELECT metric, d, rank() OVER w + (count(*) OVER (PARTITION BY metric, abs(d)) - 1) / 2.0 AS r, row_number() OVER (PARTITION BY metric ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY metric) AS n FROM deltas WINDOW w AS (PARTITION BY metric ORDER BY abs(d)))) GROUP BY metric, v) GROUP BY metric) USING (metric)
"""


def _with(select: str, *extra: str) -> str:
    return f"WITH {', '.join(x.strip() for x in (VIEWS, _FOLDS, *extra))} {select}"


_TOT, _ANN, _TASK, _STEP, _PHASE = f"tot AS ({_totals()})", f"annt AS ({_annotations()})", f"taskt AS ({_tasks()})", f"steps AS ({_rows('stepf')})", f"phases AS ({_rows('phasef')})"
_PLAIN = f"SELECT scope, key, name, metric, verdict, 0.0::DOUBLE AS baseline, 0.0::DOUBLE AS candidate, 0.0::DOUBLE AS delta, 0.0::DOUBLE AS band_lo, 0.0::DOUBLE AS band_hi, CASE WHEN verdict = 'insufficient' THEN 'matched ' || matched || CASE WHEN matched = 1 THEN ' task' ELSE ' tasks' END || ' below paired min {TH.paired_min_tasks}' ELSE '+' || positive || '/' || nonzero || ' tasks, p=' || printf('%.4f', p_up) END AS detail FROM ({_paired(_SIGN)})"
_ALL = " UNION ALL BY NAME ".join(f"({x})" for x in (_total_findings(), _annotation_findings(), _PLAIN, _row_findings("step", "steps", True), _row_findings("phase", "phases", False)))
_REPORT = f"SELECT * FROM ({_ALL}) WHERE scope = 'total' OR verdict <> 'ok'"
_BASE = (_TOT, _ANN, _TASK, _STEP, _PHASE, _DELTAS)
_COUNTS = ", ".join(f"count(*) FILTER (WHERE verdict = '{v}') AS {n}" for v, n in (("regression", "regressions"), ("notable", "notables"), ("insufficient", "insufficient"), ("improvement", "improvements")))
_AUDIT = f"""SELECT grp, run_id, metric, round(value, 6) AS value, round(median, 6) AS median, round(band, 6) AS band FROM (
  SELECT *, greatest({TH.audit_rel} * abs(median), {TH.audit_iqr} * (p75 - p25)) AS band FROM (
    SELECT *, count(*) OVER g AS n, quantile_disc(value, 0.5) OVER g AS median, quantile_disc(value, 0.25) OVER g AS p25, quantile_disc(value, 0.75) OVER g AS p75 FROM (
      {" UNION ALL ".join(f"SELECT grp, run_id, '{m}' AS metric, coalesce({m}, 0)::DOUBLE AS value FROM cell" for m in (*METRICS, "turns"))}) WINDOW g AS (PARTITION BY grp, metric))) WHERE n >= 3 AND abs(value - median) > band"""

ORACLE_SQL = {
    "cells": _with("SELECT run_id, grp, task, duration_ms, round(cost_usd, 6) AS cost_usd, tokens_in, tokens_out, nodes, turns, has_error FROM cell"),
    "run_totals": _with(_totals(True)),
    "annotation_totals": _with(_annotations(True)),
    "task_stats": _with(_tasks(True)),
    "step_rows": _with(_rows("stepf", True)),
    "step_annotations": _with(f"SELECT grp, key, annotation, stats_n, {', '.join(f'round(stats_{k}, 6) AS stats_{k}' for k, _ in QUANTILES)} FROM sann", _STEP_ANNOTATIONS),
    "step_annotation_findings": _with(_step_annotation_findings({"judge.step": True, "judge.rare": False}), _STEP, _STEP_ANNOTATIONS),
    "phase_rows": _with(_rows("phasef", True)),
    "marker_spans": _with("SELECT run_id, src, dst FROM span"),
    "total_findings": _with(_total_findings(), _TOT),
    "annotation_findings": _with(_annotation_findings(), _ANN),
    "step_findings": _with(_row_findings("step", "steps", True), _STEP),
    "phase_findings": _with(_row_findings("phase", "phases", False), _PHASE),
    "step_coverage": _with(f"SELECT round(coverage, 6) AS coverage FROM ({_coverage('steps')})", _STEP),
    "paired_sign": _with(_paired(_SIGN), _TASK, _DELTAS),
    "paired_wilcoxon": _with(_paired(_RANKS), _TASK, _DELTAS),
    "reliability": _with("SELECT grp, k, tasks, round(avg(list_aggregate(list_transform(range(k), lambda i: greatest(out_ones - i, 0)::DOUBLE / (out_n - i)), 'product')), 6) AS pass_k FROM (SELECT *, unnest(range(1, k_max + 1)) AS k FROM (SELECT *, min(out_n) OVER (PARTITION BY grp) AS k_max, count(*) OVER (PARTITION BY grp) AS tasks FROM taskt WHERE out_n > 0)) GROUP BY grp, k, tasks", _TASK),
    "outlier_audit": _with(_AUDIT),
    "regress": _with(_REPORT, *_BASE),
    "regress_verdict": _with(f"SELECT *, CASE WHEN regressions > 0 THEN 'regression' WHEN insufficient > 0 AND notables = 0 AND improvements = 0 THEN 'insufficient' ELSE 'ok' END AS verdict FROM (SELECT {_COUNTS}, count(*) AS findings FROM ({_REPORT}))", *_BASE),
}
