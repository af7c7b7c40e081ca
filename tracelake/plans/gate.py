"""The gate over a model, and its queries with their SQL."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.operators import aggregate as agg
from tracelake.operators import compare as cmp
from tracelake.plans.model import Model
from tracelake.plans.thresholds import DEFAULT, Thresholds
from tracelake.plans.views import gate_model
from tracelake.sources.shared import cut


def findings(m: Model, th: Thresholds = DEFAULT, specs: dict[str, bool] | None = None) -> DataFrame:
    """All findings of candidate against baseline, ok ones outside the totals left out."""
    # each fold is read several times, by both sides and for coverage: a row a run or key, written once
    per_run, steps = cut(agg.cells(m)), cut(agg.step_rows(m, tuple(specs or ())))
    runs = per_run.select("run_id", "grp")
    tasks = cut(agg.task_stats(m, per_run))
    asks = [cmp.total_asks(agg.totals(per_run), th), cmp.annotation_asks(agg.annotation_totals(m), specs or {}, th), cmp.row_asks("step", steps, runs, th, specs)]
    if m.spans is not None:
        asks.append(cmp.row_asks("phase", cut(agg.phase_rows(m)), runs, th))
    judged = cmp.downgraded(cmp.judged(reduce(DataFrame.unionByName, asks), th), cmp.coverage(steps), th)
    out = judged.unionByName(cmp.plain_paired(cmp.paired_findings(tasks, th), th))
    return cmp.kept(out)


def regress(m: Model, th: Thresholds = DEFAULT, specs: dict[str, bool] | None = None) -> tuple[DataFrame, DataFrame]:
    """Findings in report order and the one-row verdict."""
    found = findings(m, th, specs)
    return cmp.ordered(found), cmp.verdict(found, th)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _flat(df: DataFrame, structs: tuple[str, ...]) -> DataFrame:
    plain = [c for c in df.columns if c not in structs]
    return _rounded(df.select(*plain, *[F.col(f"{s}.{k}").alias(f"{s}_{k}") for s in structs for k in ("n", "median", "p25", "p75", "p90")]))


ROW = ("occurrences", *agg.METRICS)
SPECS = {"judge.score": True}
#: Annotations of steps, one of them of candidate runs only.
STEP_SPECS = {"judge.step": True, "judge.rare": False}


def _q(f):
    return lambda spark, sf_dir: _rounded(f(gate_model(spark, sf_dir)))


def q_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(agg.totals(agg.cells(gate_model(spark, sf_dir))), (*agg.METRICS, "nodes"))


def q_annotation_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(agg.annotation_totals(gate_model(spark, sf_dir)), ("stats",))


def q_task_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = gate_model(spark, sf_dir)
    return _flat(agg.task_stats(m, agg.cells(m)), agg.METRICS)


def q_step_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(agg.step_rows(gate_model(spark, sf_dir)), ROW)


def q_step_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = agg.step_rows(gate_model(spark, sf_dir), tuple(STEP_SPECS)).select("grp", "key", F.explode("annotations").alias("annotation", "stats"))
    return _flat(rows, ("stats",))


def q_step_annotation_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = gate_model(spark, sf_dir)
    found = cmp.row_findings("step", agg.step_rows(m, tuple(STEP_SPECS)), m.runs, DEFAULT, True, STEP_SPECS)
    return _rounded(found.where(F.col("metric").startswith("ann:")))


def q_phase_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(agg.phase_rows(gate_model(spark, sf_dir)), ROW)


def _paired(test: str, m: Model) -> DataFrame:
    return cmp.paired_findings(agg.task_stats(m, agg.cells(m)), Thresholds(paired_test=test))


QUERIES = {
    "cells": _q(agg.cells),
    "run_totals": q_totals,
    "annotation_totals": q_annotation_totals,
    "task_stats": q_task_stats,
    "step_rows": q_step_rows,
    "step_annotations": q_step_annotations,
    "step_annotation_findings": q_step_annotation_findings,
    "phase_rows": q_phase_rows,
    "marker_spans": _q(lambda m: m.spans),
    "total_findings": _q(lambda m: cmp.total_findings(agg.totals(agg.cells(m)), DEFAULT)),
    "annotation_findings": _q(lambda m: cmp.annotation_findings(agg.annotation_totals(m), SPECS, DEFAULT)),
    "step_findings": _q(lambda m: cmp.row_findings("step", agg.step_rows(m), m.runs, DEFAULT, True)),
    "phase_findings": _q(lambda m: cmp.row_findings("phase", agg.phase_rows(m), m.runs, DEFAULT, False)),
    "step_coverage": _q(lambda m: cmp.coverage(agg.step_rows(m))),
    "paired_sign": _q(partial(_paired, "sign")),
    "paired_wilcoxon": _q(partial(_paired, "wilcoxon")),
    "reliability": _q(lambda m: cmp.reliability(agg.task_stats(m, agg.cells(m)))),
    "outlier_audit": _q(lambda m: cmp.audit(agg.cells(m), DEFAULT)),
    "regress": _q(lambda m: findings(m, DEFAULT, SPECS)),
    "regress_verdict": _q(lambda m: cmp.verdict(findings(m, DEFAULT, SPECS), DEFAULT)),
}
