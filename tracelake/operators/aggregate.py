"""Folds of runs, steps, phases and tasks into group statistics.

Values are summed for each run and key first; quantiles are across runs. Both steps aggregate partially
before they shuffle, and only keys, never nodes, reach the second.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.stats import stats_of
from tracelake.plans.model import OUTCOME, Model

#: Statistics of annotations by name.
ANNOTATIONS = "map<string,struct<n:bigint,median:double,p25:double,p75:double,p90:double>>"
METRICS = ("duration_ms", "cost_usd", "tokens_in", "tokens_out")


def severity(status: Column) -> Column:
    """error, running, pending, ok, other: the worse, the greater."""
    return F.when(status == "error", 7).when(status == "running", 3).when(status == "pending", 2).when(status == "ok", 1).otherwise(0)


def millis(start: str, end: str) -> Column:
    return F.expr(f"timestampdiff(MILLISECOND, {start}, {end})").cast("double")


def zero(name: str) -> Column:
    """A null counts as 0 and stays in the sample."""
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def numeric(value: Column) -> Column:
    """A typed annotation as a number: numbers as they are, JSON's null as 0; null for texts, booleans, lists and objects."""
    number = F.schema_of_variant(value).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    return F.when(F.is_variant_null(value), 0.0).when(number, F.try_variant_get(value, "$", "double"))


def cells(m: Model) -> DataFrame:
    """A row for each run: its sums, node count, turns, error flag and duration (null if unknown)."""
    sums = m.nodes.groupBy("run_id").agg(
        F.sum(zero("cost_usd")).alias("cost_usd"), F.sum(zero("tokens_in")).alias("tokens_in"), F.sum(zero("tokens_out")).alias("tokens_out"),
        F.count("*").cast("double").alias("nodes"), F.count_if(F.col("type") == "assistant_turn").cast("double").alias("turns"), F.max((F.col("status") == "error").cast("int")).alias("node_error"),
    )
    joined = m.runs.join(sums, "run_id", "left")
    return joined.select(
        "run_id", "grp", "task", millis("started_at", "ended_at").alias("duration_ms"),
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("cost_usd", "tokens_in", "tokens_out", "nodes", "turns")],
        (F.coalesce(F.col("status") == "error", F.lit(False)) | (F.coalesce("node_error", F.lit(0)) == 1)).alias("has_error"),
    )


def totals(per_run: DataFrame) -> DataFrame:
    """A row for each group: run count, error runs and the statistics of the run metrics."""
    return per_run.groupBy("grp").agg(F.count("*").alias("runs"), F.count_if("has_error").alias("error_runs"), *[stats_of(k).alias(k) for k in (*METRICS, "nodes")])


def annotation_totals(m: Model) -> DataFrame:
    """A row for each group and run annotation: n, ones, whether all values are 0 or 1, and statistics."""
    return m.annotations.join(m.runs.select("run_id", "grp"), "run_id").groupBy("grp", "key").agg(F.count("value").alias("n"), F.count_if(F.col("value") == 1).alias("ones"), F.every(F.col("value").isin(0.0, 1.0)).alias("binary"), stats_of("value").alias("stats"))


def task_stats(m: Model, per_run: DataFrame) -> DataFrame:
    """A row for each group and task (runs without one are left out) with the outcome counts."""
    outcome = m.annotations.where(F.col("key") == OUTCOME).select("run_id", F.col("value").alias("outcome"))
    named = per_run.where("task <> ''").join(outcome, "run_id", "left")
    return named.groupBy("grp", "task").agg(F.count("*").alias("runs"), *[stats_of(k).alias(k) for k in METRICS], F.count("outcome").alias("out_n"), F.count_if(F.col("outcome") == 1).alias("out_ones"))


def _rows(folded: DataFrame, runs: DataFrame) -> DataFrame:
    """Group rows of per-run folds (run_id, key, name, worst, count and the metrics)."""
    sizes = runs.groupBy("grp").agg(F.count("*").alias("runs"))
    rows = folded.join(runs.select("run_id", "grp"), "run_id").groupBy("grp", "key").agg(
        F.min_by("name", "run_id").alias("name"), F.count("*").alias("present"), F.count_if(F.col("worst") == "error").alias("error_runs"), F.count_if(F.col("worst") == "ok").alias("ok_runs"),
        stats_of("occurrences").alias("occurrences"), *[stats_of(k).alias(k) for k in METRICS],
    )
    return rows.join(F.broadcast(sizes), "grp").withColumn("presence_rate", F.col("present") / F.col("runs"))  # sizes: a row a group


def _fold() -> list[Column]:
    return [F.min_by("name", "id").alias("name"), F.max_by("status", severity(F.col("status"))).alias("worst"), F.count("*").cast("double").alias("occurrences")]


def step_folds(m: Model) -> DataFrame:
    """A row for each run and step key: name, worst status, occurrences and sums; the duration is null if none is known."""
    return m.nodes.where("step_key <> ''").groupBy("run_id", F.col("step_key").alias("key")).agg(*_fold(), F.sum(F.col("duration_ms").cast("double")).alias("duration_ms"), *[F.sum(zero(k)).alias(k) for k in METRICS[1:]])


def step_annotations(m: Model, keys: tuple[str, ...]) -> DataFrame:
    """(run_id, key, annotation, value): the sum of each named annotation over a run's nodes of a step key, if one of them has a number."""
    steps = m.nodes.where("step_key <> ''").select("run_id", "id", F.col("step_key").alias("step"))
    given = m.node_annotations.where(F.col("key").isin(*keys)).select("run_id", "id", F.col("key").alias("annotation"), numeric(F.col("value")).alias("value")).where("value IS NOT NULL")
    return given.join(steps, ["run_id", "id"]).groupBy("run_id", F.col("step").alias("key"), "annotation").agg(F.sum("value").alias("value"))


def step_rows(m: Model, annotations: tuple[str, ...] = ()) -> DataFrame:
    """A row for each group and step key: presence, errors and statistics across the runs that have it.

    With names of ``annotations``, the statistics of their sums by run as well, a map by name: runs without a
    number aren't in them, and a row without any has no map.
    """
    rows = _rows(step_folds(m), m.runs)
    if not annotations:
        return rows
    if m.node_annotations is None:
        return rows.withColumn("annotations", F.lit(None).cast(ANNOTATIONS))
    stats = step_annotations(m, annotations).join(m.runs.select("run_id", "grp"), "run_id").groupBy("grp", "key", "annotation").agg(stats_of("value").alias("stats"))
    maps = stats.groupBy("grp", "key").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("annotation", "stats")))).alias("annotations"))  # as many as are named
    return rows.join(maps, ["grp", "key"], "left")


def phase_folds(m: Model) -> DataFrame:
    """As ``step_folds`` for phase keys; a phase's cost and tokens are those of its span's members.

    A node in two occurrences of a phase counts twice; spans to unknown nodes are ignored.
    """
    markers = m.nodes.where("phase_key <> ''").withColumn("duration_ms", millis("t_start", "t_end"))
    own = markers.groupBy("run_id", F.col("phase_key").alias("key")).agg(*_fold(), F.sum("duration_ms").alias("duration_ms"))
    members = m.spans.join(markers.select("run_id", F.col("id").alias("src"), F.col("phase_key").alias("key")), ["run_id", "src"]).join(m.nodes.select("run_id", F.col("id").alias("dst"), *METRICS[1:]), ["run_id", "dst"])
    sums = members.groupBy("run_id", "key").agg(*[F.sum(zero(k)).alias(k) for k in METRICS[1:]])
    return own.join(sums, ["run_id", "key"], "left").withColumns({k: zero(k) for k in METRICS[1:]})


def phase_rows(m: Model) -> DataFrame:
    """A row for each group and phase key, as ``step_rows``."""
    return _rows(phase_folds(m), m.runs)
