"""Judges against gold labels: the join, agreement metrics, the kappa gate, and panels of judges.

``scores``: run_id, key, step_key (null: of the run), tool, value. ``labels``: run_id, key, step_key, label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.operators.numbering import average_ranks

_ON = ("run_id", "key", "step_key")


def unique(labels: DataFrame) -> DataFrame:
    """The labels; fails if one coordinate has two."""
    many = labels.groupBy(*_ON).agg(F.count("*").alias("__n"), F.first("label").alias("label"))
    return many.select(*_ON, F.when(F.col("__n") == 1, F.col("label")).otherwise(F.raise_error(F.concat(F.lit("duplicate label for "), F.concat_ws("/", *_ON)))).alias("label"))


def paired(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores beside labels of the labelled keys (key, tool, value, label); a side that has no partner is null."""
    keys = labels.select("key").distinct()
    s = scores.join(keys, "key", "left_semi").select(*[F.col(c).alias(f"s_{c}") for c in _ON], "tool", "value")
    on = (F.col("s_run_id") == F.col("run_id")) & (F.col("s_key") == F.col("key")) & F.col("s_step_key").eqNullSafe(F.col("step_key"))
    return s.join(labels, on, "full_outer").select(F.coalesce("s_key", "key").alias("key"), "tool", "value", "label")


def unmatched(pairs: DataFrame) -> DataFrame:
    """For each key how many labels and scores have no partner."""
    return pairs.groupBy("key").agg(F.count_if(F.col("value").isNull()).alias("unmatched_labels"), F.count_if(F.col("label").isNull()).alias("unmatched_scores"))


def midranks(df: DataFrame, value: str, by: list[str], name: str) -> DataFrame:
    """Average ranks of values: distinct values are numbered by ranges, so no group meets in one task."""
    return average_ranks(df, by, value, name)


def agreement(pairs: DataFrame, threshold: float = 0.5, by: tuple[str, ...] = ("key", "tool")) -> DataFrame:
    """n, Spearman's rank correlation, Cohen's kappa, true-positive and true-negative rate; null where undefined."""
    by = list(by)
    known = pairs.where("value IS NOT NULL AND label IS NOT NULL")
    ranked = midranks(midranks(known, "label", by, "rx"), "value", by, "ry")
    one = lambda c: F.col(c) >= threshold
    sums = ranked.groupBy(*by).agg(
        F.count("*").alias("n"), F.var_pop("rx").alias("vx"), F.var_pop("ry").alias("vy"), F.covar_pop("rx", "ry").alias("cov"),
        F.count_if(one("label") == one("value")).alias("same"), F.count_if(one("label")).alias("pos"), F.count_if(one("value")).alias("called"), F.count_if(one("label") & one("value")).alias("tp"), F.count_if(~one("label") & ~one("value")).alias("tn"),
    )
    n = F.col("n").cast("double")
    chance = F.col("pos") / n * (F.col("called") / n) + (1 - F.col("pos") / n) * (1 - F.col("called") / n)
    return sums.select(
        *by, "n", F.when((F.col("n") >= 2) & (F.col("vx") > 0) & (F.col("vy") > 0), F.try_divide(F.col("cov"), F.sqrt(F.col("vx") * F.col("vy")))).alias("spearman"),
        F.when(chance < 1, F.try_divide(F.col("same") / n - chance, 1 - chance)).alias("kappa"), F.try_divide(F.col("tp"), F.col("pos")).alias("tpr"), F.try_divide(F.col("tn"), F.col("n") - F.col("pos")).alias("tnr"),
    )


def kappa_gate(by_judge: DataFrame, least: float) -> DataFrame:
    """One row: judges, how many fail (no kappa, or below ``least``) and the exit code; no judge at all fails too."""
    return by_judge.agg(F.count("*").alias("judges"), F.count_if(F.col("kappa").isNull() | (F.col("kappa") < least)).alias("failures")).withColumn("exit_code", ((F.col("judges") == 0) | (F.col("failures") > 0)).cast("int"))


def panel(scores: DataFrame, min_judges: int = 1, vote: bool = False) -> DataFrame:
    """One score for each run, key and step from its judges: their mean, or their strict majority at 0.5.

    Scores without a tool (null or "unknown") are left out; a tool may score once; a vote needs an odd panel.
    """
    named = scores.where(F.coalesce("tool", F.lit("unknown")) != "unknown")
    seats = named.groupBy(*_ON, "tool").agg(F.count("*").alias("__n"), F.first("value").alias("value"))
    seats = seats.withColumn("value", F.when(F.col("__n") == 1, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("ambiguous panel input: tool "), "tool", F.lit(" for "), F.concat_ws("/", *_ON)))))
    full = seats.groupBy(*_ON).agg(F.count("*").alias("panel_size"), F.avg("value").alias("mean"), F.count_if(F.col("value") >= 0.5).alias("ones")).where(F.col("panel_size") >= min_judges)
    if not vote:
        return full.select(*_ON, F.col("mean").alias("value"), "panel_size")
    odd = F.when(F.col("panel_size") % 2 == 1, (2 * F.col("ones") > F.col("panel_size")).cast("double")).otherwise(F.raise_error(F.concat(F.lit("a vote requires an odd panel: "), F.concat_ws("/", *_ON))))
    return full.select(*_ON, odd.alias("value"), "panel_size")
