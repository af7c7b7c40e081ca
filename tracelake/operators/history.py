"""Recorded reports of a baseline over time: numbering, baselines, trends and the Pareto front."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.operators.numbering import numbered as numbered_rows
from tracelake.operators.numbering import running

#: Envelope versions that readers accept.
VERSIONS = (1, 2)
AXES = {"accuracy": "ann:verifier.pass", "cost_usd": "cost_usd"}


def numbered(records: DataFrame) -> DataFrame:
    """Records with ``seq``, 1, 2, ... for each baseline, by time and id.

    Writers append without talking to each other, and the number is given when records are read.
    """
    return numbered_rows(records, ["baseline"], ["created_at", "record_id"], "seq").withColumn("seq", F.col("seq").cast("int"))


def append(records: DataFrame, path: str) -> None:
    """Adds records (baseline, record_id, created_at, body) to a history folder."""
    records.write.mode("append").partitionBy("baseline").parquet(path)


def upsert(baselines: DataFrame, new: DataFrame) -> DataFrame:
    """Baselines by name with the new ones in place of those of the same name."""
    return baselines.join(new.select("name"), "name", "left_anti").unionByName(new)


def delete(baselines: DataFrame, name: str) -> DataFrame:
    return baselines.where(F.col("name") != name)


def checked(records: DataFrame) -> DataFrame:
    """The records; fails on one of another envelope version."""
    ok = F.col("v").between(*VERSIONS)
    return records.withColumn("v", F.when(ok, F.col("v")).otherwise(F.raise_error(F.concat(F.lit("unsupported record version "), F.col("v").cast("string")))))


def trend(records: DataFrame, findings: DataFrame, metric: str, scope: str = "total") -> DataFrame:
    """One metric of each record in order: seq, created_at, verdict, baseline, candidate, delta."""
    picked = findings.where((F.col("scope") == scope) & (F.col("metric") == metric))
    return records.join(picked, ["baseline_name", "seq"]).select("baseline_name", "seq", "created_at", "verdict", "baseline", "candidate", "delta")


def axes(findings: DataFrame) -> DataFrame:
    """Accuracy and cost of both sides for each record, null where the finding is absent: a row a record."""
    total = findings.where((F.col("scope") == "total") & ~F.col("detail").startswith("annotation absent"))
    pick = lambda metric, side: F.max(F.when(F.col("metric") == metric, F.col(side)))
    return total.groupBy("baseline_name", "seq").agg(*[pick(m, side).alias(f"{side}_{k}") for k, m in AXES.items() for side in ("baseline", "candidate")])


def points(records: DataFrame, found: DataFrame, current: DataFrame) -> DataFrame:
    """Points of a baseline's history: one for each record, and one for the baseline from its newest record.

    ``spliced`` tells records against an older pin of the baseline.
    """
    rows = records.join(found, ["baseline_name", "seq"], "left").join(F.broadcast(current.select(F.col("name").alias("baseline_name"), F.col("created_at").alias("pinned_at"))), "baseline_name", "left")  # a row a baseline name
    own = rows.select("baseline_name", F.lit("record").alias("source"), "seq", "candidate_selector", F.col("candidate_accuracy").alias("accuracy"), F.col("candidate_cost_usd").alias("cost_usd"), (~F.col("baseline_created_at").eqNullSafe(F.col("pinned_at"))).alias("spliced"))
    newest = rows.groupBy("baseline_name").agg(F.max_by(F.struct(F.col("baseline_accuracy").alias("accuracy"), F.col("baseline_cost_usd").alias("cost_usd")), "seq").alias("x"))
    base = newest.select("baseline_name", F.lit("baseline").alias("source"), F.lit(0).alias("seq"), F.lit("").alias("candidate_selector"), "x.accuracy", "x.cost_usd", F.lit(None).cast("boolean").alias("spliced"))
    return own.unionByName(base)


def dominated(points: DataFrame, by: list[str], accuracy: str = "accuracy", cost: str = "cost_usd") -> DataFrame:
    """Points with ``dominated``: whether another of the same ``by`` is as good on both axes and better on one; null without both axes.

    A point is dominated if one cheaper is as accurate, or one as cheap more accurate. Both are running
    maxima over costs: points are reduced to one row a cost first, so no pairs are made.
    """
    whole = points.where(F.col(accuracy).isNotNull() & F.col(cost).isNotNull())
    costs = whole.groupBy(*by, cost).agg(F.max(accuracy).alias("__best"))
    costs = running(costs, by, [cost], F.max, "__best", "__cheaper")
    joined = points.join(costs, [*by, cost], "left")
    flag = (F.col("__best") > F.col(accuracy)) | F.coalesce(F.col("__cheaper") >= F.col(accuracy), F.lit(False))
    return joined.withColumn("dominated", F.when(F.col(accuracy).isNotNull() & F.col(cost).isNotNull(), flag)).drop("__best", "__cheaper")


def pareto_order(points: DataFrame) -> DataFrame:
    """Comparable points first, by cost, falling accuracy and number."""
    comparable = F.col("accuracy").isNotNull() & F.col("cost_usd").isNotNull()
    return points.orderBy(F.when(comparable, 0).otherwise(1), F.when(comparable, F.col("cost_usd")), F.when(comparable, -F.col("accuracy")), "seq")
