"""Phases: half-open time windows of a run, and what lies in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def inside(t: Column, start: Column, end: Column) -> Column:
    """Whether t lies in [start, end); an open window has no end; without a time nothing does."""
    return t.isNotNull() & start.isNotNull() & (t >= start) & (end.isNull() | (t < end))


def spans(nodes: DataFrame) -> DataFrame:
    """Edges (run_id, src, dst) from each marker to the other nodes that start in its window.

    An equi-join on the run with the window as the rest of the condition: one shuffle by run.
    """
    markers = nodes.where(F.col("type") == "marker").select("run_id", F.col("id").alias("src"), F.col("t_start").alias("__s"), F.col("t_end").alias("__e"))
    others = nodes.where(F.col("type") != "marker").select("run_id", F.col("id").alias("dst"), F.col("t_start").alias("__t"))
    return others.join(markers, "run_id").where(inside(F.col("__t"), F.col("__s"), F.col("__e"))).select("run_id", "src", "dst")


def subgraph(nodes: DataFrame, edges: DataFrame, window: DataFrame, anchored: bool = False) -> tuple[DataFrame, DataFrame]:
    """The nodes of each run that start in its window, without markers, and the edges between them.

    ``window``: (run_id, w_start, w_end), a row a run. ``anchored`` keeps session nodes as well.
    """
    here = inside(F.col("t_start"), F.col("w_start"), F.col("w_end"))
    if anchored:
        here = here | (F.col("type") == "session")
    kept = nodes.join(window, "run_id").where((F.col("type") != "marker") & here).drop("w_start", "w_end")
    ids = kept.select("run_id", "id")
    within = edges.join(ids.withColumnRenamed("id", "src"), ["run_id", "src"], "left_semi").join(ids.withColumnRenamed("id", "dst"), ["run_id", "dst"], "left_semi")
    return kept, within


def phase_window(nodes: DataFrame, name: str, occurrence: int = 0) -> DataFrame:
    """The window of a phase in each run: (run_id, w_start, w_end). Runs without it, or without its start, have none."""
    marker = nodes.where((F.col("type") == "marker") & (F.col("name") == name) & F.col("t_start").isNotNull())
    if "occurrence" in nodes.columns:
        marker = marker.where(F.col("occurrence") == occurrence)
    return marker.select("run_id", F.col("t_start").alias("w_start"), F.col("t_end").alias("w_end"))


def range_window(nodes: DataFrame, first: tuple[str, int], last: tuple[str, int]) -> DataFrame:
    """From the start of one phase to the start of another."""
    a, b = phase_window(nodes, *first).select("run_id", "w_start"), phase_window(nodes, *last).select("run_id", F.col("w_start").alias("w_end"))
    return a.join(b, "run_id")
