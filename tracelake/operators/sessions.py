"""What a session says from end to end: its first prompt, last answer, tools and steps in order.

Nodes are in order of their start as text (none first), turns before tools of the same time, then by id. Numbers
are given by ranges and first and last values by ordered aggregates, so no session's payloads meet in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.operators.numbering import numbered

TOOLS = ("tool_call", "mcp_call")


def sort_key(start: Column) -> Column:
    """Where a node stands in its session."""
    return F.struct(F.coalesce(start, F.lit("")).alias("start"), F.when(F.col("type") == "assistant_turn", 0).otherwise(1).alias("kind"), F.col("id").alias("id"))


def stamp(t: Column) -> Column:
    """A time as text that sorts as the time does."""
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def ends(nodes: DataFrame) -> DataFrame:
    """A row for each run: ``input``, of the first prompt, and ``output``, the last that a turn has; empty where there is none.

    ``nodes``: run_id, id, type, name, t_start (text), input, output.
    """
    at = sort_key(F.col("t_start"))
    turn = (F.col("type") == "assistant_turn") & F.col("output").isNotNull()
    # the prompt comes in a struct: its payload may be null, and a later one must not take its place
    first = F.min_by(F.struct("input"), F.when(F.col("type") == "user_prompt", at))
    return nodes.groupBy("run_id").agg(first.alias("p"), F.max_by("output", F.when(turn, at)).alias("output")).select("run_id", F.coalesce("p.input", F.lit("")).alias("input"), F.coalesce("output", F.lit("")).alias("output"))


def _in_order(nodes: DataFrame, name: str) -> DataFrame:
    return numbered(nodes.withColumn("__at", sort_key(F.col("t_start"))).select("*", F.col("__at.start").alias("__s"), F.col("__at.kind").alias("__k")), ["run_id"], ["__s", "__k", "id"], name)


def tools(nodes: DataFrame) -> DataFrame:
    """The calls of every run: run_id, tool_no, name, ``parameters`` (the input, if it is a JSON object) and output."""
    object_ = F.when(F.schema_of_variant(F.try_parse_json("input")).startswith("OBJECT"), F.col("input"))
    return _in_order(nodes.where(F.col("type").isin(*TOOLS)), "tool_no").select("run_id", "tool_no", F.coalesce("name", F.lit("")).alias("name"), object_.alias("parameters"), "output")


def steps(nodes: DataFrame) -> DataFrame:
    """The turns and calls of every run: run_id, step_no, kind (llm, tool), name, input, output."""
    own = nodes.where(F.col("type").isin("assistant_turn", *TOOLS))
    turn = F.col("type") == "assistant_turn"
    return _in_order(own, "step_no").select("run_id", "step_no", F.when(turn, "llm").otherwise("tool").alias("kind"), F.coalesce("name", F.when(turn, "assistant_turn").otherwise("")).alias("name"), "input", "output")


def missing_checkpoints(nodes: DataFrame, expected: DataFrame) -> DataFrame:
    """Checkpoints (run_id, name) of ``expected`` that a run has no marker of."""
    marks = nodes.where("type = 'marker'").select("run_id", "name").distinct()
    return expected.select("run_id", "name").distinct().join(marks, ["run_id", "name"], "left_anti")
