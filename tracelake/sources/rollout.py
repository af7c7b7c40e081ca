"""Rollout transcripts of the second runtime as the same observations.

Records are stateful in the file: a turn is named by a turn_context and holds until its task is complete.
The state is a window over the file's lines, the fold of a turn a grouping.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.functions.text import prompt_kind
from tracelake.operators.numbering import numbered
from tracelake.sources import transcript
from tracelake.sources.transcript import quoted

# Record types.
RECORDS = ("session_meta", "turn_context", "response_item", "event_msg", "compacted", "world_state")
DEFAULT_ROLE = "default"


#: Lines of a compressed file that a task hands on at a time.
BATCH_LINES = 4096


def read(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines (path, line_no, value) of rollout files, plain or ``.zst``.

    Plain files are read in splits; a compressed one is one stream, unpacked by one task a block at a time.
    """
    paths = [paths] if isinstance(paths, str) else paths
    some = [p for p in paths if not p.endswith(".zst")]
    plain = transcript.lines(spark, some, pathGlobFilter="*.jsonl") if some else None
    packed = [p for p in paths if p.endswith(".zst") or not re.search(r"\.jsonl$", p)]
    if not packed:
        return plain
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zst").load(packed).select("path", "content")

    def texts(batches):
        import io

        import pyarrow as pa
        import zstandard

        def batch_of(path, rows):
            return pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array([k for k, _ in rows], pa.int32()), pa.array([v for _, v in rows], pa.string())], names=["path", "line_no", "value"])

        for batch in batches:
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                stream = io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(pa.BufferReader(raw.as_buffer()), read_across_frames=True), encoding="utf-8", newline="\n")
                rows = []
                for k, line in enumerate(stream):
                    if value := line.strip(" \t\r\n"):
                        rows.append((k, value))
                    if len(rows) >= BATCH_LINES:
                        yield batch_of(path, rows)
                        rows = []
                yield batch_of(path, rows)

    unpacked = files.mapInArrow(texts, "path string, line_no int, value string")
    return unpacked if plain is None else plain.unionByName(unpacked)


def _get(c: str, path: str) -> Column:
    return F.get_json_object(c, f"$.{path}")


def records(raw: DataFrame) -> DataFrame:
    """Typed records with the current turn and the file's thread, parent and role."""
    df = raw.select("path", "line_no", _get("value", "type").alias("rtype"), F.try_to_timestamp(_get("value", "timestamp")).alias("event_time"), _get("value", "payload").alias("payload"))
    df = df.withColumns({"ptype": _get("payload", "type"), "call_id": _get("payload", "call_id"), "named": F.when(F.col("rtype") == "turn_context", _get("payload", "turn_id")).otherwise(_get("payload", "turn_id"))})
    done = (F.col("rtype") == "event_msg") & (F.col("ptype") == "task_complete")
    line = Window.partitionBy("path").orderBy("line_no")
    # a task that is complete ends its turn: a new block starts after it
    block = F.sum(done.cast("int")).over(line.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("block", F.coalesce(block, F.lit(0)))
    current = F.last("named", ignorenulls=True).over(Window.partitionBy("path", "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    meta = df.where("rtype = 'session_meta'").groupBy("path").agg(*[F.min_by(_get("payload", p), "line_no").alias(k) for k, p in (("thread", "id"), ("parent_thread", "parent_thread_id"), ("role", "agent_role"), ("cli", "cli_version"), ("cwd", "cwd"))])
    return df.withColumn("turn_id", F.coalesce("named", current)).join(meta, "path", "left")


def failed_calls(df: DataFrame) -> DataFrame:
    """Calls whose end event says that they failed: by exit code, or by ``success`` being false."""
    ends = df.where("rtype = 'event_msg' AND ptype LIKE '%_end' AND call_id IS NOT NULL")
    bad = (F.coalesce(_get("payload", "exit_code").cast("int"), F.lit(0)) != 0) | (_get("payload", "success") == "false")
    return ends.where(F.coalesce(bad, F.lit(False))).select("path", "call_id").distinct()


def output_status(output: Column) -> Column:
    """error if a line says that the process exited with another code than 0."""
    codes = F.regexp_extract_all(output, F.lit(r"(?m)^Process exited with code (\d+)$"), F.lit(1))
    return F.when(F.exists(codes, lambda c: ~c.rlike("^0+$")), "error").otherwise("ok")


def tokens(usage: str) -> dict[str, Column]:
    """Counters of a usage record: cached input isn't counted as input; cache writes only if there are some."""
    n = lambda k: F.coalesce(_get(usage, k).cast("long"), F.lit(0))
    return {"tokens_in": F.greatest(F.lit(0), n("input_tokens") - n("cached_input_tokens")), "tokens_out": n("output_tokens"), "cache_read": n("cached_input_tokens"), "cache_write": F.nullif(n("cache_write_input_tokens"), F.lit(0))}


def observations(raw: DataFrame, run_of: Column | None = None) -> DataFrame:
    """Observations of rollout lines, with the columns of the main runtime's. ``run_of`` names the run of a path (by default its root thread)."""
    df = records(raw)
    item = F.col("rtype") == "response_item"
    base = lambda d, kind, **more: d.select("path", "line_no", "event_time", "turn_id", "thread", "parent_thread", "role", "cli", "cwd", F.lit(kind).alias("kind"), *[v.alias(k) for k, v in more.items()])
    text = F.array_join(F.transform(F.from_json(_get("payload", "content"), "array<struct<type:string,text:string>>"), lambda b: F.coalesce(b["text"], F.lit(""))), "")
    message = df.where(item & (F.col("ptype") == "message")).withColumns({"text": text, "who": _get("payload", "role")})
    prompts = base(message.where("who = 'user' AND text <> ''"), "user_prompt", input=quoted(F.col("text")), prompt_kind=prompt_kind(F.col("text")))
    # turns: the last model, usage and text of each, at its last line
    said = message.where("who = 'assistant'").select("path", "line_no", "text")
    facts = df.join(said, ["path", "line_no"], "left").where("turn_id IS NOT NULL")
    usage = F.when(F.col("ptype") == "token_count", _get("payload", "info.last_token_usage"))
    model = F.when(F.col("rtype") == "turn_context", _get("payload", "model"))
    last = lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("line_no")))
    folded = facts.groupBy("path", "turn_id", "thread", "parent_thread", "role", "cli", "cwd").agg(F.max("line_no").alias("line_no"), F.max("event_time").alias("event_time"), last(model).alias("model"), last(usage).alias("usage"), last(F.col("text")).alias("said"))
    turns = base(folded, "assistant_turn", message_id=F.col("turn_id"), model=F.col("model"), output=quoted(F.col("said")), **{k: F.when(F.col("usage").isNotNull(), v) for k, v in tokens("usage").items()})
    call = df.where(item & F.col("ptype").isin("function_call", "custom_tool_call", "local_shell_call"))
    arguments = F.coalesce(_get("payload", "arguments"), _get("payload", "input"), _get("payload", "action"))
    whole = F.when(F.try_parse_json(arguments).isNotNull(), arguments).otherwise(quoted(arguments))
    uses = base(call, "assistant_tool_use", tool_use_id=F.col("call_id"), message_id=F.col("turn_id"), name=F.coalesce(_get("payload", "name"), F.lit("local_shell")), input=whole)
    back = df.where(item & F.col("ptype").isin("function_call_output", "custom_tool_call_output")).join(failed_calls(df).withColumn("failed", F.lit(True)), ["path", "call_id"], "left")
    output = F.coalesce(_get("payload", "output.content"), _get("payload", "output"))
    results = base(back, "tool_result", tool_use_id=F.col("call_id"), status=F.when(F.coalesce("failed", F.lit(False)), "error").otherwise(output_status(output)), output=quoted(output))
    begin = df.where("rtype = 'event_msg' AND ptype = 'mcp_tool_call_begin'")
    server = F.concat_ws("__", F.lit("mcp"), _get("payload", "invocation.server"), _get("payload", "invocation.tool"))
    mcp_uses = base(begin, "assistant_tool_use", tool_use_id=F.col("call_id"), message_id=F.col("turn_id"), name=server, input=_get("payload", "invocation.arguments"))
    end = df.where("rtype = 'event_msg' AND ptype = 'mcp_tool_call_end'")
    bad = _get("payload", "error").isNotNull() | _get("payload", "result.Err").isNotNull() | (F.coalesce(_get("payload", "result.is_error"), _get("payload", "result.Ok.is_error"), F.lit("false")) == "true")
    mcp_results = base(end, "tool_result", tool_use_id=F.col("call_id"), status=F.when(bad, "error").otherwise("ok"), output=_get("payload", "result"))
    child = df.where("parent_thread IS NOT NULL").groupBy("path", "thread", "parent_thread", "role", "cli", "cwd").agg(F.max("line_no").alias("line_no"), F.max("event_time").alias("event_time"), F.lit(None).cast("string").alias("turn_id"))
    stops = base(child, "subagent_stop", subagent_type=F.coalesce("role", F.lit(DEFAULT_ROLE)))
    out = prompts
    for part in (turns, uses, results, mcp_uses, mcp_results, stops):
        out = out.unionByName(part, allowMissingColumns=True)
    out = out.withColumns({
        "source": F.lit("jsonl"), "session_id": F.coalesce("parent_thread", "thread"), "run_id": F.coalesce("parent_thread", "thread") if run_of is None else run_of, "agent_id": F.when(F.col("parent_thread").isNotNull(), F.col("thread")),
        "parent_tool_use_id": F.lit(None).cast("string"), "uuid": F.lit(None).cast("string"), "version": F.col("cli"), "file_rank": F.when(F.col("parent_thread").isNotNull(), 1).otherwise(0),
    })
    return numbered(out, ["run_id"], ["file_rank", "path", "line_no", "kind"], "seq")


def drift(raw: DataFrame) -> DataFrame:
    """Records of unknown types: reason and count."""
    kind = F.coalesce(_get("value", "type"), F.lit(""))
    return raw.agg(F.count_if(~kind.isin(*RECORDS)).alias("n")).select(F.lit("unknown_record_type").alias("reason"), "n").where("n > 0")


def descendants(files: DataFrame, root: str) -> DataFrame:
    """Files of a thread and of all threads below it. ``files``: path, thread, parent_thread. Stops by itself on cycles."""
    found = files.where(F.col("thread") == root).select("path", "thread")
    edge = found
    while True:
        edge = files.join(edge.select(F.col("thread").alias("parent_thread")).distinct(), "parent_thread", "left_semi").select("path", "thread").join(found, ["path", "thread"], "left_anti")
        if edge.isEmpty():
            return found
        found = found.unionByName(edge)
