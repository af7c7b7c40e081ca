"""Session transcripts (JSON lines) as observations: one row for each atomic fact of a line.

Lines keep their order as (file_rank, line_no, part). Open JSON is read by a fixed schema; unknown record
and block types are counted as drift; a line that is no JSON object fails the read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.functions.text import prompt_kind, trimmed
from tracelake.operators.numbering import numbered

# Record and block types of the main runtime.
LINE_TYPES = ("user", "assistant", "summary", "system", "file-history-snapshot", "attachment", "last-prompt", "mode", "ai-title", "permission-mode", "pr-link", "queue-operation", "worktree-state", "relocated")
ASSISTANT_BLOCKS = ("text", "tool_use", "thinking", "redacted_thinking")
USER_BLOCKS = ("text", "tool_result", "image", "document")

LINE = "type string, uuid string, sessionId string, timestamp string, parent_tool_use_id string, isSidechain boolean, agentId string, subagent_type string, version string, cwd string, message string"
MESSAGE = "role string, id string, model string, content string, usage struct<input_tokens:bigint,output_tokens:bigint,cache_read_input_tokens:bigint,cache_creation_input_tokens:bigint>"
BLOCKS = "array<struct<type:string,id:string,name:string,text:string,input:string,tool_use_id:string,content:string,is_error:boolean>>"
PART = "struct<kind:string,uuid:string,tool_use_id:string,message_id:string,name:string,status:string,model:string,tokens_in:bigint,tokens_out:bigint,cache_read:bigint,cache_write:bigint,subagent_type:string,prompt_kind:string,input:string,output:string>"
_FIELDS = tuple(x.split(":")[0] for x in PART[7:-1].split(","))


def lines(spark: SparkSession, paths: str | list[str], **options: str) -> DataFrame:
    """Lines of transcript files with their place: path, line_no (from 0), value.

    Files are read in splits of any size. A line's number is its place in its split plus the lines of the splits
    before it in the file: only those counts, a row a split, meet.
    """
    read = spark.read.options(**options).text(paths, lineSep="\n")
    raw = read.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    counts = raw.groupBy("path", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    counts = counts.select("path", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("more"))
    each = raw.join(counts, ["path", "block"]).select("path", (F.col("at") + F.col("more")).cast("int").alias("line_no"), F.btrim("value", F.lit(" \t\r\n")).alias("value"))
    return each.where("value <> ''")


def _part(**fields: Column) -> Column:
    return F.struct(*[(fields.get(k, F.lit(None))).alias(k) for k in _FIELDS]).cast(PART)


def quoted(c: Column) -> Column:
    """A string as JSON text; null and empty stay null."""
    return F.when(c != "", F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1))


def decoded(raw: DataFrame) -> DataFrame:
    """Lines with their record ``l``, message ``m``, content as ``text`` or ``blocks``. Fails on a line that isn't JSON."""
    good = F.from_json("value", LINE, {"mode": "FAILFAST"})
    df = raw.withColumn("l", good).withColumn("m", F.from_json(F.col("l.message"), MESSAGE))
    content = F.col("m.content")
    is_list = F.coalesce(F.schema_of_variant(F.from_json("l.message", "content variant")["content"]).startswith("ARRAY"), F.lit(False))  # a string may begin with a bracket
    return df.withColumns({"text": F.when(~is_list, content), "blocks": F.when(is_list, F.from_json(content, BLOCKS))})


def parts(df: DataFrame) -> DataFrame:
    """A row for each fact of a decoded line, in the order of the line: ``part_no`` and ``p``."""
    kind, line, m = F.col("l.type"), F.col("l"), F.col("m")
    blocks = F.coalesce("blocks", F.array().cast(BLOCKS))
    prompt = F.when(
        F.coalesce(F.col("text"), F.lit("")) != "",
        F.array(_part(kind=F.lit("user_prompt"), uuid=F.concat(F.lit("pc-"), F.sha2(F.concat(F.coalesce(line["sessionId"], F.lit("")), F.lit("\x00"), trimmed(F.col("text"))), 256)), prompt_kind=prompt_kind(F.col("text")), input=quoted(F.col("text")))),
    ).otherwise(F.array().cast(f"array<{PART}>"))
    results = F.transform(F.filter(blocks, lambda b: b["type"] == "tool_result"), lambda b: _part(kind=F.lit("tool_result"), uuid=line["uuid"], tool_use_id=b["tool_use_id"], status=F.when(b["is_error"], "error").otherwise("ok"), output=b["content"]))
    joined = F.array_join(F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"]), "")
    spoken = F.when(F.coalesce(F.col("text"), F.lit("")) != "", F.col("text")).otherwise(joined)
    usage = m["usage"]
    counter = lambda k: F.when(usage.isNotNull(), F.coalesce(usage[k], F.lit(0)))
    turn = F.array(
        _part(
            kind=F.lit("assistant_turn"), uuid=line["uuid"], message_id=m["id"], model=m["model"], tokens_in=counter("input_tokens"), tokens_out=counter("output_tokens"), cache_read=counter("cache_read_input_tokens"),
            cache_write=counter("cache_creation_input_tokens"), output=quoted(spoken),
        )
    )
    tools = F.transform(F.filter(blocks, lambda b: b["type"] == "tool_use"), lambda b: _part(kind=F.lit("assistant_tool_use"), uuid=line["uuid"], tool_use_id=b["id"], message_id=m["id"], name=b["name"], input=b["input"]))
    stop = F.when(F.coalesce(line["isSidechain"], F.lit(False)) | (F.coalesce(line["agentId"], F.lit("")) != ""), F.array(_part(kind=F.lit("subagent_stop"), subagent_type=line["subagent_type"]))).otherwise(F.array().cast(f"array<{PART}>"))
    own = F.when(kind == "user", F.concat(prompt, results)).when(kind == "assistant", F.concat(turn, tools)).otherwise(F.array().cast(f"array<{PART}>"))
    return df.where(m.isNotNull()).select("path", "line_no", "l", F.posexplode(F.concat(own, stop)).alias("part_no", "p"))


def observations(raw: DataFrame, run_of: Column | None = None) -> DataFrame:
    """Observations of lines (path, line_no, value): ids, kind, attributes, payload, event time and ``seq`` by run.

    ``run_of`` names the run of a path (by default its session). Main files come before those of subagents.
    """
    df = parts(decoded(raw))
    some = lambda c: F.nullif(c, F.lit(""))
    flat = df.select(
        (some(F.col("l.sessionId")) if run_of is None else run_of).alias("run_id"), F.lit("jsonl").alias("source"), F.col("p.kind").alias("kind"), some(F.col("l.sessionId")).alias("session_id"), some(F.col("l.agentId")).alias("agent_id"),
        some(F.col("l.parent_tool_use_id")).alias("parent_tool_use_id"), some(F.col("p.tool_use_id")).alias("tool_use_id"), some(F.col("p.message_id")).alias("message_id"), some(F.col("p.uuid")).alias("uuid"),
        *[F.col(f"p.{k}").alias(k) for k in _FIELDS[4:]], some(F.col("l.version")).alias("version"), some(F.col("l.cwd")).alias("cwd"), F.try_to_timestamp(F.col("l.timestamp")).alias("event_time"),
        F.when(F.col("path").contains("/subagents/"), 1).otherwise(0).alias("file_rank"), "path", "line_no", "part_no",
    )
    return numbered(flat, ["run_id"], ["file_rank", "path", "line_no", "part_no"], "seq")


def drift(raw: DataFrame) -> DataFrame:
    """What a transcript holds that isn't known: reason and count."""
    df = decoded(raw)
    kind = F.col("l.type")
    known = F.when(kind == "user", F.array(*map(F.lit, USER_BLOCKS))).when(kind == "assistant", F.array(*map(F.lit, ASSISTANT_BLOCKS)))
    odd_blocks = F.size(F.filter(F.coalesce("blocks", F.array().cast(BLOCKS)), lambda b: ~F.array_contains(known, F.coalesce(b["type"], F.lit("")))))
    stamp = F.coalesce(F.col("l.timestamp"), F.lit(""))
    counts = df.agg(
        F.count_if(~F.coalesce(kind, F.lit("")).isin(*LINE_TYPES)).alias("unknown_record_type"), F.coalesce(F.sum(F.when(known.isNotNull(), odd_blocks)), F.lit(0)).alias("unknown_content_block"),
        F.count_if((stamp != "") & F.try_to_timestamp(stamp).isNull()).alias("bad_timestamp"),
    )
    return counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("reason"), F.col(k).alias("n")) for k in counts.columns])).alias("x")).select("x.*").where("n > 0")


def time_bounds(obs: DataFrame) -> DataFrame:
    """First and last event time of each run."""
    return obs.groupBy("run_id").agg(F.min("event_time").alias("started_at"), F.max("event_time").alias("ended_at"))


def boundary(windows: DataFrame) -> DataFrame:
    """Two marker observations for each row (run_id, name, start, end): its window's bounds, from the hook source."""
    return windows.select("run_id", "name", F.explode(F.array(F.struct(F.lit("start").alias("boundary"), F.col("start").alias("event_time")), F.struct(F.lit("end").alias("boundary"), F.col("end").alias("event_time")))).alias("b")).select("run_id", F.lit("hook").alias("source"), F.lit("marker").alias("kind"), "name", "b.*")
