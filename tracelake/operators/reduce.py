"""Observations to a graph: nodes, parent edges and runs, by grouping.

Every merge rule is an aggregate that doesn't depend on the order of rows, only on ``seq``: what a reader
that goes line by line would end with. Times come from the highest source, then the earliest (start) or
latest (end); tokens and payloads are the last ones given; a status never leaves error for ok.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from tracelake.functions.pricing import Prices, cost_usd
from tracelake.functions.text import MARK_SERVER, is_marker_tool, phase_key, skill_name, tool_type


def _rank(source: str = "source") -> Column:
    return F.when(F.col(source) == "hook", 2).when(F.col(source) == "jsonl", 1).otherwise(0)


def _filled(value: str) -> Column:
    return F.nullif(F.col(value), F.lit(""))


def _last(value: str) -> Column:
    """The last value given."""
    return F.max_by(value, F.when(F.col(value).isNotNull(), F.col("seq")))


def _first(value: str, when: Column | None = None) -> Column:
    ok = F.col(value).isNotNull() if when is None else F.col(value).isNotNull() & when
    return F.min_by(value, F.when(ok, F.col("seq")))


def without_marker_tools(obs: DataFrame, server: str = MARK_SERVER) -> DataFrame:
    """Observations without the calls of the server's marker tool and their results."""
    calls = obs.where(is_marker_tool(F.col("name"), server) & F.col("tool_use_id").isNotNull()).select("run_id", "tool_use_id").distinct()
    kept = obs.join(calls, ["run_id", "tool_use_id"], "left_anti")
    return kept.where(~(is_marker_tool(F.col("name"), server) & F.col("kind").isin("assistant_tool_use", "tool_result")))


def placed(obs: DataFrame) -> DataFrame:
    """Observations with the node that they are about: ``id`` and ``type``."""
    kind, run = F.col("kind"), F.col("run_id")
    obs_key = F.concat(F.lit("obs:"), F.col("seq").cast("string"))
    name = lambda what, key: F.concat_ws(":", run, F.lit(what), key)
    return obs.withColumns({
        "id": F.when(kind == "user_prompt", name("prompt", F.coalesce("uuid", obs_key))).when(kind == "assistant_turn", name("turn", F.coalesce("message_id", F.lit("")))).when(kind.isin("assistant_tool_use", "tool_result"), name("tool", F.coalesce("tool_use_id", obs_key))).when(kind == "subagent_stop", name("agent", F.coalesce("agent_id", F.lit("")))),
        "type": F.when(kind == "user_prompt", "user_prompt").when(kind == "assistant_turn", "assistant_turn").when(kind.isin("assistant_tool_use", "tool_result"), F.coalesce(tool_type(F.col("name")), F.lit("tool_call"))).when(kind == "subagent_stop", "subagent"),
    })


def nodes(obs: DataFrame, prices: Prices | None = None) -> DataFrame:
    """A row for each node of each run; a session node for each run, without times or status."""
    df = placed(without_marker_tools(obs)).where("id IS NOT NULL")
    at = F.col("event_time").isNotNull()
    ends = at & F.col("kind").isin("assistant_turn", "tool_result", "subagent_stop")
    df = df.withColumn("skill", F.when(F.col("type") == "skill", skill_name(F.col("input"))))
    display, strong = F.coalesce("skill", "name"), F.col("skill").isNotNull()
    status = F.when(F.col("kind") == "subagent_stop", F.coalesce(F.col("status"), F.lit("ok"))).otherwise(F.col("status"))
    df = df.withColumns({"display": F.when(F.col("kind").isin("assistant_tool_use", "tool_result"), F.nullif(display, F.lit(""))), "strong": F.coalesce(strong, F.lit(False)), "st": status, "input": _filled("input"), "output": _filled("output"), "model": _filled("model"), "subagent_type": _filled("subagent_type")})
    lattice = F.when(F.col("st") == "error", 4).when(F.col("st") == "ok", 3).when(F.col("st") == "running", 1).otherwise(0)
    grouped = df.groupBy("run_id", "id").agg(
        F.max_by("type", F.when(F.col("type") == "tool_call", 0).otherwise(1)).alias("type"), F.min_by("display", F.when(F.col("display").isNotNull(), F.struct(~F.col("strong"), F.col("seq")))).alias("name"),
        F.max_by("st", F.when(F.col("st").isNotNull(), F.struct(lattice, F.col("seq")))).alias("status"), _first("subagent_type").alias("subagent_type"), _last("agent_id").alias("agent_id"),
        F.min_by("event_time", F.when(at, F.struct(-_rank(), F.col("event_time")))).alias("t_start"), F.max_by("event_time", F.when(ends, F.struct(_rank(), F.col("event_time")))).alias("t_end"),
        *[_last(k).alias(k) for k in ("input", "output", "model", "tokens_in", "tokens_out", "cache_read", "cache_write", "prompt_kind")], F.max("seq").alias("rev"),
        F.sort_array(F.collect_list(F.struct("seq", "source", "kind"))).alias("sources"),
    )
    priced = F.when((F.col("type") == "assistant_turn") & F.col("model").isNotNull() & F.coalesce("tokens_in", "tokens_out").isNotNull(), cost_usd(F.col("model"), F.col("tokens_in"), F.col("tokens_out"), F.col("cache_read"), F.col("cache_write"), prices))
    out = grouped.withColumns({"duration_ms": F.expr("timestampdiff(MILLISECOND, t_start, t_end)").cast("long"), "cost_usd": priced, "unpriced": (F.coalesce("tokens_in", F.lit(0)) + F.coalesce("tokens_out", F.lit(0)) > 0) & priced.isNull()})
    sessions = obs.select("run_id").distinct().select("run_id", F.concat(F.lit("session:"), "run_id").alias("id"), F.lit("session").alias("type"))
    return out.unionByName(sessions, allowMissingColumns=True)


def parents(obs: DataFrame) -> DataFrame:
    """Parent edges (run_id, src, dst, rev).

    Turns hang on the prompt before them of the same agent, else on the agent or session; tools on their
    parent tool, else their turn, else the session; prompts on their agent or session.
    """
    df = placed(without_marker_tools(obs)).where("id IS NOT NULL")
    session = F.concat(F.lit("session:"), "run_id")
    root = F.when(F.col("agent_id").isNotNull(), F.concat_ws(":", "run_id", F.lit("agent"), "agent_id")).otherwise(session)
    tool = lambda c: F.concat_ws(":", "run_id", F.lit("tool"), c)
    prompts = df.where("kind = 'user_prompt'").select("run_id", root.alias("src"), F.col("id").alias("dst"), "seq")
    # as of: the last prompt before a turn's first line, in its agent's lines
    before = Window.partitionBy("run_id", "agent_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    said = df.where("kind IN ('user_prompt', 'assistant_turn')").withColumn("prompt", F.last(F.when(F.col("kind") == "user_prompt", F.col("id")), ignorenulls=True).over(before))
    turns = said.where("kind = 'assistant_turn'").groupBy("run_id", F.col("id").alias("dst")).agg(F.min_by(F.coalesce("prompt", root), "seq").alias("src"), F.max("seq").alias("seq")).select("run_id", "src", "dst", "seq")
    own = df.where("kind IN ('assistant_tool_use', 'tool_result', 'subagent_stop')")
    is_tool = F.col("kind") != "subagent_stop"
    how = F.when(F.col("parent_tool_use_id").isNotNull(), 2).when(is_tool & F.col("message_id").isNotNull(), 1).otherwise(0)
    src = F.when(F.col("parent_tool_use_id").isNotNull(), tool(F.col("parent_tool_use_id"))).when(is_tool & F.col("message_id").isNotNull(), F.concat_ws(":", "run_id", F.lit("turn"), "message_id")).otherwise(session)
    structure = F.when(F.col("source") == "jsonl", 3).otherwise(0)
    ok = ~is_tool | F.col("parent_tool_use_id").isNull() | F.col("tool_use_id").isNotNull()
    tools = own.where(ok).groupBy("run_id", F.col("id").alias("dst")).agg(F.max_by(src, F.struct(how, structure, F.col("seq"))).alias("src"), F.max("seq").alias("seq")).select("run_id", "src", "dst", "seq")
    return prompts.union(turns).union(tools).groupBy("run_id", "src", "dst").agg(F.max("seq").alias("rev"))


def runs(obs: DataFrame) -> DataFrame:
    """A row for each run: times, last seq, model, version and cwd as first given, sessions in order."""
    sessions = obs.where("session_id IS NOT NULL").groupBy("run_id", "session_id").agg(F.min("seq").alias("s")).groupBy("run_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("s", "session_id"))), lambda x: x["session_id"]).alias("session_ids"))
    named = obs.withColumn("model", _filled("model"))
    folded = named.groupBy("run_id").agg(F.min("event_time").alias("started_at"), F.max("event_time").alias("last_at"), F.max("seq").alias("last_seq"), _first("model").alias("model"), _first("version").alias("version"), _first("cwd").alias("cwd"))
    return folded.join(sessions, "run_id", "left").withColumn("status", F.lit("running"))


def marker_bounds(obs: DataFrame, server: str = MARK_SERVER) -> DataFrame:
    """Bounds of phases, one for each marker call or marker observation: run_id, name, boundary, occurrence (-1: none), state_ref, agent_id, ts, seq."""
    calls = obs.where(is_marker_tool(F.col("name"), server) & F.col("input").isNotNull())
    given = F.from_json("input", "name string, boundary string, state_ref string, occurrence int")
    tool = calls.select("run_id", F.coalesce("tool_use_id", F.concat(F.lit("obs:"), F.col("seq").cast("string"))).alias("k"), given.alias("g"), "agent_id", F.col("event_time").alias("ts"), "seq").select("run_id", "k", "g.*", "agent_id", "ts", "seq")
    found = tool.where("name <> '' AND boundary <> ''")
    if "boundary" in obs.columns:
        own = obs.where("kind = 'marker' AND name <> '' AND boundary <> ''")
        found = found.unionByName(own.select("run_id", F.concat(F.lit("obs:"), F.col("seq").cast("string")).alias("k"), "name", "boundary", F.lit(None).cast("string").alias("state_ref"), F.lit(None).cast("int").alias("occurrence"), F.lit(None).cast("string").alias("agent_id"), F.col("event_time").alias("ts"), "seq"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    merged = found.groupBy("run_id", "k").agg(first("name"), first("boundary"), first("state_ref"), first("occurrence"), first("agent_id"), F.min(F.struct("ts", "seq")).alias("p"))
    return merged.select("run_id", "name", "boundary", F.coalesce("occurrence", F.lit(-1)).alias("occurrence"), "state_ref", "agent_id", "p.ts", "p.seq")


def occurrences(wanted: list[int]) -> list[int]:
    """Occurrence numbers of starts in order: explicit ones (>= 0) to whoever names them first, the others the next free from their index.

    Below the last number given out there is none free, so one pointer that only moves on is enough.
    """
    owner: dict[int, int] = {}
    for i, w in enumerate(wanted):
        if w >= 0:
            owner.setdefault(w, i)
    named, free, out = {i: w for w, i in owner.items()}, 0, []
    for i in range(len(wanted)):
        if i not in named:
            free = max(free, i)
            while free in owner:
                free += 1
        out.append(named.get(i, free))
        free += i not in named
    return out


def pair_ends(bounds: list[tuple[str, int]], occs: list[int]) -> dict[int, int]:
    """Which bound ends each start: its named occurrence, else the last start still open; stray ends take what is left open.

    Starts stay in the order they opened; whatever ends one takes it out, so the last one is always the innermost.
    """
    start_of = {o: i for i, o in enumerate(occs)}
    ends: dict[int, int] = {}
    running: dict[int, None] = {}
    numbers = iter(range(len(occs)))
    later = []
    for k, (boundary, occ) in enumerate(bounds):
        if boundary == "start":
            if (i := next(numbers)) not in ends:  # else an end named it ahead
                running[i] = None
        elif boundary == "end":
            i = start_of.get(occ, -1) if occ >= 0 else -1
            if i < 0 or i in ends:
                i = next(reversed(running), -1)
            if i < 0:
                later.append(k)
                continue
            ends[i] = k
            running.pop(i, None)
    return ends | dict(zip(reversed(running), later, strict=False))


@F.pandas_udf(StructType().add("occurrence", ArrayType(IntegerType())).add("end", ArrayType(IntegerType())))
def _settled(starts: pd.Series, ends: pd.Series, wanted: pd.Series) -> pd.DataFrame:
    """Of each run and name, by its bounds in order: the occurrence of every start, and the place of the bound that ends it (null: open)."""
    numbers, places = [], []
    for is_start, is_end, of in zip(starts, ends, wanted, strict=True):
        bounds = [("start" if s else "end" if e else "", int(o)) for s, e, o in zip(is_start, is_end, of, strict=True)]
        occs = occurrences([o for b, o in bounds if b == "start"])
        pairs = pair_ends(bounds, occs)
        numbers.append(occs)
        places.append([pairs.get(i) for i in range(len(occs))])
    return pd.DataFrame({"occurrence": numbers, "end": places})


def phases(bounds: DataFrame) -> DataFrame:
    """A row for each phase of a run: name, occurrence, t_start, t_end (null: open), state_ref, agent_id.

    Occurrences and nesting are settled in order of time within one run and name, a batch of runs a call of Python;
    the rows of a group are one run's bounds.
    """
    rows = F.sort_array(F.collect_list(F.struct("ts", "seq", "boundary", "occurrence", "state_ref", "agent_id")))
    is_ = lambda what: F.transform("b", lambda x: x["boundary"] == what)
    df = bounds.groupBy("run_id", "name").agg(rows.alias("b")).withColumn("s", _settled(is_("start"), is_("end"), F.col("b.occurrence")))
    df = df.select("run_id", "name", "b", F.filter("b", lambda x: x["boundary"] == "start").alias("start"), F.col("s.occurrence").alias("no"), F.col("s.end").alias("end"))
    phase = lambda x: F.struct(x["no"].alias("occurrence"), x["start"]["ts"].alias("t_start"), F.get("b", x["end"])["ts"].alias("t_end"), x["end"].isNotNull().alias("closed"), x["start"]["state_ref"].alias("state_ref"), x["start"]["agent_id"].alias("agent_id"))
    return df.select("run_id", "name", F.explode(F.transform(F.arrays_zip("start", "no", "end"), phase)).alias("x")).select("run_id", "name", "x.*")


def marker_nodes(found: DataFrame, steps: DataFrame | None = None) -> DataFrame:
    """Marker nodes of phases with their phase key. ``steps`` (run_id, agent_id, step_key) gives the key of the subagent around a phase."""
    df = found.withColumn("enclosing", F.lit("")) if steps is None else found.join(steps.select("run_id", "agent_id", F.col("step_key").alias("enclosing")), ["run_id", "agent_id"], "left").fillna("", ["enclosing"])
    ms = F.expr("timestampdiff(MILLISECOND, t_start, t_end)").cast("long")
    return df.select(
        "run_id", F.concat_ws(":", "run_id", F.lit("marker"), "name", F.col("occurrence").cast("string")).alias("id"), F.lit("marker").alias("type"), "name", "occurrence", F.when(F.col("closed"), "ok").otherwise("running").alias("status"),
        phase_key(F.col("enclosing"), F.col("name"), F.col("occurrence")).alias("phase_key"), "t_start", "t_end", F.when(ms >= 0, ms).alias("duration_ms"), "state_ref",
    )
