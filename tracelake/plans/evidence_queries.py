"""``conversations`` as evidence of runs of both runtimes, through the loader to the gate, with its SQL.

Every conversation is a run: even ones are sessions of the first runtime, odd ones rollouts of the second. A user's
turn is a prompt, an assistant's a model turn with one call of a tool, which fails where the text's length is a
multiple of seven. Each run has a marker around it, a score of its own and one that names another run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import text
from tracelake.functions.pricing import FAMILIES
from tracelake.operators import aggregate as agg
from tracelake.operators import compare as cmp
from tracelake.operators import reduce, sessions
from tracelake.plans import gate, gate_sql, load, workloads
from tracelake.plans.model import Model
from tracelake.plans.thresholds import DEFAULT
from tracelake.plans.views import VIEWS, gate_model, table
from tracelake.sources import evidence, transcript

_MODEL = {0: "claude-haiku-4-5", 1: "gpt-5.1"}
_START = 1_700_000_000


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("conv_id IS NOT NULL AND turn IS NOT NULL")
    return c.select("conv_id", F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("run_id"), "turn", "role", F.char_length(F.coalesce("text", F.lit(""))).alias("n"))


def _json(**fields) -> Column:
    return F.to_json(F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()]))


def _object(**fields) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()])


def transcripts(turns: DataFrame) -> DataFrame:
    """Transcript lines of the turns: path, line_no, value."""
    turn = F.col("turn").cast("string")
    at = F.date_format(F.timestamp_seconds(F.col("turn") * 10 + F.lit(_START)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    name = lambda k: F.concat(F.lit(k), turn)
    command = F.concat(F.lit("run "), turn)
    fails, tokens = F.col("n") % 7 == 0, (F.col("n") % 100, F.col("n") % 50)
    line = lambda kind, message: _json(type=kind, sessionId=F.col("run_id"), uuid=F.concat_ws("-", "run_id", turn), timestamp=at, message=message)
    use = _object(type="tool_use", id=name("t"), name="Bash", input=_object(command=command))
    said = _object(id=name("m"), model=_MODEL[0], usage=_object(input_tokens=tokens[0], output_tokens=tokens[1]), content=F.array(use))
    main = {
        "user": [line("user", _object(role="user", content=name("ask ")))],
        "assistant": [line("assistant", said), line("user", _object(content=F.array(_object(type="tool_result", tool_use_id=name("t"), content="x", is_error=fails))))],
    }
    record = lambda kind, payload: _json(type=kind, timestamp=at, payload=payload)
    usage = _object(last_token_usage=_object(input_tokens=tokens[0] + 5, cached_input_tokens=5, output_tokens=tokens[1]))
    output = F.concat(F.lit("done\nProcess exited with code "), F.when(fails, "1").otherwise("0"))
    rollout = {
        "user": [record("response_item", _object(type="message", role="user", content=F.array(_object(type="input_text", text=name("ask ")))))],
        "assistant": [
            record("turn_context", _object(turn_id=name("m"), model=_MODEL[1])),
            record("response_item", _object(type="function_call", call_id=name("t"), name="shell", arguments=_json(command=command))),
            record("response_item", _object(type="function_call_output", call_id=name("t"), output=output)),
            record("event_msg", _object(type="token_count", info=usage)),
            record("event_msg", _object(type="task_complete", turn_id=name("m"))),
        ],
    }
    odd = F.col("conv_id") % 2 == 1
    none = F.array().cast("array<string>")
    values = none
    for runtime, lines in ((~odd, main), (odd, rollout)):
        for role, each in lines.items():
            values = F.when(runtime & (F.col("role") == role), F.array(*each)).otherwise(values)
    path = F.concat(F.lit("runs/"), "run_id", F.lit("/session.jsonl"))
    facts = turns.select(path.alias("path"), "turn", F.posexplode(values).alias("k", "value")).select("path", (F.col("turn") * 8 + F.col("k") + 8).cast("int").alias("line_no"), "value")
    heads = turns.where(odd).groupBy("run_id").agg(F.min("turn").alias("turn")).select(path.alias("path"), F.lit(0).alias("line_no"), record("session_meta", _object(id=F.col("run_id"), cli_version="1.0", cwd="/w")).alias("value"))
    return facts.unionByName(heads)


def documents(turns: DataFrame) -> DataFrame:
    """Run documents with group and folder."""
    r = turns.groupBy("conv_id", "run_id").agg(F.max("turn").alias("last"))
    variant = F.when(F.col("conv_id") % 4 < 2, "old").otherwise("new")
    docs = r.select(
        "run_id", F.concat(F.lit("t"), (F.col("conv_id") % 5).cast("string")).alias("task"), F.create_map(F.lit("variant"), variant).alias("labels"), F.when(F.col("conv_id") % 10 == 0, 1).otherwise(0).alias("exit_code"),
        F.lit("whole").alias("marker_name"), F.timestamp_seconds(F.lit(_START - 1)).alias("marker_start"), F.timestamp_seconds(F.col("last") * 10 + F.lit(_START + 11)).alias("marker_end"),
        F.struct(F.when(F.col("conv_id") % 2 == 1, load.ROLLOUT_RUNTIME).when(F.col("conv_id") % 4 == 0, load.MAIN_RUNTIME).alias("agent_runtime")).alias("env"), F.concat(F.lit("runs/"), "run_id").alias("dir"),
    )
    return load.grouped(docs, "label:variant=old", "label:variant=new")


def score_lines(turns: DataFrame) -> DataFrame:
    """Score lines as their folders hold them: own ones without and with the run's id, and one that names another run."""
    r = turns.groupBy("conv_id", "run_id").agg(F.count_if(F.col("n") % 7 == 0).alias("bad"))
    lines = F.array(
        F.struct(F.lit("judge.score").alias("key"), F.lit(9.0).alias("value"), F.lit(None).cast("string").alias("run_id")),
        F.struct(F.lit("judge.score").alias("key"), (F.col("conv_id") % 10 / 10).cast("double").alias("value"), F.col("run_id").alias("run_id")),
        F.struct(F.lit("judge.score").alias("key"), F.lit(7.0).alias("value"), F.lit("c-other").alias("run_id")),
        F.struct(F.lit("verifier.pass").alias("key"), F.when(F.col("bad") == 0, 1.0).otherwise(0.0).alias("value"), F.lit(None).cast("string").alias("run_id")),
    )
    each = r.select(F.col("run_id").alias("folder"), F.concat(F.lit("runs/"), "run_id", F.lit("/scores.jsonl")).alias("path"), F.posexplode(lines).alias("line_no", "s"))
    return each.select("folder", "path", "line_no", "s.key", "s.value", F.lit(None).cast("string").alias("step_key"), "s.run_id")


def evidence_model(spark: SparkSession, sf_dir: str) -> Model:
    t = _turns(spark, sf_dir)
    return load.assemble(documents(t), transcripts(t), score_lines(t))


def evidence_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.cells(evidence_model(spark, sf_dir)).withColumn("cost_usd", F.round("cost_usd", 9))  # prices have no more decimals


def evidence_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of totals and run annotations over runs of both runtimes."""
    m = evidence_model(spark, sf_dir)
    found = cmp.total_findings(agg.totals(agg.cells(m)), DEFAULT).unionByName(cmp.annotation_findings(agg.annotation_totals(m), gate.SPECS, DEFAULT))
    return gate._rounded(found)


def evidence_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transcripts of conversations among the files of all projects; every fourth has files of subagents, one a turn."""
    t = _turns(spark, sf_dir)
    path = F.concat(F.lit("home/p"), (F.col("conv_id") % 7).cast("string"), F.lit("/"), "run_id")
    mains = t.select(F.concat(path, F.lit(".jsonl")).alias("path")).distinct()
    subs = t.where("conv_id % 4 = 0").select(F.concat(path, F.lit("/subagents/agent-"), F.lpad(F.col("turn").cast("string"), 4, "0"), F.lit(".jsonl")).alias("path")).distinct()
    found = evidence.resolve(mains.unionByName(subs), t.select(F.col("run_id").alias("session_id")))
    return found.select("session_id", "main", F.array_join("subagents", ",").alias("subagents"))


def _session_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = reduce.nodes(transcript.observations(workloads.transcript_lines(spark, sf_dir)))
    return nodes.withColumn("t_start", sessions.stamp(F.col("t_start")))


def _said(c: str) -> Column:
    """Characters of a payload side that is a JSON text."""
    return F.coalesce(F.char_length(F.try_variant_get(F.try_parse_json(c), "$", "string")), F.lit(0))


def session_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of every conversation's first prompt and last answer."""
    return sessions.ends(_session_nodes(spark, sf_dir)).select("run_id", _said("input").alias("n_input"), _said("output").alias("n_output"))


def session_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns and calls of every conversation in order."""
    found = sessions.steps(_session_nodes(spark, sf_dir))
    return found.select("run_id", "step_no", "kind", "name", F.when(F.col("kind") == "tool", F.col("input")).otherwise(F.lit("")).alias("input"), _said("output").alias("n_output"))


def newest_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of one to twelve segments, made from order keys: the newest by priority."""
    o = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey")
    version = F.expr("array_join(transform(sequence(0, int(o_orderkey % 12)), i -> string((o_orderkey div (i + 1)) % 3)), '.')")
    return o.select("o_orderpriority", "o_orderkey", version.alias("version")).groupBy("o_orderpriority").agg(text.newest("version", "o_orderkey").alias("version"))


def missing_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoints p2 to p5 of runs that have markers p0 to p3."""
    m = gate_model(spark, sf_dir)
    expected = m.runs.select("run_id", F.explode(F.array(*[F.lit(f"p{k}") for k in range(2, 6)])).alias("name"))
    return sessions.missing_checkpoints(m.nodes, expected)


def _cost(odd: int) -> str:
    into, out, cached, _ = FAMILIES["claude-haiku-" if not odd else "gpt-5.1"]
    return f"(n % 100) * {into} / 1e6 + (n % 50) * {out} / 1e6" + (f" + 5 * {cached} / 1e6" if odd else "")


_CTES = f"""
WITH conv AS (SELECT conv_id, 'c' || conv_id AS run_id, turn, role, length(coalesce(text, '')) AS n FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
runx AS (SELECT run_id, conv_id, CASE WHEN conv_id % 4 < 2 THEN 'baseline' ELSE 'candidate' END AS grp, 't' || conv_id % 5 AS task, (max(turn) * 10 + 12) * 1000.0 AS ms, conv_id % 10 = 0 AS failed FROM conv GROUP BY run_id, conv_id),
facts AS (SELECT run_id, count(*) FILTER (WHERE role = 'user') AS prompts, count(*) FILTER (WHERE role = 'assistant') AS said, count(*) FILTER (WHERE role = 'assistant' AND n % 7 = 0) AS bad,
  sum(n % 100) FILTER (WHERE role = 'assistant') AS tokens_in, sum(n % 50) FILTER (WHERE role = 'assistant') AS tokens_out, sum(CASE WHEN conv_id % 2 = 1 THEN {_cost(1)} ELSE {_cost(0)} END) FILTER (WHERE role = 'assistant') AS cost_usd FROM conv GROUP BY run_id),
cell AS (SELECT run_id, grp, task, ms::DOUBLE AS duration_ms, coalesce(cost_usd, 0)::DOUBLE AS cost_usd, coalesce(tokens_in, 0)::DOUBLE AS tokens_in, coalesce(tokens_out, 0)::DOUBLE AS tokens_out,
  (CASE WHEN conv_id % 2 = 0 AND prompts + said = 0 THEN 1 ELSE 2 + prompts + 2 * said END)::DOUBLE AS nodes, said::DOUBLE AS turns, failed OR bad > 0 AS has_error FROM runx JOIN facts USING (run_id)),
ann AS (SELECT run_id, 'judge.score' AS key, conv_id % 10 / 10.0::DOUBLE AS value FROM runx UNION ALL SELECT run_id, 'verifier.pass', (count(*) FILTER (WHERE n % 7 = 0) = 0)::INT::DOUBLE FROM conv GROUP BY run_id)
"""

QUERIES = {f.__name__: f for f in (evidence_cells, evidence_findings, evidence_resolved, session_ends, session_steps, newest_versions, missing_checkpoints)}
_SAID = "WITH conv AS (SELECT 'c' || conv_id AS run_id, turn, role, length(coalesce(text, '')) AS n FROM conversations)"
ORACLE_SQL = {
    "session_ends": f"{_SAID} SELECT run_id, coalesce(arg_min(n, turn) FILTER (WHERE role = 'user' AND n > 0), 0)::INT AS n_input, coalesce(arg_max(n, turn) FILTER (WHERE role = 'assistant' AND n > 0), 0)::INT AS n_output FROM conv WHERE role IN ('user', 'assistant') GROUP BY run_id",
    "session_steps": f"""{_SAID} SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY turn, kind) AS step_no, kind, name, input, n_output FROM (
      SELECT run_id, turn, 'llm' AS kind, 'assistant_turn' AS name, '' AS input, n::INT AS n_output FROM conv WHERE role = 'assistant' UNION ALL
      SELECT run_id, turn, 'tool', 'Bash', '{{"command":"wc ' || n || '"}}', 0 FROM conv WHERE role = 'assistant')""",
    "newest_versions": """WITH v AS (SELECT o_orderpriority, o_orderkey, list_transform(range(0, o_orderkey % 12 + 1), lambda i: (o_orderkey // (i + 1)) % 3) AS parts FROM orders),
      k AS (SELECT *, list_slice(parts, 1, coalesce(list_max(list_transform(range(1, len(parts) + 1), lambda i: CASE WHEN parts[i] <> 0 THEN i ELSE 0 END)), 0)) AS key FROM v)
      SELECT o_orderpriority, array_to_string(parts, '.') AS version FROM k QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY key DESC, o_orderkey) = 1""",
    "missing_checkpoints": f"WITH {VIEWS.strip()} SELECT run_id, e.name FROM runx r, (SELECT unnest(['p2', 'p3', 'p4', 'p5']) AS name) e WHERE NOT EXISTS (SELECT 1 FROM node n WHERE n.run_id = r.run_id AND n.type = 'marker' AND n.name = e.name)",
    "evidence_cells": f"{_CTES} SELECT run_id, grp, task, duration_ms, round(cost_usd, 9) AS cost_usd, tokens_in, tokens_out, nodes, turns, has_error FROM cell",
    "evidence_findings": f"{_CTES}, {gate_sql._TOT}, {gate_sql._ANN} {gate_sql._total_findings()} UNION ALL {gate_sql._annotation_findings()}",
    "evidence_resolved": "SELECT 'c' || conv_id AS session_id, 'home/p' || conv_id % 7 || '/c' || conv_id || '.jsonl' AS main, CASE WHEN conv_id % 4 = 0 THEN string_agg(DISTINCT 'home/p' || conv_id % 7 || '/c' || conv_id || '/subagents/agent-' || lpad(turn::VARCHAR, 4, '0') || '.jsonl', ',' ORDER BY 'home/p' || conv_id % 7 || '/c' || conv_id || '/subagents/agent-' || lpad(turn::VARCHAR, 4, '0') || '.jsonl') ELSE '' END AS subagents FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id",
}
