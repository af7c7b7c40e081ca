"""From folders of runs to findings and verdict."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracelake.operators import aggregate as agg
from tracelake.plans import load
from tracelake.sources import evidence

START = datetime(2025, 1, 1, 10)


def stamp(seconds):
    return (START + timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%SZ")


def write_run(root, name, variant, calls, failed=False, exit_code=0, score=None, slow=1):
    """A run with one prompt, a phase, and so many pairs of calls and results; the last one fails where asked."""
    folder = root / name
    folder.mkdir(parents=True)
    lines, t = [], 0

    def line(kind, content, **message):
        nonlocal t
        t += slow
        lines.append(json.dumps({"type": kind, "uuid": f"{name}-{t}", "sessionId": f"s-{name}", "timestamp": stamp(t), "message": {"content": content, **message}}))

    line("user", "[task] do it", role="user")
    use = {"input_tokens": 10, "output_tokens": 5}
    line("assistant", [{"type": "tool_use", "id": "m1", "name": "mcp__tracelake__mark", "input": {"name": "work", "boundary": "start"}}], id="a0", model="claude-haiku-4-5", usage=use)
    for k in range(calls):
        line("assistant", [{"type": "tool_use", "id": f"t{k}", "name": "Bash", "input": {"command": f"run {k}"}}], id=f"a{k + 1}", model="claude-haiku-4-5", usage=use)
        line("user", [{"type": "tool_result", "tool_use_id": f"t{k}", "content": "x", "is_error": failed and k == calls - 1}])
    line("assistant", [{"type": "tool_use", "id": "m2", "name": "mcp__tracelake__mark", "input": {"name": "work", "boundary": "end"}}], id="z", model="claude-haiku-4-5", usage=use)
    (folder / "session.jsonl").write_text("\n".join(lines) + "\n")
    meta = {"run_id": name, "task": "t", "variant": variant, "rep": 1, "session_id": f"s-{name}", "labels": {"variant": variant}, "exit_code": exit_code, "marker_name": "whole", "marker_start": stamp(0), "marker_end": stamp(t + 1)}
    (folder / "meta.json").write_text(json.dumps(meta))
    if score is not None:
        (folder / "scores.jsonl").write_text(json.dumps({"key": "judge.score", "value": score}) + "\n" + json.dumps({"key": "judge.score", "value": score, "run_id": name}) + "\n" if score else "")


def test_evidence_to_verdict(spark, tmp_path):
    root = tmp_path / "runs"
    for k in range(5):
        write_run(root, f"a{k}", "old", 3)
        write_run(root, f"b{k}", "new", 3, failed=True, exit_code=int(k == 0), slow=2)
    write_run(root, "other", "none", 2)
    (root / "broken").mkdir()
    (root / "broken" / "meta.json").write_text("{")
    m = load.load(spark, str(root), "label:variant=old", "label:variant=new")
    assert {(r["run_id"], r["grp"], r["status"]) for r in m.runs.collect()} == {(f"a{k}", "baseline", "running") for k in range(5)} | {(f"b{k}", "candidate", "error" if k == 0 else "running") for k in range(5)}
    nodes = m.nodes.where("run_id = 'b1'").collect()
    assert sorted(r["type"] for r in nodes) == ["assistant_turn"] * 5 + ["marker"] * 2 + ["session"] + ["tool_call"] * 3 + ["user_prompt"]
    assert sorted((r["name"], r["status"]) for r in nodes if r["type"] == "marker") == [("whole", "ok"), ("work", "ok")]
    assert all(len(r["step_key"]) == 32 for r in nodes if r["type"] == "tool_call") and sum(r["status"] == "error" for r in nodes) == 1
    # the same step has one key in all runs
    keys = {(r["run_id"], r["step_key"]) for r in m.nodes.where("type = 'tool_call'").collect()}
    assert len(keys) == 30 and len({k for _, k in keys}) == 3
    findings, verdict = load.regress(spark, str(root), "label:variant=old", "label:variant=new")
    found = {(r["scope"], r["metric"]): r["verdict"] for r in findings.collect() if r["scope"] in ("total", "run")}
    assert found["total", "error_rate"] == "regression" and found["total", "duration_ms"] == "regression" and found["total", "tokens_in"] == "ok"
    steps = [r for r in findings.collect() if r["scope"] == "step" and r["metric"] == "error_rate"]
    assert [r["verdict"] for r in steps] == ["regression"]
    assert verdict.count() == 1
    same, _ = load.regress(spark, str(root), "label:variant=old", "label:variant=old")
    assert {r["verdict"] for r in same.collect()} <= {"ok", "insufficient"}


def test_selectors_of_evidence():
    with pytest.raises(ValueError):
        load.selected("name:x")


def write_rollout(root, name, variant, calls, failed=False, runtime="codex"):
    """A run of the second runtime: one prompt and a turn for each call; the last one fails where asked."""
    folder = root / name
    folder.mkdir(parents=True)
    lines, t = [], 0

    def line(kind, **payload):
        nonlocal t
        t += 1
        lines.append(json.dumps({"type": kind, "timestamp": stamp(t), "payload": payload}))

    line("session_meta", id=f"s-{name}", cli_version="1.0", cwd="/w")
    line("response_item", type="message", role="user", content=[{"type": "input_text", "text": "do it"}])
    for k in range(calls):
        line("turn_context", turn_id=f"u{k}", model="gpt-5.1")
        line("response_item", type="function_call", call_id=f"c{k}", name="shell", arguments=json.dumps({"command": f"run {k}"}))
        line("response_item", type="function_call_output", call_id=f"c{k}", output="Process exited with code " + str(int(failed and k == calls - 1)))
        line("event_msg", type="token_count", info={"last_token_usage": {"input_tokens": 30, "cached_input_tokens": 10, "output_tokens": 4}})
        line("event_msg", type="task_complete", turn_id=f"u{k}")
    (folder / "session.jsonl").write_text("\n".join(lines) + "\n")
    meta = {"run_id": name, "task": "t", "variant": variant, "rep": 1, "session_id": f"s-{name}", "labels": {"variant": variant}, "exit_code": 0, "marker_name": "whole", "marker_start": stamp(0), "marker_end": stamp(t + 1), "env": {"agent_runtime": runtime}}
    (folder / "meta.json").write_text(json.dumps(meta))


def test_runs_of_both_runtimes_with_scores_of_steps(spark, tmp_path):
    root = tmp_path / "runs"
    for k in range(3):
        write_run(root, f"a{k}", "old", 2, score=0.5)
        write_rollout(root, f"b{k}", "new", 2, failed=k == 0)
    m = load.load(spark, str(root), "label:variant=old", "label:variant=new")
    nodes = m.nodes.where("run_id = 'b0'").collect()
    assert sorted(r["type"] for r in nodes) == ["assistant_turn"] * 2 + ["marker", "session"] + ["tool_call"] * 2 + ["user_prompt"]
    assert sum(r["tokens_in"] or 0 for r in nodes) == 40 and sum(r["status"] == "error" for r in nodes) == 1 and all((r["cost_usd"] or 0) > 0 for r in nodes if r["type"] == "assistant_turn")
    steps = {r["name"]: r["step_key"] for r in m.nodes.where("run_id = 'a0' AND type = 'tool_call'").collect()} | {f"shell{r['id'][-1]}": r["step_key"] for r in m.nodes.where("run_id = 'b0' AND type = 'tool_call'").collect()}
    key = steps["shell0"]
    (root / "b0" / "scores.jsonl").write_text("\n".join(json.dumps(x) for x in ({"key": "judge.step", "value": 1, "step_key": key}, {"key": "judge.step", "value": 2, "step_key": key}, {"key": "judge.step", "value": 9, "step_key": key, "run_id": "b1"}, {"key": "judge.gone", "value": 1, "step_key": "nowhere"})))
    outside = tmp_path / "more.jsonl"
    outside.write_text("\n".join(json.dumps(x) for x in ({"key": "judge.all", "value": 0.25, "step_key": key}, {"key": "judge.step", "value": 5, "step_key": key, "run_id": "b0"}, {"key": "judge.score", "value": 0.75, "run_id": "a1"}, {"key": "judge.score", "value": 1, "run_id": "elsewhere"})))
    told = lambda m: {(r["run_id"], r["key"]): r["value"] for r in m.node_annotations.selectExpr("run_id", "key", "CAST(value AS double) AS value").collect()}
    own = load.load(spark, str(root), "label:variant=old", "label:variant=new")
    assert told(own) == {("b0", "judge.step"): 2.0}
    more = load.load(spark, str(root), "label:variant=old", "label:variant=new", scores=str(outside))
    assert told(more) == {("b0", "judge.step"): 5.0} | {(f"b{k}", "judge.all"): 0.25 for k in range(3)}
    assert {(r["run_id"], r["value"]) for r in more.annotations.collect()} == {("a0", 0.5), ("a1", 0.75), ("a2", 0.5)}
    lines = evidence.scores(spark, str(outside))
    before = own.node_annotations.select("run_id", "id", "key").unionByName(own.annotations.selectExpr("run_id", "CAST(NULL AS string) AS id", "key"))
    assert evidence.score_counts(own.nodes, own.runs, lines, before).first().asDict() == {"applied": 5, "unmatched": 1, "overridden": 2}
    rows = {(r["grp"], r["key"]): r["annotations"] for r in agg.step_rows(more, ("judge.step", "judge.all")).where(F.col("key") == key).collect()}
    assert rows["candidate", key]["judge.all"]["n"] == 3 and rows["candidate", key]["judge.step"]["median"] == 5.0


def test_two_folders_of_a_run_and_unknown_runtimes_fail(spark, tmp_path):
    root = tmp_path / "runs"
    write_rollout(root, "a", "old", 1)
    write_rollout(root, "b", "new", 1, runtime="other")
    with pytest.raises(Exception, match="unknown runtime other"):
        load.load(spark, str(root), "label:variant=old", "label:variant=new")
    meta = json.loads((root / "a" / "meta.json").read_text())
    (root / "b" / "meta.json").write_text(json.dumps(meta))
    with pytest.raises(Exception, match="has two folders"):
        load.load(spark, str(root), "label:variant=old", "label:variant=new")


def test_transcripts_of_sessions(spark):
    files = spark.createDataFrame([("h/p/s1.jsonl",), ("h/p/s1/subagents/agent-2.jsonl",), ("h/p/s1/subagents/agent-1.jsonl",), ("h/q/s2.jsonl",), ("h/p/s3.jsonl",), ("h/q/s3.jsonl",)], "path string")
    of = lambda *ids: evidence.resolve(files, spark.createDataFrame([(i,) for i in ids], "session_id string"))
    assert sorted((r["session_id"], r["main"], r["subagents"]) for r in of("s1", "s2", "s1").collect()) == [("s1", "h/p/s1.jsonl", ["h/p/s1/subagents/agent-1.jsonl", "h/p/s1/subagents/agent-2.jsonl"]), ("s2", "h/q/s2.jsonl", [])]
    with pytest.raises(Exception, match="ambiguous session s3: 2 matches"):
        of("s3").collect()
    with pytest.raises(Exception, match="no transcript for session s4"):
        of("s4").collect()


def test_annotations_as_numbers(spark):
    given = {"1": 1.0, "2.5": 2.5, "1e3": 1000.0, "null": 0.0, '"7"': None, "true": None, "[1]": None, "{}": None}
    df = spark.createDataFrame([(k,) for k in given], "j string").select("j", agg.numeric(F.parse_json("j")).alias("v"))
    assert {r["j"]: r["v"] for r in df.collect()} == given
