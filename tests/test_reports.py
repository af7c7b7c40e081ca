"""Report lines, sessions, versions, selectors and lines of files in splits."""

import json
import random

import pytest
import zstandard
from pyspark.sql import functions as F

from tracelake.functions import text
from tracelake.operators import compare as cmp
from tracelake.operators import sessions
from tracelake.plans import report
from tracelake.sources import rollout, transcript

FINDINGS = [
    ("step", "k1", "a|b", "presence", "notable", 0.0, 1.0, 1.0, 0.0, 0.25, "present 4/4 -> 0/4"),
    ("total", "", "", "tokens_in", "ok", 200.0, 210.0, 10.0, 150.0, 250.0, ""),
    ("phase", "p", "plan", "metrics", "insufficient", 0.0, 0.0, 0.0, 0.0, 0.0, "absent in candidate"),
    ("total", "", "", "cost_usd", "regression", 0.5, 1.25, 0.75, 0.25, 0.75, ""),
]


def lines(df):
    return [r["line"] for r in df.orderBy("no").collect()]


def test_reports(spark):
    df = spark.createDataFrame(FINDINGS, "scope string, key string, name string, metric string, verdict string, baseline double, candidate double, delta double, band_lo double, band_hi double, detail string")
    assert lines(report.text(df)) == [
        "VERDICT       SCOPE  KEY  NAME  METRIC     BASELINE  CANDIDATE  BAND              DETAIL",
        "regression    total  -    -     cost_usd   0.50      1.25       [0.25, 0.75]      -",
        "ok            total  -    -     tokens_in  200.00    210.00     [150.00, 250.00]  -",
        "insufficient  phase  p    plan  metrics    0.00      0.00       -                 absent in candidate",
        "notable       step   k1   a|b   presence   1.00      0.00       [0.75, 1.00]      present 4/4 -> 0/4",
    ]
    got = lines(report.markdown(df))
    assert got[:2] == ["| Verdict | Scope | Key | Name | Metric | Baseline | Candidate | Band | Detail |", "|---|---|---|---|---|---|---|---|---|"]
    assert got[-1] == "| notable | step | k1 | a\\|b | presence | 1.00 | 0.00 | [0.75, 1.00] | present 4/4 -> 0/4 |" and len(got) == 6
    told = [json.loads(x) for x in lines(report.json(df))]
    assert told[1] == {"scope": "total", "metric": "tokens_in", "verdict": "ok", "baseline": 200.0, "candidate": 210.0, "delta": 10.0, "band_lo": 150.0, "band_hi": 250.0}
    assert [(x["scope"], x.get("key")) for x in told] == [("total", None), ("total", None), ("phase", "p"), ("step", "k1")]
    assert lines(report.text(df.limit(0))) == ["VERDICT  SCOPE  KEY  NAME  METRIC  BASELINE  CANDIDATE  BAND  DETAIL"]


def test_audit_flags_in_order(spark):
    df = spark.createDataFrame([("baseline", "b", "turns"), ("baseline", "a", "tokens_in"), ("baseline", "a", "duration_ms")], "grp string, run_id string, metric string")
    assert [(r["run_id"], r["metric"]) for r in cmp.audit_order(df).collect()] == [("a", "duration_ms"), ("a", "tokens_in"), ("b", "turns")]


def test_sessions(spark):
    nodes = [
        ("r", "p2", "user_prompt", None, "t2", '"two"', None), ("r", "p1", "user_prompt", None, "t1", None, None), ("r", "a1", "assistant_turn", None, "t3", None, '"said"'), ("r", "b1", "tool_call", "Bash", "t3", '{"a":1}', '"out"'),
        ("r", "a2", "assistant_turn", "x", "t4", None, None), ("r", "c0", "mcp_call", "m", None, "[1]", None), ("r", "s", "skill", "k", "t9", None, None), ("q", "z", "session", None, None, None, None),
    ]
    df = spark.createDataFrame(nodes, "run_id string, id string, type string, name string, t_start string, input string, output string")
    assert {r["run_id"]: (r["input"], r["output"]) for r in sessions.ends(df).collect()} == {"r": ("", '"said"'), "q": ("", "")}
    got = sorted(tuple(r) for r in sessions.steps(df).collect())
    assert got == [("r", 1, "tool", "m", "[1]", None), ("r", 2, "llm", "assistant_turn", None, '"said"'), ("r", 3, "tool", "Bash", '{"a":1}', '"out"'), ("r", 4, "llm", "x", None, None)]
    assert sorted(tuple(r) for r in sessions.tools(df).collect()) == [("r", 1, "m", None, None), ("r", 2, "Bash", '{"a":1}', '"out"')]


def compared(a, b):
    """-1, 0 or 1 by segments, missing ones as 0."""
    digits = lambda s: int("".join(__import__("itertools").takewhile(lambda c: "0" <= c <= "9", s)) or 0)
    x, y = [[digits(s) for s in v.split(".")] for v in (a, b)]
    n = max(len(x), len(y))
    x, y = x + [0] * (n - len(x)), y + [0] * (n - len(y))
    return (x > y) - (x < y)


def test_versions_of_any_length(spark):
    r = random.Random(6)
    versions = ["1.2.3.4.5.6.7.8.9", "1.2.3.4.5.6.7.8", "1.2.0.0", "1.2", "0", "", "rc", "1.10-beta", "1.9.9"] + [".".join(str(r.randrange(3)) for _ in range(r.randrange(1, 12))) for _ in range(40)]
    df = spark.createDataFrame([(v,) for v in versions], "v string").select("v", text.version_key(F.col("v")).alias("k"))
    keys = {r["v"]: r["k"] for r in df.collect()}
    for a in versions:
        for b in versions:
            assert (keys[a] > keys[b]) - (keys[a] < keys[b]) == compared(a, b), (a, b)
    obs = spark.createDataFrame([("r", "1.2", 3), ("r", "1.2.0", 1), ("r", None, 9), ("r", "1.1.9", 2), ("q", None, 1)], "run string, version string, seq long")
    assert {r["run"]: r["v"] for r in obs.groupBy("run").agg(text.newest("version", "seq").alias("v")).collect()} == {"r": "1.2.0", "q": None}


def test_selectors_of_phases():
    assert text.parse_phase("plan") == ("plan", 0) and text.parse_phase("plan,2") == ("plan", 2)
    assert text.parse_window(phase="a,1") == (("a", 1), None) and text.parse_window(start="a", end="b,3") == (("a", 0), ("b", 3))
    for bad in (dict(start="a"), dict(end="a"), dict(phase="p", start="a", end="b"), dict(phase="a,x"), dict(phase="a,")):
        with pytest.raises(ValueError):
            text.parse_window(**bad)


def test_lines_of_split_files(spark, tmp_path):
    """Files in many splits have the line numbers of whole files, and sessions in them one numbering."""
    want = {}
    for name, n in (("a.jsonl", 5000), ("b.jsonl", 40), ("c.jsonl", 0)):
        values = [json.dumps({"type": "user", "sessionId": "s", "timestamp": "2025-01-01T00:00:00Z", "message": {"content": f"{name} {k}" + "x" * (k % 90)}}) if k % 7 else "  " for k in range(n)]
        (tmp_path / name).write_text("\n".join(values) + ("\n" if n % 2 else ""))
        want |= {(name, k): v for k, v in enumerate(values) if v.strip()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        df = transcript.lines(spark, str(tmp_path / "*.jsonl"))
        assert df.rdd.getNumPartitions() > 1
        assert {(r["path"].rsplit("/", 1)[1], r["line_no"]): r["value"] for r in df.collect()} == want
        obs = transcript.observations(df)
        seqs = [(r["path"].rsplit("/", 1)[1], r["line_no"]) for r in obs.orderBy("seq").collect()]
        assert seqs == sorted(want) and [r["seq"] for r in obs.orderBy("seq").select("seq").collect()] == list(range(1, len(want) + 1))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_compressed_rollouts_are_unpacked_in_blocks(spark, tmp_path, monkeypatch):
    values = [json.dumps({"type": "event_msg", "n": k}) if k % 5 else "" for k in range(9000)]
    (tmp_path / "a.jsonl.zst").write_bytes(zstandard.compress("\n".join(values).encode()))
    (tmp_path / "b.jsonl").write_text("\n".join(values[:10]))
    for paths in (str(tmp_path), [str(tmp_path / "a.jsonl.zst"), str(tmp_path / "b.jsonl")]):
        got = {(r["path"].rsplit("/", 1)[1], r["line_no"]): r["value"] for r in rollout.read(spark, paths).collect()}
        assert got == {(name, k): v for name, n in (("a.jsonl.zst", 9000), ("b.jsonl", 10)) for k, v in enumerate(values[:n]) if v}
