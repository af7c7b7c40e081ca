"""Transcripts, reduction, phases, diffs, tables and history on small cases."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tracelake.functions import text
from tracelake.operators import diff, history, judge, markers, reduce, tables
from tracelake.sources import evidence, rollout, transcript
from tracelake.streaming import live


def line(kind, stamp, message=None, **more):
    return json.dumps({"type": kind, "sessionId": "s1", "timestamp": f"2025-01-01T10:00:{stamp:02d}Z", **({"message": message} if message else {}), **more})


def tool_use(tool, use, **given):
    return {"type": "tool_use", "id": use, "name": tool, "input": given}


SESSION = [
    line("user", 0, {"role": "user", "content": "do it"}, uuid="u1", cwd="/w", version="1.2.0"),
    line("assistant", 1, {"id": "m1", "model": "claude-haiku-4-5", "usage": {"input_tokens": 10, "output_tokens": 5}, "content": [{"type": "text", "text": "one "}, {"type": "text", "text": "two"}, tool_use("Bash", "t1", command="ls")]}),
    line("assistant", 2, {"id": "m1", "model": "claude-haiku-4-5", "usage": {"input_tokens": 20, "output_tokens": 7}, "content": [tool_use("mcp__fs__read", "t2", path="a")]}),
    line("user", 3, {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t1", "content": "x"}, {"type": "tool_result", "tool_use_id": "t2", "content": "no", "is_error": True}, {"type": "odd"}]}),
    line("assistant", 4, {"id": "m2", "model": "claude-haiku-4-5", "content": [tool_use("mcp__tracelake__mark", "k1", name="plan", boundary="start")]}),
    line("assistant", 7, {"id": "m3", "model": "claude-haiku-4-5", "content": [tool_use("mcp__tracelake__mark", "k2", name="plan", boundary="end")]}),
    line("novel", 8),
]


@pytest.fixture(scope="module")
def session(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("t") / "s1.jsonl"
    path.write_text("\n".join(SESSION) + "\n")
    return transcript.lines(spark, str(path))


def test_session_graph(spark, session):
    obs = transcript.observations(session).cache()
    nodes = {r["id"]: r for r in reduce.nodes(obs).collect()}
    kinds = sorted((r["type"], r["status"]) for r in nodes.values() if r["type"] in ("tool_call", "mcp_call"))
    assert kinds == [("mcp_call", "error"), ("tool_call", "ok")]
    turn = nodes["s1:turn:m1"]
    assert (turn["tokens_in"], turn["tokens_out"]) == (20, 7) and turn["cost_usd"] == 20 / 1e6 * 1 + 7 / 1e6 * 5 and turn["output"] == '"one two"'  # the last line's counts, not their sum
    assert nodes["s1:tool:t1"]["duration_ms"] == 2000 and nodes["s1:tool:t2"]["name"] == "mcp__fs__read" and not any("k1" in k for k in nodes)
    edges = {(r["src"], r["dst"]) for r in reduce.parents(obs).collect()}
    prompt = next(k for k in nodes if ":prompt:" in k)
    assert {("session:s1", prompt), (prompt, "s1:turn:m1"), ("s1:turn:m1", "s1:tool:t1"), ("s1:turn:m1", "s1:tool:t2")} <= edges
    run = reduce.runs(obs).first()
    assert (run["model"], run["version"], run["cwd"], run["session_ids"], run["status"]) == ("claude-haiku-4-5", "1.2.0", "/w", ["s1"], "running")
    assert {r["reason"]: r["n"] for r in transcript.drift(session).collect()} == {"unknown_record_type": 1, "unknown_content_block": 1}


def test_phases_of_a_session(spark, session):
    obs = transcript.observations(session)
    found = reduce.marker_nodes(reduce.phases(reduce.marker_bounds(obs))).collect()
    assert [(r["name"], r["occurrence"], r["status"], r["duration_ms"]) for r in found] == [("plan", 0, "ok", 3000)]


def test_order_of_rows_does_not_matter(spark, session):
    obs = transcript.observations(session)
    want = sorted(map(str, reduce.nodes(obs).collect()))
    assert sorted(map(str, reduce.nodes(obs.orderBy(F.desc("seq")).repartition(7)).collect())) == want


def test_bad_line_fails(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text("{nope")
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        transcript.observations(transcript.lines(spark, str(tmp_path / "x.jsonl"))).collect()


def test_occurrences_and_pairs():
    assert reduce.occurrences([-1, 0, -1, 0]) == [1, 0, 2, 3] and reduce.occurrences([]) == [] and reduce.occurrences([2, 2, -1]) == [2, 1, 3]
    nested = [("start", -1), ("start", -1), ("end", -1), ("end", -1)]
    assert reduce.pair_ends(nested, [0, 1]) == {1: 2, 0: 3}
    assert reduce.pair_ends([("end", -1), ("start", -1)], [0]) == {0: 0}  # a stray end takes what is left open
    assert reduce.pair_ends([("start", 0), ("start", 1), ("end", 0)], [0, 1]) == {0: 2}


def test_half_open_windows(spark):
    rows = [("r", "m", "marker", 1, 3), ("r", "a", "tool_call", 1, None), ("r", "b", "tool_call", 2, None), ("r", "c", "tool_call", 3, None), ("r", "d", "tool_call", None, None), ("r", "o", "marker", 2, None)]
    nodes = spark.createDataFrame(rows, "run_id string, id string, type string, s int, e int").selectExpr("run_id", "id", "type", "timestamp_seconds(s) AS t_start", "timestamp_seconds(e) AS t_end")
    got = {(r["src"], r["dst"]) for r in markers.spans(nodes).collect()}
    assert got == {("m", "a"), ("m", "b"), ("o", "b"), ("o", "c")}


def test_rollout(spark, tmp_path):
    import zstandard

    rec = lambda kind, n, **p: json.dumps({"timestamp": f"2025-01-01T10:00:{n:02d}Z", "type": kind, "payload": p})
    lines = [
        rec("session_meta", 0, id="th", cli_version="0.9", cwd="/w"), rec("turn_context", 1, turn_id="T1", model="gpt-5.1"), rec("response_item", 2, type="message", role="user", content=[{"type": "input_text", "text": "go"}]),
        rec("response_item", 3, type="function_call", name="exec_command", call_id="c1", arguments='{"cmd":"ls"}'), rec("response_item", 4, type="function_call_output", call_id="c1", output="Process exited with code 3"),
        rec("response_item", 5, type="function_call", name="exec_command", call_id="c2", arguments="no json"), rec("response_item", 6, type="function_call_output", call_id="c2", output="fine"), rec("event_msg", 6, type="exec_command_end", call_id="c2", exit_code=1),
        rec("event_msg", 7, type="token_count", info={"last_token_usage": {"input_tokens": 11663, "cached_input_tokens": 5504, "output_tokens": 16}}), rec("event_msg", 8, type="task_complete"), rec("strange", 9),
    ]
    (tmp_path / "a.jsonl.zst").write_bytes(zstandard.ZstdCompressor().compress("\n".join(lines).encode()))
    raw = rollout.read(spark, str(tmp_path / "a.jsonl.zst"))
    obs = rollout.observations(raw).cache()
    turn = obs.where("kind = 'assistant_turn'").first()
    assert (turn["tokens_in"], turn["tokens_out"], turn["cache_read"], turn["model"]) == (6159, 16, 5504, "gpt-5.1")
    assert {r["tool_use_id"]: r["status"] for r in obs.where("kind = 'tool_result'").collect()} == {"c1": "error", "c2": "error"}
    assert {r["tool_use_id"]: r["input"] for r in obs.where("kind = 'assistant_tool_use'").collect()} == {"c1": '{"cmd":"ls"}', "c2": '"no json"'}
    assert rollout.drift(raw).first()["n"] == 1
    assert {r["type"] for r in reduce.nodes(obs).collect()} == {"session", "user_prompt", "assistant_turn", "tool_call"}


def test_descendants(spark):
    files = spark.createDataFrame([("a", "1", None), ("b", "2", "1"), ("c", "3", "2"), ("d", "4", "9"), ("e", "1", "3")], "path string, thread string, parent_thread string")
    assert {r["path"] for r in rollout.descendants(files, "1").collect()} == {"a", "b", "c", "e"}


def item(pair, k, key, content, args="x"):
    return (pair, f"{pair}-{k}", "tool_call", "Bash", "", key, content, "p", None, args, "ok", 0.1, 5, 1, 1)


ITEMS = "pair long, id string, type string, name string, subagent_type string, step_key string, content string, path string, t_start timestamp, args string, status string, cost_usd double, duration_ms long, tokens_in long, tokens_out long"


def test_diff(spark):
    a = spark.createDataFrame([item(1, 1, "k1", "c1"), item(1, 2, "k2", "c2"), item(1, 3, "k3", "c3"), item(2, 1, "z", "zz")], ITEMS)
    b = spark.createDataFrame([item(1, 1, "k1", "c1", "y"), item(1, 2, "K2", "c2"), item(1, 3, "K4", "c4"), item(1, 4, "K5", "c5")], ITEMS)
    got = sorted((r["pair"], r["kind"], r["tier"] or "", r["a"] or "", r["b"] or "") for r in diff.diff(a, b).collect())
    assert got == [(1, "added", "", "", "1-4"), (1, "changed", "step_key", "1-1", "1-1"), (1, "unchanged", "content", "1-2", "1-2"), (1, "unchanged", "position", "1-3", "1-3"), (2, "removed", "", "2-1", "")]


def test_diff_aligns_once(spark, capsys):
    """What has been matched is written down: nothing of it is done again for later passes or for the rows."""
    item = spark.createDataFrame([(1, str(i), "tool_call", "n", "", f"k{i}", f"c{i % 3}", "s") for i in range(4)], "pair int, id string, type string, name string, subagent_type string, step_key string, content string, path string")
    item = item.selectExpr("*", "timestamp_seconds(int(id)) AS t_start", "'' AS args", "'ok' AS status", "0D AS cost_usd", "0L AS duration_ms", "0L AS tokens_in", "0L AS tokens_out")
    diff.diff(item, item.where("id <> '2'")).explain()
    assert "CoGroups" not in capsys.readouterr().out


def test_long_common_subsequences_hold_few_rows():
    import tracemalloc

    a, b = [str(i * i % 31) for i in range(1500)], [str(i * i % 37) for i in range(1500)]
    tracemalloc.start()
    got = diff.common_subsequence(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 << 20 and all(a[i] == b[j] for i, j in got)
    kept, diff._MANY = diff._MANY, 1 << 40
    try:
        assert got == diff.common_subsequence(a, b)
    finally:
        diff._MANY = kept


def test_common_subsequence_is_longest():
    rng = random.Random(3)
    for _ in range(50):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(8))] for _ in range(2))
        got = diff.common_subsequence(a, b)
        assert all(a[i] == b[j] for i, j in got) and got == sorted(got) and len({i for i, _ in got}) == len(got)
        best = max(bin(m).count("1") for m in range(1 << len(a)) if _within([x for i, x in enumerate(a) if m >> i & 1], b))
        assert len(got) == best


def test_common_subsequence_keeps_its_tie_rule():
    """With items left out, the same pairs as without: where both ways are as long, a advances."""
    assert diff.common_subsequence(["a", "b"], ["b", "a"]) == [(1, 0)]
    assert diff.common_subsequence(["p", "p"], ["p"], [True]) == [(1, 0)]
    rng = random.Random(9)
    for _ in range(300):
        a, b = ([rng.choice(s) for _ in range(rng.randrange(9))] for s in ("abcx", "abcyz"))
        keep_a, keep_b = [i for i, x in enumerate(a) if x in b], [j for j, x in enumerate(b) if x in a]
        gaps = [j - (keep_b[k - 1] if k else -1) > 1 for k, j in enumerate(keep_b)]
        got = [(keep_a[i], keep_b[j]) for i, j in diff.common_subsequence([a[i] for i in keep_a], [b[j] for j in keep_b], gaps)]
        assert got == _walked(a, b), (a, b)


def _walked(a, b):
    """The definition: of what is left of both, skip a's item if that loses nothing, else b's."""
    size = lambda x, y: 0 if not x or not y else 1 + size(x[1:], y[1:]) if x[0] == y[0] else max(size(x[1:], y), size(x, y[1:]))
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif size(a[i + 1 :], b[j:]) >= size(a[i:], b[j + 1 :]):
            i += 1
        else:
            j += 1
    return out


def test_sequence_pairs_of_a_residue(spark):
    item = "pair int, id string, t_start int, step_key string, content string"
    a = spark.createDataFrame([(1, "a0", 0, "k", "p"), (1, "a1", 1, "k", "p")], item)
    b = spark.createDataFrame([(1, "b0", 0, "l", "z"), (1, "b1", 1, "l", "p")], item)
    assert [(r["a"], r["b"]) for r in diff.match_sequence(a, b, "content").collect()] == [("a1", "b1")]


def _within(a, b):
    it = iter(b)
    return all(x in it for x in a)


def test_tables_within_tolerance(spark):
    t = lambda *rows: spark.createDataFrame(list(rows), "`Region Name` string, total string")
    want = t(("a", "1"), ("a", "1.00009"), ("b", None), ("c", "x"))
    assert tables.compare(t(("c", "x"), ("a", "1.0001"), ("a", "1.00005"), ("b", None)), want).first().asDict() == {"equal": True, "row_diff": 0, "mismatches": []}
    got = tables.compare(t(("a", "1.1"), ("a", "1"), ("b", None), ("c", "x")), want).first()
    assert not got["equal"] and len(got["mismatches"]) == 2
    assert tables.compare(t(("a", "nan")), t(("a", "nan"))).first()["equal"] is False
    assert tables.compare(t(("a", "1"), ("z", "2")), t(("a", "1")), strict=False).first()["equal"] and not tables.compare(t(("a", "1"), ("z", "2")), t(("a", "1"))).first()["equal"]
    # an equal row may be the only partner of another
    for x, y in ((("0", "0.00009"), ("0", "-0.00009")), (("100.0", "99.99992"), ("100.0", "100.00009")), (("9.99995", "15.0"), ("10.0", "15.00003"))):
        assert tables.compare(t(*(("", v) for v in x)), t(*(("", v) for v in y))).first()["equal"]
    mismatch = tables.compare(t(("", "1.0"), ("", "2.0")), t(("", "1.0"), ("", "9.0"))).first()
    assert not mismatch["equal"] and len(mismatch["mismatches"]) == 2
    flag, word = spark.createDataFrame([(True,)], "x boolean"), spark.createDataFrame([("true",)], "x string")
    assert not tables.compare(flag, word).first()["equal"] and tables.compare(flag, flag).first()["equal"]
    with pytest.raises(ValueError):
        tables.normalised(spark.createDataFrame([(1, 2)], "`a b` int, `a-b` int"))


def test_pareto_equals_all_pairs(spark):
    rng = random.Random(5)
    rows = [(g, i, float(rng.randrange(6)), float(rng.randrange(6))) for g in ("x", "y") for i in range(25)] + [("x", 99, None, 1.0)]
    got = {(r["g"], r["seq"]): r["dominated"] for r in history.dominated(spark.createDataFrame(rows, "g string, seq int, accuracy double, cost_usd double"), ["g"]).collect()}
    for g, i, a, c in rows:
        want = None if a is None else any(h == g and b is not None and b >= a and d <= c and (b > a or d < c) for h, _, b, d in rows)
        assert got[g, i] == want


def test_records(spark):
    good = spark.createDataFrame([(1,), (2,)], "v int")
    assert history.checked(good).count() == 2
    with pytest.raises(Exception, match="unsupported record version 3"):
        history.checked(spark.createDataFrame([(3,)], "v int")).collect()


def test_panels(spark):
    schema = "run_id string, key string, step_key string, tool string, value double"
    rows = [("r", "j.k", None, t, v) for t, v in (("a", 1.0), ("b", 0.0), ("c", 0.5))] + [("r", "j.k", None, "unknown", 9.0)]
    s = spark.createDataFrame(rows, schema)
    assert judge.panel(s).first()["value"] == 0.5 and judge.panel(s, vote=True).first()["value"] == 1.0 and judge.panel(s, 4).count() == 0
    with pytest.raises(Exception, match="odd panel"):
        judge.panel(s.where("tool <> 'c'"), vote=True).collect()
    with pytest.raises(Exception, match="ambiguous"):
        judge.panel(s.union(s)).collect()


def test_evidence(spark, tmp_path):
    for run, extra in (("r1", {}), ("r2", {})):
        (tmp_path / run).mkdir()
        (tmp_path / run / "meta.json").write_text(json.dumps({"run_id": run, "task": "t", "labels": {"a": "1"}, "exit_code": 0} | extra, indent=1))
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "meta.json").write_text("{nope")
    runs = evidence.scan_runs(spark, str(tmp_path))
    assert sorted(r["run_id"] for r in runs.collect()) == ["r1", "r2"] and evidence.group_by_ids(runs, ["r1"]).count() == 1
    with pytest.raises(Exception, match="no run r9"):
        evidence.group_by_ids(runs, ["r9"]).collect()
    (tmp_path / "s.jsonl").write_text('{"key":"j.k","value":1,"run_id":"r1"}\n{"key":"j.k","value":2,"run_id":"r1"}\n')
    assert evidence.run_scores(evidence.scores(spark, str(tmp_path / "s.jsonl"))).first()["value"] == 2
    (tmp_path / "x.jsonl").write_text('{"key":"nodot","value":1}\n')
    with pytest.raises(Exception, match="not a score line"):
        evidence.scores(spark, str(tmp_path / "x.jsonl")).collect()
    assert [r["run_id"] for r in evidence.cells(spark, ["t"], ["a", "b"], 2).collect()] == ["t-a-1", "t-b-1", "t-a-2", "t-b-2"]


def test_live_totals(spark, tmp_path):
    rows = [("r", "assistant_turn", None, "2025-01-01 10:01:00", 5, 1, 1), ("r", "tool_result", "error", "2025-01-01 10:02:00", None, None, 2), ("q", "assistant_tool_use", None, "2025-01-01 10:12:00", None, None, 1)]
    df = spark.createDataFrame(rows, "run_id string, kind string, status string, at string, tokens_in long, tokens_out long, seq long").withColumn("event_time", F.to_timestamp("at")).drop("at")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, out, mode in (("totals", live.windowed_totals(stream), "complete"), ("status", live.latest_status(stream), "update")):
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert {(r["run_id"], r["tokens_in"], r["calls"], r["errors"]) for r in spark.table("totals").collect()} == {("r", 5, 0, 1), ("q", None, 1, 0)}
    assert {(r["run_id"], r["last_seq"], r["status"]) for r in spark.table("status").collect()} == {("r", 2, "error"), ("q", 1, "running")}


def test_tables_equal_all_matchings(spark):
    """The number of unmatched rows against the best of all assignments."""
    from itertools import permutations

    rng = random.Random(8)
    for _ in range(6):
        got, want = ([(rng.choice("ab"), rng.randrange(12) / 10) for _ in range(5)] for _ in range(2))
        best = max(sum(g[0] == w[0] and abs(g[1] - w[1]) <= 0.15 for g, w in zip(got, p, strict=True)) for p in permutations(want))
        frames = [spark.createDataFrame(x, "k string, v double") for x in (got, want)]
        assert tables.unmatched(*frames, ["k", "v"], 0.15).count() == 2 * (5 - best), (got, want)


def test_phases_by_properties():
    """Numbers are distinct, explicit ones go to their first namer; every end closes one start at most, the innermost where nothing is named."""
    rng = random.Random(6)
    for _ in range(300):
        wanted = [rng.choice([-1, -1, 0, 1, 2, 5]) for _ in range(rng.randrange(7))]
        got = reduce.occurrences(wanted)
        assert len(set(got)) == len(got) and all(got[wanted.index(w)] == w for w in wanted if w >= 0)
        taken = set()
        for i, x in enumerate(got):
            if not (wanted[i] >= 0 and wanted.index(wanted[i]) == i):
                assert all(y in taken or y in wanted for y in range(i, x))
            taken.add(x)
        bounds = [("start", -1)] * len(wanted) + [("end", rng.choice([-1, -1, 0, 1, 7])) for _ in range(rng.randrange(8))]
        rng.shuffle(bounds)
        pairs = reduce.pair_ends(bounds, got)
        assert len(set(pairs.values())) == len(pairs) == min(len(wanted), sum(b == "end" for b, _ in bounds))
        assert all(bounds[k][0] == "end" for k in pairs.values())
    assert reduce.pair_ends([("start", -1), ("start", -1), ("end", -1), ("end", -1)], [0, 1]) == {1: 2, 0: 3}
    assert reduce.pair_ends([("start", -1), ("start", -1), ("end", 0), ("end", -1)], [0, 1]) == {0: 2, 1: 3}
    assert reduce.pair_ends([("end", -1), ("start", -1)], [0]) == {0: 0} and reduce.pair_ends([("end", 0), ("start", -1), ("end", -1)], [0]) == {0: 0}


def test_prompts_that_begin_with_a_bracket_and_other_servers_tools(spark, tmp_path):
    lines = [
        {"type": "user", "uuid": "u1", "sessionId": "s", "timestamp": "2025-01-01T10:00:00Z", "message": {"role": "user", "content": "[Request interrupted by user]"}},
        {"type": "user", "uuid": "u2", "sessionId": "s", "timestamp": "2025-01-01T10:00:01Z", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t", "content": "x"}]}},
    ]
    (tmp_path / "s.jsonl").write_text("\n".join(json.dumps(x) for x in lines))
    got = transcript.parts(transcript.decoded(transcript.lines(spark, str(tmp_path / "s.jsonl")))).select("p.kind", "p.input").collect()
    assert [tuple(r) for r in got] == [("user_prompt", '"[Request interrupted by user]"'), ("tool_result", None)]
    names = spark.createDataFrame([("mcp__tracelake__mark",), ("tracelake__mark",), ("mcp__bookmarks__mark",), ("mcp__my_srv__mark",), (None,)], "n string")
    assert [r[0] for r in names.select(text.is_marker_tool(F.col("n"))).collect()] == [True, True, False, False, False]
    assert [r[0] for r in names.select(text.is_marker_tool(F.col("n"), "my_srv")).collect()] == [False, False, False, True, False]
