"""Work that grows with its input, not with the input's square: each of these took minutes, or one call a row, before."""

import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracelake.functions import text
from tracelake.operators import calibrate, compare, keys, reduce, tables
from tracelake.plans.model import Model


def test_labels_of_one_long_text(spark):
    given = ",".join(f"k{i % 40}={i}" for i in range(8000))
    spark.range(1).count()
    t = time.time()
    got = spark.createDataFrame([(given,), (None,), ("a=1,b=2,a=3",)], "t string").select(text.parse_labels(F.col("t")).alias("l")).collect()
    assert time.time() - t < 20
    assert got[0]["l"] == {f"k{i % 40}": str(i) for i in range(7960, 7992)} and got[1]["l"] is None and got[2]["l"] == {"b": "2", "a": "3"}


def test_reliability_of_many_runs(spark):
    n, c = 40_000, 39_990
    tasks = spark.createDataFrame([("g", "t0", n, c), ("g", "t1", n, n), ("h", "t0", 3, 2)], "grp string, task string, out_n long, out_ones long")
    t = time.time()
    got = {(r["grp"], r["k"]): r["pass_k"] for r in compare.reliability(tasks).collect()}
    assert time.time() - t < 25
    want = 1.0
    for k in range(1, n + 1):
        want *= max(c - k + 1, 0) / (n - k + 1)
        assert got["g", k] == pytest.approx((want + 1) / 2, abs=1e-9)
    assert len(got) == n + 3 and got["h", 2] == pytest.approx(1 / 3) and got["h", 3] == 0


def test_equal_calls_are_hashed_once(monkeypatch):
    seen = []
    monkeypatch.setattr(keys, "redact_text", lambda x: seen.append(x) or x)
    got = keys._salient_hash.func(pd.Series(["a", "a", "b", "a"]), pd.Series(["1", "1", "1", None]))
    assert len(seen) == 3 and got[0] == got[1] == got[2] != got[3]


def test_bands_of_one_row_a_side(spark):
    of = lambda rows: spark.createDataFrame(rows, "k string, v double")
    left = lambda got, want: sorted((r["side"], r["numbers"][1]) for r in tables.unmatched(of(got), of(want), ["k", "v"], 0.1).collect())
    assert left([("a", 1.0)] * 3, [("a", 1.05)] * 2) == [("got", 1.0)]
    assert left([("a", 1.0)], [("a", 1.05), ("a", 1.05)]) == [("want", 1.05)]
    assert left([("a", 1.0), ("a", 1.05)], [("a", 1.05)]) == [("got", 1.0)] or left([("a", 1.0), ("a", 1.05)], [("a", 1.05)]) == [("got", 1.05)]
    assert left([("a", 1.0), ("a", 1.05)], []) == [("got", 1.0), ("got", 1.05)]
    many = spark.range(150_000, numPartitions=4)
    t = time.time()
    assert tables.unmatched(many.selectExpr("'x' || id AS k", "0D AS v"), many.selectExpr("'x' || id AS k", "IF(id % 3 = 0, 0.2D, 0.05D) AS v"), ["k", "v"], 0.1).count() == 0 + 2 * 50_000
    assert time.time() - t < 25


def test_cases_are_keys_and_places_not_runs(spark):
    counts = []
    for k in (60, 600):
        runs = spark.range(k).selectExpr("string(id) AS run_id", "'g' AS grp", "'' AS task", "timestamp_seconds(id) AS started_at", "timestamp_seconds(id + 60 + id % 7) AS ended_at", "'ok' AS status")
        nodes = spark.range(k).selectExpr("string(id) AS run_id", "'n' AS id", "'tool_call' AS type", "'s' AS name", "IF(id % 9 = 0, 'error', 'ok') AS status", "'key' AS step_key", "'' AS phase_key", "timestamp_seconds(id) AS t_start", "CAST(NULL AS timestamp) AS t_end", "id % 100 AS duration_ms", "double(id % 10) AS cost_usd", "id % 5 AS tokens_in", "id % 3 AS tokens_out")
        m = Model(runs, nodes, spark.createDataFrame([], "run_id string, key string, value double"))
        found, members = calibrate._cases(m, calibrate.placed(m.runs))
        counts.append(found.count())
        assert members.count() == 12 * k
    assert max(counts) < 250


def test_phases_of_many_runs(spark):
    at = ("timestamp_seconds(id * 100 + b.at) AS ts", "CAST(b.at AS bigint) AS seq")
    some = "array(named_struct('at', 0, 'what', 'start', 'no', -1), named_struct('at', 3, 'what', 'start', 'no', 0), named_struct('at', 5, 'what', 'end', 'no', -1), named_struct('at', 7, 'what', 'other', 'no', -1), named_struct('at', 9, 'what', 'start', 'no', -1), named_struct('at', 8, 'what', 'end', 'no', -1))"
    bounds = spark.range(20_000).selectExpr("id", f"explode({some}) AS b").selectExpr("string(id) AS run_id", "'p' AS name", "b.what AS boundary", "b.no AS occurrence", "IF(b.at = 3, 'ref', NULL) AS state_ref", "IF(b.at = 0, 'a', NULL) AS agent_id", *at)
    t = time.time()
    found = reduce.phases(bounds.unionByName(bounds.where("run_id = '7'").selectExpr("'lone' AS run_id", "name", "'end' AS boundary", "occurrence", "state_ref", "agent_id", "ts", "seq"))).collect()
    assert time.time() - t < 25
    assert len(found) == 60_000
    of = {(r["occurrence"]): (r["t_start"].timestamp() - 700, r["t_end"] and r["t_end"].timestamp() - 700, r["closed"], r["state_ref"], r["agent_id"]) for r in found if r["run_id"] == "7"}
    assert of == {1: (0, 8, True, None, "a"), 0: (3, 5, True, "ref", None), 2: (9, None, False, None, None)}


def test_phases_without_times_and_runs(spark):
    rows = [(None, "p", "start", -1, None, None, None, 1), (None, "p", "end", -1, None, None, None, 2), ("r", "p", "end", -1, None, None, None, 5), ("r", "p", "start", -1, "s", None, None, 5)]
    found = reduce.phases(spark.createDataFrame(rows, "run_id string, name string, boundary string, occurrence int, state_ref string, agent_id string, ts timestamp, seq bigint")).collect()
    assert sorted((str(r["run_id"]), r["occurrence"], r["t_start"], r["t_end"], r["closed"], r["state_ref"]) for r in found) == [("None", 0, None, None, True, None), ("r", 0, None, None, True, "s")]
