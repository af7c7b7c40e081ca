"""Every split of a group through the gate itself, against the splits by rank shift."""

import random
from datetime import datetime, timedelta

import pytest

from pyspark.sql import functions as F

from tracelake.operators import aggregate as agg
from tracelake.operators import calibrate
from tracelake.operators import compare as cmp
from tracelake.plans import gate
from tracelake.plans.model import NODE_COLUMNS, OUTCOME, Model
from tracelake.plans.thresholds import DEFAULT, Thresholds

START = datetime(2025, 3, 1)
RUNS = "run_id string, grp string, task string, started_at timestamp, ended_at timestamp, status string"


def made(spark, k, seed=1, tasks=3, steps=4):
    """Runs whose steps, durations and outcomes are missing now and then, with ties."""
    r = random.Random(seed)
    runs, nodes, notes = [], [], []
    for i in range(k):
        at = START + timedelta(hours=r.randrange(5))
        runs.append((f"r{i:02}", "g", r.choice(["", *[f"t{x}" for x in range(tasks)]]), None if r.random() < 0.1 else at, at + timedelta(minutes=r.randrange(1, 5)), r.choice(["ok", "ok", "error"])))
        for s in range(steps):
            for n in range(r.choice([0, 1, 1, 2]) if s else 1):
                nodes.append((f"r{i:02}", f"n{s}-{n}", "tool_call", f"s{s}", r.choice(["ok", "ok", "error"]), f"k{s}" if s < 3 or i % 4 else "k-rare", "", at, None, r.choice([None, 10, 20, 40]), r.choice([None, 0.5, 1.0]), r.randrange(3) * 10, r.choice([1, 50])))
        nodes.append((f"r{i:02}", "m", "marker", "p", "ok", "", "ph", at, at + timedelta(seconds=r.randrange(4)), None, None, None, None))
        if r.random() < 0.8:
            notes.append((f"r{i:02}", OUTCOME, float(r.random() < 0.6)))
    n = spark.createDataFrame(nodes, NODE_COLUMNS)
    spans = n.where("type <> 'marker'").select("run_id", F.lit("m").alias("src"), F.col("id").alias("dst"))
    return Model(spark.createDataFrame(runs, RUNS), n, spark.createDataFrame(notes, "run_id string, key string, value double"), spans)


def split(m, order, dropped):
    """The model of one split: halves as groups."""
    left = [x for i, x in enumerate(order, 1) if i != dropped]
    half = {x: "baseline" if i < len(left) // 2 else "candidate" for i, x in enumerate(left)}
    of = F.create_map(*[F.lit(x) for kv in half.items() for x in kv])
    return Model(m.runs.where(F.col("run_id").isin(left)).withColumn("grp", of[F.col("run_id")]), *[d.where(F.col("run_id").isin(left)) for d in (m.nodes, m.annotations, m.spans)])


@pytest.mark.parametrize("k,th,drops", [(9, Thresholds(min_support=2, paired_min_tasks=1, paired_test="wilcoxon", coverage_floor=0.9), (0, 7)), (8, Thresholds(min_support=1, paired_min_tasks=2, fail_on_notable=True), (3, 8))])
def test_splits_equal_the_gate(spark, k, th, drops):
    m = made(spark, k, seed=k)
    order = [r["run_id"] for r in calibrate.in_time_order(m.runs).orderBy("position").collect()]
    assert order == [r["run_id"] for r in sorted(m.runs.collect(), key=lambda r: (r["started_at"] or datetime(1, 1, 1), r["ended_at"], r["run_id"]))]
    got = calibrate.check(m, th)
    verdicts = {r["split"]: (r["verdict"], round(r["coverage"], 9)) for r in got.verdicts.collect()}
    assert verdicts.keys() == set(range(k + 1))
    for dropped in drops:
        part = split(m, order, dropped)
        found = gate.findings(part, th)
        coverage = cmp.coverage(agg.step_rows(part)).first()[0]
        assert verdicts[dropped] == (cmp.verdict(found, th).first()["verdict"], round(coverage, 9)), dropped
        if dropped == 0:
            shown = lambda rows: sorted((r["scope"], r["key"], r["metric"], r["verdict"], round(r["baseline"], 9), round(r["candidate"], 9), round(r["band_hi"], 9), r["detail"]) for r in rows)
            assert shown(got.whole.collect()) == shown(found.collect())


def test_groups_of_few_runs(spark):
    for k, sufficient, evaluated, detail in ((5, False, False, "self-check needs k>=6 runs (have 5)"), (6, True, False, "leave-one-out needs k>=7 runs (have 6)")):
        r = calibrate.calibrate(made(spark, k), DEFAULT).first()
        assert (r["runs"], r["sufficient"], r["evaluated"], r["detail"], r["flipping_runs"]) == (k, sufficient, evaluated, detail, "")
        assert sufficient or (r["verdict"], r["drift"], r["notes"]) == ("", "", "")


def test_ten_thousand_runs_make_linear_rows(spark):
    k = 10_000
    runs = spark.range(k).selectExpr("string(id) AS run_id", "'g' AS grp", "'' AS task", "timestamp_seconds(id) AS started_at", "timestamp_seconds(id + 60 + id % 7) AS ended_at", "'ok' AS status")
    nodes = spark.range(k).selectExpr("string(id) AS run_id", "'n' AS id", "'tool_call' AS type", "'s' AS name", "IF(id % 9 = 0, 'error', 'ok') AS status", "'key' AS step_key", "'' AS phase_key", "timestamp_seconds(id) AS t_start", "CAST(NULL AS timestamp) AS t_end", "id % 100 AS duration_ms", "double(id % 10) AS cost_usd", "id % 5 AS tokens_in", "id % 3 AS tokens_out")
    m = Model(runs, nodes, spark.createDataFrame([], "run_id string, key string, value double"))
    assert calibrate.cases(m).count() == 6 * k + 6 + 6 * 2 * k + 6 * 3  # six totals; six values of the step, own and other
    got = calibrate.check(m, DEFAULT).verdicts
    assert got.count() == k + 1 and {r["verdict"] for r in got.select("verdict").distinct().collect()} == {"ok"}
