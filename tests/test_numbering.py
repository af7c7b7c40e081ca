"""Numbers, running folds and average ranks by ranges, against plain ones."""

import random

from pyspark.sql import functions as F

from tracelake.operators import numbering
from tracelake.sources import evidence


def rows(spark):
    r = random.Random(3)
    data = [(r.choice(["a", "b", None]), r.randrange(40), k, r.randrange(5)) for k in range(3000)] + [("hot", k % 7, 10_000 + k, 1) for k in range(4000)]
    return data, spark.createDataFrame(data, "g string, v int, id int, n bigint").repartition(16)


def test_numbers_and_sums_equal_plain_ones(spark):
    data, df = rows(spark)
    want, upto, most = {}, {}, {}
    for g in {x[0] for x in data}:
        total, best = 0, None
        for k, x in enumerate(sorted((x for x in data if x[0] == g), key=lambda x: (x[1], x[2])), 1):
            most[x[2]] = best
            best = x[3] if best is None else max(best, x[3])
            total += x[3]
            want[x[2]], upto[x[2]] = k, total
    assert {r["id"]: r["number"] for r in numbering.numbered(df, ["g"], ["v", "id"]).collect()} == want
    assert {r["id"]: r["s"] for r in numbering.numbered(df, ["g"], ["v", "id"], "s", "n").collect()} == upto
    assert {r["id"]: r["m"] for r in numbering.running(df, ["g"], ["v", "id"], F.max, "n", "m").collect()} == most
    assert {r["id"]: r["m"] or 0 for r in numbering.running(df, ["g"], ["v", "id"], F.sum, "n", "m").collect()} == {x[2]: upto[x[2]] - x[3] for x in data}


def test_average_ranks_equal_plain_ones(spark):
    data, df = rows(spark)
    got = {r["id"]: r["rank"] for r in numbering.average_ranks(df, ["g"], "v").collect()}
    for g, v, k, _ in data:
        same = sorted(x[1] for x in data if x[0] == g)
        assert got[k] == same.index(v) + (same.count(v) + 1) / 2


def test_numbers_of_all_rows_and_of_none(spark):
    df = spark.range(1000).repartition(7)
    assert {r["id"]: r["n"] for r in numbering.numbered(df, [], ["id"], "n").collect()} == {k: k + 1 for k in range(1000)}
    assert numbering.numbered(df.limit(0), [], ["id"], "n").collect() == []
    assert numbering.average_ranks(df.limit(0).selectExpr("id", "id AS v"), ["id"], "v").collect() == []


def test_no_window_holds_a_group(spark):
    """Ten million rows of one group: what meets in one window is a row a range."""
    df = spark.range(10_000_000).selectExpr("1 AS g", "id", "id % 1000 AS v")
    got = numbering.numbered(df, ["g"], ["id"], "n")
    assert got.agg(F.count_if(F.col("n") != F.col("id") + 1).alias("bad"), F.count("*").alias("all")).first() == (0, 10_000_000)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_stride_sample(spark):
    runs = spark.createDataFrame([(f"r{k:03}", k) for k in range(50)], "run_id string, x int")
    assert sorted(r["x"] for r in evidence.stride_sample(runs, 7).collect()) == [j * 50 // 7 for j in range(7)]
    assert evidence.stride_sample(runs, 50).count() == 50 and evidence.stride_sample(runs.limit(3), 7).count() == 3
