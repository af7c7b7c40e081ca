"""Each run is taken once, whatever is stopped, repeated or written twice."""

import json

import pytest

from tracelake.streaming import arrivals


def write(root, folder, run, task="t"):
    (root / folder).mkdir(parents=True)
    (root / folder / "meta.json").write_text(json.dumps({"run_id": run, "task": task, "labels": {"k": "v"}}))


def taken(spark, path):
    return sorted((r["run_id"], r["task"]) for r in arrivals.ledger(spark, path).collect())


def test_a_stopped_stream_takes_each_run_once(spark, tmp_path, monkeypatch):
    root, path, checkpoint = tmp_path / "runs", str(tmp_path / "ledger"), str(tmp_path / "check")
    for k in range(7):
        write(root, f"f{k}", f"r{k}")
    (root / "broken").mkdir()
    (root / "broken" / "meta.json").write_text("{")
    assert taken(spark, path) == []
    real, calls = arrivals.take, []

    def failing(batch, number, where):
        real(batch, number, where)
        calls.append(number)
        if len(calls) == 2:
            raise RuntimeError("killed after writing")

    monkeypatch.setattr(arrivals, "take", failing)
    with pytest.raises(Exception, match="killed"):
        arrivals.follow(spark, str(root), path, checkpoint, 2).trigger(availableNow=True).start().awaitTermination()
    monkeypatch.setattr(arrivals, "take", real)
    write(root, "again", "r1", "another document of a run that was taken")
    write(root, "new", "r9")
    for where in (checkpoint, str(tmp_path / "lost checkpoint")):  # from where it was, and from nothing but the ledger
        arrivals.follow(spark, str(root), path, where, 2).trigger(availableNow=True).start().awaitTermination()
        assert [r for r, _ in taken(spark, path)] == [*(f"r{k}" for k in range(7)), "r9"]


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "ledger")
    df = spark.createDataFrame([("a", "t", "d2"), ("a", "u", "d1"), ("b", "t", "d3")], "run_id string, task string, dir string")
    for _ in range(2):
        arrivals.take(df, 4, path)
        assert taken(spark, path) == [("a", "u"), ("b", "t")]
    arrivals.take(df, 5, path)
    assert taken(spark, path) == [("a", "u"), ("b", "t")]
