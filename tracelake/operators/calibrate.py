"""Self-checks of the gate: halves of one group against each other, leave-one-out, and what support can show.

A group's k runs stand in time order. With h = (k - 1) div 2, a split that leaves out one of the first h
runs compares the first h + 1 without it to all from h + 2; any other compares the first h to all from
h + 1 without it; and the whole group splits into one of these pairs. So all k + 1 splits draw on four sets
of runs, each of which misses one run at most. A key's values are sorted once for all of them: the order
statistics of a set without one value are those of the set, or their right neighbours where the value isn't
greater. A run without the key changes nothing there. So a split's counts of findings are those of its side
with no run missing, less what they are at the run's own keys, plus what they become there. That depends only
on which side the run is and where its value stands among the quantiles: comparisons are made for each key and
such a place (``code``), not for each run, and looked up by the runs of those that change a count.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.stats import binomial_tail, signed_rank, unanimous, wilson
from tracelake.operators import aggregate as agg
from tracelake.operators import compare as cmp
from tracelake.operators.aggregate import METRICS
from tracelake.operators.numbering import numbered
from tracelake.plans.model import OUTCOME, Model
from tracelake.plans.thresholds import Thresholds
from tracelake.sources.shared import cut

#: The largest support that is searched for one that can fire.
SEARCH = 1000
#: Findings and notes that a group's row shows; ``drift`` has all.
SHOWN = 20
#: Sets of runs by position: the first h + 1, the first h, all from h + 1, all from h + 2.
_SETS = {"a1": "position <= h + 1", "a0": "position <= h", "b1": "position >= h + 1", "b2": "position >= h + 2"}
_QUANTILES = {"median": 0.5, "p25": 0.25, "p75": 0.75}
#: What a split's comparison of one key needs of a side; ``ones`` are errors where the metric is ``status``.
_SIDE = ("n", "median", "p25", "p75", "present", "ones", "odd")
_KEY = ("grp", "scope", "key", "metric")


def in_time_order(runs: DataFrame) -> DataFrame:
    """Runs with ``position`` (from 1) by start, end and id, a missing time first."""
    zero = F.lit("0001-01-01").cast("timestamp")
    return numbered(runs, ["grp"], [F.coalesce("started_at", zero), F.coalesce("ended_at", zero), "run_id"], "position").withColumn("position", F.col("position").cast("int"))


def placed(runs: DataFrame) -> DataFrame:
    """(grp, run_id, position, k, h) of every run."""
    sizes = runs.groupBy("grp").agg(F.count("*").cast("int").alias("k"))
    return cut(in_time_order(runs.select("grp", "run_id", "started_at", "ended_at")).join(sizes, "grp").select("grp", "run_id", "position", "k", F.expr("(k - 1) div 2").cast("int").alias("h")))


def values(m: Model) -> DataFrame:
    """(run_id, scope, key, metric, value): every value of a run that a comparison draws on, and its status by key."""
    per_run = agg.cells(m).dropDuplicates(["run_id"])
    def long(df: DataFrame, scope: str, key: Column, **metrics: Column) -> DataFrame:
        each = F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in metrics.items()])
        return df.select("run_id", F.lit(scope).alias("scope"), key.alias("key"), F.explode(each).alias("x")).select("run_id", "scope", "key", "x.*")

    plain = {k: F.col(k) for k in METRICS}
    parts = [
        long(per_run, "total", F.lit(""), **plain, nodes=F.col("nodes"), error_rate=F.col("has_error")),
        m.annotations.where(F.col("key") == OUTCOME).select("run_id", F.lit("total").alias("scope"), F.lit("").alias("key"), F.lit(f"ann:{OUTCOME}").alias("metric"), F.col("value").cast("double").alias("value")),
        long(per_run.where("task <> ''"), "paired", F.col("task"), **plain),
    ]
    folds = [("step", agg.step_folds(m))] + ([("phase", agg.phase_folds(m))] if m.spans is not None else [])
    parts += [long(f, scope, F.col("key"), status=F.col("worst") == "error", occurrences=F.col("occurrences"), **plain) for scope, f in folds]
    return reduce(DataFrame.unionByName, parts)


def _rank(q: float, n: Column) -> Column:
    return F.greatest(F.ceil(q * n), F.lit(1)).cast("long")


def _statistics(long: DataFrame) -> DataFrame:
    """A row for each key: what its sets have, counts and of sorted values those at each quantile, whole and one short; and its group's k and h."""
    known = F.col("value").isNotNull()
    of = {x: F.expr(where) for x, where in _SETS.items()}
    tests = {"n": known, "present": F.lit(True), "ones": F.col("value") == 1, "odd": ~F.col("value").isin(0.0, 1.0)}
    counts = long.groupBy(*_KEY).agg(F.max("k").alias("k"), F.max("h").alias("h"), *[F.sum(F.when(w & test, 1).otherwise(0)).alias(f"{c}_{x}") for x, w in of.items() for c, test in tests.items()])
    upto = Window.partitionBy(*_KEY).orderBy("value", "position").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # sums run along, no group is held
    df = long.where(known).join(counts.select(*_KEY, *[f"n_{x}" for x in of]), list(_KEY)).withColumns({f"at_{x}": F.sum(F.when(w, 1).otherwise(0)).over(upto) for x, w in of.items()})
    wanted = {}
    for x, w in of.items():
        for name, q in _QUANTILES.items():
            short = _rank(q, F.col(f"n_{x}") - 1)
            for kind, at in (("", _rank(q, F.col(f"n_{x}"))), ("lo_", short), ("hi_", short + 1)):
                wanted[f"{kind}{name}_{x}"] = w & (F.col(f"at_{x}") == at)
    placed_values = df.where(reduce(Column.__or__, wanted.values())).groupBy(*_KEY).agg(*[F.max(F.when(test, F.col("value"))).alias(c) for c, test in wanted.items()])
    names = [c for c in counts.columns if c not in _KEY]
    same = reduce(Column.__and__, [counts[c] == placed_values[c] for c in _KEY])
    return cut(counts.join(placed_values, same, "left").select(*[counts[c] for c in (*_KEY, *names)], *wanted))


#: What tells the values of a key apart for the split without their run, as bits of ``code``; those of quantiles stand for a value up to the one of the set one short.
_BITS = ("left", "known", "one", "odd", *_QUANTILES)


def _bit(name: str) -> Column:
    return F.col("code").bitwiseAND(1 << _BITS.index(name)) != 0


def _members(long: DataFrame, statistics: DataFrame) -> DataFrame:
    """(grp, scope, key, metric, position, code): every run's value by its key's ``code``."""
    left, own = F.col("position") <= F.col("h"), F.col("value")
    bits = {"left": left, "known": own.isNotNull(), "one": own == 1, "odd": ~own.isin(0.0, 1.0), **{q: F.when(left, own <= F.col(f"lo_{q}_a1")).otherwise(own <= F.col(f"lo_{q}_b1")) for q in _QUANTILES}}
    code = reduce(Column.__add__, [F.when(bits[name], 1 << i).otherwise(0) for i, name in enumerate(_BITS)]) + (1 << len(_BITS))
    lows = statistics.select(*_KEY, *[f"lo_{q}_{x}" for q in _QUANTILES for x in ("a1", "b1")])
    return cut(long.join(lows, list(_KEY)).select(*_KEY, "position", code.alias("code")))


def _side(x: str, without: bool = False) -> Column:
    """A set's struct of ``_SIDE``, all of it or without a run of the row's ``code``."""
    got: dict[str, Column] = {}
    for name in _QUANTILES:
        whole = F.col(f"{name}_{x}")
        got[name] = F.coalesce(F.when(_bit("known"), F.when(_bit(name), F.col(f"hi_{name}_{x}")).otherwise(F.col(f"lo_{name}_{x}"))).otherwise(whole) if without else whole, F.lit(0.0))
    less = {"n": _bit("known"), "present": F.lit(True), "ones": _bit("one"), "odd": _bit("odd")}
    for c, test in less.items():
        got[c] = F.col(f"{c}_{x}") - (test.cast("int") if without else 0)
    return F.struct(*[got[c].alias(c) for c in _SIDE])


def _cases(m: Model, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of every comparison, and the ``_members`` that they stand for. As ``cases``, but a run that is left
    out is known by its ``code`` (0 where none is): the runs of one code are one row, however many they are."""
    long = cut(values(m).join(runs, "run_id").select(*_KEY, "value", "position", "k", "h"))
    statistics = _statistics(long)
    members = _members(long, statistics)
    half = F.expr("k div 2").cast("long")
    less_b, less_c = F.col("h").cast("long"), (F.col("k") - F.col("h") - 1).cast("long")

    def case(split: int, weight: int, b: Column, c: Column, b_runs: Column = less_b, c_runs: Column = less_c) -> Column:
        return F.struct(F.lit(split).alias("split"), F.lit(weight).alias("weight"), b.alias("b"), c.alias("c"), b_runs.alias("b_runs"), c_runs.alias("c_runs"))

    odd, left = F.col("k") % 2 == 1, _bit("left")
    pick = lambda test, x, y: F.when(test, x).otherwise(y)
    whole = case(0, 1, pick(odd, _side("a0"), _side("a1")), pick(odd, _side("b1"), _side("b2")), half, F.col("k") - half)
    sides = [case(-1, 1, _side("a1"), _side("b2")), case(-2, 1, _side("a0"), _side("b1"))]
    own = case(1, 1, pick(left, _side("a1", True), _side("a0")), pick(left, _side("b2"), _side("b1", True)))
    other = case(1, -1, pick(left, _side("a1"), _side("a0")), pick(left, _side("b2"), _side("b1")))
    every = F.col("metric").isin(*METRICS, "nodes", "error_rate") & (F.col("scope") == "total")  # no run is without them
    fixed = statistics.withColumn("code", F.lit(0)).withColumn("x", F.explode(F.when(every, F.array(whole)).otherwise(F.array(whole, *sides))))
    codes = members.select(*_KEY, "code").distinct().join(statistics, list(_KEY)).withColumn("x", F.explode(F.when(every, F.array(own)).otherwise(F.array(own, other))))
    return cut(fixed.select(*_KEY, "code", "x.*").unionByName(codes.select(*_KEY, "code", "x.*"))), members


def _of_runs(coded: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of a code as rows of the runs that have it: ``split`` is their position."""
    return coded.drop("split").join(members, [*_KEY, "code"]).withColumnRenamed("position", "split")


def cases(m: Model) -> DataFrame:
    """Both sides of every comparison: (grp, scope, key, metric, split, weight, b, c, b_runs, c_runs).

    ``split`` is 0 for the whole group, -1 and -2 for no run missing on either side, else the position of the
    run that is left out: at its own keys, what is there without it counts 1, what would be there for another -1.
    """
    found, members = _cases(m, placed(m.runs))
    return found.where("code = 0").unionByName(_of_runs(found.where("code > 0"), members)).drop("code")


def findings(found: DataFrame, th: Thresholds, also: tuple[str, ...] = ()) -> DataFrame:
    """The findings of all cases but pairs of tasks: grp, split, weight, the columns ``also`` and those of a finding. Coverage is not looked at."""
    one = cmp.ASKED[6:-1]
    b, c, metric = F.col("b"), F.col("c"), F.col("metric")
    stats = lambda s: F.struct(s["n"].alias("n"), *[s[k].alias(k) for k in _QUANTILES], F.lit(0.0).alias("p90"))
    ask = lambda *a, **k: cmp._ask(*a, **k).cast(one)
    metrics = ask(metric, stats=(stats(b), stats(c)))
    ones = F.format_string("ones %d/%d -> %d/%d", b["ones"], b["n"], c["ones"], c["n"])
    outcome = ask(metric, rate=(b["n"] - b["ones"], b["n"], c["n"] - c["ones"], c["n"], th.annotation_rate_delta), mirrored=True, note=ones)
    absent = ask(metric, absent=F.when(b["n"] == 0, "annotation absent in baseline").otherwise("annotation absent in candidate"))
    here, there = b["present"] > 0, c["present"] > 0
    note = F.format_string("present %d/%d -> %d/%d", b["present"], F.col("b_runs"), c["present"], F.col("c_runs"))
    presence = ask(F.lit("presence"), rate=(F.col("b_runs") - b["present"], F.col("b_runs"), F.col("c_runs") - c["present"], F.col("c_runs"), th.presence_delta), note=note)
    errors = ask(F.lit("error_rate"), rate=(b["ones"], b["present"], c["ones"], c["present"], th.error_rate_delta))
    gone = ask(F.lit("metrics"), absent=F.when(~here, "absent in baseline").otherwise("absent in candidate"))
    none = F.array().cast(cmp.ASKED)
    asks = (
        F.when(metric == "status", F.when(here & there, F.array(presence, errors)).when(here | there, F.array(presence, gone)).otherwise(none))
        .when(metric == f"ann:{OUTCOME}", F.when((b["n"] == 0) & (c["n"] == 0), none).when((b["n"] == 0) | (c["n"] == 0), F.array(absent)).when((b["odd"] == 0) & (c["odd"] == 0), F.array(outcome)).otherwise(F.array(ask(metric, stats=(stats(b), stats(c)), better=True))))
        .when(metric == "error_rate", F.array(ask(metric, rate=(b["ones"], b["n"], c["ones"], c["n"], th.error_rate_delta))))
        .when((F.col("scope") == "total") | (here & there), F.array(metrics))
        .otherwise(none)
    )
    asked = found.where("scope <> 'paired'").select("grp", "split", "weight", *also, "scope", "key", F.lit("").alias("name"), F.explode(asks).alias("f"))
    return cmp.judged(asked, th, ("grp", "split", "weight", *also)).drop("name")


def _over_splits(sums: DataFrame, names: list[str], runs: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """Sums by (grp, split) of weighted cases as sums of real splits: those of the run's side and its own."""
    sides = sums.where("split < 0").select("grp", (F.col("split") == -1).alias("left"), *also, *[F.col(n).alias(f"side_{n}") for n in names])
    each = runs.select("grp", F.col("position").alias("split"), (F.col("position") <= F.col("h")).alias("left")).join(sides, ["grp", "left"], "left") if not also else sides.join(runs.select("grp", F.col("position").alias("split"), (F.col("position") <= F.col("h")).alias("left")), ["grp", "left"])
    own = each.join(sums.where("split > 0"), ["grp", "split", *also], "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    own = own.select("grp", "split", *also, *[(zero(F.col(f"side_{n}")) + zero(F.col(n))).alias(n) for n in names])
    return own.unionByName(sums.where("split = 0").select("grp", "split", *also, *names))


def _weighed(each: DataFrame, members: DataFrame, names: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """Sums of weighted cases (columns of a key, code, split and ``names``) by (grp, split, *by). Codes that change nothing are left out before their runs are looked up."""
    sums = [F.sum(n).alias(n) for n in names]
    fixed = each.where("code = 0").groupBy("grp", "split", *by).agg(*sums)
    moved = each.where("code > 0").groupBy(*_KEY, "code").agg(*sums).where(" OR ".join(f"{n} <> 0" for n in names))
    return cut(fixed.unionByName(_of_runs(moved, members).groupBy("grp", "split", *by).agg(*sums)))


def paired(found: DataFrame, members: DataFrame, runs: DataFrame, th: Thresholds) -> DataFrame:
    """The paired finding of every split and metric: grp, split, metric, matched, nonzero, positive, p_up, p_down, verdict."""
    s = th.min_support
    b, c = F.col("b"), F.col("c")
    pair = (b["present"] >= s) & (c["present"] >= s)
    delta = F.when(pair & (b["n"] >= s) & (c["n"] >= s), F.nullif(c["median"] - b["median"], F.lit(0.0)))
    each = found.where("scope = 'paired'").select(*_KEY, "code", "split", "weight", pair.cast("long").alias("matched"), delta.alias("d"), (b["present"] > 0).cast("long").alias("b_tasks"), (c["present"] > 0).cast("long").alias("c_tasks"))
    counted = {"matched": F.col("matched"), "nonzero": F.col("d").isNotNull().cast("long"), "positive": F.coalesce((F.col("d") > 0).cast("long"), F.lit(0)), "b_tasks": F.col("b_tasks"), "c_tasks": F.col("c_tasks")}
    sums = _weighed(each.select(*_KEY, "code", "split", *[(F.col("weight") * v).alias(k) for k, v in counted.items()]), members, list(counted), ("metric",))
    splits = _over_splits(sums, list(counted), runs, ("metric",)).where("b_tasks > 0 AND c_tasks > 0")
    if th.paired_test == "sign":
        splits = splits.withColumn("t", F.struct(binomial_tail("positive", "nonzero").alias("p_up"), binomial_tail("(nonzero - positive)", "nonzero").alias("p_down")))
    else:
        expanded = each.where("code = 0").unionByName(_of_runs(each.where("code > 0"), members)).withColumnRenamed("key", "task")
        splits = _ranked(splits, expanded, runs)
    up, down = F.round("t.p_up", 12) <= th.paired_alpha, F.round("t.p_down", 12) <= th.paired_alpha
    verdict = F.when(F.col("matched") < th.paired_min_tasks, "insufficient").when(up, "regression").when(down, "improvement").otherwise("ok")
    return splits.select("grp", "split", "metric", "matched", "nonzero", "positive", F.col("t.p_up").alias("p_up"), F.col("t.p_down").alias("p_down"), verdict.alias("verdict"))


def _ranked(splits: DataFrame, each: DataFrame, runs: DataFrame) -> DataFrame:
    """Splits with the signed-rank test. A run that is left out changes one task's delta to one of few values, so the
    test is made once for each of those, over the tasks' deltas (a value a task), and joined to the splits."""
    side = F.when(F.col("split") > 0, -1).otherwise(F.col("split"))
    whole = each.where("split <= 0 AND d IS NOT NULL").groupBy("grp", "split", "metric").agg(F.collect_list(F.struct("task", "d")).alias("tasks")).withColumnRenamed("split", "side")
    own = each.where("split > 0 AND weight > 0").join(runs.select("grp", F.col("position").alias("split"), F.when(F.col("position") <= F.col("h"), -1).otherwise(-2).alias("side")), ["grp", "split"]).select("grp", "split", "side", "metric", "task", "d")
    changed = own.select("grp", "side", "metric", "task", "d").distinct().join(whole, ["grp", "side", "metric"], "left")
    deltas = "concat(transform(filter(coalesce(tasks, array()), x -> NOT x.task <=> task), x -> x.d), CASE WHEN d IS NULL THEN array() ELSE array(d) END)"
    changed = changed.withColumn("ds", F.expr(deltas).cast("array<double>")).withColumn("t", signed_rank("ds")).select("grp", "side", "metric", "task", F.coalesce("d", F.lit(0.0)).alias("own"), "t")
    tested = own.withColumn("own", F.coalesce("d", F.lit(0.0))).join(changed, ["grp", "side", "metric", "task", "own"]).select("grp", "split", "metric", "t")
    plain = whole.withColumn("ds", F.expr("transform(tasks, x -> x.d)")).withColumn("t", signed_rank("ds")).select("grp", F.col("side").alias("split"), "metric", "t")
    both = tested.unionByName(plain.where("split = 0"))
    unchanged = runs.select("grp", F.col("position").alias("split"), F.when(F.col("position") <= F.col("h"), -1).otherwise(-2).alias("side")).join(plain.withColumnRenamed("split", "side").withColumnRenamed("t", "side_t"), ["grp", "side"]).drop("side")
    nothing = F.struct(*[F.lit(x).alias(k) for k, x in (("w_plus", 0.0), ("w_total", 0.0), ("p_up", 1.0), ("p_down", 1.0))])
    return splits.join(both, ["grp", "split", "metric"], "left").join(unchanged, ["grp", "split", "metric"], "left").withColumn("t", F.coalesce("t", "side_t", nothing)).drop("side_t")


def split_findings(m: Model, th: Thresholds) -> DataFrame:
    """Total findings of every split: grp, dropped (0: none), metric, verdict, baseline, candidate."""
    found = findings(cases(m).where("split >= 0 AND scope = 'total' AND weight > 0"), th).where(~F.col("metric").startswith("ann:"))
    return found.select("grp", F.col("split").alias("dropped"), "metric", "verdict", "baseline", "candidate")


@dataclass(frozen=True)
class Checked:
    """``whole``: findings of the whole group's split. ``verdicts``: grp, split (0: none left out), verdict. ``runs``: as ``placed``."""

    whole: DataFrame
    verdicts: DataFrame
    runs: DataFrame


def check(m: Model, th: Thresholds) -> Checked:
    """All splits of every group."""
    runs = placed(m.runs)
    found, members = _cases(m, runs)
    judged = cut(findings(found.withColumn("of", F.col("metric")), th, ("code", "of")))
    tests = cut(paired(found, members, runs, th))
    has = lambda v: F.col("verdict") == v
    step, counted = F.col("scope") == "step", ("regressions", "step_regressions", "notables", "insufficient", "improvements")
    flags = dict(zip(counted, (has("regression") & ~step, has("regression") & step, has("notable"), has("insufficient"), has("improvement")), strict=True))
    here, there = F.col("b.present") > 0, F.col("c.present") > 0
    shared = {"b_keys": here, "both_keys": here & there}
    names = [*flags, *shared]
    weighed = lambda tests: [(F.col("weight") * (tests[k].cast("long") if k in tests else F.lit(0).cast("long"))).alias(k) for k in names]
    of_findings = judged.select("grp", "scope", "key", F.col("of").alias("metric"), "code", "split", *weighed(flags))
    of_keys = found.where("scope = 'step' AND metric = 'status'").select(*_KEY, "code", "split", *weighed(shared))
    sums = _weighed(of_findings.unionByName(of_keys), members, names)
    splits = _over_splits(sums, names, runs).withColumn("coverage", F.coalesce(F.try_divide(F.col("both_keys").cast("double"), F.col("b_keys").cast("double")), F.lit(1.0)))
    pairs = tests.groupBy("grp", "split").agg(*[F.count_if(has(v)).alias(f"paired_{v}") for v in ("regression", "insufficient", "improvement")])
    splits = splits.join(pairs, ["grp", "split"], "left").na.fill(0)
    trusted = F.col("coverage") >= th.coverage_floor
    worse = F.col("regressions") + F.col("paired_regression") + F.when(trusted, F.col("step_regressions")).otherwise(0)
    notable = F.col("notables") + F.when(trusted, 0).otherwise(F.col("step_regressions"))
    verdict = F.when((worse > 0) | (F.lit(th.fail_on_notable) & (notable > 0)), "regression").when((F.col("insufficient") + F.col("paired_insufficient") > 0) & (notable == 0) & (F.col("improvements") + F.col("paired_improvement") == 0), "insufficient").otherwise("ok")
    verdicts = cut(splits.select("grp", "split", "coverage", verdict.alias("verdict")))
    low = verdicts.where(f"split = 0 AND coverage < {th.coverage_floor}").select("grp", "coverage")
    whole = judged.where("split = 0").join(low, "grp", "left")
    down = F.col("coverage").isNotNull() & step & has("regression")
    note = F.format_string(f"step alignment coverage %.2f below floor {th.coverage_floor:.2f}", "coverage")
    whole = whole.withColumns({"verdict": F.when(down, "notable").otherwise(F.col("verdict")), "detail": F.when(down, F.concat_ws("; ", F.nullif("detail", F.lit("")), note)).otherwise(F.col("detail"))})
    columns = ["grp", *[c for c in cmp.COLUMNS if c != "name"]]
    whole = whole.select(*columns).unionByName(cmp.plain_paired(tests.where("split = 0").withColumns({"scope": F.lit("paired"), "key": F.lit(""), "name": F.lit("")}), th, ("grp",)).select(*columns))
    return Checked(cmp.kept(whole), verdicts, runs)


def drift(m: Model, th: Thresholds) -> DataFrame:
    """Findings between the halves of every group that has 2 * min_support runs, in no order: what gates or is notable,
    and where the halves' verdict is insufficient, the distinct details of what is insufficient (``note``)."""
    return _drift(check(m, th), th)


def _drift(got: Checked, th: Thresholds) -> DataFrame:
    enough = got.runs.where(f"k >= {2 * th.min_support}").select("grp").distinct()
    whole = got.whole.join(enough, "grp", "left_semi")
    at = F.struct(cmp.scope_rank().alias("scope"), "key", "metric")
    moved = whole.where(F.col("verdict").isin("regression", "notable")).select("grp", F.lit("drift").alias("kind"), at.alias("at"), "scope", "key", "metric", "verdict", "baseline", "candidate", "detail")
    unsure = got.verdicts.where("split = 0 AND verdict = 'insufficient'").select("grp")
    notes = whole.where("verdict = 'insufficient' AND detail <> ''").join(unsure, "grp", "left_semi").groupBy("grp", "detail").agg(F.min(at).alias("at"))
    none, zero = F.lit(""), F.lit(0.0)
    return moved.unionByName(notes.select("grp", F.lit("note").alias("kind"), "at", none.alias("scope"), none.alias("key"), none.alias("metric"), F.lit("insufficient").alias("verdict"), zero.alias("baseline"), zero.alias("candidate"), "detail"))


def calibrate(m: Model, th: Thresholds) -> DataFrame:
    """A row for each group: runs, whether they suffice, the split's verdict, drift and notes (how many, and the first
    ``SHOWN`` in report order), and the runs that flip the verdict when they are left out.

    The split needs 2 * min_support runs, leaving one out one more. ``drift`` gives all of the findings.
    """
    got = check(m, th)
    found = _drift(got, th)
    counts = m.runs.groupBy("grp").agg(F.count("*").alias("runs"))
    text = F.when(F.col("kind") == "drift", F.concat_ws(":", F.col("scope"), F.nullif("key", F.lit("")), F.col("metric"), F.col("verdict"))).otherwise(F.col("detail"))
    told = found.groupBy("grp").agg(F.count_if(F.col("kind") == "drift").alias("drifts"), *[F.array_join(F.transform(F.slice(F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.struct("at", text.alias("text"))))), 1, SHOWN), lambda x: x["text"]), "; ").alias(k) for k in ("drift", "note")])
    whole = got.verdicts.where("split = 0").select("grp", F.col("verdict").alias("halves"))
    flips = got.verdicts.where("split > 0").join(whole, "grp").where("verdict <> halves").join(got.runs.select("grp", F.col("position").alias("split"), "run_id"), ["grp", "split"])
    flipping = flips.groupBy("grp").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("split", F.concat_ws(":", "run_id", "verdict").alias("text")))), lambda x: x["text"]), ",").alias("flips"))
    need = 2 * th.min_support
    enough, loo = F.col("runs") >= need, F.col("runs") - 1 >= need
    none = F.lit("")
    only = lambda where, c: F.when(where, F.coalesce(c, none)).otherwise(none)
    return counts.join(whole, "grp", "left").join(told, "grp", "left").join(flipping, "grp", "left").select(
        "grp", "runs", enough.alias("sufficient"), only(enough, F.col("halves")).alias("verdict"), F.coalesce("drifts", F.lit(0).cast("long")).alias("drifts"), only(enough, F.col("drift")).alias("drift"), only(enough, F.col("note")).alias("notes"),
        loo.alias("evaluated"), only(loo, F.col("flips")).alias("flipping_runs"),
        F.when(~enough, F.format_string(f"self-check needs k>={need} runs (have %d)", "runs")).when(~loo, F.format_string(f"leave-one-out needs k>={need + 1} runs (have %d)", "runs")).otherwise(none).alias("detail"),
    )


def rate_verdict(b_bad: Column, b_n: Column, c_bad: Column, c_n: Column, delta: float, th: Thresholds) -> Column:
    """The verdict of two rates of bad outcomes."""
    (b_lo, b_hi), (c_lo, c_hi) = wilson(b_bad, b_n, th.z), wilson(c_bad, c_n, th.z)
    moved = F.coalesce(F.try_divide(c_bad.cast("double"), c_n.cast("double")), F.lit(0.0)) - F.coalesce(F.try_divide(b_bad.cast("double"), b_n.cast("double")), F.lit(0.0))
    few = (b_n < th.min_support) | (c_n < th.min_support)
    return F.when(few, "insufficient").when((b_hi < c_lo) & (moved > delta), "regression").when(moved > delta, "notable").when((c_hi < b_lo) & (-moved > delta), "improvement").otherwise("ok")


def sensitivity(counts: DataFrame, th: Thresholds) -> DataFrame:
    """What the support can show, of columns b_runs and c_runs: for each rate gate whether a full flip would fire, and from how many runs.

    A row a gate; ``min_runs`` is 0 beyond ``SEARCH``.
    """
    gates = {"presence": th.presence_delta, "error_rate": th.error_rate_delta, "annotation": th.annotation_rate_delta}
    each = counts.select("b_runs", "c_runs", F.explode(F.array(*[F.struct(F.lit(k).alias("gate"), F.lit(v).alias("delta")) for k, v in gates.items()])).alias("g")).select("b_runs", "c_runs", "g.*")
    zero = F.lit(0).cast("long")
    fires = F.lit(False)
    for k, v in gates.items():
        fires = F.when(F.col("gate") == k, rate_verdict(zero, F.col("b_runs"), F.col("c_runs"), F.col("c_runs"), v, th) == "regression").otherwise(fires)
    sizes = counts.sparkSession.range(1, SEARCH + 1).select(F.col("id").alias("n"))
    least = sizes.agg(*[F.coalesce(F.min(F.when(rate_verdict(zero, F.col("n"), F.col("n"), F.col("n"), v, th) == "regression", F.col("n"))), zero).alias(k) for k, v in gates.items()])
    long = least.select(F.explode(F.array(*[F.struct(F.lit(k).alias("gate"), F.col(k).alias("min_runs")) for k in gates])).alias("x")).select("x.*")
    return each.withColumn("reachable", F.coalesce(fires, F.lit(False))).join(F.broadcast(long), "gate").select("gate", "reachable", "min_runs")  # a row a gate


def smallest_paired(th: Thresholds) -> int:
    """How many tasks, all moved one way, it takes to fire; 0 if none do."""
    n = unanimous(th.paired_alpha)
    return max(n, th.paired_min_tasks) if n else 0
