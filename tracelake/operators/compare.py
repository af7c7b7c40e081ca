"""The gate: baseline and candidate statistics side by side become findings, findings a verdict.

Findings are long rows: scope, key, name, metric, verdict, baseline, candidate, delta, band_lo, band_hi,
detail. Every comparison is arithmetic on columns; rows of both groups meet in one full outer join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.stats import binomial_tail, pass_k_steps, signed_rank, stats_of, unanimous, wilson
from tracelake.operators.aggregate import METRICS
from tracelake.plans.model import OUTCOME
from tracelake.plans.thresholds import Thresholds

COLUMNS = ("scope", "key", "name", "metric", "verdict", "baseline", "candidate", "delta", "band_lo", "band_hi", "detail")
ROW_METRICS = ("occurrences", *METRICS)
_SCOPES = ("total", "paired", "phase", "step")


ASKED = "array<struct<metric:string,rate:boolean,delta:double,b_bad:bigint,b_n:bigint,c_bad:bigint,c_n:bigint,b:struct<n:bigint,median:double,p25:double,p75:double,p90:double>,c:struct<n:bigint,median:double,p25:double,p75:double,p90:double>,better:boolean,mirrored:boolean,note:string,absent:string>>"


def _ask(metric: Column, rate: tuple | None = None, stats: tuple | None = None, better: Column | bool = False, mirrored: Column | bool = False, note: Column | str = "", absent: Column | None = None) -> Column:
    """A comparison to make: of rates (bad and n of both sides, least delta), of statistics, or none (``absent``: why)."""
    better, mirrored, note = (x if isinstance(x, Column) else F.lit(x) for x in (better, mirrored, note))
    none = F.lit(None)
    b_bad, b_n, c_bad, c_n, delta = rate or (none,) * 5
    b, c = stats or (none, none)
    delta = delta if isinstance(delta, Column) else F.lit(delta)
    fields = {"metric": metric, "rate": F.lit(rate is not None), "delta": delta, "b_bad": b_bad, "b_n": b_n, "c_bad": c_bad, "c_n": c_n, "b": b, "c": c, "better": better, "mirrored": mirrored, "note": note, "absent": none if absent is None else absent}
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def judged(asked: DataFrame, th: Thresholds, also: tuple[str, ...] = ()) -> DataFrame:
    """The findings of the comparisons in ``f``, a row each, with the columns ``also``.

    Rates of bad outcomes: a regression needs apart intervals and more than the delta. Medians: a regression
    is outside a band around the baseline's; more is worse unless ``better``. One formula for all rows keeps
    the generated code small.
    """
    f, k = F.col("f"), th.min_support
    df = asked.withColumns({"bn": F.when(f["rate"], f["b_n"]).otherwise(f["b"]["n"]), "cn": F.when(f["rate"], f["c_n"]).otherwise(f["c"]["n"])})
    (b_lo, b_hi), (c_lo, c_hi) = wilson(f["b_bad"], f["b_n"], th.z), wilson(f["c_bad"], f["c_n"], th.z)
    share = lambda bad, n: F.coalesce(F.try_divide(bad.cast("double"), n.cast("double")), F.lit(0.0))
    df = df.withColumns({
        "few": (F.col("bn") < k) | (F.col("cn") < k), "at": F.when(f["rate"], share(f["b_bad"], f["b_n"])).otherwise(f["b"]["median"]), "now": F.when(f["rate"], share(f["c_bad"], f["c_n"])).otherwise(f["c"]["median"]),
        "b_lo": b_lo, "b_hi": b_hi, "c_lo": c_lo, "c_hi": c_hi, "band": F.greatest(th.metric_rel_delta * F.abs(f["b"]["median"]), th.iqr_factor * (f["b"]["p75"] - f["b"]["p25"])),
    })
    df = df.withColumns({"lo": F.when(f["rate"], F.col("b_lo")).otherwise(F.col("at") - F.col("band")), "hi": F.when(f["rate"], F.col("b_hi")).otherwise(F.col("at") + F.col("band")), "moved": F.col("now") - F.col("at")})
    of_rate = F.when((F.col("b_hi") < F.col("c_lo")) & (F.col("moved") > f["delta"]), "regression").when(F.col("moved") > f["delta"], "notable").when((F.col("c_hi") < F.col("b_lo")) & (-F.col("moved") > f["delta"]), "improvement").otherwise("ok")
    up, down = F.when(f["better"], "improvement").otherwise("regression"), F.when(f["better"], "regression").otherwise("improvement")
    of_metric = F.when(F.col("now") > F.col("hi"), up).when(F.col("now") < F.col("lo"), down).otherwise("ok")
    short = F.when(
        F.col("few"),
        F.concat_ws(" and ", F.when(F.col("bn") < k, F.concat(F.lit("baseline n="), F.col("bn").cast("string"))), F.when(F.col("cn") < k, F.concat(F.lit("candidate n="), F.col("cn").cast("string"))), F.lit(None).cast("string")),
    )
    detail = F.concat_ws("; ", F.concat(short, F.lit(f" below min support {k}")), F.nullif(f["note"], F.lit("")))
    absent, few, mirrored, zero = f["absent"].isNotNull(), F.col("few"), f["mirrored"], F.lit(0.0)
    flip = lambda c: F.when(mirrored, 1 - c).otherwise(c)
    known = lambda c: F.when(absent, zero).otherwise(c)
    return df.select(
        *also, "scope", "key", "name", f["metric"].alias("metric"), F.when(absent | few, "insufficient").when(f["rate"], of_rate).otherwise(of_metric).alias("verdict"),
        known(flip(F.col("at"))).alias("baseline"), known(flip(F.col("now"))).alias("candidate"), known(F.when(mirrored, -F.col("moved")).otherwise(F.col("moved"))).alias("delta"),
        known(F.when(few, zero).when(mirrored, 1 - F.col("hi")).otherwise(F.col("lo"))).alias("band_lo"), known(F.when(few, zero).when(mirrored, 1 - F.col("lo")).otherwise(F.col("hi"))).alias("band_hi"),
        F.when(absent, f["absent"]).otherwise(detail).alias("detail"),
    )


def _sides(df: DataFrame, on: list[str]) -> DataFrame:
    """Rows of the two groups side by side in structs ``b`` and ``c``, null where a group has none."""
    rest = [c for c in df.columns if c not in ("grp", *on)]
    side = lambda grp, k: df.where(F.col("grp") == grp).select(*on, F.struct(*rest).alias(k))
    if not on:
        return side("baseline", "b").crossJoin(side("candidate", "c"))  # a row a group at most
    return side("baseline", "b").join(side("candidate", "c"), on, "full_outer")


def _asked(df: DataFrame, scope: str, asks: Column, key: Column | None = None, name: Column | None = None) -> DataFrame:
    return df.select(F.lit(scope).alias("scope"), (F.lit("") if key is None else key).alias("key"), (F.lit("") if name is None else name).alias("name"), F.explode(asks.cast(ASKED)).alias("f"))


def total_asks(totals: DataFrame, th: Thresholds) -> DataFrame:
    """The comparisons of totals."""
    both = _sides(totals, [])
    b, c = F.col("b"), F.col("c")
    asks = [_ask(F.lit(k), stats=(b[k], c[k])).cast(ASKED[6:-1]) for k in (*METRICS, "nodes")]
    asks.append(_ask(F.lit("error_rate"), rate=(b["error_runs"], b["runs"], c["error_runs"], c["runs"], th.error_rate_delta)).cast(ASKED[6:-1]))
    return _asked(both, "total", F.array(*asks))


def total_findings(totals: DataFrame, th: Thresholds) -> DataFrame:
    return judged(total_asks(totals, th), th)


def annotation_findings(annotations: DataFrame, specs: dict[str, bool], th: Thresholds) -> DataFrame:
    return judged(annotation_asks(annotations, specs, th), th)


def annotation_asks(annotations: DataFrame, specs: dict[str, bool], th: Thresholds) -> DataFrame:
    """The comparisons of run annotations by spec (key: higher is better). The verifier's outcome is always among them.

    Annotations of zeros and ones on both sides are rates of bad outcomes; those that are better high are
    shown as rates of good ones.
    """
    specs = specs if OUTCOME in specs else {OUTCOME: True, **specs}
    both = _sides(annotations.where(F.col("key").isin(*specs)), ["key"])
    b, c = F.col("b"), F.col("c")
    better = F.create_map(*[F.lit(x) for kv in specs.items() for x in kv])[F.col("key")]
    metric = F.concat(F.lit("ann:"), "key")
    bad = lambda s: F.when(better, s["n"] - s["ones"]).otherwise(s["ones"])
    ones = F.format_string("ones %d/%d -> %d/%d", b["ones"], b["n"], c["ones"], c["n"])
    one = ASKED[6:-1]
    rate = _ask(metric, rate=(bad(b), b["n"], bad(c), c["n"], th.annotation_rate_delta), mirrored=better, note=ones).cast(one)
    none = F.when(b.isNull(), "annotation absent in baseline").otherwise("annotation absent in candidate")
    ask = F.when(b.isNull() | c.isNull(), _ask(metric, absent=none).cast(one)).when(b["binary"] & c["binary"], rate).otherwise(_ask(metric, stats=(b["stats"], c["stats"]), better=better).cast(one))
    return _asked(both, "total", F.array(ask))


def coverage(rows: DataFrame) -> DataFrame:
    """One row: the share of the baseline's keys that the candidate has; 1 without any."""
    keys = rows.groupBy("key").agg(F.max((F.col("grp") == "baseline").cast("int")).alias("b"), F.max((F.col("grp") == "candidate").cast("int")).alias("c"))
    return keys.agg(F.coalesce(F.try_divide(F.sum(F.col("b") * F.col("c")).cast("double"), F.sum("b").cast("double")), F.lit(1.0)).alias("coverage"))


def row_findings(scope: str, rows: DataFrame, runs: DataFrame, th: Thresholds, downgrade: bool, specs: dict[str, bool] | None = None) -> DataFrame:
    """Findings of step or phase rows. With ``downgrade``, regressions are notable while coverage is below the floor."""
    found = judged(row_asks(scope, rows, runs, th, specs), th)
    return downgraded(found, coverage(rows), th) if downgrade else found


def row_asks(scope: str, rows: DataFrame, runs: DataFrame, th: Thresholds, specs: dict[str, bool] | None = None) -> DataFrame:
    """The comparisons of step or phase rows.

    ``specs`` (key: higher is better) names annotations of rows to compare as metrics, where rows have ``annotations``.
    """
    sizes = runs.groupBy("grp").count().agg(F.coalesce(F.sum(F.when(F.col("grp") == "baseline", F.col("count"))), F.lit(0)).alias("b_runs"), F.coalesce(F.sum(F.when(F.col("grp") == "candidate", F.col("count"))), F.lit(0)).alias("c_runs"))
    both = _sides(rows.drop("runs"), ["key"]).crossJoin(F.broadcast(sizes))  # one row
    b, c, bn, cn = F.col("b"), F.col("c"), F.col("b_runs"), F.col("c_runs")
    bp, cp = F.coalesce(b["present"], F.lit(0)), F.coalesce(c["present"], F.lit(0))
    one = ASKED[6:-1]
    presence = _ask(F.lit("presence"), rate=(bn - bp, bn, cn - cp, cn, th.presence_delta), note=F.format_string("present %d/%d -> %d/%d", bp, bn, cp, cn)).cast(one)
    errors = _ask(F.lit("error_rate"), rate=(b["error_runs"], bp, c["error_runs"], cp, th.error_rate_delta)).cast(one)
    present = [presence, errors, *[_ask(F.lit(k), stats=(b[k], c[k])).cast(one) for k in ROW_METRICS]]
    gone = _ask(F.lit("metrics"), absent=F.when(b.isNull(), "absent in baseline").otherwise("absent in candidate")).cast(one)
    both_here = F.array(*present)
    if specs and "annotations" in rows.columns:
        of = lambda side, key: F.try_element_at(side["annotations"], F.lit(key))
        asked = []
        for key, better in specs.items():
            x, y, metric = of(b, key), of(c, key), F.lit(f"ann:{key}")
            none = F.when(x.isNull(), "annotation absent in baseline").otherwise("annotation absent in candidate")
            asked.append(F.when(x.isNotNull() & y.isNotNull(), _ask(metric, stats=(x, y), better=better).cast(one)).when(x.isNotNull() | y.isNotNull(), _ask(metric, absent=none).cast(one)))
        both_here = F.concat(both_here, F.filter(F.array(*asked), lambda x: x.isNotNull()))
    asks = F.when(b.isNotNull() & c.isNotNull(), both_here).otherwise(F.array(presence, gone))
    name = F.coalesce(F.nullif(b["name"], F.lit("")), c["name"], F.lit(""))
    return _asked(both, scope, asks, F.col("key"), name)


def downgraded(found: DataFrame, covered: DataFrame, th: Thresholds) -> DataFrame:
    """Findings whose step regressions are notable while coverage is below the floor."""
    found = found.crossJoin(F.broadcast(covered))  # one row
    down = (F.col("scope") == "step") & (F.col("coverage") < th.coverage_floor) & (F.col("verdict") == "regression")
    note = F.format_string(f"step alignment coverage %.2f below floor {th.coverage_floor:.2f}", F.col("coverage"))
    return found.withColumns({"verdict": F.when(down, "notable").otherwise(F.col("verdict")), "detail": F.when(down, F.concat_ws("; ", F.nullif(F.col("detail"), F.lit("")), note)).otherwise(F.col("detail"))}).drop("coverage")


def task_pairs(tasks: DataFrame, th: Thresholds) -> DataFrame:
    """Tasks with enough runs on both sides."""
    return _sides(tasks, ["task"]).where((F.col("b.runs") >= th.min_support) & (F.col("c.runs") >= th.min_support))


def paired_findings(tasks: DataFrame, th: Thresholds) -> DataFrame:
    """A finding for each metric over the tasks' median deltas, by sign test or signed ranks; none if a side has no tasks."""
    pairs = task_pairs(tasks, th)
    side = tasks.agg(F.count_if(F.col("grp") == "baseline").alias("b"), F.count_if(F.col("grp") == "candidate").alias("c")).where("b > 0 AND c > 0")
    deltas = pairs.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.when((F.col("b")[k]["n"] >= th.min_support) & (F.col("c")[k]["n"] >= th.min_support), F.col("c")[k]["median"] - F.col("b")[k]["median"]).alias("d")) for k in METRICS])).alias("x")).select("x.*")
    frame = side.select(F.explode(F.array(*[F.lit(k) for k in METRICS])).alias("metric"))
    # deltas of one metric: one value a task
    grouped = deltas.where("d <> 0").groupBy("metric").agg(F.sort_array(F.collect_list("d")).alias("d"))
    matched = pairs.agg(F.count("*").alias("matched"))
    found = frame.join(grouped, "metric", "left").crossJoin(F.broadcast(matched)).withColumn("d", F.coalesce("d", F.array().cast("array<double>")))
    found = found.withColumns({"nonzero": F.size("d").cast("long"), "positive": F.size(F.filter("d", lambda x: x > 0)).cast("long")})
    if th.paired_test == "sign":
        found = found.withColumn("t", F.struct(F.col("positive").cast("double").alias("w_plus"), F.col("nonzero").cast("double").alias("w_total"), binomial_tail("positive", "nonzero").alias("p_up"), binomial_tail("(nonzero - positive)", "nonzero").alias("p_down")))
    else:
        found = found.withColumn("t", signed_rank("d"))
    up, down = F.round(F.col("t.p_up"), 12) <= th.paired_alpha, F.round(F.col("t.p_down"), 12) <= th.paired_alpha
    verdict = F.when(F.col("matched") < th.paired_min_tasks, "insufficient").when(up, "regression").when(down, "improvement").otherwise("ok")
    return found.select(F.lit("paired").alias("scope"), F.lit("").alias("key"), F.lit("").alias("name"), "metric", verdict.alias("verdict"), "matched", "nonzero", "positive", F.col("t.w_plus").alias("w_plus"), F.col("t.w_total").alias("w_total"), F.col("t.p_up").alias("p_up"), F.col("t.p_down").alias("p_down"))


def plain_paired(paired: DataFrame, th: Thresholds, also: tuple[str, ...] = ()) -> DataFrame:
    """Paired findings in the columns of all findings: the test is told in the detail."""
    word = F.when(F.col("matched") == 1, "task").otherwise("tasks")
    few = F.format_string(f"matched %d %s below paired min {th.paired_min_tasks}", "matched", word)
    detail = F.when(F.col("verdict") == "insufficient", few).otherwise(F.format_string("+%d/%d tasks, p=%.4f", "positive", "nonzero", "p_up"))
    zeros = [F.lit(0.0).alias(k) for k in ("baseline", "candidate", "delta", "band_lo", "band_hi")]
    return paired.select(*also, "scope", "key", "name", "metric", "verdict", *zeros, detail.alias("detail"))


#: Numbers of runs that one row of ``reliability`` steps through.
_BLOCK = 200


def reliability(tasks: DataFrame) -> DataFrame:
    """pass^k for each group: the mean over tasks with outcomes, for k up to the least number of outcomes.

    A task's pass^k is that of k - 1 times one factor. Factors are multiplied in blocks of k, and the blocks' products
    before each block once more: work in proportion to the rows, not to their square.
    """
    known = tasks.where("out_n > 0")
    top = known.groupBy("grp").agg(F.min("out_n").alias("k_max"), F.count("*").alias("tasks"))
    each = known.select("grp", "task", "out_n", "out_ones").join(F.broadcast(top), "grp").withColumn("block", F.explode(F.expr(f"sequence(0L, (k_max - 1) div {_BLOCK})")))  # a row a group
    each = each.withColumn("own", pass_k_steps("out_ones", "out_n", f"block * {_BLOCK}", f"least(k_max, (block + 1) * {_BLOCK})"))
    earlier = Window.partitionBy("grp", "task").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    each = each.withColumn("before", F.coalesce(F.product(F.element_at("own", -1)).over(earlier), F.lit(1.0)))
    each = each.select("grp", "tasks", "block", "before", F.posexplode("own").alias("at", "own"))
    return each.groupBy("grp", (F.col("block") * _BLOCK + F.col("at") + 1).alias("k"), "tasks").agg(F.avg(F.col("before") * F.col("own")).alias("pass_k"))


def audit(per_run: DataFrame, th: Thresholds) -> DataFrame:
    """Runs whose metric is far from their group's median: outside max(rel * |median|, factor * IQR). Groups of 3 at least."""
    metrics = (*METRICS, "turns")
    long = per_run.select("grp", "run_id", F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.coalesce(k, F.lit(0.0)).alias("value")) for k in metrics])).alias("x")).select("grp", "run_id", "x.*")
    group = long.groupBy("grp", "metric").agg(stats_of("value").alias("s"))
    band = F.greatest(th.audit_rel * F.abs("s.median"), th.audit_iqr * (F.col("s.p75") - F.col("s.p25")))
    return long.join(F.broadcast(group), ["grp", "metric"]).where((F.col("s.n") >= 3) & (F.abs(F.col("value") - F.col("s.median")) > band)).select("grp", "run_id", "metric", "value", F.col("s.median").alias("median"), band.alias("band"))


def audit_order(flags: DataFrame) -> DataFrame:
    """Flags by run, and each run's by metric."""
    return flags.orderBy("grp", "run_id", F.array_position(F.array(*[F.lit(k) for k in (*METRICS, "turns")]), F.col("metric")))


def kept(findings: DataFrame) -> DataFrame:
    """Totals, and of the other scopes what isn't ok."""
    return findings.where((F.col("scope") == "total") | (F.col("verdict") != "ok"))


def scope_rank() -> Column:
    """A finding's place by its scope."""
    return reduce(lambda c, kv: c.when(F.col("scope") == kv[1], kv[0]), enumerate(_SCOPES), F)


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy(scope_rank(), "key", "metric")


def verdict(findings: DataFrame, th: Thresholds) -> DataFrame:
    """One row: counts by verdict and the overall verdict."""
    count = lambda v: F.count_if(F.col("verdict") == v)
    sums = findings.agg(count("regression").alias("regressions"), count("notable").alias("notables"), count("insufficient").alias("insufficient"), count("improvement").alias("improvements"), F.count("*").alias("findings"))
    only = (F.col("notables") == 0) & (F.col("improvements") == 0) & (F.col("regressions") == 0)
    overall = F.when(F.col("regressions") > 0, "regression").when(F.lit(th.fail_on_notable) & (F.col("notables") > 0), "regression").when((F.col("insufficient") > 0) & only, "insufficient").otherwise("ok")
    return sums.withColumn("verdict", overall)


def smallest_paired(th: Thresholds) -> int:
    """How many unanimous tasks it takes to fire."""
    n = unanimous(th.paired_alpha)
    return max(n, th.paired_min_tasks) if n else 0
