"""Queries of the other operators over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import redact, text
from tracelake.functions.pricing import EXACT, FAMILIES, UNPRICED, cost_usd
from tracelake.functions.redact import capped, redacted, redacted_plain
from tracelake.operators import aggregate as agg
from tracelake.operators import calibrate, diff, history, judge, keys, markers, reduce, tables
from tracelake.plans import gate_sql
from tracelake.plans.gate_sql import stats, wilson
from tracelake.plans.thresholds import DEFAULT as TH
from tracelake.plans.views import VIEWS, events, gate_model, table
from tracelake.sources import evidence, transcript


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# --- self-checks ---


def calibration_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(calibrate.split_findings(gate_model(spark, sf_dir), TH))


def calibration_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(calibrate.drift(gate_model(spark, sf_dir), TH).drop("at"))


def calibration_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibrate.check(gate_model(spark, sf_dir), TH).verdicts.select("grp", F.col("split").alias("dropped"), F.round("coverage", 6).alias("coverage"), "verdict")


def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibrate.calibrate(gate_model(spark, sf_dir), TH)


def sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = gate_model(spark, sf_dir).runs
    return calibrate.sensitivity(runs.agg(F.count_if(F.col("grp") == "baseline").alias("b_runs"), F.count_if(F.col("grp") == "candidate").alias("c_runs")), TH)


_SPLITS = """
placed AS (SELECT run_id, grp, row_number() OVER (PARTITION BY grp ORDER BY start_us, end_us, run_id) AS position, count(*) OVER (PARTITION BY grp) AS k FROM runx),
halves AS (SELECT run_id, grp AS own, dropped, CASE WHEN position - (dropped BETWEEN 1 AND position - 1)::INT <= (k - (dropped > 0)::INT) // 2 THEN 'baseline' ELSE 'candidate' END AS half FROM (SELECT *, unnest(range(0, k + 1)) AS dropped FROM placed) WHERE dropped <> position)
"""


def _split_sql() -> str:
    """The findings of every split of every group, each compared anew: sf (own, dropped, scope, key, metric, verdict, baseline, candidate, detail)."""
    at, of = "own, dropped", "GROUP BY own, dropped, half"
    row = ("occurrences", *agg.METRICS)
    cols = lambda names: [f"{m}_{k}" for m in names for k in ("n", "median", "p25", "p75", "p90")]
    out = f"unnest({{}}) AS f"
    shown = "f.metric AS metric, f.verdict AS verdict, f.baseline AS baseline, f.candidate AS candidate, f.detail AS detail"
    ctes = [
        "hsizes AS (SELECT own, dropped, count(*) FILTER (WHERE half = 'baseline') AS b_runs, count(*) FILTER (WHERE half = 'candidate') AS c_runs FROM halves GROUP BY own, dropped)",
        f"htot AS (SELECT own, dropped, half AS grp, count(*) AS runs, count(*) FILTER (WHERE has_error) AS error_runs, {', '.join(stats(m, m) for m in (*agg.METRICS, 'nodes'))} FROM cell JOIN halves USING (run_id) {of})",
        f"hann AS (SELECT own, dropped, half AS grp, count(value) AS n, count(*) FILTER (WHERE value = 1) AS ones, bool_and(value IN (0, 1)) AS allbits, {stats('value', 'stats')} FROM ann JOIN halves USING (run_id) WHERE key = 'verifier.pass' {of})",
        f"htask AS (SELECT own, dropped, half AS grp, task, count(*) AS runs, {', '.join(stats(m, m) for m in agg.METRICS)} FROM cell JOIN halves USING (run_id) WHERE task <> '' {of}, task)",
        *[f"h{fold} AS (SELECT own, dropped, half AS grp, key, count(*) AS present, count(*) FILTER (WHERE worst = 'error') AS error_runs, {', '.join(stats(m, m) for m in row)} FROM {fold} JOIN halves USING (run_id) {of}, key)" for fold in ("stepf", "phasef")],
        f"hcov AS (SELECT own, dropped, coalesce(sum(b * c)::DOUBLE / nullif(sum(b), 0), 1) AS coverage FROM (SELECT {at}, key, max((grp = 'baseline')::INT) AS b, max((grp = 'candidate')::INT) AS c FROM hstepf GROUP BY {at}, key) GROUP BY {at})",
    ]
    totals = [gate_sql._metric(f"'{m}'", f"b_{m}", f"c_{m}") for m in (*agg.METRICS, "nodes")] + [gate_sql._rate("'error_rate'", "b_error_runs", "b_runs", "c_error_runs", "c_runs", TH.error_rate_delta)]
    tot = ["runs", "error_runs", *cols((*agg.METRICS, "nodes"))]
    parts = [f"SELECT {at}, 'total' AS scope, '' AS key, {shown} FROM (SELECT {at}, {out.format('[' + ', '.join(totals) + ']')} FROM {gate_sql._side('htot', tot, 'b', at)} JOIN {gate_sql._side('htot', tot, 'c', at)} USING ({at}))"]
    ann = ["n", "ones", "allbits", *cols(("stats",))]
    name = "'ann:verifier.pass'"
    ones = "'ones ' || b_ones || '/' || b_n || ' -> ' || c_ones || '/' || c_n"
    f = f"CASE WHEN b_here IS NULL THEN {gate_sql._absent(name, chr(39) + 'annotation absent in baseline' + chr(39))} WHEN c_here IS NULL THEN {gate_sql._absent(name, chr(39) + 'annotation absent in candidate' + chr(39))} WHEN b_allbits AND c_allbits THEN {gate_sql._rate(name, '(b_n - b_ones)', 'b_n', '(c_n - c_ones)', 'c_n', TH.annotation_rate_delta, ones, True)} ELSE {gate_sql._metric(name, 'b_stats', 'c_stats', True)} END"
    parts.append(f"SELECT {at}, 'total', '', {shown} FROM (SELECT {at}, {f} AS f FROM {gate_sql._side('hann', ann, 'b', at)} FULL JOIN {gate_sql._side('hann', ann, 'c', at)} USING ({at}))")
    bp, cp = "coalesce(b_present, 0)", "coalesce(c_present, 0)"
    note = f"'present ' || {bp} || '/' || b_runs || ' -> ' || {cp} || '/' || c_runs"
    presence = gate_sql._rate("'presence'", f"(b_runs - {bp})", "b_runs", f"(c_runs - {cp})", "c_runs", TH.presence_delta, note)
    errors = gate_sql._rate("'error_rate'", "b_error_runs", bp, "c_error_runs", cp, TH.error_rate_delta)
    gone = gate_sql._absent("'metrics'", "CASE WHEN b_here IS NULL THEN 'absent in baseline' ELSE 'absent in candidate' END")
    each = f"CASE WHEN b_here AND c_here THEN [{', '.join([presence, errors, *[gate_sql._metric(chr(39) + m + chr(39), f'b_{m}', f'c_{m}') for m in row]])}] ELSE [{presence}, {gone}] END"
    keyed = f"{at}, key"
    rows = ["present", "error_runs", *cols(row)]
    for scope, fold in (("step", "hstepf"), ("phase", "hphasef")):
        down = f"'{scope}' = 'step' AND coverage < {TH.coverage_floor} AND f.verdict = 'regression'"
        low = f"printf('step alignment coverage %.2f below floor {TH.coverage_floor:.2f}', coverage)"
        fixed = shown.replace("f.verdict AS verdict", f"CASE WHEN {down} THEN 'notable' ELSE f.verdict END AS verdict").replace("f.detail AS detail", f"CASE WHEN {down} THEN CASE WHEN f.detail = '' THEN {low} ELSE f.detail || '; ' || {low} END ELSE f.detail END AS detail")
        parts.append(f"SELECT {at}, '{scope}', key, {fixed} FROM (SELECT {at}, key, coverage, {out.format(each)} FROM {gate_sql._side(fold, rows, 'b', keyed)} FULL JOIN {gate_sql._side(fold, rows, 'c', keyed)} USING ({keyed}) JOIN hsizes USING ({at}) JOIN hcov USING ({at}))")
    tasks, k = ["runs", *cols(agg.METRICS)], TH.min_support
    ctes += [
        f"hpairs AS (SELECT * FROM {gate_sql._side('htask', tasks, 'b', at + ', task')} JOIN {gate_sql._side('htask', tasks, 'c', at + ', task')} USING ({at}, task) WHERE b_runs >= {k} AND c_runs >= {k})",
        "hdeltas AS (" + " UNION ALL ".join(f"SELECT {at}, '{m}' AS metric, c_{m}_median - b_{m}_median AS d FROM hpairs WHERE b_{m}_n >= {k} AND c_{m}_n >= {k} AND c_{m}_median <> b_{m}_median" for m in agg.METRICS) + ")",
        f"hsigns AS (SELECT own, dropped, metric, coalesce(matched, 0) AS matched, coalesce(nonzero, 0) AS nonzero, coalesce(positive, 0) AS positive FROM (SELECT {at}, unnest({list(agg.METRICS)}) AS metric FROM htask GROUP BY {at} HAVING count(DISTINCT grp) = 2) LEFT JOIN (SELECT {at}, count(*) AS matched FROM hpairs GROUP BY {at}) USING ({at}) LEFT JOIN (SELECT {at}, metric, count(*) AS nonzero, count(*) FILTER (WHERE d > 0) AS positive FROM hdeltas GROUP BY {at}, metric) USING ({at}, metric))",
        f"htests AS (SELECT *, {gate_sql._tail('positive')} AS p_up, {gate_sql._tail('(nonzero - positive)')} AS p_down FROM hsigns)",
    ]
    few = f"matched < {TH.paired_min_tasks}"
    parts.append(f"SELECT {at}, 'paired', '', metric, CASE WHEN {few} THEN 'insufficient' WHEN round(p_up, 12) <= {TH.paired_alpha} THEN 'regression' WHEN round(p_down, 12) <= {TH.paired_alpha} THEN 'improvement' ELSE 'ok' END, 0::DOUBLE, 0::DOUBLE, CASE WHEN {few} THEN 'matched ' || matched || CASE WHEN matched = 1 THEN ' task' ELSE ' tasks' END || ' below paired min {TH.paired_min_tasks}' ELSE '+' || positive || '/' || nonzero || ' tasks, p=' || printf('%.4f', p_up) END FROM htests")
    ctes.append(f"sf AS ({' UNION ALL '.join(f'({x})' for x in parts)})")
    return f"WITH {VIEWS.strip()}, {gate_sql._FOLDS.strip()}, {_SPLITS.strip()}, " + ", ".join(ctes)


_NEED = 2 * TH.min_support
_SF = _split_sql()
_DRIFT = f"""{_SF}, sv AS (SELECT own AS grp, dropped, CASE WHEN bool_or(verdict = 'regression') THEN 'regression' WHEN bool_or(verdict = 'insufficient') AND NOT bool_or(verdict = 'notable') AND NOT bool_or(verdict = 'improvement') THEN 'insufficient' ELSE 'ok' END AS verdict FROM sf GROUP BY own, dropped),
drift AS (SELECT own AS grp, 'drift' AS kind, scope, key, metric, verdict, baseline, candidate, detail, CASE scope WHEN 'total' THEN 0 WHEN 'paired' THEN 1 WHEN 'phase' THEN 2 ELSE 3 END AS rank FROM sf WHERE dropped = 0 AND verdict IN ('regression', 'notable') AND own IN (SELECT grp FROM placed WHERE k >= {_NEED})
  UNION ALL SELECT own, 'note', '', '', '', 'insufficient', 0, 0, detail, min(CASE scope WHEN 'total' THEN 0 WHEN 'paired' THEN 1 WHEN 'phase' THEN 2 ELSE 3 END) FROM sf WHERE dropped = 0 AND verdict = 'insufficient' AND detail <> '' AND own IN (SELECT grp FROM placed WHERE k >= {_NEED}) AND own IN (SELECT grp FROM sv WHERE dropped = 0 AND verdict = 'insufficient') GROUP BY own, detail)"""
_CALIBRATE = f"""{_DRIFT}
SELECT grp, runs, runs >= {_NEED} AS sufficient, CASE WHEN runs >= {_NEED} THEN verdict ELSE '' END AS verdict, coalesce(drifts, 0) AS drifts, coalesce(shown, '') AS drift, coalesce(notes, '') AS notes, runs - 1 >= {_NEED} AS evaluated, CASE WHEN runs - 1 >= {_NEED} THEN coalesce(flips, '') ELSE '' END AS flipping_runs,
  CASE WHEN runs < {_NEED} THEN 'self-check needs k>={_NEED} runs (have ' || runs || ')' WHEN runs - 1 < {_NEED} THEN 'leave-one-out needs k>={_NEED + 1} runs (have ' || runs || ')' ELSE '' END AS detail
FROM (SELECT grp, count(*) AS runs FROM runx GROUP BY grp) LEFT JOIN (SELECT grp, verdict FROM sv WHERE dropped = 0) USING (grp)
LEFT JOIN (SELECT grp, count(*) AS drifts, array_to_string(list(scope || CASE WHEN key = '' THEN '' ELSE ':' || key END || ':' || metric || ':' || verdict ORDER BY rank, key, metric)[1:{calibrate.SHOWN}], '; ') AS shown FROM drift WHERE kind = 'drift' GROUP BY grp) USING (grp)
LEFT JOIN (SELECT grp, array_to_string(list(detail ORDER BY rank, key, metric, detail)[1:{calibrate.SHOWN}], '; ') AS notes FROM drift WHERE kind = 'note' GROUP BY grp) USING (grp)
LEFT JOIN (SELECT s.grp, string_agg(run_id || ':' || s.verdict, ',' ORDER BY s.dropped) AS flips FROM sv s JOIN sv w ON w.grp = s.grp AND w.dropped = 0 AND s.dropped > 0 AND s.verdict <> w.verdict JOIN placed p ON p.grp = s.grp AND p.position = s.dropped GROUP BY s.grp) USING (grp)
"""


def _fires(n_b: str, n_c: str, delta: float) -> str:
    (_, bh), (cl, _) = wilson("0", n_b), wilson(n_c, n_c)
    return f"({n_b} >= {TH.min_support} AND {n_c} >= {TH.min_support} AND {bh} < {cl} AND 1 > {delta})"


_SENSITIVITY = f"WITH {VIEWS.strip()}, g AS (SELECT count(*) FILTER (WHERE grp = 'baseline') AS b, count(*) FILTER (WHERE grp = 'candidate') AS c FROM runx) " + " UNION ALL ".join(
    f"SELECT '{gate}' AS gate, (SELECT {_fires('b', 'c', d)} FROM g) AS reachable, coalesce((SELECT min(n) FROM range(1, 1001) t(n) WHERE {_fires('n', 'n', d)}), 0)::BIGINT AS min_runs" for gate, d in (("presence", TH.presence_delta), ("error_rate", TH.error_rate_delta), ("annotation", TH.annotation_rate_delta))
)


# --- history ---


def pareto_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("seq", (F.col("o_custkey") % 60).cast("int"))
    points = o.groupBy("o_orderpriority", "seq").agg(F.round(F.avg((F.col("o_orderstatus") == "F").cast("double")), 6).alias("accuracy"), F.round(F.avg("o_totalprice"), 2).alias("cost_usd"))
    return history.dominated(points, ["o_orderpriority"])


_PARETO = """
WITH p AS (SELECT o_orderpriority, (o_custkey % 60)::INT AS seq, round(avg((o_orderstatus = 'F')::INT), 6) AS accuracy, round(avg(o_totalprice), 2) AS cost_usd FROM orders GROUP BY ALL)
SELECT a.*, EXISTS (SELECT 1 FROM p b WHERE b.o_orderpriority = a.o_orderpriority AND b.accuracy >= a.accuracy AND b.cost_usd <= a.cost_usd AND (b.accuracy > a.accuracy OR b.cost_usd < a.cost_usd)) AS dominated FROM p a
"""


def record_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return history.numbered(o.select(F.col("o_orderpriority").alias("baseline"), F.col("o_orderkey").alias("record_id"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("created_at")))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return evidence.last_of_ledger(o.select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("line_no"), F.col("o_orderstatus").alias("status"), "o_totalprice"))


# --- judges ---


def _judged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("n_chars").alias("n"))
    none = F.lit(None).cast("string")
    tools = F.array(*[F.struct(F.lit(t).alias("tool"), v.cast("double").alias("value")) for t, v in (("a", F.when(F.col("n") >= 1000, 1).otherwise(0)), ("b", F.when(F.col("n") % 3 != 0, 1).otherwise(0)), ("c", F.col("n") % 100 / 100))])
    scores = d.select(F.col("doc_id").cast("string").alias("run_id"), F.lit("judge.quality").alias("key"), none.alias("step_key"), F.explode(tools).alias("x")).select("run_id", "key", "step_key", "x.*")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("q")).where("q IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("string").alias("run_id"), F.lit("judge.quality").alias("key"), none.alias("step_key"), F.col("q").cast("double").alias("label"))
    return scores, labels


def judge_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(judge.agreement(judge.paired(*_judged(spark, sf_dir))))


def judge_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge.unmatched(judge.paired(*_judged(spark, sf_dir)))


def judge_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge.kappa_gate(judge.agreement(judge.paired(*_judged(spark, sf_dir))), 0.2)


def judge_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(judge.panel(_judged(spark, sf_dir)[0], 3).select("run_id", "value", "panel_size"))


def judge_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge.panel(_judged(spark, sf_dir)[0], 3, True).select("run_id", "value", "panel_size")


_JUDGED = """
d AS (SELECT doc_id, max(n_chars) AS n FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id),
s AS (SELECT doc_id::VARCHAR AS run_id, unnest([{'tool': 'a', 'value': (n >= 1000)::INT::DOUBLE}, {'tool': 'b', 'value': (n % 3 <> 0)::INT::DOUBLE}, {'tool': 'c', 'value': (n % 100)::DOUBLE / 100}]) AS x FROM d),
sc AS (SELECT run_id, x.tool AS tool, x.value AS value FROM s),
l AS (SELECT doc_id::VARCHAR AS run_id, max(quality)::DOUBLE AS label FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING max(quality) IS NOT NULL),
pr AS (SELECT 'judge.quality' AS key, tool, value, label FROM sc FULL JOIN l USING (run_id)),
rk AS (SELECT *, rank() OVER (PARTITION BY tool ORDER BY label) + (count(*) OVER (PARTITION BY tool, label) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY tool ORDER BY value) + (count(*) OVER (PARTITION BY tool, value) - 1) / 2.0 AS ry, (label >= 0.5)::INT AS lb, (value >= 0.5)::INT AS vb FROM pr WHERE value IS NOT NULL AND label IS NOT NULL),
ag AS (SELECT key, tool, n, round(CASE WHEN n >= 2 AND vx > 0 AND vy > 0 THEN cov / sqrt(vx * vy) END, 6) AS spearman, round(CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END, 6) AS kappa, round(tp::DOUBLE / nullif(pos, 0), 6) AS tpr, round(tn::DOUBLE / nullif(n - pos, 0), 6) AS tnr
  FROM (SELECT *, same::DOUBLE / n AS po, (pos::DOUBLE / n) * (called::DOUBLE / n) + (1 - pos::DOUBLE / n) * (1 - called::DOUBLE / n) AS pe FROM (SELECT key, tool, count(*) AS n, var_pop(rx) AS vx, var_pop(ry) AS vy, covar_pop(rx, ry) AS cov, sum((lb = vb)::INT) AS same, sum(lb) AS pos, sum(vb) AS called, sum(lb * vb) AS tp, sum((1 - lb) * (1 - vb)) AS tn FROM rk GROUP BY key, tool)))
"""


# --- scalar functions ---


def labels_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    number = lambda n: (key % n).cast("string")
    given = F.concat(
        F.lit(" seg = "), F.lower("c_mktsegment"), F.lit(",Bad Key=1,nation="), F.col("c_nationkey").cast("string"), F.lit(",k"), number(7), F.lit("="), key.cast("string"), F.lit(",novalue,k"), number(3), F.lit(" =  "), F.lower("c_name"),
        F.lit(",Up"), number(2), F.lit("=x=y,seg="), F.when(key % 2 == 0, "again").otherwise(""),
    )
    return c.select("c_custkey", text.parse_labels(given).alias("l")).select("c_custkey", text.format_labels(F.col("l")).alias("labels"), text.match_labels(F.col("l"), {"seg": "again", "absent": ""}).alias("matches"))


def token_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines priced by a model that their supplier stands for."""
    li = table(spark, sf_dir, "lineitem")
    model = F.element_at(F.array(*[F.lit(m) for m in _MODELS]), (F.col("l_suppkey") % len(_MODELS) + 1).cast("int"))
    cost = cost_usd(model, F.col("l_partkey"), F.col("l_orderkey"), F.col("l_suppkey"), F.col("l_linenumber").cast("long"))
    return li.groupBy(text.tool_type(F.lit("mcp__x")).alias("type"), (F.col("l_suppkey") % len(_MODELS)).alias("m")).agg(F.round(F.sum(cost), 4).alias("cost_usd"), F.count_if(cost.isNull()).alias("unpriced"))


#: A model of every family, of every whole name, without a price, and unknown; under vendors' names and dates.
_MODELS = [
    f"{('', 'anthropic.', 'vertex_ai/')[i % 3]}{name}{('-20250101', '@20250101', '')[i % 3]}"
    for i, name in enumerate((*[f"{k}x" for k in FAMILIES], *EXACT, *UNPRICED, "unknown-model"))
]
_COSTS = " ".join(f"WHEN {i} THEN l_partkey / 1e6 * {t[0]} + l_orderkey / 1e6 * {t[1]} + l_suppkey / 1e6 * {t[2]} + l_linenumber / 1e6 * {t[3]}" for i, t in enumerate((*FAMILIES.values(), *EXACT.values())))


def _dealt(docs: DataFrame) -> DataFrame:
    """Documents over all tasks: a file whose row groups are few would else be read, and cleared, by as few."""
    return docs.repartition("doc_id", "text")


def redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: how many kinds, and the redacted text's hash."""
    d = _dealt(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).withColumn("r", redacted(F.col("text")))
    return d.select("doc_id", F.size("r.findings").alias("n_findings"), F.array_join(F.array_distinct(F.transform("r.findings", lambda f: f["reason"])), ",").alias("reasons"), F.sha2(capped(F.col("r.text")), 256).alias("sha256"))


def redaction_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A secret of each of eight kinds, made from the id, behind every document: the rules by built-in functions."""
    d = _dealt(table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select("doc_id", "text")).withColumn("h", F.sha2(F.col("doc_id").cast("string"), 256))
    h = lambda a, n: F.substring("h", a, n)
    made = (
        F.concat(F.lit("ghp_"), h(1, 36)), F.concat(F.lit("AKIA"), F.upper(h(1, 16))), F.concat(F.lit("sk-"), h(1, 24)), F.concat(F.lit("postgres://u:"), h(1, 6), F.lit("@db/x")), F.concat(F.lit("Bearer "), h(1, 20)),
        F.concat(F.lit("eyJ"), h(1, 8), F.lit("."), h(9, 8), F.lit("."), h(17, 8)), F.col("h"), F.concat(F.lit("npm_"), h(1, 36)),
    )
    secret = F.element_at(F.array(*made), (F.pmod("doc_id", F.lit(8)) + 1).cast("int"))
    r = redacted_plain(F.concat(F.lit("doc "), F.coalesce("text", F.lit("")), F.lit(" é"), secret))
    return d.select("doc_id", r.alias("r")).select("doc_id", F.sha2("r.text", 256).alias("sha256"), F.array_join(F.sort_array("r.reasons"), ",").alias("reasons"))


# --- graphs ---


def transcript_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as transcript lines: each conversation a session, each turn a line."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    stamp = F.date_format(F.timestamp_seconds(F.col("turn") * 10 + F.lit(1_700_000_000)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    common = lambda *more: F.to_json(F.struct(F.col("role").alias("type"), F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("sessionId"), stamp.alias("timestamp"), *more))
    tool = F.struct(F.lit("tool_use").alias("type"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("id"), F.lit("Bash").alias("name"), F.struct(F.concat(F.lit("wc "), F.char_length("text").cast("string")).alias("command")).alias("input"))
    said = F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))
    usage = F.struct(F.char_length("text").alias("input_tokens"), F.col("turn").alias("output_tokens"), F.lit(0).alias("cache_read_input_tokens"), F.lit(0).alias("cache_creation_input_tokens"))
    message = F.struct(F.concat(F.lit("m"), F.col("turn").cast("string")).alias("id"), F.lit("claude-haiku-4-5").alias("model"), usage.alias("usage"), F.array(F.to_variant_object(said), F.to_variant_object(tool)).alias("content"))
    line = F.when(F.col("role") == "assistant", common(message.alias("message"))).when(F.col("role") == "user", common(F.struct(F.lit("user").alias("role"), F.col("text").alias("content")).alias("message"))).otherwise(common())
    return c.select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit(".jsonl")).alias("path"), F.col("turn").cast("int").alias("line_no"), line.alias("value"))


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    obs = transcript.observations(transcript_lines(spark, sf_dir))
    return obs, reduce.nodes(obs), reduce.parents(obs)


def session_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of conversations by session and type."""
    _, nodes, _ = _graph(spark, sf_dir)
    return nodes.groupBy("run_id", "type").agg(F.count("*").alias("n"), F.coalesce(F.sum("tokens_in"), F.lit(0)).alias("tokens_in"), F.coalesce(F.sum("tokens_out"), F.lit(0)).alias("tokens_out"), F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 8).alias("cost_usd"))


def turn_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents of turns and tools: a turn's last prompt before it."""
    _, nodes, edges = _graph(spark, sf_dir)
    named = nodes.select("run_id", "id", "type", F.unix_seconds("t_start").alias("sec"))
    kids = edges.join(named.withColumnRenamed("id", "dst"), ["run_id", "dst"]).where("type IN ('assistant_turn', 'tool_call')")
    up = named.select("run_id", F.col("id").alias("src"), F.col("type").alias("parent_type"), F.col("sec").alias("parent_sec"))
    return kids.join(up, ["run_id", "src"]).select("run_id", "type", "sec", "parent_type", F.coalesce("parent_sec", F.lit(0).cast("long")).alias("parent_sec"))


def session_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs, _, _ = _graph(spark, sf_dir)
    return reduce.runs(obs).select("run_id", F.unix_seconds("started_at").alias("started"), F.unix_seconds("last_at").alias("ended"), "last_seq", F.coalesce("model", F.lit("")).alias("model"), F.array_join("session_ids", ",").alias("sessions"), "status")


_CONV = """
conv AS (SELECT 'c' || conv_id AS run_id, turn, role, coalesce(text, '') AS text, 1700000000 + turn * 10 AS sec FROM conversations),
pa AS (SELECT *, last_value(CASE WHEN role = 'user' AND text <> '' THEN sha256('x' || trim(text)) END IGNORE NULLS) OVER w AS prompt FROM conv WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY run_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
prompts AS (SELECT run_id, sha256('x' || trim(text)) AS h, min(sec) AS sec FROM conv WHERE role = 'user' AND text <> '' GROUP BY ALL)
"""


def step_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of events as calls that hang on their run's session."""
    e = table(spark, sf_dir, "events")
    nodes = e.select(F.col("user_id").cast("string").alias("run_id"), F.col("event_id").cast("string").alias("id"), F.lit("tool_call").alias("type"), F.col("event_type").alias("name"), F.lit(None).cast("string").alias("subagent_type"), F.col("ts").cast("timestamp").alias("t_start"), F.col("props").alias("input"))
    edges = nodes.select("run_id", F.concat(F.lit("session:"), "run_id").alias("src"), F.col("id").alias("dst"))
    return keys.step_keys(nodes, edges).select("run_id", "id", "path", "step_key", "path_key")


_KEYS = """
WITH n AS (SELECT user_id::VARCHAR AS run_id, event_id::VARCHAR AS id, ts, 'tool=' || event_type || ' in=' || substr(sha256('{"k":' || regexp_extract(props, '[0-9]+')::INT || '}'), 1, 16) AS content FROM events),
p AS (SELECT *, 'tool_call#' || (row_number() OVER (PARTITION BY run_id ORDER BY ts NULLS LAST, 'tool_call' || chr(31) || content, id) - 1) AS path FROM n)
SELECT run_id, id, path, substr(sha256('stepkey/v1|' || path || '|' || content), 1, 32) AS step_key, substr(sha256('stepkey/v1|path|' || path), 1, 32) AS path_key FROM p
"""


def phase_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of each run between the starts of its second and fourth phase."""
    nodes = gate_model(spark, sf_dir).nodes
    window = markers.range_window(nodes, ("p1", 0), ("p3", 0))
    kept, _ = markers.subgraph(nodes, nodes.select("run_id", F.col("id").alias("src"), F.col("id").alias("dst")), window)
    return kept.groupBy("run_id", "name").agg(F.count("*").alias("n"))


def graph_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events against the next user's."""
    e = events(spark, sf_dir)
    item = e.select(
        F.expr("user div 2").alias("pair"), "user", F.col("event_id").cast("string").alias("id"), F.lit("tool_call").alias("type"), F.col("event_type").alias("name"), F.lit("").alias("subagent_type"), F.concat_ws(":", "event_type", "k").alias("step_key"),
        F.concat_ws(":", "event_type", (F.col("k") % 7).cast("string")).alias("content"), F.lit("s").alias("path"), F.col("ts").alias("t_start"), F.col("k").cast("string").alias("args"), F.when(F.col("k") >= 95, "error").otherwise("ok").alias("status"),
        (F.col("value") / 1000).alias("cost_usd"), F.lit(0).cast("long").alias("duration_ms"), F.col("k").cast("long").alias("tokens_in"), F.lit(0).cast("long").alias("tokens_out"),
    )
    return rounded(diff.diff(item.where("user % 2 = 0").drop("user"), item.where("user % 2 = 1").drop("user")))


# --- tables, artifacts, samples ---


def table_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers against the same with balances moved by up to 0.00016, some within the tolerance and some beyond."""
    c = table(spark, sf_dir, "customer")
    moved = c.withColumn("c_acctbal", F.col("c_acctbal") + F.col("c_custkey") % 5 * 0.00004)
    return tables.unmatched(c, moved, c.columns).groupBy("side").agg(F.count("*").alias("n"))


def artifact_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").groupBy("source", "doc_id").agg(F.max("n_chars").alias("bytes"))
    return evidence.capture(d.select(F.coalesce("source", F.lit("")).alias("run_id"), F.col("doc_id").cast("string").alias("rel"), "bytes"), 5_000, 100_000).select("run_id", "rel", "kept")


def stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = gate_model(spark, sf_dir).runs.select("run_id")
    return evidence.stride_sample(runs, 7)


def score_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by step key onto nodes, for one run or all; the last line wins."""
    nodes = gate_model(spark, sf_dir).nodes
    some = nodes.where("step_key <> ''").select("run_id", "step_key").distinct()
    line = some.select(F.lit("judge.step").alias("key"), (F.col("run_id").cast("int") % 10).cast("double").alias("value"), "step_key", "run_id", F.lit("own").alias("path"), F.col("run_id").cast("int").alias("line_no"))
    every = some.select("step_key").distinct().select(F.lit("judge.all").alias("key"), F.lit(1.0).alias("value"), "step_key", F.lit(None).cast("string").alias("run_id"), F.lit("all").alias("path"), F.lit(1).alias("line_no"))
    return evidence.apply_scores(nodes, line.unionByName(every)).groupBy("run_id", "key").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def _redacted_sql(texts: str, passes: int = 3) -> str:
    """CTEs that end in cleared (doc_id, before, t, reasons) of a relation with doc_id and t: rule by rule, pass by pass."""
    blank = lambda m: f"'‹redacted:{m}›'"
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    rules = [("pem-private-key", f"CASE WHEN regexp_matches(t, {quoted(redact._PEM_BLOCK)}) THEN regexp_replace(t, {quoted(redact._PEM_BLOCK)}, {blank('pem-private-key')}, 'g') ELSE regexp_replace(t, {quoted(redact._PEM_MARKER)}, {blank('pem-private-key')}, 'g') END")]
    rules += [(reason, f"regexp_replace(t, {quoted(p)}, {quoted(chr(92) + '1') + ' || ' if p.startswith('(^') else ''}{blank(reason)}, 'g')") for reason, p in redact.VALUE_RULES]
    for p, bits in redact.ENTROPY_RULES:
        found, gaps = f"regexp_extract_all(t, {quoted(p)})", f"string_split_regex(t, {quoted(p)})"
        rules.append(("high-entropy", f"list_aggregate(list_transform(list_zip({gaps}, {found}), lambda z: z[1] || CASE WHEN z[2] IS NULL THEN '' WHEN list_aggregate(string_split(z[2], ''), 'entropy') < {bits} THEN z[2] ELSE {blank('high-entropy')} END), 'string_agg', '')"))
    ctes, last = [f"r0 AS (SELECT doc_id, t AS before, t, []::VARCHAR[] AS reasons FROM {texts})"], 0
    for _ in range(passes):
        for reason, new in rules:
            ctes.append(f"r{last + 1} AS (SELECT doc_id, before, n AS t, CASE WHEN n = t THEN reasons ELSE list_append(reasons, '{reason}') END AS reasons FROM (SELECT *, {new} AS n FROM r{last}))")
            last += 1
    ctes.append(f"cleared AS (SELECT doc_id, before, t, list_sort(list_distinct(reasons)) AS reasons FROM r{last})")
    return ", ".join(ctes)


_MADE = """CASE doc_id % 8 WHEN 0 THEN 'ghp_' || substr(h, 1, 36) WHEN 1 THEN 'AKIA' || upper(substr(h, 1, 16)) WHEN 2 THEN 'sk-' || substr(h, 1, 24) WHEN 3 THEN 'postgres://u:' || substr(h, 1, 6) || '@db/x' WHEN 4 THEN 'Bearer ' || substr(h, 1, 20)
  WHEN 5 THEN 'eyJ' || substr(h, 1, 8) || '.' || substr(h, 9, 8) || '.' || substr(h, 17, 8) WHEN 6 THEN h ELSE 'npm_' || substr(h, 1, 36) END"""
_PLAIN_DOCS = f"WITH made AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), {_redacted_sql('made')} SELECT doc_id, len(reasons)::INT AS n_findings, array_to_string(reasons, ',') AS reasons, sha256(CASE WHEN strlen(t) <= {redact.CAP_BYTES} THEN t ELSE '\"‹ref:' || strlen(t) || ',' || substr(sha256(t), 1, 16) || '›\"' END) AS sha256 FROM cleared"
_MADE_DOCS = f"WITH made AS (SELECT doc_id, 'doc ' || coalesce(text, '') || ' é' || {_MADE} AS t FROM (SELECT *, sha256(doc_id::VARCHAR) AS h FROM documents WHERE doc_id IS NOT NULL)), {_redacted_sql('made')} SELECT doc_id, sha256(t) AS sha256, array_to_string(reasons, ',') AS reasons FROM cleared"


def _v(select: str, *extra: str) -> str:
    return f"WITH {', '.join(x.strip() for x in (VIEWS, *extra))} {select}"


QUERIES = {f.__name__: f for f in (calibration_splits, calibration_drift, calibration_verdicts, calibration, sensitivity, pareto_front, record_numbers, ledger, judge_agreement, judge_unmatched, judge_gate, judge_panel, judge_vote, labels_parsed, token_costs, redaction, redaction_rules, session_nodes, turn_parents, session_runs, step_keys, phase_subgraph, graph_diff, table_compare, artifact_caps, stride_sample, score_join)}
ORACLE_SQL = {
    "calibration_splits": f"{_SF} SELECT own AS grp, dropped::INT AS dropped, metric, verdict, round(baseline, 6) AS baseline, round(candidate, 6) AS candidate FROM sf WHERE scope = 'total' AND NOT starts_with(metric, 'ann:')",
    "calibration_drift": f"{_DRIFT} SELECT grp, kind, scope, key, metric, verdict, round(baseline, 6) AS baseline, round(candidate, 6) AS candidate, detail FROM drift",
    "calibration_verdicts": f"{_DRIFT} SELECT grp, dropped::INT AS dropped, round(coverage, 6) AS coverage, verdict FROM sv JOIN (SELECT own AS grp, dropped, coverage FROM hcov) USING (grp, dropped)",
    "redaction": _PLAIN_DOCS,
    "redaction_rules": _MADE_DOCS,
    "calibration": _CALIBRATE,
    "sensitivity": _SENSITIVITY,
    "pareto_front": _PARETO,
    "record_numbers": "SELECT o_orderpriority AS baseline, o_orderkey AS record_id, epoch_us(o_orderdate) AS created_at, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey)::INT AS seq FROM orders",
    "ledger": "SELECT o_custkey AS run_id, max(o_orderkey) AS line_no, arg_max(o_orderstatus, o_orderkey) AS status, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY o_custkey",
    "judge_agreement": f"WITH {_JUDGED.strip()} SELECT * FROM ag",
    "judge_unmatched": f"WITH {_JUDGED.strip()} SELECT key, count(*) FILTER (WHERE value IS NULL) AS unmatched_labels, count(*) FILTER (WHERE label IS NULL) AS unmatched_scores FROM pr GROUP BY key",
    "judge_gate": f"WITH {_JUDGED.strip()} SELECT count(*) AS judges, count(*) FILTER (WHERE kappa IS NULL OR kappa < 0.2) AS failures, (count(*) = 0 OR count(*) FILTER (WHERE kappa IS NULL OR kappa < 0.2) > 0)::INT AS exit_code FROM ag",
    "judge_panel": f"WITH {_JUDGED.strip()} SELECT run_id, round(avg(value), 6) AS value, count(*) AS panel_size FROM sc GROUP BY run_id",
    "judge_vote": f"WITH {_JUDGED.strip()} SELECT run_id, (2 * count(*) FILTER (WHERE value >= 0.5) > count(*))::INT::DOUBLE AS value, count(*) AS panel_size FROM sc GROUP BY run_id",
    "labels_parsed": """WITH g AS (SELECT c_custkey, ' seg = ' || lower(c_mktsegment) || ',Bad Key=1,nation=' || c_nationkey || ',k' || c_custkey % 7 || '=' || c_custkey || ',novalue,k' || c_custkey % 3 || ' =  ' || lower(c_name) || ',Up' || c_custkey % 2 || '=x=y,seg=' || CASE WHEN c_custkey % 2 = 0 THEN 'again' ELSE '' END AS given FROM customer),
      p AS (SELECT c_custkey, i, trim(split_part(x, '=', 1)) AS k, trim(substr(x, strpos(x, '=') + 1)) AS v FROM (SELECT c_custkey, unnest(string_split(given, ',')) AS x, generate_subscripts(string_split(given, ','), 1) AS i FROM g) WHERE contains(x, '=')),
      l AS (SELECT c_custkey, k, arg_max(v, i) AS v FROM p WHERE regexp_full_match(k, '[a-z0-9_.-]{1,64}') AND strlen(v) <= 256 GROUP BY c_custkey, k)
      SELECT c_custkey, string_agg(k || '=' || v, ',' ORDER BY k) AS labels, bool_or(k = 'seg' AND v = 'again') AND NOT bool_or(k = 'absent' AND v <> '') AS matches FROM l GROUP BY c_custkey""",
    "token_costs": f"SELECT 'mcp_call' AS type, m, round(sum(c), 4) AS cost_usd, count(*) - count(c) AS unpriced FROM (SELECT l_suppkey % {len(_MODELS)} AS m, CASE l_suppkey % {len(_MODELS)} {_COSTS} END AS c FROM lineitem) GROUP BY m",
    "session_nodes": f"""WITH {_CONV.strip()}
        SELECT run_id, 'session' AS type, 1::BIGINT AS n, 0::BIGINT AS tokens_in, 0::BIGINT AS tokens_out, 0::DOUBLE AS cost_usd FROM (SELECT DISTINCT run_id FROM conv WHERE role = 'assistant' OR (role = 'user' AND text <> ''))
        UNION ALL SELECT run_id, 'user_prompt', count(*), 0, 0, 0 FROM prompts GROUP BY run_id
        UNION ALL SELECT run_id, 'tool_call', count(*), 0, 0, 0 FROM conv WHERE role = 'assistant' GROUP BY run_id
        UNION ALL SELECT run_id, 'assistant_turn', count(*), sum(length(text))::BIGINT, sum(turn)::BIGINT, round(sum(length(text) / 1e6 * 1.0 + turn / 1e6 * 5.0), 8) FROM conv WHERE role = 'assistant' GROUP BY run_id""",
    "turn_parents": f"""WITH {_CONV.strip()}
        SELECT pa.run_id, 'assistant_turn' AS type, pa.sec, CASE WHEN prompt IS NULL THEN 'session' ELSE 'user_prompt' END AS parent_type, coalesce(prompts.sec, 0) AS parent_sec FROM pa LEFT JOIN prompts ON prompts.run_id = pa.run_id AND prompts.h = pa.prompt WHERE role = 'assistant'
        UNION ALL SELECT run_id, 'tool_call', sec, 'assistant_turn', sec FROM conv WHERE role = 'assistant'""",
    "session_runs": f"""WITH {_CONV.strip()}
        SELECT run_id, min(sec) AS started, max(sec) AS ended, (count(*) FILTER (WHERE role = 'user') + 2 * count(*) FILTER (WHERE role = 'assistant'))::BIGINT AS last_seq, CASE WHEN bool_or(role = 'assistant') THEN 'claude-haiku-4-5' ELSE '' END AS model, run_id AS sessions, 'running' AS status FROM conv WHERE role = 'assistant' OR (role = 'user' AND text <> '') GROUP BY run_id""",
    "step_keys": _KEYS,
    "phase_subgraph": _v("SELECT n.run_id, n.name, count(*) AS n FROM node n JOIN node a ON a.run_id = n.run_id AND a.id = 'm1' JOIN node b ON b.run_id = n.run_id AND b.id = 'm3' WHERE n.type <> 'marker' AND n.t_start >= a.t_start AND n.t_start < b.t_start GROUP BY ALL"),
    "table_compare": "SELECT side, count(*) AS n FROM customer a JOIN (SELECT c_custkey, c_acctbal + c_custkey % 5 * 0.00004::DOUBLE AS moved FROM customer) b USING (c_custkey), (SELECT unnest(['got', 'want']) AS side) WHERE abs(c_acctbal - moved) > 1e-4 GROUP BY side",
    "artifact_caps": "SELECT run_id, rel, bytes <= 5000 AND sum(CASE WHEN bytes <= 5000 THEN bytes ELSE 0 END) OVER (PARTITION BY run_id ORDER BY rel) <= 100000 AS kept FROM (SELECT coalesce(source, '') AS run_id, doc_id::VARCHAR AS rel, max(n_chars) AS bytes FROM documents WHERE doc_id IS NOT NULL GROUP BY ALL)",
    "stride_sample": "WITH r AS (SELECT run_id, row_number() OVER (ORDER BY run_id) - 1 AS i, count(*) OVER () AS k FROM (SELECT DISTINCT user_id::VARCHAR AS run_id FROM events)) SELECT run_id FROM r WHERE k <= 7 OR i IN (SELECT (j * k) // 7 FROM range(7) t(j))",
    "score_join": _v("SELECT run_id, 'judge.step' AS key, count(*) AS n, sum((run_id::INT % 10)::DOUBLE) AS value FROM node WHERE step_key <> '' GROUP BY run_id UNION ALL SELECT run_id, 'judge.all', count(*), count(*)::DOUBLE FROM node WHERE step_key <> '' GROUP BY run_id"),
}
