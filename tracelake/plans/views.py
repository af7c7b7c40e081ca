"""The test tables as the data model: users of ``events`` are runs, their events nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.operators.markers import spans
from tracelake.plans.model import OUTCOME, Model


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select(F.col("user_id").cast("string").alias("run_id"), F.col("user_id").alias("user"), "event_id", "event_type", "value", k.alias("k"), F.col("ts").cast("timestamp").alias("ts"), micros.alias("us"))


def runs(e: DataFrame) -> DataFrame:
    return e.groupBy("run_id", "user").agg(F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count_if(F.col("k") >= 50).alias("high"), F.sum("k").alias("k_sum"), F.count("*").alias("n")).select(
        "run_id", F.when(F.col("user") % 2 == 0, "baseline").otherwise("candidate").alias("grp"), F.concat(F.lit("t"), (F.expr("user div 2") % 7).cast("string")).alias("task"), "started_at", "ended_at", F.lit("running").alias("status"), "start_us", "end_us", "high", "k_sum", "n"
    )


def tool_nodes(e: DataFrame) -> DataFrame:
    following = F.lead("us").over(Window.partitionBy("run_id").orderBy("us", "event_id"))
    return e.select(
        "run_id", F.col("event_id").cast("string").alias("id"), F.when(F.col("event_type") == "view", "assistant_turn").otherwise("tool_call").alias("type"), F.col("event_type").alias("name"),
        F.when(F.col("k") >= 95, "error").otherwise("ok").alias("status"), F.substring(F.sha2(F.concat_ws(":", F.lit("v1"), "event_type", (F.col("event_id") % 4).cast("string")), 256), 1, 32).alias("step_key"), F.lit("").alias("phase_key"),
        F.col("ts").alias("t_start"), F.lit(None).cast("timestamp").alias("t_end"), F.floor((following - F.col("us")) / 1000).cast("bigint").alias("duration_ms"),
        (F.col("value") / 1000).alias("cost_usd"), F.col("k").cast("bigint").alias("tokens_in"), (F.col("event_id") % 100).alias("tokens_out"),
    )


def marker_nodes(r: DataFrame) -> DataFrame:
    """Four phases of each run by quarters of its time; the last is still open."""
    at = lambda q: F.timestamp_micros(F.expr(f"start_us + ((end_us - start_us) * ({q})) div 4"))
    q = r.withColumn("q", F.explode(F.array(*[F.lit(k) for k in range(4)])))
    key = F.substring(F.sha2(F.concat(F.lit("phasekey/v1||p"), F.col("q").cast("string"), F.lit("|0")), 256), 1, 32)
    none = F.lit(None)
    return q.select(
        "run_id", F.concat(F.lit("m"), F.col("q").cast("string")).alias("id"), F.lit("marker").alias("type"), F.concat(F.lit("p"), F.col("q").cast("string")).alias("name"), F.when(F.col("q") < 3, "ok").otherwise("running").alias("status"), F.lit("").alias("step_key"), key.alias("phase_key"),
        at("q").alias("t_start"), F.when(F.col("q") < 3, at("q + 1")).alias("t_end"), none.cast("bigint").alias("duration_ms"), none.cast("double").alias("cost_usd"), none.cast("bigint").alias("tokens_in"), none.cast("bigint").alias("tokens_out"),
    )


def step_annotations(e: DataFrame) -> DataFrame:
    """Annotations of tool nodes as VARIANT: numbers, texts, booleans and nulls in turn; ``judge.rare`` on candidate runs only."""
    k = F.col("k").cast("string")
    json = F.when(F.col("event_id") % 5 == 0, k).when(F.col("event_id") % 5 == 1, F.concat(F.lit('"'), k, F.lit('"'))).when(F.col("event_id") % 5 == 2, "true").when(F.col("event_id") % 5 == 3, "null").otherwise(F.concat(k, F.lit(".25")))
    both = F.array(F.struct(F.lit("judge.step").alias("key"), json.alias("json")), F.struct(F.lit("judge.rare").alias("key"), F.when((F.col("user") % 2 == 1) & (F.col("event_id") % 3 == 0), k).alias("json")))
    each = e.select("run_id", F.col("event_id").cast("string").alias("id"), F.explode(both).alias("x")).where("x.json IS NOT NULL")
    return each.select("run_id", "id", F.col("x.key").alias("key"), F.parse_json("x.json").alias("value"))


def gate_model(spark: SparkSession, sf_dir: str) -> Model:
    e = events(spark, sf_dir)
    r = runs(e)
    nodes = tool_nodes(e).unionByName(marker_nodes(r))
    annotations = r.select("run_id", F.explode(F.array(F.struct(F.lit(OUTCOME).alias("key"), F.when(2 * F.col("high") > F.col("n"), 1.0).otherwise(0.0).alias("value")), F.struct(F.lit("judge.score").alias("key"), (F.col("k_sum") / F.col("n")).alias("value")))).alias("a")).select("run_id", "a.*")
    return Model(r.select("run_id", "grp", "task", "started_at", "ended_at", "status"), nodes, annotations, spans(nodes), step_annotations(e))


#: The same relations in DuckDB's SQL: ev, run, node, ann, span, and the folds on them.
VIEWS = """
ev AS (SELECT user_id::VARCHAR AS run_id, user_id AS usr, event_id, event_type, value, regexp_extract(props, '[0-9]+')::INT AS k, epoch_us(ts) AS us FROM events),
runx AS (SELECT run_id, CASE WHEN usr % 2 = 0 THEN 'baseline' ELSE 'candidate' END AS grp, 't' || ((usr // 2) % 7)::VARCHAR AS task, min(us) AS start_us, max(us) AS end_us, count(*) FILTER (WHERE k >= 50) AS high, sum(k) AS k_sum, count(*) AS n FROM ev GROUP BY run_id, usr),
node AS (
  SELECT run_id, event_id::VARCHAR AS id, CASE WHEN event_type = 'view' THEN 'assistant_turn' ELSE 'tool_call' END AS type, event_type AS name, CASE WHEN k >= 95 THEN 'error' ELSE 'ok' END AS status,
    substr(sha256('v1:' || event_type || ':' || (event_id % 4)::VARCHAR), 1, 32) AS step_key, '' AS phase_key, us AS t_start, NULL::BIGINT AS t_end,
    floor((lead(us) OVER (PARTITION BY run_id ORDER BY us, event_id) - us) / 1000.0)::BIGINT AS duration_ms, value / 1000 AS cost_usd, k::BIGINT AS tokens_in, event_id % 100 AS tokens_out FROM ev
  UNION ALL
  SELECT run_id, 'm' || q::VARCHAR, 'marker', 'p' || q::VARCHAR, CASE WHEN q < 3 THEN 'ok' ELSE 'running' END, '', substr(sha256('phasekey/v1||p' || q::VARCHAR || '|0'), 1, 32),
    start_us + ((end_us - start_us) * q) // 4, CASE WHEN q < 3 THEN start_us + ((end_us - start_us) * (q + 1)) // 4 END, NULL, NULL, NULL, NULL FROM runx, (SELECT unnest([0, 1, 2, 3]) AS q)),
ann AS (SELECT run_id, 'verifier.pass' AS key, CASE WHEN 2 * high > n THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value FROM runx UNION ALL SELECT run_id, 'judge.score', k_sum::DOUBLE / n FROM runx),
nann AS (SELECT run_id, event_id::VARCHAR AS id, 'judge.step' AS key, CASE event_id % 5 WHEN 0 THEN k::DOUBLE WHEN 3 THEN 0 WHEN 4 THEN k + 0.25 END AS value FROM ev UNION ALL SELECT run_id, event_id::VARCHAR, 'judge.rare', k FROM ev WHERE usr % 2 = 1 AND event_id % 3 = 0),
span AS (SELECT m.run_id, m.id AS src, n.id AS dst FROM node m JOIN node n ON m.run_id = n.run_id AND m.type = 'marker' AND n.type <> 'marker' AND n.t_start >= m.t_start AND (m.t_end IS NULL OR n.t_start < m.t_end)),
cell AS (SELECT r.run_id, grp, task, ((end_us - start_us) // 1000)::DOUBLE AS duration_ms, s.* EXCLUDE (run_id), s.node_error = 1 AS has_error FROM runx r JOIN (
  SELECT run_id, sum(coalesce(cost_usd, 0)) AS cost_usd, sum(coalesce(tokens_in, 0))::DOUBLE AS tokens_in, sum(coalesce(tokens_out, 0))::DOUBLE AS tokens_out, count(*)::DOUBLE AS nodes, (count(*) FILTER (WHERE type = 'assistant_turn'))::DOUBLE AS turns, max((status = 'error')::INT) AS node_error FROM node GROUP BY run_id) s USING (run_id))
"""
