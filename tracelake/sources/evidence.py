"""Evidence of runs on disk: run documents, score lines, and what is written back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.operators.numbering import numbered

META = (
    "run_id string, task string, variant string, rep int, session_id string, labels map<string,string>, exit_code int, cost_usd double, basket_hash string, marker_name string, marker_start timestamp, marker_end timestamp, "
    "finished_at timestamp, artifacts array<struct<rel:string,sha256:string,bytes:bigint>>, artifacts_note string, env struct<model_id:string,agent_runtime:string,agent_version:string,resources:struct<os:string,arch:string,cpus:int>,workspace:struct<rev:string,patch_sha256:string>>"
)
SCORE = "key string, value double, step_key string, run_id string, tool string"
KEY = r"^[^.\s]+\.[^.\s]+$"


def scan_runs(spark: SparkSession, root: str) -> DataFrame:
    """A row for each run folder with a readable ``meta.json``; others are left out."""
    found = spark.read.schema(META).option("multiLine", True).option("mode", "DROPMALFORMED").json(f"{root}/*/meta.json")
    return found.where("run_id <> ''").withColumn("dir", F.regexp_extract(F.col("_metadata.file_path"), "^(.*)/[^/]*$", 1))


def scores(spark: SparkSession, paths: str | list[str], **options: str) -> DataFrame:
    """Score lines with their file and line number; fails on a line without a valid key or value."""
    files = spark.read.options(**options).text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    lines = files.select("path", F.posexplode(F.split("value", "\n")).alias("line_no", "line")).where("trim(line) <> ''")
    s = lines.withColumn("s", F.from_json("line", SCORE))
    good = F.col("s.key").rlike(KEY) & F.col("s.value").isNotNull()
    where = F.concat(F.col("path"), F.lit(":"), (F.col("line_no") + 1).cast("string"), F.lit(": not a score line"))
    return s.select("path", "line_no", F.when(F.coalesce(good, F.lit(False)), F.col("s")).otherwise(F.raise_error(where)).alias("s")).select("path", "line_no", "s.*")


def _latest(found: DataFrame) -> Column:
    """Which of two score lines wins: the one of higher ``rank`` (0 where there is none), then the later one."""
    return F.struct(F.col("rank") if "rank" in found.columns else F.lit(0), F.col("path"), F.col("line_no"))


def apply_scores(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """Node annotations (run_id, id, key, value, lines) of scores with a step key; a score without a run goes to all runs. The last line of a key wins."""
    steps = nodes.where("step_key <> ''").select("run_id", "id", "step_key")
    lines = found.where("step_key <> ''").withColumn("at", _latest(found)).select("run_id", "step_key", "key", "value", "at")
    own = lines.where("run_id <> ''").join(steps, ["run_id", "step_key"])
    every = lines.where("run_id IS NULL OR run_id = ''").drop("run_id").join(steps, "step_key")
    both = own.select("run_id", "id", "key", "value", "at").unionByName(every.select("run_id", "id", "key", "value", "at"))
    return both.groupBy("run_id", "id", "key").agg(F.max_by("value", "at").alias("value"), F.count("*").alias("lines"))


def run_scores(found: DataFrame) -> DataFrame:
    """Run annotations (run_id, key, value) of scores without a step key; those need a run. The last line wins."""
    lines = found.where("coalesce(step_key, '') = ''").withColumn("run_id", F.when(F.col("run_id") != "", F.col("run_id")).otherwise(F.raise_error(F.lit("a score of a run needs run_id"))))
    return lines.groupBy("run_id", "key").agg(F.max_by("value", _latest(found)).alias("value"))


def score_counts(nodes: DataFrame, runs: DataFrame, found: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """One row: how many values score lines set (``applied``), lines that match nothing (``unmatched``), and values set that were there
    already (``overridden``): by an earlier line, or by ``before`` (run_id, id or null for the run, key)."""
    lines = found.withColumn("at", _latest(found)).withColumn("line", F.struct("path", "line_no"))
    steps = nodes.where("step_key <> ''").select("run_id", "id", "step_key")
    of = lines.where("step_key <> ''").select("line", "at", "key", "run_id", "step_key")
    own = of.where("run_id <> ''").join(steps, ["run_id", "step_key"]).select("line", "at", "run_id", "id", "key")
    every = of.where("coalesce(run_id, '') = ''").drop("run_id").join(steps, "step_key").select("line", "at", "run_id", "id", "key")
    whole = lines.where("coalesce(step_key, '') = ''").join(runs.select("run_id"), "run_id").select("line", "at", "run_id", F.lit(None).cast("string").alias("id"), "key")
    hits = own.unionByName(every).unionByName(whole)
    values = hits.groupBy("run_id", "id", "key").agg(F.count("*").alias("n"))
    if before is not None:
        there = before.select(F.col("run_id").alias("r"), F.col("id").alias("i"), F.col("key").alias("k")).distinct().withColumn("there", F.lit(1))
        values = values.join(there, (F.col("run_id") == F.col("r")) & F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")), "left")
    else:
        values = values.withColumn("there", F.lit(None).cast("int"))
    sums = values.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("applied"), F.coalesce(F.sum(F.col("n") - 1 + F.coalesce("there", F.lit(0))), F.lit(0)).alias("overridden"))
    missed = lines.join(hits.select("line").distinct(), "line", "left_anti").agg(F.count("*").alias("unmatched"))
    return sums.crossJoin(missed).select("applied", "unmatched", "overridden")  # a row each


def resolve(files: DataFrame, sessions: DataFrame) -> DataFrame:
    """The transcripts of sessions among ``files`` (path), of projects ``<project>/<session>.jsonl`` and
    ``<project>/<session>/subagents/agent-*.jsonl``: session_id, main, subagents in order. Fails on a session without a main one, or with several."""
    wanted = sessions.select("session_id").distinct()
    mains = files.select("path", F.regexp_extract("path", r"[^/]+/([^/]+)\.jsonl$", 1).alias("session_id")).where("session_id <> '' AND path NOT LIKE '%/subagents/%'")
    subs = files.select("path", F.regexp_extract("path", r"[^/]+/([^/]+)/subagents/agent-[^/]*\.jsonl$", 1).alias("session_id")).where("session_id <> ''")
    counted = wanted.join(mains.groupBy("session_id").agg(F.count("*").alias("n"), F.min("path").alias("main")), "session_id", "left")
    bad = F.when(F.col("n").isNull(), F.concat(F.lit("no transcript for session "), "session_id")).when(F.col("n") > 1, F.concat(F.lit("ambiguous session "), "session_id", F.lit(": "), F.col("n").cast("string"), F.lit(" matches")))
    main = F.when(bad.isNotNull(), F.raise_error(bad).cast("string")).otherwise(F.col("main"))
    below = subs.groupBy("session_id").agg(F.sort_array(F.collect_list("path")).alias("subagents"))
    return counted.select("session_id", main.alias("main")).join(below, "session_id", "left").withColumn("subagents", F.coalesce("subagents", F.array().cast("array<string>")))


def group_by_ids(runs: DataFrame, ids: list[str]) -> DataFrame:
    """The named runs; fails if one is missing."""
    wanted = runs.sparkSession.createDataFrame([(i,) for i in ids], "run_id string")
    found = wanted.join(runs.withColumn("__there", F.lit(True)), "run_id", "left")
    return found.withColumn("run_id", F.when(F.col("__there"), F.col("run_id")).otherwise(F.raise_error(F.concat(F.lit("no run "), "run_id")))).drop("__there")


def last_of_ledger(entries: DataFrame) -> DataFrame:
    """A ledger's last line for each run. ``entries``: run_id, line_no and more."""
    rest = [c for c in entries.columns if c != "run_id"]
    return entries.groupBy("run_id").agg(F.max_by(F.struct(*rest), "line_no").alias("x")).select("run_id", "x.*")


def export_graph(nodes: DataFrame, edges: DataFrame, runs: DataFrame, path: str) -> None:
    """Nodes, edges and runs as JSON lines with their ``kind``, in that order and by id, without secrets: the files' names keep the order."""
    from tracelake.operators import redaction

    def lines(df: DataFrame, kind: str, no: int, *order: str) -> DataFrame:
        key = F.concat_ws("\x00", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in order])
        return df.select(F.lit(no).alias("no"), key.alias("key"), F.to_json(F.struct(F.lit(kind).alias("kind"), *df.columns)).alias("value"))

    every = lines(redaction.nodes(nodes), "node", 0, "run_id", "id").unionByName(lines(edges, "edge", 1, "run_id", "src", "dst")).unionByName(lines(redaction.runs(runs), "run", 2, "run_id"))
    every.repartitionByRange("no", "key").sortWithinPartitions("no", "key").select("value").write.mode("overwrite").text(path)


def read_graph(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    """Rows of one kind of an exported graph."""
    rows = spark.read.text(path)
    return rows.where(F.get_json_object("value", "$.kind") == kind).select(F.from_json("value", schema).alias("x")).select("x.*")


def write_evidence(lines: DataFrame, path: str) -> None:
    """Redacted transcript lines (run_id, file, line_no, value), a folder a run; each run written replaces what it had."""
    from tracelake.functions.redact import redacted

    clean = lines.withColumn("value", redacted(F.col("value"))["text"])
    clean.repartition("run_id").sortWithinPartitions("run_id", "file", "line_no").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def capture(files: DataFrame, each: int = 10 << 20, total: int = 50 << 20) -> DataFrame:
    """Which of a run's artifacts are kept: (run_id, rel, bytes, sha256, kept), by path, within caps for a file and a run."""
    fits = F.when(F.col("bytes") <= each, F.col("bytes")).otherwise(0)
    upto = numbered(files.withColumn("__fits", fits), ["run_id"], ["rel"], "__upto", "__fits")
    return upto.withColumn("kept", (F.col("bytes") <= each) & (F.col("__upto") <= total)).drop("__fits", "__upto")


def cells(spark: SparkSession, tasks: list[str], variants: list[str], reps: int) -> DataFrame:
    """Every task, variant and repetition, with the run's name, in the order of repetition, task and variant."""
    of = lambda xs, k: spark.createDataFrame([(i, x) for i, x in enumerate(xs)], f"{k}_no int, {k} string")
    out = spark.range(1, reps + 1).select(F.col("id").alias("rep")).crossJoin(of(tasks, "task")).crossJoin(of(variants, "variant"))  # a declared experiment
    return out.orderBy("rep", "task_no", "variant_no").select("task", "variant", "rep", F.concat_ws("-", "task", "variant", F.col("rep").cast("string")).alias("run_id"))


def stride_sample(runs: DataFrame, n: int) -> DataFrame:
    """n runs at even strides by id: the rows of index i * count / n, i from 0; all, if there are no more than n."""
    count = runs.count()
    if count <= n:
        return runs
    wanted = runs.sparkSession.range(n).select(F.expr(f"bigint(id) * {count}L div {n}L + 1").alias("__number"))
    picked = numbered(runs.select("run_id"), [], ["run_id"], "__number").join(F.broadcast(wanted), "__number", "left_semi")  # n rows
    return runs.join(picked.select("run_id"), "run_id", "left_semi")
