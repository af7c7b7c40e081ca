"""From evidence folders to the gate: transcripts, boundaries and scores of runs become a model, two groups of runs a verdict.

A run's folder holds ``meta.json``, ``session.jsonl``, ``subagents/agent-*.jsonl`` and ``scores.jsonl``; all but
the first may be missing. Folders without a readable ``meta.json`` are left out, as are runs of neither group. The
run's recorded runtime says how its transcripts are read, and secrets are gone before anything is written. ``load`` reads the folders; ``assemble`` takes their
lines as DataFrames, from wherever they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.pricing import Prices
from tracelake.functions.text import MARK_SERVER, match_labels, parse_selector
from tracelake.operators import keys, markers, redaction, reduce
from tracelake.plans import gate
from tracelake.plans.model import NODE_COLUMNS, Model
from tracelake.plans.thresholds import DEFAULT, Thresholds
from tracelake.sources import evidence, rollout, transcript
from tracelake.sources.shared import cut

_FOLDER = r"([^/]+)/(?:session|subagents/agent-[^/]+)\.jsonl$"
#: A boundary comes after whatever a transcript says at the same time.
_AFTER_ALL = 1 << 60
# Names of runtimes in run documents; a document without one is of the first.
MAIN_RUNTIME, ROLLOUT_RUNTIME = "claude-code", "codex"


def selected(selector: str) -> Column:
    """Whether a run is one of ``label:k=v,...``, by its labels."""
    kind, wanted = parse_selector(selector)
    if kind != "label":
        raise ValueError(f"{selector!r} names no labels of runs")
    return match_labels(F.coalesce("labels", F.create_map().cast("map<string,string>")), wanted)


def grouped(runs: DataFrame, baseline: str, candidate: str) -> DataFrame:
    """The runs of either group with ``grp`` and ``folder``; a run that both selectors name counts for each.

    Fails where two folders have the same run id: their facts couldn't be told apart.
    """
    each = [runs.where(selected(s)).withColumn("grp", F.lit(g)) for g, s in (("baseline", baseline), ("candidate", candidate))]
    both = each[0].unionByName(each[1]).withColumn("folder", F.element_at(F.split("dir", "/"), -1))
    folders = both.groupBy("run_id").agg(F.min("folder").alias("__a"), F.max("folder").alias("__z"))
    twice = F.col("__a") != F.col("__z")
    said = F.concat(F.lit("run "), "run_id", F.lit(" has two folders: "), "__a", F.lit(", "), "__z")
    return both.join(folders, "run_id").withColumn("folder", F.when(twice, F.raise_error(said).cast("string")).otherwise(F.col("folder"))).drop("__a", "__z")


def described(runs: DataFrame) -> DataFrame:
    """What reading a run needs of its document, a row a run: run_id, folder, runtime and the marker's name and window. Fails on an unknown runtime."""
    runtime = F.coalesce(F.nullif("env.agent_runtime", F.lit("")), F.lit(MAIN_RUNTIME))
    known = F.when(runtime.isin(MAIN_RUNTIME, ROLLOUT_RUNTIME), runtime).otherwise(F.raise_error(F.concat(F.lit("run "), "run_id", F.lit(" has the unknown runtime "), runtime)).cast("string"))
    return runs.dropDuplicates(["run_id"]).select("run_id", "folder", known.alias("runtime"), "marker_name", "marker_start", "marker_end")


def observed(raw: DataFrame, meta: DataFrame) -> DataFrame:
    """Observations by run id of transcript lines (path, line_no, value) of the runs in ``meta`` (as ``described``)."""
    folder = F.regexp_extract("path", _FOLDER, 1)
    named = meta.select("folder", F.col("run_id").alias("named"), "runtime")
    lines = cut(raw.where(folder != "").withColumn("folder", folder).join(named, "folder").select("path", "line_no", "value", "runtime"))
    both = [read(lines.where(F.col("runtime") == runtime).drop("runtime"), folder) for read, runtime in ((transcript.observations, MAIN_RUNTIME), (rollout.observations, ROLLOUT_RUNTIME))]
    obs = both[0].unionByName(both[1].select(*[c for c in both[1].columns if c in both[0].columns]), allowMissingColumns=True)
    obs = obs.join(named.select("folder", "named"), obs["run_id"] == named["folder"]).drop("folder", "run_id").withColumnRenamed("named", "run_id")
    windows = meta.where("marker_name <> '' AND marker_start IS NOT NULL AND marker_end IS NOT NULL").select("run_id", F.col("marker_name").alias("name"), F.col("marker_start").alias("start"), F.col("marker_end").alias("end"))
    bounds = transcript.boundary(windows).withColumn("seq", F.when(F.col("boundary") == "start", _AFTER_ALL).otherwise(_AFTER_ALL + 1))
    return obs.unionByName(bounds, allowMissingColumns=True)


def graph(obs: DataFrame, prices: Prices | None = None, server: str = MARK_SERVER) -> tuple[DataFrame, DataFrame]:
    """Nodes with their keys, markers included, and edges: parents and the members of phases."""
    plain, parents = cut(reduce.nodes(obs, prices)), cut(reduce.parents(obs))
    keyed = cut(keys.step_keys(plain, parents).select("run_id", "id", "type", "agent_id", "step_key"))
    steps = keyed.where("type = 'subagent' AND agent_id IS NOT NULL").select("run_id", "agent_id", "step_key")
    marks = reduce.marker_nodes(reduce.phases(reduce.marker_bounds(obs, server)), steps)
    nodes = plain.join(keyed.select("run_id", "id", "step_key"), ["run_id", "id"], "left").unionByName(marks, allowMissingColumns=True)
    nodes = cut(nodes.drop("sources"))
    return nodes, parents.drop("rev").unionByName(markers.spans(nodes))


def assemble(runs: DataFrame, raw: DataFrame, scores: DataFrame, more: DataFrame | None = None, prices: Prices | None = None, server: str = MARK_SERVER) -> Model:
    """The model of grouped runs (columns of a run document, ``grp``, ``folder``), their transcript lines (path, line_no,
    value) and score lines (folder, path, line_no, key, value, step_key, run_id).

    A run lasts from its marker's start to its end (unknown without); it is an error if its exit code isn't 0. A
    score line is its run's own if it names no other run: with a step key it annotates the run's nodes of that
    step, without one the run. ``more`` are score lines of all runs from elsewhere (path, line_no, key, value,
    step_key, run_id), which win over the runs' own.
    """
    runs = cut(runs)
    meta = cut(described(runs))
    obs = cut(redaction.observations(observed(raw, meta)))
    nodes, _ = graph(obs, prices, server)
    status = F.when(F.col("exit_code") != 0, "error").otherwise("running")
    rows = runs.select("run_id", "grp", "task", F.col("marker_start").alias("started_at"), F.col("marker_end").alias("ended_at"), status.alias("status"))
    found = scores.withColumnRenamed("run_id", "given").join(meta.select("folder", "run_id"), "folder")
    lines = found.where("coalesce(given, '') IN ('', run_id)").select("run_id", "step_key", "key", "value", "path", "line_no", F.lit(0).alias("rank"))
    if more is not None:
        lines = lines.unionByName(more.select("run_id", "step_key", "key", "value", "path", "line_no", F.lit(1).alias("rank")))
    lines = cut(lines)
    model_nodes = nodes.select(*[F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in NODE_COLUMNS.split(", ")])
    of_nodes = evidence.apply_scores(model_nodes, lines).select("run_id", "id", "key", F.col("value").cast("variant").alias("value"))
    of_runs = evidence.run_scores(lines).join(meta.select("run_id"), "run_id", "left_semi")
    return Model(rows, model_nodes, cut(of_runs), cut(markers.spans(nodes)), cut(of_nodes))


def load(spark: SparkSession, root: str, baseline: str, candidate: str, scores: str | None = None, prices: Prices | None = None, server: str = MARK_SERVER) -> Model:
    """The model of two groups of runs under ``root``, with the score lines of the file ``scores`` over the folders' own."""
    runs = grouped(evidence.scan_runs(spark, root), baseline, candidate)
    raw = transcript.lines(spark, root, recursiveFileLookup="true", pathGlobFilter="*.jsonl")
    own = evidence.scores(spark, root, recursiveFileLookup="true", pathGlobFilter="scores.jsonl").withColumn("folder", F.element_at(F.split("path", "/"), -2))
    return assemble(runs, raw, own, evidence.scores(spark, scores) if scores else None, prices, server)


def regress(spark: SparkSession, root: str, baseline: str, candidate: str, th: Thresholds = DEFAULT, specs: dict[str, bool] | None = None, scores: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Findings and verdict of the candidate runs against the baseline runs of one evidence folder."""
    return gate.regress(load(spark, root, baseline, candidate, scores), th, specs)
