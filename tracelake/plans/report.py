"""Findings as lines of text, Markdown or JSON, in report order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.operators import compare as cmp
from tracelake.operators.numbering import numbered

TITLES = ("VERDICT", "SCOPE", "KEY", "NAME", "METRIC", "BASELINE", "CANDIDATE", "BAND", "DETAIL")


def _number(c: Column) -> Column:
    return F.format_string("%.2f", c)


def cells(findings: DataFrame) -> DataFrame:
    """Findings with the texts that reports show, a column a title: two decimals, dashes for nothing, presence as shares of runs that have it."""
    dash = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("-"))
    there = F.col("metric") == "presence"
    value = lambda c: _number(F.when(there, 1 - F.col(c)).otherwise(F.col(c)))
    lo, hi = F.when(there, 1 - F.col("band_hi")).otherwise(F.col("band_lo")), F.when(there, 1 - F.col("band_lo")).otherwise(F.col("band_hi"))
    band = F.when((F.col("band_lo") == 0) & (F.col("band_hi") == 0), "-").otherwise(F.concat(F.lit("["), _number(lo), F.lit(", "), _number(hi), F.lit("]")))
    shown = (F.col("verdict"), F.col("scope"), dash(F.col("key")), dash(F.col("name")), F.col("metric"), value("baseline"), value("candidate"), band, dash(F.col("detail")))
    return findings.select(*[c.alias(t) for t, c in zip(TITLES, shown, strict=True)], cmp.scope_rank().alias("__rank"), F.col("key").alias("__key"), F.col("metric").alias("__metric"))


def _placed(shown: DataFrame) -> DataFrame:
    return numbered(shown, [], ["__rank", "__key", "__metric", *TITLES], "no")


def text(findings: DataFrame) -> DataFrame:
    """(no, line): a head line numbered 0, then the findings, in columns two blanks apart."""
    shown = cells(findings)
    widths = shown.agg(*[F.greatest(F.coalesce(F.max(F.char_length(t)), F.lit(0)), F.lit(len(t))).alias(f"w_{t}") for t in TITLES])
    padded = F.concat(*[F.rpad(F.col(t), F.col(f"w_{t}") + 2, " ") for t in TITLES[:-1]], F.col(TITLES[-1]))
    head = widths.select(F.lit(0).cast("long").alias("no"), F.concat(*[F.rpad(F.lit(t), F.col(f"w_{t}") + 2, " ") for t in TITLES[:-1]], F.lit(TITLES[-1])).alias("line"))
    return head.unionByName(_placed(shown).crossJoin(F.broadcast(widths)).select("no", padded.alias("line")))  # one row


def markdown(findings: DataFrame) -> DataFrame:
    """(no, line): the rows of a table."""
    bar = lambda c: F.replace(F.col(c), F.lit("|"), F.lit("\\|"))
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *[bar(t) if t in ("KEY", "NAME", "METRIC", "DETAIL") else F.col(t) for t in TITLES]), F.lit(" |"))
    head = findings.sparkSession.createDataFrame([(-1, "| " + " | ".join(t.capitalize() for t in TITLES) + " |"), (0, "|" + "---|" * len(TITLES))], "no bigint, line string")
    return head.unionByName(_placed(cells(findings)).select("no", row.alias("line")))


def json(findings: DataFrame) -> DataFrame:
    """(no, line): an object a finding, empty texts and bands left out."""
    rank = cmp.scope_rank().alias("__rank")
    placed = numbered(findings.select("*", rank), [], ["__rank", "key", "metric", "name", "verdict"], "no")
    some = lambda c: F.nullif(F.col(c), F.lit("")).alias(c)
    edge = lambda c: F.nullif(F.col(c), F.lit(0.0)).alias(c)
    return placed.select("no", F.to_json(F.struct("scope", some("key"), some("name"), "metric", "verdict", "baseline", "candidate", "delta", edge("band_lo"), edge("band_hi"), some("detail"))).alias("line"))
