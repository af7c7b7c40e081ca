"""Secrets out of whole rows: observations, nodes, edges' ends and runs, before anything is stored or exported.

Payload sides are cleared, written without white space between their parts and cut to a reference where they
are too long; their hash is of the whole cleared sides. Attributes are cleared as texts, but for checksums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.redact import CAP_BYTES, capped, redacted_json, redacted_plain, ways

#: Columns of observations and nodes that are payload sides, and texts among their attributes.
PAYLOAD = ("input", "output")
ATTRIBUTES = ("name", "model", "subagent_type", "version", "cwd", "state_ref")
_HEX_DIGEST = "^(?:[0-9a-f]{40}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})$"
_REFERENCE = '^"‹(?:ref|binary):[0-9]+,[0-9a-f]{16}›"$'


def compact(json: Column) -> Column:
    """JSON without white space between its parts; other text as it is."""
    tight = F.regexp_replace(json, r'("(?:[^"\\]|\\.)*+")|[ \t\r\n]+', "$1")
    return F.when(json.rlike(r"[ \t\r\n]") & F.try_parse_json(json).isNotNull(), tight).otherwise(json)


def labels(given: Column) -> Column:
    """A map with its values cleared."""
    return F.transform_values(given, lambda _, v: redacted_plain(v)["text"])


def _is_attribute(name: str) -> bool:
    return name in ATTRIBUTES or name == "hash" or name.endswith("_hash") and name != "payload_hash"


def _rows(df: DataFrame, cap: int) -> DataFrame:
    """Rows with attributes and payload sides cleared.

    All plain texts of a row go through the rules as one array, so the rules stand in the plan once.
    """
    attributes, sides = [c for c in df.columns if _is_attribute(c)], [c for c in PAYLOAD if c in df.columns]
    how = {c: ways(F.col(c)) for c in sides}
    told = df.withColumns({f"__{k}_{c}": x for c, both in how.items() for k, x in zip(("python", "stays"), both, strict=True)})
    digest = lambda c: F.col(c).rlike(_HEX_DIGEST) if c.endswith("hash") else F.lit(False)
    plain = [F.when(~digest(c), F.col(c)) for c in attributes] + [F.when(~F.col(f"__python_{c}") & ~F.col(f"__stays_{c}"), F.col(c)) for c in sides]
    if not plain:
        return df
    told = told.withColumns({"__plain": F.transform(F.array(*plain), lambda t: F.when(t.isNotNull(), redacted_plain(t)["text"]))} | {f"__json_{c}": redacted_json(F.when(F.col(f"__python_{c}"), F.col(c))) for c in sides})
    at = {c: F.col("__plain")[k] for k, c in enumerate([*attributes, *sides])}
    clear = {c: F.when(digest(c), F.col(c)).otherwise(at[c]) for c in attributes} | {c: F.when(F.col(f"__python_{c}"), F.col(f"__json_{c}.text")).when(F.col(f"__stays_{c}"), F.col(c)).otherwise(at[c]) for c in sides}
    out = told.withColumns(clear).withColumns({c: F.nullif(compact(F.col(c)), F.lit("")) for c in sides})
    if "payload_hash" in df.columns and sides:
        texts = [F.coalesce(c, F.lit("")) for c in sides]
        given = F.forall(F.array(*texts), lambda x: (x == "") | x.rlike(_REFERENCE)) & F.exists(F.array(*texts), lambda x: x != "")
        out = out.withColumn("payload_hash", F.when(given, F.col("payload_hash")).otherwise(F.sha2(F.concat_ws("\x00", *texts), 256)))
    return out.withColumns({c: F.when(F.col(c).rlike(_REFERENCE), F.col(c)).otherwise(capped(F.col(c), cap)) for c in sides}).select(df.columns)


def observations(obs: DataFrame, cap: int = CAP_BYTES) -> DataFrame:
    """Observations as they may be stored: payload sides and attributes cleared; a ``payload_hash`` is made anew unless only references are left."""
    return _rows(obs, cap)


def nodes(rows: DataFrame, cap: int = CAP_BYTES) -> DataFrame:
    """Nodes as they may be exported."""
    return _rows(rows, cap)


def runs(rows: DataFrame) -> DataFrame:
    """Runs as they may be exported: their labels and texts cleared."""
    out = _rows(rows, CAP_BYTES)
    return out.withColumn("labels", labels(F.col("labels"))) if "labels" in rows.columns else out
