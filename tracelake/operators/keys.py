"""Step keys: what a call is, and where in its run, in a form that holds across runs."""

from __future__ import annotations

import hashlib
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tracelake.functions.redact import redact_text
from tracelake.sources.shared import cut

SCHEME = "stepkey/v1"
ELIGIBLE = ("tool_call", "mcp_call", "skill", "subagent")

# The field that tells a tool's calls apart.
SALIENT = {"edit": ("file_path",), "multiedit": ("file_path",), "write": ("file_path",), "read": ("file_path", "path"), "bash": ("command",), "exec_command": ("cmd",), "write_stdin": ("session_id",)}
_PATCH_FILE = re.compile(r"\*\*\* (?:Add|Update|Delete) File: (.+)")


def quote(s: str) -> str:
    """A JSON string as the keys were first made with: HTML signs and line separators escaped."""
    out = json.dumps(s, ensure_ascii=False)
    for c in "<>&\u2028\u2029":
        out = out.replace(c, f"\\u{ord(c):04x}")
    return out


def canonical(v) -> str:
    """JSON with sorted keys, no spaces, and all numbers as doubles."""
    if isinstance(v, dict):
        return "{" + ",".join(f"{quote(k)}:{canonical(v[k])}" for k in sorted(v, key=lambda x: x.encode())) + "}"
    if isinstance(v, list):
        return "[" + ",".join(map(canonical, v)) + "]"
    if isinstance(v, bool) or v is None:
        return json.dumps(v)
    if isinstance(v, (int, float)):
        return _number(float(v))
    return quote(v)


def _number(x: float) -> str:
    """The shortest form of a double; exponents below 1e-6 and from 1e21 on."""
    if x == 0:
        return "-0" if str(x)[0] == "-" else "0"
    digits = repr(abs(x))
    mantissa, _, exponent = digits.partition("e")
    whole, _, part = mantissa.partition(".")
    part = "" if part == "0" else part
    point = len(whole) + int(exponent or 0)
    all_ = (whole + part).lstrip("0")
    point -= len(whole + part) - len((whole + part).lstrip("0"))
    all_ = all_.rstrip("0") or "0"
    sign = "-" if x < 0 else ""
    if 1e-6 <= abs(x) < 1e21:
        if point <= 0:
            return f"{sign}0.{'0' * -point}{all_}"
        return sign + (all_ + "0" * (point - len(all_)) if point >= len(all_) else f"{all_[:point]}.{all_[point:]}")
    e = point - 1
    tail = f".{all_[1:]}" if len(all_) > 1 else ""
    return f"{sign}{all_[0]}{tail}e{'-' if e < 0 else '+'}{abs(e):02d}"


def raw_field(text: str, key: str) -> str | None:
    """The text of a top-level field's value, as written; of repeated ones the last."""
    decoder, at, found = json.JSONDecoder(), 0, None
    skip = re.compile(r"[ \t\r\n]*")
    at = skip.match(text, 0).end() + 1
    while (at := skip.match(text, at).end()) < len(text) and text[at] == '"':
        name, at = json.decoder.scanstring(text, at + 1)
        at = skip.match(text, skip.match(text, at).end() + 1).end()
        _, end = decoder.raw_decode(text, at)
        if name == key:
            found = text[at:end]
        at = skip.match(text, end).end() + 1
    return found


def salient(name: str, red: str) -> str:
    """What tells a call apart, of its redacted input."""
    tool = (name or "").strip().lower()
    try:
        v = json.loads(red)
    except ValueError:
        return "" if tool in SALIENT else red
    if tool in SALIENT:
        for k in SALIENT[tool]:
            if isinstance(v, dict) and k in v:
                return f"{{{quote(k)}:{raw_field(red, k)}}}"
        return ""
    if tool == "apply_patch":
        text = v if isinstance(v, str) else v.get("input") if isinstance(v, dict) else None
        if isinstance(text, str) and (m := _PATCH_FILE.search(text)):
            return f'{{"file":{quote(m.group(1))}}}'
    return canonical(v)


@F.pandas_udf(StringType())
def _salient_hash(names: pd.Series, inputs: pd.Series) -> pd.Series:
    found: dict[tuple, str] = {}  # a batch's calls: equal ones are hashed once
    for call in zip(names, inputs, strict=True):
        if call not in found:
            found[call] = hashlib.sha256(salient(call[0], redact_text(call[1] or "")).encode("utf-8", "surrogatepass")).hexdigest()[:16]
    return pd.Series([found[call] for call in zip(names, inputs, strict=True)])


def terminal(kind: str = "type", name: str = "name", subagent: str = "subagent_type", payload: str = "input") -> Column:
    """The content key of a node."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return F.when(F.col(kind) == "subagent", F.concat(F.lit("agent="), text(subagent))).otherwise(F.concat(F.lit("tool="), text(name), F.lit(" in="), _salient_hash(text(name), text(payload))))


def _hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 32)


def sibling_index(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Every child with its parent and place among its siblings, by start, type and content, id: run_id, id, parent, level."""
    order = [F.col("t_start").asc_nulls_last(), F.concat_ws("\x1f", "type", "content"), F.col("id")]
    kids = nodes.join(edges.select("run_id", F.col("src").alias("parent"), F.col("dst").alias("id")), ["run_id", "id"])
    place = F.row_number().over(Window.partitionBy("run_id", "parent").orderBy(*order)) - 1
    return kids.select("run_id", "id", "parent", F.concat_ws("#", "type", place.cast("string")).alias("level"))


def paths(levels: DataFrame) -> DataFrame:
    """The path of every child from its root: run_id, id, path.

    By doubling: each round joins a node's path to that of the ancestor it reaches, so a tree of depth d
    takes log2(d) rounds. What still moves after as many rounds as a run's nodes allow has a cycle above it:
    its path is walked up to, and without the level of, the node whose parent was there before. A node that
    is its own parent has no path.
    """
    levels = levels.where("parent <> id")
    most = levels.groupBy("run_id").count().agg(F.max("count")).first()[0] or 0
    reach = levels.select("run_id", "id", F.col("parent").alias("top"), F.col("level").alias("path"))
    for k in range(most.bit_length() + 1):
        reach = cut(reach)
        above = reach.select("run_id", F.col("id").alias("top"), F.col("top").alias("next"), F.col("path").alias("before"))
        moving = reach.join(above, ["run_id", "top"], "left_semi")
        if moving.isEmpty():
            return reach.select("run_id", "id", "path")
        if k < most.bit_length():
            reach = reach.join(above, ["run_id", "top"], "left").select("run_id", "id", F.coalesce("next", "top").alias("top"), F.concat_ws("/", "before", "path").alias("path"))
    loops = cut(moving.select("run_id", "id"))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        up = {i: (p, x) for i, p, x in zip(pdf["id"], pdf["parent"], pdf["level"], strict=True)}
        found = []
        for i in up:
            seen, at, names = {i}, i, []
            while at in up and up[at][0] not in seen:
                names.append(up[at][1])
                at = up[at][0]
                seen.add(at)
            found.append("/".join(reversed(names)))
        return pd.DataFrame({"run_id": pdf["run_id"], "id": pdf["id"], "path": found})

    walked = levels.join(loops.select("run_id").distinct(), "run_id", "left_semi").groupBy("run_id").applyInPandas(walk, "run_id string, id string, path string")  # one run with a cycle
    plain = reach.select("run_id", "id", "path").join(loops, ["run_id", "id"], "left_anti")
    return plain.unionByName(walked.join(loops, ["run_id", "id"], "left_semi"))


def step_keys(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Eligible nodes with ``content``, ``path``, ``step_key`` and ``path_key``. ``edges``: parent edges (run_id, src, dst)."""
    named = nodes.withColumn("content", terminal())
    found = paths(sibling_index(named, edges))
    out = named.where(F.col("type").isin(*ELIGIBLE)).join(found, ["run_id", "id"], "left").withColumn("path", F.coalesce("path", F.lit("")))
    return out.withColumns({"step_key": _hash(F.concat_ws("|", F.lit(SCHEME), "path", "content")), "path_key": _hash(F.concat_ws("|", F.lit(SCHEME), F.lit("path"), "path"))})
