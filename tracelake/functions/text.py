"""Scalar functions over names, labels, versions and payloads, as Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Beginnings of prompts that no person wrote.
SYNTHETIC = (
    "<command-name>", "<command-message>", "<command-args>", "<local-command-stdout>", "<local-command-stderr>", "<local-command-caveat>", "<task-notification>", "<system-reminder>", "<user-prompt-submit-hook>",
)
# Tools that open and close phases, and those that run skills.
SKILL_TOOLS = ("Skill", "SlashCommand")
MAX_LABELS, MAX_LABEL_BYTES = 32, 256
_SPACE = r"[\s\u0085   -     　]"


def trimmed(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, f"^{_SPACE}+|{_SPACE}+$", "")


def prompt_kind(text: Column) -> Column:
    """"system" for prompts that a runtime wrote, else "human"."""
    t = trimmed(text)
    found = F.lit(False)
    for x in SYNTHETIC:
        found = found | t.startswith(x)
    return F.when(found, "system").otherwise("human")


#: The server whose tool ``mark`` bounds phases.
MARK_SERVER = "tracelake"


def is_marker_tool(name: Column, server: str = MARK_SERVER) -> Column:
    """Whether a tool is ``mark`` of the given server, under its own name or the runtime's; other servers' ``mark`` is a tool like any."""
    return F.coalesce(name.isin(f"mcp__{server}__mark", f"{server}__mark"), F.lit(False))


def tool_type(name: Column) -> Column:
    return F.when(name.startswith("mcp__"), "mcp_call").when(name.isin(*SKILL_TOOLS), "skill").otherwise("tool_call")


def skill_name(payload: Column) -> Column:
    """The skill of a call's input: its ``skill``, else the first word of its ``command`` without a slash; null without."""
    command = F.regexp_extract(trimmed(F.get_json_object(payload, "$.command")), r"^/?(\S*)", 1)
    return F.coalesce(F.nullif(F.get_json_object(payload, "$.skill"), F.lit("")), F.nullif(command, F.lit("")))


def parse_labels(text: Column) -> Column:
    """A map of ``key=value`` pairs, comma-separated. Bad keys and long values are left out; the last of a key wins."""
    pairs = F.transform(F.filter(F.split(text, ","), lambda x: F.contains(x, F.lit("="))), lambda x: F.struct(trimmed(F.substring_index(x, "=", 1)).alias("k"), trimmed(F.regexp_extract(x, "(?s)=(.*)$", 1)).alias("v")))
    good = F.filter(pairs, lambda p: p["k"].rlike("^[a-z0-9_.-]{1,64}$") & (F.octet_length(p["v"]) <= MAX_LABEL_BYTES))

    def last(pairs: Column) -> Column:
        """Keys in the order of their last pairs, each with that pair's value."""
        keys = F.slice(F.reverse(F.array_distinct(F.transform(F.reverse(pairs), lambda p: p["k"]))), 1, MAX_LABELS)
        return F.transform(keys, lambda k: F.struct(k.alias("k"), F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"].alias("v")))

    return F.map_from_entries(F.element_at(F.transform(F.array(good), last), 1))  # the pairs have a name: they are found once


def format_labels(labels: Column) -> Column:
    """``key=value`` pairs by key, comma-separated."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")


def merge_labels(left: Column, right: Column) -> Column:
    """Both maps; the right one's values win."""
    rest = F.map_filter(left, lambda k, _: ~F.array_contains(F.map_keys(right), k))
    return F.map_concat(rest, right)


def match_labels(labels: Column, wanted: dict[str, str]) -> Column:
    """Whether all wanted pairs are there; a missing label is the empty string."""
    ok = F.lit(True)
    for k, v in wanted.items():
        ok = ok & (F.coalesce(F.try_element_at(labels, F.lit(k)), F.lit("")) == v)
    return ok


def parse_selector(selector: str) -> tuple[str, dict[str, str] | str]:
    """``label:k=v,...`` as ("label", pairs), ``name:x`` as ("name", x)."""
    kind, _, rest = selector.partition(":")
    if kind == "name" and rest:
        return kind, rest
    if kind == "label" and rest and all("=" in x for x in rest.split(",")):
        return kind, {k.strip(): v.strip() for k, _, v in (x.partition("=") for x in rest.split(","))}
    raise ValueError(f"{selector!r} is neither label:k=v,... nor name:x")


def parse_annotation_specs(specs: list[str]) -> dict[str, bool]:
    """``owner.key[:higher-better|lower-better]`` as key: higher is better. One dot; no repeats."""
    out: dict[str, bool] = {}
    for spec in specs:
        key, _, way = spec.partition(":")
        if way not in ("", "higher-better", "lower-better") or key.count(".") != 1 or not all(key.split(".")):
            raise ValueError(f"{spec!r} is not owner.key[:higher-better|lower-better]")
        if key in out:
            raise ValueError(f"{key} is given twice")
        out[key] = way == "higher-better"
    return out


def version_key(version: Column) -> Column:
    """A version's leading numbers by segment, for comparison: "1.12.3-rc" is [1, 12, 3], of any length. A leading v is left out.

    Zeros at the end go, as "1.2" and "1.2.0" are equal; what is then a beginning of another is the lesser one.
    """
    parts = F.transform(F.split(F.regexp_replace(version, "^v", ""), r"\."), lambda x: F.coalesce(F.regexp_extract(x, "^[0-9]+", 0).try_cast("long"), F.lit(0).cast("long")))
    numbered = F.transform(parts, lambda x, i: F.when(x != 0, i + 1).otherwise(0))
    return F.slice(parts, 1, F.array_max(numbered))


def newest(version: str, seq: str) -> Column:
    """The newest of a group's versions, as an aggregate; of equal ones the first by ``seq``. Nulls and empty texts are no versions."""
    known = F.nullif(F.col(version), F.lit(""))
    return F.max_by(version, F.when(known.isNotNull(), F.struct(version_key(F.col(version)), -F.col(seq))))


def parse_phase(selector: str) -> tuple[str, int]:
    """``name[,occurrence]``; the first occurrence by default."""
    name, comma, occurrence = selector.partition(",")
    if comma and not re.fullmatch(r"[+-]?[0-9]+", occurrence):
        raise ValueError(f"{selector!r} is not name[,occurrence]")
    return name, int(occurrence) if comma else 0


def parse_window(phase: str = "", start: str = "", end: str = "") -> tuple[tuple[str, int], tuple[str, int] | None]:
    """A phase, or a range from one phase to another: (phase, None) or (first, last). A range needs both ends and excludes a phase."""
    if bool(start) != bool(end):
        raise ValueError("a range needs both its ends")
    if start and phase:
        raise ValueError("a phase and a range exclude each other")
    return (parse_phase(start), parse_phase(end)) if start else (parse_phase(phase), None)


def payload_hash(input: Column, output: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(input, F.lit("")), F.lit("\x00"), F.coalesce(output, F.lit(""))), 256)


def phase_key(enclosing: Column, name: Column, occurrence: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", F.lit("phasekey/v1"), enclosing, name, occurrence.cast("string")), 256), 1, 32)
