"""Operator 2: benchmark decontamination with one Aho-Corasick automaton over normalised items.

Text and items are normalised alike: A-Z in lower case, words are runs of 0-9, a-z and everything
beyond ASCII. The automaton holds each item's windows of ``window`` consecutive words (an item of
fewer words is one window), a space before and after each word, so a match is whole words. A text is
scanned once; matched words map back to code points of the original text.

Rows: null text or item has no words; an item without words has no window. Items that repeat a
window are all reported. Empty tables give no rows, or rows without hits. Only the id and text
columns are read.
"""

from __future__ import annotations

import hashlib

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import cut, hold, map_arrow, slices, utf8

#: Bytes of normalised windows that one automaton holds at most (some 50 bytes of memory each); more items make more automata and scans.
AUTOMATON_BYTES = 8_000_000

_KEEP = bytes(i if 0x30 <= i <= 0x39 or 0x61 <= i <= 0x7A or i >= 0x80 else 0x20 for i in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(_KEEP).split()


def windows_of(text: bytes, window: int) -> set[bytes]:
    w = words_of(text)
    return {b" ".join(w[i : i + window]) for i in range(max(1, len(w) - window + 1))} if w else set()


def build(items: list[tuple], window: int):
    """The automaton of (item, text) pairs; a window's value is its number of words and its items."""
    owners: dict[bytes, list] = {}
    for item, text in items:
        for x in windows_of(text, window):
            owners.setdefault(x, []).append(item)
    found = ahocorasick.Automaton()
    for x, who in owners.items():
        found.add_word(f" {x.decode('latin-1')} ", (x.count(b" ") + 1, who))
    if owners:
        found.make_automaton()
    return found if owners else None


def scan(automaton, words: list[bytes]) -> tuple[bytearray, set]:
    """Which words lie in an occurrence, and the items that occur."""
    hit, items = bytearray(len(words)), set()
    if automaton is None or not words:
        return hit, items
    s = f" {b' '.join(words).decode('latin-1')} "
    at = spaces = 0
    for end, (n, who) in automaton.iter(s):
        spaces += s.count(" ", at, end)  # the space at end closes word number spaces - 1
        at = end
        hit[spaces - n : spaces] = b"\x01" * n
        items.update(w for w in who if w is not None)  # an item without an id marks words and isn't listed
    return hit, items


def source_spans(text: bytes, hit: bytearray) -> list[dict]:
    """Runs of hit words as code points of the original text, end exclusive."""
    clean = text.lower().translate(_KEEP)
    out, at, chars, k = [], 0, 0, 0
    last = -2
    for word in clean.split():
        start = clean.index(word, at)
        end = start + len(word)
        if hit[k]:
            a = chars + len(text[at:start].decode())
            b = a + len(text[start:end].decode())
            if last == k - 1:
                out[-1]["end"] = b
            else:
                out.append({"start": a, "end": b})
            last = k
        chars += len(text[at:end].decode())
        at, k = end, k + 1
    return out


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", max_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """Per text: the id, ``n_words``, ``n_hit``, ``items`` (sorted as strings), ``spans`` and ``contaminated``.

    Items are gathered to build the automaton only up to ``max_bytes`` of windows at a time; a larger
    set is dealt into as many automata by a hash of the item, and texts are scanned once with each.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.lit(None).cast("binary").alias("hit"), F.array().cast("array<string>").alias("items"))
    automata = list(_automata(items, window, item_col, item_text, max_bytes))
    for shared, key in automata[:-1]:
        rows = cut(_pass(rows, shared, key, id_type))
    rows = _final(rows, *automata[-1], id_col, id_type)
    return rows


def _state(batch):
    """Texts with the hits and items that earlier automata found."""
    return zip(utf8(batch, "text"), batch.column("hit").to_pylist(), batch.column("items").to_pylist(), strict=True)


def _more(shared, key: tuple, text: bytes, before: bytes | None, items: list) -> tuple[bytearray, set]:
    hit, found = scan(_automaton(shared, key), words_of(text))
    if before:
        hit = bytearray(a | b for a, b in zip(hit, before, strict=True))
    return hit, found | set(items)


def _pass(rows: DataFrame, shared, key: tuple, id_type: str) -> DataFrame:
    def run(batch):
        got = [_more(shared, key, *x) for x in _state(batch)]
        yield {"id": batch.column("id"), "text": batch.column("text"), "hit": [bytes(h) for h, _ in got], "items": [sorted(i) for _, i in got]}

    return map_arrow(rows, {c: F.col(c) for c in rows.columns}, f"id {id_type}, text string, hit binary, items array<string>", run)


def _final(rows: DataFrame, shared, key: tuple, id_col: str, id_type: str) -> DataFrame:
    def run(batch):
        out: dict[str, list] = {id_col: batch.column("id")} | {k: [] for k in ("n_words", "n_hit", "items", "spans", "contaminated")}
        for text, before, items in _state(batch):
            hit, found = _more(shared, key, text, before, items)
            n = sum(hit)
            out["n_words"].append(len(hit))
            out["n_hit"].append(n)
            out["items"].append(sorted(found))
            out["spans"].append(source_spans(text, hit) if n else [])
            out["contaminated"].append(n > 0)
        yield out

    schema = f"`{id_col}` {id_type}, n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:int,end:int>>, contaminated boolean"
    return map_arrow(rows, {c: F.col(c) for c in rows.columns}, schema, run)


def keep_clean(docs: DataFrame, items: DataFrame, window: int = 10, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", max_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """The documents in which no window of an item occurs, with all their columns. Items as in ``decontaminate``."""
    for shared, key in _automata(items, window, item_col, item_text, max_bytes):

        def run(batches, shared=shared, key=key):
            import pyarrow as pa

            for batch in slices(batches):
                automaton = _automaton(shared, key)
                clean = [not any(scan(automaton, words_of(t))[0]) for t in utf8(batch, text_col)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def _automata(items: DataFrame, window: int, item_col: str, item_text: str, max_bytes: int):
    """Items as broadcasts of at most ``max_bytes`` of windows each, with a key for each."""
    spark = items.sparkSession
    given = items.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).cast("string").alias("text")).where("text is not null")
    total = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = total * window // max_bytes + 1
    for k in range(shards):
        part = given.where(F.pmod(F.xxhash64("item"), F.lit(shards)) == k) if shards > 1 else given
        held = sorted(((r["item"], r["text"].encode()) for r in part.toLocalIterator()), key=lambda x: (x[0] is None, x[0] or "", x[1]))
        yield spark.sparkContext.broadcast(held), (hashlib.sha256(repr(held).encode()).hexdigest(), window)


def _automaton(shared, key: tuple):
    """One automaton for each Python worker and set of items."""
    return hold(key, lambda: build(shared.value, key[1]))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns."""
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")
