"""Operator 8: SimHash near-duplicates by pigeonhole blocks.

Fingerprints link at ``DISTANCE`` (2) or fewer differing bits. A fingerprint is cut into 4 blocks of
16 bits; two differing bits leave two blocks alike, so every linked pair shares one of the 6 pairs of
blocks (32 bits). Distinct fingerprints join on those keys and Hamming distance is verified.

A key that more than ``SMALL`` distinct fingerprints share (a large group of near copies) is not
paired up: two fingerprints are within 2 bits exactly if a third is within 1 bit of both, so each
fingerprint of such a key links to the 65 centres around it. A centre has 65 neighbours at most,
whatever the group's size, and rows stay in proportion to the fingerprints.

Rows: null text has no words; without words the fingerprint is zero, linked like any other. Exact
copies meet in one fingerprint before any join. Ties: a bit is set if in over half of the shingle
hashes, so a tie is 0. Repeated ids keep a row each. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import cut, map_arrow, utf8
from tracelake.llm.components import min_labels

SEED = 42
SHINGLE = 3
DISTANCE = 2
#: A block key of more fingerprints takes the centres instead of pairs.
SMALL = 32
#: Hashes that are counted at a time.
_CHUNK = 1 << 16


def fingerprint(text: bytes, n: int = SHINGLE) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= n:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - n + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[n - 1 :].tolist(), strict=True)], "<u8")
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), _CHUNK):
        bits = np.unpackbits(hashes[k : k + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * counts > len(hashes)).tolist()))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and ``fp``, the fingerprint as a signed long."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batch):
        fps = np.array([fingerprint(x) for x in utf8(batch, "text")], np.uint64)
        yield {id_col: batch.column("id"), "fp": fps.view(np.int64)}

    return map_arrow(docs, {"id": F.col(id_col), "text": F.col(text_col).cast("string")}, f"`{id_col}` {id_type}, fp bigint", run)


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct ``fp`` whose components are those of the links at DISTANCE bits.

    ``a`` is a fingerprint. ``b`` is a fingerprint, or a centre, which may be one or not.
    """
    blocks = [F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF)) for k in range(4)]
    keys = F.array(*[F.shiftleft(F.shiftleft(F.lit(n).cast("long"), 16).bitwiseOR(blocks[i]), 16).bitwiseOR(blocks[j]) for n, (i, j) in enumerate(combinations(range(4), 2))])
    keyed = fps.select("fp", F.explode(keys).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("first")).where("n > 1")
    shared = keyed.join(sizes, "key")
    small = shared.where(F.col("n") <= SMALL)
    other = small.select("key", F.col("fp").alias("b"))
    pairs = small.join(other, "key").where((F.col("fp") < F.col("b")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= DISTANCE)).select(F.col("fp").alias("a"), "b")
    bits = F.array(F.lit(0).cast("long"), *[F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(64)])
    hot = shared.where(F.col("n") > SMALL).select("fp").distinct()
    around = hot.select(F.col("fp").alias("a"), F.explode(bits).alias("bit")).select("a", F.col("a").bitwiseXOR(F.col("bit")).alias("centre"))
    near = around.groupBy("centre").agg(F.min("a").alias("b"), F.count("*").alias("n")).where("n > 1")
    centred = around.join(near, "centre").where("a <> b").select("a", "b")
    return pairs.unionByName(centred).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, ``fp`` and ``component`` (the least id reachable by links, itself included)."""
    marked = cut(fingerprints(docs, id_col, text_col))
    groups = marked.groupBy("fp").agg(F.min(id_col).alias("least"))
    groups = cut(groups)
    edges = links(groups.select("fp"))
    joined = min_labels(edges, groups.select(F.col("fp").alias("node"), F.col("least").alias("label")))
    final = groups.join(joined, groups["fp"] == joined["node"], "left").select("fp", F.coalesce("label", "least").alias("component"))
    final = cut(final)  # a plain scan beside a plain scan: AQE splits a fingerprint of very many copies
    return marked.join(final, "fp").select(id_col, "fp", "component")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns."""
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without near-duplicates: of each component the row with the least id stays.

    Of rows that repeat one id, the one with the least text stays (null counts as empty). Rows without an id are kept: nothing names them.
    """
    found = cut(near_duplicates(docs, id_col, text_col))
    dropped = found.where(F.col(id_col) > F.col("component")).select(F.col(id_col).alias("__drop")).distinct()
    kept = docs.join(dropped, docs[id_col] == dropped["__drop"], "left_anti")
    if found.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").isEmpty():
        return kept
    rows = kept.where(kept[id_col].isNotNull())
    least = F.min_by(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    once = rows.groupBy(F.col(id_col).alias("__id")).agg(least.alias("__row")).select("__row.*")
    return kept.where(kept[id_col].isNull()).unionByName(once)
