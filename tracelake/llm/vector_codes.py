"""Operator 12: product quantisation of vectors, by weighted Lloyd rounds over distinct parts.

A component x becomes the integer ``floor(256 * x)``; a vector is cut into ``PARTS`` equal consecutive
parts, and each part's place has a codebook of at most ``ENTRIES`` entries. Equal parts of one place are
one row with a weight, so a vector that a third of the table repeats costs a round as much as any other.
Lloyd's rounds run over those distinct parts alone: tasks assign them in blocks against the codebooks
(``PARTS * ENTRIES`` entries, a fixed number, sent with the code) and return weighted sums by entry, at
most one row an entry and task. After the last assignment, codes and errors are joined back to the
vectors by part. All arithmetic is of 64-bit integers, so the order of rows and tasks can't matter.

Rows: a vector that is null, or holds a null or a component that isn't finite, is dropped. The first
codebooks are the parts of the ``ENTRIES`` rows with the least ids (of one id, the least vector first;
null ids last); fewer rows make smaller codebooks, equal ones stay and the lower index wins. Repeated rows
each give a row. A vector whose length differs from the first one's can't be compared with it and is
dropped; a length that ``PARTS`` doesn't divide is filled up with zeros, which changes no distance.
Components whose distances could leave 64 bits (from 740,000 at 64 components) are refused with an error.
An empty table gives no rows. Only id, vector and label are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import cut

SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
#: Distinct parts that a task holds against a codebook at a time, as a block of int64 distances.
BLOCK_ROWS = 4096

#: Of every place, its entries as rows of int64.
Codebooks = list[np.ndarray]


def _integer(x: Column, length: Column) -> Column:
    """``floor(256 * x)``, if squared distances of vectors of such components stay in 64 bits."""
    scaled = F.floor(x * SCALE)
    return F.when(F.abs(scaled) < F.sqrt(F.lit(2.0**63) / length) / 2, scaled).otherwise(F.raise_error(F.lit("a vector component is too large for distances of 64 bits")).cast("long")).cast("int")


def kept(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Rows with whole finite vectors: ``row`` (a number without meaning), ``id``, ``label``, ``ints``."""
    found = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    found = found.where(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    return found.select(F.monotonically_increasing_id().alias("row"), "id", "label", F.transform("v", lambda x: _integer(x, F.size("v"))).alias("ints"))


def cut_up(rows: DataFrame, length: int, parts: int = PARTS) -> DataFrame:
    """``row``, ``place`` and ``part`` of vectors of ``length`` components."""
    width = max(1, -(-length // parts))
    ints = F.concat("ints", F.array_repeat(F.lit(0), width * parts - length))
    return rows.select("row", F.posexplode(F.array(*[F.slice(ints, p * width + 1, width) for p in range(parts)])).alias("place", "part"))


def first_codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> tuple[int, Codebooks]:
    """The vectors' length and the parts of the first rows: ``entries`` vectors reach the driver."""
    order = [F.col("id").asc_nulls_last(), F.col("ints")]
    length = next((len(r["ints"]) for r in rows.orderBy(*order).select("ints").limit(1).collect()), 0)
    seeds = [r["ints"] for r in rows.where(F.size("ints") == length).orderBy(*order).select("ints").limit(entries).collect()]
    width = max(1, -(-length // parts))
    whole = np.zeros((len(seeds), width * parts), np.int64)
    if seeds and length:
        whole[:, :length] = seeds
    return length, [whole[:, p * width : (p + 1) * width] for p in range(parts)]


def nearest(values: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of every row and its squared distance; of ties the lower index."""
    codes, errors = np.empty(len(values), np.int64), np.empty(len(values), np.int64)
    for a in range(0, len(values), BLOCK_ROWS):
        block = values[a : a + BLOCK_ROWS]
        far = np.zeros((len(block), len(book)), np.int64)
        for k in range(block.shape[1]):
            gap = block[:, k, None] - book[None, :, k]
            far += gap * gap
        codes[a : a + BLOCK_ROWS] = best = far.argmin(axis=1)
        errors[a : a + BLOCK_ROWS] = far[np.arange(len(block)), best]
    return codes, errors


def _by_place(batch: pa.RecordBatch, books: Codebooks):
    """Of every place in a batch of distinct parts: the place, its rows' numbers, their values, codes and errors."""
    places = batch.column("place").to_numpy()
    values = batch.column("part").flatten().to_numpy().astype(np.int64).reshape(batch.num_rows, -1)
    for p in np.unique(places):
        at = np.flatnonzero(places == p)
        yield int(p), at, values[at], *nearest(values[at], books[p])


def moved(distinct: DataFrame, books: Codebooks) -> Codebooks:
    """One round: entries become the floored mean of what is assigned to them, by weight; unused ones stay."""
    width = books[0].shape[1]

    def run(batches):
        sums = [np.zeros((len(b), width + 1), np.int64) for b in books]
        most = 0.0
        for batch in batches:
            weights = batch.column("n").to_numpy()
            for p, at, values, codes, _ in _by_place(batch, books):
                w = weights[at, None]
                most += float(np.abs(values).max(initial=1)) * float(w.sum())
                if most >= 2.0**63:
                    raise OverflowError("the sums of a codebook leave 64 bits")
                order = np.argsort(codes, kind="stable")
                used, starts = np.unique(codes[order], return_index=True)
                sums[p][used] += np.add.reduceat(np.hstack([w, w * values])[order], starts)
        found = [(p, c, x) for p, s in enumerate(sums) for c, x in enumerate(s) if x[0]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.int32()), pa.array([x[2].tolist() for x in found], pa.list_(pa.int64()))],
            names=["place", "code", "sums"],
        )

    tasks = distinct.mapInArrow(run, "place int, code int, sums array<bigint>")
    totals = tasks.groupBy("place", "code").agg(*[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(width + 1)])
    new = [b.copy() for b in books]
    for place, code, n, *total in totals.collect():  # parts x entries rows at most
        new[place][code] = [t // n for t in total]
    return new


def assigned(distinct: DataFrame, books: Codebooks) -> DataFrame:
    """``place``, ``part``, ``code`` and ``error`` of the distinct parts."""

    def run(batches):
        for batch in batches:
            codes, errors = np.empty(batch.num_rows, np.int32), np.empty(batch.num_rows, np.int64)
            for _, at, _, c, e in _by_place(batch, books):
                codes[at], errors[at] = c, e
            yield pa.RecordBatch.from_arrays([batch.column("place"), batch.column("part"), pa.array(codes), pa.array(errors)], names=["place", "part", "code", "error"])

    return distinct.mapInArrow(run, "place int, part array<int>, code int, error bigint")


def told(books: Codebooks) -> str:
    """Hex SHA-256 of all components as decimals, by place, entry and position, with commas between."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for row in b for x in row).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """Per kept row its id, label, ``code`` (two hex digits a part) and ``error``; and the codebooks. Entries are 256 at most."""
    if entries > 256:
        raise ValueError("a code has two hex digits")
    rows = cut(kept(vectors, id_col, vector_col, label_col))
    length, books = first_codebooks(rows, parts, entries)
    rows = rows.where(F.size("ints") == length)
    pieces = cut_up(rows, length, parts)
    distinct = cut(pieces.groupBy("place", "part").agg(F.count(F.lit(1)).alias("n")))
    for _ in range(rounds):
        books = moved(distinct, books)
    joined = pieces.join(assigned(distinct, books), ["place", "part"])
    # seven codes of eight bits fit a long, whatever they are
    longs = range(0, parts, 7)
    packed = [F.sum(F.when((F.col("place") >= p) & (F.col("place") < p + 7), F.expr(f"shiftleft(bigint(code), 8 * ({p + 6} - place))")).otherwise(0)).alias(f"c{p}") for p in longs]
    by_row = joined.groupBy("row").agg(F.sum("error").alias("error"), *packed)
    code = F.concat(*[F.substring(F.lpad(F.hex(f"c{p}"), 14, "0"), 1, 2 * min(7, parts - p)) for p in longs])
    found = rows.select("row", "id", "label").join(by_row.select("row", "error", F.lower(code).alias("code")), "row")
    return found.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error"), books


def digest(compressed: tuple[DataFrame, Codebooks], id_col: str = "vec_id", label_col: str = "label") -> DataFrame:
    """The contract's columns. Errors are summed by label before they meet the rows, so a common label is no gathering."""
    found, books = cut(compressed[0]), compressed[1]
    by_label = cut(found.groupBy(label_col).agg(F.sum("error").alias("label_error"))).withColumnRenamed(label_col, "of")
    return found.join(by_label, found[label_col].eqNullSafe(by_label["of"])).select(id_col, "code", "error", "label_error", F.lit(told(books)).alias("codebooks_sha256"))


#: The same rows in DuckDB's SQL: every part of every vector against every entry, in each round.
CODES_SQL = f"""
WITH kept AS (
    SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS ints
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: coalesce(NOT isfinite(x), true))) = 0
), v AS (SELECT r, p, ints[p * len(ints) // {PARTS} + 1:(p + 1) * len(ints) // {PARTS}] AS part FROM kept, range({PARTS}) t(p)
), first AS (SELECT r, row_number() OVER (ORDER BY vec_id, ints) - 1 AS e FROM kept QUALIFY e < {ENTRIES}
), b0 AS (SELECT p, e, part AS entry FROM v JOIN first USING (r)
{"".join(f'''), a{k} AS (
    SELECT r, v.p, part, arg_min(e, (list_sum(list_transform(list_zip(part, entry), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e)) AS e,
        min(list_sum(list_transform(list_zip(part, entry), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS error
    FROM v JOIN b{k} USING (p) GROUP BY r, v.p, part
''' + (f'''), s{k} AS (
    SELECT p, e, i, CAST(floor(sum(part[i]) / count(*)) AS BIGINT) AS x FROM a{k}, range(1, (SELECT max(len(part)) FROM v) + 1) t(i) WHERE i <= len(part) GROUP BY p, e, i
), b{k + 1} AS (
    SELECT b.p, b.e, coalesce(m.entry, b.entry) AS entry FROM b{k} b LEFT JOIN (SELECT p, e, list(x ORDER BY i) AS entry FROM s{k} GROUP BY p, e) m ON m.p = b.p AND m.e = b.e
''' if k < ROUNDS else "") for k in range(ROUNDS + 1))}), coded AS (
    SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(error) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r
), told AS (SELECT sha256(string_agg(array_to_string(entry, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN coded USING (r), told
"""
