"""Comparison of two tables: numbers within a tolerance, header and row order aside.

Only rows with equal text cells can be partners, and of those only rows whose first numbers hang together by
steps within the tolerance: a band. A band of rows that are all equal, or of one distinct row a side, is settled by counts. In any other, a
maximum matching is found among all its rows, as an equal row may be the only partner of another one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_MISMATCHES = 10


def header(name: str) -> str:
    return name.strip().lower().replace(" ", "_").replace("-", "_")


def normalised(df: DataFrame) -> DataFrame:
    """The table with normalised headers; fails if two become one."""
    names = [header(c) for c in df.columns]
    if clash := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"columns {clash} repeat after header normalisation")
    return df.toDF(*names)


def cell(c: Column, boolean: bool = False) -> Column:
    """A cell as struct(number, text): a number if it reads as one, else its stripped text; null is neither. A boolean equals no text."""
    if boolean:
        return F.struct(F.lit(None).cast("double").alias("number"), F.concat(F.lit("\x00"), c.cast("string")).alias("text"))
    s = F.trim(c.cast("string"))
    n = s.try_cast("double")
    return F.struct(n.alias("number"), F.when(n.isNull(), s).alias("text"))


def _matching(near: list[list[int]], m: int) -> list[int]:
    """For each right item its left one or -1, as many as possible (augmenting paths)."""
    of = [-1] * m
    for i in range(len(near)):
        seen, stack = [False] * m, [(i, iter(near[i]), -1)]
        while stack:
            left, options, _ = stack[-1]
            j = next((j for j in options if not seen[j]), None)
            if j is None:
                stack.pop()
                continue
            seen[j] = True
            stack[-1] = (left, options, j)
            if of[j] < 0:
                for left, _, j in reversed(stack):
                    of[j] = left
                break
            stack.append((of[j], iter(near[of[j]]), -1))
    return of


def unmatched(got: DataFrame, want: DataFrame, columns: list[str], tolerance: float = 1e-4) -> DataFrame:
    """Rows without a partner: side ("got", "want") and the row's cells as text."""
    texts = F.to_json(F.array(*[F.coalesce(F.col(f"{c}.text"), F.when(F.col(f"{c}.number").isNotNull(), F.lit("\x00number")), F.lit("\x00null")) for c in columns]))
    numbers = F.array(*[F.col(f"{c}.number") for c in columns])
    cells = lambda df: df.select(*[cell(F.col(c), df.schema[c].dataType.simpleString() == "boolean").alias(c) for c in columns])
    shape = lambda df, n: cells(df).select(texts.alias("texts"), numbers.alias("numbers"), F.lit(n).alias("got"), F.lit(1 - n).alias("want"))
    both = shape(got, 1).unionByName(shape(want, 0))
    finite = F.forall("numbers", lambda x: x.isNull() | (~F.isnan(x) & (F.abs(x) < float("inf"))))
    distinct = both.where(finite).groupBy("texts", "numbers").agg(F.sum("got").alias("got"), F.sum("want").alias("want"))
    first = F.coalesce(F.try_element_at(F.filter("numbers", lambda x: x.isNotNull()), F.lit(1)), F.lit(0.0))
    steps = Window.partitionBy("texts").orderBy("first")
    banded = distinct.withColumn("first", first).withColumn("step", (F.col("first") - F.lag("first").over(steps) > tolerance).cast("int")).withColumn("band", F.coalesce(F.sum("step").over(steps), F.lit(0)))
    within = Window.partitionBy("texts", "band")
    sized = banded.withColumns({"rows": F.count("*").over(within), "both": F.sum(F.least("got", "want")).over(within), "gots": F.sum("got").over(within), "wants": F.sum("want").over(within), "least": F.min("numbers").over(within), "most": F.max("numbers").over(within)})
    each = lambda df, side, n: df.select("texts", "numbers", "band", F.explode(F.array_repeat(F.lit(side), n.cast("int"))).alias("side"))
    # of two distinct rows, one of each side, there is nothing to choose: they are partners as often as both are there, or not at all
    pair = (F.col("rows") == 2) & (F.col("both") == 0) & (F.col("gots") > 0) & (F.col("wants") > 0)
    near = F.forall(F.arrays_zip("least", "most"), lambda z: z["least"].isNull() | (F.abs(z["least"] - z["most"]) <= tolerance))
    sized = sized.withColumn("pair", pair)
    partners = F.when(F.col("pair") & near, F.least("gots", "wants")).otherwise(0)
    alike = sized.where("rows = 1 OR pair").withColumns({"got": F.greatest(F.col("got") - partners, F.lit(0)), "want": F.greatest(F.col("want") - partners, F.lit(0))})
    mixed = sized.where("rows > 1 AND NOT pair")
    settled = each(alike, "got", F.greatest(F.col("got") - F.col("want"), F.lit(0))).unionByName(each(alike, "want", F.greatest(F.col("want") - F.col("got"), F.lit(0))))
    odd = both.where(~finite).select("texts", "numbers", F.when(F.col("got") == 1, "got").otherwise("want").alias("side"))  # NaN and infinities equal nothing
    rest = each(mixed, "got", F.col("got")).unionByName(each(mixed, "want", F.col("want")))

    def match(group):
        import numpy as np
        import pyarrow as pa

        t = group.to_pydict()
        rows = [np.array([np.nan if x is None else x for x in r], float) for r in t["numbers"]]
        has = np.array([x is not None for x in t["numbers"][0]])  # the same cells in the whole group
        g, w = ([i for i, s in enumerate(t["side"]) if s == k] for k in ("got", "want"))

        def like(i, j):
            d = np.abs(rows[i] - rows[j])
            return bool(np.all(~has | (d <= tolerance)))  # a NaN is never within

        of = _matching([[k for k, j in enumerate(w) if like(i, j)] for i in g], len(w))
        used = set(of)
        alone = [i for k, i in enumerate(g) if k not in used] + [j for k, j in enumerate(w) if of[k] < 0]
        kinds = pa.schema([("side", pa.string()), ("texts", pa.string()), ("numbers", pa.list_(pa.float64()))])
        return pa.Table.from_pydict({"side": [t["side"][i] for i in alone], "texts": [t["texts"][i] for i in alone], "numbers": [t["numbers"][i] for i in alone]}, schema=kinds)

    found = rest.groupBy("texts", "band").applyInArrow(match, "side string, texts string, numbers array<double>")
    return found.unionByName(settled.select("side", "texts", "numbers")).unionByName(odd)


def compare(got: DataFrame, want: DataFrame, tolerance: float = 1e-4, strict: bool = True, normalize_headers: bool = True) -> DataFrame:
    """One row: equal, row_diff, and the first mismatches.

    Strict: columns and row counts must be the same. Otherwise ``want`` need only be contained in ``got``.
    """
    if normalize_headers:
        got, want = normalised(got), normalised(want)
    missing = [f"column {c}: in got, not in want" for c in sorted(set(got.columns) - set(want.columns))] + [f"column {c}: in want, not in got" for c in sorted(set(want.columns) - set(got.columns))]
    columns = [c for c in want.columns if c in got.columns]
    alone = unmatched(got, want, columns, tolerance)
    if not strict:
        alone = alone.where("side = 'want'")
    first = alone.orderBy("texts", "numbers", "side").limit(MAX_MISMATCHES).agg(F.collect_list(F.concat_ws(" ", F.lit("row only in"), "side", "texts", F.to_json("numbers"))).alias("rows"))
    counts = got.agg(F.count("*").alias("g")).crossJoin(want.agg(F.count("*").alias("w")))  # a row each
    size = F.when((F.col("g") != F.col("w")) & F.lit(strict), F.array(F.format_string("row count: got %d, want %d", "g", "w"))).otherwise(F.array().cast("array<string>"))
    listed = F.slice(F.concat(F.array(*map(F.lit, missing if strict else [])).cast("array<string>"), size, F.col("rows")), 1, MAX_MISMATCHES)
    return counts.crossJoin(first).select((F.size(listed) == 0).alias("equal"), F.abs(F.col("g") - F.col("w")).alias("row_diff"), listed.alias("mismatches"))
