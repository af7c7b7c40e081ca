"""Two graphs step by step: what was added, removed, changed or stayed.

Any number of pairs of graphs is aligned at once; ``pair`` groups them. Steps are matched in four passes:
by step key, by content where it is unique on both sides, by the longest common subsequence of what is
left, and by position. The k-th of equal keys matches the k-th of the other side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.sources.shared import cut

ITEM = ("id", "type", "name", "subagent_type", "step_key", "content", "path", "t_start", "args", "status", "cost_usd", "duration_ms", "tokens_in", "tokens_out")


def without_markers(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph without marker nodes and their edges."""
    markers = nodes.where("type = 'marker'").select("run_id", "id")
    kept = edges.join(markers.withColumnRenamed("id", "src"), ["run_id", "src"], "left_anti").join(markers.withColumnRenamed("id", "dst"), ["run_id", "dst"], "left_anti")
    return nodes.where("type <> 'marker'"), kept


def _order() -> list[Column]:
    return [F.col("t_start").asc_nulls_last(), F.col("step_key"), F.col("content"), F.col("id")]


def position_key() -> Column:
    return F.concat_ws("\x1f", *[F.coalesce(c, F.lit("")) for c in ("path", "type", "name", "subagent_type")])


def _ranked(items: DataFrame, key: Column) -> DataFrame:
    keyed = items.withColumn("__k", key)
    return keyed.select("pair", "id", "__k", F.row_number().over(Window.partitionBy("pair", "__k").orderBy(*_order())).alias("__r"))


def match_ranked(a: DataFrame, b: DataFrame, key: Column) -> DataFrame:
    """(pair, a, b): the k-th item of a key with the k-th of the other side."""
    return _ranked(a, key).withColumnRenamed("id", "a").join(_ranked(b, key).withColumnRenamed("id", "b"), ["pair", "__k", "__r"]).select("pair", "a", "b")


def match_unique(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(pair, a, b): items whose key is alone on both sides."""
    one = lambda d, k: d.groupBy("pair", key).agg(F.count("*").alias("n"), F.min("id").alias(k)).where("n = 1").drop("n")
    return one(a, "a").join(one(b, "b"), ["pair", key]).select("pair", "a", "b")


class _Lengths:
    """Lengths of common subsequences of the rest of ``a`` from i and of ``b`` from j: ``self[i][j]``, to be asked in order of i.

    Every row is made once from the last to the first, and only those at even strides are kept; the rows between
    two of them are made again when they are asked for. So at most about two times the root of all rows are held.
    """

    def __init__(self, a: list[str], b: list[str]):
        import numpy as np

        of: dict[str, list[int]] = {}
        for j, x in enumerate(b):
            of.setdefault(x, []).append(j)
        self._where = {x: np.array(js) for x, js in of.items()}
        self._a, self._stride = a, max(int(len(a) ** 0.5), 1)
        row = np.zeros(len(b) + 1, np.int32)
        self._kept, self._block, self._rows = {len(a): row}, -1, {}
        for i in range(len(a) - 1, -1, -1):
            row = self._before(i, row)
            if i % self._stride == 0:
                self._kept[i] = row

    def _before(self, i: int, after):
        import numpy as np

        row = after.copy()
        at = self._where.get(self._a[i])
        if at is not None:
            row[at] = np.maximum(row[at], after[at + 1] + 1)
            row = np.maximum.accumulate(row[::-1])[::-1]
        return row

    def __getitem__(self, i: int):
        if i in self._kept:
            return self._kept[i]
        if (block := i // self._stride) != self._block:
            top = min((block + 1) * self._stride, len(self._a))
            row, self._rows, self._block = self._kept[top], {}, block
            for k in range(top - 1, block * self._stride, -1):
                row = self._rows[k] = self._before(k, row)
        return self._rows[i]


#: Cells from which on rows of lengths are made at once instead of one by one.
_MANY = 6_000


def common_subsequence(a: list[str], b: list[str], gaps: list[bool] | None = None) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence; where both ways are as long, a advances.

    ``gaps``: whether items that ``a`` lacks, left out of ``b``, stood before each of its items. Such an item
    can't match, but the walk stops at it: ``a`` advances there as far as that costs nothing.
    """
    n, m = len(a), len(b)
    if n * m > _MANY:
        best = _Lengths(a, b)
    else:
        best = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n - 1, -1, -1):
            row, after, x = best[i], best[i + 1], a[i]
            for j in range(m - 1, -1, -1):
                row[j] = after[j + 1] + 1 if x == b[j] else max(after[j], row[j + 1])
    out, i = [], 0
    for j in range(m):
        if gaps and gaps[j]:
            while i < n and best[i + 1][j] == best[i][j]:
                i += 1
        while i < n and a[i] != b[j] and best[i + 1][j] >= best[i][j + 1]:
            i += 1
        if i < n and a[i] == b[j]:
            out.append((i, j))
            i += 1
    return out


def match_sequence(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(pair, a, b) by the longest common subsequence of what one pair of graphs has left."""

    def matched(left, right):
        import pyarrow as pa

        left, right = left.sort_by("place"), right.sort_by("place")
        at = right["place"].to_pylist()
        hits = common_subsequence(left[key].to_pylist(), right[key].to_pylist(), [p - q > 1 for p, q in zip(at, [0, *at], strict=False)])
        return pa.table({"pair": left["pair"].take([i for i, _ in hits]), "a": left["id"].take([i for i, _ in hits]), "b": right["id"].take([j for _, j in hits])}) if hits else pa.table({c: pa.array([], t) for c, t in (("pair", left.schema.field("pair").type), ("a", pa.string()), ("b", pa.string()))})

    need = ["pair", "id", key, "place"]
    place = F.row_number().over(Window.partitionBy("pair").orderBy(*_order()))  # one graph's residue
    a, b = a.withColumn("place", place), b.withColumn("place", place)
    # contents that one side lacks can't match: left out before the quadratic part
    keys = a.select("pair", key).distinct().join(b.select("pair", key).distinct(), ["pair", key])
    a, b = (d.join(keys, ["pair", key], "left_semi").select(*need) for d in (a, b))
    a, b = (d.select(*[F.col(c).alias(c) for c in need]) for d in (a, b))  # both may come from one table
    return a.groupBy("pair").cogroup(b.groupBy("pair")).applyInArrow(matched, a.select("pair", F.col("id").alias("a"), F.col("id").alias("b")).schema)


def _left(a: DataFrame, b: DataFrame, hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    return a.join(hits.select("pair", F.col("a").alias("id")), ["pair", "id"], "left_anti"), b.join(hits.select("pair", F.col("b").alias("id")), ["pair", "id"], "left_anti")


def _aligned(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All matched items (pair, a, b), and what is left of either side (pair, id, name). Each pass is written down: the next ones start from its rows."""
    need = ["pair", "id", "type", "name", "subagent_type", "step_key", "content", "path", "t_start"]
    a, b = (d.select(*[F.col(c).alias(c) for c in need]) for d in (a, b))
    found = []
    for match in (lambda x, y: match_ranked(x, y, F.col("step_key")), lambda x, y: match_unique(x, y, "content"), lambda x, y: match_sequence(x, y, "content"), lambda x, y: match_ranked(x, y, position_key())):
        found.append(cut(match(a, b)))
        a, b = (cut(d) for d in _left(a, b, found[-1]))
    return reduce(DataFrame.unionByName, found), a.select("pair", "id", "name"), b.select("pair", "id", "name")


def align(a: DataFrame, b: DataFrame) -> DataFrame:
    """(pair, a, b) of all matched items."""
    return _aligned(a, b)[0]


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """A row for each step of either graph: ``kind`` (added, removed, changed, unchanged), ``tier`` of the match, and what changed.

    Null numbers count as 0 in deltas.
    """
    hits, gone, new = _aligned(a, b)
    side = lambda d, k: d.select("pair", F.col("id").alias(k), F.struct(*[c for c in ITEM if c != "id"]).alias(f"{k}_"))
    both = hits.join(side(a, "a"), ["pair", "a"]).join(side(b, "b"), ["pair", "b"])
    x, y = F.col("a_"), F.col("b_")
    tier = F.when(x["step_key"] == y["step_key"], "step_key").when(x["content"] == y["content"], "content").otherwise("position")
    number = lambda k: F.coalesce(y[k], F.lit(0)) - F.coalesce(x[k], F.lit(0))
    deltas = {f"{k}_delta": number(k) for k in ("cost_usd", "duration_ms", "tokens_in", "tokens_out")}
    args, status = ~x["args"].eqNullSafe(y["args"]), ~x["status"].eqNullSafe(y["status"])
    changed = args | status
    for d in deltas.values():
        changed = changed | (d != 0)
    found = both.select("pair", "a", "b", F.when(changed, "changed").otherwise("unchanged").alias("kind"), tier.alias("tier"), x["name"].alias("name"), args.alias("args_changed"), status.alias("status_changed"), *[v.alias(k) for k, v in deltas.items()])
    out = found.unionByName(gone.select("pair", F.col("id").alias("a"), F.lit("removed").alias("kind"), "name"), allowMissingColumns=True)
    return out.unionByName(new.select("pair", F.col("id").alias("b"), F.lit("added").alias("kind"), "name"), allowMissingColumns=True)
