"""Operator 11: how filters interact in every order, from sums over the lattice of filter subsets.

Five filters fail a document independently of each other; an order only decides which one removes it.
So all 120 orders are paths in one lattice: a node is the subset of filters already applied, an edge
``(subset, next filter)`` applies one more. What a step of an order counts depends on its edge alone,
so documents are summed over the 80 edges, never over the orders, and the 600 steps are joined to the sums.

Documents of one part, failures and labels count alike on every edge, so they are counted first (at
most 32 failure masks a part): only those counts are dealt to the edges.

Failure conditions (``conditions``; words are runs of other characters than white space):
A under 100 words; B under 80 distinct words in 100; C over 10 letters ``A-Z`` in 100 characters;
D any of ``#$%&*|``; E the same text as a row with a smaller id, wherever in the table, removed or not.

Rows: null text is empty. A null language is the part of the empty string. A null id is neither smaller
nor larger than another: such rows never fail E and have no label. Rows of one id and one text are
no copies of each other (no id is smaller); each counts. Where labels have several rows of an id, the id
is good or toxic if one of them says so; an id without labels is neither. An empty table has no parts and
gives no rows. Only id, text and language, and the three columns of labels, are read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import cut
from tracelake.llm.quality import _words as words

MIN_WORDS = 100
MIN_DISTINCT_PERCENT = 80
MAX_CAPITALS_PERCENT = 10
SYMBOLS = "[#$%&*|]"
FILTERS = "ABCDE"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def conditions(text: Column, found: Column) -> dict[str, Column]:
    """The conditions of one text and its words, by filter; E is of the table and not among them."""
    return {
        "A": F.size(found) < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct(found)) < MIN_DISTINCT_PERCENT * F.size(found),
        "C": 100 * F.char_length(F.regexp_replace(text, "[^A-Z]+", "")) > MAX_CAPITALS_PERCENT * F.char_length(text),
        "D": text.rlike(SYMBOLS),
    }


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Documents counted by ``part``, ``mask`` (bit k is set where filter k fails), ``good`` and ``toxic``: a column ``n``.

    Texts are read once, and are SHA-256 sums after that. Rows of one id and text are counted together
    before any join, and copies meet by (sum, id), so a text or id of a third of all rows is no hot key.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    mask = sum((F.when(c, 1 << FILTERS.index(k)).otherwise(0) for k, c in conditions(F.col("text"), F.col("words")).items()), F.lit(0))
    told = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    told = told.withColumn("words", words(F.col("text"))).select("id", "part", F.unhex(F.sha2("text", 256)).alias("sha"), mask.alias("mask"))
    told = cut(told.groupBy("id", "part", "sha", "mask").agg(F.count(F.lit(1)).alias("n")))
    known = told.where("id IS NOT NULL")
    first = known.groupBy("sha").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    marked = cut(
        labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id"))
        .agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    )
    copies = F.when(F.col("first"), 0).otherwise(1 << FILTERS.index("E"))
    known = known.join(first, ["sha", "id"], "left").withColumn("mask", F.col("mask") + copies).drop("first", "sha").join(marked, "id", "left")
    rest = told.where("id IS NULL").select("id", "part", "mask", "n", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    both = known.select("id", "part", "mask", "n", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")).unionByName(rest)
    return both.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def edges(counted: DataFrame, n_filters: int = len(FILTERS)) -> DataFrame:
    """The counts of every part over every edge ``(subset, filter)`` of the lattice of ``n_filters`` filters."""
    lattice = [(s, k) for s in range(1 << n_filters) for k in range(n_filters) if not s >> k & 1]
    every = F.array(*[F.struct(F.lit(s).alias("subset"), F.lit(k).alias("filter")) for s, k in lattice])
    dealt = counted.withColumn("edge", F.explode(every)).select("part", "mask", "n", "good", "toxic", "edge.*")
    own = F.expr("shiftleft(1, filter)")
    fails = F.col("mask").bitwiseAND(own) != 0
    gone = F.col("mask").bitwiseAND(F.col("subset")) != 0
    alone = F.col("mask") == own
    total = lambda where: F.sum(F.when(where, F.col("n")).otherwise(0))
    sums = (~gone & ~fails, ~gone & fails, gone & fails, alone, ~gone & fails & F.col("good"), ~gone & fails & F.col("toxic"))
    return dealt.groupBy("part", "subset", "filter").agg(*[total(w).alias(c) for c, w in zip(COUNTS, sums, strict=True)])


def paths(summed: DataFrame, filters: str = FILTERS) -> DataFrame:
    """The steps of every order, each with its edge's counts, and each filter's Shapley total: what it removed in all orders together."""
    steps = []
    for order in permutations(range(len(filters))):
        for k, f in enumerate(order):
            steps.append(("".join(filters[x] for x in order), k + 1, sum(1 << x for x in order[:k]), f))
    table = summed.sparkSession.createDataFrame(steps, "filter_order string, step int, subset int, filter int")
    walked = summed.join(F.broadcast(table), ["subset", "filter"])  # n! * n rows, 600 for five filters
    share = walked.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return walked.join(share, ["part", "filter"]).select("part", "filter_order", "step", *COUNTS, "shapley")


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, order and step: ``kept`` after it, ``removed`` by it, ``redundant``, ``unique_fails``, ``good_lost``, ``toxic_lost``, ``shapley``."""
    return paths(cut(edges(masks(docs, labels, id_col, text_col, part_col))))


#: The same rows in DuckDB's SQL, document by document and order by order.
AUDIT_SQL = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), l AS (SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id
), f AS (
    SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t), regexp_matches(t, '[#$%&*|]'),
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS fail
    FROM d LEFT JOIN l USING (doc_id)
), o AS (
    SELECT '' AS filter_order UNION ALL SELECT filter_order || x FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(filter_order, x)
), steps AS (
    SELECT filter_order, step, ascii(filter_order[step:step]) - 64 AS k, list_transform(range(1, step), lambda i: ascii(filter_order[i:i]) - 64) AS before
    FROM o, range(1, 6) r(step) WHERE length(filter_order) = 5
), edges AS (SELECT DISTINCT k, list_sort(before) AS before FROM steps
), counted AS (SELECT part, good, toxic, fail, count(*) AS n FROM f GROUP BY ALL
), c AS (
    SELECT part, k, before, n, good, toxic, fail[k] AS fails, list_bool_or(list_transform(before, lambda i: fail[i])) AS gone, len(list_filter(fail, lambda x: x)) AS failures FROM counted, edges
), e AS (
    SELECT part, k, before,
        sum(CASE WHEN NOT coalesce(gone, false) AND NOT fails THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT coalesce(gone, false) AND fails THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN gone AND fails THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails AND failures = 1 THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN NOT coalesce(gone, false) AND fails AND good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN NOT coalesce(gone, false) AND fails AND toxic THEN n ELSE 0 END) AS toxic_lost
    FROM c GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
    CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, s.k) AS BIGINT) AS shapley
FROM steps s JOIN e ON e.k = s.k AND e.before = list_sort(s.before)
"""
