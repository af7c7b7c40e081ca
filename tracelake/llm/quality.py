"""Operator 7: quality rules, line first, in DataFrame functions only.

Every line is judged by itself: end punctuation, navigation, symbols, shouting and boilerplate.
Lines that fail are removed, and a document that loses more than ``MAX_LOSS_PERCENT`` of its word
characters is rejected, as is one that fails the base rules (fewer than 50 words, or over half of
its words in repeated 3-word windows).

Rows: null text is empty, has no words and fails. Lines without a word neither pass nor fail.
Repeated rows are judged alike. An empty table gives no rows. Only id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_LOSS_PERCENT = 50
#: A line is navigation with as many separators as this for each 100 words, and three at least.
SEPARATORS_PER_100_WORDS = 25
#: A line fails with more symbols for each 100 word characters.
SYMBOLS_PER_100_CHARS = 10
#: Boilerplate phrases fail lines of at most so many words.
BOILERPLATE_WORDS = 40

SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\f\r"
_ENDS = ".!?:;…。！？؟।\"'”’»)]"
_SEPARATORS = "|›•·"
_BOILERPLATE = (
    "lorem ipsum", "javascript", "terms of use", "terms of service", "privacy policy", "cookie policy", "uses cookies", "use of cookies", "use cookies",
    "all rights reserved", "skip to content", "click here", "read more", "sign up", "log in", "subscribe to", "share this", "follow us", "back to top",
)


def _without(c: Column, chars: str) -> Column:
    for x in chars:
        c = F.replace(c, F.lit(x), F.lit(""))
    return c


def _words(c: Column) -> Column:
    for x in SPACE[1:]:
        c = F.replace(c, F.lit(x), F.lit(" "))
    return F.array_remove(F.split(c, " "), "")


def _flags(text: Column) -> Column:
    """What lines of a text can fail by, asked once a text: a text without separators has no navigation."""
    lower = F.lower(text)
    boilerplate = F.lit(False)
    for x in _BOILERPLATE:
        boilerplate = boilerplate | F.contains(lower, F.lit(x))
    separators = F.lit(False)
    for x in _SEPARATORS:
        separators = separators | F.contains(text, F.lit(x))
    symbols = F.lit(False)
    for x in SYMBOLS:
        symbols = symbols | F.contains(text, F.lit(x))
    return F.struct(boilerplate.alias("boilerplate"), separators.alias("separators"), symbols.alias("symbols"))


def line_fails(line: Column, flags: Column) -> Column:
    """Whether a line that has a word is removed."""
    n_words = F.char_length(line) - F.char_length(F.replace(line, F.lit(" "), F.lit(""))) + 1
    separators = F.char_length(line) - F.char_length(_without(line, _SEPARATORS))
    symbols = F.char_length(line) - F.char_length(_without(line, SYMBOLS))
    boilerplate = F.lower(line).rlike("|".join(_BOILERPLATE))
    return (
        ~F.contains(F.lit(_ENDS), F.substring(F.rtrim(line, F.lit(SPACE)), -1, 1))
        | (flags["separators"] & (separators >= 3) & (separators * 100 >= n_words * SEPARATORS_PER_100_WORDS))
        | (flags["symbols"] & (symbols * 100 > F.char_length(_without(line, SPACE)) * SYMBOLS_PER_100_CHARS))
        | ((F.upper(line) == line) & (F.lower(line) != line) & (n_words >= 5))
        | (flags["boilerplate"] & (n_words <= BOILERPLATE_WORDS) & boilerplate)
    )


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, the base measures, ``base_failed``, ``lost_chars`` and ``kept``."""
    df = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__t"))
    df = df.withColumns({"__w": _words(F.col("__t")), "__l": F.filter(F.split("__t", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")})
    df = df.withColumns({"n_words": F.size("__w").cast("long"), "word_chars": F.char_length(F.array_join("__w", "")).cast("long"), "n_symbols": (F.char_length("__t") - F.char_length(_without(F.col("__t"), SYMBOLS))).cast("long"), "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long")})
    # a window by the 64-bit hash of its words; positions only where some hash repeats
    df = df.withColumn("__h", F.expr("CASE WHEN n_words >= 3 THEN slice(transform(__w, (w, i) -> xxhash64(w, get(__w, i + 1), get(__w, i + 2))), 1, int(n_words) - 2) ELSE array() END"))
    df = df.withColumn("__s", F.expr("CASE WHEN size(array_distinct(__h)) < size(__h) THEN sort_array(transform(__h, (h, i) -> struct(h, i))) END"))
    df = df.withColumn("__p", F.expr("sort_array(filter(transform(__s, (x, k) -> CASE WHEN x.h = get(__s, k - 1).h OR x.h = get(__s, k + 1).h THEN x.i END), x -> x IS NOT NULL))"))
    df = df.withColumn("n_repeat_words", F.expr("coalesce(aggregate(__p, struct(0L AS n, -3 AS last), (a, p) -> struct(a.n + least(3, p - a.last) AS n, p AS last), a -> a.n), 0L)"))
    df = df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    df = df.withColumn("__f", _flags(F.col("__t")))
    flags = F.col("__f")
    lost = F.aggregate("__l", F.lit(0).cast("long"), lambda a, x: a + F.when(line_fails(x, flags), F.char_length(_without(x, SPACE))).otherwise(0))
    df = df.withColumn("lost_chars", F.when(~F.col("base_failed"), lost))
    df = df.withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= MAX_LOSS_PERCENT * F.col("word_chars")))
    return df.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_chars", "kept")


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Kept documents with their failed lines removed; other columns as they are."""
    flags = _flags(F.col(text_col))
    judged = docs.withColumn("__clean", F.array_join(F.filter(F.split(text_col, "\n"), lambda x: (F.btrim(x, F.lit(SPACE)) == "") | ~line_fails(x, flags)), "\n"))
    kept = measure(docs, id_col, text_col).where("kept").select(F.col(id_col).alias("__kept")).distinct()
    return judged.join(kept, judged[id_col] == kept["__kept"], "left_semi").withColumn(text_col, F.col("__clean")).select(docs.columns)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns."""
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
