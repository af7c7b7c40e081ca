"""Operator 5: repeated paragraphs by MinHash banding, verified by exact Jaccard, removed by component.

Paragraphs of a text, as runs of its words (lower case; a letter of a script without spaces is a word):

- lines of at least ``MIN_WORDS`` words, and runs of shorter lines that have so many (an empty line ends one);
- windows of ``WINDOW`` words over the whole text, whatever the lines. The least hash among any ``CHOICE``
  shingles in a row says where one starts, so equal passages choose alike: of any ``PASSAGE`` words, wherever
  they stand, at least one window lies inside, and one window in 16 words is enough for all.

A paragraph is compared by its set of 5-word shingles. Its MinHash signature is cut into ``BANDS`` bands of
``ROWS`` values, which makes a pair of similarity 0.8 collide with probability 1 - (1 - 0.8^3)^7 = 0.993.
A window has one band of the first ``WINDOW_ROWS`` values: with 16 shingles, similarity 0.8 leaves room for one
that differs (0.88), so two windows are either the same but for a word at an end, or no pair at all.
Distinct paragraphs that share a band are candidates; their exact Jaccard similarity decides. Linked
paragraphs and exact copies (equal hashes of all words) form components, of which the first paragraph
(least document id, then position) stays and the others are removable. Windows of one text that belong to
the same survivor, equally far on, and touch each other are given as one span.

Candidates are all pairs of a band key that up to ``SMALL`` distinct paragraphs share. In a key of more (a
large family of edited copies, or paragraphs around one passage) each paragraph is held against the key's
commonest one. Where that leaves such a key in several components, its paragraphs are joined by exact
prefix filtering: ordered by rarity, two sets of similarity 0.8 share one of their first fifth of
shingles. Only pairs of different components are looked at, so a family that already hangs together
costs nothing, and no pair that could link two components is left out. Shingles are fetched for candidates
only, and no join carries them but the one that verifies.

Rows: null text has no paragraphs; rows of null id are left out, as nothing names them. A repeated row
repeats its paragraphs. A window that overlaps its own repeat in one text (one word over and over) counts
once. A very long line is one paragraph, read whole. Ties in commonness go to the greater hash. An empty
table gives no rows. Only id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import cut, lowered, map_arrow, portions, strings
from tracelake.llm.components import min_labels

SHINGLE = 5
SIMILARITY = 0.8
MIN_WORDS = 20
WINDOW = 20
PASSAGE = 50
CHOICE = PASSAGE - WINDOW + 1
BANDS, ROWS = 7, 3
WINDOW_ROWS = 6
SMALL = 32
#: Counters by which shingles are ordered from rare to common, and the partial sums that reach the driver.
SKETCH = 1 << 18
SUMS = 16

_SPACE, _ALONE = 1, 2
_KINDS = np.zeros(0x110000, np.uint8)
for _a, _b in ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)):  # scripts without spaces
    _KINDS[_a : _b + 1] = _ALONE
_KINDS[[c for c in range(0x3001) if chr(c).isspace()]] = _SPACE
_SEEDS = np.random.default_rng(20_24).integers(1, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """The words of texts, one text after another: places, and hashes of any run, the same wherever it stands.

    ``first`` and ``last``: start and end of each word in code points of its text; ``of``: its text; ``line``:
    its line there; ``base`` and ``ends``: each text's first word and the one after its last; ``counts``: words
    of each line of all texts; ``lines``: where each text's lines begin and end in them.
    """

    def __init__(self, texts: list[str]):
        codes = np.frombuffer("".join(lowered(t) + "\n" for t in texts).encode("utf-32-le"), np.uint32)
        kinds = np.pad(_KINDS[codes], 1, constant_values=_SPACE)
        word = kinds[1:-1] != _SPACE
        before, after = (word & ((x != 0) | (kinds[1:-1] == _ALONE)) for x in (kinds[:-2], kinds[2:]))
        first, last = np.flatnonzero(before), np.flatnonzero(after) + 1
        begin = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)))
        self.n = len(first)
        self.of = np.searchsorted(begin, first, "right") - 1
        self.ends = np.searchsorted(first, begin[1:])
        self.base = np.concatenate(([0], self.ends[:-1])).astype(np.int64)
        breaks = np.concatenate(([0], np.cumsum(codes == 10)))
        self.lines = breaks[begin]
        line = breaks[first]
        self.counts = np.bincount(line, minlength=self.lines[-1])
        self.line = line - self.lines[self.of]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * _powers(_BASE, len(codes)), dtype=np.uint64)))
        h = _mixed((sums[last] - sums[first]) * _powers(_INVERSE, len(codes))[first])
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * _powers(_BASE, len(h)), dtype=np.uint64)))
        self.back = _powers(_INVERSE, len(h) + 1)
        self.shingles = self.runs(np.arange(max(0, len(h) - SHINGLE + 1)), SHINGLE)
        self.first, self.last = first - begin[self.of], last - begin[self.of]

    def runs(self, at: np.ndarray, n) -> np.ndarray:
        """Hashes of the runs of n words that start at the given ones."""
        return _mixed((self.sums[at + n] - self.sums[at]) * self.back[at])

    def set_of(self, at: int, n: int) -> np.ndarray:
        """The distinct shingles of a run of SHINGLE words or more."""
        return np.unique(self.shingles[at : at + n - SHINGLE + 1]).view(np.int64)

    def whole(self) -> np.ndarray:
        """First word and length of every paragraph of whole lines."""
        found = [(base + a, n) for base, x, y in zip(self.base.tolist(), self.lines[:-1], self.lines[1:], strict=True) for a, n in lines_of(self.counts[x:y].tolist())]
        return np.array(found, np.int64).reshape(-1, 2)

    def windows(self) -> np.ndarray:
        """First words of windows, apart where one text repeats itself."""
        if self.n < PASSAGE:
            return np.zeros(0, np.int64)
        starts = np.flatnonzero(self.ends[self.of] - np.arange(self.n) >= PASSAGE)
        at = np.lib.stride_tricks.sliding_window_view(self.shingles, CHOICE)[: self.n - PASSAGE + 1].argmin(1)
        found = np.unique(starts + at[starts])
        return found[_apart(self.of[found], found, self.runs(found, WINDOW))]


def lines_of(counts: list[int]) -> list[tuple[int, int]]:
    """First word and length of every paragraph of whole lines, from the number of words in each line."""
    out, at, first, held = [], 0, 0, 0  # held: words of the run of short lines so far
    for n in [*counts, 0]:
        if held and (n == 0 or n >= MIN_WORDS):
            if held >= MIN_WORDS:
                out.append((first, held))
            held = 0
        if n >= MIN_WORDS:
            out.append((at, n))
        elif n:
            first = first if held else at
            held += n
        at += n
    return out


def _apart(text: np.ndarray, pos: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which windows stay, if equal ones of one text mustn't overlap."""
    order = np.lexsort((pos, hashes, text))
    same = (np.diff(hashes[order].view(np.int64), prepend=0) == 0) & (np.diff(text[order], prepend=-1) == 0)
    keep = np.ones(len(pos), bool)
    last = before = -1
    for j in np.flatnonzero(same[1:]).tolist():
        if j != before:
            last = pos[order[j]]
        keep[order[j + 1]] = pos[order[j + 1]] - last >= WINDOW
        last, before = (pos[order[j + 1]] if keep[order[j + 1]] else last), j + 1
    return keep


def _bands(least: list[np.ndarray], rows: int) -> np.ndarray:
    """Keys of bands of so many minima each, as signed longs: (paragraphs, bands)."""
    keys = []
    for k in range(0, len(least), rows):
        key = np.full(len(least[k]), k + rows, np.uint64)
        for x in least[k : k + rows]:
            key = (key ^ x) * np.uint64(_BASE)
            key ^= key >> np.uint64(32)
        keys.append(key)
    return np.stack(keys, 1).view(np.int64)


def band_keys(shingles: np.ndarray, at: np.ndarray, n: np.ndarray, lines: int) -> list[np.ndarray]:
    """Band keys of paragraphs: the first so many are lines, the others windows."""
    bounds = np.stack([at[:lines], at[:lines] + n[:lines] - SHINGLE + 1], 1).ravel()
    of_lines, of_windows = [], []
    for k in range(BANDS * ROWS if lines else WINDOW_ROWS):
        mixed = shingles * _SEEDS[0, k]
        mixed ^= mixed >> np.uint64(29)
        mixed *= _SEEDS[1, k]
        if lines:
            of_lines.append(np.minimum.reduceat(np.append(mixed, mixed[:1]), bounds)[::2])
        if lines < len(at) and k < WINDOW_ROWS:
            of_windows.append(np.lib.stride_tricks.sliding_window_view(mixed, WINDOW - SHINGLE + 1)[at[lines:]].min(1))
    return [*(_bands(of_lines, ROWS) if of_lines else ()), *(_bands(of_windows, WINDOW_ROWS) if of_windows else ())]


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", windows: bool = True) -> DataFrame:
    """Every paragraph: doc_id, para (number of its first line), pos (of its first word), start, end (code points), n_words, is_window, hash, bands."""

    def run(batch):
        ids, texts = batch.column("id").to_numpy(), strings(batch, "text")
        for a, b in portions(texts):
            words = Words(texts[a:b])
            at, n = words.whole().T
            lines = len(at)
            if windows:
                more = words.windows()
                at, n = np.concatenate((at, more)), np.concatenate((n, np.full(len(more), WINDOW)))
            if len(at):
                of = words.of[at]
                yield {
                    "doc_id": ids[a:b][of], "para": words.line[at], "pos": at - words.base[of], "start": words.first[at], "end": words.last[at + n - 1], "n_words": n,
                    "is_window": np.arange(len(at)) >= lines, "hash": words.runs(at, n).view(np.int64), "bands": band_keys(words.shingles, at, n, lines),
                }

    rows = docs.where(F.col(id_col).isNotNull())
    schema = "doc_id bigint, para int, pos int, start int, end int, n_words int, is_window boolean, hash bigint, bands array<bigint>"
    return map_arrow(rows, {"id": F.col(id_col).cast("long"), "text": F.col(text_col).cast("string")}, schema, run)


def shingles_for(wanted: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shingles of the wanted paragraphs (hash, first): (hash, shingles), read again from the text that each was first seen in."""
    places = wanted.select(F.col("first.doc_id").alias("doc"), F.struct(F.col("first.pos").alias("pos"), F.col("first.n_words").alias("n"), "hash").alias("p"))
    by_doc = cut(places.groupBy("doc").agg(F.collect_list("p").alias("places")))  # one text's paragraphs at most
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).join(by_doc, "doc")

    def run(batch):
        texts, places = strings(batch, "text"), batch.column("places").to_pylist()
        for a, b in portions(texts):
            words = Words(texts[a:b])
            asked = np.array([(k, p["pos"], p["n"], p["hash"]) for k, of in enumerate(places[a:b]) for p in of], np.int64).reshape(-1, 4)
            at = words.base[asked[:, 0]] + asked[:, 1]
            asked, at = (x[at + asked[:, 2] <= words.ends[asked[:, 0]]] for x in (asked, at))
            same = words.runs(at, asked[:, 2]).view(np.int64) == asked[:, 3]  # of rows that repeat an id, the one that has it
            yield {"hash": asked[same, 3], "shingles": [words.set_of(x, n) for x, n in zip(at[same].tolist(), asked[same, 2].tolist(), strict=True)]}

    got = map_arrow(rows, {"text": F.col("text"), "places": F.col("places")}, "hash bigint, shingles array<bigint>", run)
    once = docs.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").isEmpty()
    return cut(got if once else got.dropDuplicates(["hash"]))


def candidates(paras: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b), a < b, of hashes of distinct paragraphs that share a band, and the members (key, hash) of keys over SMALL."""
    keyed = paras.select("hash", F.explode("bands").alias("key"))
    several = keyed.groupBy("key").agg(F.min("hash").alias("lo"), F.max("hash").alias("hi")).where("lo < hi").select("key")
    shared = cut(keyed.join(several, "key"))
    members = cut(shared.groupBy("key", "hash").agg(F.count("*").alias("n")))
    sizes = cut(members.groupBy("key").agg(F.count("*").alias("size"), F.max_by("hash", F.struct("n", "hash")).alias("leader")))
    small = members.join(sizes.where(F.col("size") <= SMALL), "key").select("key", "hash")
    pairs = small.select("key", F.col("hash").alias("a")).join(small.select("key", F.col("hash").alias("b")), "key").where("a < b").select("a", "b")
    large = members.join(sizes.where(F.col("size") > SMALL), "key")
    led = large.where("hash <> leader").select(F.least("hash", "leader").alias("a"), F.greatest("hash", "leader").alias("b"))
    return cut(pairs.union(led).distinct()), large.select("key", "hash")


def verified(pairs: DataFrame, shingles: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs whose exact Jaccard similarity is at least as given."""
    left = pairs.join(shingles.select(F.col("hash").alias("a"), F.col("shingles").alias("sa")), "a")
    both = left.join(shingles.select(F.col("hash").alias("b"), F.col("shingles").alias("sb")), "b")
    inside = F.size(F.array_intersect("sa", "sb"))
    return both.where(inside >= similarity * (F.size("sa") + F.size("sb") - inside)).select("a", "b")


def _commonness(sets: DataFrame):
    """Roughly how many sets hold each shingle: counts by hash in ``SKETCH`` slots, summed over tasks. Of fixed size, so broadcast."""

    def count(batches):
        counts = np.zeros(SKETCH, np.uint32)
        for batch in batches:
            flat = pa.ListArray.flatten(batch.column(0)).to_numpy().view(np.uint64)
            np.add.at(counts, flat % np.uint64(SKETCH), 1)
        yield pa.RecordBatch.from_pydict({"part": pa.array([int(counts.sum()) % SUMS], pa.int32()), "counts": [counts.tobytes()]})

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.uint32).astype(np.uint64) for x in group.column("counts"))
        return pa.table({"part": group.column("part")[:1], "counts": pa.array([np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes()])})

    sums = sets.select("shingles").mapInArrow(count, "part int, counts binary").groupBy("part").applyInArrow(add, "part int, counts binary").collect()  # SUMS rows at most
    return sum((np.frombuffer(r["counts"], np.uint32).astype(np.uint64) for r in sums), np.zeros(SKETCH, np.uint64))


def across(members: DataFrame, links: DataFrame, shingles: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Links between different components among the members of large keys that aren't one component.

    Any order of all shingles makes the prefix filter exact; rare ones first make it quick. The join sees a
    shingle, its place in the order and the size of its set: what follows it bounds how much two sets can share.
    """
    hashes = members.select("hash").distinct()
    labels = min_labels(links, hashes.select(F.col("hash").alias("node"), F.col("hash").alias("label")).union(links.select("a", "a")).union(links.select("b", "b")).distinct())
    labelled = cut(members.join(labels.select(F.col("node").alias("hash"), "label"), "hash", "left").withColumn("label", F.coalesce("label", "hash")))
    torn = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    rest = cut(labelled.join(torn, "key", "left_semi").select("hash", "label").distinct().join(shingles, "hash"))
    if rest.isEmpty():
        return links.where("false")
    shared = rest.sparkSession.sparkContext.broadcast(_commonness(rest))

    def prefixes(batch):
        common = shared.value
        out: dict[str, list] = {k: [] for k in ("hash", "label", "s", "k", "n")}
        for h, label, held in zip(batch.column("hash").to_pylist(), batch.column("label").to_pylist(), batch.column("shingles"), strict=True):
            x = held.values.to_numpy()
            n = len(x) - int(np.ceil(len(x) * similarity - 1e-9)) + 1
            first = x[np.lexsort((x, common[x.view(np.uint64) % np.uint64(SKETCH)]))[:n]]
            for k, v in (("hash", [h] * n), ("label", [label] * n), ("s", first.tolist()), ("k", range(n)), ("n", [len(x)] * n)):
                out[k] += v
        if out["hash"]:
            yield out

    first = cut(map_arrow(rest, {c: F.col(c) for c in ("hash", "label", "shingles")}, "hash bigint, label bigint, s bigint, k int, n int", prefixes))
    a, b = (first.select("s", *[F.col(c).alias(f"{side}_{c}") for c in ("hash", "label", "k", "n")]) for side in "ab")
    most = F.least(F.expr("a_n - a_k"), F.expr("b_n - b_k"))
    like = (F.least("a_n", "b_n") >= similarity * F.greatest("a_n", "b_n")) & (most * (1 + similarity) >= similarity * (F.col("a_n") + F.col("b_n")) - 1e-9)
    pairs = a.join(b, (a["s"] == b["s"]) & (F.col("a_hash") < F.col("b_hash")) & (F.col("a_label") != F.col("b_label")) & like).select(F.col("a_hash").alias("a"), F.col("b_hash").alias("b"))
    return verified(cut(pairs.distinct()), shingles, similarity)


def spans_of(found: DataFrame) -> DataFrame:
    """Windows of one text and one survivor, equally far on, that touch each other, as one row."""
    place = Window.partitionBy("doc_id", "cluster_doc", "ahead").orderBy("pos")  # one text's windows at most
    moved = found.withColumn("ahead", F.col("cluster_pos") - F.col("pos"))
    new = (F.col("pos") > F.lag("pos").over(place) + WINDOW).cast("int")
    run = moved.withColumn("new", F.coalesce(new, F.lit(0))).withColumn("run", F.sum("new").over(place))
    out = run.groupBy("doc_id", "cluster_doc", "ahead", "run").agg(
        F.min("para").alias("para"), F.min("start").alias("start"), F.max("end").alias("end"), (F.max("pos") - F.min("pos") + WINDOW).cast("int").alias("n_words"), F.min("cluster_para").alias("cluster_para"), F.max("copies").alias("copies"), F.max("removed").alias("removed")
    )
    return out.select("doc_id", "para", "start", "end", "n_words", "cluster_doc", "cluster_para", "copies", "removed")


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, windows: bool = True) -> DataFrame:
    """Every paragraph that has a copy or near copy, a row each; with ``windows``, those too, joined to spans.

    Columns: ``doc_id``, ``para`` (line), ``start``, ``end``, ``n_words``, ``cluster_doc`` and ``cluster_para``
    (the paragraph that stays), ``copies`` (paragraphs of the component) and ``removed``.
    """
    paras = cut(paragraphs(docs, id_col, text_col, windows))
    pairs, members = candidates(paras)
    wanted = pairs.select(F.col("a").alias("hash")).union(pairs.select("b")).distinct().withColumn("wanted", F.lit(True))
    counts = paras.groupBy("hash").agg(F.min(F.struct("doc_id", "pos", "para", "n_words")).alias("first"), F.count("*").alias("n"))
    kept = cut(counts.join(cut(wanted), "hash", "left").where("n > 1 or wanted"))  # what may be in a component
    shingles = shingles_for(kept.where("wanted"), docs, id_col, text_col)
    edges = cut(verified(pairs, shingles, similarity))
    if not members.isEmpty():
        edges = edges.union(across(members, edges, shingles, similarity))
    linked = min_labels(edges, kept.where("wanted").select(F.col("hash").alias("node"), F.col("hash").alias("label")))
    named = kept.join(linked, kept["hash"] == linked["node"], "left").select("hash", F.coalesce("label", "hash").alias("component"), "first", "n")
    named = cut(named)
    totals = cut(named.groupBy("component").agg(F.min("first").alias("stays"), F.sum("n").alias("copies")).where("copies > 1"))
    final = cut(named.select("hash", "component").join(totals, "component").select("hash", "stays", "copies"))
    place = F.struct("doc_id", "pos")
    found = paras.drop("bands").join(final, "hash").select(
        "doc_id", "para", "pos", "start", "end", "n_words", "is_window", F.col("stays.doc_id").alias("cluster_doc"), F.col("stays.pos").alias("cluster_pos"), F.col("stays.para").alias("cluster_para"), "copies", (place != F.struct("stays.doc_id", "stays.pos")).alias("removed")
    )
    whole = found.where("not is_window")
    if not windows:
        return whole.drop("is_window", "pos", "cluster_pos")
    found = cut(found)
    return found.where("not is_window").drop("is_window", "pos", "cluster_pos").unionByName(spans_of(found.where("is_window")))
