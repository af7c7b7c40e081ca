"""Operator 6: toxicity by a linear-chain conditional random field over words.

Two states, clean and toxic, along sequences of ``SEQUENCE`` words. Every word has features: itself, its
beginnings of 4 to 8 letters, its end, the word before and the word after it, hashed into ``SIZE`` weights.
Labels are of documents, so labels of words are taken in two steps. At first, words of toxic documents with
a feature that (over the sample) stands almost only in such documents count as toxic, all other words as
clean. The field fitted to those tags the toxic documents again, by all features and transitions, and is
fitted to what it found (``REFITS`` times). Weights are fitted by gradient ascent on the conditional
likelihood. A document's score is a calibrated sum of its words' forward-backward marginals, as far as they
are over ``FLOOR``, and words above a half give the offending offsets.

The fit is on a bounded sample: ``SAMPLE_ROWS`` labelled rows of each class, by least hash of the id. Tasks
read them whole, count their features, tag their words, and send the driver the sequences to fit: those with
a toxic word and one in ``PLAIN`` of the others, at most ``SAMPLE_SEQUENCES`` of a text, by hash. Scoring
reads every text whole.

Rows: null and empty texts are scored as texts without words. Labels of null id or value don't count; a
repeated label row counts again, and of differing ones the greatest counts. Without labels of both classes
every score is the share of label 1 (0 without labels). Empty documents give no rows. Of documents only id
and text are read; ``keep_clean`` carries the other columns along.
"""

from __future__ import annotations

import re
import uuid
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import cut, hold, lowered, map_arrow, portions, slices, strings

SAMPLE_ROWS = 4000
SAMPLE_SEQUENCES = 128
THRESHOLD = 0.7
#: A feature marks words as toxic if it stands in so many toxic documents of the sample at least, in
#: such a share of them (rarer ones are chance and copies), and so purely.
MIN_DOCS = 4
MIN_SHARE = 0.01
MIN_PURITY = 0.95
#: Words of a line that tells copies.
COPY_WORDS = 20
#: Words of a sequence.
SEQUENCE = 48
#: Sequences that are summed over at a time.
BLOCK = 4096
#: Of sequences without a word taken for toxic, one in so many is fitted.
PLAIN = 8
STEPS, REFIT_STEPS, REFITS = 60, 20, 1
#: Marginals up to this are noise, which long texts would add up.
FLOOR = 0.1
SIZE = 1 << 20
#: Words whose features a worker remembers.
REMEMBERED = 150_000

_WORD = re.compile(r"[^\W\d_]+")
_BEGINNINGS = (4, 5, 6, 7, 8)
#: Features of a word: it and its beginnings, its end; then what it says of the next word and of the one before.
_OWN, _BEFORE, _AFTER = len(_BEGINNINGS) + 2, len(_BEGINNINGS) + 2, len(_BEGINNINGS) + 3


def words_of(text: str) -> list[str]:
    return _WORD.findall(lowered(text))


def features_of(word: str) -> list[int]:
    """The weights that a word asks for; SIZE, which is always 0, where it is too short."""
    names = ["=" + word, *("^" + word[:k] if len(word) > k else "" for k in _BEGINNINGS), "$" + word[-3:] if len(word) > 3 else "", "<" + word, ">" + word]
    return [xxhash.xxh3_64_intdigest(n) & (SIZE - 1) if n else SIZE for n in names]


def ratios(emissions: np.ndarray, ends: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """exp(emission) and, toxic to clean, the forward and backward messages: (words, sequences) each.

    ``ends``: words of each sequence; behind them a backward message is 1.
    """
    a = np.exp(trans)
    psi = np.exp(np.clip(emissions, -30, 30))
    ahead, back = np.empty_like(psi), np.ones_like(psi)
    ahead[0] = psi[0]
    for j in range(1, len(psi)):
        ahead[j] = psi[j] * (a[0, 1] + ahead[j - 1] * a[1, 1]) / (a[0, 0] + ahead[j - 1] * a[1, 0])
    for j in range(len(psi) - 2, -1, -1):
        v = psi[j + 1] * back[j + 1]
        back[j] = np.where(ends > j + 1, (a[1, 0] + a[1, 1] * v) / (a[0, 0] + a[0, 1] * v), 1.0)
    return psi, ahead, back


def marginals(ahead: np.ndarray, back: np.ndarray) -> np.ndarray:
    return ahead * back / (1 + ahead * back)


class Sequences:
    """Words of texts cut into sequences: where each word stands, the padded width and the length of each."""

    def __init__(self, sizes: np.ndarray):
        n = -(-sizes // SEQUENCE)
        first = np.cumsum(n) - n
        at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.of = np.repeat(first, sizes) + at // SEQUENCE
        self.at = at % SEQUENCE
        self.n = int(n.sum())
        self.ends = np.bincount(self.of, minlength=self.n)

    def emissions(self, own: np.ndarray, before: np.ndarray, after: np.ndarray, bias: float) -> np.ndarray:
        """(words, sequences), from what each word says of itself, of the next word and of the one before."""
        e = own + bias
        if len(e) > 1:
            same = self.of[1:] == self.of[:-1]
            e[1:] += before[:-1] * same
            e[:-1] += after[1:] * same
        out = np.zeros((SEQUENCE, self.n))
        out[self.at, self.of] = e
        return out


@dataclass
class Model:
    """Weights of the field and of the calibration."""

    rate: float = 0.0
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    bias: float = 0.0
    transitions: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    slope: float = 0.0
    offset: float = 0.0
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def said(self, words: list[str]) -> np.ndarray:
        """For each word what it says of itself, the next and the one before: (words, 3)."""
        ids, values = hold(("toxicity", self.key), lambda: ({}, np.zeros((REMEMBERED, 3))))
        distinct = set(words)
        new = [w for w in distinct if w not in ids]
        if len(ids) + len(new) > len(values):
            ids.clear()
            new = list(distinct)
            if len(new) > len(values):  # one text with very many distinct words
                return self.of_features(np.array([features_of(w) for w in words]))
        if new:
            values[len(ids) : len(ids) + len(new)] = self.of_features(np.array([features_of(w) for w in new]))
            ids.update(zip(new, range(len(ids), len(ids) + len(new)), strict=True))
        return values[np.fromiter(map(ids.__getitem__, words), np.int64, len(words))]

    def of_features(self, features: np.ndarray) -> np.ndarray:
        w = self.weights[features]
        return np.stack([w[:, :_OWN].sum(1, dtype=float), w[:, _BEFORE], w[:, _AFTER]], 1)

    def tag(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The probability of toxic for each word of the texts, and the number of words of each text."""
        sizes = np.array([len(t) for t in texts], np.int64)
        if not len(self.weights) or not sizes.sum():
            return np.zeros(sizes.sum()), sizes
        said = self.said([w for t in texts for w in t])
        seq = Sequences(sizes)
        _, ahead, back = ratios(seq.emissions(*said.T, self.bias), seq.ends, self.transitions)
        return marginals(ahead, back)[seq.at, seq.of], sizes

    def scores(self, tagged: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        p, sizes = tagged
        if not len(self.weights):
            return np.full(len(sizes), self.rate)
        return 1 / (1 + np.exp(-(self.slope * mass(p, sizes) + self.offset)))


def mass(p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """log(1 + expected toxic words) of each text."""
    over = np.maximum(0, p - FLOOR) / (1 - FLOOR)
    return np.log1p(np.bincount(np.repeat(np.arange(len(sizes)), sizes), over, len(sizes)))


class Block:
    """Some of the sequences to fit: their words as indexes of distinct ones, and their targets."""

    def __init__(self, ends: np.ndarray, flat: np.ndarray, gold: np.ndarray):
        self.seq, self.flat, self.gold = Sequences(ends), flat, gold
        self.inner = np.arange(1, SEQUENCE)[:, None] < self.seq.ends
        self.same = self.seq.of[1:] == self.seq.of[:-1]

    def pairs(self) -> np.ndarray:
        """How often each target follows each in a sequence."""
        padded = np.zeros((SEQUENCE, self.seq.n))
        padded[self.seq.at, self.seq.of] = self.gold
        return np.array([[np.sum((padded[:-1] == a) & (padded[1:] == b) & self.inner) for b in (0, 1)] for a in (0, 1)], float)

    def expected(self, now: Model, said: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The expected ``pairs``, and by distinct word what targets exceed marginals by: of the word, the one behind and the one before."""
        psi, ahead, back = ratios(self.seq.emissions(*said[self.flat].T, now.bias), self.seq.ends, now.transitions)
        a, v, r = np.exp(now.transitions), psi[1:] * back[1:], ahead[:-1]
        joint = np.stack([np.full_like(v, a[0, 0]), a[0, 1] * v, a[1, 0] * r, a[1, 1] * r * v])
        residual = self.gold - marginals(ahead, back)[self.seq.at, self.seq.of]
        known = len(said)
        by_word = [np.bincount(self.flat, residual, known), np.bincount(self.flat[:-1], residual[1:] * self.same, known), np.bincount(self.flat[1:], residual[:-1] * self.same, known)]
        return (joint / joint.sum(0) * self.inner).sum((1, 2)).reshape(2, 2), np.stack(by_word)


def _ascend(model: Model, words: pa.Array, ends: np.ndarray, gold: np.ndarray, steps: int) -> Model:
    """Weights that make the targets likely: Adam on the penalised conditional likelihood, from those of ``model``.

    ``words`` and ``gold``: all sequences one after the other; ``ends``: the length of each. Each step sums over
    blocks of sequences, so that memory is that of one block and of the words.
    """
    coded = words.dictionary_encode()
    flat = coded.indices.to_numpy()
    features = np.array([features_of(w) for w in coded.dictionary.to_pylist()], np.int32)
    at = np.concatenate(([0], np.cumsum(ends)))
    blocks = [Block(ends[k : k + BLOCK], *(x[at[k] : at[min(k + BLOCK, len(ends))]] for x in (flat, gold))) for k in range(0, len(ends), BLOCK)]
    pairs = sum(b.pairs() for b in blocks)
    theta = np.concatenate((model.weights.astype(float), [model.bias], model.transitions.ravel()))
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        now = Model(0.0, theta[: SIZE + 1], theta[SIZE + 1], theta[SIZE + 2 :].reshape(2, 2), key="")
        said = now.of_features(features)
        expected, by_word = np.zeros((2, 2)), np.zeros((3, len(features)))
        for b in blocks:
            for total, part in zip((expected, by_word), b.expected(now, said), strict=True):
                total += part
        of_feature = sum(np.bincount(features[:, k], x, SIZE + 1) for k, x in enumerate([by_word[0]] * _OWN + [by_word[1], by_word[2]]))
        grad = np.concatenate([of_feature, [by_word[0].sum()], (pairs - expected).ravel()])
        grad[SIZE] = 0
        grad = grad / len(ends) - 1e-4 * theta
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        theta = theta + 0.15 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-6)
        theta[SIZE] = 0
    return Model(model.rate, theta[: SIZE + 1].astype(np.float32), float(theta[SIZE + 1]), theta[SIZE + 2 :].reshape(2, 2))


def _calibrated(model: Model, x: np.ndarray, labels: np.ndarray, rate: float) -> Model:
    """The field with a logistic curve over log(1 + expected toxic words), fitted at the true share of label 1."""
    y = labels.astype(float)
    n1 = y.sum()
    weight = np.where(y > 0, rate / n1, (1 - rate) / (len(y) - n1)) * len(y)
    design = np.stack([x, np.ones_like(x)], 1)
    theta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ theta))
        grad = design.T @ (weight * (y - p)) - 0.05 * theta
        hess = (design * (weight * p * (1 - p))[:, None]).T @ design + 0.05 * np.eye(2)
        theta = theta + np.linalg.solve(hess, grad)
    return Model(rate, model.weights, model.bias, model.transitions, float(theta[0]), float(theta[1]))


def held_out(id_col: Column) -> Column:
    """Rows that no model is fitted on."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fits the field on a bounded sample of labelled documents that aren't held out: tasks read and tag texts, the driver gets sequences."""
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("string").alias("id"), F.col("toxic").cast("int").alias("y")).where("id is not null and y is not null").where(~held_out(F.col("id")))
    counts = {r["y"]: r["count"] for r in known.groupBy(F.col("y").isin(1).cast("int").alias("y")).count().collect()}
    rate = counts.get(1, 0) / max(1, sum(counts.values()))
    once = known.groupBy("id").agg(F.max((F.col("y") == 1).cast("int")).alias("y"))
    chosen = [(r["id"], y) for y in (0, 1) for r in once.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample_rows).collect()]
    if not chosen:
        return Model(rate)
    picked = F.broadcast(spark.createDataFrame(chosen, "__id string, __y int"))  # 2 * sample_rows ids at most
    texts = docs.select(F.col("doc_id").cast("string").alias("__id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(picked, "__id")
    texts = cut(texts.select(F.col("__id").alias("id"), F.col("__y").alias("y"), "text", F.monotonically_increasing_id().alias("row")))
    texts, n1, n0 = _without_copies(texts)
    if not n1 or not n0:
        return Model(rate)
    pure = _pure_features(texts, n1, n0)
    if not pure:
        return Model(rate)
    model = Model(rate, np.zeros(SIZE + 1, np.float32), -2.0)
    for k in range(REFITS + 1):
        model = _ascend(model, *_sequences(texts, pure, model if k else None), REFIT_STEPS if k else STEPS)
    shared = spark.sparkContext.broadcast(model)

    def masses(batch):
        yield {"id": batch.column("id"), "y": batch.column("y"), "x": mass(*shared.value.tag([words_of(t) for t in strings(batch, "text")]))}

    found = sorted(tuple(r) for r in map_arrow(texts, {c: F.col(c) for c in ("id", "y", "text")}, "id string, y int, x double", masses).collect())
    return _calibrated(model, np.array([x for _, _, x in found]), np.array([y for _, y, _ in found]), rate)


def _without_copies(texts: DataFrame) -> tuple[DataFrame, int, int]:
    """Copies count once, and so do near copies: texts of a class that share a line of ``COPY_WORDS`` words. And the rows of each class."""

    def lines(batch):
        held = [[x for x in t.split("\n") if x.count(" ") >= COPY_WORDS - 1] or [t] for t in strings(batch, "text")]
        yield {c: batch.column(c) for c in ("id", "y", "row")} | {"lines": [np.array([xxhash.xxh3_64_intdigest(x) for x in of], np.uint64).view(np.int64) for of in held]}

    rows = map_arrow(texts, {c: F.col(c) for c in ("id", "y", "row", "text")}, "id string, y int, row bigint, lines array<bigint>", lines).collect()
    seen: set[tuple[int, int]] = set()
    keep = []
    for r in sorted(rows, key=lambda r: (r["id"], r["lines"])):
        own = {(r["y"], h) for h in r["lines"]}
        if seen.isdisjoint(own):
            keep.append((r["row"], r["y"]))
        seen |= own
    kept = texts.join(F.broadcast(texts.sparkSession.createDataFrame([(k,) for k, _ in keep], "row bigint")), "row") if keep else texts.where("false")
    n1 = sum(y for _, y in keep)
    return cut(kept), n1, len(keep) - n1


def _pure_features(texts: DataFrame, n1: int, n0: int) -> frozenset[int]:
    """Features that stand almost only in toxic documents; their number is bounded by MIN_SHARE."""

    def count(batch):
        y = np.array(batch.column("y").to_pylist())
        counts = np.zeros((2, SIZE + 1), np.int32)
        for label, text in zip(y, strings(batch, "text"), strict=True):
            stems = {f for w in set(words_of(text)) for f in features_of(w)[: _OWN - 1]}
            counts[label, list(stems)] += 1
        counts[:, SIZE] = 0
        used = np.flatnonzero(counts.any(0))
        yield {"feature": used, "n0": counts[0, used], "n1": counts[1, used]}

    counted = map_arrow(texts, {"y": F.col("y"), "text": F.col("text")}, "feature int, n0 bigint, n1 bigint", count).groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    inside, outside = F.col("n1") / n1, (F.col("n0") + 0.5) / n0
    found = counted.where((F.col("n1") >= max(MIN_DOCS, MIN_SHARE * n1)) & (inside >= MIN_PURITY * (inside + outside)))
    return frozenset(r["feature"] for r in found.select("feature").collect())


def _sequences(texts: DataFrame, pure: frozenset[int], model: Model | None) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The sequences to fit: their words, lengths and targets. Words of toxic documents are toxic by a pure feature, or as ``model`` tags them."""
    shared = texts.sparkSession.sparkContext.broadcast((pure, model))

    def run(batch):
        pure, model = shared.value
        toxic_words: dict[str, bool] = {}
        out: dict[str, list] = {k: [] for k in ("id", "k", "words", "gold")}
        for doc, y, text in zip(batch.column("id").to_pylist(), batch.column("y").to_pylist(), strings(batch, "text"), strict=True):
            words = words_of(text)
            gold = np.zeros(len(words), bool)
            if y:
                toxic_words |= {w: not pure.isdisjoint(features_of(w)[: _OWN - 1]) for w in set(words) - toxic_words.keys()}
                gold[:] = [toxic_words[w] for w in words]
                if model is not None:
                    gold |= model.tag([words])[0] > 0.5
            order = [(xxhash.xxh3_64_intdigest(f"{doc} {k}"), k) for k in range(-(-len(words) // SEQUENCE))]
            fits = [(h, k) for h, k in order if gold[k * SEQUENCE : (k + 1) * SEQUENCE].any() or h % PLAIN == 0]
            for _, k in sorted(fits)[:SAMPLE_SEQUENCES]:
                for c, v in (("id", doc), ("k", k), ("words", words[k * SEQUENCE : (k + 1) * SEQUENCE]), ("gold", gold[k * SEQUENCE : (k + 1) * SEQUENCE])):
                    out[c].append(v)
        yield out

    found = map_arrow(texts, {c: F.col(c) for c in ("id", "y", "text")}, "id string, k int, words array<string>, gold array<boolean>", run).toArrow().sort_by([("id", "ascending"), ("k", "ascending")])
    words, gold = (found.column(c).combine_chunks() for c in ("words", "gold"))
    if isinstance(words, pa.ChunkedArray):
        words, gold = (pa.concat_arrays(x.chunks) for x in (words, gold))
    return words.flatten(), np.diff(words.offsets.to_numpy()).astype(np.int64), gold.flatten().to_numpy(zero_copy_only=False).astype(float)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, ``score`` and ``spans`` (array of start, end) of words likelier toxic than not."""
    id_type = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch):
        m = shared.value
        for a, b in portions(texts := strings(batch, "text")):
            p, sizes = tagged = m.tag([words_of(t) for t in texts[a:b]])
            spans = [[] for _ in sizes]
            ends = np.cumsum(sizes)
            toxic = np.flatnonzero(p > 0.5)
            of = np.searchsorted(ends, toxic, "right")
            for k in np.unique(of).tolist():
                here = {*(toxic[of == k] - (ends[k] - sizes[k])).tolist()}
                spans[k] = [dict(zip(("start", "end"), x.span(), strict=True)) for i, x in enumerate(_WORD.finditer(lowered(texts[a + k]))) if i in here]
            yield {id_col: batch.column("id").slice(a, b - a), "score": m.scores(tagged), "spans": spans}

    return map_arrow(docs, {"id": F.col(id_col), "text": F.col(text_col).cast("string")}, f"`{id_col}` {id_type}, score double, spans array<struct<start:int,end:int>>", run)


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in slices(batches):
            for a, b in portions(texts := strings(batch, "text")):
                scores = m.scores(m.tag([words_of(t) for t in texts[a:b]]))
                yield batch.slice(a, b - a).filter(pa.array(scores < threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def crc32(doc_id) -> int:
    """The hash that parts rows, for tests."""
    return zlib.crc32(str(doc_id).encode())


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns."""
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
