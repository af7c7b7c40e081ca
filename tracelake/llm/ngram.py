"""Operator 4: language-model scores from an Elias-Fano n-gram trie.

Level 1 of the trie holds the words (by 64-bit hash) with their counts, level 2 the successors of each
word, level n the successors of each node of level n - 1, up to ``order``. All are dealt into shards by hash
and written, as Elias-Fano sequences, to the shared folder, where scoring tasks map them into memory. Where the
successors of each context begin is a monotone sequence (the pointers), and the successors, made
monotone by adding (rank of the context) * (number of words), are another; a word is searched in the range
between its context's pointers only. In level 2 the contexts present in a shard are a sequence of their own. From
level 3 a node's successors lie in the node's own shard, so its place there is the rank and no context is kept.
A node keeps its smoothed log10 probability in 16 bits, and from level 2 each context its weight in 16 bits.

Smoothing is by Dirichlet priors, one a level: P(w | h) = (c(hw) + K * P(w | h')) / (c(h) + K), h' being h without
its first word, which sums to 1, with P(w) = (c(w) + 0.1) / (N + 0.1 * (V + 1)). Unseen successors take the c(hw) = 0
form, unseen contexts leave P(w | h'). A text's first word follows an end; no context reaches back beyond that end.

Counting: each task counts the n-grams of its documents, a level a pass, and sends packed arrays to the shards,
one row a chunk of text and shard, so an n-gram that stands in every document is one entry a chunk. No
n-gram is dropped. Shards hold about ``SHARD_BYTES`` of text each, however large the corpus.

Rows: null text is empty: its one token is the end. Rows of null id are trained on. Repeated rows
count again. Without training rows all probabilities are those of N = V = 0. An empty table gives no
rows. Only id and text are read. The shared folder must be a mounted path (file:), as files in it are
mapped.
"""

from __future__ import annotations

import os
import uuid
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm import eliasfano
from tracelake.llm.common import map_arrow, shared_dir, utf8

#: K of level 2, of level 3 and so on: there is one level more than priors.
PRIORS = (20.0, 5.0)
ADD = 0.1
SHARD_BYTES = 16_000_000
#: Bytes of text that a task holds as arrays at a time (one longer text goes alone).
CHUNK_BYTES = 6_000_000
_END = b"\n"  # no word holds white space
_CODES = 65_535
_LOW = -16.0  # log10 of the least probability that a node can keep
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LONG = 64
_IN_WORD = np.array([not bytes([b]).isspace() for b in range(256)], np.int8)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(10)) == 0, F.lit(False))


def indexed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all texts as indexes of distinct tokens, the sorted hashes of those, and the number of tokens of each text."""
    raw = _END.join([*texts, b""]).lower() + bytes(8)
    buffer = np.frombuffer(raw, np.uint8)
    word = np.zeros(len(buffer) + 1, np.int8)
    word[1:-8] = _IN_WORD[buffer[:-8]]
    edge = np.diff(word[:-7])
    starts, ends = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
    of_text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts], dtype=np.int64), starts, "right")
    sizes = np.bincount(of_text, minlength=len(texts)).astype(np.int64) + 1
    keys = np.full(len(starts) + len(texts), _END_HASH, np.uint64)
    keys[np.arange(len(starts)) + of_text] = _hashed(raw, starts, ends - starts)
    known, index = np.unique(keys, return_inverse=True)
    return index, known, sizes


def _hashed(raw: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, eight bytes of all of them at a time; words of over ``_LONG`` bytes by XXH3. Eight bytes follow the last word."""
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    out = sizes.astype(np.uint64) * _MIX
    left, at, which = sizes, starts, np.arange(len(sizes))
    for _ in range(0, _LONG, 8):
        spare = np.maximum(64 - 8 * left, 0).astype(np.uint64)
        x = (out[which] ^ (eight[at] << spare)) * _MIX
        out[which] = x ^ (x >> np.uint64(29))
        more = np.flatnonzero(left > 8)
        if not len(more):
            break
        left, at, which = left[more] - 8, at[more] + 8, which[more]
    out *= _MIX
    out ^= out >> np.uint64(32)
    for k in np.flatnonzero(sizes > _LONG).tolist():
        out[k] = xxhash.xxh3_64_intdigest(raw[starts[k] : starts[k] + sizes[k]])
    return out


_END_HASH = _hashed(_END + bytes(8), np.array([0]), np.array([1]))[0]


def chunks(batch: pa.RecordBatch):
    """The batch in slices of about CHUNK_BYTES of text: (slice, texts)."""
    texts = utf8(batch, "text")
    start = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > CHUNK_BYTES:
            yield batch.slice(start, k - start), texts[start:k]
            start, size = k, 0
        size += len(t)
    if start < len(texts):
        yield batch.slice(start), texts[start:]


def _pack(keys: np.ndarray) -> bytes:
    """Sorted keys by their differences, which compress well."""
    return _planes(np.diff(keys, prepend=np.uint64(0)), "<u8")


def _unpack(planes: bytes) -> np.ndarray:
    return np.cumsum(_of_planes(planes, "<u8"), dtype=np.uint64)


def _shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (((keys * _MIX) >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)


def _by_shard(where: np.ndarray, shards: int):
    """(shard, its places in order) of each shard that has some."""
    where = where.astype(np.min_scalar_type(shards))  # two bytes and less are sorted by radix
    order = np.argsort(where, kind="stable")
    ends = np.searchsorted(where[order], np.arange(shards + 1))
    for k in np.flatnonzero(np.diff(ends)).tolist():
        yield k, order[ends[k] : ends[k + 1]]


def _planes(values: np.ndarray, kind: str) -> bytes:
    """The values byte by byte, compressed."""
    x = values.astype(kind)
    return zstandard.compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes(), 1)


def _of_planes(planes: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(planes), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _values(column, kind: str) -> np.ndarray:
    return np.concatenate([_of_planes(x.as_py(), kind) for x in column])


def _dealt(keys: np.ndarray, counts: np.ndarray, where: np.ndarray, shards: int, lower: np.ndarray | None = None) -> dict:
    """Keys and counts, packed for each shard that has some. ``lower``: the kept probability after the shorter context."""
    used, parts = zip(*_by_shard(where, shards)) if len(where) else ((), ())
    return {
        "shard": np.array(used, np.int64), "keys": [_pack(keys[p]) for p in parts], "counts": [_planes(counts[p], "<u4") for p in parts],
        "lower": [None if lower is None else _planes(lower[p], "<u2") for p in parts],
    }


def _merged(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Distinct keys, summed counts and ``lower`` of a shard's rows."""
    keys = np.concatenate([_unpack(x.as_py()) for x in group.column("keys")])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]) != 0)
    counts = np.add.reduceat(_values(group.column("counts"), "<u4")[order].astype(np.int64), first)
    lower = None if group.column("lower").null_count else _values(group.column("lower"), "<u2")[order[first]]
    return keys[first], counts, lower


def _code(p: np.ndarray) -> np.ndarray:
    """log10 probabilities in 16 bits."""
    return np.clip(np.rint((p - _LOW) * (_CODES / -_LOW)), 0, _CODES).astype("<u2")


def _log10(codes: np.ndarray) -> np.ndarray:
    return codes * (-_LOW / _CODES) + _LOW


_ROW = "shard int, keys binary, counts binary, lower binary"


class Level1:
    """The words: global number and count by hash. Numbers follow the shards and, in them, the hashes."""

    def __init__(self, folder: str, shards: int, offsets: list[int]):
        self.folder, self.shards, self.offsets = folder, shards, np.array(offsets, np.int64)

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers (-1: unknown) and counts."""
        numbers, counts = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        for k, at in _by_shard(_shard_of(keys, self.shards), self.shards):
            if (found := _level1_file(self.folder, k)) is not None:
                i = found[0].find(keys[at])
                at, i = at[i >= 0], i[i >= 0]
                numbers[at], counts[at] = i + self.offsets[k], found[1][i]
        return numbers, counts

    def count_of(self, numbers: np.ndarray) -> np.ndarray:
        where = np.searchsorted(self.offsets, numbers, "right") - 1
        out = np.zeros(len(numbers), np.int64)
        for k in np.unique(where).tolist():
            at = where == k
            out[at] = _level1_file(self.folder, k)[1][numbers[at] - self.offsets[k]]
        return out


@lru_cache(4096)
def _level1_file(folder: str, k: int):
    path = f"{folder}/words-{k}"
    if not os.path.exists(path):
        return None
    parts = eliasfano.load(path)
    return eliasfano.Sequence(parts), parts["counts"]


@lru_cache(4096)
def _level2_file(folder: str, k: int):
    path = f"{folder}/pairs-{k}"
    if not os.path.exists(path):
        return None
    parts = eliasfano.load(path)
    return tuple(eliasfano.Sequence(parts, p) for p in ("contexts_", "pointers_", "successors_")) + (parts["codes"],)


@lru_cache(4096)
def _deep_file(folder: str, level: int, k: int):
    path = f"{folder}/level{level}-{k}"
    if not os.path.exists(path):
        return None
    parts = eliasfano.load(path)
    return tuple(eliasfano.Sequence(parts, p) for p in ("pointers_", "successors_")) + (parts["codes"], parts["weights"])


class Walk:
    """A chunk of texts down the trie: of each token its text, word and log10 probability, and its deepest n-gram's node."""

    def __init__(self, model: Model, texts: list[bytes], order: int):
        index, known, self.sizes = indexed(texts)
        numbers, counts = model.words.look_up(np.append(known, _END_HASH))
        self.after, self.counts = numbers[:-1][index], counts[:-1][index]
        self.base = model.base(self.counts)
        starts = np.cumsum(self.sizes) - self.sizes
        self.p = self.base
        if order > 1:
            self._pairs(model, numbers[-1], counts[-1])
        for level in range(3, order + 1):
            self._deeper(model, level, starts)

    def _pairs(self, model: Model, end: int, ends: int) -> None:
        prior = model.priors[0]
        before, context = np.concatenate(([end], self.after[:-1])), np.concatenate(([ends], self.counts[:-1]))
        self.p = np.log10(prior / (context + prior)) + self.base
        self.shard, self.node = np.zeros(len(before), np.int32), np.full(len(before), -1, np.int64)
        both = np.flatnonzero((before >= 0) & (self.after >= 0))
        if len(both):
            v = np.uint64(model.v)
            keys, which = np.unique(before[both].astype(np.uint64) * v + self.after[both].astype(np.uint64), return_inverse=True)
            shard, node, kept = model.pairs((keys // v).astype(np.int64), (keys % v).astype(np.int64))
            self.shard[both], self.node[both] = shard[which], node[which]
            kept = kept[which]
            self.p[both] = np.where(np.isnan(kept), self.p[both], kept)

    def parents(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens whose context has a node (a text's first one has none), and that node's shard and place."""
        node = np.concatenate(([-1], self.node[:-1]))
        node[starts] = -1
        at = np.flatnonzero(node >= 0)
        return at, self.shard[at - 1], node[at]

    def _deeper(self, model: Model, level: int, starts: np.ndarray) -> None:
        at, shard, parent = self.parents(starts)
        node, kept, weight = model.successors(level, shard, parent, self.after[at])
        self.p = self.p.copy()
        self.p[at] = np.where(node >= 0, kept, self.p[at] + weight)
        self.shard, self.node = self.shard.copy(), np.full(len(self.node), -1, np.int64)
        self.shard[at], self.node[at] = shard, node


class Model:
    """What a task needs to open the trie: its folder and sizes."""

    def __init__(self, folder: str, shards: int, offsets: list[int], n: int, v: int, priors: tuple[float, ...]):
        self.folder, self.shards, self.offsets, self.n, self.v, self.priors = folder, shards, offsets, n, v, priors

    @property
    def words(self) -> Level1:
        return Level1(self.folder, self.shards, self.offsets)

    @property
    def order(self) -> int:
        return 1 + len(self.priors)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10(counts + ADD) - np.log10(self.n + ADD * (self.v + 1))

    def pairs(self, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of pairs of known words: shard, place in it (-1: the trie has none) and kept log10 probability (nan)."""
        where = _shard_of(before.astype(np.uint64) * np.uint64(self.v) + after.astype(np.uint64), self.shards)
        node, out = np.full(len(before), -1, np.int64), np.full(len(before), np.nan)
        for k, at in _by_shard(where, self.shards):
            if (found := _level2_file(self.folder, k)) is None:
                continue
            contexts, pointers, successors, codes = found
            distinct, which = np.unique(before[at], return_inverse=True)
            rank = contexts.find(distinct.astype(np.uint64))
            begin, end = pointers.get_pair(np.maximum(rank, 0))
            has = rank[which] >= 0
            at, which = at[has], which[has]
            i = successors.find(rank[which].astype(np.uint64) * np.uint64(self.v) + after[at].astype(np.uint64), begin[which], end[which])
            good = i >= 0
            node[at[good]], out[at[good]] = i[good], _log10(codes[i[good]])
        return where, node, out

    def successors(self, level: int, shard: np.ndarray, parent: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of words (-1: unknown) after nodes of the level above: place (-1: the trie has none), kept log10 probability and the context's log10 weight."""
        node, out, weight = np.full(len(parent), -1, np.int64), np.full(len(parent), np.nan), np.zeros(len(parent))
        for k, at in _by_shard(shard, self.shards):
            if (found := _deep_file(self.folder, level, k)) is None:
                continue
            pointers, words, codes, weights = found
            at = at[np.argsort(parent[at])]  # neighbours in the files come one after the other
            weight[at] = _log10(weights[parent[at]])
            at = at[after[at] >= 0]
            first = np.diff(parent[at], prepend=-1) != 0
            which = np.cumsum(first) - 1
            begin, end = pointers.get_pair(parent[at[first]])
            i = words.find(parent[at].astype(np.uint64) * np.uint64(self.v) + after[at].astype(np.uint64), begin[which], end[which])
            good = i >= 0
            node[at[good]], out[at[good]] = i[good], _log10(codes[i[good]])
        return node, out, weight


def _write_words(folder: str):
    def run(group: pa.Table) -> pa.Table:
        k = group.column("shard")[0].as_py()
        keys, counts, _ = _merged(group)
        eliasfano.save(f"{folder}/words-{k}", **eliasfano.encode(keys, 1 << 64), counts=_narrow(counts))
        return pa.table({"shard": pa.array([k], pa.int32()), "distinct": pa.array([len(keys)], pa.int64()), "total": pa.array([int(counts.sum())], pa.int64())})

    return run


def _narrow(counts: np.ndarray) -> np.ndarray:
    """In as few bytes as the greatest one needs."""
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0))))


def _write_pairs(model: Model):
    def run(group: pa.Table) -> pa.Table:
        k = group.column("shard")[0].as_py()
        keys, counts, _ = _merged(group)
        v = np.uint64(model.v)
        before, after = (keys // v).astype(np.int64), (keys % v).astype(np.int64)
        contexts, first, rank = np.unique(before, return_index=True, return_inverse=True)
        words = model.words
        distinct, which = np.unique(after, return_inverse=True)
        k2 = model.priors[0]
        prior = k2 * 10 ** model.base(words.count_of(distinct))[which]
        p = np.log10((counts + prior) / (words.count_of(contexts)[rank] + k2))
        eliasfano.save(
            f"{model.folder}/pairs-{k}",
            **{f"contexts_{n}": x for n, x in eliasfano.encode(contexts, model.v).items()},
            **{f"pointers_{n}": x for n, x in eliasfano.encode(np.append(first, len(keys)), len(keys) + 1).items()},
            **{f"successors_{n}": x for n, x in eliasfano.encode(rank.astype(np.uint64) * v + after.astype(np.uint64), len(contexts) * model.v).items()},
            codes=_code(p),
        )
        return pa.table({"shard": pa.array([k], pa.int32()), "distinct": pa.array([len(keys)], pa.int64()), "total": pa.array([int(counts.sum())], pa.int64())})

    return run


def _write_deep(model: Model, level: int, parents: list[int]):
    def run(group: pa.Table) -> pa.Table:
        k = group.column("shard")[0].as_py()
        keys, counts, lower = _merged(group)
        v, prior = np.uint64(model.v), model.priors[level - 2]
        parent = (keys // v).astype(np.int64)
        pointers = np.searchsorted(parent, np.arange(parents[k] + 1))
        total = np.diff(np.concatenate(([0], np.cumsum(counts)))[pointers])  # of each parent's successors
        p = np.log10((counts + prior * 10 ** _log10(lower)) / (total[parent] + prior))
        eliasfano.save(
            f"{model.folder}/level{level}-{k}",
            **{f"pointers_{n}": x for n, x in eliasfano.encode(pointers, len(keys) + 1).items()},
            **{f"successors_{n}": x for n, x in eliasfano.encode(keys, parents[k] * model.v).items()},
            codes=_code(p),
            weights=_code(np.log10(prior / (total + prior))),
        )
        return pa.table({"shard": pa.array([k], pa.int32()), "distinct": pa.array([len(keys)], pa.int64()), "total": pa.array([int(counts.sum())], pa.int64())})

    return run


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", priors: tuple[float, ...] = PRIORS) -> Model:
    """Counts the rows that aren't held out and writes the trie, of one level more than ``priors``."""
    spark = docs.sparkSession
    url = urlparse(shared_dir(spark))
    if url.scheme not in ("", "file"):
        raise ValueError(f"the trie is memory-mapped: spark.checkpoint.dir must be a mounted path, not {url.scheme}:")
    folder = f"{url.path.rstrip('/')}/trie-{uuid.uuid4().hex}"
    os.makedirs(folder)
    rows = docs.where(~held_out(F.col(id_col))).select(F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(16, -(-size // SHARD_BYTES))
    stats = "shard int, distinct bigint, total bigint"

    def words(batch):
        for _, texts in chunks(batch):
            index, keys, _ = indexed(texts)
            counts = np.bincount(index, minlength=len(keys))
            yield _dealt(keys, counts, _shard_of(keys, shards), shards)

    level1 = map_arrow(rows, {"text": F.col("text")}, _ROW, words, None).groupBy("shard").applyInArrow(_write_words(folder), stats).collect()
    sizes = _sizes(level1, shards)
    offsets = np.concatenate(([0], np.cumsum(sizes)[:-1])).tolist()
    model = Model(folder, shards, offsets, sum(r["total"] for r in level1), sum(sizes), priors)

    def pairs(batch):
        # a text's first word follows the end of the text before it, which stands for its start
        end = model.words.look_up(np.array([_END_HASH]))[0].astype(np.uint64)
        for _, texts in chunks(batch):
            index, known, _ = indexed(texts)
            numbers = model.words.look_up(known)[0].astype(np.uint64)[index]
            keys, counts = np.unique(np.concatenate((end, numbers[:-1])) * np.uint64(model.v) + numbers, return_counts=True)
            yield _dealt(keys, counts, _shard_of(keys, shards), shards)

    def deeper(level):
        def run(batch):
            for _, texts in chunks(batch):
                walk = Walk(model, texts, level - 1)
                at, shard, parent = walk.parents(np.cumsum(walk.sizes) - walk.sizes)
                key = parent.astype(np.uint64) * np.uint64(model.v) + walk.after[at].astype(np.uint64)
                order = np.argsort(key)
                key, shard = key[order], shard[order]
                # where shards take turns within a key, their entries are more than one, which adds up in the shard
                first = np.flatnonzero((np.diff(key, prepend=~key[:1]) != 0) | (np.diff(shard, prepend=-1) != 0))
                yield _dealt(key[first], np.diff(np.append(first, len(key))), shard[first], shards, _code(walk.p[at[order[first]]]))

        return run

    level = pairs
    write = _write_pairs(model)
    for n in range(2, model.order + 1 if model.v else 0):
        done = map_arrow(rows, {"text": F.col("text")}, _ROW, level, None).groupBy("shard").applyInArrow(write, stats).collect()
        level, write = deeper(n + 1), _write_deep(model, n + 1, _sizes(done, shards)) if n < model.order else None
    return model


def _sizes(stats: list, shards: int) -> list[int]:
    found = {r["shard"]: r["distinct"] for r in stats}
    return [found.get(k, 0) for k in range(shards)]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batch):
        for part, texts in chunks(batch):
            walk = Walk(model, texts, model.order)
            row = np.repeat(np.arange(len(texts)), walk.sizes)
            n = len(texts)
            yield {
                id_col: part.column("id"), "held_out": part.column("held_out"), "n_tokens": walk.sizes, "n_known": np.bincount(row, walk.counts > 0, n).astype(np.int64),
                "train_tokens": np.full(n, model.n, np.int64), "base_score": np.bincount(row, walk.base, n), "score": np.bincount(row, walk.p, n),
            }

    schema = f"`{id_col}` {id_type}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return map_arrow(docs, {"id": F.col(id_col), "held_out": held_out(F.col(id_col)), "text": F.col(text_col).cast("string")}, schema, run, None)
