"""Operator 10: byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token's bytes are a doubly linked list. For every merge rank there is a bucket of list
positions; a three-level bitmap marks the buckets in use, and find-first-set on it gives the next
rank. An entry whose pair has changed since it was queued is stale and skipped. A merge costs
O(log) whatever the length, so a pre-token of a megabyte is no special case.

Rows: null text is the empty text, which has no ids. Repeated rows are encoded independently.
An empty table gives an empty table. Only the id and text columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from heapq import heappop, heappush

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import hold, map_arrow, strings

#: Pre-tokens whose ids a Python worker remembers; beyond it, the older half is forgotten.
CACHE_ENTRIES = 600_000
#: Longer pre-tokens are not remembered.
CACHE_CHARS = 40

# Below U+0250 the categories L and N and white space are these; the standard library's engine takes
# them as classes and is faster than one that looks categories up. Other texts take the given pattern.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_BEYOND = re.compile("[^\x00-ɏ]")


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def latin_pattern(pattern: str) -> str:
    """The same pattern with the categories written out for characters below U+0250."""
    out = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{_S}{_L}{_N}]").replace(r"\p{L}", f"[{_L}]").replace(r"\p{N}", f"[{_N}]")
    return out.replace(r"\s+(?!\S)", f"[{_S}]+(?![^{_S}])").replace(r"\s+", f"[{_S}]+")


class RankQueue:
    """Least rank first, then least position."""

    def __init__(self, n_ranks: int):
        self.buckets: dict[int, list[int]] = {}
        self.low = [0] * ((n_ranks >> 6) + 1)
        self.mid = [0] * ((n_ranks >> 12) + 1)
        self.top = 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [position]
            self.low[rank >> 6] |= 1 << (rank & 63)
            self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
            self.top |= 1 << (rank >> 12)
        else:
            heappush(bucket, position)

    def pop(self) -> tuple[int, int]:
        """The next rank and position, or (-1, -1)."""
        top = self.top
        if not top:
            return -1, -1
        a = (top & -top).bit_length() - 1
        m = self.mid[a]
        b = a << 6 | (m & -m).bit_length() - 1
        w = self.low[b]
        rank = b << 6 | (w & -w).bit_length() - 1
        bucket = self.buckets[rank]
        position = heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            self.low[b] = w = w & (w - 1)
            if not w:
                self.mid[a] = m = m & (m - 1)
                if not m:
                    self.top = top & (top - 1)
        return rank, position


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.queue = RankQueue(len(self.tokens))
        self.any = regex.compile(pattern)
        self.latin = re.compile(latin_pattern(pattern))
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        ranks, n = self.ranks, len(piece)
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        part: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank_at: list[int] = [-1] * n
        queue = self.queue
        push, pop, get = queue.push, queue.pop, ranks.get
        for i in range(n - 1):
            if (r := get(piece[i : i + 2])) is not None:
                rank_at[i] = r
                push(r, i)
        while True:
            rank, i = pop()
            if rank < 0:
                break
            if rank_at[i] != rank:  # stale
                continue
            j = after[i]
            part[i] = merged = part[i] + part[j]
            k = after[i] = after[j]
            rank_at[j] = -1
            if k < n:
                before[k] = i
                r = get(merged + part[k])
                if r is None:
                    rank_at[i] = -1
                else:
                    rank_at[i] = r
                    push(r, i)
            else:
                rank_at[i] = -1
            if (h := before[i]) >= 0:
                r = get(part[h] + merged)
                if r is None:
                    rank_at[h] = -1
                elif r != rank_at[h]:
                    rank_at[h] = r
                    push(r, h)
        out, i = [], 0
        while i < n:
            out.append(ranks[part[i]])
            i = after[i]
        return out

    def ids_bytes(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        pieces = (self.any if _BEYOND.search(text) else self.latin).findall(text)
        young, old = self.young, self.old
        try:
            return b"".join([young[p] for p in pieces])
        except KeyError:
            pass
        out = []
        for p in pieces:
            if (x := young.get(p)) is None:
                if (x := old.get(p)) is None:
                    x = np.array(self.merge(p.encode()), "<u4").tobytes()
                if len(p) <= CACHE_CHARS:
                    if len(young) >= CACHE_ENTRIES // 2:
                        self.old = old = young
                        self.young = young = {}
                    young[p] = x
            out.append(x)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Ids of every text, and the text decoded from them.

    Returns the id column, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, with ``keep_ids``,
    ``ids`` (array of int). The rank file is read on the driver and broadcast: it is a fixed
    vocabulary, whose size has nothing to do with the corpus, and is checked.
    """
    ranks = load_ranks(ranks_path)
    if len(ranks) > 2_000_000:
        raise ValueError(f"{ranks_path} has {len(ranks)} ranks; a vocabulary of 2,000,000 at most is broadcast")
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    key = (ranks_path, len(ranks), pattern)
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batch):
        c = hold(key, lambda: Codec(shared.value, pattern))
        names = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids
        out: dict[str, list] = {id_col: batch.column("id")} | {k: [] for k in names}
        for text in strings(batch, "text"):
            ids = c.ids_bytes(text)
            out["n_tokens"].append(len(ids) // 4)
            out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(c.decode(ids)).hexdigest())
            if keep_ids:
                out["ids"].append(np.frombuffer(ids, "<i4"))
        yield out

    schema = f"`{id_col}` {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return map_arrow(df, {"id": F.col(id_col), "text": F.col(text_col).cast("string")}, schema, run)
