"""Elias-Fano sequences: non-decreasing integers in about 2 + log2(universe / n) bits each.

The high bits are a unary bitmap (a one for each value, a zero for each step of the high part), the low
bits lie packed. The places of every 64th zero and every 64th one are kept, so a value's bucket and an index's
value are found by one sample and a few popcounts. All queries take numpy arrays. Parts are plain files, opened by memory map.
"""

from __future__ import annotations

import os

import numpy as np

_SAMPLE = 64
_BLOCK = 1 << 18
#: By byte * 8 + k: the place of the byte's k-th set bit.
_IN_BYTE = np.array([([i for i in range(8) if byte >> i & 1] + [0] * 8)[k] for byte in range(256) for k in range(8)], np.int64)


def save(path: str, **arrays: np.ndarray) -> None:
    """Writes arrays to one file, whole or not at all: a task that is run again replaces it."""
    temp = f"{path}.{os.getpid()}.{os.urandom(4).hex()}"
    head, at = [], 0
    for name, x in arrays.items():
        head.append(f"{name} {x.dtype.str} {len(x)} {at}")
        at += -(-x.nbytes // 64) * 64
    top = ("\n".join(head) + "\n\n").encode()
    with open(temp, "wb") as f:
        f.write(len(top).to_bytes(8, "little") + top)
        f.write(b"\0" * (-f.tell() % 64))
        for x in arrays.values():
            f.write(np.ascontiguousarray(x).tobytes())
            f.write(b"\0" * (-x.nbytes % 64))
    os.replace(temp, path)


def load(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file, memory-mapped."""
    raw = np.memmap(path, np.uint8, "r")
    n = int(raw[:8].view("<u8")[0])
    start = -(-(8 + n) // 64) * 64
    out = {}
    for line in bytes(raw[8 : 8 + n]).decode().split("\n"):
        if line:
            name, dtype, count, at = line.split()
            d = np.dtype(dtype)
            out[name] = raw[start + int(at) : start + int(at) + int(count) * d.itemsize].view(d)
    return out


def encode(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """The parts of a sequence of sorted uint64 values below ``universe``."""
    n = len(values)
    low_bits = max(0, min(56, (universe // max(1, n)).bit_length() - 1))
    values = values.astype(np.uint64)
    high = (values >> np.uint64(low_bits)).astype(np.int64)
    zeros = ((universe - 1) >> low_bits) + 1 if universe else 1
    n_bits = n + zeros
    bits = np.zeros(-(-(n_bits + 1) // 64) * 64, np.uint8)
    bits[high + np.arange(n)] = 1
    words = np.packbits(bits, bitorder="little").view("<u8")
    ones = high[::_SAMPLE] + np.arange(0, n, _SAMPLE)
    bucket = np.arange(0, zeros, _SAMPLE)
    places = bucket + np.searchsorted(high, bucket, "right")  # a bucket's zero stands behind its values
    low = np.zeros(n * low_bits // 8 + 16, np.uint8)
    for start in range(0, n if low_bits else 0, _BLOCK):
        part = values[start : start + _BLOCK] & np.uint64((1 << low_bits) - 1)
        at = np.arange(start, start + len(part), dtype=np.int64) * low_bits
        byte, shift = at >> 3, (at & 7).astype(np.uint64)
        shifted = part << shift
        for k in range((low_bits + 14) // 8):  # neighbours may share a byte
            np.bitwise_or.at(low, byte + k, (shifted >> np.uint64(8 * k)).astype(np.uint8))
    return {"meta": np.array([n, low_bits, n_bits], np.int64), "words": words, "places": places.astype(np.int64), "ones": ones.astype(np.int64), "low": low}


class Sequence:
    def __init__(self, parts: dict[str, np.ndarray], prefix: str = ""):
        self.n, self.low_bits, self.n_bits = (int(x) for x in parts[prefix + "meta"])
        self.words, self.places, self.ones, low = (np.asarray(parts[prefix + k]) for k in ("words", "places", "ones", "low"))
        self.low = np.ndarray((len(low) - 7,), "<u8", np.frombuffer(low, np.uint8), strides=(1,)) if len(low) >= 8 else None
        self.mask = np.uint64((1 << self.low_bits) - 1)

    def low_at(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i * self.low_bits
        return (self.low[at >> 3] >> (at & 7).astype(np.uint64)) & self.mask

    def zero(self, k: np.ndarray) -> np.ndarray:
        """The place of the k-th zero, from 0."""
        return self._select(k, self.places, ~np.uint64(0))

    def _select(self, k: np.ndarray, samples: np.ndarray, flip: np.uint64) -> np.ndarray:
        start = samples[k // _SAMPLE]
        word = start >> 6
        left = k % _SAMPLE + 1  # bits to go, the sampled one included
        w = (self.words[word] ^ flip) & ~((np.uint64(1) << (start & 63).astype(np.uint64)) - np.uint64(1))
        count = np.bitwise_count(w).astype(np.int64)
        short = np.flatnonzero(left > count)
        while len(short):
            left[short] -= count[short]
            word[short] += 1
            w[short] = self.words[word[short]] ^ flip
            count[short] = np.bitwise_count(w[short])
            short = short[left[short] > count[short]]
        at = np.zeros(len(k), np.int64)
        for step in (32, 16, 8):  # the byte with the left-th set bit of w
            part = np.bitwise_count(w & np.uint64((1 << step) - 1)).astype(np.int64)
            over = left > part
            at += over * step
            left -= over * part
            w >>= (over * step).astype(np.uint64)
        return word * 64 + at + _IN_BYTE[(w & np.uint64(255)).astype(np.int64) * 8 + left - 1]

    def _next(self, at: np.ndarray, flip: np.uint64) -> np.ndarray:
        """The place of the first one (of the first zero, where all bits are flipped) at or after each place."""
        word = at >> 6
        w = (self.words[word] ^ flip) & ~((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        none = np.flatnonzero(w == 0)
        while len(none):
            word[none] += 1
            w[none] = self.words[word[none]] ^ flip
            none = none[w[none] == 0]
        return word * 64 + np.bitwise_count((w & (~w + np.uint64(1))) - np.uint64(1))

    def find(self, values: np.ndarray, begin: np.ndarray | int = 0, stop: np.ndarray | None = None) -> np.ndarray:
        """The index of each value (of the first, if repeated) among those from ``begin`` to before ``stop``, or -1.

        What a value's bucket and its range have in common is searched by halving.
        """
        out = np.full(len(values), -1, np.int64)
        if not self.n or not len(values):
            return out
        values = values.astype(np.uint64)
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        low = values & self.mask
        at = np.zeros(len(values), np.int64)
        later = np.flatnonzero(high > 0)
        at[later] = self.zero(high[later] - 1) + 1
        lo, hi = np.maximum(at - high, begin), self._next(at, ~np.uint64(0)) - high
        if stop is not None:
            hi = np.minimum(hi, stop)
        end = hi.copy()
        alive = np.flatnonzero(lo < hi)
        while len(alive):
            mid = (lo[alive] + hi[alive]) >> 1
            less = self.low_at(mid) < low[alive]
            lo[alive[less]] = mid[less] + 1
            hi[alive[~less]] = mid[~less]
            alive = alive[lo[alive] < hi[alive]]
        inside = np.flatnonzero(lo < np.maximum(end, 0))
        same = inside[self.low_at(lo[inside]) == low[inside]]
        out[same] = lo[same]
        return out

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at indexes."""
        return self._value(i, self._select(i, self.ones, np.uint64(0)))

    def get_pair(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values at indexes and those behind them, as signed integers."""
        place = self._select(i, self.ones, np.uint64(0))
        return self._value(i, place).astype(np.int64), self._value(i + 1, self._next(place + 1, np.uint64(0))).astype(np.int64)

    def _value(self, i: np.ndarray, place: np.ndarray) -> np.ndarray:
        return ((place - i).astype(np.uint64) << np.uint64(self.low_bits)) | self.low_at(i)
