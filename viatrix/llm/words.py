"""Words and their hashes over whole Arrow batches, in numpy.

A word's hash is a polynomial in a random code of its bytes modulo 2**64, taken as a difference of
prefix sums, then mixed. Cost is a few passes over the bytes and none over Python strings.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
P = 0x9E3779B97F4A7C15 | 1
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base % 2**64))
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """Keeps the tables of powers between batches of a task."""

    def __init__(self, seed: int = 1, lower: bool = True):
        codes = np.random.default_rng(seed).integers(0, 2**64, 256, dtype=np.uint64)
        self.codes = codes[LOWER] if lower else codes
        self.up = self.down = np.zeros(0, np.uint64)

    def spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 21) -> np.ndarray:
        """64-bit hashes of data[start:end], starts ascending; many bytes go block by block, so that sums stay small."""
        if len(data) > block and len(starts):
            cuts = np.searchsorted(starts, np.arange(0, len(data) + block, block)).tolist()
            parts = [(i, j, int(starts[i]), int(ends[i:j].max())) for i, j in zip(cuts, cuts[1:]) if j > i]
            if len(parts) > 1 or parts[0][3] - parts[0][2] < len(data):
                return np.concatenate([self.spans(data[a:b], starts[i:j] - a, ends[i:j] - a, max(block, b - a)) for i, j, a, b in parts])
        n = len(data) + 1
        if len(self.up) < n:
            self.up, self.down = powers(P, n), powers(pow(P, -1, 2**64), n)
        sums = np.zeros(n, np.uint64)
        np.cumsum(self.codes[data] * self.up[: n - 1], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64) * M1)


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def split(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """starts, ends of the words between separator bytes, and the position among words at which each text begins."""
    word = np.zeros(len(data) + 2, bool)
    word[1:-1] = ~apart[data]
    edge = word[1:] != word[:-1]
    begin, end = edge & word[1:], edge & word[:-1]  # at a byte; behind a byte
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    joined = inner[word[inner] & word[inner + 1]]  # a text's end inside a run of word bytes
    begin[joined] = end[joined] = True
    starts, ends = np.flatnonzero(begin[:-1]) if len(data) else np.zeros(0, np.int64), np.flatnonzero(end)
    return starts, ends, np.searchsorted(starts, offsets)


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about so many bytes of text each (a longer text comes alone), so that memory stays bounded."""
    for batch in batches:
        _, offsets = strings(batch.column(column))
        lo = 0
        while lo < len(batch):
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of k words in each text (with fewer words, of the whole sequence), and where each text's begin."""
    counts = np.diff(first)
    many = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
    at = np.concatenate([[0], np.cumsum(many)])
    found = np.empty(at[-1], np.uint64)
    n = len(words)
    for lo in range(0, len(found), block):
        place = np.arange(lo, min(lo + block, len(found)))
        text = np.searchsorted(at, place, side="right") - 1
        where = place + (first[:-1] - at[:-1])[text]
        left = first[1:][text] - where
        out = np.full(len(place), np.uint64(0x2545F4914F6CDD1D))
        for i in range(k):
            out = out * np.uint64(P) + np.where(left <= i, np.uint64(0), words[np.minimum(where + i, n - 1)])
        found[lo : lo + len(place)] = mix(out + np.minimum(left, k).astype(np.uint64))
    return found, at
