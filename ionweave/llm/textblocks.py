"""Arrow string columns as byte arrays: words, word hashes and shingles.

All word classes of this subpackage are defined on ASCII bytes, so UTF-8 bytes
can be classified one by one.  A block is a slice of a record batch whose texts
hold at most ``BLOCK_BYTES`` bytes (one longer text makes a block of its own),
which bounds the memory of every kernel by the block or the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2 << 20

#: Bytes with A-Z folded to a-z.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
_MASK = np.array([0] + [(1 << 8 * k) - 1 for k in range(1, 9)], np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)

#: Bytes between words: space, tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes between alphanumeric words (once A-Z are lower case).
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[48:58] = NOT_ALNUM[65:91] = NOT_ALNUM[97:123] = NOT_ALNUM[128:] = False


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, in place where it can be."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one large_string array without nulls (null becomes empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("")


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each text in them."""
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batch: pa.RecordBatch, text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold at most ``limit`` bytes, one row at least."""
    lengths = np.diff(buffers(strings(batch.column(text)))[1])
    ends = np.cumsum(lengths)
    start = 0
    while start < len(lengths):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(start, end - start)
        start = end


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end) of data, eight bytes at a time."""
    words = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    left = ends - starts
    h = left.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (words[starts] & _MASK[np.minimum(left, 8)])) * _STEP
    longer = np.flatnonzero(left > 8)
    at, left = starts[longer] + 8, left[longer] - 8
    while len(longer):
        x = h[longer]
        x ^= x >> np.uint64(32)
        h[longer] = (x ^ (words[at] & _MASK[np.minimum(left, 8)])) * _STEP
        more = left > 8
        longer, at, left = longer[more], at[more] + 8, left[more] - 8
    return mix(h)


class Words:
    """The words of a block: where each starts and ends, its text and its hash."""

    def __init__(self, texts: pa.Array, between: np.ndarray = SPACE, hashed: bool = True):
        data, offsets = buffers(texts)
        n = len(data)
        self.data, self.offsets, self.n_texts = data, offsets, len(offsets) - 1
        gap = between[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        first = ~gap
        last = first.copy()
        if n:
            first[1:] &= gap[:-1] | edge[1:-1]
            last[:-1] &= gap[1:] | edge[1:-1]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        #: Index of the first word of each text, and the number of all words.
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        if hashed:
            self.hashes = span_hashes(FOLD[data], self.starts, self.ends)

    def of_text(self) -> np.ndarray:
        """The text's index for each word."""
        return np.repeat(np.arange(self.n_texts), self.counts)


def shingles(words: Words, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of k consecutive words for each text; of all its words if it has fewer."""
    h, out = words.hashes, []
    n = len(h)
    rolled = np.zeros(max(n - k + 1, 0), np.uint64)
    for j in range(k):
        rolled *= np.uint64(0x9FB21C651E98DF25)
        rolled += h[j : j + len(rolled)]
    rolled = mix(rolled)
    for a, c in zip(words.first[:-1].tolist(), words.counts.tolist(), strict=True):
        if c >= k:
            out.append(np.unique(rolled[a : a + c - k + 1]))
        elif c:
            x = np.zeros(1, np.uint64)
            for j in range(c):
                x = x * np.uint64(0x9FB21C651E98DF25) + h[a + j : a + j + 1]
            out.append(mix(x + np.uint64(c)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
