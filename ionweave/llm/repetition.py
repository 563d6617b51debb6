"""Quality rules by repetition: maximal repeated word sequences from a suffix array of each text.

A task takes texts block by block.  Words get exact ranks within their text,
prefix doubling sorts all suffixes of the block's texts at once (a suffix ends
with its text), and the ranks kept for each power of two give the longest common
prefixes of neighbours.  Intervals of that array whose words before differ are
the maximal repeats; the union of their spans and the longest of them decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import bound_batches
from .textblocks import SPACE, Words, blocks, span_hashes, strings

#: Words of the shortest repeat that counts.
MIN_WORDS = 8
#: Texts of fewer words fail, and texts of which repeats cover more than this share of the words.
LEAST_WORDS, WORD_SHARE = 20, 0.30
#: The verdict beyond these: share of the words' code points that repeats cover, and words of the longest repeat.
CHAR_SHARE, LONGEST = 0.30, 100

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_CONTINUED = np.zeros(256, bool)
_CONTINUED[128:192] = True


def _same(data: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> bool:
    """Whether the spans that start at a and at b are equal, each over its length."""
    eights = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    masks = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
    while len(a):
        if np.any((eights[a] ^ eights[b]) & masks[np.minimum(lengths, 8)]):
            return False
        more = lengths > 8
        a, b, lengths = a[more] + 8, b[more] + 8, lengths[more] - 8
    return True


def classes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each span of data, equal for equal bytes only: hashes bring them together, bytes decide."""
    h = span_hashes(data, starts, ends)
    order = np.argsort(h, kind="stable")
    first = np.concatenate([[True], h[order[1:]] != h[order[:-1]]]) if len(h) else np.zeros(0, bool)
    group = np.cumsum(first) - 1
    leader = order[np.flatnonzero(first)][group] if len(h) else order
    lengths = ends - starts
    out = np.empty(len(h), np.int64)
    out[order] = group
    if np.array_equal(lengths[order], lengths[leader]) and _same(data, starts[order], starts[leader], lengths[order]):
        return out
    raw, known = data.tobytes(), {}  # two spans of one hash: number them by their bytes
    return np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)


def suffix_array(symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The order of all suffixes, and their ranks by their first 1, 2, 4, ... symbols.

    A suffix goes up to ``ends`` of its position; the symbols of different texts
    must differ.  Ranks are positions in the order, so a rank stays when its
    suffix is told apart from all others, and only the rest is sorted again.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    new = np.concatenate([[True], symbols[order[1:]] != symbols[order[:-1]]]) if n else np.zeros(0, bool)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, width = [rank], 1
    alone = new & np.concatenate([new[1:], [True]]) if n else new
    active = order[~alone]  # in the order of their ranks
    while len(active):
        after = active + width
        inside = after < ends[active]
        key = rank[active] * (n + 1) + np.where(inside, rank[np.minimum(after, n - 1)] + 1, 0)
        by_key = np.argsort(key, kind="stable")
        own, sorted_key = active[by_key], key[by_key]
        group = rank[own]
        starts_group = np.concatenate([[True], group[1:] != group[:-1]])
        at = np.arange(len(own))
        place = group + at - np.maximum.accumulate(np.where(starts_group, at, 0))
        new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
        order[place] = own
        rank = rank.copy()
        rank[own] = place[np.maximum.accumulate(np.where(new, at, 0))]
        levels.append(rank)
        width *= 2
        active = own[~(new & np.concatenate([new[1:], [True]]))]
    return order, levels


def common_prefixes(order: np.ndarray, levels: list[np.ndarray], ends: np.ndarray, least: int) -> np.ndarray:
    """Length of the longest common prefix of each suffix and the one before it in the order, 0 where below ``least``."""
    lcp = np.zeros(len(order), np.int64)
    base = least.bit_length() - 1
    if len(levels) <= base:
        return lcp
    at = 1 + np.flatnonzero(levels[base][order[1:]] == levels[base][order[:-1]])
    a, b = order[at - 1].copy(), order[at].copy()
    stop, total = np.maximum(a, b), np.zeros(len(at), np.int64)
    stop = ends[stop] - stop  # words of the shorter suffix
    for k in range(len(levels) - 1, -1, -1):
        ok = total < stop
        i, j = np.where(ok, a + total, 0), np.where(ok, b + total, 0)
        total += np.where(ok & (levels[k][i] == levels[k][j]), 1 << k, 0)
    lcp[at] = np.where(total >= least, total, 0)
    return lcp


def maximal_repeats(order: np.ndarray, lcp: np.ndarray, differs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position the length of the longest maximal repeat that starts there (0: none), and how many repeats start first there.

    ``differs`` says for each place in the order whether the symbol before its
    suffix is another than that before the suffix one place earlier.  Intervals
    of lcp are closed from the inside; a suffix waits until one of its intervals
    is maximal on the left, too, so each is touched once.
    """
    cover, found = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
    changes = np.cumsum(differs)
    inside = np.flatnonzero(lcp)
    if not len(inside):
        return cover, found
    breaks = np.flatnonzero(np.diff(inside) > 1) + 1
    for run in np.split(inside, breaks):
        left = int(run[0]) - 1
        heights = [*lcp[run].tolist(), 0]
        change = changes[left : left + len(heights)].tolist()
        places, lengths, counts = [], [], []
        waiting = [0]
        stack: list[tuple[int, int]] = []  # length and first place of open intervals
        for k, height in enumerate(heights):  # between places k and k + 1 of the run
            first = k
            while stack and stack[-1][0] > height:
                length, first = stack.pop()
                if change[k] > change[first]:
                    counts.append(first)
                    while waiting and waiting[-1] >= first:
                        places.append(waiting.pop())
                        lengths.append(length)
            if height and (not stack or stack[-1][0] < height):
                stack.append((height, first))
            waiting.append(k + 1)
        cover[order[left + np.array(places, np.int64)]] = lengths
        np.add.at(found, order[left + np.array(counts, np.int64)], 1)
    return cover, found


def measures(texts: pa.Array, least: int = MIN_WORDS) -> tuple[dict[str, np.ndarray], list[np.ndarray]]:
    """The counts of each text, and the spans (first and last + 1 word) that its repeats of ``least`` words or more cover."""
    words = Words(texts, hashed=False)
    data, offsets = words.data, words.offsets

    def per_text(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
        return upto[bounds[1:]] - upto[bounds[:-1]]

    points = np.concatenate([[0], np.cumsum(~_CONTINUED[data], dtype=np.int64)])
    length = points[words.ends] - points[words.starts]
    out = {"n_words": words.counts.astype(np.int64), "word_chars": per_text(length, words.first), "n_symbols": per_text(_SYMBOL[data], offsets)}

    # lines: between line feeds and the texts' ends
    cut = np.flatnonzero(data == 10)
    starts, ends = np.sort(np.concatenate([offsets[:-1], cut + 1])), np.sort(np.concatenate([cut, offsets[1:]]))
    text = np.searchsorted(offsets, starts, "right") - 1
    text = np.where(starts == ends, np.minimum(text, words.n_texts - 1), text)
    has_word = np.searchsorted(words.starts, starts) < np.searchsorted(words.starts, ends)
    starts, ends, text = starts[has_word], ends[has_word], text[has_word]
    key = text * (len(starts) + 1) + classes(data, starts, ends)
    out["n_dup_lines"] = np.bincount(text, minlength=words.n_texts) - np.bincount(text[np.unique(key, return_index=True)[1]], minlength=words.n_texts)

    n, of_text = len(words.starts), words.of_text()
    symbols = of_text * (n + 1) + classes(data, words.starts, words.ends)
    last = words.first[1:][of_text]
    order, levels = suffix_array(symbols, last)
    lcp = common_prefixes(order, levels, last, least)
    starts_text = np.isin(order, words.first[:-1])
    before = symbols[np.maximum(order - 1, 0)]
    differs = np.ones(n, bool)
    if n:
        differs[1:] = starts_text[1:] | starts_text[:-1] | (before[1:] != before[:-1])
    cover, found = maximal_repeats(order, lcp, differs)
    begins = np.flatnonzero(cover)
    change = np.bincount(begins, minlength=n + 1) - np.bincount(begins + cover[begins], minlength=n + 1)
    covered = np.cumsum(change)[:n] > 0
    out["n_repeat_words"] = per_text(covered, words.first)
    out["repeat_chars"] = per_text(length * covered, words.first)
    out["n_repeats"] = per_text(found, words.first)
    longest = np.zeros(words.n_texts, np.int64)
    np.maximum.at(longest, of_text[begins], cover[begins])
    out["longest_repeat"] = longest

    # runs of covered words, cut where a text ends
    edge = np.zeros(n + 1, bool)
    edge[words.first] = True
    opens = covered & (~np.concatenate([[False], covered[:-1]]) | edge[:-1]) if n else covered
    closes = covered & (~np.concatenate([covered[1:], [False]]) | edge[1:]) if n else covered
    a, b = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    spans = np.column_stack([a, b]) - words.first[:-1][of_text[a]][:, None] if len(a) else np.zeros((0, 2), np.int64)
    return out, np.split(spans, np.searchsorted(a, words.first[1:-1]))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "repeat_chars", "n_repeats", "longest_repeat")


def measured(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """doc_id, the counts of each whole text, and repeat_spans: the word spans that its maximal repeats of ``least`` words or more cover.

    Null texts count as empty, and empty ones have counts of 0.  Words and lines
    are compared with case, byte by byte.  Each row is taken by itself: repeated
    rows and ids, null ids and other columns change nothing.  A long text is held
    by one task, with about 100 bytes for each of its words.
    """
    if least < 1:
        raise ValueError("a repeat has one word at least")
    bound_batches(docs.sparkSession)
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("repeat_spans", T.ArrayType(span))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch) if batch.num_rows else ():
                counts, spans = measures(strings(part.column("text")), least)
                flat = np.concatenate(spans) if spans else np.zeros((0, 2), np.int64)
                ends = np.cumsum([0, *map(len, spans)])
                pairs = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["start", "end"])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(counts[c], pa.int64()) for c in COUNTS), lists], names=["doc_id", *COUNTS, "repeat_spans"])

    return docs.select("doc_id", "text").mapInArrow(scan, schema)


def base_failed() -> Column:
    """Too few words, or too many of them in repeats; over the columns of measured."""
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > round(100 * WORD_SHARE) * F.col("n_words"))


def is_kept(char_share: float = CHAR_SHARE, longest: int = LONGEST) -> Column:
    """Whether a text passes the base rules, its repeats cover at most ``char_share`` of its words' code points, and none has more than ``longest`` words."""
    return ~base_failed() & (100 * F.col("repeat_chars") <= round(100 * char_share) * F.col("word_chars")) & (F.col("longest_repeat") <= longest)
