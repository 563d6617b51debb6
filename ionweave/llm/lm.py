"""Interpolated modified Kneser-Ney n-gram model of any order, counted in Spark and mapped into memory by its scorers.

Tasks count the words and n-grams of their texts with numpy and emit the counts
as arrays, one for each shard; a shard is a range of the words' hashes, and
their number follows the size of the input, so a shard's task has a bounded
amount.  An n-gram belongs to the shard of its last word but one, those with a
very frequent word there to that of the last, so no word's n-grams meet in one
task.  All n-grams that end in the same two words thus meet, and a shard derives
the continuation counts of every lower order by itself: only n-grams of the
highest order are shuffled, and the shorter ones at the begin of a text, which
keep their plain counts as nothing precedes them.  The model is a set of sorted
hash arrays with counts in the shared folder, two files a shard: one of its
n-grams, one of its words and of contexts that end in a very frequent word.  To
spare disk, n-grams are
shuffled as places in a table of the commonest words, and a shard of the model
keeps 32 bits of a hash besides those that its place says, and two bits of most
counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Arrays, map_array, map_together, save_arrays, save_together, shared_dir, written
from .textblocks import Words, blocks, mix, strings

SHARD_BYTES = 16 << 20
#: Counts that a task holds before it emits them.
HELD = 1_500_000
#: Words, the commonest, that n-grams name by their places in the shuffle; others go with their hashes.
COMMON = 1 << 22
BEGIN, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_K = np.uint64(0x9FB21C651E98DF25)
_POWERS = 1 << np.arange(63, dtype=np.int64)
_CONTEXT = ("total", "n1", "n2", "n3")
_WORD = ("count", "cont", *_CONTEXT)


def is_training(doc_id: Column) -> Column:
    """Whether a document is learned from: crc32 of its id as text (null: empty) isn't divisible by 10."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 10 != 0


def _shard(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def bigram_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(v * _K + w)


def _history(tokens: np.ndarray, ends: np.ndarray, order: int) -> list[np.ndarray]:
    """The token order - 1, ..., 1 places before each token; 0 where its text hasn't so many, the begin included."""
    starts = np.append(0, ends[:-1]) if len(ends) else ends
    out = [_before(tokens, ends)]
    for _ in range(order - 2):
        further = np.zeros_like(tokens)
        further[1:] = out[-1][:-1]
        further[starts] = 0
        out.append(further)
    return out[::-1]


def _contexts(history: list[np.ndarray]) -> list[np.ndarray]:
    """Hashes of all tokens from each one of a history; 0 where it is absent."""
    out = []
    for k, first in enumerate(history):
        h = first
        for t in history[k + 1 :]:
            h = bigram_hash(h, t)
        out.append(np.where(first != 0, h, np.uint64(0)))
    return out


def _kept_counts(name: str, **counts: np.ndarray) -> dict[str, np.ndarray]:
    """Counts as arrays to save, in two bits each; those above 2 as 3, with their places and values besides."""
    out = {}
    for key, x in counts.items():
        large = np.flatnonzero(x > 2)
        small = np.zeros(-(-len(x) // 4) * 4, np.uint8)
        small[: len(x)] = np.minimum(x, 3)
        bits = np.bitwise_or.reduce(small.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8), axis=1, dtype=np.uint8)
        out |= {f"{name}.{key}": bits, f"{name}.{key}.at": large.astype(np.uint32), f"{name}.{key}.large": np.frombuffer(_packed(x[large]), np.uint8)}
    return out


def _counts_at(saved: Arrays, name: str, at: np.ndarray) -> np.ndarray:
    out = (saved.get(name, np.uint8)[at >> 2] >> (2 * (at & 3)).astype(np.uint8) & 3).astype(np.int64)
    large = np.flatnonzero(out == 3)
    if len(large):
        values = saved.get(f"{name}.large", np.uint8)
        out[large] = values[1:].view(f"<u{values[0]}")[np.searchsorted(saved.get(f"{name}.at", np.uint32), at[large].astype(np.uint32))]
    return out


def _kept_hashes(name: str, h: np.ndarray) -> dict[str, np.ndarray]:
    """Sorted distinct hashes as arrays to save: the begin of each bucket by their first bits and the 32 bits that follow.

    A bucket has 16 of n hashes at most on average, so hashes are told apart by
    32 + log2(n) - 4 bits or more: one of n in a shard is taken for another with
    a chance of 2^-28 or less.
    """
    bits = max(len(h).bit_length() - 4, 1)
    begins = np.searchsorted(h >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    return {f"{name}.hash": (h << np.uint64(bits) >> np.uint64(32)).astype(np.uint32), f"{name}.begin": begins.astype(np.uint32)}


def _hashes_at(saved: Arrays, name: str, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of hashes among the saved ones, and whether they are there."""
    known, begins = saved.get(f"{name}.hash", np.uint32), saved.get(f"{name}.begin", np.uint32)
    if not len(known):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    bits = (len(begins) - 1).bit_length() - 1
    bucket, rest = (h >> np.uint64(64 - bits)).astype(np.int64), (h << np.uint64(bits) >> np.uint64(32)).astype(np.uint32)
    low, end = begins[bucket].astype(np.int64), begins[bucket + 1].astype(np.int64)
    high = end
    while (low < high).any():
        middle = (low + high) // 2
        less = (low < high) & (known[np.minimum(middle, len(known) - 1)] < rest)
        low, high = np.where(less, middle + 1, low), np.where(less, high, np.minimum(middle, high))
    at = np.minimum(low, len(known) - 1)
    return at, (low < end) & (known[at] == rest)


def _longest(contexts: list[np.ndarray]) -> np.ndarray:
    """The first context of each row that isn't 0."""
    found = contexts[-1]
    for c in contexts[-2::-1]:
        found = np.where(c != 0, c, found)
    return found


def _tokens(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words with the end of each text, and the index after each text's end."""
    ends = words.first[1:]
    return np.insert(words.hashes, ends, END), ends + np.arange(1, words.n_texts + 1)


def _before(tokens: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The token before each token; a text's first has BEGIN."""
    v = np.empty_like(tokens)
    v[1:] = tokens[:-1]
    v[0:1] = BEGIN
    v[ends[:-1]] = BEGIN
    return v


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes, a place of each, and the index of each place's hash among them."""
    order = np.argsort(h)
    ranked = h[order]
    new = np.ones(len(h), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    back = np.empty(len(h), np.int64)
    back[order] = np.cumsum(new) - 1
    return ranked[new], order[new], back


def _by_shard(shards: np.ndarray, bits: int) -> np.ndarray:
    """The order of shards, by a radix sort where their numbers have 16 bits or fewer."""
    return np.argsort(shards.astype(np.uint16) if bits <= 16 else shards, kind="stable")


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys, and the sums of the values for each."""
    if not len(keys):
        return keys, *values
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], *(np.add.reduceat(v[order], first) for v in values)


def _place_type(n: int) -> type:
    return np.uint16 if n <= 1 << 16 else np.uint32


def _array(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _squeezed(data: bytes) -> bytes:
    """Compressed for the shuffle, with the length in front."""
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def _restored(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def _named(known: np.ndarray, common: np.ndarray) -> bytes:
    """Sorted distinct words: the steps between the places of common ones, byte by byte, and the hashes of the others."""
    at = np.minimum(np.searchsorted(common, known), max(len(common) - 1, 0))
    hit = common[at] == known if len(common) else np.zeros(len(known), bool)
    steps = np.diff(at[hit], prepend=0).astype(np.uint32)
    return _squeezed(len(steps).to_bytes(8, "little") + _bytewise(steps) + _array(known[~hit]))


def _words_named(data: bytes, common: np.ndarray) -> np.ndarray:
    data = _restored(data)
    n = int.from_bytes(data[:8], "little")
    steps = _from_bytes(data[8 : 8 + 4 * n], np.uint32)
    return np.sort(np.concatenate([common[np.cumsum(steps, dtype=np.int64)], np.frombuffer(data, np.uint64, offset=8 + 4 * n)]))


def _bytewise(x: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones, and so on, which compresses better."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes()


def _from_bytes(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def _places(x: np.ndarray) -> bytes:
    """n-grams (one row for each of their words) sorted by their last two words: of these, the steps."""
    x = x.copy()
    x[-2:, 1:] -= x[-2:, :-1].copy()
    return _squeezed(_bytewise(x.ravel()))


def _placed(data: bytes, order: int, dtype) -> np.ndarray:
    x = _from_bytes(_restored(data), dtype).reshape(order, -1)
    x[-2:] = np.cumsum(x[-2:], axis=1, dtype=dtype)
    return x


def _packed(counts: np.ndarray) -> bytes:
    """Counts in the fewest bytes, 1, 2, 4 or 8, that hold the largest of them, and that number."""
    size = next(b for b in (1, 2, 4, 8) if b == 8 or not len(counts) or int(counts.max()) < 1 << 8 * b)
    return bytes([size]) + counts.astype(f"<u{size}").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64) if data else np.zeros(0, np.int64)


def _counts_of(table: pa.Table, column: str) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *(_unpacked(x) for x in table.column(column).to_pylist())])


def _joined(table: pa.Table, column: str, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).to_pylist()), dtype)


def _sliced(shards: np.ndarray, n: int) -> Iterator[tuple[int, slice]]:
    """The shards that occur in a sorted array of shards, and where."""
    bounds = np.searchsorted(shards, np.arange(n + 1))
    return ((s, slice(bounds[s], bounds[s + 1])) for s in np.flatnonzero(np.diff(bounds)).tolist())


@dataclass(frozen=True)
class Model:
    """The folder of the arrays, and what belongs to no word."""

    folder: str
    bits: int
    train_tokens: int
    types: int
    bigram_types: int
    #: Those of each order from 1.
    discounts: tuple[tuple[float, float, float], ...]
    #: The mass that the discounts of the words' continuation counts leave for all words alike.
    left_over: float

    def hot_words(self) -> np.ndarray:
        return map_array(self.folder, "hot.hash", np.uint64)

    def bigram_shard(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        return _bigram_shard(v, w, self.bits, self.hot_words())

    def words(self, h: np.ndarray) -> dict[str, np.ndarray]:
        """The counts of words by their sorted distinct hashes; 0 where the word is unknown."""
        out = {name: np.zeros(len(h), np.int64) for name in _WORD}
        for s, part in _sliced(_shard(h, self.bits), 1 << self.bits):
            saved = map_together(self.folder, f"w{s}")
            known = saved.get("w.hash", np.uint64)
            if len(known):
                at = np.minimum(np.searchsorted(known, h[part]), len(known) - 1)
                same = known[at] == h[part]
                for name in out:
                    out[name][part] = np.where(same, _counts_at(saved, f"w.{name}", at), 0)
        return out

    def grams(self, k: int, h: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Counts of distinct k-grams by their hashes and last two words."""
        return self._found("n", f"g{k}", ("count",), h, self.bigram_shard(v, w))[0]

    def contexts(self, k: int, h: np.ndarray, v: np.ndarray) -> list[np.ndarray]:
        """total, n1, n2 and n3 of distinct contexts of k-grams, k above 2, by their hashes and last word."""
        hot = np.isin(v, self.hot_words())
        out = [np.zeros(len(h), np.int64) for _ in _CONTEXT]
        # the first bits of a very frequent context's hash are its shard's
        often = self._found("w", f"h{k}", _CONTEXT, h[hot] << np.uint64(self.bits), _shard(h[hot], self.bits))
        others = self._found("n", f"c{k}", _CONTEXT, h[~hot], _shard(v[~hot], self.bits))
        for x, y, z in zip(out, often, others, strict=True):
            x[hot], x[~hot] = y, z
        return out

    def _found(self, file: str, name: str, values: tuple[str, ...], h: np.ndarray, shard: np.ndarray) -> list[np.ndarray]:
        # sorted hashes stay sorted within their shards
        order = _by_shard(shard, self.bits)
        out = [np.zeros(len(h), np.int64) for _ in values]
        for s, part in _sliced(shard[order], 1 << self.bits):
            mine = order[part]
            saved = map_together(self.folder, f"{file}{s}")
            at, same = _hashes_at(saved, name, h[mine])
            mine, at = mine[same], at[same]
            if len(mine):
                for x, value in zip(out, values, strict=True):
                    x[mine] = _counts_at(saved, f"{name}.{value}", at)
        return out


def _bigram_shard(v: np.ndarray, w: np.ndarray, bits: int, hot: np.ndarray) -> np.ndarray:
    if not len(hot):
        return _shard(v, bits)
    at = np.minimum(np.searchsorted(hot, v), len(hot) - 1)
    return _shard(np.where(hot[at] == v, w, v), bits)


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts of counts 1 to 4; 0.5, 1 and 1.5 where those say nothing."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.0
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3) if y and n3 and n4 else (0.5, 1.0, 1.5)
    return tuple(min(max(d, 0.0), k + 1.0) for k, d in enumerate(found))


def _of_counts(c: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3, 4 and above 2."""
    return [*np.bincount(np.minimum(c, 5), minlength=6)[1:5].tolist(), int((c > 2).sum())]


def train(docs: DataFrame, shard_bytes: int = SHARD_BYTES, order: int = 2) -> Model:
    """Counts the words and n-grams up to the order, 2 at least, of all given documents (null text: empty) into a new model."""
    if order < 2:
        raise ValueError("the order must be 2 or more")
    spark = docs.sparkSession
    folder = shared_dir(spark, "lm")
    texts = docs.select("text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(4, (-(-size // shard_bytes) - 1).bit_length())
    n_shards = 1 << bits

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
        for batch in batches:
            for part in blocks(batch) if batch.num_rows else ():
                yield Words(strings(part.column("text")))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def emit() -> pa.RecordBatch:
            h, c = _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            rows = [(s, _array(h[p]), _packed(c[p])) for s, p in _sliced(_shard(h, bits), n_shards)]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["shard", "hash", "count"])

        for words in words_of(batches):
            held.append(np.unique(_tokens(words)[0], return_counts=True))
            if sum(len(h) for h, _ in held) > HELD:
                yield emit()
        if held:
            yield emit()

    def sum_words(table: pa.Table) -> pa.Table:
        s = table.column("shard")[0].as_py()
        h, c = _summed(_joined(table, "hash", np.uint64), _counts_of(table, "count"))
        save_together(folder, f"u{s}", {"u.hash": h, **_kept_counts("u", count=c)})
        often = np.flatnonzero(c > c.sum() / 1000)
        sizes = np.bincount(np.searchsorted(_POWERS, c, "right") - 1, minlength=len(_POWERS))
        row = {"shard": s, "types": len(h), "tokens": int(c.sum()), "sizes": sizes.tolist(), "often": [{"hash": int(a), "n": int(b)} for a, b in zip(h[often].view(np.int64), c[often], strict=True)]}
        return pa.Table.from_pylist([row], _totals)

    _totals = pa.schema([("shard", pa.int32()), *((n, pa.int64()) for n in ("types", "tokens")), ("sizes", pa.list_(pa.int64())), ("often", pa.list_(pa.struct([("hash", pa.int64()), ("n", pa.int64())])))])
    words = texts.mapInArrow(count_words, "shard int, hash binary, count binary")
    words = written(words.groupBy("shard").applyInArrow(sum_words, "shard int, types long, tokens long, sizes array<long>, often array<struct<hash:long,n:long>>"), f"{folder}/words")
    totals = words.agg(F.sum("types"), F.sum("tokens"), *[F.sum(F.col("sizes")[k]) for k in range(len(_POWERS))]).first()
    types, tokens = totals[0] or 0, totals[1] or 0
    # words of how large a count are so few that all have a place in the table
    sizes = np.cumsum([n or 0 for n in totals[:1:-1]])[::-1]
    least = int(_POWERS[np.argmax(sizes <= COMMON)])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.column("shard").to_pylist():
                saved = map_together(folder, f"u{s}")
                h = saved.get("u.hash", np.uint64)
                c = _counts_at(saved, "u.count", np.arange(len(h)))
                yield pa.RecordBatch.from_pydict({"hash": pa.array([_array(h[c >= least])], pa.binary())})

    def save_common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x, np.uint64) for b in batches for x in b.column("hash").to_pylist())])
        save_arrays(folder, "common", hash=np.sort(found))
        yield pa.RecordBatch.from_pydict({"n": pa.array([len(found)], pa.int64())})

    written(words.select("shard").mapInArrow(choose, "hash binary").repartition(1).mapInArrow(save_common, "n long"), f"{folder}/common-saved")

    def save_hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.concatenate([np.zeros(0, np.int64), *(b.column("hash").to_numpy() for b in batches)]).view(np.uint64)
        save_arrays(folder, "hot", hash=np.append(np.sort(found), np.zeros(0, np.uint64)))
        yield pa.RecordBatch.from_pydict({"n": pa.array([len(found)], pa.int64())})

    # no more than 4 * n_shards words have so large a share; the begin stands before every text
    begins = texts.limit(1).select(F.lit(int(BEGIN)).cast("long").alias("hash"))
    hot = words.select(F.inline("often")).where(F.col("n") > max(tokens / (4 * n_shards), 1000)).select("hash").unionByName(begins)
    written(hot.coalesce(1).mapInArrow(save_hot, "n long"), f"{folder}/hot")

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_words, common = map_array(folder, "hot.hash", np.uint64), map_array(folder, "common.hash", np.uint64)
        held: list[tuple[np.ndarray, ...]] = []

        def emit() -> pa.RecordBatch:
            *grams, c = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            h = bigram_hash(_longest(_contexts(grams[:-1])), grams[-1])
            rank = np.argsort(h)
            ranked = h[rank]
            first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
            c = np.add.reduceat(c[rank], first)
            grams = [x[rank[first]] for x in grams]
            shard = _bigram_shard(grams[-2], grams[-1], bits, hot_words)
            rank = np.lexsort((*grams[:-2], grams[-1], grams[-2], shard))
            grams, c = [x[rank] for x in grams], c[rank]
            rows = []
            for s, p in _sliced(shard[rank], n_shards):
                # a shard's words once, n-grams as places in them
                known, places = np.unique(np.concatenate([x[p] for x in grams]), return_inverse=True)
                rows.append((s, _named(known, common), _places(places.astype(_place_type(len(known))).reshape(order, -1)), _squeezed(_packed(c[p]))))
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 3), strict=True)], names=["shard", "words", "grams", "count"])

        for words in words_of(batches):
            tokens, ends = _tokens(words)
            grams = [*_history(tokens, ends, order), tokens]
            _, first, back = _distinct(bigram_hash(_longest(_contexts(grams[:-1])), tokens))
            held.append((*(x[first] for x in grams), np.bincount(back, minlength=len(first))))
            if sum(len(x[0]) for x in held) > HELD:
                yield emit()
        if held:
            yield emit()

    def sum_grams(table: pa.Table) -> pa.Table:
        s = table.column("shard")[0].as_py()
        hot_words, common = map_array(folder, "hot.hash", np.uint64), map_array(folder, "common.hash", np.uint64)
        parts = []
        for known, places in zip(table.column("words").to_pylist(), table.column("grams").to_pylist(), strict=True):
            known = _words_named(known, common)
            parts.append(known[_placed(places, order, _place_type(len(known)))])
        *history, last = np.concatenate(parts, axis=1)
        grams = [*_contexts(history), last]
        del parts, history
        count = np.concatenate([_unpacked(_restored(x)) for x in table.column("count").to_pylist()])
        whole = grams[0] != 0
        begun = [*(x[~whole] for x in grams), count[~whole]]
        grams, count = [x[whole] for x in grams], count[whole]
        rows: dict[tuple[int, int], list[bytes]] = {}
        of_counts, saved = [], {}

        def hand_on(k: int, column: int, arrays: tuple[np.ndarray, ...]) -> None:
            for t, p in _sliced(_shard(arrays[0], bits), n_shards):
                row = rows.setdefault((t, k), [b""] * 7)
                row[column : column + len(arrays)] = [(_named(x[p], common) if k == 2 else _array(x[p])) if not j else _packed(x[p]) for j, x in enumerate(arrays)]

        for k in range(order, 1, -1):
            if k < order:
                # the n-grams one longer are distinct: each is one word before its last k; those that begin a text keep their counts
                own = begun[0] != 0
                grams = [np.concatenate([x, y[own]]) for x, y in zip(grams[1:], begun[:-1], strict=True)]
                count = np.concatenate([np.ones(len(count), np.int64), begun[-1][own]])
                begun = [x[~own] for x in begun]
            h = bigram_hash(grams[0], grams[-1])
            rank = np.argsort(h)
            h = h[rank]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, int)
            count = np.add.reduceat(count[rank], first) if len(h) else count
            grams = [x[rank[first]] for x in grams]
            saved |= _kept_hashes(f"g{k}", h[first]) | _kept_counts(f"g{k}", count=count)
            of_counts += _of_counts(count)[:4]
            begun = begun[1:]
            tally = (count, *((count == 1).astype(np.int64), (count == 2).astype(np.int64), (count > 2).astype(np.int64)))
            if k == 2:
                hand_on(2, 0, _summed(grams[0], *tally))
                hand_on(2, 5, _summed(grams[-1], np.ones(len(count), np.int64)))
            else:
                # a context that ends in a very frequent word has parts in other shards as well
                hot = np.isin(grams[-2], hot_words)
                own = _summed(grams[0][~hot], *(x[~hot] for x in tally))
                saved |= _kept_hashes(f"c{k}", own[0]) | _kept_counts(f"c{k}", **dict(zip(_CONTEXT, own[1:], strict=True)))
                hand_on(k, 0, _summed(grams[0][hot], *(x[hot] for x in tally)))
        save_together(folder, f"n{s}", saved)
        out = [(t, k, *row, None) for (t, k), row in rows.items()] + [(-1, 0, *[b""] * 7, of_counts)]
        return pa.table([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _partial, strict=True)], _partial)

    _partial = pa.schema([("shard", pa.int32()), ("k", pa.int32()), *((n, pa.binary()) for n in ("v", "total", "n1", "n2", "n3", "w", "cont")), ("of_counts", pa.list_(pa.int64()))])
    spark_partial = "shard int, k int, v binary, total binary, n1 binary, n2 binary, n3 binary, w binary, cont binary, of_counts array<long>"
    counted = texts.mapInArrow(count_grams, "shard int, words binary, grams binary, count binary")
    partial = written(counted.groupBy("shard").applyInArrow(sum_grams, spark_partial), f"{folder}/grams")
    of_grams = partial.select(*[F.sum(F.col("of_counts")[k]) for k in range(4 * (order - 1))]).first()

    def sum_contexts(table: pa.Table) -> pa.Table:
        s = table.column("shard")[0].as_py()
        own, common, saved = map_together(folder, f"u{s}"), map_array(folder, "common.hash", np.uint64), {}
        known = own.get("u.hash", np.uint64)
        count = _counts_at(own, "u.count", np.arange(len(known)))
        for k in range(3, order + 1):
            longer = table.filter(pc.field("k") == k)
            h, *sums = _summed(_joined(longer, "v", np.uint64), *(_counts_of(longer, x) for x in _CONTEXT))
            saved |= _kept_hashes(f"h{k}", h << np.uint64(bits)) | _kept_counts(f"h{k}", **dict(zip(_CONTEXT, sums, strict=True)))
        table = table.filter(pc.field("k") == 2)
        v, w = (np.concatenate([np.zeros(0, np.uint64), *(_words_named(x, common) for x in table.column(side).to_pylist() if x)]) for side in "vw")
        v, *context = _summed(v, *(_counts_of(table, x) for x in ("total", "n1", "n2", "n3")))
        w, cont = _summed(w, _counts_of(table, "cont"))
        h = np.union1d(np.union1d(known, v), w)
        out = {name: np.zeros(len(h), np.int64) for name in _WORD}
        out["count"][np.searchsorted(h, known)] = count
        out["cont"][np.searchsorted(h, w)] = cont
        for name, x in zip(("total", "n1", "n2", "n3"), context, strict=True):
            out[name][np.searchsorted(h, v)] = x
        save_together(folder, f"w{s}", saved | {"w.hash": h, **_kept_counts("w", **out)})
        return pa.table({"cont": pa.array([int(cont.sum())], pa.int64()), "of_counts": pa.array([_of_counts(cont)], pa.list_(pa.int64()))})

    contexts = written(partial.where("k >= 2").drop("of_counts").groupBy("shard").applyInArrow(sum_contexts, "cont long, of_counts array<long>"), f"{folder}/contexts")
    of_words = contexts.select(F.sum("cont"), *[F.sum(F.col("of_counts")[k]) for k in range(5)]).first()
    bigram_types, *n = (x or 0 for x in of_words)
    d = _discounts(n[:4])
    left_over = (d[0] * n[0] + d[1] * n[1] + d[2] * n[4]) / max(bigram_types, 1)
    return Model(folder, bits, tokens, types, bigram_types, (d, *(_discounts([x or 0 for x in of_grams[4 * k : 4 * k + 4]]) for k in range(order - 2, -1, -1))), left_over)


def _discount(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(c, 3)]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score (log10 probabilities), and the perplexity of each document.

    A text's tokens are its words and one end; null text is empty.  base_score
    is that of the smoothed unigram counts.  Other columns are not read.
    """

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch) if batch.num_rows else ():
                tokens, ends = _tokens(Words(strings(part.column("text"))))
                h, _, word = _distinct(np.append(tokens, BEGIN))
                w = word[:-1]
                known = model.words(h)
                # words by their continuations, the longest n-grams by their counts
                types, (d1, *longer) = model.bigram_types, model.discounts
                of_one = max(model.types + 1, 1)
                if types:
                    p1 = np.maximum(known["cont"].astype(float) - _discount(known["cont"], d1), 0) / types + model.left_over / of_one
                else:
                    p1 = np.full(len(h), 1 / of_one)
                p = p1[w]
                contexts = _contexts(_history(tokens, ends, len(model.discounts)))[::-1]
                v = contexts[0]
                for k, (context, d) in enumerate(zip(contexts, longer, strict=True), 2):
                    at = np.flatnonzero(context)
                    _, one, back = _distinct(context[at])
                    if k == 2:
                        place = np.searchsorted(h, context[at[one]])
                        tally = [known[x][place] for x in _CONTEXT]
                    else:
                        tally = model.contexts(k, context[at[one]], v[at[one]])
                    total, n1, n2, n3 = (x[back] for x in tally)
                    g, one, back = _distinct(bigram_hash(context[at], tokens[at]))
                    c = model.grams(k, g, v[at[one]], tokens[at[one]])[back]
                    some = np.maximum(total, 1)
                    gamma = (d[0] * n1 + d[1] * n2 + d[2] * n3) / some
                    p[at] = np.where(total > 0, np.maximum(c - _discount(c, d), 0) / some + gamma * p[at], p[at])
                base = np.log10((known["count"] + 0.1) / (model.train_tokens + 0.1 * (model.types + 1)))[w]
                starts = np.append(0, ends[:-1])
                n = np.diff(np.append(starts, len(tokens)))
                s = np.add.reduceat(np.log10(p), starts)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(n, pa.int64()),
                        pa.array(np.add.reduceat((known["count"] > 0)[w].astype(np.int64), starts)),
                        pa.array(np.add.reduceat(base, starts)),
                        pa.array(s),
                        pa.array(10 ** np.minimum(-s / n, 300.0)),
                    ],
                    names=["doc_id", "n_tokens", "n_known", "base_score", "score", "perplexity"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scored, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double, perplexity double")
