"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

Patterns are the windows of ``window`` consecutive words of every benchmark
item (a shorter item is one window).  For each pattern length a shift table
over hashed blocks of two words tells how far a window's end can move on when
the block there ends no pattern; where the shift is 0, the bucket of the
block's hash (and of the window's first block) selects patterns, and comparing
the words confirms.  The benchmark is compiled by tasks into table files of at
most ``TABLE_BYTES`` of text each in the shared folder; every task of the scan
goes through all tables for each block of texts, so neither table nor texts
pass through the driver and documents are never shuffled.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .shared import map_array, save_arrays, shared_dir, written
from .textblocks import NOT_ALNUM, Words, blocks, mix, strings

WINDOW = 10
TABLE_BYTES = 4 << 20
_SHIFT_BITS = 18
_K = np.uint64(0x9FB21C651E98DF25)
_LANES = 2048


def _block(h: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` (1 or 2) words of h that end at ``end``."""
    x = h[end]
    return mix(x * _K + h[end - 1]) if size == 2 else x


def _compile(words: Words, item_ids: list, window: int) -> dict[str, np.ndarray]:
    """Arrays of the tables of one part of the benchmark, by pattern length."""
    out: dict[str, np.ndarray] = {}
    found: dict[int, dict[bytes, tuple[int, set]]] = {}
    text = words.data.tobytes().lower()
    spans = list(zip(words.starts.tolist(), words.ends.tolist(), strict=True))
    for i, item in enumerate(item_ids):
        a, n = int(words.first[i]), int(words.counts[i])
        m = min(n, window)
        for s in range(a, a + n - m + 1) if n else ():
            key = b" ".join(text[x:y] for x, y in spans[s : s + m])
            found.setdefault(m, {}).setdefault(key, (s, set()))[1].add(item)
    for m, patterns in found.items():
        size = min(2, m)
        starts = np.array([s for s, _ in patterns.values()], np.int64)
        rows = words.hashes[starts[:, None] + np.arange(m)]
        flat, at = rows.ravel(), np.arange(len(rows)) * m
        shift = np.full(1 << _SHIFT_BITS, m - size + 1, np.uint8)
        for j in range(size - 1, m):
            np.minimum.at(shift, _block(flat, at + j, size) & np.uint64((1 << _SHIFT_BITS) - 1), m - 1 - j)
        key = _block(flat, at + m - 1, size) * _K + _block(flat, at + size - 1, size)
        order = np.argsort(key, kind="stable")
        members = [sorted(x) for _, x in patterns.values()]
        out |= {
            f"{m}.shift": shift,
            f"{m}.key": key[order],
            f"{m}.rows": rows[order],
            f"{m}.texts": np.array([list(patterns)[k] for k in order], object),
            f"{m}.items": np.array([members[k] for k in order] + [None], object)[:-1],
        }
    return out


def compile_tables(benchmark: DataFrame, folder: str, window: int = WINDOW) -> list[str]:
    """Compiles (item_id, text) into table files in folder; returns their names."""
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).where("item_id is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // (TABLE_BYTES // 2)))

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        for k, batch in enumerate(x for b in batches if b.num_rows for x in blocks(b, limit=TABLE_BYTES)):
            out = io.BytesIO()
            np.savez(out, **_compile(Words(strings(batch.column("text")), NOT_ALNUM), batch.column("item_id").to_pylist(), window))
            name = f"table-{TaskContext.get().partitionId():05d}-{k:05d}"
            save_arrays(folder, name, npz=np.frombuffer(out.getvalue(), np.uint8))
            yield pa.RecordBatch.from_pydict({"name": pa.array([name], pa.string())})

    names = written(items.repartition(parts, F.xxhash64("item_id")).mapInArrow(save, "name string"), f"{folder}/names")
    return sorted(r.name for r in names.distinct().collect())


class _Scanner:
    """All tables; the words of a block are searched for each."""

    def __init__(self, folder: str, names: list[str]):
        self.folder, self.names = folder, names
        self.kept: dict[str, dict] = {}

    def _load(self, name: str) -> dict:
        if name not in self.kept:
            if len(self.kept) >= 4:
                self.kept.clear()
            with np.load(io.BytesIO(map_array(self.folder, f"{name}.npz", np.uint8).tobytes()), allow_pickle=True) as f:
                self.kept[name] = {k: f[k] for k in f.files}
        return self.kept[name]

    def search(self, words: Words) -> tuple[np.ndarray, list[tuple[int, list]]]:
        """Whether each word is hit, and (text's index, item ids) of each occurrence."""
        of_text = words.of_text()
        edges = np.zeros(len(words.starts) + 1, np.int64)
        items: list[tuple[int, list]] = []
        text = None
        for name in self.names:
            t = self._load(name)
            for m in sorted({int(k.split(".")[0]) for k in t}):
                ends, patterns = self._occurrences(words.hashes, of_text, m, t)
                for e, p in zip(ends.tolist(), patterns.tolist(), strict=True):
                    text = words.data if text is None else text
                    a = e - m + 1
                    own = b" ".join(text[x:y].tobytes().lower() for x, y in zip(words.starts[a : e + 1].tolist(), words.ends[a : e + 1].tolist(), strict=True))
                    if own == t[f"{m}.texts"][p]:
                        edges[a] += 1
                        edges[e + 1] -= 1
                        items.append((int(of_text[e]), t[f"{m}.items"][p]))
        return np.cumsum(edges[:-1]) > 0, items

    @staticmethod
    def _occurrences(h: np.ndarray, of_text: np.ndarray, m: int, t: dict) -> tuple[np.ndarray, np.ndarray]:
        """Ends of windows of m words that equal a pattern in their hashes, and the pattern."""
        size, shift, n = min(2, m), t[f"{m}.shift"], len(h)
        if n < m:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        mask = np.uint64(len(shift) - 1)
        # lanes of neighbouring ends are moved on side by side
        bounds = np.linspace(m - 1, n, min(_LANES, max(1, n // 64)) + 1).astype(np.int64)
        at, stop, stopped = bounds[:-1].copy(), bounds[1:], []
        live = at < stop
        at, stop = at[live], stop[live]
        while len(at):
            move = shift[_block(h, at, size) & mask]
            zero = move == 0
            if zero.any():
                stopped.append(at[zero])
            at = at + np.maximum(move, 1)
            live = at < stop
            if not live.all():
                at, stop = at[live], stop[live]
        if not stopped:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ends = np.concatenate(stopped)
        ends = ends[of_text[ends] == of_text[ends - m + 1]]
        key = _block(h, ends, size) * _K + _block(h, ends - m + size, size)
        low, high = (np.searchsorted(t[f"{m}.key"], key, side) for side in ("left", "right"))
        n_each = high - low
        e = np.repeat(ends, n_each)
        p = np.repeat(low, n_each) + np.arange(n_each.sum()) - np.repeat(np.cumsum(n_each) - n_each, n_each)
        same = (h[e[:, None] - m + 1 + np.arange(m)] == t[f"{m}.rows"][p]).all(axis=1)
        return e[same], p[same]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted item ids) and spans (start, end of hit runs, in words, end exclusive).

    Words are runs of letters, digits and all non-ASCII characters, A-Z folded.
    Null or empty text has no words and hits nothing; an item without words or
    with a null id is no pattern; item ids keep their type; repeated items count once; an empty benchmark
    hits nothing; other columns, whatever their names, are not read.
    """
    folder = shared_dir(docs.sparkSession, "benchmark")
    names = compile_tables(benchmark, folder, window)
    item = benchmark.schema["item_id"].dataType
    item_type = to_arrow_type(item)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _Scanner(folder, names)
        for batch in batches:
            for part in blocks(batch) if batch.num_rows else ():
                words = Words(strings(part.column("text")), NOT_ALNUM)
                hit, found = scanner.search(words)
                items: list[set] = [set() for _ in range(words.n_texts)]
                for k, ids in found:
                    items[k].update(ids)
                total = np.concatenate([[0], np.cumsum(hit)])
                spans = [[] for _ in range(words.n_texts)]
                for k in {k for k, _ in found}:
                    a, b = words.first[k], words.first[k + 1]
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit[a:b], [False]]).astype(np.int8)))
                    spans[k] = [{"start": s, "end": e} for s, e in edge.reshape(-1, 2).tolist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(words.counts, pa.int64()),
                        pa.array(total[words.first[1:]] - total[words.first[:-1]], pa.int64()),
                        pa.array([sorted(x) for x in items], pa.list_(item_type)),
                        pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    ],
                    names=["doc_id", "n_words", "n_hit", "items", "spans"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, n_words long, n_hit long, items array<{item.simpleString()}>, spans array<struct<start:long,end:long>>")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents in which no window of the benchmark occurs, whole and with all their columns."""
    folder = shared_dir(docs.sparkSession, "benchmark")
    names = compile_tables(benchmark, folder, window)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _Scanner(folder, names)
        for batch in batches:
            for part in blocks(batch) if batch.num_rows else ():
                _, found = scanner.search(Words(strings(part.column("text")), NOT_ALNUM))
                clean = np.ones(part.num_rows, bool)
                clean[[k for k, _ in found]] = False
                yield part.filter(pa.array(clean))

    return docs.mapInArrow(scan, docs.schema)
