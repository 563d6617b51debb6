"""Exact dedup by content-defined chunk recipes.

A normalised text is cut where a hash of the last eight bytes has a pattern, so
equal texts have equal chunks.  Tasks emit each of their distinct chunks once;
their bytes are shuffled once, and a chunk hash that stands for different bytes
is recorded.  A text's recipe is its ordered list of chunk identifiers (the
hash, or where it was recorded, the hash with the bytes): recipes are equal
exactly if the texts are, and only recipes, not texts, are grouped and joined.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_array, save_arrays, shared_dir, written
from .textblocks import blocks, buffers, strings

MIN_CHUNK, MEAN_CHUNK, MAX_CHUNK = 512, 2048, 1 << 16
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def chunk_ends(data: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """For each text of a block, the ends of its chunks (none for an empty text)."""
    n = len(data)
    cuts = np.zeros(0, np.int64)
    if n >= 8:
        window = np.ndarray((n - 7,), "<u8", data.tobytes(), strides=(1,))
        cuts = np.flatnonzero((window * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(53) == 0) + 8
    out = []
    first = np.searchsorted(cuts, offsets[:-1] + 8).tolist()
    last = np.searchsorted(cuts, offsets[1:]).tolist()
    for a, b, i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), first, last, strict=True):
        ends = []
        while b - a > MIN_CHUNK:
            i += int(np.searchsorted(cuts[i:j], a + MIN_CHUNK)) if i < j else 0
            a = min(int(cuts[i]) if i < j else b, a + MAX_CHUNK, b)
            ends.append(a)
        if a < b:
            ends.append(b)
        out.append(ends)
    return out


def _chunks(part: pa.RecordBatch, digest: int) -> Iterator[tuple[bytes, list[tuple[bytes, bytes]]]]:
    """(normalised text, its chunks as (hash, bytes)) for each row of a block."""
    data, offsets = buffers(strings(part.column("text")))
    data = _LOWER[data]
    raw = data.tobytes()
    for a, b, ends in zip(offsets[:-1].tolist(), offsets[1:].tolist(), chunk_ends(data, offsets), strict=True):
        pieces = [raw[x:y] for x, y in zip([a, *ends[:-1]], ends, strict=True)] if ends else []
        yield raw[a:b], [(hashlib.blake2b(x, digest_size=digest).digest(), x) for x in pieces]


def exact_groups(docs: DataFrame, digest: int = 16) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each document, dropped ones too.

    Texts are equal when identical once A-Z are lower case; null counts as
    empty.  Of equal texts the largest doc_id stays; rows that repeat an id and
    its text are all marked kept.  ``digest`` is the bytes of a chunk hash;
    results do not depend on it.  Other columns are not read.
    """
    folder = shared_dir(docs.sparkSession, "recipes")
    texts = docs.select("doc_id", "text")

    def distinct_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for part in blocks(batch) if batch.num_rows else ():
                new: dict[bytes, bytes] = {}
                clash = []
                for _, pieces in _chunks(part, digest):
                    for h, x in pieces:
                        if h not in seen and new.setdefault(h, x) != x:
                            clash.append((h, x))
                rows = [*new.items(), *clash]
                if digest >= 8:  # a shorter hash, for tests, must show all its bytes
                    seen.update(new)
                yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in rows], pa.binary()), pa.array([x for _, x in rows], pa.binary())], names=["chunk", "bytes"])

    chunks = texts.mapInArrow(distinct_chunks, "chunk binary, bytes binary").groupBy("chunk", "bytes").agg(F.lit(1).alias("one"))
    shared_hashes = chunks.groupBy("chunk").agg(F.count("*").alias("n")).where("n > 1").select("chunk")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = b"".join(x for b in batches for x in b.column("chunk").to_pylist())
        save_arrays(folder, "clashes", ids=np.frombuffer(found, np.uint8))
        yield pa.RecordBatch.from_pydict({"bytes": pa.array([len(found)], pa.int64())})

    # hashes that stand for two chunks: none in practice at 128 bits
    written(shared_hashes.coalesce(1).mapInArrow(save, "bytes long"), f"{folder}/saved")

    def recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = map_array(folder, "clashes.ids", np.uint8).tobytes()
        clashes = {raw[k : k + digest] for k in range(0, len(raw), digest)}
        for batch in batches:
            for part in blocks(batch) if batch.num_rows else ():
                recipe, sha = [], []
                for text, pieces in _chunks(part, digest):
                    recipe.append(b"".join(h + (len(x).to_bytes(4, "little") + x if h in clashes else b"") for h, x in pieces))
                    sha.append(hashlib.sha256(text).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(recipe, pa.binary()), pa.array(sha)], names=["doc_id", "recipe", "text_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    listed = written(texts.mapInArrow(recipes, f"doc_id {kind}, recipe binary, text_sha256 string"), f"{folder}/recipes")
    groups = listed.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")
    return listed.join(groups, "recipe").select("doc_id", "keep_id", "group_size", kept, "text_sha256")
