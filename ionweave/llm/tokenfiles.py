"""Token-ID files: Parquet list columns, in ascending doc_id order, that can be read selectively.

Token ids are dictionary-encoded list columns (a column that outgrows its
dictionary falls back to delta encoding), row groups are small and pages are
indexed, so a reader can fetch the metadata columns alone, or the ids of a
range of documents.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import shared_dir
from .textblocks import blocks, buffers, span_hashes, strings

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
#: Pieces that a worker remembers; beyond it the memory starts anew.
KEPT_PIECES = 3 << 18
_PLACE_BITS = 21
_SEPARATOR = "\ue000"
#: Letters for which a class of characters can be named: Latin, Cyrillic, kana, CJK, Hangul.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u01ba\u0400-\u0481\u048a-\u052f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
_PLAIN = re.compile(f"[ \n]?[!-~{_LETTERS}]+")
_SPLIT = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[0-9]+| ?[^\\s{_LETTERS}0-9\0]+|\n")
WRITE_OPTIONS = {
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "compression": "zstd",
}
_SPACE = np.zeros(256, bool)
_SPACE[[32, 10]] = True
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
#: Lead bytes of the white space beyond ASCII.
_LEAD = np.zeros(256, bool)
_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return name if "/" in name else public_tokenizers.path(name)


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where a block's texts may be cut so that byte-level BPE of the pieces is that of the texts.

    The tokenizer's first step never joins a word with a space or line feed
    after it, so a text can be cut before each single one between two
    characters that aren't white space.
    """
    n = len(data)
    at = np.flatnonzero(_SPACE[data])
    at = at[(at > 0) & (at < n - 1)]
    # white space beyond ASCII has two or three bytes, with one of few lead bytes
    sure = ~(_WHITE[data[at - 1]] | _WHITE[data[at + 1]] | _LEAD[data[at + 1]])
    sure &= ~(_LEAD[data[np.maximum(at - 2, 0)]] | _LEAD[data[np.maximum(at - 3, 0)]])
    return np.union1d(at[sure], offsets[:-1][np.diff(offsets) > 0])


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level BPE has for each byte, as a table for str.translate of latin-1 text."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


class _Encoder:
    """Encodes blocks of texts; remembers the ids of pieces by their hash.

    Pieces are found in a table with two places for each; the few that find
    both taken are kept in a dictionary.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)).encode()) if special else None
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << _PLACE_BITS, np.uint64)
        self.at = np.zeros(1 << _PLACE_BITS, np.int32)
        self.rest: dict[int, int] = {}
        self.flat = np.zeros(1 << 20, np.int32)
        self.ends = np.zeros(1 << 16, np.int64)
        self.n = 0

    def _learn(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        """Encodes new pieces and gives them the next indexes."""
        ids, counts = self._pieces(pieces)
        n, k = self.n, len(pieces)
        while n + k >= len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.ends[n + 1 : n + k + 1] = self.ends[n] + np.cumsum(counts)
        while self.ends[n + k] > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.ends[n] : self.ends[n + k]] = ids
        index = np.arange(n, n + k, dtype=np.int32)
        for k in (0, 1):
            place = _places(hashes)[k]
            free = np.flatnonzero(self.keys[place] == 0)
            _, one = np.unique(place[free], return_index=True)
            free = free[one]
            self.keys[place[free]], self.at[place[free]] = hashes[free], index[free]
            left = np.ones(len(hashes), bool)
            left[free] = False
            hashes, index = hashes[left], index[left]
        self.rest.update(zip(hashes.tolist(), index.tolist(), strict=True))
        self.n += len(pieces)

    def _pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, and how many each has."""
        found = self.tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)
        return np.array([i for e in found for i in e.ids], np.int32), np.array([len(e) for e in found], np.int64)

    def _known(self, hashes: np.ndarray) -> np.ndarray:
        """Index of each piece, -1 where it is in neither place."""
        first, second = _places(hashes)
        found = np.where(self.keys[first] == hashes, self.at[first], -1)
        lost = np.flatnonzero(found < 0)
        again = second[lost]
        found[lost] = np.where(self.keys[again] == hashes[lost], self.at[again], -1)
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts and the number of each text's."""
        data, offsets = buffers(texts)
        starts = piece_starts(data, offsets)
        stops = np.append(starts[1:], len(data)) if len(starts) else starts
        hashes = span_hashes(data, starts, stops)
        hashes[hashes == 0] = 1
        at = self._known(hashes)
        lost = np.flatnonzero(at < 0)
        if len(lost):
            distinct, first, inverse = np.unique(hashes[lost], return_index=True, return_inverse=True)
            if self.n + len(distinct) > KEPT_PIECES and self.n:
                self.clear()
                return self.encode(texts)
            index = np.array([self.rest.get(h, -1) for h in distinct.tolist()], np.int64)
            new = np.flatnonzero(index < 0)
            if len(new):
                raw, where = data.tobytes(), lost[first[new]]
                index[new] = np.arange(self.n, self.n + len(new))
                self._learn(distinct[new], [raw[a:b] for a, b in zip(starts[where].tolist(), stops[where].tolist(), strict=True)])
            at[lost] = index[inverse]
        low = self.ends[at]
        n_each = self.ends[at + 1] - low
        total = np.cumsum(n_each)
        out = self.flat[np.repeat(low - (total - n_each), n_each) + np.arange(total[-1] if len(total) else 0)]
        ends = np.concatenate([[0], total])[np.searchsorted(starts, offsets)]
        if self.special and self.special.search(data.tobytes()):
            return self._whole(texts, out, np.diff(ends))
        return out, np.diff(ends)

    def _whole(self, texts: pa.Array, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As encode, where texts with a special token's string are encoded in one piece."""
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for k, x in enumerate(texts.to_pylist()):
            if self.special.search(x.encode()):
                parts[k] = np.array(self.tokenizer.encode(x, add_special_tokens=False).ids, np.int32)
        return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)


class _ByteLevelEncoder(_Encoder):
    """For byte-level BPE: many plain pieces go through the tokenizer in one call.

    Plain pieces (ASCII and common letters, at most one space or line feed, in
    front) are split here as the tokenizer's pattern does, with the letters of
    their bytes put in and a separator between them.  As each id stands for a
    known number of bytes, the sums of those tell where a piece's ids end.
    Other pieces take the tokenizer's own way.
    """

    def __init__(self, path: str):
        super().__init__(path)
        from tokenizers import Tokenizer

        spec = json.loads(self.tokenizer.to_str())
        spec |= {"added_tokens": [], "pre_tokenizer": {"type": "Split", "pattern": {"String": _SEPARATOR}, "behavior": "Removed", "invert": False}}
        self.plain = Tokenizer.from_str(json.dumps(spec))
        self.letters = _byte_letters() | {0: _SEPARATOR}
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.n_bytes = np.zeros(max(vocab.values()) + 1, np.int64)
        self.n_bytes[list(vocab.values())] = [len(t) for t in vocab]

    def _pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [p.decode() for p in pieces]
        plain = np.array([_PLAIN.fullmatch(t) is not None for t in texts])
        counts = np.zeros(len(pieces), np.int64)
        if plain.any():
            own = [t for t, x in zip(texts, plain.tolist(), strict=True) if x]
            parts = ["\0".join(_SPLIT.findall("\0".join(own[k : k + 500]))) for k in range(0, len(own), 500)]
            found = self.plain.encode_batch_fast([p.encode().decode("latin-1").translate(self.letters) for p in parts], add_special_tokens=False)
            ids = np.concatenate([np.array(e.ids, np.int32) for e in found])
            upto = np.cumsum(self.n_bytes[ids])
            lengths = np.array([len(p) for p in pieces], np.int64)[plain]
            counts[plain] = np.diff(np.searchsorted(upto, np.cumsum(lengths)) + 1, prepend=0)
            if plain.all():
                return ids, counts
        other, other_counts = super()._pieces([p for p, x in zip(pieces, plain.tolist(), strict=True) if not x])
        counts[~plain] = other_counts
        out = np.zeros(counts.sum(), np.int32)
        of_plain = np.repeat(plain, counts)
        if plain.any():
            out[of_plain] = ids
        out[~of_plain] = other
        return out, counts


def _places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (hashes >> np.uint64(64 - _PLACE_BITS)).astype(np.int64), (hashes & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)


def _encoder(path: str) -> _Encoder:
    if path not in _encoders:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = spec.get("pre_tokenizer") or {}
        plain = spec["model"]["type"] == "BPE" and not spec.get("normalizer") and steps.get("type") == "ByteLevel" and steps.get("use_regex") and not steps.get("add_prefix_space")
        if not plain:
            raise ValueError(f"{path} is no byte-level BPE without normalizer or prefix space, whose texts can be cut into pieces")
        _encoders[path] = _ByteLevelEncoder(path)
    return _encoders[path]


_encoders: dict[str, _Encoder] = {}


def write_tokens(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> None:
    """Writes (doc_id, part, part_start, n_tokens, ids) of all documents to folder.

    Documents are dealt by ranges of doc_id and sorted within them, so files in
    the order of their part hold ascending ids; null ids come first, and rows
    that repeat an id stand together, ordered by their text.  part_start is the
    number of ids before a document in its part.  Null text counts as empty and
    has the end id alone; other columns are not read.
    """
    path = tokenizer_path(tokenizer)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = _encoder(path)
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            for block in blocks(batch) if batch.num_rows else ():
                ids, counts = encoder.encode(strings(block.column("text")))
                whole = np.insert(ids, np.cumsum(counts), end_id).astype(np.int32)
                counts = counts + 1
                ends = np.cumsum(counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        block.column("doc_id"),
                        pa.array(np.full(len(counts), part, np.int32)),
                        pa.array(before + ends - counts),
                        pa.array(counts),
                        pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(whole)),
                    ],
                    names=["doc_id", "part", "part_start", "n_tokens", "ids"],
                )
                before += int(ends[-1])

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(encode, f"doc_id {kind}, part int, part_start long, n_tokens long, ids array<int>").write.options(**WRITE_OPTIONS).parquet(folder)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids as written; start counts all ids of documents before.

    Only the columns that a query asks for are read: starts need the metadata
    columns, one sum for each part.
    """
    files = spark.read.parquet(folder)
    # one row for each written part, so no more than shuffle partitions: fit for one task, and to broadcast
    sums = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    return files.join(F.broadcast(starts), "part").select("doc_id", (F.col("offset") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def token_digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files."""
    files = read_tokens(spark, folder)
    kind = files.schema["doc_id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("ids")
            values = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            at = lists.offsets.to_numpy()
            crc = [zlib.crc32(values[x:y].tobytes()) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("doc_id", "start", "ids").mapInArrow(digest, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def tokenized(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """Writes the documents' token files to the shared folder and digests them."""
    folder = shared_dir(docs.sparkSession, "tokens")
    write_tokens(docs, folder, tokenizer, end_id)
    return token_digests(docs.sparkSession, folder)
