"""N-gram Jaccard join by token-combination prefixes.

Tokens are hashes of a text's word n-grams.  In one order of all tokens (rare
ones first), two sets that are similar enough share tokens in their prefixes.
Rare tokens are indexed alone; the others are dealt into classes, and pairs of
tokens of a class are indexed, for which prefixes are extended until at least
one signature of every similar partner must survive:

    a set of n tokens may miss at most t = n - ceil(threshold * n) of them in a
    partner; a missing token breaks one rare signature, and breaking all pairs
    of a class with c tokens in the prefix takes c - 1; so the prefix ends where
    rare tokens + sum of (c - 1) exceeds t.

The number of classes follows the set's size, and a set is indexed for every
number that a partner of allowed size has.  Which tokens are rare is counted
over all texts for a quarter of the hash range; the rest counts as frequent.
Equal texts are collapsed first.  Candidates are verified on the whole sets.

Members of one signature are not paired with each other: they are compared with
one leader, linked ones share a component, and only members whose components still differ
are compared, in chunks and by sketches first, without emitting their pairs; so
no link between different components is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ionweave.operators.keys import numbered

from .components import components
from .shared import SortedStore, map_array, save_arrays, shared_dir, written
from .textblocks import Words, blocks, mix, shingles, strings

#: Documents in which a token must occur to count as frequent.
FREQUENT = 16
#: Tokens below this hash are counted.
COUNTED = np.uint64(1 << 62)
#: Rounds in which members of a signature meet a leader.
LEADERS = 2
#: Members of a signature that one side of a comparison holds.
CHUNK = 1000
#: Bytes of token sets in one saved shard.
SHARD_BYTES = 32 << 20
_K, _K2 = np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F)


def at_least(n: int, percent: int) -> int:
    """The least number of a set's n tokens that a partner must hold."""
    return -(-n * percent // 100)


def level(n: int) -> int:
    """Log2 of the number of classes for sets of n tokens."""
    return max(n // 16, 1).bit_length() - 1


def signatures(tokens: np.ndarray, rare: np.ndarray, percent: int) -> np.ndarray:
    """The signatures of one set: sorted distinct token hashes, and which of them are rare."""
    n = len(tokens)
    if not n:
        return np.zeros(0, np.uint64)
    largest = n * 100 // percent
    if largest == n:
        # partners are equal sets
        return mix(np.array([np.bitwise_xor.reduce(mix(tokens * _K2)) ^ np.uint64(n)], np.uint64))
    need = n - at_least(n, percent) + 1
    alone = tokens[rare][:need]
    if len(alone) == need:
        return alone
    out = [alone]
    need -= len(alone)
    others = tokens[~rare]
    for bits in range(level(at_least(n, percent)), level(largest) + 1):
        of_class = (others >> np.uint64(7)) & np.uint64((1 << bits) - 1)
        new = np.zeros(len(others), bool)
        new[np.unique(of_class, return_index=True)[1]] = True
        end = int(np.searchsorted(np.cumsum(~new), need)) + 1
        x, c = others[:end], of_class[:end]
        order = np.argsort(c, kind="stable")
        x, c = x[order], c[order]
        for d in range(1, len(x)):
            same = c[d:] == c[:-d]
            if not same.any():
                break
            out.append(mix((x[:-d][same] * _K + x[d:][same]) ^ mix(np.full(1, bits + 1, np.uint64))))
    return np.concatenate(out)


def _folded_fingerprints(words: Words) -> list[bytes]:
    raw = words.hashes.tobytes()
    return [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)]


class _Join:
    def __init__(self, docs: DataFrame, k: int, percent: int):
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        self.k, self.percent = k, percent
        self.folder = shared_dir(docs.sparkSession, "jaccard")

    def __getstate__(self) -> dict:
        """What tasks get: all but the frame."""
        return {k: v for k, v in vars(self).items() if k != "docs"}

    def collapse(self) -> DataFrame:
        """(doc_id, rep): documents with equal words share the smallest id; saves which ids are left."""

        def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in blocks(batch) if batch.num_rows else ():
                    found = np.frombuffer(b"".join(_folded_fingerprints(Words(strings(part.column("text"))))), np.int64).reshape(-1, 2)
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found[:, 0]), pa.array(found[:, 1])], names=["doc_id", "f", "g"])

        rows = written(self.docs.mapInArrow(fingerprints, "doc_id long, f long, g long"), f"{self.folder}/fingerprints")
        reps = rows.groupBy("f", "g").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
        repeated = written(reps.where("n > 1"), f"{self.folder}/repeated")
        rows = written(rows.join(repeated, ["f", "g"], "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep")), f"{self.folder}/rows")
        copies = rows.where("doc_id <> rep")
        self.copies = SortedStore.saved(copies, "doc_id", self.folder, "copies", copies.count())
        return rows

    def sets(self, batches: Iterator[pa.RecordBatch], only: SortedStore | None = None) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
        """(ids, token sets) of each block, of documents that aren't copies (and are in only)."""
        for batch in batches:
            batch = batch.filter(batch.column("doc_id").is_valid())
            ids = batch.column("doc_id").to_numpy()
            keep = ~self.copies.find(ids)[0]
            if only is not None:
                keep &= only.find(ids)[0]
            batch = batch.filter(pa.array(keep))
            for part in blocks(batch) if batch.num_rows else ():
                yield part.column("doc_id").to_numpy(), shingles(Words(strings(part.column("text"))), self.k)

    def count_frequent(self) -> None:
        """Saves the tokens of the counted range that occur in many documents."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple[np.ndarray, np.ndarray]] = []

            def emit() -> pa.RecordBatch:
                h = np.concatenate([x for x, _ in held])
                n = np.concatenate([x for _, x in held])
                held.clear()
                order = np.argsort(h)
                h = h[order]
                first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, int)
                n = np.add.reduceat(n[order], first) if len(h) else n
                h = h[first]
                shard = (h >> np.uint64(62 - bits)).astype(np.int64)
                bounds = np.searchsorted(shard, np.arange((1 << bits) + 1))
                rows = [(s, h[a:b].tobytes(), n[a:b].astype(np.uint32).tobytes()) for s, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if b > a]
                return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["shard", "hash", "count"])

            for _, sets in self.sets(batches):
                x = np.concatenate(sets)
                held.append(np.unique(x[x < COUNTED], return_counts=True))
                if sum(len(h) for h, _ in held) > 1_000_000:
                    yield emit()
            if held:
                yield emit()

        def total(table: pa.Table) -> pa.Table:
            h = np.frombuffer(b"".join(table.column("hash").to_pylist()), np.uint64)
            n = np.frombuffer(b"".join(table.column("count").to_pylist()), np.uint32).astype(np.int64)
            order = np.argsort(h)
            h = h[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            often = np.add.reduceat(n[order], first) >= FREQUENT
            return pa.table({"hash": pa.array(h[first][often].view(np.int64))})

        size = self.docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        bits = max(5, (size // (64 << 20)).bit_length())
        found = self.docs.mapInArrow(count, "shard int, hash binary, count binary").groupBy("shard").applyInArrow(total, "hash long")
        found = written(found, f"{self.folder}/often")
        self.often = SortedStore.saved(found, "hash", self.folder, "frequent", found.count())

    def postings(self) -> tuple[DataFrame, DataFrame]:
        """(sig, doc, n) of all signatures, and (doc, n) of all documents that aren't copies."""

        def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, sets in self.sets(batches):
                x = np.concatenate(sets)
                rare = x < COUNTED
                rare[rare] = ~self.often.find(x[rare].view(np.int64))[0]
                ends = np.cumsum([len(s) for s in sets])
                sigs = [signatures(s, rare[e - len(s) : e], self.percent) for s, e in zip(sets, ends.tolist(), strict=True)]
                each = [len(s) for s in sigs]
                sizes = np.array([len(s) for s in sets], np.int32)
                docs = np.concatenate([np.repeat(ids, each), ids])
                sig = np.concatenate([*sigs, np.zeros(len(ids), np.uint64)]).view(np.int64)
                alone = np.zeros(len(sig), bool)
                alone[len(sig) - len(ids) :] = True
                yield pa.RecordBatch.from_arrays([pa.array(sig, mask=alone), pa.array(docs), pa.array(np.concatenate([np.repeat(sizes, each), sizes]))], names=["sig", "doc", "n"])

        rows = written(self.docs.mapInArrow(index, "sig long, doc long, n int"), f"{self.folder}/postings", compression="zstd")
        return rows.where("sig is not null"), rows.where("sig is null").select("doc", "n")

    def save_sets(self, wanted: DataFrame, name: str) -> None:
        """Saves the token sets of the wanted documents (doc, n), in shards by id that have about SHARD_BYTES each."""
        wanted = written(wanted, f"{self.folder}/{name}-wanted")
        rows, tokens = wanted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        own = SortedStore.saved(wanted, "doc", self.folder, f"{name}-ids", rows)
        shards = SortedStore(self.folder, name, max(own.bits, (8 * tokens // SHARD_BYTES).bit_length()))

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, sets in self.sets(batches, own):
                yield pa.RecordBatch.from_arrays([pa.array(shards.shards(ids).astype(np.int32)), pa.array(ids), pa.array([s.tobytes() for s in sets], pa.binary())], names=["shard", "doc", "tokens"])

        def save(table: pa.Table) -> pa.Table:
            s = table.column("shard")[0].as_py()
            ids = table.column("doc").to_numpy()
            order = np.argsort(ids, kind="stable")
            sets = table.column("tokens").combine_chunks().take(pa.array(order)).to_pylist()
            ends = np.cumsum([0, *(len(x) // 8 for x in sets)])
            save_arrays(self.folder, f"{name}{s}", ids=ids[order], ends=ends, tokens=np.frombuffer(b"".join(sets), np.uint64))
            return pa.table({"n": pa.array([len(ids)], pa.int64())})

        rows = self.docs.mapInArrow(emit, "shard int, doc long, tokens binary")
        written(rows.groupBy("shard").applyInArrow(save, "n long"), f"{self.folder}/{name}-saved")
        self.stored = (name, shards)

    def verified(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) whose whole sets are similar enough."""
        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
                order = np.lexsort((a, b))
                a, b = a[order], b[order]
                keep = np.zeros(len(a), bool)
                last, y = None, np.zeros(0, np.uint64)
                for i, (x, q) in enumerate(zip(self.tokens(a), b.tolist(), strict=True)):
                    if q != last:
                        last, y = q, np.array(next(self.tokens(b[i : i + 1])))
                    keep[i] = self.similar(x, y)
                yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

        return written(pairs.select("a", "b").mapInArrow(verify, "a long, b long"), f"{self.folder}/{name}")

    def within_signatures(self, postings: DataFrame) -> DataFrame:
        """Links (a, b) that join the labels of members of a signature wherever similar pairs do.

        Members are taken in chunks, and a task compares two chunks of a
        signature: parity sketches bound the symmetric difference of a pair
        from below, the rest is verified on the whole sets, and a pair is
        passed over once links found before connect it.
        """
        members = postings.groupBy("sig").agg(F.count("*").alias("members"))
        chunk = F.pmod(F.xxhash64("doc"), F.ceil(F.col("members") / CHUNK)).cast("int").alias("chunk")
        chunks = postings.join(members, "sig").select("sig", chunk, F.struct("doc", "n", "label").alias("m")).groupBy("sig", "chunk").agg(F.collect_list("m").alias("x"))
        chunks = written(chunks, f"{self.folder}/chunks", compression="zstd")
        others = chunks.select("sig", F.col("chunk").alias("other"), F.col("x").alias("y"))
        many = chunks.join(others, "sig").where("chunk < other").select("x", "y")
        sides = chunks.select("x", F.expr("cast(null as array<struct<doc:bigint,n:int,label:bigint>>)").alias("y")).unionByName(many)

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sketch: dict[tuple[int, int], np.ndarray] = {}
            verdicts: dict[tuple[int, int], bool] = {}
            root: dict[int, int] = {}
            for batch in batches:
                found: list[tuple[int, int]] = []
                for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                    if len(sketch) > 20_000:
                        sketch.clear()
                    if len(verdicts) > 200_000:
                        verdicts.clear()
                    found += self._compared(x.values, y.values if y.is_valid else None, sketch, verdicts, root)
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int64()), pa.array([q for _, q in found], pa.int64())], names=["a", "b"])

        return written(sides.mapInArrow(compare, "a long, b long"), f"{self.folder}/within")

    def _compared(self, x: pa.StructArray, y: pa.StructArray | None, sketch: dict, verdicts: dict, root: dict[int, int]) -> list[tuple[int, int]]:
        """Links between members of x and y (of x alone) that connect labels which root, the task's forest, doesn't connect yet."""
        a, n, label = (x.field(f).to_numpy() for f in ("doc", "n", "label"))
        b, m, other = (a, n, label) if y is None else (y.field(f).to_numpy() for f in ("doc", "n", "label"))
        may = label[:, None] != other[None, :]
        may &= 100 * np.minimum(n[:, None], m[None, :]) >= self.percent * np.maximum(n[:, None], m[None, :])
        if y is None:
            may &= a[:, None] < b[None, :]
        i, j = np.nonzero(may)
        if len(i) > 8:
            bits = 1 << max(8, min(13, (2 * int(max(n.max(), m.max()))).bit_length()))
            p, q = self.sketches(a, bits, sketch), self.sketches(b, bits, sketch)
            most = (n[i].astype(np.int64) + m[j]) * (100 - self.percent) // (100 + self.percent)
            off = np.concatenate([np.bitwise_count(p[i[s : s + 65536]] ^ q[j[s : s + 65536]]).sum(axis=1) for s in range(0, len(i), 65536)])
            i, j = i[off <= most], j[off <= most]

        def find(k: int) -> int:
            while (up := root.get(k, k)) != k:
                root[k] = root.get(up, up)
                k = up
            return k

        out = []
        for p, q, u, v in zip(a[i].tolist(), b[j].tolist(), label[i].tolist(), other[j].tolist(), strict=True):
            u, v = find(u), find(v)
            if u != v:
                pair = (min(p, q), max(p, q))
                if pair not in verdicts:
                    s, t = self.tokens(np.array(pair))
                    verdicts[pair] = self.similar(s, t)
                if verdicts[pair]:
                    root[u] = v
                    out.append(pair)
        return out

    def similar(self, x: np.ndarray, y: np.ndarray) -> bool:
        if not len(x) or not len(y):
            return False
        at = np.searchsorted(y, x)
        at[at == len(y)] = 0
        both = int(np.count_nonzero(y[at] == x))
        return 100 * both >= self.percent * (len(x) + len(y) - both)

    def tokens(self, docs: np.ndarray) -> Iterator[np.ndarray]:
        """The saved token set of each document, empty if there is none."""
        store, own = self.stored
        for doc, shard in zip(docs.tolist(), own.shards(docs).tolist(), strict=True):
            ids = map_array(self.folder, f"{store}{shard}.ids", np.int64)
            k = int(np.searchsorted(ids, doc))
            if k == len(ids) or ids[k] != doc:
                yield np.zeros(0, np.uint64)
            else:
                ends = map_array(self.folder, f"{store}{shard}.ends", np.int64)
                yield map_array(self.folder, f"{store}{shard}.tokens", np.uint64)[ends[k] : ends[k + 1]]

    def sketches(self, docs: np.ndarray, bits: int, kept: dict) -> np.ndarray:
        """For each document, the parity of its tokens in each of ``bits`` classes: sketches differ in no more bits than sets in tokens."""
        out = np.zeros((len(docs), bits // 64), np.uint64)
        for k, doc in enumerate(docs.tolist()):
            if (doc, bits) not in kept:
                (t,) = self.tokens(docs[k : k + 1])
                of_class = ((t >> np.uint64(11)) & np.uint64(bits - 1)).astype(np.int64)
                kept[doc, bits] = np.packbits((np.bincount(of_class, minlength=bits) & 1).astype(bool)).view(np.uint64)
            out[k] = kept[doc, bits]
        return out

    def run(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(doc_id, rep) of all documents, (doc, n) and (node, label) of those that aren't copies."""
        rows = self.collapse()
        self.count_frequent()
        postings, sizes = self.postings()
        shared = postings.groupBy("sig").agg(F.count("*").alias("members")).where("members > 1").select("sig")
        width = -np.log(self.percent / 100)
        postings = postings.join(shared, "sig").withColumn("size_class", F.floor(F.log("n") / float(width)).cast("int"))
        postings = written(postings, f"{self.folder}/shared", compression="zstd")
        fits = F.expr(f"100 * least(n, m) >= {self.percent} * greatest(n, m)")
        links, labels = None, None
        for k in range(LEADERS + 1):
            if labels is not None:
                open_ = postings.drop("label").join(labels, F.col("doc") == F.col("node"), "left").withColumn("label", F.coalesce("label", "doc")).select("sig", "doc", "n", "size_class", "label")
                mixed = open_.groupBy("sig").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("sig")
                postings = written(open_.join(mixed, "sig"), f"{self.folder}/open{k}", compression="zstd")
            else:
                postings = postings.withColumn("label", F.col("doc"))
            if k < LEADERS:
                turn = F.struct(F.xxhash64("doc", F.lit(k)).alias("h"), "doc", "n", "label")
                leaders = postings.groupBy("sig", "size_class").agg(F.min(turn).alias("x")).select("sig", "size_class", F.col("x.doc").alias("b"), F.col("x.n").alias("m"), F.col("x.label").alias("other"))
                leaders = leaders.unionByName(leaders.withColumn("size_class", F.col("size_class") + 1))
                pairs = postings.join(leaders, ["sig", "size_class"]).where(fits & (F.col("label") != F.col("other")))
                pairs = pairs.select(F.least(F.col("doc"), "b").alias("a"), F.greatest(F.col("doc"), "b").alias("b"))
                pairs = pairs.distinct()
                if k:
                    pairs = pairs.join(tested, ["a", "b"], "left_anti")
                pairs = written(pairs, f"{self.folder}/pairs{k}")
                tested = pairs if not k else tested.unionByName(pairs)
                if not k:
                    self.save_sets(postings.groupBy("doc").agg(F.max("n").alias("n")), "sets")
                found = self.verified(pairs, f"links{k}")
            else:
                found = self.within_signatures(postings)
            links = found if links is None else links.unionByName(found)
            known = links if labels is None else found.unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b")))
            labels = written(components(known), f"{self.folder}/labels{k}")
        return rows, sizes, labels


def linked(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id reachable by links) of each document.

    A document's set: its distinct k-word shingles, A-Z folded; with fewer
    words, all of them as one; with none (null or empty text) empty and linked
    with nothing.  Two link when 100 * intersection >= percent * union.  Rows
    with a null id have no set and no component; of rows that repeat an id with
    different texts one stands for the others.  Ids that are no whole numbers are
    numbered in their order first.  Other columns are not read.
    """
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        ids = numbered(docs.select("doc_id").where("doc_id is not null").distinct(), ["doc_id"], key="_n")
        known = docs.select("doc_id", "text").join(ids, "doc_id", "left").select(F.col("_n").alias("doc_id"), "text")
        found = linked(known, k, percent).withColumnRenamed("doc_id", "_n")
        found = found.join(ids, "_n", "left").join(ids.select(F.col("_n").alias("component_id"), F.col("doc_id").alias("_c")), "component_id", "left")
        return found.select("doc_id", "n_shingles", F.col("_c").alias("component_id"))
    rows, sizes, labels = _Join(docs, k, percent).run()
    sizes = sizes.groupBy("doc").agg(F.max("n").alias("n"))
    reps = sizes.join(labels, F.col("doc") == F.col("node"), "left").select("doc", F.col("n").cast("long").alias("n_shingles"), F.coalesce("label", "doc").alias("component"))
    out = rows.join(reps, (F.col("rep") == F.col("doc")) & F.col("doc_id").isNotNull(), "left")
    alone = F.col("n_shingles") == 0
    return out.select("doc_id", F.coalesce("n_shingles", F.lit(0)).alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents, whole and with all columns, but for those whose component has a smaller id.

    Near copies by distinct k-word shingles, linked at this similarity in
    percent; which ids go is mapped into memory by the tasks, so texts aren't
    shuffled.  Rows with a null id, and texts without words, stay.
    """
    found = linked(docs, k, percent).where("doc_id <> component_id").select("doc_id").distinct()
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        return docs.join(found.withColumnRenamed("doc_id", "_id"), F.col("doc_id") == F.col("_id"), "left_anti")
    folder = shared_dir(docs.sparkSession, "near")
    found = written(found, f"{folder}/ids")
    gone = SortedStore.saved(found, "doc_id", folder, "gone", found.count())

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64())
            drop = gone.find(ids.fill_null(0).to_numpy())[0] & ids.is_valid().to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(~drop))

    return docs.mapInArrow(keep, docs.schema)
