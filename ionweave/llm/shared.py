"""The folder that driver and executors share: written tables, and arrays that tasks map into memory."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

#: What this worker has mapped, those asked for last at the end.
_mapped: dict[str, object] = {}
#: Files that a worker keeps mapped; beyond them, those that were not asked for the longest are let go.
MAPPED = 4096

#: Rows that a task hands to Python at once: texts can be long, and tasks share an executor's memory.
BATCH_ROWS = 500


def bound_batches(spark: SparkSession) -> None:
    """Sets the session's limit of rows a batch where it is above BATCH_ROWS."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir.

    Where that setting is absent and the session runs in one local process (as
    in tests), a temporary folder is made and set; on a cluster it must be set.
    Every operator starts here, so Arrow batches are bounded here, too.
    """
    bound_batches(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='ionweave-')}"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str, **options: str) -> DataFrame:
    """The frame written as Parquet and read back: its lineage starts at the files."""
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _put(folder: str, name: str, pieces: Iterable[bytes | memoryview]) -> None:
    """A file of the pieces; a rerun task replaces it by an equal one."""
    fs, root = _filesystem(folder)
    fs.create_dir(root, recursive=True)
    part = f"{root}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as f:
        for x in pieces:
            f.write(x)
    fs.move(part, f"{root}/{name}")


def _raw(x: np.ndarray) -> memoryview:
    return np.ascontiguousarray(x).view(np.uint8).data


def save_arrays(folder: str, name: str, **arrays: np.ndarray) -> None:
    """Each array as a file ``folder/name.key``."""
    for key, x in arrays.items():
        _put(folder, f"{name}.{key}", [_raw(x)])


def save_together(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """All arrays in one file, behind a table of their places."""
    places, at = {}, 0
    for key, x in arrays.items():
        places[key] = (at, x.nbytes)
        at += -(-x.nbytes // 8) * 8
    table = json.dumps(places).encode()
    table += b" " * (-len(table) % 8)
    padded = (piece for x in arrays.values() for piece in (_raw(x), bytes(-x.nbytes % 8)))
    _put(folder, name, [len(table).to_bytes(8, "little"), table, *padded])


def _cached(where: str, made: Callable[[], object]) -> object:
    x = _mapped.pop(where, None)
    if x is None:
        while len(_mapped) >= MAPPED:
            del _mapped[next(iter(_mapped))]
        x = made()
    _mapped[where] = x
    return x


def _mapped_file(where: str) -> np.ndarray:
    """The bytes of a file, memory-mapped; none if there is no such file.

    From a store that is not mounted, the file is copied to a temporary file
    that is unlinked once mapped, so nothing stays behind.
    """
    fs, path = _filesystem(where)
    if not fs.get_file_info(path).size:  # None, if there is no such file
        return np.zeros(0, np.uint8)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.asarray(np.memmap(path, np.uint8, "r"))
    fd, local = tempfile.mkstemp()
    try:
        with fs.open_input_stream(path) as f, os.fdopen(fd, "wb") as out:
            while block := f.read(8 << 20):
                out.write(block)
        return np.asarray(np.memmap(local, np.uint8, "r"))
    finally:
        os.unlink(local)


def map_array(folder: str, name: str, dtype) -> np.ndarray:
    """The array of ``folder/name``, memory-mapped; empty where none was saved."""
    where = f"{folder}/{name}"
    return _cached(where, lambda: _mapped_file(where)).view(dtype)


class Arrays:
    """The arrays that were saved together in a file, memory-mapped."""

    def __init__(self, data: np.ndarray):
        self._begin = 8 + int.from_bytes(data[:8].tobytes(), "little")
        self._data = data
        self._places = json.loads(data[8 : self._begin].tobytes() or b"{}")

    def get(self, key: str, dtype) -> np.ndarray:
        """The array of that name; empty where none was saved."""
        at, size = self._places.get(key, (0, 0))
        return self._data[self._begin + at : self._begin + at + size].view(dtype)


def map_together(folder: str, name: str) -> Arrays:
    where = f"{folder}/{name}"
    return _cached(where, lambda: Arrays(_mapped_file(where)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class SortedStore:
    """A table keyed by a long, as sorted arrays that tasks map into memory, in shards by some of its bits."""

    def __init__(self, folder: str, name: str, bits: int):
        self.folder, self.name, self.bits = folder, name, bits

    @classmethod
    def saved(cls, df: DataFrame, key: str, folder: str, name: str, rows: int, value: str | None = None) -> SortedStore:
        """Saves df's key (and value), both long; about a million of the given number of rows go in a shard."""
        import pyarrow as pa
        from pyspark.sql import functions as F

        store = cls(folder, name, max(5, (rows >> 20).bit_length()))
        shard = F.col("key").bitwiseXOR(F.shiftrightunsigned("key", 32)).bitwiseXOR(F.shiftrightunsigned("key", 16)).bitwiseAND(F.lit((1 << store.bits) - 1))

        def save(table: pa.Table) -> pa.Table:
            s = table.column("shard")[0].as_py()
            keys = table.column("key").to_numpy()
            order = np.argsort(keys, kind="stable")
            save_arrays(folder, f"{name}{s}", key=keys[order], **({"value": table.column("value").to_numpy()[order]} if value else {}))
            return pa.table({"n": pa.array([len(keys)], pa.int64())})

        columns = [F.col(key).cast("long").alias("key"), *([F.col(value).cast("long").alias("value")] if value else [])]
        written(df.select(*columns).withColumn("shard", shard.cast("int")).groupBy("shard").applyInArrow(save, "n long"), f"{folder}/{name}")
        return store

    def shards(self, keys: np.ndarray) -> np.ndarray:
        x = keys.view(np.uint64)
        return ((x ^ (x >> np.uint64(32)) ^ (x >> np.uint64(16))) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key (int64) is there, and its value (0 if not, or if there are none)."""
        shards = self.shards(keys)
        found, values = np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        order = np.argsort(shards, kind="stable")
        bounds = np.searchsorted(shards[order], np.arange((1 << self.bits) + 1))
        for s in np.flatnonzero(np.diff(bounds)).tolist():
            own = order[bounds[s] : bounds[s + 1]]
            known = map_array(self.folder, f"{self.name}{s}.key", np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, keys[own]), len(known) - 1)
                found[own] = same = known[at] == keys[own]
                stored = map_array(self.folder, f"{self.name}{s}.value", np.int64)
                if len(stored):
                    values[own] = np.where(same, stored[at], 0)
        return found, values
