"""Product codes of vectors with exact integer results: float32 screening, int64 decisions.

Components become integers.  For each part of a vector, one float32 matrix
product gives approximate distances to all codebook entries.  A bound of the
rounding errors makes an interval of each; entries whose interval reaches below
the best upper end are compared again in int64, ties going to the lower index.
Codebooks have a fixed size and travel with the tasks; sums of assigned parts
are added up within tasks before they are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bound_batches, shared_dir, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Integers beyond are moved to this bound, so that sums of squares fit in int64 up to 8,192 components.
LIMIT = 1 << 24
#: Rows whose approximate distances are held at once.
ROWS = 4096
_UNIT = 2.0**-24  # rounding unit of float32


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest row of entries for each row of x (both int64), and the squared distance, both exact.

    The screened value is s = |c|^2 - 2 x.c, the squared distance less |x|^2.
    With u = 2^-24, a float32 product of w terms in any order, of factors rounded
    to float32, is off by less than 1.01 (w + 2) u |x||c| while w u is small; |c|^2
    and the difference are rounded once each.  So s is off by less than
    1.01 (w + 6) u (|c|^2 + 2 |x||c|), which is computed in float64.
    """
    n, w = x.shape
    index, distance = np.zeros(n, np.int64), np.zeros(n, np.int64)
    squares = (entries * entries).sum(axis=1)
    slack = 1.01 * (w + 6) * _UNIT
    lengths = np.sqrt(squares.astype(np.float64)) * (1 + 1e-9)
    narrow = entries.astype(np.float32).T
    for a in range(0, n, ROWS):
        own = x[a : a + ROWS]
        screened = (squares.astype(np.float32) - np.float32(2) * (own.astype(np.float32) @ narrow)).astype(np.float64)
        own_lengths = np.sqrt((own * own).sum(axis=1).astype(np.float64)) * (1 + 1e-9)
        error = slack * (squares.astype(np.float64) + 2 * own_lengths[:, None] * lengths) if slack < 0.005 else np.full(screened.shape, np.inf)
        reach = (screened + error).min(axis=1)
        rows, columns = np.nonzero(screened - error <= reach[:, None])
        d = own[rows] - entries[columns]
        d = (d * d).sum(axis=1)
        starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        best = np.minimum.reduceat(d, starts)
        hits = np.flatnonzero(d == best[rows])  # in the order of rows, then columns
        hits = hits[np.unique(rows[hits], return_index=True)[1]]
        index[a : a + ROWS], distance[a : a + ROWS] = columns[hits], best
    return index, distance


def is_usable(vector: Column) -> Column:
    """Whether a vector is there, without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def integers(vector: Column) -> Column:
    """floor(256 * x) of each component, at most LIMIT away from 0."""
    return F.transform(vector, lambda x: F.floor(F.least(F.greatest(x.cast("double") * SCALE, F.lit(float(-LIMIT))), F.lit(float(LIMIT)))))


def prepared(vectors: DataFrame) -> DataFrame:
    """vec_id, label and x (integers) of the usable rows."""
    vector = F.col("embedding").cast("array<double>")
    return vectors.where(is_usable(vector)).select("vec_id", "label", integers(vector).alias("x"))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), size)


@dataclass(frozen=True)
class Codebooks:
    """Entries as an array of parts, entries and components within a part."""

    entries: np.ndarray

    @property
    def size(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def assigned(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and squared distances, a column for each part, of integer vectors."""
        parts, _, width = self.entries.shape
        found = [nearest(np.ascontiguousarray(x[:, p * width : (p + 1) * width]), self.entries[p]) for p in range(parts)]
        return np.column_stack([i for i, _ in found]), np.column_stack([d for _, d in found])

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        """The integer vectors that codes (a column for each part) stand for."""
        return np.concatenate([self.entries[p][codes[:, p]] for p in range(len(self.entries))], axis=1)


def first_codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> Codebooks | None:
    """The parts of the vectors of the smallest vec_ids (null last; equal ids by components); None without rows."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()  # so many rows at most
    if not first:
        return None
    size = len(first[0].x)
    if size % parts:
        raise ValueError(f"vectors of {size} components can't be cut into {parts} equal parts")
    same = [r.x for r in first if len(r.x) == size]
    return Codebooks(np.array(same, np.int64).reshape(len(same), parts, size // parts).transpose(1, 0, 2).copy())


def refined(rows: DataFrame, books: Codebooks) -> Codebooks:
    """Each entry replaced by the floored mean of the parts assigned to it, unless there are none."""
    parts, entries, width = books.entries.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            x = _matrix(batch.column("x"), books.size)
            codes, _ = books.assigned(x)
            for p in range(parts):
                np.add.at(sums[p], codes[:, p], x[:, p * width : (p + 1) * width])
                counts[p] += np.bincount(codes[:, p], minlength=entries)
        p, e = np.nonzero(counts)
        place = np.repeat(p * entries + e, width)
        columns = [place, np.tile(np.arange(width), len(p)), sums[p, e].ravel(), np.repeat(counts[p, e], width)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["place", "at", "total", "n"])

    totals = rows.select("x").mapInArrow(add, "place long, at long, total long, n long").groupBy("place", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    out = books.entries.reshape(parts * entries, width).copy()
    for r in totals.collect():  # a row for each component of the codebooks at most
        out[r.place, r["at"]] = r.total // r.n
    return Codebooks(out.reshape(parts, entries, width))


def encoded(rows: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code (two hex digits for each part) and error of each row."""
    from pyspark.sql import types as T

    schema = T.StructType([rows.schema["vec_id"], rows.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes, distances = books.assigned(_matrix(batch.column("x"), books.size))
                text = [row.tobytes().hex() for row in codes.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(text, pa.string()), pa.array(distances.sum(axis=1), pa.int64())], names=["vec_id", "label", "code", "error"])

    return rows.mapInArrow(encode, schema)


def with_label_error(coded: DataFrame) -> DataFrame:
    """label_error besides: the error of all rows of the same label (nulls together), at most 2^63 - 1.

    The totals of labels with a thousandth of all rows or more, of which there are
    a thousand at most, are broadcast; rows of other labels are shuffled by label.
    """
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    totals = coded.groupBy(F.col("label").alias("_label")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), most).cast("long").alias("label_error"), F.count("*").alias("_n"))
    n = coded.count()
    frequent, rare = totals.where(F.col("_n") * 1000 >= n).drop("_n"), totals.where(F.col("_n") * 1000 < n).drop("_n")
    same = F.col("label").eqNullSafe(F.col("_label"))
    joined = coded.join(F.broadcast(frequent), same, "left")
    rest = joined.where("label_error is null").drop("_label", "label_error").join(rare, same)
    return joined.where("label_error is not null").unionByName(rest).drop("_label")


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of the usable rows of vec_id, embedding and label.

    Rows whose vector is null, or holds null or non-finite components, are
    dropped; so are those of another length than the vector of the smallest
    vec_id left, as no codebook fits them.  Components beyond 65,536 count as
    65,536 (LIMIT).  Repeated ids are rows of their own, null ids come last;
    fewer rows than entries make smaller codebooks; no rows, no rows.  Other
    columns are not read.  A length that ``parts`` doesn't divide is an error.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    bound_batches(vectors.sparkSession)
    rows = prepared(vectors)
    books = first_codebooks(rows, parts, entries)
    if books is None:
        return rows.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    rows = rows.where(F.size("x") == books.size)
    for _ in range(rounds):
        books = refined(rows, books)
    coded = written(encoded(rows, books), f"{shared_dir(vectors.sparkSession, 'codes')}/rows")
    return with_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
