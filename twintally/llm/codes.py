"""Vector codes: each part of a vector becomes the index of the nearest entry of that part's codebook.

The nearest entry is found by slices and bitmasks. A codebook keeps its entries' coordinates sorted for each dimension,
with a mask of the entries before each place. An initial radius, the distance to the entry that is next to the part in
its widest dimension, selects a range of places per dimension; the masks at both ends give the entries in that range,
and the masks of all dimensions are ANDed as 64-bit words. No entry outside can be nearer than the one that gave the
radius, so the nearest of the candidates, by exact integer distances, is the nearest of all.

Codebooks start as the parts of the vectors with the least ids. In each round tasks add up the parts of each entry, Spark
adds up the tasks' sums, and the new entries (``parts`` x ``entries`` rows, whatever the table's size) return to the driver.

Defined results: rows whose vector is null or holds a null or non-finite component are dropped; equal ids are ordered by
their vectors, a null id comes last; repeated rows count each; with fewer vectors than entries there are fewer entries;
ties go to the lower index. The length of vectors is that of the one with the least id: rows of another length have null
results, and a length that the parts don't divide is cut as evenly as possible. Components whose integers are so large that
distances would leave 64 bits count as the largest that don't. Null labels are one label; a sum of a label beyond 64 bits is
null. Other columns don't matter; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twintally.llm.words import map_batches
from twintally.sources.staging import scratch, stage

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Rows of a batch that are compared at once.
ROWS = 1 << 14


class Codebook:
    """Entries of one part, their coordinates sliced by dimension."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        n, width = entries.shape
        self.order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(entries, self.order, axis=0)
        self.words = -(-n // 64)
        bits = np.zeros((n, self.words), np.uint64)
        bits[np.arange(n), np.arange(n) // 64] = np.uint64(1) << (np.arange(n) % 64).astype(np.uint64)
        #: before[j][k]: the entries at the first k places of dimension j.
        self.before = np.zeros((width, n + 1, self.words), np.uint64)
        for j in range(width):
            self.before[j, 1:] = np.bitwise_or.accumulate(bits[self.order[:, j]], axis=0)
        self.widest = int(np.argmax(np.ptp(entries, axis=0))) if width else 0

    def candidates(self, points: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Masks of the entries within the radius in every dimension."""
        found = np.full((len(points), self.words), np.uint64(0xFFFFFFFFFFFFFFFF))
        for j in range(points.shape[1]):
            low = np.searchsorted(self.sorted[:, j], points[:, j] - radius, "left")
            high = np.searchsorted(self.sorted[:, j], points[:, j] + radius, "right")
            found &= self.before[j][high] & ~self.before[j][low]
        return found

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each point's nearest entry and the squared distance."""
        n, width = self.entries.shape
        if not width:
            return (np.zeros(len(points), np.int64),) * 2
        j = self.widest
        place = np.minimum(np.searchsorted(self.sorted[:, j], points[:, j]), n - 1)
        best = ((points - self.entries[self.order[place, j]]) ** 2).sum(axis=1)
        # One more than the root, so that rounding never makes the range too narrow.
        masks = self.candidates(points, np.sqrt(best.astype(np.float64)).astype(np.int64) + 1)
        index, best = np.full(len(points), n, np.int64), np.full(len(points), np.iinfo(np.int64).max)
        for e in range(n):
            rows = np.flatnonzero(masks[:, e // 64] >> np.uint64(e % 64) & np.uint64(1))
            distance = ((points[rows] - self.entries[e]) ** 2).sum(axis=1)
            nearer = distance < best[rows]
            index[rows[nearer]], best[rows[nearer]] = e, distance[nearer]
        return index, best


def bounds(length: int, parts: int) -> list[int]:
    return [length * p // parts for p in range(parts + 1)]


def usable(vector: str) -> Column:
    """Whether a vector is there with finite components only."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))


def integers(values: np.ndarray, rows: int, length: int, scale: int) -> np.ndarray:
    limit = isqrt((1 << 62) // max(length, 1)) // 2
    return np.clip(np.floor(values.astype(np.float64) * scale), -limit, limit).astype(np.int64).reshape(rows, length)


def rows_of(column: pa.Array, length: int, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of rows with vectors of that length, and their integers."""
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    own = np.flatnonzero(sizes == length)
    for a in range(0, len(own), ROWS):
        rows = own[a : a + ROWS]
        yield rows, integers(column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False), len(rows), length, scale)


def assigned(vectors: np.ndarray, books: list[Codebook], cuts: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    for p, book in enumerate(books):
        points = vectors[:, cuts[p] : cuts[p + 1]]
        yield (p, points, *book.nearest(points))


def next_entries(vectors: DataFrame, entries: list[np.ndarray], scale: int) -> list[np.ndarray]:
    """The entries of all parts after a round."""
    length = sum(x.shape[1] for x in entries)
    cuts = bounds(length, len(entries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [Codebook(x) for x in entries]
        totals = [np.zeros((len(x), x.shape[1] + 1), np.int64) for x in entries]
        for batch in batches:
            for _, own in rows_of(batch.column(0), length, scale):
                for p, points, index, _ in assigned(own, books, cuts):
                    np.add.at(totals[p], index, np.column_stack([points, np.ones(len(points), np.int64)]))
        for p, total in enumerate(totals):
            entry, place = np.nonzero(total)
            columns = [pa.array(x, pa.int32()) for x in (np.full(len(entry), p), entry, place)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total[entry, place], pa.int64())], ["part", "entry", "place", "total"])

    parts = map_batches(vectors.select("vector"), run, "part int, entry int, place int, total bigint")
    found = parts.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    sums = {(r["part"], r["entry"], r["place"]): int(r["total"]) for r in found.collect()}
    out = []
    for p, old in enumerate(entries):
        new = old.copy()
        for e in range(len(old)):
            count = sums.get((p, e, old.shape[1]), 0)
            if count:
                new[e] = [sums.get((p, e, k), 0) // count for k in range(old.shape[1])]
        out.append(new)
    return out


def encode(vectors: DataFrame, entries: list[np.ndarray], scale: int) -> DataFrame:
    """(id, label, code, error) of each row."""
    length = sum(x.shape[1] for x in entries)
    cuts = bounds(length, len(entries))
    digits = max(2, len(f"{len(entries[0]) - 1:x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [Codebook(x) for x in entries]
        for batch in batches:
            codes, errors = np.full(len(batch), None, object), np.zeros(len(batch), np.int64)
            for rows, own in rows_of(batch.column(2), length, scale):
                spelled = np.full(len(rows), "", object)
                for _, _, index, distance in assigned(own, books, cuts):
                    spelled += np.array([f"{e:0{digits}x}" for e in range(len(entries[0]))], object)[index]
                    errors[rows] += distance
                codes[rows] = spelled
            none = np.array([x is None for x in codes], bool)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes.tolist(), pa.string()), pa.array(errors, pa.int64(), mask=none)], ["id", "label", "code", "error"])

    kinds = [vectors.schema[c].dataType.simpleString() for c in ("id", "label")]
    return map_batches(vectors.select("id", "label", "vector"), run, f"id {kinds[0]}, label {kinds[1]}, code string, error bigint")


def codebooks_sha256(entries: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for part in entries for x in part.ravel().tolist()).encode()).hexdigest()


def compress(
    table: DataFrame,
    parts: int = PARTS,
    n_entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """One row per usable vector: id, ``code``, ``error``, ``label_error`` and ``codebooks_sha256``."""
    vectors = table.where(usable(vector_col)).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    first = [r["vector"] for r in vectors.orderBy(F.col("id").asc_nulls_last(), "vector").limit(n_entries).collect()]
    length = len(first[0]) if first else 0
    first = [v for v in first if len(v) == length] or [[]]
    start = integers(np.array(first, np.float64), len(first), length, scale)
    cuts = bounds(length, parts)
    entries = [start[:, cuts[p] : cuts[p + 1]] for p in range(parts)]
    if length:
        for _ in range(rounds):
            entries = next_entries(vectors, entries, scale)
    with scratch(table.sparkSession):
        coded = stage(encode(vectors, entries, scale), "codes", keep=True)
        by_label = stage(coded.groupBy("label").agg(F.try_sum("error").alias("label_error")), "label-errors", keep=True)
    found = coded.join(by_label.withColumnRenamed("label", "of"), F.col("label").eqNullSafe(F.col("of")))
    return found.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(codebooks_sha256(entries)).alias("codebooks_sha256"))
