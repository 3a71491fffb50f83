"""Packing of documents into sequences of a fixed number of tokens.

Documents become pieces: those with more tokens than a sequence holds are cut from their end, so that only the first
piece is shorter. Pieces are dealt out to groups of about ``GROUP_PIECES``, and every group is packed by itself with
bounded-space online best-fit: at most ``OPEN_BINS`` bins are open; a bitset keyed by free space finds the tightest bin
that takes a piece; with none, a new bin is opened, and if that is one too many, the fullest is closed first. The
packing sees lengths only; ids are written once and never shuffled for it.

Defined results: null and empty texts are the end token alone; repeated rows are packed each; other columns, whatever
their names, don't matter; an empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twintally.llm.tokens import encoder
from twintally.llm.words import map_batches, slices
from twintally.sources.staging import stage

END_ID = 2
GROUP_PIECES = 1 << 18
OPEN_BINS = 1024
SLICE_BYTES = 2 << 20


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, piece, start, length, ids): the ids of each piece as little-endian 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer, end_id)
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(2), SLICE_BYTES):
                ids, begin = own.encode(data, offsets)
                total = np.diff(begin)
                parts = -(-total // capacity)
                text = np.repeat(np.arange(b - a), parts)
                number = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
                short = total - (parts - 1) * capacity
                start = np.where(number > 0, short[text] + (number - 1) * capacity, 0)
                length = np.where(number > 0, capacity, short[text])
                cuts = np.append(begin[text] + start, len(ids)) * 4
                blob = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(text), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a).take(pa.array(text)),
                        batch.column(1).slice(a, b - a).take(pa.array(text)),
                        pa.array(number, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        blob.cast(pa.binary()),
                    ],
                    ["row", "id", "piece", "start", "length", "ids"],
                )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, run, f"row bigint, id {rows.schema['id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids binary")


class Bins:
    """Open bins by free space: a bit for each space that some bin has, and the bins of each space."""

    def __init__(self, capacity: int, limit: int) -> None:
        self.capacity, self.limit = capacity, limit
        self.spaces, self.bins = 0, [[] for _ in range(capacity)]
        self.opened = self.open = 0

    def take(self, space: int) -> int:
        found = self.bins[space].pop()
        if not self.bins[space]:
            self.spaces ^= 1 << space
        self.open -= 1
        return found

    def put(self, length: int) -> tuple[int, int]:
        """The bin of a piece and its place there."""
        fitting = self.spaces >> length << length
        if fitting:
            space = (fitting & -fitting).bit_length() - 1
            found = self.take(space)
        else:
            if self.open == self.limit:
                self.take((self.spaces & -self.spaces).bit_length() - 1)
            space, found = self.capacity, self.opened
            self.opened += 1
        left = space - length
        if left:
            self.spaces |= 1 << left
            self.bins[left].append(found)
            self.open += 1
        return found, self.capacity - space


def best_fit(lengths: list[int], capacity: int, limit: int = OPEN_BINS) -> tuple[list[int], list[int]]:
    """Bin and place in it of each piece, in the order in which they come."""
    bins = Bins(capacity, limit)
    placed = [bins.put(n) for n in lengths]
    return [p[0] for p in placed], [p[1] for p in placed]


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", open_bins: int = OPEN_BINS
) -> DataFrame:
    """One row per piece: id, piece, start, length, ``ids`` and their ``ids_crc32``, ``sequence_id`` and ``offset``."""
    cut = pieces(docs, tokenizer, capacity, end_id, id_col, text_col)
    cut = stage(cut.withColumn("ids_crc32", F.crc32("ids")), "pieces")
    groups = -(-cut.count() // GROUP_PIECES)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("order", "ascending"), ("row", "ascending"), ("piece", "ascending")])
        found, offset = best_fit(table.column("length").to_pylist(), capacity, open_bins)
        first = table.column("part")[0].as_py() << 32
        return pa.table(
            {"row": table.column("row"), "piece": table.column("piece"), "sequence_id": pa.array([first + x for x in found], pa.int64()), "offset": pa.array(offset, pa.int64())}
        )

    order = F.xxhash64("row", "piece")
    lengths = cut.select("row", "piece", "length", order.alias("order"), F.pmod(order, F.lit(max(groups, 1))).alias("part"))
    placed = lengths.groupBy("part").applyInArrow(run, "row bigint, piece int, sequence_id bigint, offset bigint")
    return cut.join(placed, ["row", "piece"]).select(F.col("id").alias(id_col), "piece", "start", "length", "ids", "ids_crc32", "sequence_id", "offset")
