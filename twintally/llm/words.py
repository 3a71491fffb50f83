"""Words of whole texts as byte arrays.

Texts come as the UTF-8 buffers of Arrow batches. A word is a run of bytes of a class, so words, lines and their
hashes are found with array operations over many texts at once; no text is cut, and a slice holds one text at least.
Word hashes are 64 bits of a polynomial over random byte values.
"""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SLICE_BYTES = 1 << 20
HASH_BYTES = 1 << 19
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

BASE = np.uint64(0x9E3779B97F4A7C15)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values; one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * BASE)
LOWER_VALUES = BYTE_VALUES[LOWER]


def byte_class(keep: Callable[[int], bool]) -> np.ndarray:
    return np.array([keep(b) for b in range(256)])


#: Words between ASCII white space, lines, and words of letters, digits and all non-ASCII characters.
SPACED = byte_class(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
LINES = byte_class(lambda b: b != 0x0A)
ALNUM = byte_class(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)


def map_batches(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` whose Python workers find this package wherever the driver was started."""
    known = df.sparkSession.sparkContext.environment
    paths = known.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        known["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Returns what a finished task has freed to the system; a reused worker would keep it otherwise."""
    pa.default_memory_pool().release_unused()
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, row after the last, bytes and own offsets of runs of whole texts of about ``limit`` bytes."""
    data, offsets = text_buffers(column)
    row, rows = 0, len(column)
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        part = offsets[row : end + 1]
        yield row, end, data[part[0] : part[-1]], part - part[0]
        row = end


def runs(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of the maximal runs of a byte class; none goes across texts."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    mask = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = mask.copy()
    start[1:] &= ~mask[:-1] | edge[1:-1]
    last = mask.copy()
    last[:-1] &= ~mask[1:] | edge[1:-1]
    first = np.flatnonzero(start)
    return first, np.flatnonzero(last) + 1, np.searchsorted(offsets, first, "right") - 1


def hash_runs(data: np.ndarray, first: np.ndarray, end: np.ndarray, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """A 64-bit hash of each run of bytes."""
    out = np.empty(len(first), np.uint64)
    a = 0
    while a < len(first):
        b = max(a + 1, int(np.searchsorted(end, first[a] + HASH_BYTES, "right")))
        lo, hi = first[a:b], end[a:b]
        length = hi - lo
        at = np.concatenate(([0], np.cumsum(length)))
        place = np.arange(at[-1]) - np.repeat(at[:-1], length)
        powers = np.full(int(length.max()), BASE, np.uint64)
        powers = np.multiply.accumulate(powers)
        terms = values[data[np.repeat(lo, length) + place]] * powers[place]
        out[a:b] = np.add.reduceat(terms, at[:-1]) + length.astype(np.uint64)
        a = b
    return mix(out)


def per_text(numbers: np.ndarray, texts: int) -> np.ndarray:
    """Where the items of each text begin; ``numbers`` are their text numbers, ascending."""
    return np.searchsorted(numbers, np.arange(texts + 1))


def cut(data: np.ndarray, spans: list[tuple[int, int]]) -> bytes:
    """The bytes without the spans."""
    kept, at = [], 0
    for lo, hi in spans:
        kept.append(data[at:lo].tobytes())
        at = hi
    return b"".join([*kept, data[at:].tobytes()])
