"""Benchmark decontamination with an FM-index for each shard of the training text.

A shard is a run of whole documents of a few megabytes inside one task. Its words become an array of symbols, its
FM-index answers backward searches for all phrases of the benchmark at once through wavelet-tree ranks, and sampled
suffix positions locate the occurrences, whose spans are merged per document. Words that no phrase has share one symbol.

A phrase is a window of ``window`` consecutive words of an item, or the whole of an item with fewer words. Phrases go to
the tasks in blocks of at most ``BLOCK_BYTES`` of item text each; every block is searched in every document.

Defined results: null and empty texts have no words and no hits; a null item id counts as no item; items with equal
texts each count; a document is never cut; other columns don't matter; empty tables give empty or unmarked results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twintally.llm.suffix import FMIndex
from twintally.llm.words import ALNUM, LOWER_VALUES, cut, hash_runs, map_batches, per_text, runs, slices, text_buffers

WINDOW = 10
SHARD_BYTES = 6 << 20
BLOCK_BYTES = 2 << 20
ROWS_AT_ONCE = 1 << 20
FOUND = "__leak_spans"


@dataclass
class Phrases:
    """Distinct phrases, last word first, over the numbers of a sorted vocabulary; ``items`` of each from ``at``."""

    vocabulary: np.ndarray
    words: np.ndarray
    lengths: np.ndarray
    at: np.ndarray
    items: np.ndarray
    ids: list


def phrases(ids: list, texts: pa.Array, window: int = WINDOW) -> Phrases:
    data, offsets = text_buffers(texts)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    first, end, item = runs(data, offsets, ALNUM)
    vocabulary, word = np.unique(hash_runs(data, first, end, LOWER_VALUES), return_inverse=True)
    begin = per_text(item, len(ids))
    rows, owners = [], []
    for k in range(len(ids)):
        own = word[begin[k] : begin[k + 1]]
        for j in range(max(len(own) - window + 1, min(len(own), 1))):
            rows.append(own[j : j + window][::-1])
            owners.append(k)
    lengths = np.array([len(r) for r in rows], np.int64)
    table = np.full((len(rows), window), -1, np.int64)
    for row, part in zip(table, rows):
        row[: len(part)] = part
    table, inverse = np.unique(table, axis=0, return_inverse=True) if len(rows) else (table, lengths)
    owner = np.array(owners, np.int64)
    order = np.argsort(inverse, kind="stable")
    at = np.searchsorted(inverse[order], np.arange(len(table) + 1))
    return Phrases(vocabulary, table, (table >= 0).sum(axis=1), at, owner[order], ids)


def search(data: np.ndarray, offsets: np.ndarray, wanted: Phrases) -> tuple:
    """Words (first, end, text number), then text number, start and length of every merged span, then text and item."""
    texts = len(offsets) - 1
    first, end, doc = runs(data, offsets, ALNUM)
    none = np.zeros(0, np.int64)
    if not len(first) or not len(wanted.words):
        return first, end, doc, (none, none, none), (none, none)
    hashes = hash_runs(data, first, end, LOWER_VALUES)
    place = np.minimum(np.searchsorted(wanted.vocabulary, hashes), len(wanted.vocabulary) - 1)
    known = wanted.vocabulary[place] == hashes
    # 0 ends the array, 1 stands between texts, 2 for any unknown word.
    symbols = np.ones(len(first) + texts, np.int64)
    at = np.arange(len(first)) + doc
    symbols[at] = np.where(known, place + 3, 2)
    used, symbols = np.unique(symbols, return_inverse=True)
    number = np.full(len(wanted.vocabulary) + 3, -1, np.int64)
    number[used] = np.arange(1, len(used) + 1)
    index = FMIndex(symbols + 1, len(used) + 1)
    patterns = np.where(wanted.words >= 0, number[wanted.words + 3], 0)
    able = np.flatnonzero((patterns >= 0).all(axis=1))
    low, high = index.search(patterns[able], wanted.lengths[able])
    found = high > low
    able, low, high = able[found], low[found], high[found]
    change = np.zeros(len(symbols) + 1, np.int64)
    pairs = [np.zeros((0, 2), np.int64)]
    text_of = np.repeat(np.arange(texts), np.bincount(doc, minlength=texts) + 1)
    total = np.concatenate(([0], np.cumsum(high - low)))
    for lo in range(0, int(total[-1]), ROWS_AT_ONCE):
        number_in = np.arange(lo, min(lo + ROWS_AT_ONCE, int(total[-1])))
        which = np.searchsorted(total, number_in, "right") - 1
        where = index.locate(low[which] + number_in - total[which])
        phrase = able[which]
        np.add.at(change, where, 1)
        np.add.at(change, where + wanted.lengths[phrase], -1)
        text_phrase = np.unique(np.stack([text_of[where], phrase], axis=1), axis=0)
        count = wanted.at[text_phrase[:, 1] + 1] - wanted.at[text_phrase[:, 1]]
        inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        item = wanted.items[np.repeat(wanted.at[text_phrase[:, 1]], count) + inner]
        pairs.append(np.unique(np.stack([np.repeat(text_phrase[:, 0], count), item], axis=1), axis=0))
    hit = np.cumsum(change)[:-1] > 0
    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    text = text_of[start]
    pair = np.unique(np.concatenate(pairs), axis=0)
    # Between texts stands a symbol no phrase has, so a span lies in one text and word numbers are places less texts.
    return first, end, doc, (text, start - text, stop - start), (pair[:, 0], pair[:, 1])


def blocks(items: DataFrame, id_col: str, text_col: str, window: int) -> list[Phrases]:
    """The phrases of all items, in blocks of a bounded size."""
    rows = items.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where("id IS NOT NULL AND text IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    count = 2 * size // BLOCK_BYTES + 1
    out = []
    for k in range(count):
        part = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(count)) == k) if count > 1 else rows
        table = part.toArrow()
        text = table.column("text").combine_chunks()
        out.append(phrases(table.column("id").to_pylist(), text, window))
    return out


HITS = "n_words bigint, spans array<struct<start: bigint, length: bigint>>, items array<string>"


def find_leaks(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """One row per document: id, number of words, merged spans of words, ids of the items found."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    for wanted in blocks(items, item_id_col, item_text_col, window):
        rows = map_batches(rows, finder(wanted), f"id {kind}, text string, {HITS}")
    return rows.drop("text").withColumnRenamed("id", id_col)


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))


def finder(wanted: Phrases):
    """Adds the hits of one block of phrases; what an earlier block found is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(1), SHARD_BYTES):
                texts, part = b - a, batch.slice(a, b - a)
                _, _, doc, (text, start, length), (with_item, item) = search(data, offsets, wanted)
                own, at = start - np.searchsorted(doc, text), per_text(with_item, texts)
                names = [[str(wanted.ids[i]) for i in item[at[k] : at[k + 1]]] for k in range(texts)]
                if batch.num_columns > 2:
                    text, own, length = united(part.column(3), text, own, length)
                    names = [x + y for x, y in zip(part.column(4).to_pylist(), names)]
                spans = pa.StructArray.from_arrays([pa.array(own, pa.int64()), pa.array(length, pa.int64())], fields=list(SPANS.value_type))
                words = pa.array(np.bincount(doc, minlength=texts), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1).cast(pa.string()),
                        words,
                        pa.ListArray.from_arrays(pa.array(per_text(text, texts), pa.int32()), spans),
                        pa.array(names, pa.list_(pa.string())),
                    ],
                    ["id", "text", "n_words", "spans", "items"],
                )

    return run


def merged(text: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of spans of each text; touching spans become one."""
    order = np.lexsort((start, text))
    out: list[list[int]] = []
    for t, a, n in zip(text[order].tolist(), start[order].tolist(), length[order].tolist()):
        if out and out[-1][0] == t and a <= out[-1][1] + out[-1][2]:
            out[-1][2] = max(out[-1][2], a + n - out[-1][1])
        else:
            out.append([t, a, n])
    return tuple(np.array([x[k] for x in out], np.int64) for k in range(3))


def united(spans: pa.Array, text: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of an earlier block's spans, a list for each text, and more of them."""
    earlier = spans.to_pylist()
    text = np.concatenate([text, np.repeat(np.arange(len(earlier)), [len(x) for x in earlier])])
    start = np.concatenate([start, np.array([x["start"] for y in earlier for x in y], np.int64)])
    length = np.concatenate([length, np.array([x["length"] for y in earlier for x in y], np.int64)])
    return merged(text, start, length)


def remove_leaks(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """``docs`` with the merged spans of all phrases cut from the texts; texts without any stay as they are.

    Every block of phrases is searched in the whole text; the union of what all blocks find is cut once, by the last one.
    """
    at = docs.columns.index(text_col)
    wanted = blocks(items, item_id_col, item_text_col, window)

    def remover(block: Phrases, is_last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b, data, offsets in slices(batch.column(at), SHARD_BYTES):
                    part, texts = batch.slice(a, b - a), b - a
                    first, end, doc, (text, start, length), _ = search(data, offsets, block)
                    begin = per_text(doc, texts)
                    own = start - begin[text]
                    if batch.num_columns > width:
                        text, own, length = united(part.column(width), text, own, length)
                    part = part.select(range(width))
                    if not is_last:
                        spans = pa.StructArray.from_arrays([pa.array(own, pa.int64()), pa.array(length, pa.int64())], fields=list(SPANS.value_type))
                        column = pa.ListArray.from_arrays(pa.array(per_text(text, texts), pa.int32()), spans)
                        part = pa.RecordBatch.from_arrays([*part.columns, column], schema=part.schema.append(pa.field(FOUND, SPANS)))
                    elif len(text):
                        lo = begin[text] + own
                        cuts = np.split(np.stack([first[lo], end[lo + length - 1]], axis=1), per_text(text, texts)[1:-1])
                        left = part.column(at).to_pylist()
                        for k in np.unique(text):
                            left[k] = cut(data[offsets[k] : offsets[k + 1]], [tuple(x - offsets[k]) for x in cuts[k]]).decode()
                        part = part.set_column(at, part.schema.field(at), pa.array(left, part.schema.field(at).type))
                    yield part

        return run

    width, schema = len(docs.columns), docs.schema
    found = T.StructType([*schema.fields, T.StructField(FOUND, T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())])))])
    for k, block in enumerate(wanted):
        is_last = k == len(wanted) - 1
        docs = map_batches(docs, remover(block, is_last), schema if is_last else found)
    return docs
