"""Quality rules over repeated substrings.

A suffix array over the words of every text gives, through the common prefixes of its neighbours, the maximal
repeated word sequences of that text. Their spans are united; a text fails if they cover too large a fraction of its
words, or if the longest repeat is too long. A batch of texts shares one array: a symbol stands for a word of one
text, so no repeat goes across texts. Texts never leave their task and are never cut.

Defined results: a null text is an empty one; a text with fewer than ``min_words`` words fails; repeated rows are judged
alike; other columns, whatever their names, don't matter; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twintally.llm.suffix import common_prefixes, dense, suffix_array
from twintally.llm.words import LINES, SPACED, hash_runs, map_batches, mix, runs, slices

SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))


@dataclass(frozen=True)
class Limits:
    """Limits of the rules.

    A text fails with fewer than ``min_words`` words, or if words in windows of ``window`` words that occur again are
    more than ``max_window_percent`` of them. Repeats of at least ``repeat_words`` words may cover at most
    ``max_covered_percent`` of the words, and no repeat may be longer than ``max_repeat_words``. Symbols, and lines
    equal to earlier ones, are counted only.
    """

    min_words: int = 20
    window: int = 8
    max_window_percent: int = 30
    repeat_words: int = 6
    max_covered_percent: int = 35
    max_repeat_words: int = 200


COLUMNS = [
    ("n_words", pa.int64()),
    ("word_chars", pa.int64()),
    ("n_symbols", pa.int64()),
    ("n_dup_lines", pa.int64()),
    ("n_repeat_words", pa.int64()),
    ("n_covered_words", pa.int64()),
    ("longest_repeat", pa.int64()),
    ("base_failed", pa.bool_()),
    ("kept", pa.bool_()),
]
SCHEMA = ", ".join(f"{name} {'boolean' if kind == pa.bool_() else 'bigint'}" for name, kind in COLUMNS)


def covered(doc: np.ndarray, texts: int, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Words of each text in the union of spans of words; the words' text numbers are ``doc``."""
    change = np.bincount(start, minlength=len(doc) + 1) - np.bincount(start + length, minlength=len(doc) + 1)
    return np.bincount(doc[np.cumsum(change)[:-1] > 0], minlength=texts)


def repeats(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each word, the longest sequence beginning with it that occurs elsewhere in its text."""
    _, symbols = dense(hashes ^ mix(doc.astype(np.uint64) + np.uint64(1)))
    levels: list = []
    order = suffix_array(symbols, int(symbols.max(initial=0)) + 1, levels)
    shared = common_prefixes(symbols, order, levels)
    longest = np.zeros(len(hashes), np.int64)
    longest[order] = np.maximum(shared, np.append(shared[1:], 0))
    return longest


def judge(data: np.ndarray, offsets: np.ndarray, limits: Limits) -> list[np.ndarray]:
    """The columns of ``COLUMNS`` for a slice of texts."""
    texts = len(offsets) - 1
    first, end, doc = runs(data, offsets, SPACED)
    words = np.bincount(doc, minlength=texts)
    starts_char = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    chars = np.zeros(texts, np.int64)
    np.add.at(chars, doc, starts_char[end] - starts_char[first])
    marks = np.concatenate(([0], np.cumsum(SYMBOLS[data])))[offsets]
    line_first, line_end, line_doc = runs(data, offsets, LINES)
    worded = np.unique(np.searchsorted(line_first, first, "right") - 1)
    line_first, line_end, line_doc = line_first[worded], line_end[worded], line_doc[worded]
    _, once = np.unique(hash_runs(data, line_first, line_end) ^ mix(line_doc.astype(np.uint64) + np.uint64(1)), return_index=True)
    duplicates = np.bincount(line_doc, minlength=texts) - np.bincount(line_doc[once], minlength=texts)
    longest = repeats(hash_runs(data, first, end), doc)
    found = []
    for least in (limits.window, limits.repeat_words):
        begin = np.flatnonzero(longest >= least)
        found.append(covered(doc, texts, begin, longest[begin]))
    top = np.zeros(texts, np.int64)
    np.maximum.at(top, doc, longest)
    top[top < limits.repeat_words] = 0
    failed = (words < limits.min_words) | (100 * found[0] > limits.max_window_percent * words)
    kept = ~failed & (100 * found[1] <= limits.max_covered_percent * words) & (top <= limits.max_repeat_words)
    return [words, chars, np.diff(marks), duplicates, found[0], found[1], top, failed, kept]


def measure(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, the measures and the two verdicts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(1)):
                values = [pa.array(v, kind) for v, (_, kind) in zip(judge(data, offsets, limits), COLUMNS)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *values], names)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    names = ["id", *(name for name, _ in COLUMNS)]
    out = map_batches(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, {SCHEMA}")
    return out.withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, limits: Limits = Limits(), text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(at)):
                yield batch.slice(a, b - a).filter(pa.array(judge(data, offsets, limits)[-1], pa.bool_()))

    return map_batches(docs, run, docs.schema)
