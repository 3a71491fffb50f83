"""Alignment of two tokenizers over whole texts by the byte offsets where tokens of both end.

Tokenizer A is a byte-level BPE file, B a sentencepiece model that puts a space before the text. Both see a space and the
text; special tokens' strings are ordinary text. Offsets where an A and a B token end cut the tokens into groups, and the last
A and B token of a group are linked.

1. One array gives for each A id the B id with the same bytes. A group of one A token and that B token is *regular*: it
   is kept as its A id alone.
2. Tasks count regular groups in vectors as long as A's vocabulary; only links of the other groups are counted as pairs
   in a shuffle.
3. Counts of regular links and the highest count of each B id are as long as the vocabularies. They go to the tasks,
   with those irregular pairs that have at least a ``HEAVY``-th of the irregular links each (so there are ``HEAVY`` at
   most). Documents are scored with them.
4. The remaining irregular links join their counts in a shuffle. No such pair has more than a ``HEAVY``-th of them.

The parts of B are the stretches from a space behind another character to the next such place. No piece of the model goes
across one, which is checked when the model is loaded; if a model has such a piece, texts are encoded whole.

Defined results: null and empty texts, and those whose tokens' bytes are not the space and the text (with the piece's own
mark for a space, or invalid bytes), have no tokens: zeros and ''. Repeated rows count each. A null id is an id as any
other; other columns don't matter; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twintally.llm.tokens import Parts, encoder, in_order
from twintally.llm.words import map_batches, slices
from twintally.sources.staging import scratch, stage

HEAVY = 1 << 16
#: Texts are encoded and links are counted by runs of whole rows of about so many bytes or links, however large an Arrow batch is.
ENCODED_BYTES = 1 << 18
COUNTED_LINKS = 1 << 18
SPACE_MARK = "\u2581"


class Vocabulary:
    """The bytes of each token id."""

    def __init__(self, entries: list[bytes]) -> None:
        self.entries = entries
        self.length = np.array([len(x) for x in entries], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(entries), np.uint8)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        length = self.length[ids]
        end = np.cumsum(length)
        return self.bytes[np.repeat(self.begin[ids] - end + length, length) + np.arange(end[-1] if len(end) else 0)]


def byte_level_bytes(token: str, table: dict[str, int]) -> bytes:
    return bytes(table[c] for c in token) if all(c in table for c in token) else b""


@cache
def byte_level_table() -> dict[str, int]:
    """The visible character of each byte: printable ones stand for themselves, the others follow from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


@cache
def vocabulary_a(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as file:
        ids = json.load(file)["model"]["vocab"]
    entries = [b""] * (max(ids.values(), default=-1) + 1)
    for token, number in ids.items():
        entries[number] = byte_level_bytes(token, byte_level_table())
    return Vocabulary(entries)


class PieceEncoder:
    """Encodes slices of texts, each with a space before it, by a sentencepiece model."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        self.is_byte = np.array([self.model.is_byte(k) for k in range(len(pieces))])
        odd = [self.model.is_control(k) or self.model.is_unknown(k) for k in range(len(pieces))]
        self.vocabulary = Vocabulary([b"" if odd[k] else bytes([int(x[3:5], 16)]) if self.is_byte[k] else x.replace(SPACE_MARK, " ").encode() for k, x in enumerate(pieces)])
        # The model gives nothing for an empty text, so a single space between parts is looked up by itself.
        self.space = self.model.piece_to_id(SPACE_MARK)
        self.divisible = not any(SPACE_MARK in x.lstrip(SPACE_MARK) for x in pieces) and not odd[self.space]
        self.parts = Parts(self.whole)

    def whole(self, parts: list[bytes]) -> list[list[int]]:
        found = self.model.encode([x[1:].decode(errors="replace") for x in parts], num_threads=1)
        return [ids or [self.space] for ids in found]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begins = np.zeros(len(data), bool)
        if self.divisible:
            blank = data == 0x20
            begins[1:] = blank[1:] & ~blank[:-1]
        begins[offsets[:-1]] = True
        first = np.flatnonzero(begins)
        text = np.searchsorted(offsets, first, "right") - 1
        at, count = self.parts.look_up(data, first, np.append(first[1:], len(data)))
        return in_order(text, at, count, self.parts.ids, len(offsets) - 1)


@cache
def piece_encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


@cache
def same_bytes(path_a: str, path_b: str) -> np.ndarray:
    """For each A id the B id with the same bytes, else -1; a piece of its own goes before a byte's."""
    b = piece_encoder(path_b)
    found: dict[bytes, int] = {}
    for k in np.argsort(~b.is_byte, kind="stable").tolist():
        found[b.vocabulary.entries[k]] = k
    found.pop(b"", None)
    return np.array([found.get(x, -1) for x in vocabulary_a(path_a).entries], np.int64)


@cache
def decimals(limit: int) -> tuple[np.ndarray, np.ndarray]:
    """For each id below the limit its digits, right-aligned, with a place left after them, and which places it fills."""
    numbers = np.arange(limit)
    places = 10 ** np.arange(len(str(limit)) - 1, -1, -1)
    digits = np.full((limit, len(places) + 1), 0x30, np.uint8)
    digits[:, :-1] += (numbers[:, None] // places % 10).astype(np.uint8)
    filled = np.ones(digits.shape, bool)
    filled[:, :-2] = numbers[:, None] >= places[:-1]
    return digits, filled


def correct(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, begin: np.ndarray, words: Vocabulary) -> np.ndarray:
    """For each text, whether its tokens' bytes are its own."""
    ends = np.append(0, np.cumsum(words.length[ids]))[begin]
    good = np.diff(ends) == np.diff(offsets)
    spelled = words.spell(ids)
    if good.all():
        wrong = np.flatnonzero(spelled != data)
        good[np.searchsorted(offsets, wrong, "right") - 1] = False
    else:
        for k in np.flatnonzero(good).tolist():
            good[k] = np.array_equal(spelled[ends[k] : ends[k + 1]], data[offsets[k] : offsets[k + 1]])
    return good


def aligned(data: np.ndarray, offsets: np.ndarray, path_a: str, path_b: str) -> Iterator[tuple]:
    """For each text with a space before it: n_a, n_b, groups, A ids of regular groups, A and B ids of the other links."""
    a, b, words_a = encoder(path_a, None, plain=True), piece_encoder(path_b), vocabulary_a(path_a)
    ids_a, begin_a = a.encode(data, offsets)
    ids_b, begin_b = b.encode(data, offsets)
    good = (np.diff(offsets) > 1) & correct(data, offsets, ids_a, begin_a, words_a) & correct(data, offsets, ids_b, begin_b, b.vocabulary)
    n_a, n_b = np.diff(begin_a) * good, np.diff(begin_b) * good
    ids_a, ids_b = ids_a[np.repeat(good, np.diff(begin_a))], ids_b[np.repeat(good, np.diff(begin_b))]
    ends_a, ends_b = np.cumsum(words_a.length[ids_a]), np.cumsum(b.vocabulary.length[ids_b])
    place = np.minimum(np.searchsorted(ends_b, ends_a), max(len(ends_b) - 1, 0))
    last_a = np.flatnonzero(ends_b[place] == ends_a) if len(ends_b) else np.zeros(0, np.int64)
    last_b = place[last_a]
    link_a, link_b = ids_a[last_a].astype(np.int64), ids_b[last_b].astype(np.int64)
    single = (np.diff(last_a, prepend=-1) == 1) & (np.diff(last_b, prepend=-1) == 1)
    regular = single & (same_bytes(path_a, path_b)[link_a] == link_b)

    # The tokens in the order of the groups' text, each with what follows it.
    digits, filled = decimals(max(len(words_a.entries), len(b.vocabulary.entries)))
    after_a, after_b = np.full(len(ids_a), ord(","), np.uint8), np.full(len(ids_b), ord(","), np.uint8)
    after_a[last_a], after_b[last_b] = ord("|"), ord(";")
    group_a = np.searchsorted(last_a, np.arange(len(ids_a)))
    group_b = np.searchsorted(last_b, np.arange(len(ids_b)))
    from_a = np.append(0, last_b + 1)[group_a] + np.arange(len(ids_a))
    from_b = last_a[group_b] + 1 + np.arange(len(ids_b))
    token, after = np.empty(len(ids_a) + len(ids_b), np.int64), np.empty(len(ids_a) + len(ids_b), np.uint8)
    token[from_a], token[from_b] = ids_a, ids_b
    after[from_a], after[from_b] = after_a, after_b
    places = digits[token]
    places[:, -1] = after
    shown = filled[token]
    spelled = places[shown]
    width = np.append(0, np.cumsum(shown.sum(axis=1)))

    tokens = np.append(0, np.cumsum(n_a + n_b))
    links = np.searchsorted(last_a, np.append(0, np.cumsum(n_a)))
    for k in range(len(good)):
        lo, hi = links[k], links[k + 1]
        own = regular[lo:hi]
        groups = spelled[width[tokens[k]] : max(width[tokens[k + 1]] - 1, 0)] if n_a[k] else spelled[:0]
        yield int(n_a[k]), int(n_b[k]), int(hi - lo), groups, link_a[lo:hi][own], link_a[lo:hi][~own], link_b[lo:hi][~own]


def with_space(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text with a space before it."""
    return np.insert(data, offsets[:-1], 0x20), offsets + np.arange(len(offsets))


def encode_both(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str) -> DataFrame:
    """(row, id, n_a, n_b, n_groups, groups_sha256, regular, odd_a, odd_b) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(2), ENCODED_BYTES):
                rows = [(x[0], x[1], x[2], hashlib.sha256(x[3].tobytes()).hexdigest() if x[0] else "", *x[4:]) for x in aligned(*with_space(data, offsets), path_a, path_b)]
                columns = list(zip(*rows))
                numbers = [pa.array(x, pa.int64()) for x in columns[:3]]
                lists = [pa.array(x, pa.list_(pa.int32())) for x in columns[4:]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *numbers, pa.array(columns[3], pa.string()), *lists],
                    ["row", "id", "n_a", "n_b", "n_groups", "groups_sha256", "regular", "odd_a", "odd_b"],
                )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return map_batches(rows, run, f"row bigint, id {kind}, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, regular array<int>, odd_a array<int>, odd_b array<int>")


def flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def link_slices(batches: Iterator[pa.RecordBatch], first: int) -> Iterator[pa.RecordBatch]:
    """Runs of whole rows with about ``COUNTED_LINKS`` links in the columns ``first`` (regular) and ``first + 1`` (others)."""
    for batch in batches:
        links = sum(np.append(0, np.cumsum(batch.column(k).value_lengths().to_numpy())) for k in (first, first + 1))
        row = 0
        while row < len(batch):
            end = max(row + 1, int(np.searchsorted(links, links[row] + COUNTED_LINKS, "right")) - 1)
            yield batch.slice(row, end - row)
            row = end


def count_links(encoded: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(a, b, regular, n): how many links hold each pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same = same_bytes(path_a, path_b)
        total = np.zeros(len(same), np.int64)

        def counted(a: np.ndarray, b: np.ndarray, regular: bool, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array([regular] * len(a), pa.bool_()), pa.array(n, pa.int64())], ["a", "b", "regular", "n"])

        for batch in link_slices(batches, 0):
            total += np.bincount(flat(batch.column(0)), minlength=len(total))
            pairs, n = np.unique(flat(batch.column(1)) << 32 | flat(batch.column(2)), return_counts=True)
            yield counted(pairs >> 32, pairs & 0xFFFFFFFF, False, n)
        own = np.flatnonzero(total)
        yield counted(own, same[own], True, total[own])

    parts = map_batches(encoded.select("regular", "odd_a", "odd_b"), run, "a int, b int, regular boolean, n bigint")
    return parts.groupBy("a", "b", "regular").agg(F.sum("n").alias("n"))


def score(encoded: DataFrame, regular: np.ndarray, best: np.ndarray, heavy: tuple[np.ndarray, np.ndarray], path_a: str, path_b: str) -> DataFrame:
    """Documents with ``n_best`` and ``count_sum`` over regular and heavy links, and their other links ``light`` (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same = same_bytes(path_a, path_b)
        is_best = (same >= 0) & (regular == best[same]) & (regular > 0)
        for batch in link_slices(batches, 6):
            rows = len(batch)
            owner = np.repeat(np.arange(rows), batch.column(6).value_lengths().to_numpy())
            a = flat(batch.column(6))
            n_best = np.bincount(owner[is_best[a]], minlength=rows)
            total = np.zeros(rows, np.int64)
            np.add.at(total, owner, regular[a])
            owner = np.repeat(np.arange(rows), batch.column(7).value_lengths().to_numpy())
            pair = flat(batch.column(7)) << 32 | flat(batch.column(8))
            known, n = heavy
            at = np.minimum(np.searchsorted(known, pair), max(len(known) - 1, 0))
            found = known[at] == pair if len(known) else np.zeros(len(pair), bool)
            np.add.at(total, owner[found], n[at[found]])
            top = np.zeros(len(pair), bool)
            top[found] = n[at[found]] == best[pair[found] & 0xFFFFFFFF]
            n_best += np.bincount(owner[top], minlength=rows)
            left = pair[~found]
            ends = np.append(0, np.cumsum(np.bincount(owner[~found], minlength=rows)))
            light = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(left, pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(n_best, pa.int64()), pa.array(total, pa.int64()), light], [*batch.schema.names[:6], "n_best", "count_sum", "light"])

    kind = encoded.schema["id"].dataType.simpleString()
    return map_batches(encoded, run, f"row bigint, id {kind}, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, n_best bigint, count_sum bigint, light array<bigint>")


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY) -> DataFrame:
    """One row per document: id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``."""
    pair = (F.shiftleft(F.col("a").cast("bigint"), 32) + F.col("b")).alias("pair")
    with scratch(docs.sparkSession):
        encoded = stage(encode_both(docs, path_a, path_b, id_col, text_col), "aligned")
        counts = stage(count_links(encoded, path_a, path_b), "links")
        regular, best = np.zeros(len(vocabulary_a(path_a).entries), np.int64), np.zeros(len(piece_encoder(path_b).vocabulary.entries), np.int64)
        for a, n in counts.where("regular").select("a", "n").collect():
            regular[a] = n
        for b, n in counts.groupBy("b").agg(F.max("n")).collect():
            best[b] = n
        odd = counts.where("NOT regular")
        total = odd.agg(F.sum("n")).first()[0] or 0
        known = sorted(map(tuple, odd.where(F.col("n") * heavy >= total).select(pair, "n").collect()))
        known = tuple(np.array(x, np.int64) for x in zip(*known)) if known else (np.zeros(0, np.int64),) * 2
        scored = stage(score(encoded, regular, best, known, path_a, path_b), "scored", keep=True)
        top = counts.groupBy("b").agg(F.max("n").alias("top"))
        light = odd.where(F.col("n") * heavy < total).join(top, "b").select(pair, "n", (F.col("n") == F.col("top")).cast("bigint").alias("is_best"))
        links = scored.select("row", F.explode("light").alias("pair")).groupBy("row", "pair").agg(F.count("*").alias("times")).join(light, "pair")
        more = links.groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("more_sum"), F.sum(F.col("times") * F.col("is_best")).alias("more_best"))
        more = stage(more, "light-links", keep=True)
    none = F.lit(0).cast("bigint")
    return scored.join(more, "row", "left").select(
        F.col("id").alias(id_col),
        "n_a",
        "n_b",
        "n_groups",
        F.col("n_groups").alias("n_links"),
        (F.col("n_best") + F.coalesce("more_best", none)).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", none)).alias("count_sum"),
        "groups_sha256",
    )
