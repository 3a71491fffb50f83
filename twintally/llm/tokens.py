"""Token ids of whole texts by a byte-level BPE tokenizer file.

The tokenizer splits a text by a fixed pattern and encodes every part on its own. The parts are found here with array
operations over the code points of many texts, and the library encodes each distinct part once while a worker remembers
it; what it remembers is bounded, and whole texts are never among it. Texts with a special token's string, with code
points this Python's Unicode tables don't know, or with invalid bytes go to the library whole. The ids are the library's
own in each case.
"""

from __future__ import annotations

import os
import sys
import unicodedata
from collections.abc import Callable
from functools import cache

import numpy as np

from twintally.llm.words import hash_runs

SPACE, LETTER, NUMBER, OTHER, UNKNOWN = range(5)
#: A worker forgets its parts when it keeps more of them, or more ids, than these: 24 and 16 MB.
KNOWN_PARTS = 1 << 20
KNOWN_IDS = 1 << 22
RECENT_PARTS = 100_000


@cache
def code_point_classes() -> np.ndarray:
    """White space, letters, numbers and the rest, as the tokenizer's pattern knows them."""
    spaces = {*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        category = unicodedata.category(chr(c))
        table[c] = SPACE if c in spaces else UNKNOWN if category in ("Cn", "Cs") else kinds.get(category[0], OTHER)
    return table


def part_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where parts begin. ``first`` marks the first code point of each text.

    The pattern: 's|'t|'re|'ve|'m|'ll|'d| ?letters| ?numbers| ?others|spaces before another space or the end|spaces.
    """
    n = len(points)
    kind = code_point_classes()[points]
    new_run = first.copy()
    new_run[1:] |= kind[1:] != kind[:-1]
    last_of_text = np.append(first[1:], True)
    last_of_run = np.append(new_run[1:], True)
    space = kind == SPACE
    after_blank = np.zeros(n, bool)
    after_blank[1:] = points[:-1] == 0x20
    after_blank &= ~first
    start = np.where(space, new_run | (last_of_run & ~last_of_text), new_run & ~after_blank)
    quote = np.flatnonzero((points == 0x27) & new_run & last_of_run & ~last_of_text & start)
    for tail in ("s", "t", "m", "d", "re", "ve", "ll"):
        at = quote
        for j, c in enumerate(tail, 1):
            at = at[at + j < n]
            at = at[(points[at + j] == ord(c)) & ~first[at + j]]
        start[at + 1] = False
        after = at + 1 + len(tail)
        after = after[after < n]
        start[after[(kind[after] == LETTER) & ~first[after]]] = True
    return np.flatnonzero(start)


class Parts:
    """Token ids of distinct parts of texts: ``encode`` gives those of new parts, which are then remembered."""

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]]) -> None:
        self.encode = encode
        self.forget()

    def forget(self) -> None:
        self.hashes, self.at, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.recent = (self.hashes, self.at, self.count)
        self.ids, self.used = np.empty(1 << 20, np.uint32), 0

    def store(self, encoded: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Keeps lists of ids; where each begins and its length."""
        count = np.array([len(x) for x in encoded], np.int64)
        flat = np.fromiter((i for x in encoded for i in x), np.uint32, int(count.sum()))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[self.used : self.used + len(flat)] = flat
        at = self.used + np.cumsum(count) - count
        self.used += len(flat)
        return at, count

    def look_up(self, data: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each part, where its ids are kept and how many they are; valid until the next call."""
        if len(self.hashes) > KNOWN_PARTS or self.used > KNOWN_IDS:
            self.forget()
        distinct, sample, back = np.unique(hash_runs(data, first, end), return_index=True, return_inverse=True)
        at, count = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        missing = np.ones(len(distinct), bool)
        for hashes, where, length in ((self.hashes, self.at, self.count), self.recent):
            if len(hashes):
                place = np.minimum(np.searchsorted(hashes, distinct), len(hashes) - 1)
                known = hashes[place] == distinct
                at[known], count[known] = where[place[known]], length[place[known]]
                missing &= ~known
        new = np.flatnonzero(missing)
        if len(new):
            own = sample[new]
            at[new], count[new] = self.store(self.encode([data[a:b].tobytes() for a, b in zip(first[own], end[own])]))
            self.recent = joined(self.recent, (distinct[new], at[new], count[new]))
            if len(self.recent[0]) > RECENT_PARTS:
                self.hashes, self.at, self.count = joined((self.hashes, self.at, self.count), self.recent)
                self.recent = tuple(x[:0] for x in self.recent)
        return at[back], count[back]


def in_order(text: np.ndarray, at: np.ndarray, count: np.ndarray, ids: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """The lists of ids one after the other by their text's number, and where each text's ids begin."""
    order = np.argsort(text, kind="stable")
    text, at, count = text[order], at[order], count[order]
    end = np.cumsum(count)
    out = ids[np.repeat(at - end + count, count) + np.arange(end[-1] if len(end) else 0)]
    return out, np.append(0, end)[np.searchsorted(text, np.arange(texts + 1))]


class Encoder:
    """Encodes slices of texts; one for each worker, tokenizer file and way to end a text.

    Strings of special tokens are those tokens, or with ``plain`` ordinary text. Without ``end_id`` texts have no end.
    """

    def __init__(self, path: str, end_id: int | None, plain: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.special = [] if plain else [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.end = [] if end_id is None else [end_id]
        self.parts = Parts(lambda parts: self.whole([x.decode() for x in parts]))

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one text after the other with its end, and where each text's ids begin."""
        texts = len(offsets) - 1
        raw = data.tobytes()
        odd = set()
        for mark in self.special:
            at = raw.find(mark)
            while at >= 0:
                odd.add(int(np.searchsorted(offsets, at, "right")) - 1)
                at = raw.find(mark, at + 1)
        try:
            points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
            starts = np.flatnonzero((data & 0xC0) != 0x80)
            odd |= set((np.searchsorted(offsets, starts[code_point_classes()[points] == UNKNOWN], "right") - 1).tolist())
        except UnicodeDecodeError:
            points, starts, odd = np.zeros(0, np.uint32), np.zeros(0, np.int64), set(range(texts))
        if len(points) and len(odd) < texts:
            mark = np.zeros(len(data) + 1, bool)
            mark[offsets] = True
            first = starts[part_starts(points, mark[starts])]
            text = np.searchsorted(offsets, first, "right") - 1
            at, count = self.parts.look_up(data, first, np.append(first[1:], len(data)))
            if odd:
                plain = ~np.isin(text, list(odd))
                text, at, count = text[plain], at[plain], count[plain]
        else:
            text, at, count = (np.zeros(0, np.int64),) * 3
        ids, used = self.parts.ids, self.parts.used
        # Ends and whole texts are put behind the known ids for this slice only.
        more = [self.end] * (texts if self.end else 0)
        owners = list(range(texts)) if self.end else []
        if odd:
            own = sorted(odd)
            more = self.whole([raw[offsets[k] : offsets[k + 1]].decode(errors="replace") for k in own]) + more
            owners = own + owners
        if more:
            length = np.array([len(x) for x in more], np.int64)
            ids = np.concatenate([ids[:used], np.fromiter((i for x in more for i in x), np.uint32, int(length.sum()))])
            text, at, count = np.concatenate([text, owners]), np.concatenate([at, used + np.cumsum(length) - length]), np.concatenate([count, length])
        return in_order(text, at, count, ids, texts)


def joined(known: tuple, new: tuple) -> tuple:
    both = [np.concatenate(x) for x in zip(known, new)]
    order = np.argsort(both[0], kind="stable")
    return tuple(x[order] for x in both)


ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, end_id: int | None, plain: bool = False) -> Encoder:
    """This worker's encoder. It keeps ``KNOWN_PARTS`` parts and ``KNOWN_IDS`` ids, and a slice's new ones, at most."""
    if (path, end_id, plain) not in ENCODERS:
        ENCODERS[path, end_id, plain] = Encoder(path, end_id, plain)
    return ENCODERS[path, end_id, plain]
