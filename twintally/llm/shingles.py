"""Sets of word shingles as sorted 64-bit numbers."""

from __future__ import annotations

import numpy as np

from twintally.llm.words import LOWER_VALUES, SPACED, hash_runs, mix, per_text, runs

WORDS = 5
PLACES = mix(np.arange(101, 133, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """For each text its distinct shingles of ``words`` lower-cased words, ascending.

    A text with fewer words has one shingle, the whole sequence; one without words has none.
    """
    texts = len(offsets) - 1
    first, end, doc = runs(data, offsets, SPACED)
    hashes = hash_runs(data, first, end, LOWER_VALUES)
    count = np.bincount(doc, minlength=texts)
    begin = per_text(doc, texts)
    padded = np.concatenate([hashes, np.zeros(words - 1, np.uint64)])
    whole = np.zeros(len(hashes), np.uint64)
    for j in range(words):
        whole += padded[j : j + len(hashes)] * PLACES[j]
    whole = mix(whole)
    out = []
    for k in range(texts):
        n = count[k]
        if n >= words:
            out.append(np.unique(whole[begin[k] : begin[k + 1] - words + 1]))
        elif n:
            short = hashes[begin[k] : begin[k + 1]] * PLACES[:n]
            out.append(mix(np.array([short.sum() + np.uint64(n)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
