"""Languages of whole texts: scripts narrow the candidates, and Viterbi over the words labels spans of one language.

A word is a run of letters and marks of one script. Its candidates are the learned languages that use its script; its score
for each is the sum of the smoothed logarithms of its character trigrams' shares there. Over the words of a text, the
best path of languages is found in which each change costs ``SWITCH``. The language of most letters is the text's;
the share of the letters with that label is its score.

Trigrams are counted over all texts to learn from: tasks count into vectors of ``BUCKETS`` hashed trigrams for each language,
Spark adds them up, and a model of languages x ``BUCKETS`` numbers returns, whatever the number of texts.

Paths of all texts of a slice are found together. Texts are cut into blocks of ``BLOCK`` words: the scores of entering
and leaving a block in each language are found for all blocks at once, then chained over each text's blocks, which gives the exact
path whatever a text's length.

Defined results: null texts and those without a letter are ``und`` with score 0, and so are all where nothing was learned;
a text of scripts that nobody learned gets the language with the best trigrams; equal letters go to the first name in
order; texts with a null language are not learned from; repeated rows count each; other columns don't matter; an
empty table gives an empty table.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twintally.llm.words import map_batches, mix, per_text, slices

UNKNOWN = "und"
BUCKETS = 1 << 16
SMOOTHING = 0.1
SWITCH = 8.0
BLOCK = 64
#: A language uses a script if at least this share of its letters is of it.
SCRIPT_SHARE = 0.001
#: The score of a word in a language that doesn't use its script.
EXCLUDED = -1e4
#: Numbers of a slice's words x languages that are held at once.
CELLS = 1 << 21

# First and last code points of the scripts.
SCRIPTS = [
    ("Latin", [(0x41, 0x24F), (0x250, 0x2AF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFB00, 0xFB06), (0xFF21, 0xFF5A)]),
    ("Greek", [(0x370, 0x3FF), (0x1F00, 0x1FFF)]),
    ("Cyrillic", [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)]),
    ("Armenian", [(0x530, 0x58F), (0xFB13, 0xFB17)]),
    ("Hebrew", [(0x590, 0x5FF), (0xFB1D, 0xFB4F)]),
    ("Arabic", [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFE)]),
    ("Devanagari", [(0x900, 0x97F), (0xA8E0, 0xA8FF)]),
    ("Bengali", [(0x980, 0x9FF)]),
    ("Gurmukhi", [(0xA00, 0xA7F)]),
    ("Gujarati", [(0xA80, 0xAFF)]),
    ("Tamil", [(0xB80, 0xBFF)]),
    ("Telugu", [(0xC00, 0xC7F)]),
    ("Kannada", [(0xC80, 0xCFF)]),
    ("Malayalam", [(0xD00, 0xD7F)]),
    ("Sinhala", [(0xD80, 0xDFF)]),
    ("Thai", [(0xE00, 0xE7F)]),
    ("Lao", [(0xE80, 0xEFF)]),
    ("Tibetan", [(0xF00, 0xFFF)]),
    ("Myanmar", [(0x1000, 0x109F)]),
    ("Georgian", [(0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)]),
    ("Ethiopic", [(0x1200, 0x139F), (0x2D80, 0x2DDF)]),
    ("Khmer", [(0x1780, 0x17FF)]),
    ("Mongolian", [(0x1800, 0x18AF)]),
    ("Hangul", [(0x1100, 0x11FF), (0x3130, 0x318F), (0xA960, 0xA97F), (0xAC00, 0xD7FF)]),
    ("Kana", [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)]),
    ("Han", [(0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)]),
]
OTHER_SCRIPT = len(SCRIPTS)


@cache
def code_points() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each code point: whether it is a letter, a letter or mark, its script, and its lower-case form."""
    size = sys.maxunicode + 1
    letter, inside = np.zeros(size, bool), np.zeros(size, bool)
    script, lower = np.full(size, OTHER_SCRIPT, np.uint8), np.arange(size, dtype=np.uint32)
    for c in range(size):
        kind = unicodedata.category(chr(c))
        letter[c] = kind[0] == "L"
        inside[c] = kind[0] in "LM"
        if kind in ("Lu", "Lt") and len(chr(c).lower()) == 1:
            lower[c] = ord(chr(c).lower())
    for k, (_, ranges) in enumerate(SCRIPTS):
        for a, b in ranges:
            script[a : b + 1] = k
    return letter, inside, script, lower


@dataclass
class Words:
    """Words of a slice of texts: first and last + 1 of their code points, text, script, and the trigram at each of their points."""

    first: np.ndarray
    end: np.ndarray
    text: np.ndarray
    script: np.ndarray
    trigrams: np.ndarray
    #: Where each word's trigrams begin, and where each text's code points begin.
    begin: np.ndarray
    texts: np.ndarray


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    letter, inside, scripts, lower = code_points()
    points = np.frombuffer(data.tobytes().decode(errors="replace").encode("utf-32-le"), np.uint32)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    if len(lead) != len(points):  # invalid bytes: text by text
        own = [data[a:b].tobytes().decode(errors="replace").encode("utf-32-le") for a, b in zip(offsets[:-1], offsets[1:])]
        texts = np.append(0, np.cumsum([len(x) // 4 for x in own]))
        points = np.frombuffer(b"".join(own), np.uint32)
    else:
        texts = np.searchsorted(lead, offsets)
    n = len(points)
    mask, script = inside[points], scripts[points]
    # A mark belongs to the letter before it, whatever its own script.
    at = np.maximum.accumulate(np.where(letter[points], np.arange(n), 0)) if n else np.zeros(0, np.int64)
    script = script[at]
    new = np.ones(n + 1, bool)
    if n:
        new[1:n] = ~mask[:-1] | (script[1:] != script[:-1])
        new[texts] = True
    first = np.flatnonzero(mask & new[:-1])
    last = mask & np.append(~mask[1:], True) if n else mask
    if n:
        last |= mask & new[1:]
    end = np.flatnonzero(last) + 1
    some = np.append(0, np.cumsum(letter[points]))
    real = some[end] > some[first]
    first, end = first[real], end[real]
    length = end - first
    begin = np.cumsum(length) - length
    at = np.repeat(first - begin, length) + np.arange(length.sum())
    small = lower[points[at]].astype(np.uint64)
    before, after = np.roll(small, 1), np.roll(small, -1)
    before[begin] = 0
    after[begin + length - 1] = 0
    trigrams = (mix(before | small << np.uint64(21) | after << np.uint64(42)) % np.uint64(BUCKETS)).astype(np.int64)
    return Words(first, end, np.searchsorted(texts, first, "right") - 1, script[first] if n else np.zeros(0, np.uint8), trigrams, begin, texts)


@dataclass
class Model:
    """Names of the languages in order, log-shares of trigrams and which languages are candidates of a script."""

    names: list[str]
    shares: np.ndarray
    allowed: np.ndarray


def counts(docs: DataFrame) -> DataFrame:
    """(lang, bucket, n) over all documents (lang, text): trigrams, and behind ``BUCKETS`` the letters of each script."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = BUCKETS + OTHER_SCRIPT + 1
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(0).to_pylist()
            for a, b, data, offsets in slices(batch.column(1)):
                words = words_of(data, offsets)
                known = {name: k for k, name in enumerate(dict.fromkeys(names[a:b]))}
                lang = np.array([known[x] for x in names[a:b]])[words.text]
                length = words.end - words.first
                keys = np.concatenate([np.repeat(lang * width, length) + words.trigrams, np.repeat(lang * width + BUCKETS + words.script, length)])
                found, n = np.unique(keys, return_counts=True)
                for name, k in known.items():
                    own = slice(*np.searchsorted(found, [k * width, (k + 1) * width]))
                    totals.setdefault(name, np.zeros(width, np.int64))[found[own] - k * width] += n[own]
        for name, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["lang", "bucket", "n"])

    parts = map_batches(docs.select("lang", "text"), run, "lang string, bucket int, n bigint")
    return parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame) -> Model:
    """A model of the documents (lang, text)."""
    docs = docs.where(F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    found = counts(docs).toArrow()
    names = sorted(set(found.column("lang").to_pylist()))
    number = {name: k for k, name in enumerate(names)}
    total = np.zeros((len(names), BUCKETS + OTHER_SCRIPT + 1))
    if names:
        lang = np.array([number[x] for x in found.column("lang").to_pylist()])
        total[lang, found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    grams, scripts = total[:, :BUCKETS], total[:, BUCKETS:]
    shares = np.log((grams + SMOOTHING) / (grams.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS)).astype(np.float32)
    allowed = scripts >= np.maximum(SCRIPT_SHARE * scripts.sum(axis=1, keepdims=True), 1)
    allowed[:, ~allowed.any(axis=0)] = True
    return Model(names, shares, allowed)


def word_scores(words: Words, model: Model, lo: int, hi: int) -> np.ndarray:
    """Scores (words x languages) of a range of words."""
    if hi == lo:
        return np.zeros((0, len(model.names)), np.float32)
    a, b = words.begin[lo], words.begin[hi] if hi < len(words.begin) else len(words.trigrams)
    sums = np.add.reduceat(model.shares[:, words.trigrams[a:b]], words.begin[lo:hi] - a, axis=1).T
    return np.where(model.allowed.T[words.script[lo:hi]], sums, np.float32(EXCLUDED))


def best_path(scores: np.ndarray, begin: np.ndarray, penalty: float = SWITCH, block: int = BLOCK) -> np.ndarray:
    """For each word its label on the best path of its text; ``begin`` has where each text's words begin, and their end."""
    words, n = scores.shape
    count = np.diff(begin)
    blocks = -(-count // block)
    base = np.cumsum(blocks) - blocks
    total = int(blocks.sum())
    if not total:
        return np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(count)), count)
    within = np.arange(words) - begin[text]
    own, step = base[text] + within // block, within % block
    padded = np.zeros((total, block, n), np.float32)
    padded[own, step] = scores

    # From each language before a block to each at its end.
    through = np.where(np.eye(n, dtype=bool), 0.0, -np.inf)[None].repeat(total, axis=0)
    for t in range(block):
        through = padded[:, t, None, :] + np.maximum(through, through.max(axis=2, keepdims=True) - penalty)
    enter = np.zeros((total, n))
    for k in range(1, int(blocks.max())):
        now = base[blocks > k] + k
        enter[now] = (enter[now - 1][:, :, None] + through[now - 1]).max(axis=1)

    back = np.empty((block, total, n), np.uint16)
    now, labels = enter, np.arange(n, dtype=np.uint16)
    for t in range(block):
        top, most = now.argmax(axis=1).astype(np.uint16), now.max(axis=1, keepdims=True) - penalty
        back[t] = np.where(now >= most, labels, top[:, None])
        now = padded[:, t] + np.maximum(now, most)
    # The labels within a block for each language at its end, and the one before it.
    path = np.empty((block, total, n), np.uint16)
    label = np.broadcast_to(labels, (total, n))
    for t in range(block - 1, -1, -1):
        path[t] = label
        label = np.take_along_axis(back[t], label.astype(np.int64), axis=1)
    leave = now.argmax(axis=1)
    for k in range(int(blocks.max()) - 1, 0, -1):
        at = base[blocks > k] + k
        leave[at - 1] = label[at, leave[at]]
    return path[step, own, leave[own]].astype(np.int64)


def labelled(words: Words, model: Model, texts: int) -> np.ndarray:
    """The label of each word; texts are taken together as far as ``CELLS`` go."""
    begin = per_text(words.text, texts)
    out, k = np.zeros(len(words.first), np.int64), 0
    while k < texts:
        end = max(k + 1, int(np.searchsorted(begin, begin[k] + CELLS // len(model.names), "right")) - 1)
        lo, hi = int(begin[k]), int(begin[end])
        out[lo:hi] = best_path(word_scores(words, model, lo, hi), begin[k : end + 1] - lo)
        k = end
    return out


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``lang_pred``, ``score`` and ``spans`` (start, end, lang) in code points."""
    names = np.array([*model.names, UNKNOWN], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(1)):
                texts, languages = b - a, len(model.names)
                words = words_of(data, offsets) if languages else words_of(data[:0], np.zeros(texts + 1, np.int64))
                label = labelled(words, model, texts) if languages else np.zeros(0, np.int64)
                weight = np.bincount(words.text * max(languages, 1) + label, words.end - words.first, minlength=texts * max(languages, 1)).reshape(texts, -1)
                total = weight.sum(axis=1)
                found = np.where(total > 0, weight.argmax(axis=1), languages)
                score = weight.max(axis=1) / np.maximum(total, 1)
                new = np.ones(len(label), bool)
                new[1:] = (label[1:] != label[:-1]) | (words.text[1:] != words.text[:-1])
                start = np.flatnonzero(new)
                last = np.append(start[1:], len(label)) - 1 if len(start) else start
                own = words.texts[words.text[start]]
                spans = pa.StructArray.from_arrays([pa.array(words.first[start] - own, pa.int64()), pa.array(words.end[last] - own, pa.int64()), pa.array(names[label[start]].tolist(), pa.string())], ["start", "end", "lang"])
                lists = pa.ListArray.from_arrays(pa.array(per_text(words.text[start], texts), pa.int32()), spans)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, texts), pa.array(names[found].tolist(), pa.string()), pa.array(score, pa.float64()), lists], ["id", "lang_pred", "score", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = map_batches(rows, run, f"id {kind}, lang_pred string, score double, spans array<struct<start:bigint,end:bigint,lang:string>>")
    return out.withColumnRenamed("id", id_col)
