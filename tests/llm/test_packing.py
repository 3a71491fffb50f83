import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.conftest import ODD
from twintally.llm import packing
from twintally.llm.tokens import Encoder
from twintally.llm.words import slices

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)
ENCODER = Encoder(PATH, 2)

BITS = ["'s", "'re", "'", " ", "  ", "\n", "\t", "it's", "é", "日本", "1", "٣", "!", "'ll", "x'sst", "\x85", "\u3000", "<|endoftext|>", "\u1c8a", "\u200b", "\r\n", "S'S"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.lists(st.sampled_from(BITS), max_size=12).map("".join)), max_size=8))
def test_ids_are_those_of_the_library(texts):
    texts = [t.encode(errors="ignore").decode() for t in texts]
    for a, b, data, offsets in slices(pa.array(texts, pa.string()), 40):
        ids, begin = ENCODER.encode(data, offsets)
        for k in range(b - a):
            assert ids[begin[k] : begin[k + 1]].tolist() == [*TOKENIZER.encode(texts[a + k], add_special_tokens=False).ids, 2]


def test_pieces_and_sequences(docs, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 20)
    rng = random.Random(1)
    rows = ODD + [(k, " ".join(rng.choice(["alpha", "be", "c"]) for _ in range(rng.randrange(200)))) for k in range(100, 180)]
    out = packing.pack(docs(rows, piece="x", length=1), PATH, 64).collect()
    expected = sorted(([*TOKENIZER.encode(t or "", add_special_tokens=False).ids, 2] for _, t in rows))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in out:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        if r["doc_id"] not in (None, 5):
            by_doc[r["doc_id"]].append((r["piece"], r["start"], ids))
    for parts in by_doc.values():
        parts.sort()
        assert [p[0] for p in parts] == list(range(len(parts))) and all(len(p[2]) == 64 for p in parts[1:])
        assert [p[1] for p in parts] == [sum(len(q[2]) for q in parts[:k]) for k in range(len(parts))]
        assert [i for p in parts for i in p[2]] in expected
    assert {d for d, _ in rows} - {None, 5} == set(by_doc)
    for parts in by_sequence.values():
        parts.sort()
        assert [p[0] for p in parts] == [sum(q[1] for q in parts[:k]) for k in range(len(parts))]
        assert sum(p[1] for p in parts) <= 64


def brute_best_fit(lengths, capacity, limit):
    """Free space of each open bin in a list; ties go to the bin that got a piece last."""
    open_bins, placed, opened = [], [], 0
    for n in lengths:
        fitting = [b for b in open_bins if b[0] >= n]
        if fitting:
            bin_ = min(reversed(fitting), key=lambda b: b[0])
            open_bins.remove(bin_)
        else:
            if len(open_bins) == limit:
                open_bins.remove(min(reversed(open_bins), key=lambda b: b[0]))
            bin_ = (capacity, opened)
            opened += 1
        placed.append((bin_[1], capacity - bin_[0]))
        if bin_[0] > n:
            open_bins.append((bin_[0] - n, bin_[1]))
    return [p[0] for p in placed], [p[1] for p in placed]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120), st.integers(1, 12))
def test_best_fit_is_that_of_brute_force(lengths, limit):
    assert packing.best_fit(lengths, 40, limit) == brute_best_fit(lengths, 40, limit)


def test_sequences_are_well_filled():
    rng = random.Random(5)
    lengths = [rng.randrange(1, 1025) for _ in range(50_000)]
    assert sum(lengths) / 1024 / (max(packing.best_fit(lengths, 1024)[0]) + 1) > 0.98


def test_empty_table(docs):
    assert packing.pack(docs([]), PATH, 64).collect() == []
