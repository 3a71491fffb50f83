import hashlib
import random
import tracemalloc
from collections import Counter, defaultdict
from unittest.mock import MagicMock

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from tokenizers import Tokenizer

from tests.llm.conftest import ODD
from twintally.llm import alignment
from twintally.llm.queries import QUERIES

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(rows):
    """Per document from the libraries' ids of whole texts, token by token."""
    one, two = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    one.encode_special_tokens = True
    table = {v: k for k, v in alignment.byte_level_table().items()}
    spelling = {k: v for v, k in one.get_vocab().items()}
    bytes_a = lambda k: bytes({c: b for b, c in table.items()}[c] for c in spelling[k])
    bytes_b = lambda k: bytes([int(two.id_to_piece(k)[3:5], 16)]) if two.is_byte(k) else two.id_to_piece(k).replace("\u2581", " ").encode()
    groups = []
    for _, text in rows:
        own = []
        if text:
            a, b = one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)
            if b"".join(map(bytes_a, a)) == b"".join(map(bytes_b, b)) == (" " + text).encode():
                at, i, j = [0, 0], 0, 0
                left, right = [], []
                while i < len(a) or j < len(b):
                    if at[0] <= at[1] and i < len(a):
                        left.append(a[i])
                        at[0] += len(bytes_a(a[i]))
                        i += 1
                    else:
                        right.append(b[j])
                        at[1] += len(bytes_b(b[j]))
                        j += 1
                    if at[0] == at[1]:
                        own.append((left, right))
                        left, right = [], []
        groups.append(own)
    count = Counter((g[0][-1], g[1][-1]) for own in groups for g in own)
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    out = []
    for (i, _), own in zip(rows, groups):
        links = [(g[0][-1], g[1][-1]) for g in own]
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in own)
        sums = [sum(len(g[k]) for g in own) for k in (0, 1)]
        out.append((i, *sums, len(own), len(own), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if own else ""))
    return out


def some_rows(rng):
    bits = ["the", " quick", "Thing", "ly", "  ", "\n", "\t", "é", "ñoño", "日本", "語", "🙂", "don't", "1234", ".", "...", "<|endoftext|>", "<s>", "<0x41>", " of", "antidisestablishment", "\u00a0", "\x00", "ﬁ"]
    rows = [(k, "".join(rng.choice(bits) for _ in range(rng.randrange(1, 30)))) for k in range(300)]
    return rows + [(900, "a\u2581b"), (901, " "), (902, "   leading and trailing   "), (903, "\u2581"), (904, "x" * 300 + " " * 300)] + rows[:20] + ODD


def test_result_is_that_of_brute_force(docs):
    rows = some_rows(random.Random(1))
    out = alignment.align(docs(rows, row=1, n_a="x", light=2), A, B)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, brute(rows)))


def test_light_links_are_counted_in_a_shuffle(docs):
    rows = some_rows(random.Random(2))
    # With so few heavy pairs, nearly all irregular links take the other way.
    out = alignment.align(docs(rows), A, B, heavy=3)
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, brute(rows)))


def test_a_model_with_pieces_across_spaces_takes_whole_texts(docs, monkeypatch):
    encoder = alignment.piece_encoder(B)
    monkeypatch.setattr(encoder, "divisible", False)
    import numpy as np

    data = np.frombuffer(b" one two  three four", np.uint8)
    ids, begin = encoder.encode(data, np.array([0, 15, 20]))
    assert ids.tolist() == encoder.model.encode("one two  three") + encoder.model.encode("four")
    assert begin.tolist() == [0, len(encoder.model.encode("one two  three")), len(ids)]


def test_empty_table(docs):
    assert alignment.align(docs([]), A, B).collect() == []


def test_query_over_a_whole_table(spark):
    out = QUERIES["op11_token_alignment"](spark, "/root/testdata/sf0.001")
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert sorted(map(tuple, out.collect())) == sorted(brute(rows))
    assert [t for _, t in out.dtypes] == ["bigint"] * 7 + ["string"]


def runner(make, monkeypatch, *args):
    """The function over Arrow batches that an operator's step gives to Spark."""
    found = []
    with monkeypatch.context() as patch:
        patch.setattr(alignment, "map_batches", lambda df, run, schema: found.append(run) or df)
        make(*args)
    return found[0]


def steps(encoded, monkeypatch):
    """The runs of the steps that count and score, with the columns they take."""
    regular = np.arange(len(alignment.vocabulary_a(A).entries))
    best = np.full(len(alignment.piece_encoder(B).vocabulary.entries), 5)
    heavy = np.array([1 << 32 | 2, 7 << 32 | 9]), np.array([5, 4])
    monkeypatch.setattr(alignment, "F", MagicMock())
    return [(runner(alignment.count_links, monkeypatch, MagicMock(), A, B), [6, 7, 8]), (runner(alignment.score, monkeypatch, encoded, regular, best, heavy, A, B), range(9))]


def links(lists):
    """A batch of encoded documents with the given regular links and pairs of other links."""
    regular, a, b = ([list(map(int, x[k])) for x in lists] for k in range(3))
    numbers = [pa.array(range(len(lists)), pa.int64())] * 5
    columns = [*numbers, pa.array([""] * len(lists)), *(pa.array(x, pa.list_(pa.int32())) for x in (regular, a, b))]
    return pa.RecordBatch.from_arrays(columns, "row id n_a n_b n_groups groups_sha256 regular odd_a odd_b".split())


def test_steps_over_links_take_large_batches_by_slices(monkeypatch):
    # Two million regular links and as many others in one batch: arrays over all of them would take 16 MB each.
    one = np.arange(1000)
    batch = links([(one, one + 1, one)] * 2000)
    for run, columns in steps(MagicMock(), monkeypatch):
        for _ in run(iter([batch.slice(0, 10).select(list(columns))])):
            pass
        tracemalloc.start()
        for _ in run(iter([batch.select(list(columns))])):
            pass
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 24e6


def test_slices_of_links_change_nothing(monkeypatch):
    rng = np.random.default_rng(3)
    some = lambda n: (rng.integers(0, 9, n % 5), *rng.integers(0, 12, (2, n % 7)))
    batch = links([some(n) for n in rng.integers(0, 35, 200)]).slice(11, 150)
    for k, (run, columns) in enumerate(steps(MagicMock(), monkeypatch)):
        outs = []
        for limit in (1, 7, 1 << 18):
            monkeypatch.setattr(alignment, "COUNTED_LINKS", limit)
            rows = pa.Table.from_batches(list(run(iter([batch.select(list(columns)), batch.slice(0, 0).select(list(columns))])))).to_pylist()
            counts = Counter()
            for r in rows if k == 0 else ():
                counts[r["a"], r["b"], r["regular"]] += r["n"]
            outs.append(rows if k else counts)
        assert outs[0] == outs[1] == outs[2] and len(outs[0]) > 100
