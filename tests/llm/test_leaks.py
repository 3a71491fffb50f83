import random
import re

import pytest
from pyspark.sql import types as T

from tests.llm.conftest import ODD
from twintally.llm import leaks

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(text, items, window=10):
    words, hit, found = WORD.findall(lower(text)), set(), set()
    for item_id, item in items:
        own = WORD.findall(lower(item))
        for j in range(max(len(own) - window + 1, min(len(own), 1))):
            part = own[j : j + window]
            for i in range(len(words) - len(part) + 1):
                if words[i : i + len(part)] == part:
                    hit |= set(range(i, i + len(part)))
                    if item_id is not None:
                        found.add(str(item_id))
    return len(words), hit, found


def cases(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "cé", "d1", "日本"]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(some(rng.randrange(6, 30)))) for k in range(12)] + [(90, "a B"), (91, ""), (92, None), (93, "a B")]
    rows = []
    for k in range(60):
        words = some(rng.randrange(40))
        if k % 2:
            own = (rng.choice(items)[1] or "").split()
            at = rng.randrange(len(words) + 1)
            words[at:at] = own[rng.randrange(3) :]
        rows.append((k, rng.choice([" ", "-", "\n", ". "]).join(words)))
    return rows, items


@pytest.mark.parametrize("block", [leaks.BLOCK_BYTES, 150])
def test_hits_are_those_of_brute_force(spark, docs, monkeypatch, block):
    monkeypatch.setattr(leaks, "BLOCK_BYTES", block)
    monkeypatch.setattr(leaks, "ROWS_AT_ONCE", 7)
    rows, items = cases(5)
    rows += [r for r in ODD if r[0] != 8]
    out = leaks.find_leaks(docs(rows, spans="x", items=3), spark.createDataFrame(items, ITEMS)).collect()
    found = sorted(str((r["doc_id"], r["n_words"], sorted({j for s in r["spans"] for j in range(s["start"], s["start"] + s["length"])}), sorted(set(r["items"])))) for r in out)
    expected = []
    for i, text in rows:
        n, hit, ids = brute(text, items)
        expected.append(str((i, n, sorted(hit), sorted(ids))))
    assert found == sorted(expected)
    for r in out:
        ends = [(s["start"], s["start"] + s["length"]) for s in r["spans"]]
        assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))


def test_spans_are_cut_from_texts(spark, docs):
    item = "One two, three four five six seven eight nine ten eleven é."
    table = docs([(1, f"Before it. {item} After it."), (2, "clean é text"), (3, None), (4, "")], more=[1])
    out = {r["doc_id"]: r for r in leaks.remove_leaks(table, spark.createDataFrame([(1, item)], ITEMS)).collect()}
    assert out[1]["text"] == "Before it. . After it." and out[1]["more"] == [1]
    assert out[2]["text"] == "clean é text" and out[3]["text"] is None and out[4]["text"] == ""


@pytest.mark.parametrize("block", [leaks.BLOCK_BYTES, 150])
def test_what_is_cut_does_not_depend_on_blocks(spark, docs, monkeypatch, block):
    """Items that overlap in a text, and phrases that a cut would make, lie in different blocks."""
    monkeypatch.setattr(leaks, "BLOCK_BYTES", block)
    w = [f"w{k}" for k in range(60)]
    rows, items = cases(7)
    items += [(200 + k, " ".join(w[k : k + 14])) for k in range(0, 46, 5)] + [(300, " ".join([*w[55:], "x1", "x2", "x3", "x4", "x5"]))]
    rows += [(200, " ".join(["before", *w[:50], "after"])), (201, " ".join(w[3:31])), (202, " ".join([*w[55:], *w[20:34], "x1 x2 x3 x4 x5"]))]
    out = {r["doc_id"]: r["text"] for r in leaks.remove_leaks(docs(rows, more=1), spark.createDataFrame(items, ITEMS)).collect()}
    left = lambda t: [x for j, x in enumerate(WORD.findall(lower(t))) if j not in brute(t, items)[1]]
    assert {i: WORD.findall(lower(t)) for i, t in out.items()} == {i: left(t) for i, t in rows}
    assert "x1 x2" in out[202] and "w55" in out[202] and "w20" not in out[202]


def test_empty_tables(spark, docs):
    items = spark.createDataFrame([], ITEMS)
    assert leaks.find_leaks(docs([]), items).collect() == []
    row = leaks.find_leaks(docs([(1, "a b")]), items).first()
    assert (row["n_words"], row["spans"], row["items"]) == (2, [], [])
    assert leaks.remove_leaks(docs([(1, "a b")]), items).first()["text"] == "a b"
