import random
import re

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tests.llm.conftest import ODD
from twintally.llm import copies
from twintally.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) > 4 else frozenset([tuple(words)] if words else [])


def brute(rows):
    """(id, size, least id of the class) of each row."""
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (row, _) in enumerate(rows):
        if row is not None:
            least[find(i)] = min(row, least.get(find(i), row))
    return [(row, len(sets[i]), least.get(find(i))) for i, (row, _) in enumerate(rows)]


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randrange(edits)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def cases():
    rng = random.Random(11)
    texts = []
    for k in range(6):
        texts += family(rng, [f"w{k}_{rng.randrange(300)}" for _ in range(80)], 14, 7)
    common = [f"c{j}" for j in range(30)]
    texts += [" ".join(common + [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 60))]) for _ in range(40)]
    texts += [texts[3]] * 5 + [texts[5].upper()] + ["a b c", "A  b\tc", "a b", "a b c d e"]
    rng.shuffle(texts)
    return [(k, t) for k, t in enumerate(texts)] + ODD


@pytest.mark.parametrize("long_list", [2, 32])
def test_classes_are_those_of_brute_force(docs, monkeypatch, long_list):
    """With long lists from 3 entries on, and with none."""
    monkeypatch.setattr(copies, "LONG_LIST", long_list)
    monkeypatch.setattr(copies, "BROADCAST_ROWS", 0 if long_list == 2 else 100)
    rows = cases()
    found = copies.classes(docs(rows, node="x", row=2.5)).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found), key=str) == sorted(brute(rows), key=str)


def test_one_of_each_class_stays(spark, docs, tmp_path):
    rows = [(k, t) for k, (_, t) in enumerate(cases())]
    docs(rows, lang="en").write.parquet(str(tmp_path / "d"))
    table = spark.read.parquet(str(tmp_path / "d"))
    out = copies.one_of_each(table).collect()
    names = {r: c for r, _, c in brute(rows)}
    kept = [names[r["doc_id"]] for r in out if shingles(r["text"])]
    assert len(kept) == len(set(kept)) == len({names[r] for r, t in rows if shingles(t)})
    assert sum(not shingles(r["text"]) for r in out) == sum(not shingles(t) for _, t in rows)


def test_empty_table(docs):
    assert copies.classes(docs([])).collect() == []


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + k, 1001 + k) for k in range(40)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {x: find(x) for a, b in links if a != b for x in (a, b)}


def test_classes_hold_when_the_input_is_split_anew(spark, tmp_path, monkeypatch):
    from tests.llm.conftest import splits_anew

    rows = [(k, " ".join(f"w{(k % 400) * 31 + j}" for j in range(30)) + (" more" if k % 2 else "")) for k in range(1200)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    with splits_anew(spark, copies, monkeypatch):
        assert {r["doc_id"]: r["component_id"] for r in copies.classes(table, of_files=True).collect()} == {k: k % 400 for k in range(1200)}
        assert {r["doc_id"] % 400 for r in copies.one_of_each(table, of_files=True).collect()} == set(range(400))


def test_long_lists_are_summed_where_they_are_read(docs, monkeypatch):
    monkeypatch.setattr(copies, "SUMMED_LIST", 8)
    rows = cases()
    assert sorted(map(str, copies.classes(docs(rows)).select("doc_id", "n_shingles", "component_id").collect())) == sorted(
        str(Row(doc_id=i, n_shingles=n, component_id=c)) for i, n, c in brute(rows)
    )


def test_no_task_gets_a_long_list(spark, docs, monkeypatch):
    monkeypatch.setattr(copies, "SUMMED_LIST", 8, raising=False)
    dealt, own = {}, copies.stage

    def stage(df, name, *args, **named):
        if name in ("shared", "open-lists"):
            rows = df.groupBy("token", F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"))
            dealt[name] = rows.groupBy("token").agg(F.sum("n"), F.max("n")).collect()
        return own(df, name, *args, **named)

    # 26 of each two documents' 36 shingles are common, so they have common prefixes and no links.
    rng = random.Random(4)
    rows = [(k, " ".join([f"w{j}" for j in range(30)] + [f"u{rng.randrange(10**9)}" for _ in range(5)])) for k in range(90)]
    monkeypatch.setattr(copies, "stage", stage)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = copies.classes(docs(rows)).select("doc_id", "n_shingles", "component_id").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sorted(map(tuple, found)) == sorted(brute(rows)) == [(k, 31, k) for k in range(90)]
    for name in ("shared", "open-lists"):
        long = [(total, most) for _, total, most in dealt[name] if total > 8]
        assert long and all(total == 90 and most <= 60 for total, most in long), (name, long)
