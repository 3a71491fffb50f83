from collections import Counter

from tests.llm.conftest import ODD
from twintally.llm import shards


def test_sizes_slots_and_columns(spark, docs, monkeypatch):
    monkeypatch.setattr(shards, "BUCKET_ROWS", 5)
    rows = ODD + [(k, "t" * (k % 7)) for k in range(100, 300)]
    table = docs(rows, size="old", slot=1.5, lang="de").repartition(7)
    out = shards.shard(table, 8).collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in out) == sorted((str(a), str(b)) for a, b in rows)
    sizes = Counter(r["shard"] for r in out)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(n))
    assert all(r["size"] == len((r["text"] or "").encode()) + 8 and r["lang"] == "de" for r in out)


def test_few_rows_and_none(docs):
    assert sorted(r["shard"] for r in shards.shard(docs([(1, "a"), (1, "a")]), 5).collect()) == [0, 1]
    assert shards.shard(docs([]), 5).collect() == []


def test_numbers_follow_the_hypergeometric_law(spark):
    """30 of 90 places, 20 special: mean 20/3 and the variance of the law, over many nodes."""
    nodes = spark.range(4000).selectExpr("id AS node", "array(20L, 40L, 30L) AS caps", "30L AS half")
    taken = [r[0] for r in nodes.selectExpr(shards.split_places(3, 1)).collect()]
    assert all(sum(t) == 30 and all(0 <= x <= c for x, c in zip(t, (20, 40, 30))) for t in taken)
    for k, cap in enumerate((20, 40, 30)):
        values = [t[k] for t in taken]
        mean = sum(values) / len(values)
        variance = sum((x - mean) ** 2 for x in values) / len(values)
        expected = 30 * cap / 90 * (1 - cap / 90) * 60 / 89
        assert abs(mean - 30 * cap / 90) < 0.12 and abs(variance - expected) < 0.12 * expected


def test_large_counts(spark):
    node = spark.range(1).selectExpr("id AS node", "array_repeat(3000000000L, 24) AS caps", "31000000000L AS half")
    taken = node.selectExpr(shards.split_places(24, 1)).first()[0]
    assert sum(taken) == 31_000_000_000 and all(abs(x / 3e9 - 31 / 72) < 1e-3 for x in taken)


def test_shuffle_is_uniform_over_pairs(spark, docs):
    """Rows that stand together in the input fall into the same shard about once in so many shards."""
    table = docs([(k, "x") for k in range(4000)]).coalesce(3)
    out = {r["doc_id"]: r["shard"] for r in shards.shard(table, 4).collect()}
    together = sum(out[k] == out[k + 1] for k in range(3999))
    assert 900 < together < 1100


def test_plan_has_no_python(spark, docs):
    plan = shards.shard(docs([(1, "a"), (2, "b")]), 3)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_no_row_is_lost_when_the_input_is_split_anew(spark, tmp_path, monkeypatch):
    from tests.llm.conftest import splits_anew

    spark.range(20_000).selectExpr("id AS doc_id", "concat('text ', id) AS text").repartition(7).write.parquet(str(tmp_path / "t"))
    with splits_anew(spark, shards, monkeypatch):
        out = shards.shard(spark.read.parquet(str(tmp_path / "t")), 24, of_files=True).collect()
    assert sorted(r["doc_id"] for r in out) == list(range(20_000))
    for k in range(24):
        own = sorted(r["slot"] for r in out if r["shard"] == k)
        assert own == list(range(len(own))) and len(own) in (833, 834)
