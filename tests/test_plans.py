"""Plans keep the shape that holds at scale."""

import re
from contextlib import redirect_stdout
from io import StringIO

import pytest

from twintally.operators.compare import KeyedComparison
from twintally.operators.keys import distinct_counts
from twintally.operators.structure import infer_types
from workload.pairs import LINEITEM, ORDERS, SUPPLIED, sides
from workload.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def plan(df, mode="formatted"):
    out = StringIO()
    with redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()


def single_task_windows(df):
    """Windows of the plan whose rows aren't dealt out by any column."""
    simple = plan(df, "simple")
    return [line for line in simple.splitlines() if re.search(r"(?<!Running)\bWindow \[", line) and re.search(r"windowspecdefinition\((?!\S+#\d+\w*, (?!\S+ (?:ASC|DESC)))\S+ (?:ASC|DESC)", line)]


def test_the_search_for_single_task_windows_finds_them(spark):
    table = spark.range(5).selectExpr("id", "id % 2 AS g")
    assert single_task_windows(table.selectExpr("sum(id) OVER (ORDER BY id) AS s"))
    assert single_task_windows(table.selectExpr("sum(id) OVER (ORDER BY g DESC, id) AS s"))
    assert not single_task_windows(table.selectExpr("sum(id) OVER (PARTITION BY g ORDER BY id) AS s"))
    assert not single_task_windows(table)


@pytest.fixture(autouse=True)
def no_broadcast(spark):
    """Plan as for tables that are too large to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["diff_counts_dup", "outer_status_dup", "only_a_dup", "diff_rows_top_hot", "column_structure", "bad_lines", "match_files_full", "positional_diff"])
def test_no_pairing_of_everything_and_no_python(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    text = plan(df)
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "InPandas", "ArrowEval"):
        assert node not in text, node
    assert not single_task_windows(df)


def test_counts_need_one_join_and_key_pass_none(spark):
    unique = KeyedComparison(*sides(spark, SF_DIR, ORDERS), ORDERS.key)
    assert len(re.findall(r"^\(\d+\) \w*Join", plan(unique.counts()), re.M)) == 1
    # Keys repeated on both sides are left out of the join by one more join on either side, and counted by two.
    c = KeyedComparison(*sides(spark, SF_DIR, LINEITEM), LINEITEM.key)
    assert len(re.findall(r"^\(\d+\) \w*Join", plan(c.counts()), re.M)) == 5
    keys = plan(c.key_counts())
    assert "Join" not in keys
    assert keys.count("ReadSchema: struct<l_orderkey:bigint,l_suppkey:bigint,l_linenumber:int>") == 2


def test_aggregates_combine_before_the_shuffle(spark):
    a, b = sides(spark, SF_DIR, ORDERS)
    for df in (distinct_counts(a, b, [("o_orderkey",), ("o_custkey", "o_orderstatus")]), infer_types(a)):
        text = plan(df, "simple")
        assert "HashAggregate" in text and "SortAggregate" not in text


def test_heavy_keys_are_not_paired(spark):
    c = KeyedComparison(*sides(spark, SF_DIR, SUPPLIED), SUPPLIED.key)
    assert c.profile.heavy_keys > 0 and c.profile.matched > 100 * c.profile.rows_a
    assert c.pairs().count() <= c.profile.rows_a + c.profile.rows_b


def test_positions_of_lines_need_no_range_shuffle(spark):
    from twintally.operators.positions import with_block_position, with_position

    rows = [(f"f{k % 3}", k // 40, k, f"v{k}") for k in range(200)]
    table = spark.createDataFrame(rows, "_file string, _block bigint, _at bigint, v string").repartition(5)
    placed = with_block_position(table, "_file", "_block", "_at")
    assert "rangepartitioning" not in plan(placed, "simple") and not single_task_windows(placed)
    order = ["_file", "_block", "_at"]
    assert sorted(r["_pos"] for r in placed.collect()) == list(range(1, 201))
    assert {(r["v"], r["_pos"]) for r in placed.collect()} == {(r["v"], r["_pos"]) for r in with_position(table, order).collect()}


def test_running_totals_are_those_of_one_window(spark):
    from pyspark.sql import functions as F

    from twintally.operators.positions import running_totals

    table = spark.range(3000).select(F.col("id").alias("k"), F.pmod(F.xxhash64("id"), F.lit(7)).alias("n")).repartition(6)
    numbers = dict((r["k"], r["n"]) for r in table.collect())
    totals, total = {}, 0
    for k in sorted(numbers, reverse=True):
        totals[k] = total
        total += numbers[k]
    found = running_totals(table, [F.col("k").desc()], "n", "before")
    assert not single_task_windows(found) and {r["k"]: r["before"] for r in found.collect()} == totals
    some = running_totals(table, [F.col("k").desc()], "n", "before", limit=500)
    assert {r["k"]: r["before"] for r in some.collect()} == {k: t for k, t in totals.items() if t < 500}


def test_keys_are_counted_once_for_profile_and_heavy_keys(spark):
    c = KeyedComparison(*sides(spark, SF_DIR, SUPPLIED), SUPPLIED.key)
    expected = c.key_counts().collect()
    heavy = [r for r in expected if min(r["rows_a"], r["rows_b"]) > 1]
    assert c.profile.heavy_keys == len(heavy) == c._heavy_keys.count()
    assert c.profile.matched == sum(r["rows_a"] * r["rows_b"] for r in expected)
    assert "Exchange" not in plan(c._heavy_keys, "simple")
