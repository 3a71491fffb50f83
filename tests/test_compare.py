import random
from collections import Counter

import pytest

from twintally import compare
from twintally.operators import compare as module
from twintally.operators.compare import KeyedComparison, PositionalComparison

COLUMNS = ["k", "v.1", "w x"]
SCHEMA = "k string, `v.1` string, `w x` string"


def clean(v):
    return "" if v is None else " ".join(v.replace(" ", " ").split())


def random_rows(rng, n, keys):
    values = ["1", "2", " 1", "1 ", "x  y", "x y", None, ""]
    return [(rng.choice(keys), rng.choice(values), rng.choice(values)) for _ in range(n)]


def brute(a, b):
    a, b = ([tuple(map(clean, row)) for row in side] for side in (a, b))
    pairs = [(x, y) for x in a for y in b if x[0] == y[0]]
    keys_a, keys_b = {x[0] for x in a}, {y[0] for y in b}
    differing = [(x[0], *x[1:], *y[1:]) for x, y in pairs if x != y]
    return {
        "n_both": len(pairs),
        "diff": Counter(differing),
        "per_column": [sum(x[i] != y[i] for x, y in pairs) for i in (1, 2)],
        "only_a": Counter(x for x in a if x[0] not in keys_b),
        "only_b": Counter(y for y in b if y[0] not in keys_a),
    }


def shown(df):
    names = ["k"] + [f"{c}__{s}" for s in "ab" for c in COLUMNS[1:]]
    return [tuple(row[n] for n in names) for row in df.collect()]


def frames(spark, seed):
    rng = random.Random(seed)
    keys = ["hot"] * 6 + ["k1", "k2", " k2", "k3 ", None, "", "a only"]
    a = random_rows(rng, 40, keys)
    b = random_rows(rng, 45, [k for k in keys if k != "a only"] + ["b only"])
    return a, b, spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)


@pytest.mark.parametrize("seed, expand", [(1, True), (2, False), (3, False)])
def test_against_brute_force(spark, seed, expand):
    a, b, left, right = frames(spark, seed)
    expected = brute(a, b)
    c = KeyedComparison(left, right, ["k"], expand=expand)
    counts = c.counts().first().asDict()
    assert counts["n_both"] == expected["n_both"]
    assert counts["n_diff"] == sum(expected["diff"].values())
    assert [counts["diff__v.1"], counts["diff__w x"]] == expected["per_column"]
    assert Counter(tuple(r) for r in c.only_a().collect()) == expected["only_a"]
    assert Counter(tuple(r) for r in c.only_b().collect()) == expected["only_b"]
    assert (counts["only_a"], counts["only_b"]) == tuple(sum(expected[s].values()) for s in ("only_a", "only_b"))
    for limit in (3, 50, 100_000):
        assert shown(c.diff_rows_top(limit)) == sorted(expected["diff"].elements())[:limit]
    heavy = {r["k"] for r in c.key_counts().where(c._is_heavy()).collect()}
    light = Counter({row: n for row, n in expected["diff"].items() if row[0] not in heavy})
    assert Counter(shown(c.diff_rows())) == light
    if heavy:
        rebuilt = Counter()
        groups = c.diff_groups().collect()
        for x in groups:
            for y in groups:
                copies = x["rows_a"] * y["rows_b"]
                if x["k"] == y["k"] and copies and x[1:3] != y[1:3]:
                    rebuilt[(x["k"], *x[1:3], *y[1:3])] += copies
        assert rebuilt + light == expected["diff"]


def test_outer_lists_pairs_and_one_sided_rows(spark):
    a, b, left, right = frames(spark, 4)
    a, b = ([tuple(map(clean, row)) for row in side] for side in (a, b))
    keys_a, keys_b = {x[0] for x in a}, {y[0] for y in b}
    expected = Counter((x[0], *x[1:], *y[1:], "both") for x in a for y in b if x[0] == y[0])
    expected += Counter((x[0], *x[1:], None, None, "only_a") for x in a if x[0] not in keys_b)
    expected += Counter((y[0], None, None, *y[1:], "only_b") for y in b if y[0] not in keys_a)
    found = KeyedComparison(left, right, ["k"], expand=True).outer().collect()
    names = ["k", "v.1__a", "w x__a", "v.1__b", "w x__b", "side"]
    assert Counter(tuple(r[n] for n in names) for r in found) == expected


@pytest.mark.parametrize("n", [1, 2, 32, 33, 1000])
def test_listed_and_grouped_differences_add_up(spark, n):
    a = spark.createDataFrame([("k", str(i % 7)) for i in range(n)] + [("one", "x")], "k string, v string")
    b = spark.createDataFrame([("k", str(i % 5)) for i in range(n)] + [("one", "y")] * 3, "k string, v string")
    c = KeyedComparison(a, b, ["k"])
    groups = c.diff_groups().collect()
    grouped = sum(x["rows_a"] * y["rows_b"] for x in groups for y in groups if x["v"] != y["v"])
    assert c.diff_rows().count() + grouped == c.counts().first()["n_diff"]
    assert c.diff_rows().count() == c.diff_cells().count() == 3
    assert KeyedComparison(a, b, ["k"], expand=True).diff_rows().count() == c.counts().first()["n_diff"]


def test_helper_names_leave_columns_alone(spark):
    for name in ("rows_a", "side", "column", "pos", "_rank"):
        schema = f"{name} string, v string, rows_b string"
        a = spark.createDataFrame([("1", "x", "r"), ("2", "y", "r"), ("2", "z", "r"), ("3", "o", "r")], schema)
        b = spark.createDataFrame([("1", "n", "r"), ("2", "y", "r"), ("2", "y", "s")], schema)
        c = KeyedComparison(a, b, [name])
        assert c.counts().first()["n_diff"] == 4 and c.diff_rows().count() == 1
        assert {r[name] for r in c.outer().collect()} == {"1", "3"}
        assert [r[name] for r in c.diff_cells().collect()] == ["1"]
        assert c.diff_rows_top(3).count() == 3 and c.diff_groups().count() == 3


def test_underscored_order_columns_are_compared(spark):
    a, b = (spark.createDataFrame([(n, "x")], "_id int, v string") for n in (2, 9))
    assert compare(a, b, order_by=["_id"]).counts().first()["n_diff"] == 1
    assert compare(a, b, order_by=["_id"], helpers=["_id"]).counts().first()["n_diff"] == 0


def test_cells_and_materialized_reports(spark):
    _, _, left, right = frames(spark, 5)
    c = KeyedComparison(left, right, ["k"], expand=True)
    before = Counter(map(tuple, c.diff_cells().collect()))
    counts = c.counts().first()
    per_column = Counter(r["column"] for r in c.diff_cells().collect())
    assert per_column == {"v.1": counts["diff__v.1"], "w x": counts["diff__w x"]}
    c.materialize()
    assert Counter(map(tuple, c.diff_cells().collect())) == before
    assert c.counts().first() == counts


def test_swapping_sides_and_equal_sides(spark):
    _, _, left, right = frames(spark, 6)
    forth, back = KeyedComparison(left, right, ["k"]), KeyedComparison(right, left, ["k"])
    assert (forth.profile.only_a, forth.profile.only_b) == (back.profile.only_b, back.profile.only_a)
    same = spark.createDataFrame([(str(i), "x", None) for i in range(9)], SCHEMA)
    p = KeyedComparison(same, same, ["k"], expand=True)
    assert p.counts().first()["n_diff"] == 0 and p.profile.only_a == p.profile.only_b == 0


def test_wide_tables_take_the_long_form(spark, monkeypatch):
    _, _, left, right = frames(spark, 7)
    narrow = KeyedComparison(left, right, ["k"]).counts().first()
    monkeypatch.setattr(module, "WIDE_COLUMNS", 1)
    assert KeyedComparison(left, right, ["k"]).counts().first() == narrow


def test_original_values_are_reported_but_compared_clean(spark):
    a = spark.createDataFrame([(" 1", "x  y"), ("2", "p")], "k string, v string")
    b = spark.createDataFrame([("1 ", "x y"), ("2", " q")], "k string, v string")
    c = KeyedComparison(a, b, ["k"], keep_original=True)
    assert [tuple(r)[:3] for r in c.diff_rows().collect()] == [("2", "p", " q")]
    assert c.summary().first()["rows_diff"] == 1


def test_column_summary_texts(spark):
    a = spark.createDataFrame([("1", "x", "p"), ("2", "y", "p"), ("3", "z", "p")], "k string, v string, w string")
    b = spark.createDataFrame([("1", "x", "p"), ("2", "n", "p"), ("3", "z", "p")], "k string, v string, w string")
    rows = KeyedComparison(a, b, ["k"]).column_summary().orderBy("position").collect()
    assert [(r["column"], r["n_equal"], r["n_diff"], r["pct_text"], r["status"]) for r in rows] == [
        ("v", 2, 1, "33.3%", "DIFFERENZE"),
        ("w", 3, 0, "0.0%", "OK"),
    ]


@pytest.mark.parametrize("unique", [False, True])
def test_positions_against_sorted_rows(spark, unique):
    rng = random.Random(8)
    a = [(i if unique else rng.randint(0, 5), rng.choice("xy")) for i in range(60)]
    b = [(i if unique else rng.randint(0, 5), rng.choice("xy")) for i in range(70)]
    left, right = (spark.createDataFrame(side, "o int, v string").repartition(4) for side in (a, b))
    c = compare(left, right, order_by=["o"], unique_order=unique)
    assert isinstance(c, PositionalComparison)
    sides = [[(str(o), v) for o, v in sorted(side)] for side in (a, b)]
    expected = [(i + 1, x, y) for i, (x, y) in enumerate(zip(*sides)) if x != y]
    found = [(r["_pos"], (r["o__a"], r["v__a"]), (r["o__b"], r["v__b"])) for r in c.diff_rows().orderBy("_pos").collect()]
    assert found == expected
    assert c.profile.matched == 60 and c.only_a().count() == 0
    assert [(r["_pos"], r["o"], r["v"]) for r in c.only_b().orderBy("_pos").collect()] == [
        (i + 1, *row) for i, row in enumerate(sides[1]) if i >= 60
    ]


def test_order_is_required_without_key(spark):
    df = spark.createDataFrame([("1",)], "v string")
    with pytest.raises(ValueError):
        compare(df, df)


def test_tables_of_key_columns_only(spark):
    a = spark.createDataFrame([("1",), ("2",)], "k string")
    b = spark.createDataFrame([("2",), ("3",)], "k string")
    c = KeyedComparison(a, b, ["k"])
    assert tuple(c.counts().first()) == (1, 1, 1, 0)
    assert c.column_summary().count() == c.diff_cells().count() == c.diff_rows().count() == 0
