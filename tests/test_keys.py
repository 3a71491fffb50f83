import glob
import random
from itertools import combinations

import pytest

from tests.test_staging import shuffle_files
from twintally import detect_key, detect_key_strict
from twintally.operators import keys
from twintally.operators.keys import key_uniqueness
from twintally.operators.structure import column_structure, infer_types
from twintally.sources.staging import shared_dir


def brute_key(columns, a, b):
    best, best_score = [], -1.0
    for size in range(1, 5):
        for combo in combinations(range(len(columns)), size):
            shares = [len({tuple(r[i] or "" for i in combo) for r in side}) / max(len(side), 1) for side in (a, b)]
            score = sum(shares) / 2
            if score > best_score:
                best, best_score = [columns[i] for i in combo], score
            if best_score >= 0.999:
                return best
    return best if best_score >= 0.5 else []


@pytest.mark.parametrize("seed", range(5))
def test_detect_key_against_brute_force(spark, seed):
    rng = random.Random(seed)
    columns = ["a", "b", "c", "d", "e"]
    sizes = [rng.choice([2, 3, 6, 12]) for _ in columns]
    sides = [[tuple(rng.choice([None, *map(str, range(n))]) for n in sizes) for _ in range(60)] for _ in "ab"]
    frames = [spark.createDataFrame(side, ", ".join(f"{c} string" for c in columns)) for side in sides]
    assert detect_key(*frames) == brute_key(columns, *sides)


def test_ambiguous_empty_and_unrelated(spark):
    same = spark.createDataFrame([("x", "y")] * 10, "a string, b string")
    assert detect_key(same, same) == []
    empty = same.limit(0)
    assert detect_key(empty, empty) == []
    assert detect_key(same, same.toDF("c", "d")) == []
    assert detect_key_strict(same, same) == []


def test_values_do_not_run_together(spark):
    df = spark.createDataFrame([("1", "11"), ("11", "1"), ("1:", "1"), ("1", ":1")], "a string, b string")
    row = key_uniqueness(df, df, [("a", "b")]).first()
    assert (row["distinct_a"], row["score"]) == (4, 1.0)


def test_strict_key_ignores_columns_with_null_but_not_pairs(spark):
    df = spark.createDataFrame([(None, "x"), ("1", "x"), ("2", "y")], "a string, b string")
    assert detect_key_strict(df, df) == ["a", "b"]
    full = spark.createDataFrame([("x", "1"), ("x", "2")], "a string, b string")
    assert detect_key_strict(full, full) == ["b"]


@pytest.mark.parametrize(
    "values, expected",
    [
        (["1", "2", "-3"], "INTERO"),
        (["1", "2.5"], "DECIMALE"),
        (["1,5", "2,5"], "TESTO"),
        (["31/01/2024", "1/2/2024", ""], "DATA"),
        (["31/02/2024"], "TESTO"),
        (["2024-01-31", "31/01/2024"], "TESTO"),
        (["2024-01-31 10:20:30"], "DATA"),
        (["20240131"], "INTERO"),
        (["", " "], "VUOTO"),
        ([None, None], "VUOTO"),
        (["nan", "x"], "TESTO"),
        ([str(i) for i in range(19)] + ["x"], "INTERO"),
        ([str(i) for i in range(9)] + ["x"], "TESTO"),
        (["1.5d", "2f"], "TESTO"),
    ],
)
def test_infer_types(spark, values, expected):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert infer_types(df).first()["type"] == expected


def test_structure_keeps_named_empty_columns(spark):
    a = spark.createDataFrame([("1", "", "x")], "k string, e string, gone string")
    b = spark.createDataFrame([("1", "7", "n")], "k string, e string, fresh string")
    rows = [tuple(r) for r in column_structure(a, b).collect()]
    assert rows == [
        ("k", "Si'", "Si'", 1, 1, "INTERO", "INTERO", "Si'", "OK"),
        ("e", "Si'", "Si'", 2, 2, "VUOTO", "INTERO", "No", "OK"),
        ("gone", "Si'", "No", 3, None, "TESTO", "—", "—", "SOLO AS-IS"),
        ("fresh", "No", "Si'", None, 3, "—", "TESTO", "—", "SOLO TO-BE"),
    ]


@pytest.fixture
def small_passes(monkeypatch):
    """Few rows count as many: several passes, shuffles by one column, popular values apart."""
    for name, value in {"PASS_ROWS": 150, "TASK_ROWS": 16, "TASK_TUPLES": 8, "BUCKETS": 16, "POPULAR": 8}.items():
        monkeypatch.setattr(keys, name, value)


def uneven_sides(seed):
    """Nulls, blanks, a value of half the rows, and a column that nearly tells rows apart."""
    rng = random.Random(seed)
    columns = ["a", "b", "c", "d"]
    value = {
        "a": lambda: rng.choice([None, "", "7", *map(str, range(100, 400))]) if rng.random() < 0.6 else "7",
        "b": lambda: rng.choice([None, "", "x"]),
        "c": lambda: str(rng.randrange(5)),
        "d": lambda: str(rng.randrange(200)),
    }
    return columns, [[tuple(value[c]() for c in columns) for _ in range(n)] for n in (300, 250)]


@pytest.mark.parametrize("seed", [1])
def test_counts_by_passes_are_those_of_brute_force(spark, small_passes, monkeypatch, seed):
    columns, sides = uneven_sides(seed)
    frames = [spark.createDataFrame(side, ", ".join(f"{c} string" for c in columns)) for side in sides]
    combos = [c for n in range(1, 5) for c in combinations(columns, n)]
    kinds, shared, summed = [], keys._shared, keys._summed
    monkeypatch.setattr(keys, "_shared", lambda *x: kinds.append("shared") or shared(*x))
    monkeypatch.setattr(keys, "_summed", lambda *x: kinds.append(("summed", x[3])) or summed(*x))
    found = {r["columns"]: (r["distinct_a"], r["distinct_b"]) for r in key_uniqueness(*frames, combos).collect()}
    for combo in combos:
        places = [columns.index(c) for c in combo]
        assert found[",".join(combo)] == tuple(len({tuple(r[i] or "" for i in places) for r in side}) for side in sides)
    assert "shared" in kinds and any(x[1] > 1 for x in kinds if x != "shared")
    assert detect_key(*frames) == brute_key(columns, *sides)


def test_counting_leaves_no_shuffles_and_no_tables(spark, small_passes):
    columns, sides = uneven_sides(9)
    frames = [spark.createDataFrame(side, ", ".join(f"{c} string" for c in columns)) for side in sides]
    before, staged = shuffle_files(spark), set(tables_of(spark))
    key_uniqueness(*frames, [("a",), ("a", "d"), ("a", "b", "d"), ("a", "c", "d")]).collect()
    # One row of sums may be left.
    assert len({x.split("_")[1] for x in shuffle_files(spark) - before}) <= 1
    detect_key(*frames)
    assert set(tables_of(spark)) == staged


def tables_of(spark):
    return glob.glob(f"{shared_dir(spark).removeprefix('file://')}/twintally/{spark.sparkContext.applicationId}/*")


def brute_strict(columns, sides):
    def single(places):
        return all(len({tuple(r[i] or "" for i in places) for r in side}) == len(side) for side in sides)

    for i, c in enumerate(columns):
        if single([i]) and all(r[i] is not None for side in sides for r in side):
            return [c]
    return next(([columns[i], columns[j]] for i, j in combinations(range(len(columns)), 2) if single([i, j])), [])


@pytest.mark.parametrize("seed", [0, 3, 4])
def test_strict_key_by_slices_is_that_of_brute_force(spark, small_passes, monkeypatch, seed):
    monkeypatch.setattr(keys, "SLICE_ROWS", 100)
    monkeypatch.setattr(keys, "COMBINATIONS_PER_JOB", 4 if seed % 2 else 16)
    columns, sides = uneven_sides(seed)
    rng, doubles = random.Random(seed), seed in (2, 3)
    # e and f are a key together, but for one double far on; g is one alone, but for a null.
    sides = [[(*r, str(k // 20), str(k % 20), None if k == 33 else f"g{k}") for k, r in enumerate(side)] for side in sides]
    for side in sides[:doubles]:
        side[7] = (*side[7][:4], *side[8][4:6], "g8")
    for side in sides:
        rng.shuffle(side)
    order = columns + ["e", "f", "g"][: 2 if seed < 4 else 3]
    sides = [[r[: len(order)] for r in side] for side in sides]
    frames = [spark.createDataFrame(side, ", ".join(f"{c} string" for c in order)) for side in sides]
    expected = brute_strict(order, sides)
    assert detect_key_strict(*frames) == expected
    assert bool(expected) is not doubles


def test_strict_search_counts_no_slice_that_it_can_do_without(spark, small_passes, monkeypatch):
    monkeypatch.setattr(keys, "SLICE_ROWS", 100)
    columns, sides = uneven_sides(4)
    sides = [[(*r, str(k)) for k, r in enumerate(side)] for side in sides]
    frames = [spark.createDataFrame(side, ", ".join(f"{c} string" for c in [*columns, "k"])) for side in sides]
    whole, tuples, staged = [], keys._tuples, set(tables_of(spark))
    monkeypatch.setattr(keys, "_tuples", lambda values, combos, skip_null=False, passes=1, which=0: (passes <= 4 and whole.append(tuple(combos))) or tuples(values, combos, skip_null, passes, which))
    monkeypatch.setattr(keys, "_counts", None)
    assert detect_key_strict(*frames) == ["k"]
    assert set(whole) >= {((4,),)} and all(len(x) == 1 for x in whole)
    assert set(tables_of(spark)) == staged
