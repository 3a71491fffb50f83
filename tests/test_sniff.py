import random
import statistics

import pytest
from pyspark.sql import functions as F

from twintally.operators import sniff


def lines_of(spark, files):
    rows = [(name, i + 1, line) for name, text in files.items() for i, line in enumerate(text.split("\n"))]
    return spark.createDataFrame(rows, "file string, line_no bigint, value string")


def brute_separator(lines, candidates):
    best, best_score = ";", -1.0
    for sep in candidates:
        counts = [line.count(sep) for line in lines if line.strip()]
        if counts and max(counts):
            spread = statistics.variance(counts) if len(counts) > 1 else 0
            score = statistics.mean(counts) / (1 + spread)
            if score > best_score + 1e-12:
                best, best_score = sep, score
    return best


def test_separators_against_brute_force(spark):
    rng = random.Random(3)
    files = {}
    for i in range(12):
        sep = rng.choice([";", ",", "|", ";|", "\t", ";£"])
        files[f"f{i}"] = "\n".join(
            sep.join(rng.choice(["a", "b,c", "d e", "1.5", "x|y", ""]) + "z" for _ in range(rng.choice([4, 4, 5])))
            for _ in range(rng.choice([1, 5, 40]))
        )
    files["blank"] = "\n \n"
    found = {r["file"]: r["sep"] for r in sniff.detect_separators(lines_of(spark, files)).collect()}
    for name, content in files.items():
        assert found[name] == brute_separator(content.split("\n")[:30], sniff.SEPARATORS), name


def test_compound_separator_must_follow_every_semicolon(spark):
    files = {
        "hash": "A;#B;#C;#\n1;#2;#3;#",
        "minus": "1;-2;x\n3;-4;y",
        "tie": "a;#b;@c\nd;#e;@f",
    }
    rows = {r["file"]: r for r in sniff.compound_separators(lines_of(spark, files)).collect()}
    assert (rows["hash"]["follower"], rows["hash"]["accepted"]) == ("#", True)
    assert not rows["minus"]["accepted"] and not rows["tie"]["accepted"]
    seps = {r["file"]: r["sep"] for r in sniff.detect_separators(lines_of(spark, files)).collect()}
    assert seps["hash"] == ";#" and seps["minus"] == ";"


@pytest.mark.parametrize(
    "line, modern, legacy",
    [
        ("C_FILIALE;N_CONTRATTO;1", True, True),
        ("name;code;kind;1", True, True),
        ("name;code;1;2", False, True),
        ("1;2024-01-31;x y", False, False),
        ("£NUM_C;£COD;£D", True, False),
        ('"A_1";"B"', True, False),
        (";;", True, False),
        ("first name;last name", False, True),
    ],
)
def test_header(spark, line, modern, legacy):
    row = spark.createDataFrame([(line,)], "v string").select(
        sniff.is_header(F.col("v"), ";").alias("modern"), sniff.is_header(F.col("v"), ";", legacy=True).alias("legacy")
    ).first()
    assert (row["modern"], row["legacy"]) == (modern, legacy)


@pytest.mark.parametrize("sep", [";", "|", ";#", "\t", ";£"])
@pytest.mark.parametrize("as_column", [False, True])
def test_fields(spark, sep, as_column):
    lines = {
        "a~b~": ["a", "b", ""],
        "~": ["", ""],
        '"x~y"~z': ["x~y", "z"],
        'a~ "say ""hi""" ~c': ["a", 'say "hi"', "c"],
        '5" pipe~6" pipe': ['5" pipe', '6" pipe'],
        '""~x': ["", "x"],
        '"open~x': ['"open', "x"],
    }
    given = [(line.replace("~", sep), sep) for line in lines]
    df = spark.createDataFrame(given, "v string, sep string")
    found = [r["f"] for r in df.select(sniff.fields(F.col("v"), F.col("sep") if as_column else sep).alias("f")).collect()]
    assert found == [[v.replace("~", sep) for v in expected] for expected in lines.values()]


def test_long_quoted_fields_do_not_exhaust_the_stack(spark):
    df = spark.createDataFrame([('"' + 'x""y;' * 50_000 + '";b',)], "v string")
    found = df.select(sniff.fields(F.col("v"), ";").alias("f")).first()["f"]
    assert found == ['x"y;' * 50_000, "b"]


def test_bad_lines_and_whitespace(spark):
    table = lines_of(spark, {"f": 'A_1;B\n1;2\n4;5;6\n7;8;\n9\n"x;y";2\n a;b \n4;;;6', "g": "1;2\n3;4;5"})
    seps = sniff.detect_separators(table, [";"])
    widths = sniff.expected_widths(table, seps, sniff.detect_headers(table, seps))
    bad = sorted((r["file"], r["line_no"], r["n_fields"]) for r in sniff.bad_lines(table, seps, widths).collect())
    assert bad == [("f", 3, 3), ("f", 8, 4), ("g", 2, 3)]
    spaced = {r["file"]: r["n_spaced"] for r in sniff.whitespace_audit(table, seps).collect()}
    assert spaced == {"f": 2, "g": 0}
