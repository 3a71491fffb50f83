import re

import pytest
from pyspark.sql import functions as F

from twintally.functions import names, text
from twintally.operators.columns import dedup_columns, is_artifact, prefix_chars
from twintally.operators.filters import describe_filter, filter_rows, parse_key, parse_row_filter

UNTIDY = [
    "plain", "", "  both  ", "in  ner", "a\tb", " edge ", "mid dle", "   ", "a   b",
    "\x1cctl\x1f", " wide ", "città  è ", "line\nbreak", "\n edge \r\n", "a" + " " * 500 + "b", "\u0085x\u0085",
]


def cleaned(value):
    value = value.strip().replace(" ", " ")
    return re.sub("[ \t]+", " ", value).strip()


def evaluate(spark, values, expression, schema="v string"):
    df = spark.createDataFrame([(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)], "i int, " + schema)
    return [r["x"] for r in df.select("i", expression.alias("x")).orderBy("i").collect()]


def test_clean(spark):
    assert evaluate(spark, UNTIDY + [None], text.clean(F.col("v"))) == [cleaned(v) for v in UNTIDY] + [""]


def test_num_diff(spark):
    pairs = [("1,5", "1"), ("2", "2.50"), ("x", "1"), ("", "1"), ("1.5d", "1"), ("nan", "1"), ("1e3", "-.5"), ("1,234,5", "1")]
    assert evaluate(spark, pairs, text.num_diff(F.col("a"), F.col("b")), "a string, b string") == [
        0.5, -0.5, None, None, None, None, 1000.5, None,
    ]


def test_occurrences_and_percent(spark):
    assert evaluate(spark, ["a;;b;", ";;;"], text.occurrences(F.col("v"), F.lit(";;"))) == [1, 1]
    shares = [(1, 8), (0, 4), (0, 0), (1, 3)]
    assert evaluate(spark, shares, text.percent_text(F.col("a"), F.col("b")), "a bigint, b bigint") == ["12.5%", "0.0%", "0%", "33.3%"]


def test_listed():
    assert text.listed([]) == "—"
    assert text.listed(["a", "b"]) == "a, b"
    assert text.listed(["a", "b", "c"], 2) == "a, b…"


@pytest.mark.parametrize(
    "name, key",
    [
        ("DW.D.PLZHA.AVTBCODI.20260326000000.000L.20260326030157.csv", "AVTBCODI"),
        ("DW.D.PLZ3A.ABBINAMENTO_PLZ_DANNI.20260326000000.000L.csv", "ABBINAMENTO_PLZ_DANNI"),
        ("DW.D.PLZAA.ABK001FW_DANNI.csv", "ABK001FW_DANNI"),
        ("DW.D.PLZBA.STORNI_DANNI.csv", "STORNI_DANNI"),
        ("orders-old.20260326000000.csv", "ORDERS_OLD"),
        ("20260326000000.csv", "20260326000000"),
        ("folder/sub.csv", "SUB"),
    ],
)
def test_stem_key(spark, name, key):
    assert evaluate(spark, [name], names.stem_key(F.col("v"))) == [key]


def test_logical_and_family_names(spark):
    stamped = "DW.D.PLZHA.T.20260326000000.000L.csv"
    assert evaluate(spark, [stamped, "plain.csv"], names.logical_name(F.col("v"))) == ["DW.D.PLZHA.T", "plain"]
    assert evaluate(spark, ["DW.D.T", "plain"], names.short_name(F.col("v"))) == ["T", "plain"]
    folders = ["DW.M.PLZ3A.ALL.20260326000000.20260326000000", "DW.M.PLZ3A.ALL.zip", "DW.M.PLZ3A.ALL"]
    assert evaluate(spark, folders, names.family_prefix(F.col("v"))) == ["DW.M.PLZ3A.ALL"] * 3


def test_column_names():
    assert dedup_columns(["X", "X", "Y", "X", "x"]) == ["X", "X_1", "Y", "X_2", "x_3"]
    assert dedup_columns(["X", "X", "X_1"]) == ["X", "X_2", "X_1"]
    assert dedup_columns(["X", "X_1", "X", "X_1"]) == ["X", "X_1", "X_2", "X_1_1"]
    kept = ["#ID", "_COL", "£A", "è"]
    assert [n for n in ["", " ", "#", "£", "|", ";#", "Unnamed: 3", *kept] if not is_artifact(n)] == kept


def test_prefix_chars():
    assert prefix_chars(["£NUM", "COD"], {}, 0, ";£") == ";£"
    assert prefix_chars(["£NUM", "£COD", "D"], {}, 0, ";") == ";£"
    assert prefix_chars(["£NUM", "B", "C", "D", "E"], {}, 0, ";") == ";"
    assert prefix_chars(["NUM", "COD"], {"#": 2}, 3, ";") == "#;"
    assert prefix_chars(["NUM", "COD"], {"#": 1}, 3, ";") == ";"


def test_settings(spark):
    assert parse_row_filter("A=1; B = x=y\nC=z;;nonsense") == {"A": "1", "B": "x=y", "C": "z"}
    assert parse_row_filter(None) == {}
    assert parse_key(" A, B ,") == ["A", "B"]
    assert describe_filter({"A": "1", "B": "2"}) == "A = '1'  AND  B = '2'"
    df = spark.createDataFrame([("1 ", "a"), ("2", "b")], "Code string, v string")
    kept, missing = filter_rows(df, {"code": " 1", "other": "x"})
    assert [r["v"] for r in kept.collect()] == ["a"] and missing == ["other"]
