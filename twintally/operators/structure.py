"""Inferred column types and the structure of two sides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twintally.functions.text import NUMBER, col

# Names of the inferred types and of the column states.
EMPTY, INTEGER, DECIMAL, DATE, TEXT = "VUOTO", "INTERO", "DECIMALE", "DATA", "TESTO"
BOTH, ONLY_A, ONLY_B = "OK", "SOLO AS-IS", "SOLO TO-BE"
YES, NO, NONE = "Si'", "No", "—"
NUMERIC_SHARE = 0.9

# Date formats, day first; one of them has to fit a whole column.
DATE_FORMATS = [
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "y-M-d"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "y/M/d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/y"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-y"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.y"),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{2}:\d{2}:\d{2}$", "y-M-d HH:mm:ss"),
    (r"^\d{4}-\d{1,2}-\d{1,2}T\d{2}:\d{2}:\d{2}$", "y-M-d'T'HH:mm:ss"),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{2}:\d{2}$", "y-M-d HH:mm"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{2}:\d{2}:\d{2}$", "d/M/y HH:mm:ss"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{2}:\d{2}$", "d/M/y HH:mm"),
]
_LONGEST_DATE = 19


def _date_format(v: Column) -> Column:
    """Number of the format the text has the shape of, else null."""
    # Most texts are ruled out without a pattern: every format is short and starts with a digit.
    ruled_out = (F.char_length(v) > _LONGEST_DATE) | ~F.substring(v, 1, 1).between("0", "9")
    shape = F.when(ruled_out, F.lit(None))
    for i, (pattern, _) in enumerate(DATE_FORMATS):
        shape = shape.when(v.rlike(pattern), F.lit(i))
    return shape


def _is_date(v: Column, format_no: Column) -> Column:
    parsed = F.lit(False)
    for i, (_, fmt) in enumerate(DATE_FORMATS):
        parsed = F.when(format_no == i, F.try_to_timestamp(v, F.lit(fmt)).isNotNull()).otherwise(parsed)
    return parsed


def infer_types(df: DataFrame, columns: Sequence[str] | None = None, sample_rows: int | None = None) -> DataFrame:
    """Semantic type per column: ``(position, column, type)``.

    The cells are counted by column in one pass; the shuffle carries a few numbers
    per column and task, whatever the number of rows or columns.
    """
    columns = list(df.columns if columns is None else columns)
    names = _schema_frame(df, columns)
    if not columns:
        return names.withColumn("type", F.lit(EMPTY))
    if sample_rows is not None:
        df = df.limit(sample_rows)
    values = F.array(
        *[F.struct(F.lit(i + 1).alias("position"), col(c).cast("string").alias("v")) for i, c in enumerate(columns)]
    )
    v = F.col("v")
    counted = (
        df.select(F.inline(values))
        .where(v.isNotNull())
        .withColumn("format_no", _date_format(v))
        .groupBy("position")
        .agg(
            F.count("*").alias("n"),
            F.count_if(F.trim(v) == "").alias("n_blank"),
            F.count_if(v.rlike(NUMBER)).alias("n_number"),
            F.count_if(F.contains(v, F.lit("."))).alias("n_point"),
            F.count_if(_is_date(v, F.col("format_no"))).alias("n_date"),
            (F.min("format_no") == F.max("format_no")).alias("one_format"),
        )
    )
    inferred = (
        F.when(F.col("n").isNull() | (F.col("n") == F.col("n_blank")), EMPTY)
        .when(F.col("n_number") / F.col("n") > NUMERIC_SHARE, F.when(F.col("n_point") > 0, DECIMAL).otherwise(INTEGER))
        .when(F.col("one_format") & (F.col("n_date") + F.col("n_blank") == F.col("n")), DATE)
        .otherwise(TEXT)
    )
    return names.join(counted, "position", "left").select(
        "position", "column", inferred.alias("type")
    )


def column_structure(a: DataFrame, b: DataFrame, sample_rows: int | None = None) -> DataFrame:
    """Presence, position and type of every column, in the order of a, then of b."""
    types = [
        infer_types(df, sample_rows=sample_rows).select(
            "column", F.col("position").alias(f"pos_{s}"), F.col("type").alias(f"type_{s}")
        )
        for df, s in ((a, "a"), (b, "b"))
    ]
    in_a, in_b = F.col("pos_a").isNotNull(), F.col("pos_b").isNotNull()
    consistent = F.when(in_a & in_b, F.when(F.col("type_a") == F.col("type_b"), YES).otherwise(NO)).otherwise(NONE)
    return (
        types[0]
        .join(types[1], "column", "full_outer")
        .select(
            "column",
            F.when(in_a, YES).otherwise(NO).alias("in_a"),
            F.when(in_b, YES).otherwise(NO).alias("in_b"),
            "pos_a",
            "pos_b",
            F.coalesce("type_a", F.lit(NONE)).alias("type_a"),
            F.coalesce("type_b", F.lit(NONE)).alias("type_b"),
            consistent.alias("type_consistent"),
            F.when(in_a & in_b, BOTH).when(in_a, ONLY_A).otherwise(ONLY_B).alias("status"),
        )
        .orderBy(F.col("pos_a").asc_nulls_last(), "pos_b")
    )


def _schema_frame(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.sparkSession.createDataFrame(
        [(i + 1, c) for i, c in enumerate(columns)], "position int, column string"
    )
