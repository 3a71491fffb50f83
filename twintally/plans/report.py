"""Reports on one pair and on many: every report is a DataFrame."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twintally.functions.text import col, listed, listed_column
from twintally.operators.compare import (
    STATUS_DIFF,
    STATUS_OK,
    Comparison,
    KeyedComparison,
    PositionalComparison,
    column_sets,
)
from twintally.operators.filters import describe_filter
from twintally.operators.positions import POSITION
from twintally.operators.structure import BOTH, NO, ONLY_A, ONLY_B, column_structure
from twintally.sources.staging import stage

# Fixed values of the reports.
ANOMALY, ERROR = "ANOMALIE", "ERRORE"
SEP_DIFFERS, SEP_SAME = "SI'", "No"
SIDE_A, SIDE_B = "AS-IS", "TO-BE"
MISSING_FILE = "— MANCANTE —"
POSITIONAL = "(confronto posizionale)"

RECORD_SCHEMA = """
    label string, name_a string, name_b string, sep_a string, sep_b string, sep_ok boolean,
    rows_a bigint, rows_b bigint, cols_only_a array<string>, cols_only_b array<string>,
    type_mismatches array<struct<column:string,type_a:string,type_b:string>>,
    n_diff_rows bigint, n_only_a bigint, n_only_b bigint, n_spaced_a bigint, n_spaced_b bigint,
    n_rejected_a bigint, n_rejected_b bigint, error string
"""


def _data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != POSITION]


# -- one pair --------------------------------------------------------------


def pair_summary(
    comparison: Comparison,
    label: str,
    name_a: str,
    name_b: str,
    row_filter: Mapping[str, str] | None = None,
    unfiltered: Sequence[str] = (),
    counts: DataFrame | None = None,
) -> DataFrame:
    """One row with all counters and the outcome of a pair.

    OK means: same columns, same number of rows, every row paired, no difference.
    ``unfiltered`` names filter columns that a side lacks, so that it was not filtered.
    """
    p = comparison.profile
    counts = comparison.counts() if counts is None else counts
    only_a, only_b, _ = column_sets(_data_columns(comparison.a), _data_columns(comparison.b))
    differing = F.array_compact(F.array(*[F.when(col(f"diff__{c}") > 0, F.lit(c)) for c in comparison.values]))
    if not comparison.values:
        differing = F.array().cast("array<string>")
    paired = not (only_a or only_b or p.only_a or p.only_b) and p.rows_a == p.rows_b
    keyed = not isinstance(comparison, PositionalComparison)

    def number(n: int):
        return F.lit(n).cast("bigint")

    return counts.select(
        F.lit(label).alias("label"),
        F.lit(name_a).alias("name_a"),
        F.lit(name_b).alias("name_b"),
        number(p.rows_a).alias("rows_a"),
        number(p.rows_b).alias("rows_b"),
        number(p.rows_a - p.rows_b).alias("delta_rows"),
        F.lit(listed(only_a)).alias("cols_only_a"),
        F.lit(listed(only_b)).alias("cols_only_b"),
        listed_column(differing).alias("cols_with_diff"),
        F.col("n_diff").alias("rows_with_diff"),
        F.when(F.lit(paired) & (F.col("n_diff") == 0), STATUS_OK).otherwise(STATUS_DIFF).alias("outcome"),
        F.lit(", ".join(comparison.key) if keyed else POSITIONAL).alias("key_used"),
        number(p.matched).alias("matched_rows"),
        number(p.only_a).alias("rows_only_a"),
        number(p.only_b).alias("rows_only_b"),
        number(p.dup_keys_a).alias("dup_keys_a"),
        number(p.dup_keys_b).alias("dup_keys_b"),
        number(p.heavy_keys).alias("heavy_keys"),
        F.lit(describe_filter(row_filter or {})).alias("row_filter"),
        F.lit(", ".join(unfiltered)).alias("unfiltered"),
        F.lit(keyed and p.matched == 0 and p.rows_a > 0 and p.rows_b > 0).alias("no_match_warning"),
    )


def pair_reports(comparison: Comparison, label: str, name_a: str, name_b: str, **options) -> dict[str, DataFrame]:
    """All reports on one pair. The differing pairs, their counts and the structure
    are written once and shared."""
    counts = stage(comparison.materialize().counts(), "counts")
    reports = {
        "pair_summary": stage(pair_summary(comparison, label, name_a, name_b, counts=counts, **options), "summary"),
        "column_structure": stage(_structure(comparison), "structure"),
        "column_summary": comparison.column_summary(counts),
        "diff_rows": comparison.diff_rows(),
        "diff_cells": comparison.diff_cells(),
        "only_a": comparison.only_a(),
        "only_b": comparison.only_b(),
    }
    if isinstance(comparison, KeyedComparison) and comparison.profile.heavy_keys:
        reports["diff_groups"] = comparison.diff_groups()
    return {name: df for name, df in reports.items() if df.columns}


def _structure(comparison: Comparison) -> DataFrame:
    sides = [side.select(*map(col, _data_columns(side))) for side in (comparison.a, comparison.b)]
    return column_structure(*sides)


def issue_record(
    comparison: Comparison,
    label: str,
    name_a: str,
    name_b: str,
    seps: tuple[str, str],
    spaced: tuple[int, int] = (0, 0),
    rejected: tuple[int, int] = (0, 0),
    counts: DataFrame | None = None,
    structure: DataFrame | None = None,
) -> DataFrame:
    """One row with everything that may be wrong with a pair."""
    p = comparison.profile
    counts = comparison.counts() if counts is None else counts
    structure = _structure(comparison) if structure is None else structure
    only_a, only_b, _ = column_sets(_data_columns(comparison.a), _data_columns(comparison.b))
    # One entry per column at most, so the list stays as small as the schema.
    mismatch = F.when(
        (F.col("status") == BOTH) & (F.col("type_consistent") == NO),
        F.struct("pos_a", "column", "type_a", "type_b"),
    )
    listed_types = F.transform(
        F.array_sort(F.collect_list(mismatch)),
        lambda m: F.struct(m["column"].alias("column"), m["type_a"].alias("type_a"), m["type_b"].alias("type_b")),
    )
    types = structure.agg(listed_types.alias("type_mismatches")).withColumn("label", F.lit(label))

    def names(columns: list[str]):
        return F.array(*map(F.lit, columns)).cast("array<string>")

    def number(n: int):
        return F.lit(n).cast("bigint")

    row = counts.select(F.lit(label).alias("label"), "n_diff").join(types, "label")
    return row.select(
        "label",
        F.lit(name_a).alias("name_a"),
        F.lit(name_b).alias("name_b"),
        F.lit(seps[0]).alias("sep_a"),
        F.lit(seps[1]).alias("sep_b"),
        F.lit(seps[0] == seps[1]).alias("sep_ok"),
        number(p.rows_a).alias("rows_a"),
        number(p.rows_b).alias("rows_b"),
        names(only_a).alias("cols_only_a"),
        names(only_b).alias("cols_only_b"),
        "type_mismatches",
        F.col("n_diff").alias("n_diff_rows"),
        number(p.only_a).alias("n_only_a"),
        number(p.only_b).alias("n_only_b"),
        number(spaced[0]).alias("n_spaced_a"),
        number(spaced[1]).alias("n_spaced_b"),
        number(rejected[0]).alias("n_rejected_a"),
        number(rejected[1]).alias("n_rejected_b"),
        F.lit(None).cast("string").alias("error"),
    )


def failed_record(spark: SparkSession, label: str, name_a: str | None, name_b: str | None, error: str) -> DataFrame:
    """The record of a pair that could not be compared."""
    given = {"label": label, "name_a": name_a, "name_b": name_b, "error": error}
    return spark.createDataFrame([given], RECORD_SCHEMA)


def union_records(records: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, records)


# -- many pairs ------------------------------------------------------------


def _has_issue():
    return (
        ~F.col("sep_ok")
        | (F.size("cols_only_a") + F.size("cols_only_b") > 0)
        | (F.col("n_diff_rows") > 0)
        | (F.col("n_only_a") > 0)
        | (F.col("n_only_b") > 0)
    )


def issue_summary(records: DataFrame) -> DataFrame:
    failed = F.col("error").isNotNull()
    outcome = F.when(failed, F.concat(F.lit(ERROR + ": "), "error")).when(_has_issue(), ANOMALY).otherwise(STATUS_OK)
    return records.select(
        "label",
        "name_a",
        "name_b",
        "sep_a",
        "sep_b",
        F.when(~failed, F.when(F.col("sep_ok"), SEP_SAME).otherwise(SEP_DIFFERS)).alias("sep_differs"),
        "rows_a",
        "rows_b",
        (F.col("rows_a") - F.col("rows_b")).alias("delta_rows"),
        F.when(~failed, (F.size("cols_only_a") + F.size("cols_only_b")).cast("bigint")).alias("n_missing_columns"),
        "n_diff_rows",
        "n_only_a",
        "n_only_b",
        outcome.alias("outcome"),
    )


def issue_totals(records: DataFrame) -> DataFrame:
    return records.agg(
        F.count("*").alias("n_pairs"),
        F.count_if(F.col("error").isNull() & _has_issue()).alias("n_with_issues"),
    )


def issue_separators(records: DataFrame) -> DataFrame:
    return records.where("error is null and not sep_ok").select("label", "name_a", "name_b", "sep_a", "sep_b")


def issue_structure(records: DataFrame) -> DataFrame:
    sides = [
        records.where("error is null").select("label", F.explode(columns).alias("column"), F.lit(kind).alias("issue"))
        for columns, kind in (("cols_only_a", ONLY_A), ("cols_only_b", ONLY_B))
    ]
    return sides[0].unionByName(sides[1])


def issue_types(records: DataFrame) -> DataFrame:
    return records.where("error is null").select("label", F.inline("type_mismatches"))


def issue_spaces(records: DataFrame) -> DataFrame:
    sides = [
        records.where("error is null").select(
            "label", F.lit(side).alias("side"), F.col(f"name_{s}").alias("name"), F.col(f"n_spaced_{s}").alias("n_spaced")
        )
        for side, s in ((SIDE_A, "a"), (SIDE_B, "b"))
    ]
    return sides[0].unionByName(sides[1]).where("n_spaced > 0")


def issue_lines(rejected: DataFrame, label: str, side: str, name: str) -> DataFrame:
    """Lines left out of one file, whole."""
    return rejected.select(
        F.lit(label).alias("label"),
        F.lit(side).alias("side"),
        F.lit(name).alias("name"),
        "line_no",
        "line",
    )


def issue_log(records: DataFrame) -> dict[str, DataFrame]:
    return {
        "issue_records": records,
        "issue_summary": issue_summary(records),
        "issue_totals": issue_totals(records),
        "issue_separators": issue_separators(records),
        "issue_structure": issue_structure(records),
        "issue_types": issue_types(records),
        "issue_spaces": issue_spaces(records),
    }


# -- sinks -----------------------------------------------------------------


def partition_folder(name: str, value: str) -> str:
    """The folder of a partition, as Spark reads it back: all but plain characters are escaped as %XX."""
    return f"{name}=" + "".join(f"%{ord(c):02X}" if ord(c) < 128 and not (c.isalnum() or c in "._-") else c for c in value)


def write_reports(reports: Mapping[str, DataFrame], out: str, label: str | None = None, format: str = "parquet") -> None:
    """One folder per report, one partition folder per label below it.

    Writing a label again replaces its own partition and no other, also when the report has become empty;
    labels may have any characters, and several may be written at the same time. CSV has no nested columns, so
    lists are written as JSON text there.
    """
    for name, df in reports.items():
        path = f"{out.rstrip('/')}/{name}" + (f"/{partition_folder('label', label)}" if label else "")
        own = (_flat(df) if format == "csv" else df).drop(*(["label"] if label else []))
        own.write.mode("overwrite").format(format).options(**({"header": "true"} if format == "csv" else {})).save(path)


def _flat(df: DataFrame) -> DataFrame:
    nested = {f.name for f in df.schema if f.dataType.typeName() in ("array", "struct", "map")}
    return df.select(*[F.to_json(col(c)).alias(c) if c in nested else col(c) for c in df.columns])
