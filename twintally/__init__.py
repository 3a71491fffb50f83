"""Reconciliation of two deliveries of the same data on Spark."""

from twintally.operators.compare import KeyedComparison, PositionalComparison, compare
from twintally.operators.filters import filter_rows, parse_key, parse_row_filter
from twintally.operators.keys import detect_key, detect_key_strict, key_uniqueness
from twintally.operators.pairing import find_families, match_files, match_logical
from twintally.operators.structure import column_structure, infer_types
from twintally.plans.batch import run, run_families
from twintally.plans.report import issue_log, pair_reports, pair_summary, write_reports
from twintally.sources.delimited import Delivery, read_deliveries, read_delimited
from twintally.sources.listing import list_deliveries, list_sources

__all__ = [
    "Delivery",
    "KeyedComparison",
    "PositionalComparison",
    "column_structure",
    "compare",
    "detect_key",
    "detect_key_strict",
    "filter_rows",
    "find_families",
    "infer_types",
    "issue_log",
    "key_uniqueness",
    "list_deliveries",
    "list_sources",
    "match_files",
    "match_logical",
    "pair_reports",
    "pair_summary",
    "parse_key",
    "parse_row_filter",
    "read_deliveries",
    "read_delimited",
    "run",
    "run_families",
    "write_reports",
]
