"""Row filter and the text syntaxes of user settings."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twintally.functions.text import col, strip, text


def parse_row_filter(setting: str | None) -> dict[str, str]:
    """``COL=val;COL2=val2`` (or one condition per line); a value may contain '='."""
    conditions = {}
    for part in re.split(r"[;\n]", setting or ""):
        name, equals, value = part.partition("=")
        if equals and name.strip():
            conditions[name.strip()] = value.strip()
    return conditions


def parse_key(setting: str | None) -> list[str]:
    """``A,B`` into column names."""
    return [part.strip() for part in (setting or "").split(",") if part.strip()]


def describe_filter(conditions: Mapping[str, str]) -> str:
    """The filter as shown in reports."""
    return "  AND  ".join(f"{name} = '{value}'" for name, value in conditions.items())


def resolve_column(columns: Sequence[str], name: str) -> str | None:
    """Column by exact name, else by name without regard to case."""
    if name in columns:
        return name
    return next((c for c in columns if c.lower() == name.lower()), None)


def filter_rows(df: DataFrame, conditions: Mapping[str, str]) -> tuple[DataFrame, list[str]]:
    """Keep the rows where every condition holds, both sides trimmed.

    A column the table lacks does not filter; its name comes back as a warning.
    """
    missing = []
    for name, value in conditions.items():
        found = resolve_column(df.columns, name)
        if found is None:
            missing.append(name)
        else:
            df = df.where(strip(text(col(found))) == F.lit(value.strip()))
    return df, missing
