"""String expressions shared by every operator.

All of them are built-in column expressions, so they stay inside whole-stage
code generation and never leave the JVM.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as whitespace at the edge of a value, what a plain
# decimal number looks like, and the prefix characters known from deliveries.
ASCII_SPACE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"
SPACE_CLASS = r"[\s\p{Z}\x{0085}\x1c-\x1f]"
NBSP = "\u00a0"
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
VALUE_PREFIXES = "£#;|,@~"

_LEADING = f"^{SPACE_CLASS}+"
# The look-behind lets a match start only where a run of spaces starts, which
# keeps the search linear on long inner runs.
_TRAILING = f"(?<!{SPACE_CLASS}){SPACE_CLASS}+$"
_EDGES = f"{_LEADING}|{_TRAILING}"


def col(name: str) -> Column:
    """Column by its exact name, whatever characters the name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def text(c: Column) -> Column:
    """Value as a string, null as the empty string."""
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    """Drop Unicode whitespace at both ends."""
    return F.regexp_replace(c, _EDGES, "")


def clean(c: Column) -> Column:
    """Normalise a value: edges stripped, no-break spaces and runs of blanks
    turned into one space, null into ''.

    Most values of a delivery are already tidy. Those are recognised with byte
    comparisons and returned as they are; only the others pay for the regexes.
    """
    c = text(c)
    tidy = (
        (F.octet_length(c) == F.char_length(c))
        & (F.btrim(c, F.lit(ASCII_SPACE)) == c)
        & ~F.contains(c, F.lit("  "))
        & ~F.contains(c, F.lit("\t"))
    )
    spaced = F.translate(strip(c), NBSP, " ")
    return F.when(tidy, c).otherwise(strip(F.regexp_replace(spaced, "[ \t]+", " ")))


def lstrip_chars(c: Column, chars: str) -> Column:
    """Drop leading characters that belong to the set ``chars``."""
    return F.ltrim(c, F.lit(chars)) if chars else c


def as_number(c: Column) -> Column:
    """Value as double when it is a plain number (decimal comma allowed), else null."""
    dotted = F.replace(text(c), F.lit(","), F.lit("."))
    return F.when(dotted.rlike(NUMBER), dotted.try_cast("double"))


def num_diff(a: Column, b: Column) -> Column:
    """Numeric difference a - b, null when one of them is not a number."""
    return as_number(a) - as_number(b)


def occurrences(c: Column, part: Column) -> Column:
    """How often ``part`` occurs in ``c`` without overlap."""
    removed = F.char_length(c) - F.char_length(F.replace(c, part, F.lit("")))
    return (removed / F.char_length(part)).cast("int")


def percent_text(part: Column, total: Column) -> Column:
    """Share of the total with one decimal, '0%' when there is no total."""
    share = F.bround(part / total * 100, 1)
    return F.when(total > 0, F.format_string("%.1f%%", share)).otherwise(F.lit("0%"))


def listed(items: Iterable[str], limit: int | None = None) -> str:
    """Names joined by comma, '—' when there is none, '…' when cut for display."""
    items = list(items)
    shown = items if limit is None else items[:limit]
    return (", ".join(shown) + ("…" if len(shown) < len(items) else "")) or "—"


def listed_column(names: Column) -> Column:
    """The same for an array column."""
    return F.coalesce(F.nullif(F.array_join(names, ", "), F.lit("")), F.lit("—"))
