"""Decisions about delimited files, taken for many files in one job.

Input is a lines table ``(file, line_no, value)``. Every operator groups by file
with partial aggregation, so one huge file spreads over all tasks. Decisions have
one row per file and are staged: they are taken once, and since Spark knows the
size of a written table it can join them to the lines without moving the lines.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twintally.functions.text import ASCII_SPACE, NBSP, VALUE_PREFIXES, occurrences, strip
from twintally.sources.staging import stage

# Separators in order of priority, and what decides between them.
SEPARATORS = [";|", ";£", "£|", "|;", "\t", ";", ",", "|", "£"]
DEFAULT_SEPARATOR = ";"
COMPOUND_SHARE = 0.5
# What a column name looks like and how many names make a header.
COLUMN_NAME = r"^[A-Za-z_][A-Za-z0-9_]*$"
LEGACY_COLUMN_NAME = r"^[A-Za-z_][A-Za-z0-9_\s]*$"
HEADER_SHARE = 0.75
HEADER_SHARE_UNDERSCORE = 0.50

_AFTER_SEMICOLON = ";([^\\p{L}\\p{N}; \n\r\"'])"


def is_blank(value: Column) -> Column:
    return F.btrim(value, F.lit(ASCII_SPACE + NBSP)) == ""


def _sniffed(lines: DataFrame, sample_lines: int | None) -> DataFrame:
    """Non-blank lines among the first ones of each file; all when no number is given."""
    if sample_lines is not None:
        lines = lines.where(F.col("line_no") <= sample_lines)
    return lines.where(~is_blank(F.col("value")))


# -- separator -------------------------------------------------------------


def compound_separators(lines: DataFrame, sample_lines: int | None = None) -> DataFrame:
    """Per file the special character that follows ';' most often.

    ``accepted`` says whether ';' plus that character is a separator: it follows
    every ';' and occurs in enough lines.
    """
    sniffed = _sniffed(lines, sample_lines)
    totals = sniffed.groupBy("file").agg(
        F.count("*").alias("n_lines"),
        F.sum(occurrences(F.col("value"), F.lit(";"))).alias("n_semicolon"),
    )
    followers = sniffed.select("file", F.explode(F.regexp_extract_all("value", F.lit(_AFTER_SEMICOLON), F.lit(1))).alias("x"))
    counted = followers.groupBy("file", "x").agg(F.count("*").alias("n_follow"))
    most = counted.groupBy("file").agg(F.max(F.struct("n_follow", "x")).alias("top"))
    enough = F.greatest(F.lit(1.0), F.col("n_lines") * COMPOUND_SHARE)
    return most.join(totals, "file").select(
        "file",
        F.col("top.x").alias("follower"),
        F.col("top.n_follow").alias("n_follow"),
        "n_semicolon",
        "n_lines",
        ((F.col("top.n_follow") >= enough) & (F.col("top.n_follow") >= F.col("n_semicolon"))).alias("accepted"),
    )


def separator_scores(
    lines: DataFrame, candidates: Sequence[str] | None = None, sample_lines: int | None = None
) -> DataFrame:
    """Mean occurrences per line over (1 + sample variance), per file and candidate
    that occurs at all. ``priority`` 0 is a compound found in the file itself.

    All sums are of whole numbers, so equal counts give equal scores in any order."""
    sniffed = _sniffed(lines, sample_lines)
    listed = F.array(
        *[
            F.struct(F.lit(i + 1).alias("priority"), F.lit(sep).alias("sep"))
            for i, sep in enumerate(candidates or SEPARATORS)
        ]
    )
    if candidates is None:
        found = compound_separators(lines, sample_lines).where("accepted").select(
            "file", F.concat(F.lit(";"), "follower").alias("sep")
        )
        found = found.where(~F.col("sep").isin(SEPARATORS)).select(
            "file", F.array(F.struct(F.lit(0).alias("priority"), "sep")).alias("found")
        )
        sniffed = sniffed.join(stage(found, "compound"), "file", "left")
        listed = F.concat(F.coalesce("found", F.expr("array()")), listed)
    counts = F.transform(
        listed,
        lambda c: F.struct(c.priority.alias("priority"), c.sep.alias("sep"), occurrences(F.col("value"), c.sep).alias("n")),
    )
    return (
        sniffed.select("file", F.inline(counts))
        .groupBy("file", "priority", "sep")
        .agg(F.count("*").alias("lines"), F.sum("n").alias("s"), F.sum(F.col("n").cast("bigint") * F.col("n")).alias("q"))
        .where("s > 0")
        .select("file", "priority", "sep", _score(*(F.col(c).cast("decimal(19,0)") for c in ("lines", "s", "q"))).alias("score"))
    )


def _score(n: Column, s: Column, q: Column) -> Column:
    """s/n over 1 + (n q - s s) / (n (n - 1)), with one division; n lines, sum s, sum of squares q."""
    several = (s * (n - 1)).cast("double") / (n * (n - 1) + n * q - s * s).cast("double")
    return F.when(n > 1, several).otherwise(s.cast("double"))


def detect_separators(
    lines: DataFrame, candidates: Sequence[str] | None = None, sample_lines: int | None = None
) -> DataFrame:
    """``(file, sep)``: best score, earlier candidate on a tie, ';' when none occurs."""
    best = separator_scores(lines, candidates, sample_lines).groupBy("file").agg(
        F.max(F.struct("score", -F.col("priority"), "sep")).alias("best")
    )
    files = lines.select("file").distinct()
    chosen = files.join(best, "file", "left").select(
        "file", F.coalesce("best.sep", F.lit(DEFAULT_SEPARATOR)).alias("sep")
    )
    return stage(chosen, "separators")


# -- fields ----------------------------------------------------------------


def quoted_separator(sep: str | Column) -> Column:
    """The separator as a regular expression."""
    if isinstance(sep, str):
        return F.lit(re.sub(r"([^A-Za-z0-9_\s£])", r"\\\1", sep))
    return F.concat(F.lit("\\Q"), sep, F.lit("\\E"))


def fields(line: Column, sep: str | Column, quote: str | None = '"') -> Column:
    """Fields of a line. A field in quotes may contain the separator and doubled quotes.

    Lines without a quote, the common case, take a plain split.
    """
    regex = quoted_separator(sep)
    plain = F.split(line, regex, -1)
    if not quote:
        return plain
    sep_text = F.lit(sep) if isinstance(sep, str) else sep
    q = re.escape(quote)
    inside = f"[^{q}]*+(?:{q}{q}[^{q}]*+)*+"
    pattern = F.concat(
        F.lit("(?s)"), regex, F.lit(f"(?: *{q}{inside}{q}(?= *(?:"), regex, F.lit(r"|\z))|.*?(?="), regex, F.lit(r"|\z))")
    )

    def value(found: Column) -> Column:
        bare = F.ltrim(F.substring(found, F.char_length(sep_text) + 1, F.char_length(found)))
        unquoted = F.replace(F.substring(bare, F.lit(2), F.char_length(bare) - 2), F.lit(quote * 2), F.lit(quote))
        whole = F.startswith(bare, F.lit(quote)) & F.endswith(bare, F.lit(quote)) & (F.char_length(bare) > 1)
        return F.when(whole, unquoted).otherwise(bare)

    found = F.regexp_extract_all(F.concat(sep_text, line), pattern, F.lit(0))
    return F.when(F.contains(line, F.lit(quote)), F.transform(found, value)).otherwise(plain)


# -- header ----------------------------------------------------------------


def is_header(line: Column, sep: str | Column, legacy: bool = False) -> Column:
    """Whether a line holds column names rather than data."""
    parts = F.split(line, quoted_separator(sep), -1)
    if legacy:
        named = F.filter(F.transform(parts, F.trim), lambda v: v != "")
        like = F.size(F.filter(named, lambda v: v.rlike(LEGACY_COLUMN_NAME)))
        return (F.size(named) > 0) & (like >= F.greatest(F.lit(1.0), F.size(named) * 0.5))
    bare = F.transform(parts, lambda v: F.btrim(F.btrim(strip(v), F.lit('"')), F.lit("'")))
    named = F.filter(bare, lambda v: v != "")
    like = F.filter(F.transform(named, lambda v: F.ltrim(v, F.lit(VALUE_PREFIXES))), lambda v: v.rlike(COLUMN_NAME))
    share = F.size(like) / F.size(named)
    underscore = F.exists(like, lambda v: F.contains(v, F.lit("_")))
    return (
        F.when(F.size(named) == 0, True)
        .when((share >= HEADER_SHARE_UNDERSCORE) & underscore, True)
        .otherwise(share >= HEADER_SHARE)
    )


def first_lines(lines: DataFrame) -> DataFrame:
    """First non-blank line per file."""
    # A minimum of numbers, then a lookup: cheaper than carrying texts through an aggregate.
    numbers = lines.where(~is_blank(F.col("value"))).groupBy("file").agg(F.min("line_no").alias("line_no"))
    return lines.join(stage(numbers, "first-lines"), ["file", "line_no"])


def detect_headers(lines: DataFrame, separators: DataFrame, legacy: bool = False) -> DataFrame:
    """``(file, has_header)``; a file without content counts as having one, in the legacy rule not."""
    sep = F.lit(";") if legacy else F.col("sep")
    tested = first_lines(lines).join(separators, "file").select(
        "file", is_header(F.col("value"), sep, legacy).alias("has_header")
    )
    decided = separators.select("file").join(tested, "file", "left").select(
        "file", F.coalesce("has_header", F.lit(not legacy)).alias("has_header")
    )
    return stage(decided, "headers")


# -- line checks -----------------------------------------------------------


def expected_widths(lines: DataFrame, separators: DataFrame, headers: DataFrame, quote: str | None = '"') -> DataFrame:
    """Fields a line may have: those of the first line, or of the first data line if more."""
    first = stage(first_lines(lines), "first-lines")
    after = lines.join(first.select("file", F.col("line_no").alias("_first")), "file").where(
        F.col("line_no") > F.col("_first")
    )
    second = first_lines(after.drop("_first"))
    width = F.size(fields(F.col("value"), F.col("sep"), quote))
    sep_header = separators.join(headers, "file")
    firsts = first.join(sep_header, "file").select("file", width.alias("_w1"), "has_header")
    seconds = second.join(separators, "file").select("file", width.alias("_w2"))
    widths = firsts.join(seconds, "file", "left").select(
        "file", F.when(F.col("has_header"), F.greatest("_w1", "_w2")).otherwise(F.col("_w1")).alias("expected")
    )
    return stage(widths, "widths")


def too_long(parts: Column, expected: Column | int) -> Column:
    """More fields than expected, not counting blank ones at the end."""
    limit = F.lit(expected) if isinstance(expected, int) else expected
    beyond = F.slice(parts, limit + 1, F.greatest(F.size(parts) - limit, F.lit(0)))
    return (F.size(parts) > limit) & F.exists(beyond, lambda v: ~is_blank(v))


def bad_lines(lines: DataFrame, separators: DataFrame, widths: DataFrame, quote: str | None = '"') -> DataFrame:
    """Lines with too many fields: ``(file, line_no, n_fields, value)``."""
    parts = F.col("_parts")
    return (
        lines.join(separators.join(widths, "file"), "file")
        .withColumn("_parts", fields(F.col("value"), F.col("sep"), quote))
        .where(too_long(parts, F.col("expected")))
        .select("file", "line_no", F.size(parts).alias("n_fields"), "value")
    )


def spaced_fields(line: Column, sep: str | Column) -> Column:
    """Number of fields with whitespace at an edge or a no-break space."""
    bare = F.transform(
        F.split(line, quoted_separator(sep), -1), lambda v: F.btrim(F.btrim(v, F.lit('"')), F.lit("'"))
    )
    spaced = F.size(F.filter(bare, lambda v: (v != strip(v)) | F.contains(v, F.lit(NBSP))))
    # A plain ASCII line without any whitespace needs no look at its fields.
    compact = (F.octet_length(line) == F.char_length(line)) & ~line.rlike(f"[{re.escape(ASCII_SPACE)}]")
    return F.when(compact, 0).otherwise(spaced)


def whitespace_audit(lines: DataFrame, separators: DataFrame, n_lines: int | None = None) -> DataFrame:
    """``(file, n_spaced)`` over the data lines, the first line of a file left out."""
    data = lines.where(F.col("line_no") > 1)
    if n_lines is not None:
        data = data.where(F.col("line_no") <= n_lines + 1)
    return (
        data.join(separators, "file")
        .select("file", spaced_fields(F.col("value"), F.col("sep")).alias("n"))
        .groupBy("file")
        .agg(F.sum("n").alias("n_spaced"))
    )
