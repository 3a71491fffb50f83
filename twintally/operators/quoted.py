"""Records with line breaks inside quotes, found without reading a file in one piece.

Input is a lines table ``(delivery, _file, _block, _at, value, sep)``: a block is a split of a file as it was scanned, ``_at``
grows within it. A line that begins outside quotes may end inside them, and the other way round, so a line is a function on
two states. Functions of a block are composed by running aggregates over its lines; one row per block carries the
state over the blocks of a file. Only lines of blocks and files with an open quote are touched, and only the lines of
records that span lines are grouped.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twintally.operators.sniff import quoted_separator
from twintally.sources.staging import stage

FILE = ["delivery", "_file"]
BLOCK = [*FILE, "_block"]


def _inside(quote: str) -> str:
    """What may stand between two quotes: all but a quote, or doubled quotes."""
    q = re.escape(quote)
    return f"[^{q}]*+(?:{q}{q}[^{q}]*+)*+"


def opens(line: Column, sep: str | Column, quote: str = '"') -> Column:
    """Whether a line that begins outside quotes ends inside: its last quoted field isn't closed."""
    q, begin = re.escape(quote), (F.lit(r"(?s)(?:\A|"), quoted_separator(sep), F.lit(") *"))
    closed = F.concat(*begin, F.lit(q + _inside(quote) + q))
    bare = F.regexp_replace(line, closed, F.lit("x"))
    return F.contains(line, F.lit(quote)) & F.regexp_like(bare, F.concat(*begin, F.lit(q + _inside(quote) + r"\z")))


def stays_inside(line: Column, sep: str | Column, quote: str = '"') -> Column:
    """Whether a line that begins inside quotes ends inside: nothing closes them, or a later field opens new ones."""
    q = re.escape(quote)
    rest = F.regexp_replace(line, rf"(?s)\A{_inside(quote)}{q}", "x")
    return F.when(line.rlike(rf"(?s)\A{_inside(quote)}\z"), True).otherwise(opens(rest, sep, quote))


def _flips(order: str, keys: list[str]) -> tuple[Column, Column]:
    """Running composition over rows with ``_e0`` and ``_e1``, the states behind a row for both states before it.

    The parity of the swaps before a row, and the last fixed state before it as it was without them (null: none).
    """
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    swaps = F.coalesce(F.sum(F.when(F.col("_e0") & ~F.col("_e1"), 1).otherwise(0)).over(before), F.lit(0)) % 2
    return swaps, F.last("_fixed", ignorenulls=True).over(before)


def _composed(rows: DataFrame, order: str, keys: list[str]) -> DataFrame:
    """Adds ``_swaps`` and ``_fixed_before`` for the rows before each, and ``_fixed`` of the row itself."""
    swaps, last = _flips(order, keys)
    fixed = F.when(F.col("_e0") == F.col("_e1"), (F.col("_e0").cast("int") + F.col("_swaps")) % 2)
    return rows.withColumn("_swaps", swaps).withColumn("_fixed", fixed).withColumn("_fixed_before", last)


def _state(entry: Column | int) -> Column:
    """The state before a row: 1 is inside."""
    known = F.coalesce("_fixed_before", entry if isinstance(entry, Column) else F.lit(entry))
    return (known + F.col("_swaps")) % 2


def open_files(lines: DataFrame, quote: str) -> DataFrame:
    """``(delivery, _file)`` of the files with a line whose quote stays open."""
    return lines.where(opens(F.col("value"), F.col("sep"), quote)).select(*FILE).distinct()


def join_records(lines: DataFrame, quote: str) -> DataFrame:
    """The lines of some files with those of one record joined by a line break, at the place of the first.

    A quote that is never closed doesn't count: from the last line that opens one to the end of the file, lines stay as
    they are.
    """
    has = F.contains("value", F.lit(quote))
    ends = {"_e0": F.when(has, opens(F.col("value"), F.col("sep"), quote)).otherwise(False), "_e1": F.when(has, stays_inside(F.col("value"), F.col("sep"), quote)).otherwise(True)}
    lines = stage(_composed(lines.withColumns(ends), "_at", BLOCK).drop("_fixed"), "quote-states")

    # One row per block: what it does to the state it is entered in.
    totals = lines.groupBy(*BLOCK).agg(
        (F.sum(F.when(F.col("_e0") & ~F.col("_e1"), 1).otherwise(0)) % 2).alias("_parity"),
        F.max_by(
            F.when(F.col("_e0") == F.col("_e1"), (F.col("_e0").cast("int") + F.col("_swaps")) % 2),
            F.when(F.col("_e0") == F.col("_e1"), F.col("_at")),
        ).alias("_last"),
    )
    after = lambda entry: (F.coalesce("_last", F.lit(entry)) + F.col("_parity")) % 2 == 1
    blocks = _composed(totals.withColumns({"_e0": after(0), "_e1": after(1)}), "_block", FILE)
    blocks = blocks.withColumn("_entry", _state(0))
    blocks = blocks.withColumn("_exit", F.when(F.col("_entry") == 1, F.col("_e1")).otherwise(F.col("_e0")))
    blocks = stage(blocks.select(*BLOCK, "_entry", "_exit"), "quote-blocks")
    lines = lines.join(blocks.drop("_exit"), BLOCK).withColumn("_inside", _state(F.col("_entry")) == 1)
    lines = lines.withColumn("_open", F.when(F.col("_inside"), F.col("_e1")).otherwise(F.col("_e0")))

    # Where a quote is never closed.
    at = F.struct("_block", "_at")
    last = blocks.groupBy(*FILE).agg(F.max_by("_exit", "_block").alias("_unclosed"))
    opened = lines.where(~F.col("_inside") & F.col("_open")).groupBy(*FILE).agg(F.max(at).alias("_never"))
    never = stage(last.where("_unclosed").join(opened, FILE).select(*FILE, "_never"), "quotes-never-closed")
    lines = lines.join(never, FILE, "left").withColumn("_plain", F.coalesce(at >= F.col("_never"), F.lit(False)))
    begins = F.col("_plain") | ~F.col("_inside")
    lines = lines.select(*BLOCK, "_at", "value", "sep", begins.alias("_begins"), (F.col("_open") & ~F.col("_plain")).alias("_open"))

    single = lines.where(F.col("_begins") & ~F.col("_open"))
    several = stage(lines.where(~F.col("_begins") | F.col("_open")), "lines-of-records")
    # The record a line belongs to is named by its first line, which may stand in an earlier block.
    begin = F.when(F.col("_begins"), at)
    firsts = several.groupBy(*BLOCK).agg(F.max(begin).alias("_first"))
    before = Window.partitionBy(*FILE).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = stage(firsts.select(*BLOCK, F.last("_first", ignorenulls=True).over(before).alias("_carried")), "records-of-blocks")
    so_far = Window.partitionBy(*BLOCK).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    named = several.join(carried, BLOCK).withColumn("_record", F.coalesce(F.last(begin, ignorenulls=True).over(so_far), F.col("_carried")))
    texts = F.array_sort(F.collect_list(F.struct("_block", "_at", "value")))
    joined = named.groupBy(*FILE, "_record", "sep").agg(F.array_join(F.transform(texts, lambda t: t["value"]), "\n").alias("value"))
    joined = joined.select(*FILE, F.col("_record._block").alias("_block"), F.col("_record._at").alias("_at"), "value", "sep")
    return single.select(*BLOCK, "_at", "value", "sep").unionByName(joined)
