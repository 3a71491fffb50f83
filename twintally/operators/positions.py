"""Explicit row positions for tables that have no key, and running totals along an order."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twintally.functions.text import col
from twintally.sources.staging import stage

POSITION = "_pos"
_INDEX_BITS = 33  # fixed by monotonically_increasing_id: partition << 33 | row in partition


def running_totals(df: DataFrame, order: Sequence[Column], number: str, name: str, limit: int | None = None) -> DataFrame:
    """Add ``name``: the sum of ``number`` over all rows before, by an ``order`` without ties.

    Two levels: ranges of rows get their start from one sum per range, rows theirs from a window inside their
    range. With ``limit``, only rows with a total below it are kept, and ranges beyond are not sorted.
    """
    spark = df.sparkSession
    ranged = stage(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    starts, start = [], 0
    for part, total in sorted((r[0], r[1] or 0) for r in ranged.groupBy("__range").agg(F.sum(number)).collect()):
        if limit is None or start < limit:
            starts.append((part, Decimal(start)))
        start += int(total)
    kind = ranged.select(F.sum(number)).schema[0].dataType
    starts = spark.createDataFrame(starts, "__range int, __start decimal(38,0)").withColumn("__start", F.col("__start").cast(kind))
    before = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = ranged.join(F.broadcast(starts), "__range").withColumn(name, F.col("__start") + F.coalesce(F.sum(number).over(before), F.lit(0)))
    return (found if limit is None else found.where(F.col(name) < limit)).drop("__range", "__start")


def with_block_position(df: DataFrame, file: str, block: str, at: str) -> DataFrame:
    """Add ``_pos`` = 1..n along (file, block, at) by prefix sums of the blocks' numbers of rows; nothing is sorted but blocks.

    A block is a part of a file that one task has read, so its rows fit into a task.
    """
    blocks = stage(df.groupBy(col(file), col(block)).agg(F.count("*").alias("_n")), "blocks")
    starts, start = [], 0
    for name, n in sorted(tuple(r) for r in blocks.groupBy(col(file)).agg(F.sum("_n")).collect()):
        starts.append((name, start))
        start += n
    starts = df.sparkSession.createDataFrame(starts, f"`{file}` string, _start bigint")
    earlier = Window.partitionBy(col(file)).orderBy(col(block)).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).join(starts, file)
    blocks = stage(blocks.select(col(file), col(block), (F.col("_start") + F.col("_before")).alias("_start")), "block-starts")
    index = F.row_number().over(Window.partitionBy(col(file), col(block)).orderBy(col(at)))
    return df.withColumn(POSITION, index).join(blocks, [file, block]).withColumn(POSITION, F.col("_start") + F.col(POSITION)).drop("_start")


def with_position(df: DataFrame, order_by: Sequence[str], unique: bool = False) -> DataFrame:
    """Add ``_pos`` = 1..n by ``order_by``, ties broken by all other columns.

    The table is range-partitioned and sorted inside its partitions, so no task
    sees more than its range. Partition and row index of the sorted table come
    from one generated id; the running start of every partition (one number per
    partition) is added by a broadcast join.

    Rows that are equal in every column would all fall into one range. Unless
    ``unique`` says that ``order_by`` has no ties, they get a written-down row id
    that lets the range boundaries cut through them.
    """
    spark = df.sparkSession
    order = [col(c) for c in order_by]
    if not unique:
        df = stage(df.withColumn("_tie", F.monotonically_increasing_id()), "unordered")
        order += [col(c) for c in df.columns if c not in order_by]
    # Without a number, adaptive execution joins small ranges.
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # The ranges are sampled anew on every run, so they are written before being counted.
    placed = stage(ranged.withColumn("_at", F.monotonically_increasing_id()), "ordered")

    part = F.shiftright("_at", _INDEX_BITS)
    sizes = placed.groupBy(part.alias("_part")).count().collect()
    starts, start = [], 0
    for row in sorted(sizes):
        starts.append((row["_part"], start))
        start += row["count"]
    offsets = spark.createDataFrame(starts, "_part bigint, _start bigint")
    index = F.col("_at").bitwiseAND(F.lit((1 << _INDEX_BITS) - 1))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(POSITION, F.col("_start") + index + 1)
        .drop("_part", "_start", "_at", "_tie")
    )
