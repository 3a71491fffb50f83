"""Small helpers around DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twintally.sources.staging import stage

TABLES = "documents embeddings pages benchmark labels conversations".split()
#: Row numbers are a file's number and a place in it: 2^23 files of 2^40 rows.
PLACE_BITS = 40
#: Paths of at most so many files are broadcast; rows of more files are written with their numbers.
MOST_FILES = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(rows: DataFrame, name: str, of_files: bool = False) -> DataFrame:
    """``rows`` with a number each, which is the same at every reading, however the input is split then.

    ``of_files``: ``rows`` are rows of Parquet files, at most filtered and with other columns (no join, no explode). Their
    numbers are those of the file and of the row within it, so nothing is written but the files' numbers. All
    other rows are written once with their numbers.
    """
    if of_files:
        paths = rows.select(F.col("_metadata.file_path").alias("__path")).distinct().coalesce(1)
        paths = stage(paths.withColumn("__file", F.monotonically_increasing_id()), "files", keep=True)
        if paths.count() <= MOST_FILES:
            found = rows.withColumns({"__path": F.col("_metadata.file_path"), "__place": F.col("_metadata.row_index")})
            found = found.join(F.broadcast(paths), "__path")
            return found.withColumn(name, F.shiftleft("__file", PLACE_BITS) + F.col("__place")).select(*rows.columns, name)
    return stage(rows.withColumn(name, F.monotonically_increasing_id()), "numbered-rows", keep=True)
