"""Enumeration of deliveries: files, folders and archives."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twintally.functions.names import base_name
from twintally.sources.archive import list_entries

ENTRY_MARK = "::"


def _is(extension: str) -> Column:
    return F.endswith(F.lower("path"), F.lit(extension))


def list_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """``(path, size)`` of the files under a path; their content is not read.

    A scan skips empty files, so the names come from the listing of the scan.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    files = reader.load(path)
    names = spark.createDataFrame([(_plain(uri),) for uri in files.inputFiles()], "path string")
    sizes = files.select("path", F.col("length").alias("size"))
    return names.join(sizes, "path", "left").select("path", F.coalesce("size", F.lit(0)).alias("size"))


def _plain(uri: str) -> str:
    """A listed URI the way the scan itself writes the path."""
    return re.sub("^file:/+", "file:/", unquote(uri))


def list_sources(spark: SparkSession, path: str) -> DataFrame:
    """CSV files of a file, folder (not its subfolders) or archive.

    ``(name, path, size)``; a file inside an archive has the path
    ``archive.zip::entry`` and its uncompressed size.
    """
    files = list_files(spark, path)
    plain = files.where(_is(".csv")).select(base_name(F.col("path")).alias("name"), "path", "size")
    entries = list_entries(spark, [r["path"] for r in files.where(_is(".zip")).select("path").collect()])
    inside = entries.select(
        base_name(F.col("entry")).alias("name"), F.concat("path", F.lit(ENTRY_MARK), "entry").alias("path"), "size"
    )
    return plain.unionByName(inside)


def list_deliveries(spark: SparkSession, base_dir: str) -> DataFrame:
    """Folders and archives directly under a base folder: ``(name, path, is_zip)``."""
    root = list_files(spark, base_dir, recursive=True)
    base = F.lit(base_dir.rstrip("/").split("://")[-1].removeprefix("file:") + "/")
    below = F.element_at(F.split("path", base, 2), 2)
    top = F.element_at(F.split(below, "/"), 1)
    is_file = ~F.contains(below, F.lit("/"))
    found = root.select(top.alias("name"), is_file.alias("is_file"), F.lower(top).alias("lower"))
    found = found.where(~F.col("is_file") | F.endswith("lower", F.lit(".zip"))).distinct()
    path = F.concat(F.lit(base_dir.rstrip("/") + "/"), "name")
    return found.select("name", path.alias("path"), F.col("is_file").alias("is_zip"))
