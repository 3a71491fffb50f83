"""Entries of ZIP archives as data sources.

``zip_entries`` lists the entries of archives from their central directories, one partition per archive. ``zip_lines`` reads
the lines of entries, one partition per entry; conditions on ``path`` and ``entry`` choose entries before any is
opened. Entries are read line by line in small batches and are never held whole.

    register(spark)
    spark.read.format("zip_lines").load("/in/old.zip").where("entry LIKE '%.csv'")

``path`` is an archive; the option ``paths`` is a JSON list of archives, ``entries`` one of (archive, entry) pairs.
"""

from __future__ import annotations

import json
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

# Which entries are deliveries.
ENTRY_SUFFIX = ".csv"
HIDDEN_PREFIX = "__"
BATCH_LINES = 10_000
BATCH_BYTES = 8 << 20


def _open(uri: str) -> zipfile.ZipFile:
    filesystem, path = fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))
    return zipfile.ZipFile(filesystem.open_input_file(path))


def _listed(uri: str) -> list[tuple[str, int]]:
    """Names and sizes of an archive's entries; none of what isn't an archive (failing to read one is an error)."""
    try:
        with _open(uri) as archive:
            return [(e.filename, e.file_size) for e in archive.infolist() if not e.is_dir()]
    except (zipfile.BadZipFile, ValueError):
        return []


class Entry(ds.InputPartition):
    def __init__(self, path: str, entry: str | None = None) -> None:
        self.path, self.entry = path, entry


class _Archives:
    """The archives or entries that the options name."""

    def __init__(self, options: dict) -> None:
        self.paths = json.loads(options["paths"]) if "paths" in options else [options["path"]] if "path" in options else []
        self.entries = [tuple(x) for x in json.loads(options["entries"])] if "entries" in options else None
        self.conditions: list = []

    def pushFilters(self, filters: list) -> Iterator:
        for condition in filters:
            # Spark keeps them too, so that an entry's rows are tested again.
            if condition.__class__ in _TESTS and condition.attribute in (("path",), ("entry",)):
                self.conditions.append(condition)
            yield condition

    def wanted(self, **values: str) -> bool:
        own = [c for c in self.conditions if c.attribute[0] in values]
        return all(_TESTS[c.__class__](values[c.attribute[0]], c) for c in own)


_TESTS = {
    ds.EqualTo: lambda v, c: v == c.value,
    ds.In: lambda v, c: v in c.value,
    ds.StringStartsWith: lambda v, c: v.startswith(c.value),
    ds.StringEndsWith: lambda v, c: v.endswith(c.value),
    ds.StringContains: lambda v, c: c.value in v,
}


class LinesReader(_Archives, ds.DataSourceReader):
    def partitions(self) -> list[Entry]:
        entries = self.entries
        if entries is None:
            entries = [(path, name) for path in self.paths if self.wanted(path=path) for name, _ in _listed(path)]
        return [Entry(*x) for x in entries if self.wanted(path=x[0], entry=x[1])]

    def read(self, partition: Entry | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there are no partitions
            return
        number, values, size = 0, [], 0
        with _open(partition.path) as archive, archive.open(partition.entry) as stream:
            for line in stream:
                values.append(line.rstrip(b"\r\n"))
                size += len(line)
                if len(values) == BATCH_LINES or size > BATCH_BYTES:
                    yield self._batch(partition, number, values)
                    number, values, size = number + len(values), [], 0
            yield self._batch(partition, number, values)

    def _batch(self, partition: Entry, number: int, values: list[bytes]) -> pa.RecordBatch:
        own = [pa.array([x] * len(values), pa.string()) for x in (partition.path, partition.entry)]
        return pa.RecordBatch.from_arrays([*own, pa.array(range(number, number + len(values)), pa.int64()), pa.array(values, pa.binary())], ["path", "entry", "at", "value"])


class EntriesReader(_Archives, ds.DataSourceReader):
    def partitions(self) -> list[Entry]:
        return [Entry(path) for path in self.paths if self.wanted(path=path)]

    def read(self, partition: Entry | None) -> Iterator[tuple]:
        if partition is None:  # there are no partitions
            return
        for name, size in _listed(partition.path):
            if self.wanted(entry=name):
                yield partition.path, name, size


class ZipLines(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "zip_lines"

    def schema(self) -> str:
        return "path string, entry string, at bigint, value binary"

    def reader(self, schema) -> LinesReader:
        return LinesReader(self.options)


class ZipEntries(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "zip_entries"

    def schema(self) -> str:
        return "path string, entry string, size bigint"

    def reader(self, schema) -> EntriesReader:
        return EntriesReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the formats known to the session, with conditions handed down to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (ZipLines, ZipEntries):
        spark.dataSource.register(source)


def list_entries(spark: SparkSession, archives: list[str]) -> DataFrame:
    """``(path, entry, size)`` for every CSV entry of the archives."""
    register(spark)
    found = spark.read.format("zip_entries").option("paths", json.dumps(archives)).load()
    return found.where(F.endswith(F.lower("entry"), F.lit(ENTRY_SUFFIX)) & ~F.startswith("entry", F.lit(HIDDEN_PREFIX)))


def entry_lines(spark: SparkSession, entries: list[tuple[str, str]]) -> DataFrame:
    """``(path, entry, at, value)``: raw lines of (archive, entry) pairs, numbered from 0 within their entry."""
    register(spark)
    return spark.read.format("zip_lines").option("entries", json.dumps(entries)).load()
