from contextlib import contextmanager
from itertools import cycle

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])

#: Rows every operator must stand: null, empty, one word, a repeated row, a long word and a long text.
ODD = [
    (None, None),
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "one"),
    (5, "same row twice here"),
    (5, "same row twice here"),
    (6, "x" * 5000),
    (7, "Ünïcödé wörds   and more\x0bhere"),
    (8, "ab cd " * 3000),
    (None, "a row without an id"),
]


@pytest.fixture
def docs(spark):
    """Makes a table of documents; more columns may be given by name, one value for all rows."""

    def make(rows, **more):
        from pyspark.sql import functions as F

        table = spark.createDataFrame(rows, DOCS)
        return table.withColumns({k: F.lit(v) for k, v in more.items()}) if more else table

    return make


@contextmanager
def splits_anew(spark, module, monkeypatch):
    """Within it, every table that ``module`` stages is written from inputs in other splits than the one before."""
    sizes, own = cycle(["200", "3000", "700", "100000"]), module.stage
    names = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    before = [spark.conf.get(n) for n in names]

    def stage(*args, **named):
        for n in names:
            spark.conf.set(n, next(sizes))
        return own(*args, **named)

    monkeypatch.setattr(module, "stage", stage)
    try:
        yield
    finally:
        for n, value in zip(names, before):
            spark.conf.set(n, value)
