"""Written tables that cut lineage.

A staged table is plain Parquet in the shared folder the cluster names in
``spark.checkpoint.dir``; it outlives lost executors and is read back column-wise. Shuffle files of the job that
writes it go with the job.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


class _Open(threading.local):
    """For each thread, the paths staged within the blocks of ``scratch`` that are open."""

    def __init__(self) -> None:
        self.blocks: list[list[str]] = []


_open = _Open()

#: Spark removes the shuffle files of a query when it ends, not when the driver happens to collect its garbage.
FREES_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock = threading.Lock()
#: For each session, how many blocks of ``freeing`` are open in all threads, and the setting before the first of them.
_freeing: dict[str, tuple[int, str | None]] = {}


@contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries that are made and run inside are removed as soon as the query ends."""
    session = spark._jsparkSession.sessionUUID()
    with _lock:
        n, before = _freeing.get(session) or (0, spark.conf.get(FREES_SHUFFLES, None))
        _freeing[session] = (n + 1, before)
        spark.conf.set(FREES_SHUFFLES, "true")
    try:
        yield
    finally:
        with _lock:
            n, before = _freeing.pop(session)
            if n > 1:
                _freeing[session] = (n - 1, before)
            elif before is None:
                spark.conf.unset(FREES_SHUFFLES)
            else:
                spark.conf.set(FREES_SHUFFLES, before)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session: its checkpoint folder, else its warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (folder or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody uses yet."""
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/twintally/{app}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, keep: bool = False, partition_by: Sequence[str] = (), compression: str | None = None) -> DataFrame:
    """Write ``df`` once and continue from the written table.

    Within a block of ``scratch`` the table goes with the block; with ``keep`` it
    outlives it and goes with the block around it, if there is one.
    """
    path = new_path(df.sparkSession, name)
    with freeing(df.sparkSession):
        df.select("*").write.parquet(path, partitionBy=list(partition_by) or None, compression=compression)
    blocks = _open.blocks[: len(_open.blocks) - keep]
    if blocks:
        blocks[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside are removed at the end, when nothing reads them any more."""
    paths: list[str] = []
    _open.blocks.append(paths)
    try:
        yield
    finally:
        _open.blocks.pop()
        jvm, configuration = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in paths:
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(configuration).delete(folder, True)
