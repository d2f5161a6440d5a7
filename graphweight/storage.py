"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: What each open scratch() has written, innermost last: (file system, path).
_OPEN: list[list[tuple]] = []


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder: spark.checkpoint.dir if it names one, else (tests on one machine) a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            named = tempfile.mkdtemp(prefix="graphweight-")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and read back from a compressed table in the shared folder.

    It cuts the lineage; lost executors do not lose it. The table goes with the scratch() it was written in, with
    release(), or when the driver's JVM ends: its file system deletes it, also if the session was stopped before.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    df.write.option("compression", "zstd").parquet(path)
    system.deleteOnExit(where)
    if _OPEN:
        _OPEN[-1].append((system, where))
    out = spark.read.schema(df.schema).parquet(path)
    out._table = (system, where)
    return out


def stored(df: DataFrame) -> DataFrame:
    """written(), of a table that outlives the innermost scratch()."""
    out = written(df)
    if _OPEN:
        last = _OPEN[-1].pop()
        if len(_OPEN) > 1:
            _OPEN[-2].append(last)
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing will read again. Frames that are no such tables are passed over."""
    for table in tables:
        if hasattr(table, "_table"):
            system, where = table._table
            system.delete(where, True)


@contextmanager
def scratch() -> Iterator[None]:
    """Tables written inside are deleted at its end: what is returned must have been consumed, or written outside, by then."""
    own: list[tuple] = []
    _OPEN.append(own)
    try:
        yield
    finally:
        _OPEN.remove(own)
        for system, where in own:
            system.delete(where, True)
