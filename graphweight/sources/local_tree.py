"""File trees as tables."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHAPE = "path string, is_dir boolean, size long, mtime_nanos decimal(38,0)"


def _listing(folders: Iterator[str], deep: bool) -> Iterator[tuple[str, bool, int, int]]:
    todo = list(folders)
    seen = set()
    while todo:
        folder = todo.pop()
        real = os.path.realpath(folder)
        if real in seen:
            continue
        seen.add(real)  # links that lead back are followed once
        try:
            found = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            continue
        for e in found:
            try:
                stat, is_dir = e.stat(), e.is_dir()
            except OSError:
                continue
            yield e.path, is_dir, 0 if is_dir else stat.st_size, stat.st_mtime_ns
            if is_dir and deep:
                todo.append(e.path)


def local_tree(spark: SparkSession, root: str) -> DataFrame:
    """Every file and folder under root, hidden and empty ones too: SHAPE. Links are followed, folders have size 0.

    The driver lists the first level; executors list the folders below it. root must be a path that all of them see.
    """
    root = os.path.abspath(root)
    top = list(_listing(iter([root]), False))
    decimal = pa.decimal128(38, 0)

    def rows(found: list[tuple[str, bool, int, int]]) -> pa.RecordBatch:
        path, is_dir, size, mtime = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(is_dir, pa.bool_()), pa.array(size, pa.int64()), pa.array(mtime, pa.int64()).cast(pa.decimal128(19, 0)).cast(decimal)], names=["path", "is_dir", "size", "mtime_nanos"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple[str, bool, int, int]] = []
            for row in _listing(iter(batch.column("folder").to_pylist()), True):
                held.append(row)
                if len(held) == 10_000:
                    yield rows(held)
                    held = []
            if held:
                yield rows(held)

    own = spark.createDataFrame([(root, True, 0, None), *top], SHAPE.replace("decimal(38,0)", "long")).withColumn("mtime_nanos", F.col("mtime_nanos").cast("decimal(38,0)"))
    folders = [(p,) for p, is_dir, *_ in top if is_dir]
    if not folders:
        return own
    below = spark.createDataFrame(folders, "folder string").repartition(min(len(folders), 256), "folder").mapInArrow(walk, SHAPE)
    return own.unionByName(below).dropDuplicates(["path"])


def with_content(files: DataFrame) -> DataFrame:
    """files(path) with content (binary, null if it cannot be read). Only the files that are asked for are read."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents = []
            for path in batch.column("path").to_pylist():
                try:
                    with open(path, "rb") as file:
                        contents.append(file.read())
                except OSError:
                    contents.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(contents, pa.binary())], names=["path", "content"])

    return files.select("path").mapInArrow(read, "path string, content binary")
