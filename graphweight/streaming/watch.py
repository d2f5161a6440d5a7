"""Noticing that a source tree has changed."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweight.functions import scalar as X
from graphweight.sources.local_tree import local_tree
from graphweight.storage import written


def relevant(listing: DataFrame, root: str, language: str) -> DataFrame:
    """The files of a listing whose change can change the graph."""
    below = X.relative_path(F.col("path"), root)
    return listing.where(~F.col("is_dir") & X.is_relevant_event(below, X.LANGUAGE_EXTENSIONS[language])).select("path", "size", "mtime_nanos")


def events(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, event (create, modify, remove) between two listings."""
    both = before.withColumnsRenamed({"size": "s0", "mtime_nanos": "t0"}).join(after.withColumnsRenamed({"size": "s1", "mtime_nanos": "t1"}), "path", "full")
    modified = ~(F.col("s0").eqNullSafe(F.col("s1")) & F.col("t0").eqNullSafe(F.col("t1")))
    event = F.when(F.col("s0").isNull(), "create").when(F.col("s1").isNull(), "remove").when(modified, "modify")
    return both.select("path", event.alias("event")).where("event is not null")


class Watch:
    """Remembers a tree as it was at the last refresh. File streams only report new files, so listings are compared."""

    def __init__(self, spark: SparkSession, root: str, language: str):
        self.spark, self.root, self.language = spark, os.path.abspath(root), language
        self.refresh()

    def _now(self) -> DataFrame:
        return relevant(local_tree(self.spark, self.root), self.root, self.language)

    def refresh(self) -> None:
        self.seen = written(self._now())

    def events(self) -> DataFrame:
        return events(self.seen, self._now())

    @property
    def dirty(self) -> bool:
        return not self.events().isEmpty()


def poll(watch: Watch, on_change: Callable[[DataFrame], None], seconds: float = 1.0):
    """A stream that compares listings every so often and hands what changed to on_change, which is then the state to compare with."""

    def batch(_: DataFrame, __: int) -> None:
        found = written(watch.events())
        if not found.isEmpty():
            on_change(found)
            watch.refresh()

    clock = watch.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return clock.writeStream.foreachBatch(batch).trigger(processingTime=f"{int(seconds * 1000)} milliseconds").start()
