"""Repeated windows of a fixed length over whole documents, found through sampled anchors.

A pass over the documents gives one row for each run of windows that share an anchor (textscan.window_runs):
key `a` (digest of the anchor), class `c` (digest of all that the run covers), document `d` and `place`.
Equal windows have equal anchors, so a window can repeat only where its anchor does, and all windows of a run
repeat where its class does. Only anchors that occur with different classes need a look at single windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import NULL_ID, written
from .textscan import Digests, byte_digests, flat, pieces, signed, window_runs, word_hashes, word_spans

#: place = first window << 32 | number of windows << 24 | 24 bits of the text's digest. It orders by the start,
#: and keeps apart rows of one doc_id with other texts.
START, COUNT, VARIANT = 32, 24, (1 << 24) - 1


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """d: doc_id, with a stand-in for null; text: never null."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("d"), F.coalesce("text", F.lit("")).alias("text"), *more)


class Piece:
    """Some documents as one sequence of letters: their words or their bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, words: bool):
        self.data, self.offsets = data, offsets
        whole = byte_digests(data)
        self.variant = (whole.of(offsets[:-1], offsets[1:]) & np.uint64(VARIANT)).astype(np.int64)
        if words:
            self.starts, self.stops, doc = word_spans(data, offsets)
            self.letters = Digests(whole.of(self.starts, self.stops))
            self.bounds = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(offsets) - 1))))
        else:
            self.letters, self.bounds = whole, offsets
        self.ends = np.repeat(self.bounds[1:], np.diff(self.bounds))

    def runs(self, width: int, anchor: int) -> tuple[np.ndarray, ...]:
        """Document, first window in it, number of windows, anchor, class of each run."""
        first, count, a, c = window_runs(self.letters, self.ends, width, anchor)
        doc = np.searchsorted(self.bounds, first, "right") - 1
        return doc, first - self.bounds[doc], count, a, c


def scan(batch: pa.RecordBatch, words: bool) -> Iterator[tuple[slice, Piece]]:
    data, offsets = flat(batch.column("text"))
    for i, j in pieces(offsets):
        yield slice(i, j), Piece(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)


def place(start: np.ndarray, count: np.ndarray, variant: np.ndarray) -> np.ndarray:
    return start << START | count << COUNT | variant


def occurrences(docs: DataFrame, words: bool, width: int, anchor: int) -> DataFrame:
    """(a, c, d, place) of every run of every whole text; docs as from keyed()."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("d").to_numpy(zero_copy_only=False)
            for rows, piece in scan(batch, words):
                doc, start, count, a, c = piece.runs(width, anchor)
                if len(doc):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (signed(a), signed(c), ids[rows][doc], place(start, count, piece.variant[doc]))], names=["a", "c", "d", "place"])

    return docs.select("d", "text").mapInArrow(emit, "a long, c long, d long, place long")


def repeated(found: DataFrame) -> DataFrame:
    """The occurrences whose anchor occurs more than once.

    The frequent anchors are a table of their own, so that both sides of the join are plain exchanges and the
    rows of a hot anchor can be split over tasks.
    """
    often = written(found.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a"))
    return found.join(often, "a")


def with_lists(texts: DataFrame, marks: DataFrame, how: str) -> DataFrame:
    """texts joined with the sorted list `places` of their marks (d, place)."""
    lists = marks.groupBy("d").agg(F.sort_array(F.collect_set("place")).alias("places")).withColumnRenamed("d", "_d")
    return texts.join(lists, texts["d"] == lists["_d"], how).drop("_d")


def marked(batch: pa.RecordBatch, words: bool) -> Iterator[tuple[slice, Piece, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows and pieces of a batch with their marks: document in the piece, start and count of windows. Marks of another text of the same doc_id are left out."""
    lists = batch.column("places")
    values = lists.values.to_numpy(zero_copy_only=False) if len(lists) else np.zeros(0, np.int64)
    lengths = np.asarray(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    starts = np.asarray(lists.offsets.to_numpy(zero_copy_only=False)[:-1], np.int64) if len(lists) else np.zeros(0, np.int64)
    for rows, piece in scan(batch, words):
        n = lengths[rows]
        at = np.repeat(starts[rows] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        places, doc = values[at], np.repeat(np.arange(len(n)), n)
        own = (places & VARIANT) == piece.variant[doc]
        places, doc = places[own], doc[own]
        yield rows, piece, doc, places >> START, places >> COUNT & 255


def spread(doc: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each single window of some runs: index of the run, start."""
    run = np.repeat(np.arange(len(count)), count)
    return run, start[run] + np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)


Emit = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
