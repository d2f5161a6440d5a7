"""Suffix-array dedup of long byte strings with a logarithmic family of indexes."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runs
from .storage import written
from .textscan import byte_digests, covered, pieces, signed

#: Documents come in so many batches, by a hash of their id.
BATCHES = 4
#: Stretches around one anchor that one task may hold together; those of a more frequent anchor are indexed by single suffixes.
MOST_CLASSES = 1 << 16
#: Stretches that a task scans at once, those of one anchor at least.
ROWS = 8192
LEVEL = "a long, c long, n long, content binary"


class SuffixIndex:
    """A logarithmic family of suffix arrays, each a written table.

    A row is a stretch: the suffixes that share an anchor, from the first one's start to the last one's end. It is
    ordered by its anchor and by the digest of all it covers, and inside of a scan by its suffixes' digests of
    min_bytes bytes. A new batch is an array of its own. It is merge-scanned against itself and all levels: they
    are dealt by anchor, sorted, and equal neighbours are matches of at least min_bytes. Then it is merged with the
    level of its size, and the result with that of the next, so that there are O(log n) levels of geometric sizes
    and each stretch is written O(log n) times.
    """

    def __init__(self, min_bytes: int) -> None:
        self.min_bytes = min_bytes
        self.levels: list[tuple[int, DataFrame]] = []  # batches, table; large ones first

    def add(self, batch: DataFrame, last: bool = False) -> DataFrame:
        """(a, c, at, count): runs of suffixes of stretches, of the batch or of levels, that the batch brings a match for. batch: LEVEL, each (a, c) once, n its number of places. last: nothing will be added after it."""
        batch = batch.select("a", "c", "n", "content")
        rows = batch.withColumn("new", F.lit(True))
        for _, level in self.levels:
            rows = rows.unionByName(level.withColumn("new", F.lit(False)))
        marks = written(rows.repartition(F.col("a")).sortWithinPartitions("a", "c").mapInArrow(_merge_scan(self.min_bytes, ROWS), "a long, c long, at long, count long"))
        if not last:
            size, table = 1, batch
            while self.levels and self.levels[-1][0] == size:
                table, size = table.unionByName(self.levels.pop()[1]), 2 * size
            self.levels.append((size, table if size == 1 else written(table.repartition(F.col("a"), F.col("c")).sortWithinPartitions("a", "c"))))
        return marks


def _windows(contents: pa.Array, min_bytes: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Digest of each window of some contents, and the number of windows of each content."""
    offsets = np.frombuffer(contents.cast(pa.large_binary()).buffers()[1], np.int64)[contents.offset : contents.offset + len(contents) + 1]
    data = np.frombuffer(contents.cast(pa.large_binary()).buffers()[2], np.uint8)
    for i, j in pieces(offsets):
        own = offsets[i : j + 1] - offsets[i]
        count = np.diff(own) - min_bytes + 1
        _, at = runs.spread(np.arange(j - i), own[:-1], count)
        yield slice(i, j), byte_digests(data[offsets[i] : offsets[j]]).windows(min_bytes)[at], count


def _runs_of(found: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of marked windows: content, first window, number."""
    owner, at = runs.spread(np.arange(len(count)), np.zeros(len(count), np.int64), count)
    owner, at = owner[found], at[found]
    new = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)))) if len(at) else np.zeros(0, np.int64)
    return owner[new], at[new], np.diff(np.append(new, len(at)))


def _merge_scan(min_bytes: int, rows_at_once: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The scan of rows (LEVEL and new) sorted by anchor, some whole anchors at a time."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            own = pa.Table.from_batches([batch])
            held = own if held is None else pa.concat_tables([held, own])
            if held.num_rows >= rows_at_once:
                a = held.column("a").to_numpy()
                whole = int(np.searchsorted(a, a[-1]))  # the last anchor may go on in the next batch
                if whole:
                    yield _matches(held.slice(0, whole), min_bytes)
                    held = held.slice(whole)
        if held is not None and held.num_rows:
            yield _matches(held, min_bytes)

    return scan


def _matches(rows: pa.Table, min_bytes: int) -> pa.RecordBatch:
    """Runs of suffixes that have an equal one among the rows, one of the two in a new row."""
    a, c, n, new = (rows.column(x).to_numpy() for x in ("a", "c", "n", "new"))
    digests, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for _, d, count in _windows(pa.concat_arrays(rows.column("content").chunks), min_bytes):
        digests.append(d)
        counts.append(count)
    keys, count = np.concatenate(digests), np.concatenate(counts)
    owner = np.repeat(np.arange(len(count)), count)
    order = np.argsort(keys, kind="stable")
    group = np.cumsum(np.concatenate(([True], keys[order][1:] != keys[order][:-1]))) - 1 if len(keys) else np.zeros(0, np.int64)
    size = np.bincount(group, minlength=1)
    fresh = np.bincount(group, weights=new[owner[order]], minlength=1)
    matched = np.zeros(len(keys), bool)
    matched[order] = ((size > 1) & (fresh > 0))[group]
    row, at, length = _runs_of(matched, count)
    once = n[row] == 1  # a stretch with several places is a match as a whole
    return pa.RecordBatch.from_arrays([pa.array(x[once]) for x in (a[row], c[row], at, length)], names=["a", "c", "at", "count"])


def removed_windows(texts: DataFrame, min_bytes: int, anchor: int) -> DataFrame:
    """(d, place): the suffixes, or runs of suffixes, of which another place has an equal one.

    Candidates are the stretches whose anchor occurs more than once. Equal stretches are one row with its number of
    places; those whose anchor has several go into the index, batch by batch, with their bytes. What is found of a
    stretch holds at all its places.
    """
    survivors = written(runs.repeated(runs.occurrences(texts, False, min_bytes, anchor)))
    classes = written(survivors.groupBy("a", "c").agg(F.count("*").alias("n"), F.min(F.struct("d", "place")).alias("first")))
    mixed = written(classes.groupBy("a").agg(F.count("*").alias("k")).where("k > 1"))
    size = F.shiftright("first.place", runs.COUNT).bitwiseAND(255)
    whole = classes.where("n > 1").select("a", "c", F.lit(0).cast("long").alias("at"), size.cast("long").alias("count"))
    firsts = classes.join(mixed, "a").select("first.d", F.struct("first.place", "a", "c", "n", (F.col("k") > MOST_CLASSES).cast("long").alias("hot")).alias("place"))

    def content(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column("d").to_numpy(zero_copy_only=False), batch.column("places")
            values, lengths = lists.flatten(), np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
            where, a, c, n, hot = (x.to_numpy(zero_copy_only=False) for x in values.flatten())
            bounds = np.concatenate(([0], np.cumsum(lengths)))
            for rows, piece in runs.scan(batch, False):
                raw = piece.data.tobytes()
                lo, hi = bounds[rows.start], bounds[rows.stop]
                doc = np.repeat(np.arange(rows.stop - rows.start), lengths[rows])
                own = (where[lo:hi] & runs.VARIANT) == piece.variant[doc]
                spots, doc = where[lo:hi][own], doc[own]
                begin = piece.offsets[doc] + (spots >> runs.START)
                end = begin + (spots >> runs.COUNT & 255) - 1 + min_bytes
                columns = [pa.array(x[lo:hi][own]) for x in (a, c, n, hot)] + [pa.array(ids[rows][doc]), pa.array([raw[b:e] for b, e in zip(begin.tolist(), end.tolist(), strict=True)], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["a", "c", "n", "hot", "d", "content"])

    contents = runs.with_lists(texts, firsts, "inner").mapInArrow(content, "a long, c long, n long, hot long, d long, content binary")
    contents = written(contents.withColumn("batch", F.pmod(F.xxhash64("d"), F.lit(BATCHES)).cast("int")).drop("d").dropDuplicates(["a", "c"]))

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, c, n = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("a", "c", "n"))
            for rows, digests, count in _windows(batch.column("content"), min_bytes):
                owner, at = runs.spread(np.arange(len(count)), np.zeros(len(count), np.int64), count)
                yield pa.RecordBatch.from_arrays([pa.array(signed(digests)), *[pa.array(x[rows][owner]) for x in (a, c, n)], pa.array(at)], names=["s", "a", "c", "n", "at"])

    index, marks = SuffixIndex(min_bytes), whole
    for k in range(BATCHES):
        marks = marks.unionByName(index.add(contents.where((F.col("batch") == k) & (F.col("hot") == 0)), last=k == BATCHES - 1))
    suffixes = contents.where("hot > 0").mapInArrow(single, "s long, a long, c long, n long, at long")
    often = written(suffixes.groupBy("s").agg(F.count("*").alias("m")).where("m > 1").select("s"))
    marks = written(marks.unionByName(suffixes.join(often, "s").where("n = 1").select("a", "c", "at", F.lit(1).cast("long").alias("count"))))
    start = F.shiftleft(F.shiftright("place", runs.START) + F.col("at"), runs.START)
    return survivors.join(marks, ["a", "c"]).select("d", start.bitwiseOR(F.shiftleft("count", runs.COUNT)).bitwiseOR(F.col("place").bitwiseAND(runs.VARIANT)).alias("place"))


def suffix_dedup(docs: DataFrame, min_bytes: int = 200, anchor: int = 32) -> DataFrame:
    """Remove every byte covered by a string of min_bytes bytes that also starts anywhere else in the table.

    docs: doc_id, text, taken as UTF-8; other columns are not looked at, whatever their names. Matches lie inside
    documents; all copies go, the first as well. Returns per row doc_id, n_bytes, n_removed, n_spans (maximal
    removed runs), kept_sha256 (of the remaining bytes, concatenated).

    Null and empty texts have no bytes; shorter texts than min_bytes keep all. Rows that repeat a doc_id are
    documents of their own, so a repeated row loses what a copy loses. A null doc_id is returned as null. An empty
    table gives an empty one.
    """
    if not 0 < min_bytes - anchor < 255:
        raise ValueError("anchor must be shorter than min_bytes, by less than 255 bytes")
    texts = runs.keyed(docs).repartition(F.col("d"))
    marks = removed_windows(runs.keyed(docs), min_bytes, anchor)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("d")
            for rows, piece, doc, start, count in runs.marked(batch, False):
                begin = piece.offsets[doc] + start
                n, n_bytes = len(piece.data), np.diff(piece.offsets)
                gone = covered(begin, begin + count - 1 + min_bytes, n)
                totals = np.concatenate(([0], np.cumsum(gone)))
                before = np.concatenate(([False], gone))[:-1] if n else gone
                before[piece.offsets[:-1][piece.offsets[:-1] < n]] = False
                spans = np.concatenate(([0], np.cumsum(gone & ~before)))
                kept = piece.data[~gone].tobytes()
                at = np.concatenate(([0], np.cumsum(n_bytes - np.diff(totals[piece.offsets]))))
                digests = [hashlib.sha256(kept[x:y]).hexdigest() for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                columns = [ids[rows.start : rows.stop], pa.array(n_bytes), pa.array(np.diff(totals[piece.offsets])), pa.array(np.diff(spans[piece.offsets])), pa.array(digests, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["d", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    out = runs.with_lists(texts, marks, "left").mapInArrow(cut, "d long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.select(F.nullif(F.col("d"), F.lit(runs.NULL_ID)).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
