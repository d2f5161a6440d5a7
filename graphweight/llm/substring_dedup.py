"""Substring dedup by level-wise doubling over word windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runs
from .storage import written
from .textscan import anchor_places, covered, signed

OUT = "d long, n_words long, n_removed long, kept_sha256 string"


def removed_windows(texts: DataFrame, min_words: int) -> DataFrame:
    """(d, place): the windows, or runs of windows, whose words also start earlier.

    Level-wise doubling, for 20 words: 5, 10, 20. The first level takes 5-word strings, one for each 20-word window
    (the one of least digest, which the window's words alone determine); windows that share it stand in runs. What
    occurs once is dropped. Runs that cover the same words throughout are settled at once, all but the earliest.
    Only the earliest runs of each such class, where a 5-word string has several, are extended: to 10 words (to
    the right where the window has them, else to the left); what occurs once at that length is dropped; and the
    rest to the full 20. No candidate is left after it.
    """
    if min_words < 4 or min_words % 4 or min_words > 252:
        raise ValueError("min_words must be a multiple of 4, at most 252")
    quarter, half = min_words // 4, min_words // 2
    survivors = written(runs.repeated(runs.occurrences(texts, True, min_words, quarter)))
    classes = survivors.groupBy("a", "c").agg(F.min(F.struct("d", "place")).alias("first"))
    classes = written(classes)
    mixed = written(classes.groupBy("a").agg(F.count("*").alias("k")).where("k > 1").select("a"))
    settled = survivors.join(classes, ["a", "c"]).where("d > first.d or (d = first.d and place > first.place)").select("d", "place")
    firsts = classes.join(mixed, "a").select("first.d", "first.place")

    def doubled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("d").to_numpy(zero_copy_only=False)
            for rows, piece, doc, start, count in runs.marked(batch, True):
                begin = piece.bounds[doc] + start
                anchor = anchor_places(piece.letters, begin, min_words, quarter)
                left = np.clip(anchor - half - begin, 0, count)  # windows that end before the anchor's right half does
                raw = piece.data.tobytes()
                for skip, n, x, side in ((0, left, anchor + quarter - half, 0), (left, count - left, anchor, 1)):
                    some = np.flatnonzero(n > 0)
                    at, n, own = (begin + skip)[some], n[some], doc[some]
                    key = piece.letters.of(x[some], x[some] + half) ^ np.uint64(side)
                    spots = runs.place((start + skip)[some], n, piece.variant[own])
                    spans = zip(piece.starts[at].tolist(), piece.stops[at + n + min_words - 2].tolist(), strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(signed(key)), pa.array(ids[rows][own]), pa.array(spots), pa.array([raw[b:e] for b, e in spans], pa.binary())], names=["a", "d", "place", "text"])

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, places = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("d", "place"))
            for rows, piece in runs.scan(batch, True):
                spots = places[rows]
                run, at = runs.spread(np.arange(len(spots)), np.zeros_like(spots), spots >> runs.COUNT & 255)
                begin, spots = piece.bounds[run] + at, spots[run]
                where = runs.place((spots >> runs.START) + at, np.ones_like(at), spots & runs.VARIANT)
                yield pa.RecordBatch.from_arrays([pa.array(signed(piece.letters.of(begin, begin + min_words))), pa.array(ids[rows][run]), pa.array(where)], names=["w", "d", "place"])

    halves = written(runs.with_lists(texts, firsts, "inner").mapInArrow(doubled, "a long, d long, place long, text binary"))
    windows = written(runs.repeated(halves).mapInArrow(single, "w long, d long, place long"))
    again = written(windows.groupBy("w").agg(F.min(F.struct("d", "place")).alias("first"), F.count("*").alias("n")).where("n > 1"))
    later = windows.join(again, "w").where("d > first.d or (d = first.d and place > first.place)").select("d", "place")
    return settled.unionByName(later)


def substring_dedup(docs: DataFrame, min_words: int = 20, with_text: bool = False) -> DataFrame:
    """Remove every word covered by a window of min_words words that also starts earlier (smaller doc_id, or the same document).

    docs: doc_id, text; other columns are not looked at, whatever their names. Returns per row doc_id, n_words,
    n_removed, kept_sha256 (of the kept words joined by one space) and, with with_text, kept_text: the text
    itself where nothing goes, else the text without the removed words and the white space after them.

    Null and empty texts have no words. Texts below min_words keep all. Rows that repeat a doc_id with the same
    text are one document and get the same result; with another text they are judged apart, in the order of their
    starts. A null doc_id counts as smallest and is returned as null. An empty table gives an empty one.
    """
    texts = runs.keyed(docs).repartition(F.col("d"))
    marks = removed_windows(runs.keyed(docs), min_words)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("d")
            for rows, piece, doc, start, count in runs.marked(batch, True):
                begin = piece.bounds[doc] + start
                gone = covered(begin, begin + count - 1 + min_words, len(piece.starts))
                totals = np.concatenate(([0], np.cumsum(gone)))
                n_words, n_removed = np.diff(piece.bounds), np.diff(totals[piece.bounds])
                raw, digests, kept = piece.data.tobytes(), [], []
                for i in range(len(n_words)):
                    x, y = piece.offsets[i], piece.offsets[i + 1]
                    text = raw[x:y]
                    if n_removed[i]:
                        lo, hi = piece.bounds[i], piece.bounds[i + 1]
                        keep = ~gone[lo:hi]
                        steps = np.diff(np.concatenate(([False], keep, [False])).astype(np.int8))
                        upto = np.append(piece.starts[lo + 1 : hi], y)  # a word goes with the white space after it
                        spans = list(zip(piece.starts[lo:hi][steps[:-1] == 1].tolist(), upto[steps[1:] == -1].tolist(), strict=True))
                        text = b"".join(raw[b:e] for b, e in spans)
                    digests.append(hashlib.sha256(b" ".join(text.split())).hexdigest())
                    if with_text:
                        kept.append(text.decode())
                columns = [ids[rows.start : rows.stop], pa.array(n_words), pa.array(n_removed), pa.array(digests, pa.string())]
                names = ["d", "n_words", "n_removed", "kept_sha256"]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.string())] * with_text, names=names + ["kept_text"] * with_text)

    out = runs.with_lists(texts, marks, "left").mapInArrow(cut, OUT + (", kept_text string" if with_text else ""))
    return out.select(F.nullif(F.col("d"), F.lit(runs.NULL_ID)).alias("doc_id"), "n_words", "n_removed", "kept_sha256", *(["kept_text"] if with_text else []))
