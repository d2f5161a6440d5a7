"""Licence scans by patience alignment."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_texts import TEMPLATES
from .textscan import flat, pieces, word_hashes, word_spans

#: Share of a template's words that a passage must align with, in order.
MIN_COVERAGE = 0.8
#: A window is opened where it holds enough of a template's words, in any order, for that; it may be longer than the template by SLACK.
SLACK = 0.25
OUT = "doc_id long, license string, kind string, start_word long, end_word long, n_matched long, template_words long, coverage double"

#: Words are runs of ASCII letters and digits and of bytes beyond ASCII, without regard to case.
_BLANK = np.array([not (chr(b).isascii() and chr(b).isalnum() or b >= 0x80) for b in range(256)])
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digests of all words, and the bounds of each document's."""
    data = _LOWER[data]
    starts, ends, doc = word_spans(data, offsets, _BLANK)
    return word_hashes(data, starts, ends), np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(offsets) - 1))))


def rising(values: Sequence[int]) -> list[int]:
    """Places of a longest increasing subsequence, by patience sorting: the tops of the piles and what lay before each."""
    tops: list[int] = []
    ends: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        if pile == len(tops):
            tops.append(v)
            ends.append(i)
        else:
            tops[pile], ends[pile] = v, i
        before[i] = ends[pile - 1] if pile else -1
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(text: Sequence[int], template: Sequence[int]) -> list[tuple[int, int]]:
    """Pairs of equal words (place in the text, place in the template), both rising.

    Words at the ends that agree are paired; then the words that stand once in each anchor a longest rising
    sequence, and each gap between anchors is aligned in the same way.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        here, there = Counter(text[a:b]), Counter(template[c:d])
        place = {w: i for i, w in enumerate(text[a:b], a) if here[w] == 1}
        once = [(place[w], j) for j, w in enumerate(template[c:d], c) if there[w] == 1 and w in place]
        anchors = [once[i] for i in rising([x for x, _ in once])]
        if not anchors:
            continue
        out += anchors
        for (p, q), (r, s) in zip([(a - 1, c - 1), *anchors], [*anchors, (b, d)], strict=True):
            if p + 1 < r and q + 1 < s:
                todo.append((p + 1, r, q + 1, s))
    return sorted(out)


class Scanner:
    def __init__(self, templates: Sequence[tuple[str, str, str]], min_coverage: float):
        self.names = [(t[0], t[1]) for t in templates]
        self.min_coverage = min_coverage
        self.words = []
        for *_, text in templates:
            data = np.frombuffer(text.encode(), np.uint8)
            self.words.append(words_of(data, np.array([0, len(data)]))[0])
        self.vocabulary = np.unique(np.concatenate(self.words)) if self.words else np.zeros(0, np.uint64)
        self.places = [np.unique(np.searchsorted(self.vocabulary, w), return_counts=True) for w in self.words]  # a template's words in the vocabulary, and how often it has them
        self.member = np.zeros((len(self.words), len(self.vocabulary)), bool)
        for k, (places, _) in enumerate(self.places):
            self.member[k, places] = True
        self.need = [max(1, int(np.ceil(min_coverage * len(w) - 1e-9))) for w in self.words]

    def known(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words that some template has, and their places in the vocabulary."""
        if not len(self.vocabulary):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        found = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        at = np.flatnonzero(self.vocabulary[found] == words)
        return at, found[at]

    def likely(self, doc: np.ndarray, word: np.ndarray, n_docs: int) -> np.ndarray:
        """documents x templates: whether a document's words, in any order and each as often as the template has it, could cover enough of the template. doc, word: the known words."""
        size = max(1, len(self.vocabulary))
        counts = np.bincount(doc * size + word, minlength=n_docs * size).reshape(n_docs, size)
        out = np.zeros((n_docs, len(self.words)), bool)
        for k, (places, often) in enumerate(self.places):
            out[:, k] = np.minimum(counts[:, places], often).sum(axis=1) >= self.need[k]
        return out

    def passages(self, text: np.ndarray, likely: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(template, first word, end, words aligned) of every open window of a document that aligns well enough. They overlap: a window may start before the notice and end inside it."""
        places, word = self.known(text)
        for k in np.flatnonzero(likely).tolist():
            template = self.words[k]
            at = places[self.member[k, word]]
            need, length = self.need[k], len(template) + max(2, int(SLACK * len(template)))
            if len(at) < need:
                continue
            open_ = at[np.searchsorted(at, at + length) - np.arange(len(at)) >= need]
            wanted, last = template.tolist(), None
            for s in open_.tolist():
                pairs = align(text[s : s + length].tolist(), wanted)
                if len(pairs) >= need:
                    found = k, s + pairs[0][0], s + pairs[-1][0] + 1, len(pairs)
                    if found != last:
                        yield found
                    last = found

    def scan(self, text: np.ndarray, likely: np.ndarray | None = None) -> list[tuple[int, int, int, int]]:
        """Passages that do not overlap: of overlapping ones that with more aligned words, then that of higher coverage, then the shortest, stays."""
        if likely is None:
            word = self.known(text)[1]
            likely = self.likely(np.zeros(len(word), np.int64), word, 1)[0]
        found = sorted(self.passages(text, likely), key=lambda m: (-m[3], -m[3] / len(self.words[m[0]]), m[2] - m[1], m[1], m[0]))
        kept: list[tuple[int, int, int, int]] = []
        for m in found:
            i = bisect_left(kept, m[1], key=lambda x: x[1])  # what is kept does not overlap, so only its neighbours can
            if (i == 0 or kept[i - 1][2] <= m[1]) and (i == len(kept) or m[2] <= kept[i][1]):
                insort(kept, m, key=lambda x: x[1])
        return kept


def license_scan(docs: DataFrame, templates: Sequence[tuple[str, str, str]] = TEMPLATES, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """Licence passages of whole texts: a row for each, with words counted from 0 and coverage = n_matched / template_words.

    docs: doc_id, text. Windows with enough of a template's words are aligned with it by patience alignment, and
    count where the alignment covers min_coverage of the template. Passages of one document do not overlap.

    A passage may be longer than its template by SLACK: words that are put in beyond that end it. Notices, openings
    and whole bodies of licences are templates; of a whole body found, its opening is a part and gives no row.

    Null and empty texts, and texts without a passage, give no row. Repeated rows give their passages each; a
    null doc_id is kept. Other columns are not looked at. An empty table gives an empty one. The number of templates is that of the parameter: fixed and small.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, min_coverage)
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            rows = []
            for i, j in pieces(offsets):
                words, bounds = words_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                at, word = scanner.known(words)
                doc = np.searchsorted(bounds, at, "right") - 1
                likely = scanner.likely(doc, word, j - i)
                for k in np.flatnonzero(likely.any(axis=1)).tolist():
                    for t, start, end, matched in scanner.scan(words[bounds[k] : bounds[k + 1]], likely[k]):
                        n = len(scanner.words[t])
                        rows.append((ids[i + k], *scanner.names[t], start, end, matched, n, matched / n))
            if rows:
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 4, pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in OUT.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(emit, OUT)
