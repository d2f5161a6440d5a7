"""Vectorised scanning of Arrow text columns: words, polynomial digests, minimisers.

Everything works on one flat byte array and the offsets of its documents, so a
task never holds more than one Arrow batch and handles it in pieces of bounded
size (a single longer document is a piece of its own).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: The words of every contract: maximal runs of bytes outside these (also the regular expression for Spark).
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"
IS_BLANK = np.zeros(256, dtype=bool)
IS_BLANK[[0x20, *range(0x09, 0x0E)]] = True

PIECE_BYTES = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LETTERS = np.random.default_rng(20240917).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.random.default_rng(7).integers(0, 2, 256, dtype=np.uint64)
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n, (_, offsets, data) = len(column), column.buffers()
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most `most` bytes together; a longer document stands alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = IS_BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and document of every word (run of bytes that are not blank); documents touch without sharing a word."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~blank[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    edges = offsets[1:-1]
    before[edges[edges < len(data)]] = False
    after[edges[edges > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


class Digests:
    """Digests of any span of a sequence, from prefix sums of a random polynomial modulo 2**64."""

    _powers = _inverses = np.ones(1, np.uint64)

    @classmethod
    def _tables(cls, n: int) -> None:
        if len(cls._powers) < n:
            size = max(n, PIECE_BYTES + 1)
            powers, inverses = np.full(size, _BASE), np.full(size, _BASE_INVERSE)
            powers[0] = inverses[0] = 1
            cls._powers, cls._inverses = np.multiply.accumulate(powers), np.multiply.accumulate(inverses)

    def __init__(self, letters: np.ndarray):
        n = len(letters)
        self._tables(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(letters * self._powers[:n], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self._inverses[starts] + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))

    def windows(self, width: int) -> np.ndarray:
        """Of every `width` consecutive letters."""
        n = len(self.sums) - width
        return mix((self.sums[width:] - self.sums[:n]) * self._inverses[:n] + _U(width * 0xD6E8FEB86659FD93 % (1 << 64))) if n > 0 else np.zeros(0, np.uint64)


def byte_digests(data: np.ndarray) -> Digests:
    return Digests(_LETTERS[data])


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return byte_digests(data).of(starts, ends)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    out, have = x, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[: len(out) - (width - have)], out[width - have :])
    return out


def window_runs(letters: Digests, ends: np.ndarray, width: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Windows of `width` letters in runs that share their anchor.

    `ends` holds for each letter the end of its document. The anchor of a window is the leftmost of its
    `anchor`-letter strings of least digest, so equal windows have equal anchors at equal places. Windows that
    share one anchor stand side by side. For each run: first window, number of windows, digest of the anchor,
    digest of all that the run's windows cover (with the anchor's place in it).
    """
    n, none = len(ends), np.zeros(0, np.int64)
    if n < width:
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    grams = letters.windows(anchor)
    keyed = (grams & _U(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    least = (sliding_min(keyed, width - anchor + 1) & _U(0xFFFFFFFF)).astype(np.int64)
    at = np.flatnonzero(np.arange(n - width + 1) + width <= ends[: n - width + 1])
    if not len(at):
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    place = least[at]
    new = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1))))
    first, count = at[new], np.diff(np.append(new, len(at)))
    anchors = place[new]
    cover = mix(letters.of(first, first + count - 1 + width) + (anchors - first).astype(np.uint64) * _U(0xA24BAED4963EE407))
    return first, count, grams[anchors], cover


def anchor_places(letters: Digests, begin: np.ndarray, width: int, anchor: int) -> np.ndarray:
    """Where the anchor (see window_runs) of the windows that start at `begin` starts."""
    if not len(begin):
        return begin
    grams = (letters.windows(anchor) >> _U(32)).astype(np.uint32)
    return begin + grams[begin[:, None] + np.arange(width - anchor + 1)].argmin(axis=1)


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Mask of the positions below n that the spans cover."""
    steps = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(np.minimum(ends, n), minlength=n + 1)[: n + 1]
    return np.cumsum(steps)[:n] > 0


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
