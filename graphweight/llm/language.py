"""Language identification of mixed-language text."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textscan import flat, mix, pieces

#: Ranges of code points and their scripts. Fixed values (Unicode blocks). They narrow the languages of a word; what is a letter is told by its Unicode category.
SCRIPT_RANGES = [
    (0x41, 0x24F, "latin"), (0x1E00, 0x1EFF, "latin"), (0xFF21, 0xFF5A, "latin"), (0x370, 0x3FF, "greek"), (0x1F00, 0x1FFF, "greek"), (0x400, 0x52F, "cyrillic"), (0x531, 0x58F, "armenian"), (0x591, 0x5F4, "hebrew"),
    (0x620, 0x6FF, "arabic"), (0x750, 0x77F, "arabic"), (0x900, 0x97F, "devanagari"), (0x980, 0x9FF, "bengali"), (0xB80, 0xBFF, "tamil"), (0xC00, 0xC7F, "telugu"), (0xE00, 0xE5B, "thai"),
    (0x10A0, 0x10FF, "georgian"), (0x1100, 0x11FF, "hangul"), (0x3041, 0x30FF, "kana"), (0x3400, 0x4DBF, "han"), (0x4E00, 0x9FFF, "han"), (0xAC00, 0xD7A3, "hangul"), (0x20000, 0x323AF, "han"),
]
#: Letters outside of all ranges are of one script that is open to every language.
OTHER = "other"
SCRIPTS = [*sorted({name for _, _, name in SCRIPT_RANGES}), OTHER]
#: Marks belong to the word they stand in; what is neither ends it.
MARK, NO_LETTER = 254, 255

#: Hashed strings of one to GRAM characters of a word (with its edges) have so many counters a language; fewer, if there are many languages.
GRAMS, BUCKETS = (1, 2, 3, 4), 1 << 16
#: Counters of all languages together, as long as each has LEAST_BUCKETS.
MOST_COUNTERS, LEAST_BUCKETS = 1 << 22, 1 << 10
SWITCH_PENALTY = 8.0
HELD_OUT_OF = 5
#: A script stays open to a language that has at least this share of its words in it.
SCRIPT_SHARE = 0.001
UNDETERMINED = "und"
#: Characters of a text that are scored at once; words of it that one Viterbi sweep goes through one after another.
PART_CHARS, BLOCK_WORDS = 1 << 18, 256


@cache
def script_table() -> np.ndarray:
    """Script of each code point: a place in SCRIPTS, MARK or NO_LETTER."""
    kinds = "".join(unicodedata.category(chr(c))[0] for c in range(0x110000))
    kind = np.frombuffer(kinds.encode(), np.uint8)
    table = np.full(0x110000, SCRIPTS.index(OTHER), np.uint8)
    for lo, hi, name in SCRIPT_RANGES:
        table[lo : hi + 1] = SCRIPTS.index(name)
    return np.where(kind == ord("L"), table, np.where(kind == ord("M"), MARK, NO_LETTER)).astype(np.uint8)


def buckets_for(languages: int) -> int:
    """Counters a language: a power of two, BUCKETS at most."""
    size = BUCKETS
    while size > LEAST_BUCKETS and size * languages > MOST_COUNTERS:
        size //= 2
    return size


class Letters:
    """Words of some texts: maximal runs of letters and their marks, lower-cased, as code points with an edge mark before each."""

    def __init__(self, texts: list[str]):
        texts = [t.lower() for t in texts]
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        script = script_table()[points]
        inside = script != NO_LETTER
        edge = np.zeros(len(points) + 1, bool)
        edge[bounds] = True
        begin, stop = inside.copy(), inside.copy()
        if len(points):
            begin[1:] &= ~inside[:-1] | edge[1:-1]
            stop[:-1] &= ~inside[1:] | edge[1:-1]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        # the script of a word is its first letter's; runs of marks alone are no words
        letters = np.flatnonzero(script < MARK)
        first = np.searchsorted(letters, starts)
        has = first < len(letters)
        has[has] = letters[first[has]] < ends[has]
        starts, ends, first = starts[has], ends[has], first[has]
        self.doc = np.searchsorted(bounds, starts, "right") - 1
        self.lengths = ends - starts
        self.script = script[letters[first]] if len(starts) else np.zeros(0, np.uint8)
        # words one after another, each with one edge mark before it
        n = self.lengths + 1
        self.first = np.concatenate(([0], np.cumsum(n)))
        at = np.arange(self.first[-1]) - np.repeat(self.first[:-1], n) - 1 + np.repeat(starts, n)
        self.points = np.where(np.arange(len(at)) == np.repeat(self.first[:-1], n), 0x20, points[np.maximum(at, 0)]) if len(at) else np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.lengths)

    def grams(self, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each length of GRAMS: the counter of the string that starts at each code point, and whether it lies in one word (edges included)."""
        p = np.concatenate((self.points, np.full(max(GRAMS), 0x20))).astype(np.uint64)
        n = len(self.points)
        left = np.repeat(self.first[1:], self.lengths + 1) - np.arange(n)  # letters from here to the word's end
        h = np.zeros(n, np.uint64)
        for k in range(1, max(GRAMS) + 1):
            h = mix(h * np.uint64(31) + p[k - 1 : n + k - 1] + np.uint64(k))
            if k in GRAMS:
                yield (h >> np.uint64(48)).astype(np.int64) & (buckets - 1), left + 1 >= k


def parts_of(texts: list[str], most: int = PART_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Some texts after another, of about `most` characters together, and the first one's place; a longer text in parts that end where no word runs on."""
    held: list[str] = []
    size = first = 0
    table = script_table()
    for i, text in enumerate(texts):
        if held and size + len(text) > most:
            yield first, held
            held, size = [], 0
        if not held:
            first = i
        while len(text) > most:
            end = most
            while end < len(text) and table[ord(text[end])] != NO_LETTER:
                end += 1
            yield i, [text[:end]]
            text, first = text[end:], i
        held.append(text)
        size += len(text)
    if held:
        yield first, held


@dataclass
class Model:
    """log_p[counter, language] (buckets and a last row of zeros, x languages) and allowed[script, language]."""

    languages: list[str]
    log_p: np.ndarray
    allowed: np.ndarray
    prior: np.ndarray

    def scores(self, words: Letters) -> np.ndarray:
        """Log-likelihood of each word in each language; languages that a word's script rules out have a large negative one."""
        buckets, k = len(self.log_p) - 1, len(self.languages)
        total = np.zeros((len(words.points), k), np.float32)
        for counters, valid in words.grams(buckets):
            total += self.log_p[np.where(valid, counters, buckets)]
        out = np.add.reduceat(total, words.first[:-1]) if len(words) else np.zeros((0, k), np.float32)
        allowed = self.allowed[words.script]
        return np.where(allowed | ~allowed.any(axis=1, keepdims=True), out, np.float32(-1e4))


def _sweeps(step: Callable[[np.ndarray, np.ndarray], np.ndarray], first: np.ndarray, count: np.ndarray, before: np.ndarray, start: np.ndarray, out: np.ndarray, way: int) -> None:
    """Fills out[word] = step(state before the word, word) along blocks of words, all blocks at a time; before[block] is the one whose last state its own starts from (-1: start[block] as it is).

    A block's start is at first a guess. Blocks whose start turns out to be another are gone through again, until
    all starts are the states that came before: the result of going through all words one after another. States
    are kept relative to their best and no lower than the penalty, so they soon forget where they started.
    """
    redo = np.arange(len(first))
    while len(redo):
        order = redo[np.argsort(-count[redo], kind="stable")]
        state = start[order].copy()
        alive = np.searchsorted(-count[order], -np.arange(count[order[0]]), "left")
        for t in range(count[order[0]]):
            n = alive[t]
            word = first[order[:n]] + way * t
            state[:n] = step(state[:n], word)
            out[word] = state[:n]
        linked = np.flatnonzero(before >= 0)
        b = before[linked]
        new = out[first[b] + way * (count[b] - 1)]
        changed = (new != start[linked]).any(axis=1)
        redo = linked[changed]
        start[redo] = new[changed]


def spans(scores: np.ndarray, doc: np.ndarray, penalty: float, prior: np.ndarray) -> np.ndarray:
    """The most likely language of each word where a change of language costs `penalty`. doc: the text of each word, rising.

    Viterbi in two sweeps (best past and best future of each word and language) over blocks of BLOCK_WORDS words.
    """
    n, k = scores.shape
    if not n:
        return np.zeros(0, np.int64)
    new = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    sizes = np.diff(np.append(new, n))
    blocks = -(-sizes // BLOCK_WORDS)
    text = np.repeat(np.arange(len(new)), blocks)
    place = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    first = new[text] + place * BLOCK_WORDS
    count = np.minimum(sizes[text] - place * BLOCK_WORDS, BLOCK_WORDS)
    index = np.arange(len(text))
    p = np.float32(penalty)

    def step(state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The best way up to a word (from the end: from it on), the word's own score included, relative to the best language's."""
        x = np.maximum(state, -p) + scores[word]
        return x - x.max(axis=1, keepdims=True)

    past, future = np.empty((n, k), np.float32), np.empty((n, k), np.float32)
    start = np.zeros((len(text), k), np.float32)
    start[place == 0] = np.maximum(prior - prior.max(), -p)
    _sweeps(step, first, count, np.where(place > 0, index - 1, -1), start, past, 1)
    last = place == blocks[text] - 1
    _sweeps(step, first + count - 1, count, np.where(last, -1, index + 1), np.zeros((len(text), k), np.float32), future, -1)
    # what lies after a word: the next word's future, and nothing after a text's last
    after = np.zeros((n, k), np.float32)
    inner = np.flatnonzero(doc[1:] == doc[:-1])
    after[inner] = np.maximum(future[inner + 1], -p)
    return (past + after).argmax(axis=1)


def train(labelled: DataFrame) -> Model | None:
    """A model from all rows (text, lang) with a non-null lang, of every label.

    Each task sums counters of its rows; tasks' sums are added by counter, so at most (buckets + scripts) x labels
    numbers come to the driver: about MOST_COUNTERS, or LEAST_BUCKETS a label where there are thousands of them.
    None if no row has a letter.
    """
    labelled = labelled.where("lang is not null").select("text", F.col("lang").cast("string").alias("lang"))
    languages = sorted(r["lang"] for r in labelled.select("lang").distinct().collect())
    if not languages:
        return None
    buckets, k = buckets_for(len(languages)), len(languages)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((buckets + len(SCRIPTS)) * k, np.int64)
        known = {x: i for i, x in enumerate(languages)}
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            own = np.array([known.get(x, -1) for x in batch.column("lang").to_pylist()])
            for i, held in parts_of(texts):
                words = Letters(held)
                lang = own[i + words.doc]
                at = np.repeat(lang, words.lengths + 1)
                for counters, valid in words.grams(buckets):
                    np.add.at(sums, counters[valid] * k + at[valid], 1)
                np.add.at(sums, (buckets + words.script.astype(np.int64)) * k + lang, 1)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some // k), pa.array(some % k), pa.array(sums[some])], names=["counter", "lang", "n"])

    rows = labelled.mapInArrow(count, "counter long, lang long, n long").groupBy("counter", "lang").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((buckets + len(SCRIPTS), k))
    counts[rows["counter"].to_numpy(), rows["lang"].to_numpy()] = rows["n"].to_numpy()
    grams, scripts = counts[:buckets], counts[buckets:]
    if not grams.sum():
        return None
    p = (grams + 0.5) / (grams.sum(axis=0) + 0.5 * buckets)
    log_p = np.log(p)
    log_p -= log_p.mean(axis=1, keepdims=True)
    log_p = np.concatenate((log_p / len(GRAMS), np.zeros((1, k)))).astype(np.float32)  # a last row for strings that leave their word
    seen = scripts.sum(axis=0)
    allowed = scripts >= np.maximum(1, SCRIPT_SHARE * seen)
    allowed[SCRIPTS.index(OTHER)] = True
    prior = np.log(np.maximum(seen, 1) / max(seen.sum(), 1)).astype(np.float32)
    return Model(languages, log_p, allowed, prior)


def predict(docs: DataFrame, model: Model | None, penalty: float = SWITCH_PENALTY, with_spans: bool = False) -> DataFrame:
    """docs (text and any others) with lang_pred, score, n_spans and, with with_spans, spans.

    The words of a text are scored in each language that their script allows; the labels of a text are the best
    path of its words with a penalty a switch. lang_pred is the language of most letters, score their share.
    Spans: (first word, number of words, language). A letter is what Unicode calls one (category L), with the marks
    that follow it; digits are none. A text without letters, or null, is `und` with score 0; ties go to the first
    language by name. Whole texts are labelled, however long: their characters are scored in parts, and a task holds
    a float for each word and language of the text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c != "text"]
    extra = "lang_pred string, score double, n_spans long" + (", spans array<struct<start:bigint,words:bigint,lang:string>>" if with_spans else "")

    def labels(own: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, letters and language of each word of some texts: scored in parts, labelled as whole texts."""
        doc, letters, scores = [], [], []
        for i, held in parts_of(texts):
            words = Letters(held)
            doc.append(i + words.doc)
            letters.append(words.lengths)
            scores.append(own.scores(words))
        d = np.concatenate(doc) if doc else np.zeros(0, np.int64)
        if not len(d):
            return d, d, d
        return d, np.concatenate(letters), spans(np.concatenate(scores), d, penalty, own.prior)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            raw = data.tobytes()
            pred, score, n_spans, lists = [], [], [], []
            for i, j in pieces(offsets):
                m = j - i
                texts = [raw[x:y].decode() for x, y in zip(offsets[i:j].tolist(), offsets[i + 1 : j + 1].tolist(), strict=True)]
                doc, lengths, label = labels(own, texts) if own is not None else [np.zeros(0, np.int64)] * 3
                if not len(doc):
                    pred += [UNDETERMINED] * m
                    score += [0.0] * m
                    n_spans += [0] * m
                    lists += [[]] * m
                    continue
                k = len(own.languages)
                letters = np.bincount(doc * k + label, weights=lengths, minlength=m * k).reshape(m, k)
                total, best = letters.sum(axis=1), letters.argmax(axis=1)
                pred += [own.languages[b] if t else UNDETERMINED for b, t in zip(best.tolist(), total.tolist(), strict=True)]
                score += (letters.max(axis=1) / np.maximum(total, 1)).tolist()
                new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (label[1:] != label[:-1]))))
                n_spans += np.bincount(doc[new], minlength=m).tolist()
                if with_spans:
                    count = np.bincount(doc, minlength=m)
                    begin = new - (np.cumsum(count) - count)[doc[new]]
                    size = np.diff(np.append(new, len(label)))
                    each = [[] for _ in range(m)]
                    for d, b, s, w in zip(doc[new].tolist(), begin.tolist(), size.tolist(), label[new].tolist(), strict=True):
                        each[d].append({"start": b, "words": s, "lang": own.languages[w]})
                    lists += each
            columns = [batch.column(c) for c in names] + [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(n_spans, pa.int64())]
            if with_spans:
                columns.append(pa.array(lists, pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64()), ("lang", pa.string())]))))
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "lang_pred", "score", "n_spans", *(["spans"] if with_spans else [])])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.select(*[F.col(f"`{c}`") for c in names], "text").mapInArrow(emit, f"{kept}, {extra}" if kept else extra)


def identify(docs: DataFrame, with_spans: bool = False) -> DataFrame:
    """Language of each row of docs (doc_id, text, lang): doc_id, held_out, lang_pred, score, n_spans.

    The model learns from the rows with a lang whose crc32(doc_id) mod HELD_OUT_OF is not 0; predictions look at
    the text alone. held_out: that remainder is 0 (false for a null doc_id). Null, empty and letterless texts are `und`; without
    labelled rows all are. Repeated rows get equal results. Other columns are not looked at.
    """
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % HELD_OUT_OF == 0, F.lit(False)).alias("held_out")
    rows = docs.select("doc_id", held_out, "text", "lang")
    return predict(rows.drop("lang"), train(rows.where("not held_out").select("text", "lang")), with_spans=with_spans)
