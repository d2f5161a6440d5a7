"""Main text of web pages, with a suffix array for each host's boilerplate."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import NULL_ID, written
from .textscan import Digests, byte_digests, covered, flat, signed

#: A string of so many words is boilerplate if it stands in this share of a host's distinct pages, and in so many of them at least.
MIN_TOKENS, SHARE, MIN_PAGES = 6, 0.5, 4
#: Pages of a host that one suffix array holds.
CHUNK = 64

# HTML elements by kind, and words of class, id and role attributes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg iframe object canvas title textarea select audio video".split())
DROPPED = frozenset("head nav header footer aside form button dialog menu fieldset label option datalist".split()) | RAW
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark math menclose mfrac mi mn mo mover mpadded mroot mrow mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover q rp rt ruby s samp small span strike strong sub sup td th time tt u var wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SPACED = frozenset("br td th img".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table tbody thead tfoot select article main section div body nav aside header footer form blockquote td th".split())
HINTS = frozenset(
    "ad ads adbox advert advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert banner menu nav navbar navigation breadcrumb breadcrumbs "
    "pagination pager sidebar aside widget widgets footer header masthead comment comments commentlist disqus respond reply replies discussion share sharing social newsletter subscribe subscription signup "
    "login search popup modal overlay related recommended toolbar complementary contentinfo".split()
)
#: Words that may stand beside a hint in one class name: `ad-slot` and `related-posts` are set aside, `related-work` is not.
BESIDE = frozenset(
    "area bar block body bottom box btn button buttons center col column container content desktop float form global group holder icon icons inner item items label left line link links list main mobile page panel "
    "articles posts stories primary right row secondary section site slot sticky tag text title top unit wrap wrapper zone 1 2 3 4 5".split()
)
_TAG = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<(script|style|noscript|template|svg|iframe|object|canvas|title|textarea|select|audio|video)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:/>|>(?:.*?</\1\s*>|.*\Z)|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S | re.I,
)
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_PARTS = re.compile(r"[_\-]+")


def _sets_aside(name: str) -> bool:
    """Whether a class, id or role is made of hints, and words that may stand beside them."""
    parts = [p for p in _PARTS.split(name) if p]
    return not HINTS.isdisjoint(parts) and all(p in HINTS or p in BESIDE for p in parts)


def _hinted(name: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element's attributes mark it as something beside the text; whether they mark the main text."""
    aside = main = False
    for m in _ATTR.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" and "=" not in m[0] or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            aside = True
        elif key == "role" and value == "main":
            main = True
        elif key in ("class", "id", "role"):
            aside = aside or any(map(_sets_aside, value.split()))
    return aside, main


def blocks(html: str) -> list[str]:
    """Texts of a page's blocks that the markup does not set aside, in page order: those of its article, or of the whole page if it marks none.

    Set aside are menus, headers, footers, sidebars, forms, scripts, styles and hidden elements, by element, and
    notices, adverts and comments by the words of their class, id or role. Unclosed and overlapping elements end
    with what holds them.
    """
    main: list[str] = []
    loose: list[str] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # element, set aside, in the article; as they hold inside it
    off = inside = heading = False
    position = 0

    def end_block() -> None:
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            parts.clear()
            if text:
                if inside and (not off or heading):
                    main.append(text)
                elif not off:
                    loose.append(text)

    for m in _TAG.finditer(html):
        if m.start() > position:
            parts.append(html[position : m.start()])
        position = m.end()
        name = m[3] or m[6]
        if not name:
            continue
        name = name.lower()
        closing = (m[2] or m[5]) == "/"
        if name in SPACED:
            parts.append(" ")
        if name not in INLINE:
            end_block()
        if name in VOID:
            continue
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    if any(x[1] != off or x[2] != inside for x in stack[i:]) or i and (stack[i - 1][1] != off or stack[i - 1][2] != inside) or not i and (off or inside):
                        end_block()
                    del stack[i:]
                    off, inside = (stack[-1][1], stack[-1][2]) if stack else (False, False)
                    break
                if name in INLINE and stack[i][0] not in INLINE:
                    break  # an inline end tag does not close blocks
            if name in HEADINGS:
                heading = False
            continue
        if name not in INLINE:
            closed = CLOSES.get(name, set()) | {"p"}
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in closed:
                    del stack[i:]
                    break
                if stack[i][0] in SCOPES:
                    break
            off, inside = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        attributes = m[4] or m[7] or ""
        hinted, is_main = _hinted(name, attributes) if attributes and not attributes.isspace() else (False, False)
        if name in ("html", "body", "main") or name == "article" and not inside:
            hinted = False
        now_off = off or hinted or name in DROPPED
        if name in INLINE and now_off != off:
            end_block()
        inside = inside or (name in ("article", "main") or is_main) and not now_off
        heading = name in HEADINGS and inside and bool(stack) and stack[-1][0] == "header" or heading and name in INLINE
        off = now_off
        stack.append((name, off, inside))
    parts.append(html[position:])
    end_block()
    return main or loose


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def tokens_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the words of a page's blocks, one after another, and the block of each."""
    words = [t.split() for t in texts]
    column = pa.array([w for ws in words for w in ws], pa.string())
    data, offsets = flat(column)
    return byte_digests(data).of(offsets[:-1], offsets[1:]), np.repeat(np.arange(len(words)), [len(w) for w in words])


def coded(tokens: np.ndarray) -> np.ndarray:
    """Tokens in 16 bits, to be dealt out. Strings of few tokens that differ seldom get equal codes; what is found by codes is counted by full digests."""
    return (tokens >> np.uint64(48)).astype("<u2")


def windows_of(tokens: np.ndarray, n: int) -> np.ndarray:
    """Digest of every n words."""
    return signed(Digests(tokens).windows(n)) if len(tokens) >= n else np.zeros(0, np.int64)


def suffix_array(tokens: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Places of a concatenation of streams, sorted by the `depth` (or more) tokens that follow in their stream.

    Prefix doubling: ranks by 1, 2, 4, ... tokens; a stream's end is less than any token. ends: the end of the stream of each place.
    """
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1
    length = 1
    while length < depth:
        ahead = np.arange(n) + length
        second = np.where(ahead < ends, rank[np.minimum(ahead, n - 1)], 0)
        rank = np.unique(rank * (n + 2) + second, return_inverse=True)[1].astype(np.int64) + 1
        length *= 2
    return np.argsort(rank, kind="stable")


def repeated_strings(streams: list[np.ndarray], min_tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the strings of min_tokens tokens that stand in two or more of the streams, and in how many.

    Neighbours of the suffix array that agree in min_tokens tokens are an interval; its distinct streams are counted.
    """
    sizes = np.array([len(s) for s in streams])
    tokens = np.concatenate(streams)
    page, ends = np.repeat(np.arange(len(sizes)), sizes), np.repeat(np.cumsum(sizes), sizes)
    whole = windows_of(tokens, min_tokens)
    order = suffix_array(tokens, ends, min_tokens)
    order = order[order + min_tokens <= ends[order]]
    if not len(order):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = whole[order]
    interval = np.cumsum(np.concatenate(([True], key[1:] != key[:-1]))) - 1
    pairs = np.unique(interval * len(sizes) + page[order])
    count = np.bincount(pairs // len(sizes), minlength=interval[-1] + 1)
    first = np.searchsorted(interval, np.arange(interval[-1] + 1))
    often = count > 1
    return key[first[often]], count[often]


def without(texts: list[str], boilerplate: np.ndarray, min_tokens: int) -> list[str]:
    """Blocks without the words that strings of boilerplate cover; what is left of a block is joined by spaces.

    A covered run goes if it holds min_tokens words of a block or the whole block: a repeated string that reaches a
    word or two into the next block cuts nothing there.
    """
    tokens, block = tokens_of(texts)
    at = np.flatnonzero(np.isin(windows_of(tokens, min_tokens), boilerplate))
    if not len(at):
        return texts
    gone = covered(at, at + min_tokens, len(tokens))
    out, first = [], np.searchsorted(block, np.arange(len(texts) + 1))
    for text, x, y in zip(texts, first[:-1].tolist(), first[1:].tolist(), strict=True):
        if not gone[x:y].any():
            out.append(text)
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([False], gone[x:y], [False])).astype(np.int8)))
        words, kept, position = text.split(), [], 0
        for b, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if e - b >= min_tokens or e - b == y - x:
                kept += words[position:b]
                position = e
        kept += words[position:]
        if kept:
            out.append(" ".join(kept))
    return out


def boilerplate(streams: DataFrame, min_tokens: int = MIN_TOKENS, share: float = SHARE, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, strings): digests of the strings of min_tokens words that stand in enough of a host's distinct pages.

    streams(host, stream, lead, n_tokens, texts). Pages with the same stream count once; lead: the row is the first
    of its stream in its task, so that of many copies a few are dealt out. The distinct pages of a host are dealt
    by hash into chunks of CHUNK, each with a suffix array of its own. A string of `share` of all pages has that
    share in some chunk, so what a chunk finds that often are the candidates of the host (few: each needs its share
    of the pages). Candidates are then counted over all pages.
    """
    leads = streams.where(F.col("lead") & (F.col("n_tokens") >= min_tokens)).select("host", "stream", "texts")
    hosts = written(leads.select("host", "stream").distinct().groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [coded(tokens_of(texts)[0]).tobytes() for texts in batch.column("texts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("stream"), pa.array(codes, pa.binary())], names=["host", "stream", "codes"])

    pages = leads.mapInArrow(code, "host string, stream long, codes binary").join(hosts, "host").withColumn("chunk", F.pmod(F.xxhash64("stream"), F.ceil(F.col("n") / CHUNK)).cast("int"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(host: str, held: dict[int, np.ndarray], n: int) -> pa.RecordBatch:
            strings, count = repeated_strings(list(held.values()), min_tokens)
            strings = strings[count >= max(share * len(held), min_pages if n <= CHUNK else 2)]
            return pa.RecordBatch.from_arrays([pa.array([host] * len(strings), pa.string()), pa.array(strings)], names=["host", "string"])

        now, held, size = None, {}, 0
        for batch in batches:
            for host, chunk, n, stream, codes in zip(*(batch.column(c).to_pylist() for c in ("host", "chunk", "n", "stream", "codes")), strict=True):
                if now != (host, chunk):
                    if len(held) > 1:
                        yield found(now[0], held, size)
                    now, held, size = (host, chunk), {}, n
                held[stream] = np.frombuffer(codes, "<u2").astype(np.uint64)
        if len(held) > 1:
            yield found(now[0], held, size)

    dealt = pages.repartition("host", "chunk").sortWithinPartitions("host", "chunk")
    candidates = written(dealt.mapInArrow(search, "host string, string long").distinct())
    lists = written(candidates.groupBy("host").agg(F.sort_array(F.collect_list("string")).alias("strings")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for host, stream, texts, strings in zip(*(batch.column(c).to_pylist() for c in ("host", "stream", "texts", "strings")), strict=True):
                tokens = tokens_of(texts)[0]
                like = np.isin(windows_of(coded(tokens).astype(np.uint64), min_tokens), np.array(strings, np.int64))
                own = np.unique(windows_of(tokens, min_tokens)[like])
                rows += [(host, stream, x) for x in own.tolist()]
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["host", "stream", "string"])

    counted = leads.join(lists, "host").select("host", "stream", "texts", "strings").mapInArrow(count, "host string, stream long, string long").distinct().groupBy("host", "string").agg(F.count("*").alias("k"))
    often = counted.join(hosts, "host").where((F.col("k") >= F.col("n") * share) & (F.col("k") >= min_pages))
    return written(often.groupBy("host").agg(F.sort_array(F.collect_list("string")).alias("strings")))


def main_text(pages: DataFrame, min_tokens: int = MIN_TOKENS, share: float = SHARE, min_pages: int = MIN_PAGES) -> DataFrame:
    """Main text of each row of pages (page_id, url, html): page_id, url, text, n_chars.

    The markup sets aside menus, headers, footers, sidebars, notices, adverts, forms, scripts and comments; a page
    with an article (or main element) keeps the blocks of it, another all that is left. Then, on every page, what is
    boilerplate of its host goes: the words covered by strings of min_tokens words that stand in `share` of the
    host's distinct pages, and in min_pages at least, found by suffix arrays of the pages' token streams
    (boilerplate()). Text that fewer pages share, such as a quotation, a reprint or a teaser, stays.

    Blocks are joined by one line end, character references decoded, white space made one space. Null and empty html
    gives an empty text; cut-off html is read as far as it goes. Repeated rows get equal results and count as one
    page, as do pages with the same words; pages without a url are one host; a null page_id is returned as null.
    Other columns are not looked at. An empty table gives an empty one.
    """
    rows = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(NULL_ID)).alias("page"), "url", "html")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int]] = set()
        for batch in batches:
            texts = [blocks(html or "") for html in batch.column("html").to_pylist()]
            words = [tokens_of(t)[0] for t in texts]
            keys = [(host_of(url), int(signed(Digests(w).of(np.array([0]), np.array([len(w)])))[0])) for url, w in zip(batch.column("url").to_pylist(), words, strict=True)]
            lead = []
            for key in keys:
                lead.append(key not in seen)
                seen.add(key)
            columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array(lead, pa.bool_()), pa.array([len(w) for w in words], pa.int64()), pa.array(texts, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("page"), batch.column("url"), *columns], names=["page", "url", "host", "stream", "lead", "n_tokens", "texts"])

    streams = written(rows.mapInArrow(parse, "page long, url string, host string, stream long, lead boolean, n_tokens long, texts array<string>"))
    marks = boilerplate(streams, min_tokens, share, min_pages)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = ["\n".join(texts if strings is None else without(texts, np.array(strings, np.int64), min_tokens)) for texts, strings in zip(batch.column("texts").to_pylist(), batch.column("strings").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page", "url", "text", "n_chars"])

    out = streams.join(marks, "host", "left").select("page", "url", "texts", "strings").mapInArrow(cut, "page long, url string, text string, n_chars long")
    return out.select(F.nullif(F.col("page"), F.lit(NULL_ID)).alias("page_id"), "url", "text", "n_chars")
