"""Quality rules by distribution divergence, with DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import row_of, written
from .textscan import BLANKS

#: Frequent function words of four languages; those of other labels are learned. "de", "en", "la", "un" and others serve several.
COMMON = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "was", "on", "are", "as", "with", "be", "by", "at", "from", "this", "or"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "sur", "au", "il", "pas", "avec"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "al", "lo"],
}
WORDS = sorted({w for words in COMMON.values() for w in words})
#: One letter stands for each common word, so that counts are lengths of strings.
CODES = {w: chr(0x21 + i) if 0x21 + i < 0x7F else chr(0x100 + i) for i, w in enumerate(WORDS)}
SYMBOLS = r"[#*$%&|<>]"
CLASSES = ("upper", "lower", "wide", "digit", "mark", "symbol", "rest", "blank")
#: Classes whose shares differ by script and language; a text without a label is not judged by how they are dealt.
OF_SCRIPT = ("upper", "lower", "wide", "blank")
#: Common words learned for a label outside COMMON.
MOST_COMMON = 21

MIN_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8
#: Guards: a histogram of fewer items is not judged.
MIN_CHARS, MIN_COMMON_OF_WORDS = 300, 80
#: Largest Jensen-Shannon distances (square root of the divergence in bits) from the language's reference.
MOST_CHAR_DISTANCE, MOST_WORD_DISTANCE = 0.28, 0.30


def with_features(docs: DataFrame, keep: list[str], learned: DataFrame | None = None) -> DataFrame:
    """keep and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, _n (characters), _chars and _commons (histograms).

    learned (learned_words()): documents of its languages have _commons of that language's words. Words are not exploded into rows: everything about a document is computed in its row.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    chars = lambda pattern: F.length("_t") - F.length(F.regexp_replace("_t", pattern, ""))
    if learned is not None:
        docs = docs.join(learned, "lang", "left")
    df = docs.select(*keep, text.alias("_t"), *(["_own"] if learned is not None else []))
    df = df.withColumn("_w", F.array_remove(F.split("_t", BLANKS), ""))
    df = df.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    df = df.withColumn("_x", F.transform(F.slice("_h", 1, F.greatest(F.size("_h") - (WINDOW - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(F.col("_h"), i + k) for k in range(1, WINDOW)])))
    # places of windows found twice: equal neighbours once (digest, place) pairs are sorted; only texts with a repeated window sort
    twice = F.size(F.array_distinct("_x")) < F.size("_x")
    pairs = F.array_sort(F.transform("_x", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    df = df.withColumn("_p", F.when(twice, pairs).otherwise(F.array().cast("array<struct<x:bigint,i:int>>")))
    again = F.filter("_p", lambda p, i: (F.get(F.col("_p"), i + 1)["x"] == p["x"]) | ((i > 0) & (F.get(F.col("_p"), F.greatest(i - 1, F.lit(0)))["x"] == p["x"])))
    df = df.withColumn("_a", F.array_sort(F.transform(again, lambda p: p["i"])))
    steps = F.transform("_a", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_a"), i + 1) - p, F.lit(WINDOW))))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.length(F.regexp_replace(x, BLANKS, "")) > 0)
    common = F.filter(F.transform("_w", F.lower), lambda w: w.isin(WORDS))
    codes = F.create_map(*[F.lit(x) for w in WORDS for x in (w, CODES[w])])
    places = F.filter(F.transform("_w", lambda w: F.array_position(F.col("_own"), F.lower(w))), lambda p: p > 0)
    df = df.select(
        *keep,
        *(["_own", places.alias("_places")] if learned is not None else []),
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.length("_t").cast("long").alias("_n"),
        chars(SYMBOLS).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
        F.coalesce(F.aggregate(steps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"),
        chars("[A-Z]+").alias("_upper"),
        chars("[0-9]+").alias("_digit"),
        chars("[.,;:!?'\"()\\-]+").alias("_mark"),
        chars("[^\\x00-\\x7F]+").alias("_wide"),
        chars("[@_/\\\\+=~^`{}\\[\\]\\x00-\\x08\\x0E-\\x1F\\x7F]+").alias("_rest"),
        F.array_join(F.transform(common, lambda w: F.try_element_at(codes, w)), "").alias("_c"),
    )
    blank = F.col("_n") - F.col("word_chars")
    known = {"upper": F.col("_upper"), "wide": F.col("_wide"), "digit": F.col("_digit"), "mark": F.col("_mark"), "symbol": F.col("n_symbols"), "rest": F.col("_rest"), "blank": blank}
    known["lower"] = F.col("_n") - sum(known.values())
    own = [(F.length("_c") - F.length(F.replace(F.col("_c"), F.lit(c)))).cast("double") for c in CODES.values()]
    commons = F.array(*own, (F.col("n_words") - F.length("_c")).cast("double"))
    if learned is not None:
        each = F.transform("_own", lambda _, i: F.size(F.filter("_places", lambda p: p == i + 1)).cast("double"))
        commons = F.when(F.col("_own").isNull(), commons).otherwise(F.concat(each, F.array((F.col("n_words") - F.size("_places")).cast("double"))))
    return df.select(
        *keep,
        "n_words", "word_chars", "n_symbols", "_n", F.monotonically_increasing_id().alias("_row_no"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.array(*[known[c].cast("double") for c in CLASSES]).alias("_chars"),
        commons.alias("_commons"),
    )


def once() -> Column:
    """Always true. A filter with it is not moved below the features, which would compute them again inside the filter."""
    return F.col("_row_no") >= 0


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def learned_words(docs: DataFrame) -> DataFrame | None:
    """(lang, _own): the MOST_COMMON words of largest mean share in the documents of each label outside COMMON. None without such labels."""
    others = docs.where(F.col("lang").isNotNull() & ~F.col("lang").isin(list(COMMON)))
    if others.select("lang").isEmpty():
        return None
    good = with_features(others, ["lang", "text"]).where(~base_failed() & (F.col("n_words") >= MIN_COMMON_OF_WORDS) & once())
    each = good.select("lang", "n_words", F.explode(F.array_remove(F.split("text", BLANKS), "")).alias("w"))
    shares = each.groupBy("lang", F.lower("w").alias("w")).agg(F.round(F.sum(1 / F.col("n_words")), 9).alias("x"))
    first = shares.withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("x"), "w"))).where(F.col("i") <= MOST_COMMON)
    return written(first.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "w"))), lambda s: s["w"]).alias("_own")))


def language_references(features: DataFrame) -> DataFrame:
    """(lang, _q_chars, _q_commons): character-class and common-word distribution of each label, from all its documents that pass the base rules.

    Each document counts as one distribution, so that no long one decides. Languages without such documents have no reference.
    """
    good = features.where(F.col("lang").isNotNull() & ~base_failed() & (F.col("n_words") >= MIN_COMMON_OF_WORDS) & once())
    shares = F.concat(F.transform("_chars", lambda x: x / F.col("_n")), F.transform("_commons", lambda x: x / F.col("n_words")))
    means = good.select("lang", F.posexplode(shares).alias("i", "x")).groupBy("lang", "i").agg(F.avg("x").alias("x"))
    rows = means.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("x"))
    n = len(CLASSES)
    return written(rows.select("lang", F.slice("x", 1, n).alias("_q_chars"), F.slice("x", n + 1, F.size("x") - n).alias("_q_commons")))


def pooled(chars: Column) -> Column:
    """Histogram of the classes with those of OF_SCRIPT as one."""
    at = {c: F.get(chars, i) for i, c in enumerate(CLASSES)}
    return F.array(sum((at[c] for c in OF_SCRIPT[1:]), at[OF_SCRIPT[0]]), *[at[c] for c in CLASSES if c not in OF_SCRIPT])


def js_distance(counts: Column, total: Column, reference: Column) -> Column:
    """Jensen-Shannon distance, in bits, of a histogram (and its sum) from a distribution of as many bins. 0 for an empty histogram."""

    def part(c: Column, q: Column) -> Column:
        p = c / total
        half = (p + q) / 2
        return F.when(p > 0, p * F.log2(p / half)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / half)).otherwise(0.0)

    divergence = F.aggregate(F.zip_with(counts, reference, part), F.lit(0.0), lambda a, x: a + x) / 2
    return F.when(total > 0, F.sqrt(F.greatest(divergence, F.lit(0.0)))).otherwise(0.0)


def with_verdict(features: DataFrame, references: DataFrame) -> DataFrame:
    """Adds base_failed, char_distance, word_distance and kept. A distance from a reference that there is not is 0."""
    shared = references.select(F.posexplode(pooled(F.col("_q_chars"))).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("x")).orderBy("i").collect()
    out = features.join(references, "lang", "left").withColumn("base_failed", base_failed())
    unlabelled = js_distance(pooled(F.col("_chars")), F.col("_n"), F.array(*[F.lit(r["x"]) for r in shared])) if shared else F.lit(0.0)
    out = out.withColumn("char_distance", F.when(F.col("lang").isNull(), unlabelled).otherwise(js_distance(F.col("_chars"), F.col("_n"), F.col("_q_chars"))))
    out = out.withColumn("word_distance", js_distance(F.col("_commons"), F.col("n_words"), F.col("_q_commons")))
    far = (F.col("word_chars") >= MIN_CHARS) & (F.col("char_distance") > MOST_CHAR_DISTANCE)
    far = far | ((F.col("n_words") >= MIN_COMMON_OF_WORDS) & (F.col("word_distance") > MOST_WORD_DISTANCE))
    return out.withColumn("kept", ~F.col("base_failed") & ~far)


RESULT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance"]


def quality(docs: DataFrame) -> DataFrame:
    """Base counts and verdict of each row of docs (doc_id, text, lang): columns doc_id and RESULT.

    Base rules: fewer than MIN_WORDS words, or more than MOST_REPEATED % of the words in 8-word windows found
    twice or more. The method: the histograms of character classes and of common words must lie near the
    reference of the document's language, in Jensen-Shannon distance; texts below the guards are not judged by
    it, nor those of a label without a reference. Where lang is null, only the shares of digits, marks, symbols and
    the rest are compared, with the mean of all references, since they say nothing of the language. References are
    learned from all labelled documents, and so are the common words of labels outside COMMON.

    Null and empty texts have no words and fail the base rules. Repeated rows get equal results. Other columns are
    not looked at, whatever their names. An empty table gives an empty one.
    """
    docs = docs.select("doc_id", "text", "lang")
    features = written(with_features(docs, ["doc_id", "lang"], learned_words(docs)))
    return with_verdict(features, language_references(features)).select("doc_id", *RESULT)


def good_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that quality() keeps, with their columns. The rows are written beside their features, which are dear to compute: once, and no text is shuffled."""
    row = docs.select(row_of(docs).alias("_row"), "text", "lang")
    features = written(with_features(row, ["_row", "lang"], learned_words(docs.select("text", "lang"))))
    kept = with_verdict(features, language_references(features)).where("kept")
    return kept.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
