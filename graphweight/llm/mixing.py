"""Mixing sources to target weights, with DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import row_of
from .textscan import WORD

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2
SEED = 17
#: Hash-random keys are summed in two levels of 2**RANGE_BITS ranges each.
RANGE_BITS = 10
KEY_BITS = 60


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_key(*values: Column) -> Column:
    """The first KEY_BITS bits of the MD5 digest of the values, joined by bars (null: empty), as a number. Other engines have this digest too."""
    joined = F.concat_ws("|", *[F.coalesce(v.cast("string"), F.lit("")) for v in values])
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")


def source_targets(totals: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Sources in code point order, null last, have the weights in turn and share `share` times all sizes. A target
    stops at `most` times its source's size; the excess is shared again by weight until no target is above. With
    the sources in the order of size per weight, those that stop come first; the level of the others is what is
    left per weight left, at the first source that stays below its stop. One row a source: a small table.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % len(weights) + 1).cast("int"))
    rows = totals.select("source", "source_size", weight.alias("_w"), F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())).alias("_r"))
    order = W.orderBy(F.col("source_size") / F.col("_w"), "_r")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    all_size, all_weight = F.sum("source_size").over(everything), F.sum("_w").over(everything)
    left = F.lit(share) * all_size - F.lit(float(most)) * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    level = left / (all_weight - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    rows = rows.withColumn("_level", level)
    open_ = F.col("_w") * F.col("_level") <= F.lit(float(most)) * F.col("source_size")
    rows = rows.withColumn("_level", F.min_by(F.when(open_, F.col("_level")), F.when(open_, F.struct(F.col("source_size") / F.col("_w"), F.col("_r")))).over(everything))
    target = F.least(F.lit(float(most)) * F.col("source_size"), F.col("_w") * F.coalesce("_level", F.lit(float("inf"))))
    return rows.select("source", "source_size", F.when(F.col("source_size") > 0, target).otherwise(0.0).alias("target"))


def mix_sources(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS, seed: int = SEED, keep: Sequence[str] = ()) -> DataFrame:
    """How much of each document a mix of the sources takes.

    docs: doc_id, source, text (and the columns named in keep). Returns per row doc_id, size (words of the text),
    source_size, target, taken, and those of keep. Each row gets a hash-random key from its doc_id, its text and the seed, so that rows with
    a null or the same doc_id are dealt out as well; within a source rows stand in the order of the keys, and the first whole epochs and then the rows up to the
    source's exact budget are taken, the last one in part. So the taken words of a source are its target, rounded
    down, and reruns agree.

    The prefix sums are made in two levels of 2**RANGE_BITS key ranges, summed before they are shuffled, and
    then within a range; no task holds a source. Null texts and texts without words have size 0 and nothing
    taken; a null source is a source; repeated rows stand side by side (they are alike, so any order gives the same
    rows). An empty table gives an empty one.
    """
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), hash_key(F.lit(seed), F.col("doc_id"), F.col("text")).alias("_k"), *keep)
    part = lambda level: F.shiftright("_k", KEY_BITS - RANGE_BITS * level).bitwiseAND((1 << RANGE_BITS) - 1)
    rows = rows.withColumns({"_b1": part(1), "_b2": part(2)})
    fine = rows.groupBy("source", "_b1", "_b2").agg(F.sum("size").alias("_s"))
    coarse = fine.groupBy("source", "_b1").agg(F.sum("_s").alias("_s"))
    ahead = lambda *by: W.partitionBy("source", *by[:-1]).orderBy(by[-1]).rowsBetween(W.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    coarse = coarse.withColumn("_p1", F.coalesce(F.sum("_s").over(ahead("_b1")), none)).drop("_s")
    fine = fine.withColumn("_p2", F.coalesce(F.sum("_s").over(ahead("_b1", "_b2")), none)).drop("_s")
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)

    def joined(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        """An inner join on keys that may be null."""
        other = right.select(*[F.col(c).alias(f"_j{c}") if c in on else F.col(c) for c in right.columns])
        same = F.lit(True)
        for c in on:
            same = same & left[c].eqNullSafe(other[f"_j{c}"])
        return left.join(other, same).drop(*[f"_j{c}" for c in on])

    starts = joined(joined(fine, coarse, ["source", "_b1"]), targets, ["source"])
    out = joined(rows, starts, ["source", "_b1", "_b2"])
    within = W.partitionBy("source", "_b1", "_b2").orderBy("_k", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    out = out.withColumn("_before", F.col("_p1") + F.col("_p2") + F.coalesce(F.sum("size").over(within), none))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size") - F.col("_before")
    taken = epochs * F.col("size") + F.greatest(none, F.least(F.col("size"), rest))
    return out.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), *keep)


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    return F.array_join(F.slice(F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), F.lit(1), n.cast("int")), "")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows repeated by epoch, the row at a source's cut shortened to the words it may give, untaken rows left out.

    Returns the columns of docs; n_chars, where there is one, is that of the text given. Rows without words are
    not taken.
    """
    plan = mix_sources(docs.select("doc_id", "source", "text", row_of(docs).alias("_row")), keep=["_row"], **options)
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0)
    part = F.col("taken") - whole * F.col("size")
    copies = F.concat(F.array_repeat(F.lit(-1).cast("long"), whole.cast("int")), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<long>")))
    out = plan.where("taken > 0").withColumn("_cut", F.explode(copies))
    text = F.when(F.col("_cut") < 0, F.col("_row.text")).otherwise(first_words(F.col("_row.text"), F.col("_cut")))
    out = out.withColumn("_text", text)
    new = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return out.select(*[new.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns])
