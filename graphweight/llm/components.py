"""Connected components of an edge table by label spreading with pointer jumping, on DataFrames alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges(u, v) of longs to (node, root): root is the least node that links reach.

    Each round replaces every edge by one between the least neighbours of its ends (large star, then small star),
    which keeps the components and halves the depth, until all edges are stars around their least node. A round
    aggregates with partial minima and joins them, read back as a table, with the edges; both sides are plain
    exchanges, so that the edges of a hub spread over tasks (adaptive skew join).
    Nodes without an edge do not appear. Nothing is collected but one count a round.
    """
    now = written(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct())
    state = _state(now)
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("u"), "v").where("u < v")  # larger neighbours go to the least one
        large = written(large.distinct())
        lower = written(large.groupBy("v").agg(F.min("u").alias("m")))  # smaller neighbours go to the least one
        small = large.join(lower, "v").select(F.col("m").alias("u"), F.explode(F.array("v", F.col("u"))).alias("v")).where("u < v").distinct()
        now, before = written(small), state
        state = _state(now)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("root")).unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
