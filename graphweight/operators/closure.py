"""Reachability by frontier: one job a level, each level a written table."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweight.storage import release, written

#: The tables of so many levels are made one.
FOLD = 8


def by_level(first: DataFrame, step: Callable[[DataFrame], DataFrame], keys: Sequence[str], seen: DataFrame | None = None, stop: Column | None = None) -> DataFrame:
    """All levels, from the first on; step gives what a level leads to, of which what was not visited is the next level (its column depth is set here).

    It ends after a level with a row that meets stop, or when a level is empty.
    """
    union = lambda frames: reduce(DataFrame.unionByName, frames)
    frontier = written(first.withColumn("depth", F.lit(0)))
    tables = [frontier]
    for depth in count(1):
        if stop is not None and not frontier.where(stop).isEmpty():
            break
        visited = union([t.select(*keys) for t in ([] if seen is None else [seen]) + tables])
        level = written(step(frontier, visited).withColumn("depth", F.lit(depth)))
        if level.isEmpty():
            release(level)
            break
        if len(tables) == 1 and frontier is not tables[0]:
            release(frontier)
        frontier = level
        tables.append(level)
        if len(tables) > FOLD:
            whole = written(union(tables))
            release(*tables[:-1])
            tables = [whole]
    return union(tables)


def reach(edges: DataFrame, seeds: DataFrame, group: Sequence[str] = (), seen: DataFrame | None = None, keep: Column | None = None, stop: Column | None = None) -> DataFrame:
    """Nodes that the edges(src, dst) reach from the seeds(*group, node), by level: *group, node, depth.

    Each group is a traversal of its own. seen(*group, node): nodes that count as visited already and are not
    returned. keep: a condition on (*group, node) that entered nodes must meet. The traversal ends after a level with
    a node that meets stop, or when a level is empty. A level joins the frontier with the edges and drops what was
    visited by an anti-join; both are equi-joins that adapt to sizes and skew. Nothing is collected.
    """
    keys = [*group, "node"]
    start = seeds.select(*keys).distinct()
    if keep is not None:
        start = start.where(keep)
    if seen is not None:
        start = start.join(seen.select(*keys), keys, "left_anti")
    hops = edges.select(F.col("src").alias("node"), "dst")

    def step(frontier: DataFrame, visited: DataFrame) -> DataFrame:
        found = frontier.join(hops, "node").select(*group, F.col("dst").alias("node"))
        return (found if keep is None else found.where(keep)).distinct().join(visited, keys, "left_anti")

    return by_level(start, step, keys, seen, stop)


def place_of(edges: DataFrame) -> Column:
    """What orders the edges of a source: their place in it, their target's path where there is none."""
    return F.coalesce(F.lpad(F.col("ord").cast("string"), 12, "0"), F.col("dst")) if "ord" in edges.columns else F.col("dst")


def tree(edges: DataFrame, entry: str, stop: Column | None = None, flag: str | None = None) -> DataFrame:
    """Breadth-first tree from the entry: node, depth, parent (the first to reach it), rank and is_target.

    is_target: the boolean column `flag` of the edges that lead to the node (false without one, and for the entry).

    rank sorts the nodes of a level as a queue would: by their first parent's, then by the edge's place in the
    source. A level is range-partitioned by it, so no task holds a level.
    """
    hops = edges.select(F.col("src").alias("node"), "dst", place_of(edges).alias("place"), (F.col(flag) if flag else F.lit(False)).alias("hit"))
    first = edges.sparkSession.createDataFrame([(entry,)], "node string").select("node", F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("rank"), F.lit(False).alias("is_target"))

    def step(frontier: DataFrame, visited: DataFrame) -> DataFrame:
        found = frontier.join(hops, "node").select(F.col("dst").alias("_n"), F.struct("rank", "place", F.col("node").alias("parent"), "hit").alias("by"))
        best = found.groupBy(F.col("_n").alias("node")).agg(F.min("by").alias("by")).join(visited, "node", "left_anti")
        order = ["by.rank", "by.place", "node"]
        return best.repartitionByRange(*map(F.col, order)).sortWithinPartitions(*order).select("node", "by.parent", F.monotonically_increasing_id().alias("rank"), F.col("by.hit").alias("is_target"))

    return by_level(first, step, ["node"], None, stop)


def lineage(found: DataFrame, ends: DataFrame) -> DataFrame:
    """ends(node, ...) with chain: the path from the root of a tree() to the node. Only the ends' ancestors are joined."""
    names = ends.columns
    up = found.select(F.col("node").alias("_up"), F.col("parent").alias("_next"))
    rows = ends.withColumn("_up", F.col("node")).withColumn("chain", F.array().cast("array<string>"))
    while True:
        for _ in range(FOLD):
            rows = rows.join(up, "_up", "left").select(*names, F.col("_next").alias("_up"), F.when(F.col("_up").isNull(), F.col("chain")).otherwise(F.concat(F.array("_up"), "chain")).alias("chain"))
        rows = written(rows)
        if rows.where("_up is not null").isEmpty():
            return rows.drop("_up")


def static_closure(edges: DataFrame, seeds: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """What the seeds(*group, node) reach by static edges: *group, node, depth."""
    return reach(edges.where("kind = 'static'"), seeds, group)


def dynamic_closure(edges: DataFrame, static: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """What only dynamic edges add to a static closure: *group, node, depth from the first dynamic edge's target."""
    loose = edges.where("kind = 'dynamic'").select("src", "dst").join(static.select(*group, F.col("node").alias("src")), "src").select(*group, F.col("dst").alias("node"))
    return reach(edges.where("kind in ('static', 'dynamic')"), loose, group, seen=static)
