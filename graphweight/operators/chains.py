"""Shortest import chains, their classification, and the modules that cut them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphweight.storage import written

from .closure import place_of, tree
from .graph import ImportGraph, followed

MAX_CHAINS = 10


@dataclass(frozen=True)
class Target:
    """A package by name, or a module by path."""

    package: str | None = None
    module: str | None = None

    def matches(self, path: str = "path", package: str = "package") -> Column:
        return F.coalesce(F.col(package) == self.package, F.lit(False)) if self.module is None else F.col(path) == self.module


def shortest_dag(graph: ImportGraph, entry: str, target: Target, include_dynamic: bool) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, depth, rank, is_target) up to the level of the first target, and the edges from each level to the next.

    Targets are not passed through; only those of the first level that has one count.
    """
    edges = graph.edges.where(followed(include_dynamic))
    hits = graph.nodes.where(target.matches()).select("path")
    marked = edges.join(hits.withColumnRenamed("path", "src"), "src", "left_anti")
    flags = hits.select(F.col("path").alias("dst"), F.lit(True).alias("_hit"))
    marked = written(marked.join(flags, "dst", "left").withColumn("_hit", F.coalesce("_hit", F.lit(False))))
    found = tree(marked, entry, stop=F.col("is_target"), flag="_hit")  # a level that holds a target ends the traversal
    if not hits.where(F.col("path") == entry).isEmpty():
        found = found.where("depth = 0").withColumn("is_target", F.lit(True))
    marked = marked.drop("_hit")
    first = found.where("is_target").agg(F.min("depth").alias("d")).first()["d"]
    if first is None:
        return found.limit(0), edges.limit(0)
    found = found.where((F.col("depth") < first) | ((F.col("depth") == first) & F.col("is_target")))
    levels = found.select("node", "depth")
    steps = marked.join(levels.select(F.col("node").alias("src"), F.col("depth").alias("_a")), "src")
    steps = steps.join(levels.select(F.col("node").alias("dst"), F.col("depth").alias("_b")), "dst").where("_b = _a + 1")
    return found, written(steps.withColumn("depth", F.col("_b")).drop("_a", "_b"))


def path_counts(graph: ImportGraph, entry: str, target: Target, include_dynamic: bool = False) -> DataFrame:
    """hop_count and path_count (exact, without enumeration) of the shortest chains to the target; no row if there is none."""
    found, steps = shortest_dag(graph, entry, target, include_dynamic)
    deepest = found.agg(F.max("depth").alias("d")).first()["d"]
    if deepest is None:
        return graph.nodes.sparkSession.createDataFrame([], "hop_count int, path_count long")
    ways = graph.nodes.sparkSession.createDataFrame([(entry, 1)], "node string, ways long")
    for depth in range(1, deepest + 1):
        ways = written(ways.join(steps.where(F.col("depth") == depth), F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.sum("ways").alias("ways")))
    return ways.agg(F.lit(deepest).alias("hop_count"), F.sum("ways").cast("long").alias("path_count"))


def all_shortest_chains(graph: ImportGraph, entry: str, target: Target, max_chains: int = MAX_CHAINS, include_dynamic: bool = False) -> DataFrame:
    """Up to max_chains shortest chains: idx, modules, edge_kinds.

    They come in the order of a breadth-first search that goes back from the targets, parents as they were found. Every partial chain
    leads back to the entry, so the first max_chains partial ones of a level are all that is needed of it.
    """
    spark = graph.nodes.sparkSession
    found, steps = shortest_dag(graph, entry, target, include_dynamic)
    deepest = found.agg(F.max("depth").alias("d")).first()["d"]
    shape = "idx int, modules array<string>, edge_kinds array<string>"
    if deepest is None:
        return spark.createDataFrame([], shape)
    order = found.select(F.col("node").alias("src"), F.col("rank").alias("_o"))
    steps = steps.join(order, "src").select("src", "dst", "kind", "depth", F.struct("_o", place_of(steps), "kind").alias("_by"))
    ends = found.where("is_target").orderBy("rank", "node").limit(max_chains)
    partial = written(ends.select(F.row_number().over(W.orderBy("rank", "node")).alias("idx"), F.array("node").alias("modules"), F.array().cast("array<string>").alias("edge_kinds")))
    for depth in range(deepest, 0, -1):
        more = partial.join(steps.where(F.col("depth") == depth), F.get("modules", F.lit(0)) == F.col("dst")).orderBy("idx", "_by").limit(max_chains)
        rank = F.row_number().over(W.orderBy("idx", "_by"))  # of at most max_chains rows
        partial = written(more.select(rank.alias("idx"), F.concat(F.array("src"), "modules").alias("modules"), F.concat(F.array("kind"), "edge_kinds").alias("edge_kinds")))
    return partial


def dedup_by_package(chains: DataFrame, nodes: DataFrame) -> DataFrame:
    """The first of the chains that run through the same packages (modules where there is no package)."""
    steps = chains.select("idx", F.posexplode("modules").alias("at", "path")).join(nodes.select("path", "package"), "path", "left")
    keys = steps.groupBy("idx").agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("at", F.coalesce("package", "path").alias("name")))), lambda s: s["name"])).alias("key"))
    first = keys.groupBy("key").agg(F.min("idx").alias("idx")).select("idx")
    return chains.join(first, "idx", "left_semi")


def classification(kinds: Column) -> Column:
    """all_static (also of no edge), all_dynamic, or mixed with the first dynamic hop."""
    dynamic = F.array_position(kinds, "dynamic")
    kind = F.when(F.forall(kinds, lambda k: k == "static"), "all_static").when(F.forall(kinds, lambda k: k == "dynamic"), "all_dynamic").otherwise("mixed")
    return F.struct(kind.alias("type"), F.when(kind == "mixed", (dynamic - 1).cast("int")).alias("first_dynamic_hop"))


def find_chains(graph: ImportGraph, entry: str, target: Target, include_dynamic: bool = False, max_chains: int = MAX_CHAINS) -> DataFrame:
    """Shortest chains, one for each run of packages, with their classification."""
    chains = dedup_by_package(all_shortest_chains(graph, entry, target, max_chains, include_dynamic), graph.nodes)
    return chains.withColumn("classification", classification(F.col("edge_kinds")))


def module_frequency(chains: DataFrame) -> DataFrame:
    """In how many chains each module stands."""
    return chains.select(F.explode("modules").alias("path")).groupBy("path").agg(F.count("*").alias("chains"))


def cut_candidates(graph: ImportGraph, chains: DataFrame, entry: str, target: Target) -> DataFrame:
    """Modules on every chain, apart from the entry and the target: path, chains_broken, package."""
    total = chains.agg(F.count("*").alias("total"))
    every = module_frequency(chains).join(F.broadcast(total), F.col("chains") == F.col("total"))  # total is one row
    return every.join(graph.nodes, "path").where((F.col("path") != entry) & ~target.matches()).select("path", F.col("chains").alias("chains_broken"), "package")


def cuts(candidates: DataFrame, weights: DataFrame, n_chains: int, top: int = -1) -> DataFrame:
    """path, chains_broken, exclusive_size_bytes: the heaviest module of each package that cuts all chains.

    weights(path, exclusive_size_bytes). Heaviest first; of a single chain the lightest (most surgical) first; ties by path.
    """
    rows = candidates.join(weights, "path", "left").withColumn("exclusive_size_bytes", F.coalesce("exclusive_size_bytes", F.lit(0)))
    best = F.row_number().over(W.partitionBy(F.coalesce("package", F.concat(F.lit("\0"), F.col("path")))).orderBy(F.desc("exclusive_size_bytes"), "path"))
    rows = rows.withColumn("_r", best).where("_r = 1").select("path", "chains_broken", "exclusive_size_bytes")
    rows = rows.orderBy(F.asc("exclusive_size_bytes") if n_chains == 1 else F.desc("exclusive_size_bytes"), "path")
    return rows if top < 0 else rows.limit(top)


def direct_import(chains: DataFrame, no_cuts: bool) -> DataFrame:
    """One row: whether there are chains, no cut, and every chain is one hop."""
    return chains.agg(((F.count("*") > 0) & F.coalesce(F.bool_and(F.size("modules") == 2), F.lit(False)) & F.lit(no_cuts)).alias("direct_import"))
