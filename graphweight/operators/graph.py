"""The graph as two DataFrames, and what follows from them without traversal."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphweight.schema import DYNAMIC, STATIC
from graphweight.storage import written


def followed(include_dynamic: bool) -> Column:
    """Edges that weights and chains follow: static ones, dynamic ones if asked for, type-only ones never."""
    return F.col("kind").isin([STATIC, DYNAMIC]) if include_dynamic else F.col("kind") == STATIC


def dedup_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (src, dst, kind): the first in source order, with its specifier."""
    return edges.groupBy("src", "dst", "kind").agg(F.min_by("specifier", "ord").alias("specifier"), F.min("ord").alias("ord"))


@dataclass
class ImportGraph:
    """nodes(path, size_bytes, package) and edges(src, dst, kind, specifier, ord)."""

    nodes: DataFrame
    edges: DataFrame

    @classmethod
    def of(cls, nodes: DataFrame, edges: DataFrame) -> ImportGraph:
        """Of raw tables: nodes once a path, edges once a (src, dst, kind)."""
        return cls(nodes.dropDuplicates(["path"]), dedup_edges(edges))

    def stored(self) -> ImportGraph:
        """The same graph, computed once."""
        return ImportGraph(written(self.nodes), written(self.edges))

    def with_ids(self) -> DataFrame:
        """nodes with dense ids in the order of the paths.

        A rank over all rows needs their global order: they are range-partitioned and sorted, and each partition's
        ids start after the rows of those before it.
        """
        rows = written(self.nodes.repartitionByRange(F.col("path")).sortWithinPartitions("path").withColumn("_p", F.spark_partition_id()))
        sizes = rows.groupBy("_p").agg(F.count("*").alias("n"))
        starts = sizes.withColumn("_start", F.coalesce(F.sum("n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
        own = F.row_number().over(W.partitionBy("_p").orderBy("path"))
        return rows.join(starts, "_p").select((F.col("_start") + own - 1).cast("long").alias("id"), "path", "size_bytes", "package")

    def edge_counts(self) -> DataFrame:
        return self.edges.groupBy("kind").agg(F.count("*").alias("edges"), F.countDistinct("src").alias("sources"))

    def dangling(self) -> DataFrame:
        """Edges whose target is no node."""
        return self.edges.join(self.nodes.select(F.col("path").alias("dst")), "dst", "left_anti")

    def with_leaves(self, sizes: DataFrame) -> ImportGraph:
        """Targets that are no node become leaves, with the size that sizes(path, size_bytes, package) has for them, else 0."""
        missing = self.dangling().select(F.col("dst").alias("path")).distinct()
        leaves = missing.join(sizes, "path", "left").select("path", F.coalesce("size_bytes", F.lit(0)).cast("long").alias("size_bytes"), "package")
        return ImportGraph(self.nodes.unionByName(leaves), self.edges)

    def packages(self, top: int = -1) -> DataFrame:
        """Size and files of each package over the whole graph, largest first, ties by name; top: -1 all, 0 none."""
        found = self.nodes.where("package is not null").groupBy(F.col("package").alias("name"))
        found = found.agg(F.sum("size_bytes").alias("total_size_bytes"), F.count("*").alias("file_count"), F.min("path").alias("entry_module"))
        return top_rows(found, top, F.desc("total_size_bytes"), F.asc("name"))

    def package(self, name: str) -> DataFrame:
        return self.packages().where(F.col("name") == name)

    def imports(self, path: str) -> DataFrame:
        """What a module imports: path, kind, in source order."""
        out = self.edges.where(F.col("src") == path).join(self.nodes, F.col("dst") == F.col("path"))
        return out.select("path", "kind", "ord").orderBy("ord", "path", "kind").drop("ord")

    def importers(self, path: str) -> DataFrame:
        """The modules that import a module: path, kind."""
        out = self.edges.where(F.col("dst") == path).join(self.nodes, F.col("src") == F.col("path"))
        return out.select("path", "kind").orderBy("path", "kind")

    def has(self, path: str) -> bool:
        return not self.nodes.where(F.col("path") == path).isEmpty()


def top_rows(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows in that order; -1 for all."""
    df = df.orderBy(*order)
    return df if n < 0 else df.limit(n)
