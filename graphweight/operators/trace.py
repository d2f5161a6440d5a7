"""What an entry point weighs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweight.storage import written

from .closure import dynamic_closure, lineage, reach, static_closure, tree
from .graph import ImportGraph, followed, top_rows


@dataclass(frozen=True)
class TraceOptions:
    include_dynamic: bool = False
    top_n: int = 10
    ignore: Sequence[str] = field(default_factory=tuple)


@dataclass
class Trace:
    """Closures of one entry, and all that is derived from them. top_n and ignore only shape heavy_packages."""

    graph: ImportGraph
    entry: str

    @classmethod
    def of(cls, graph: ImportGraph, entry: str) -> Trace:
        return cls(graph, entry)

    @classmethod
    def both(cls, graph: ImportGraph, a: str, b: str) -> tuple[Trace, Trace]:
        """Traces of two entries, from one traversal of (entry, node) pairs for static and one for dynamic edges."""
        seeds = graph.nodes.sparkSession.createDataFrame([(a, a), (b, b)], "entry string, node string").distinct()
        static = written(static_closure(graph.edges, seeds, ["entry"]))
        dynamic = dynamic_closure(graph.edges, static, ["entry"])
        out = []
        for entry in (a, b):
            one = cls(graph, entry)
            one.static, one.dynamic_only = (one._sized(x.where(F.col("entry") == entry).drop("entry")) for x in (static, dynamic))
            out.append(one)
        return out[0], out[1]

    def _sized(self, found: DataFrame) -> DataFrame:
        return written(found.join(self.graph.nodes.withColumnRenamed("path", "node"), "node"))

    @cached_property
    def static(self) -> DataFrame:
        """node, depth, size_bytes, package of what static edges reach. Traversed when first asked for."""
        seeds = self.graph.nodes.sparkSession.createDataFrame([(self.entry,)], "node string")
        return self._sized(static_closure(self.graph.edges, seeds))

    @cached_property
    def dynamic_only(self) -> DataFrame:
        """The same of what dynamic edges add."""
        return self._sized(dynamic_closure(self.graph.edges, self.static))

    def reached(self, include_dynamic: bool = False) -> DataFrame:
        """node, depth, size_bytes, package, phase (0 static, 1 added by dynamic edges)."""
        static = self.static.withColumn("phase", F.lit(0))
        return static.unionByName(self.dynamic_only.withColumn("phase", F.lit(1))) if include_dynamic else static

    def static_summary(self) -> DataFrame:
        """static_weight, static_module_count; dynamic edges are not followed."""
        return _weigh(self.static, "static_weight", "static_module_count")

    def dynamic_summary(self) -> DataFrame:
        """dynamic_only_weight, dynamic_only_module_count."""
        return _weigh(self.dynamic_only, "dynamic_only_weight", "dynamic_only_module_count")

    def summary(self, include_dynamic: bool = False) -> DataFrame:
        """static_weight, static_module_count, dynamic_only_weight, dynamic_only_module_count. With dynamic edges included the latter are 0."""
        rows = self.reached(True)
        first = rows if include_dynamic else rows.where("phase = 0")
        if include_dynamic:
            return _weigh(first, "static_weight", "static_module_count").withColumns({"dynamic_only_weight": F.lit(0).cast("long"), "dynamic_only_module_count": F.lit(0).cast("long")})
        size = lambda phase: F.coalesce(F.sum(F.when(F.col("phase") == phase, F.col("size_bytes"))), F.lit(0)).cast("long")
        number = lambda phase: F.count(F.when(F.col("phase") == phase, 1))
        return rows.agg(size(0).alias("static_weight"), number(0).alias("static_module_count"), size(1).alias("dynamic_only_weight"), number(1).alias("dynamic_only_module_count"))

    def packages(self, include_dynamic: bool = False) -> DataFrame:
        """name, total_size_bytes, file_count of each package that is reached."""
        rows = self.reached(include_dynamic).where("package is not null")
        return rows.groupBy(F.col("package").alias("name")).agg(F.sum("size_bytes").alias("total_size_bytes"), F.count("*").alias("file_count"))

    def dynamic_packages(self) -> DataFrame:
        """name, total_size_bytes over what only dynamic edges reach, whether they are included or not."""
        return self.dynamic_only.where("package is not null").groupBy(F.col("package").alias("name")).agg(F.sum("size_bytes").alias("total_size_bytes"))

    def heavy_packages(self, options: TraceOptions = TraceOptions()) -> DataFrame:
        """The largest packages, ties by name; ignored ones are left out here and nowhere else."""
        rows = self.packages(options.include_dynamic)
        if options.ignore:
            rows = rows.where(~F.col("name").isin(list(options.ignore)))
        return top_rows(rows, options.top_n, F.desc("total_size_bytes"), F.asc("name"))

    def with_chains(self, packages: DataFrame) -> DataFrame:
        """packages(name, ...) with the chain to the first module of each that a static search meets; an empty one if it is reached only dynamically."""
        found = tree(self.graph.edges.where(followed(False)), self.entry)
        own = self.graph.nodes.where("package is not null").select(F.col("path").alias("node"), F.col("package").alias("name"))
        first = found.join(own, "node").join(packages.select("name"), "name", "left_semi").groupBy("name").agg(F.min_by("node", F.struct("depth", "rank")).alias("node"))
        out = packages.join(lineage(found, first).drop("node"), "name", "left").withColumn("chain", F.coalesce("chain", F.array().cast("array<string>")))
        return out.orderBy(F.desc("total_size_bytes"), "name")

    def modules_by_cost(self, weights: DataFrame, include_dynamic: bool = False, top: int = -1) -> DataFrame:
        """path, exclusive_size_bytes of first-party modules other than the entry, heaviest first; of all modules if none is first-party.

        weights(path, exclusive_size_bytes)."""
        rows = self.reached(include_dynamic).where(F.col("node") != self.entry)
        own = rows.where("package is null")
        rows = rows if own.isEmpty() else own
        rows = rows.join(weights.withColumnRenamed("path", "node"), "node")
        out = rows.select(F.col("node").alias("path"), "exclusive_size_bytes", "phase", "depth").orderBy(F.desc("exclusive_size_bytes"), "phase", "depth", "path").drop("phase", "depth")
        return out if top < 0 else out.limit(top)

    def exceeds(self, threshold: int) -> DataFrame:
        """One row: static_weight, threshold, exceeded."""
        return self.static_summary().select("static_weight", F.lit(threshold).cast("long").alias("threshold"), (F.col("static_weight") > threshold).alias("exceeded"))

    def snapshot(self) -> DataFrame:
        """One row in the shape of schema.SNAPSHOT, of all packages: the form that is saved. Within an engine, compare the tables (operators.diff.sections)."""
        size = F.sum("size_bytes").alias("size")
        sums = self.reached(True).groupBy("phase", "package").agg(size)
        names = lambda phase: F.map_from_entries(F.sort_array(F.collect_list(F.when((F.col("phase") == phase) & F.col("package").isNotNull(), F.struct("package", "size")))))
        total = lambda phase: F.coalesce(F.sum(F.when(F.col("phase") == phase, F.col("size"))), F.lit(0)).cast("long")
        return sums.agg(F.lit(self.entry).alias("entry"), total(0).alias("static_weight"), names(0).alias("packages"), total(1).alias("dynamic_weight"), names(1).alias("dynamic_packages"))


def _weigh(rows: DataFrame, weight: str, number: str) -> DataFrame:
    return rows.agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("long").alias(weight), F.count("*").alias(number))


def transitive_importers(graph: ImportGraph, path: str, include_dynamic: bool = False) -> DataFrame:
    """Everything that reaches a module: node, depth."""
    edges = graph.edges.where(followed(include_dynamic)).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reach(edges, edges.sparkSession.createDataFrame([(path,)], "node string"))
