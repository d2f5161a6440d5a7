"""Queries over one loaded graph."""

from __future__ import annotations

import os
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from graphweight import incremental
from graphweight.errors import EntryNotFound, EntryNotInGraph, TargetIsEntry
from graphweight.functions import scalar as X
from graphweight.operators import chains as C
from graphweight.operators import diff as D
from graphweight.operators.dominators import exclusive_weights
from graphweight.operators.trace import Trace, TraceOptions
from graphweight.project import Loaded, checked_entry, load, project_root
from graphweight.storage import written
from graphweight.streaming.watch import Watch


@dataclass(frozen=True)
class ResolvedTarget:
    target: C.Target
    label: str
    exists: bool


class Session:
    """A graph, its entry, and what was computed of them. Results are kept by entry and dynamic flag, never by what only shapes a report."""

    def __init__(self, spark: SparkSession, loaded: Loaded, use_cache: bool = False):
        self.spark, self.loaded, self.entry, self.use_cache = spark, loaded, loaded.entry, use_cache
        self._traces: dict[str, Trace] = {}
        self._weights: dict[tuple[str, bool], DataFrame] = {}
        self._watch: Watch | None = None

    @classmethod
    def open(cls, spark: SparkSession, entry: str, use_cache: bool = True, root: str | None = None) -> Session:
        entry = checked_entry(entry)
        root = root or project_root(entry)
        return cls(spark, incremental.refreshed(spark, entry, root, use_cache) if use_cache else load(spark, entry, root), use_cache)

    graph = property(lambda self: self.loaded.graph)
    root = property(lambda self: self.loaded.root)

    @cached_property
    def extensions(self) -> list[str]:
        return X.LANGUAGE_EXTENSIONS[self.loaded.language]

    def relative(self, path: str) -> str:
        return path.removeprefix(self.root.rstrip("/") + "/")

    def path_of(self, name: str) -> str:
        """A module by absolute path, path from the current folder, or path from the root."""
        for path in (os.path.abspath(name), os.path.realpath(name), os.path.join(self.root, name)):
            if self.graph.has(path):
                return path
        if any(os.path.exists(p) for p in (name, os.path.join(self.root, name))):
            raise EntryNotInGraph(name)
        raise EntryNotFound(name)

    def set_entry(self, name: str) -> None:
        self.entry = self.path_of(name)

    def entry_label(self, entry: str | None = None) -> str:
        return f"{os.path.basename(self.root)}/{self.relative(entry or self.entry)}"

    def trace(self, entry: str | None = None) -> Trace:
        entry = entry or self.entry
        if entry not in self._traces:
            self._traces[entry] = Trace.of(self.graph, entry)
        return self._traces[entry]

    def weights(self, include_dynamic: bool = False, entry: str | None = None) -> DataFrame:
        key = (entry or self.entry, include_dynamic)
        if key not in self._weights:
            self._weights[key] = written(exclusive_weights(self.graph, *key))
        return self._weights[key]

    def resolve_target(self, name: str) -> ResolvedTarget:
        """A module if it looks like a path and is in the graph, else a package."""
        if not name.startswith("@") and ("/" in name or name.rsplit(".", 1)[-1] in self.extensions and "." in name):
            try:
                path = self.path_of(name)
                return ResolvedTarget(C.Target(module=path), self.relative(path), True)
            except (EntryNotFound, EntryNotInGraph):
                pass
        return ResolvedTarget(C.Target(package=name), name, not self.graph.nodes.where(F.col("package") == name).isEmpty())

    def _not_entry(self, found: ResolvedTarget) -> None:
        if found.target.module == self.entry:
            raise TargetIsEntry(found.label)

    def chain(self, name: str, include_dynamic: bool = False) -> tuple[ResolvedTarget, DataFrame]:
        found = self.resolve_target(name)
        self._not_entry(found)
        return found, written(C.find_chains(self.graph, self.entry, found.target, include_dynamic))

    def cut(self, name: str, include_dynamic: bool = False, top: int = 10) -> tuple[ResolvedTarget, DataFrame, DataFrame, bool]:
        """Target, chains, cut points (the first `top`), and whether the target is imported directly. Emptiness is decided before the cut to `top`."""
        found, chains = self.chain(name, include_dynamic)
        candidates = written(C.cut_candidates(self.graph, chains, self.entry, found.target))
        n = chains.count()
        cuts = C.cuts(candidates, self.weights(include_dynamic), n, top)
        direct = C.direct_import(chains, candidates.isEmpty()).first()["direct_import"]
        return found, chains, cuts, bool(direct)

    def snapshot(self, entry: str | None = None) -> DataFrame:
        return self.trace(entry).snapshot().withColumn("entry", F.lit(self.entry_label(entry)))

    def diff_entry(self, other: str) -> tuple[DataFrame, DataFrame]:
        """Snapshots of this entry and of another file of the graph."""
        return written(self.snapshot()), written(self.snapshot(self.path_of(other)))

    def packages(self, top: int = -1) -> DataFrame:
        return self.graph.packages(top)

    def imports(self, name: str) -> DataFrame:
        return self.graph.imports(self.path_of(name))

    def importers(self, name: str) -> DataFrame:
        return self.graph.importers(self.path_of(name))

    def info(self, package: str) -> Row | None:
        return self.graph.package(package).first()

    def heavy_packages(self, options: TraceOptions = TraceOptions()) -> DataFrame:
        trace = self.trace()
        return trace.with_chains(trace.heavy_packages(options))

    def modules_by_cost(self, include_dynamic: bool = False, top: int = -1) -> DataFrame:
        return self.trace().modules_by_cost(self.weights(include_dynamic), include_dynamic, top)

    def watch(self) -> None:
        self._watch = Watch(self.spark, self.root, self.loaded.language)

    def is_dirty(self) -> bool:
        return self._watch is not None and self._watch.dirty

    def refresh(self) -> bool:
        """Loads the graph again if the tree has changed; whether it did. All that was computed is forgotten then, also if only sizes differ."""
        if self._watch is not None and not self._watch.dirty:
            return False
        before = self.loaded
        self.loaded = incremental.refreshed(self.spark, before.entry, before.root, True) if self.use_cache else load(self.spark, before.entry, before.root)
        self._traces.clear()
        self._weights.clear()
        if self._watch is not None:
            self._watch.refresh()
        if not self.graph.has(self.entry):
            self.entry = self.loaded.entry
        return True


__all__ = ["D", "ResolvedTarget", "Session"]
