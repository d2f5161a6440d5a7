"""A dependency graph of a source tree."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweight.errors import EntryIsDirectory, EntryNotFound, UnsupportedFileType
from graphweight.extract.files import as_rows, extract
from graphweight.functions import scalar as X
from graphweight.operators.closure import reach
from graphweight.operators.graph import ImportGraph, dedup_edges
from graphweight.resolve.node_paths import resolve_node
from graphweight.resolve.probing import resolved
from graphweight.resolve.python_paths import SearchPath, search_path
from graphweight.sources.git_tree import blob_contents, git_tree, repo_root
from graphweight.sources.local_tree import local_tree, with_content
from graphweight.storage import written

# Files that mark a project's root.
ROOT_MARKS = {"typescript": ("package.json",), "python": ("pyproject.toml", "setup.py", "setup.cfg")}


def language_of(path: str) -> str:
    extension = path.rsplit(".", 1)[-1] if "." in os.path.basename(path) else ""
    for language, extensions in X.LANGUAGE_EXTENSIONS.items():
        if extension in extensions:
            return language
    raise UnsupportedFileType(path)


def checked_entry(path: str) -> str:
    real = os.path.realpath(path)
    if os.path.isdir(real):
        raise EntryIsDirectory(path)
    if not os.path.exists(real):
        raise EntryNotFound(path)
    language_of(real)
    return real


def project_root(entry: str) -> str:
    """The nearest folder above with a root mark of the entry's language, else the entry's folder."""
    marks = ROOT_MARKS[language_of(entry)]
    folder = home = os.path.dirname(entry)
    while True:
        if any(os.path.isfile(os.path.join(folder, m)) for m in marks):
            return folder
        if os.path.dirname(folder) == folder:
            return home
        folder = os.path.dirname(folder)


@dataclass
class Tree:
    """A listing (path, is_dir, size, mtime_nanos) and a way to read some of its files (path, content)."""

    listing: DataFrame
    blobs: DataFrame | None = None
    repo: str | None = None

    @classmethod
    def local(cls, spark: SparkSession, root: str) -> Tree:
        return cls(written(local_tree(spark, root)))

    @classmethod
    def at_commit(cls, spark: SparkSession, ref: str, root: str) -> Tree:
        repo = repo_root(root)
        listing, blobs = git_tree(spark, repo, ref, repo)
        return cls(written(listing), written(blobs), repo)

    def read(self, paths: DataFrame) -> DataFrame:
        if self.blobs is None:
            return with_content(paths)
        return blob_contents(self.blobs.join(paths.select("path"), "path", "left_semi"), self.repo)


@dataclass
class Loaded:
    """A graph and what was met while it was built."""

    root: str
    entry: str
    language: str
    graph: ImportGraph
    imports: DataFrame  #: path, ord, specifier, kind, resolved
    unresolvable: DataFrame  #: path, count
    unresolved: DataFrame  #: specifier
    warnings: DataFrame  #: path, message
    files: DataFrame  #: path, size_bytes, mtime_nanos
    from_cache: bool = False


def workspace_names(modules: DataFrame, manifests: DataFrame, root: str) -> DataFrame:
    """path, workspace: the name in the nearest package.json above a module, that of the project's root excepted."""
    folder = lambda c: F.regexp_replace(c, "/[^/]*$", "")
    named = manifests.where(F.col("path") != f"{root}/package.json").select(folder("path").alias("above"), F.get_json_object(F.col("content").cast("string"), "$.name").alias("workspace")).where("workspace is not null")
    parts = F.split(folder("path"), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return modules.select("path", F.explode(above).alias("above")).join(named, "above").groupBy("path").agg(F.max_by("workspace", F.length("above")).alias("workspace"))


def load(spark: SparkSession, entry: str, root: str | None = None, tree: Tree | None = None, sites: list[str] | None = None) -> Loaded:
    """The graph of all that an entry imports, of every kind and at any distance.

    Source files of the tree outside of installed packages are read at once; installed packages are followed from what
    they are asked for, a level at a time. Targets that are not source files, and files that cannot be read, are
    leaves with their size (folders 0).
    """
    if tree is None:
        entry = checked_entry(entry)
    language = language_of(entry)
    root = root or project_root(entry)
    tree = tree or Tree.local(spark, root)
    listing = tree.listing
    extensions = X.LANGUAGE_EXTENSIONS[language]
    paths = search_path(root, sites) if language == "python" else None
    outside = [s for s in (paths.sites if paths else ()) if not s.startswith(root.rstrip("/") + "/")]
    for site in outside:
        listing = listing.unionByName(Tree.local(spark, site).listing)
    if outside:
        listing = written(listing.dropDuplicates(["path"]))
    sources = listing.where(~F.col("is_dir") & X.extension(F.col("path")).isin(extensions))
    installed = _installed(language, paths)
    manifests = written(tree.read(listing.where("path like '%/package.json' and not is_dir").select("path"))) if language == "typescript" else None

    def parsed(files: DataFrame) -> tuple[DataFrame, DataFrame]:
        found = written(extract(tree.read(files)))
        questions = as_rows(found).withColumn("folder", F.regexp_replace("path", "/[^/]*$", ""))
        answers = resolve_node(questions, listing, manifests) if language == "typescript" else _resolve_python(questions, listing, paths)
        rows = questions.join(answers, ["folder", "specifier"], "left").select("path", "ord", "specifier", "kind", "resolved")
        return found, written(rows)

    found, rows = parsed(sources.where(~installed | (F.col("path") == entry)).select("path"))
    done = sources.where(~installed | (F.col("path") == entry)).select("path")
    while True:
        edges = rows.where("resolved is not null").select(F.col("path").alias("src"), F.col("resolved").alias("dst"))
        reached = written(reach(edges, spark.createDataFrame([(entry,)], "node string")).select(F.col("node").alias("path")))
        more = reached.join(sources.select("path"), "path", "left_semi").join(done, "path", "left_anti")
        more = written(more)
        if more.isEmpty():
            break
        new_found, new_rows = parsed(more)
        found, rows = found.unionByName(new_found), rows.unionByName(new_rows)
        done = done.unionByName(more)
    own = reached
    imports = rows.join(own, "path", "left_semi")
    package = X.node_package(F.col("path")) if language == "typescript" else X.python_package(F.col("path"), list(paths.sites))
    sizes = listing.select("path", F.when(F.col("is_dir"), 0).otherwise(F.col("size")).cast("long").alias("size_bytes"), "mtime_nanos")
    nodes = own.join(sizes, "path", "left").withColumn("size_bytes", F.coalesce("size_bytes", F.lit(0)))
    nodes = nodes.withColumn("package", package)
    if language == "typescript":
        nodes = nodes.join(workspace_names(own, manifests, root), "path", "left").withColumn("package", F.coalesce("package", "workspace")).drop("workspace")
    nodes = written(nodes.withColumn("package", F.when(F.col("path") != entry, F.col("package"))))
    edges = dedup_edges(imports.where("resolved is not null").select(F.col("path").alias("src"), F.col("resolved").alias("dst"), "kind", "specifier", "ord"))
    about = found.join(own, "path", "left_semi")
    return Loaded(
        root, entry, language,
        ImportGraph(nodes.select("path", "size_bytes", "package"), written(edges)),
        imports,
        about.where("unresolvable > 0").select("path", F.col("unresolvable").alias("count")),
        imports.where("resolved is null").select("specifier").distinct(),
        about.where("warning is not null").select("path", F.col("warning").alias("message")),
        nodes.select("path", "size_bytes", "mtime_nanos"),
    )


def _installed(language: str, paths: SearchPath | None) -> Column:
    if language == "typescript":
        return F.col("path").contains("/node_modules/")
    out = F.lit(False)
    for site in paths.sites:
        out = out | F.col("path").startswith(site.rstrip("/") + "/")
    return out


def _resolve_python(questions: DataFrame, fs: DataFrame, paths: SearchPath) -> DataFrame:
    return resolved(questions, fs, paths.probes, paths.decide)
