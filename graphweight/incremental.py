"""A stored graph, and what has to be done to use it again."""

from __future__ import annotations

import json
import os
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweight.extract.files import extract
from graphweight.functions.scalar import LOCKFILES
from graphweight.operators.graph import ImportGraph
from graphweight.project import Loaded, Tree, load

FORMAT = 1
FOLDER = ".graphweight"
TABLES = ("nodes", "edges", "imports", "unresolvable", "unresolved", "warnings", "files")


def sentinels(root: str) -> dict[str, int]:
    """Lockfiles of the nearest folder above that has any, with their times."""
    folder = root
    while True:
        found = {p: os.stat(p).st_mtime_ns for n in LOCKFILES if os.path.isfile(p := os.path.join(folder, n))}
        if found or os.path.dirname(folder) == folder:
            return found
        folder = os.path.dirname(folder)


def save(loaded: Loaded) -> None:
    """Tables and a manifest under the root, in a new folder that takes the old one's place."""
    home = os.path.join(loaded.root, FOLDER)
    new = f"{home}-{uuid.uuid4().hex}"
    tables = {"nodes": loaded.graph.nodes, "edges": loaded.graph.edges, "imports": loaded.imports, "unresolvable": loaded.unresolvable, "unresolved": loaded.unresolved, "warnings": loaded.warnings, "files": loaded.files}
    for name in TABLES:
        tables[name].write.parquet(f"{new}/{name}")
    with open(f"{new}/manifest.json", "w", encoding="utf-8") as file:
        json.dump({"format": FORMAT, "entry": loaded.entry, "language": loaded.language, "sentinels": sentinels(loaded.root)}, file)
    shutil.rmtree(home, ignore_errors=True)
    os.rename(new, home)


def stored(spark: SparkSession, root: str, entry: str) -> tuple[Loaded, dict] | None:
    """The stored graph of an entry; None if there is none, or one of another entry or format, or a damaged one."""
    home = os.path.join(root, FOLDER)
    try:
        with open(f"{home}/manifest.json", encoding="utf-8") as file:
            about = json.load(file)
        if about["format"] != FORMAT or about["entry"] != entry or not all(os.path.isdir(f"{home}/{t}") for t in TABLES):
            return None
        t = {name: spark.read.parquet(f"{home}/{name}") for name in TABLES}
    except (OSError, ValueError, KeyError, TypeError):
        return None
    except Exception as error:  # noqa: BLE001  a table that Spark cannot open is no cache
        if "AnalysisException" not in type(error).__name__:
            raise
        return None
    loaded = Loaded(root, entry, about["language"], ImportGraph(t["nodes"], t["edges"]), t["imports"], t["unresolvable"], t["unresolved"], t["warnings"], t["files"], from_cache=True)
    return loaded, about


def changes(old: DataFrame, listing: DataFrame) -> DataFrame:
    """path, state (missing or changed) of the stored files(path, size_bytes, mtime_nanos) that are not as they were."""
    now = listing.select("path", F.when(F.col("is_dir"), 0).otherwise(F.col("size")).alias("_size"), F.col("mtime_nanos").alias("_mtime"), F.lit(True).alias("_there"))
    both = old.join(now, "path", "left")
    changed = (F.col("size_bytes") != F.col("_size")) | ~F.col("mtime_nanos").eqNullSafe(F.col("_mtime"))
    return both.withColumn("state", F.when(F.col("_there").isNull(), "missing").when(changed, "changed")).where("state is not null").select("path", "state", F.col("_size").alias("size_bytes"), F.col("_mtime").alias("mtime_nanos"))


def same_imports(loaded: Loaded, changed: DataFrame, tree: Tree) -> bool:
    """Whether the changed files import what they did: the same specifiers and kinds in the same order."""
    new = extract(tree.read(changed)).select("path", "imports")
    old = loaded.imports.join(changed, "path", "left_semi").groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "specifier", "kind"))), lambda x: F.struct(x["specifier"].alias("specifier"), x["kind"].alias("kind"))).alias("before"))
    return new.join(old, "path", "left").where(~F.col("imports").eqNullSafe(F.coalesce("before", F.array().cast("array<struct<specifier:string,kind:string>>")))).isEmpty()


def refreshed(spark: SparkSession, entry: str, root: str, use_cache: bool = True) -> Loaded:
    """The graph of an entry, from the store as far as that still holds.

    A missing file, or imports that could not be resolved while lockfiles have changed, means a new build; files of
    new size or time are read again, and if their imports are the same only sizes are replaced.
    """
    found = stored(spark, root, entry) if use_cache else None
    if found:
        loaded, about = found
        tree = Tree.local(spark, root)
        changed = changes(loaded.files.where(F.col("path").startswith(root + "/")), tree.listing).cache()
        states = {r["state"] for r in changed.select("state").distinct().collect()}
        unmoved = about["sentinels"] == sentinels(root)
        if "missing" not in states and (unmoved or loaded.unresolved.isEmpty()):
            if not states:
                return loaded
            if same_imports(loaded, changed.select("path"), tree):
                new = changed.select("path", F.col("size_bytes").alias("_size"), F.col("mtime_nanos").alias("_mtime"))
                sizes = lambda df: df.join(new, "path", "left").withColumn("size_bytes", F.coalesce("_size", "size_bytes")).drop("_size")
                files = sizes(loaded.files).withColumn("mtime_nanos", F.coalesce("_mtime", "mtime_nanos")).drop("_mtime")
                loaded.graph = ImportGraph(sizes(loaded.graph.nodes).drop("_mtime"), loaded.graph.edges)
                loaded.files = files
                save(loaded)
                again = stored(spark, root, entry)
                return again[0] if again else loaded
    loaded = load(spark, entry, root)
    if use_cache:
        save(loaded)
    return loaded
