"""Scalar functions as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Node's built-in modules.
NODE_BUILTINS = (
    "assert async_hooks buffer child_process cluster console constants crypto dgram diagnostics_channel dns domain events fs http http2 https inspector module net os path "
    "perf_hooks process punycode querystring readline repl stream string_decoder sys test timers tls trace_events tty url util v8 vm wasi worker_threads zlib"
).split()
LANGUAGE_EXTENSIONS = {"typescript": ["ts", "tsx", "js", "jsx", "mjs", "cjs", "mts", "cts"], "python": ["py"]}
# Files and folders that a watch looks for or skips.
LOCKFILES = ["package-lock.json", "pnpm-lock.yaml", "yarn.lock", "bun.lockb", "poetry.lock", "Pipfile.lock", "uv.lock", "requirements.txt"]
UNWATCHED = ["node_modules", ".git", "__pycache__", ".graphweight", "target"]


def size_text(n: int) -> str:
    if n >= 1_000_000:
        return f"{n / 1_000_000:.1f} MB"
    return f"{n / 1_000:.0f} KB" if n >= 1_000 else f"{n} B"


def format_size(n: Column) -> Column:
    """Bytes in decimal units, half to even on the binary value: 1 digit for MB, none for KB."""

    @F.pandas_udf("string")
    def formatted(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if pd.isna(x) else size_text(int(x)))

    return formatted(n)


def parse_size(text: Column) -> Column:
    """Bytes of a size with the unit MB, KB, B or none, cut to whole bytes; null if it is no size."""
    t = F.trim(text)
    unit = F.regexp_extract(t, r"(MB|KB|B)?$", 1)
    factor = F.when(unit == "MB", 1e6).when(unit == "KB", 1e3).otherwise(1.0)
    number = F.trim(F.regexp_replace(t, r"(MB|KB|B)$", "")).try_cast("double")
    return F.when(number * factor < 9.2e18, F.floor(F.greatest(number, F.lit(0.0)) * factor).cast("long"))


def relative_path(path: Column, root: str) -> Column:
    """The path below root, unchanged outside of it; whole components only."""
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substring(path, F.lit(len(prefix) + 1), F.length(path))).otherwise(path)


def display_name(path: Column, package: Column, root: str) -> Column:
    return F.coalesce(package, relative_path(path, root))


def package_relative_path(path: Column, package: Column) -> Column:
    """The path from the last place where its components are the package's name (both parts of a scoped one); else the file name."""
    parts, name = F.split(path, "/"), F.split(package, "/")
    found = F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: (F.get(parts, i) == F.get(name, F.lit(0))) & ((F.size(name) < 2) | F.coalesce(F.get(parts, i + 1) == F.get(name, F.lit(1)), F.lit(False))))
    last = F.array_max(found)
    return F.when(last.isNotNull(), F.array_join(F.slice(parts, last + 1, F.size(parts)), "/")).otherwise(F.element_at(parts, -1))


def node_package(path: Column) -> Column:
    """Package of a file under the last node_modules folder, scoped names in two parts; null if there is none, and for a .pnpm store itself."""
    name = F.regexp_extract(path, r"^(?:.*/)?node_modules/((?:@[^/]+/)?[^/]+)(?:/|$)", 1)
    return F.when((name != "") & (name != ".pnpm"), name)


def python_package(path: Column, site_dirs: Sequence[str]) -> Column:
    """Package of a file under the first of the site folders that holds it: its first component, C extensions up to the first dot."""
    out = F.lit(None).cast("string")
    for folder in reversed(list(site_dirs)):
        prefix = folder.rstrip("/") + "/"
        first = F.element_at(F.split(F.substring(path, F.lit(len(prefix) + 1), F.length(path)), "/"), 1)
        name = F.when(first.endswith(".dist-info") | first.endswith(".egg-info"), None)
        name = name.when(first.endswith(".so") | first.endswith(".pyd"), F.element_at(F.split(first, "\\."), 1)).otherwise(first)
        out = F.when(path.startswith(prefix), name).otherwise(out)
    return out


def is_node_builtin(specifier: Column) -> Column:
    """A built-in module by name, with or without the node: prefix, or an internal one with it."""
    return specifier.isin(NODE_BUILTINS) | specifier.isin([f"node:{x}" for x in NODE_BUILTINS]) | specifier.startswith("node:internal/")


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^./]+)$", 1)


def looks_like_path(text: Column, extensions: Sequence[str]) -> Column:
    """Not a scoped package, and has a folder or a source file's extension."""
    return ~text.startswith("@") & (text.contains("/") | extension(text).isin(list(extensions)))


def is_relevant_event(path: Column, extensions: Sequence[str]) -> Column:
    """Whether a changed file can change the graph."""
    parts = F.split(path, "/")
    return ~F.arrays_overlap(parts, F.array(*[F.lit(x) for x in UNWATCHED])) & (F.element_at(parts, -1).isin(LOCKFILES) | extension(path).isin(list(extensions)))


def entry_label(root: Column, relative: Column) -> Column:
    return F.concat_ws("/", F.element_at(F.split(root, "/"), -1), relative)


def python_version(config: Column) -> Column:
    """major.minor of the version line of a pyvenv.cfg."""
    version = F.regexp_extract(config, r"(?m)^\s*version(?:_info)?\s*=\s*(\d+\.\d+)", 1)
    return F.when(version != "", version)


def format_time(ns: Column) -> Column:
    """A duration in ns, us, ms or s."""
    text = lambda digits, factor, unit: F.concat(F.format_string(f"%.{digits}f", ns / factor), F.lit(unit))
    return F.when(ns < 1e3, text(0, 1.0, "ns")).when(ns < 1e6, text(1, 1e3, "us")).when(ns < 1e9, text(1, 1e6, "ms")).otherwise(text(2, 1e9, "s"))


def plural(n: Column) -> Column:
    return F.when(n == 1, "").otherwise("s")
