"""Queries over small fixed inputs, for what no table of the driver can feed: sources, imports, resolution, reports, the shell.

Each query is an operator of the engine over the fixture; its SQL is the list of the rows that are to come out.
"""

from __future__ import annotations

import json
import os
import subprocess
import tempfile
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import cache
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweight import cli, incremental, report
from graphweight.errors import GraphError
from graphweight.extract.files import as_rows, extract
from graphweight.functions import scalar as X
from graphweight.functions import stats as M
from graphweight.operators import chains as C
from graphweight.operators import diff as D
from graphweight.operators.dominators import exclusive_weights
from graphweight.operators.graph import ImportGraph
from graphweight.operators.trace import Trace, TraceOptions
from graphweight.project import Tree, checked_entry, load, project_root
from graphweight.resolve.node_paths import resolve_node
from graphweight.resolve.probing import resolved
from graphweight.resolve.python_paths import SearchPath, search_path
from graphweight.schema import SNAPSHOT
from graphweight.session import Session
from graphweight.sources.git_tree import blob_contents, classify, commit_of, git_tree, is_git_repo
from graphweight.sources.local_tree import local_tree, with_content
from graphweight.storage import shared_folder, written
from graphweight.streaming.watch import events, relevant

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
NODES, LINKS = "path string, size_bytes long, package string", "src string, dst string, kind string, specifier string, ord long"


def _literal(x: Any) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, (int, float)):
        return repr(x)
    return "'" + str(x).replace("'", "''") + "'"


def fixed(shape: str, rows: Sequence[Sequence[Any]]) -> Callable[[Query], Query]:
    """Registers a query with the rows that it must give, as SQL. shape: names and DuckDB types."""

    def register(function: Query) -> Query:
        names = [part.split()[0] for part in shape.split(", ")]
        casts = ", ".join(f"CAST({n} AS {part.split()[1]}) AS {n}" for n, part in zip(names, shape.split(", "), strict=True))
        body = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
        QUERIES[function.__name__] = function
        ORACLES[function.__name__] = f"SELECT {casts} FROM (VALUES {body}) t({', '.join(names)})"
        return function

    return register


def _table(spark: SparkSession, shape: str, rows: Sequence[Sequence[Any]]) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rows], shape)


def _graph(spark: SparkSession, nodes: str, edges: str) -> ImportGraph:
    """nodes: `name size [package]` separated by commas; edges: `a>b` static, `a~b` dynamic, `a?b` type-only."""
    rows = [(p[0], int(p[1]), p[2] if len(p) > 2 else None) for p in (n.split() for n in nodes.split(","))]
    links = []
    for i, e in enumerate(edges.split()):
        mark = next(c for c in ">~?" if c in e)
        a, b = e.split(mark)
        links.append((a, b, {">": "static", "~": "dynamic", "?": "type_only"}[mark], f"./{b}", i))
    return ImportGraph.of(_table(spark, NODES, rows), _table(spark, LINKS, links)).stored()


#: name: nodes, edges (all start at e).
GRAPHS = {
    "linear": ("e 100,b 200,c 300", "e>b b>c"),
    "dynamic": ("e 100,b 200,c 300,t 7", "e>b e~c b?t"),
    "reached_both_ways": ("e 1,a 2,b 4,c 8", "e~a e>b b>a a~c"),
    "cycle": ("e 1,a 2,b 4", "e>a a>b b>a b>e"),
    "alone": ("e 9,x 1", "x>e"),
}


@fixed("graph VARCHAR, static_weight BIGINT, static_module_count BIGINT, dynamic_only_weight BIGINT, dynamic_only_module_count BIGINT", [
    ("linear", 600, 3, 0, 0), ("dynamic", 300, 2, 300, 1), ("reached_both_ways", 7, 3, 8, 1), ("cycle", 7, 3, 0, 0), ("alone", 9, 1, 0, 0),
])
def f01_weights(spark, sf_dir):
    """Static and dynamic-only weight: type-only edges never count, what static edges reach is not dynamic."""
    return _union(_each(lambda name, g: Trace.of(_graph(spark, *g), "e").summary().select(F.lit(name).alias("graph"), "*"), GRAPHS))


def _each(function: Callable[..., Any], cases: dict[str, Any]) -> list:
    """function(name, case) of all cases, several at a time: small jobs."""
    with ThreadPoolExecutor(6) as pool:
        return list(pool.map(function, cases, cases.values()))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


@fixed("id BIGINT, path VARCHAR, size_bytes BIGINT, package VARCHAR", [(0, "a", 1, None), (1, "b", 7, "p"), (2, "c", 0, None)])
def f02_leaves_and_ids(spark, sf_dir):
    """Nodes once a path; targets that are no node become leaves, with their size where it is known; ids by path."""
    edges = _table(spark, LINKS, [("a", "b", "static", "b", 0), ("a", "c", "static", "c", 1)])
    g = ImportGraph.of(_table(spark, NODES, [("a", 1, None), ("a", 1, None)]), edges)
    return g.with_leaves(_table(spark, NODES, [("b", 7, "p")])).with_ids()


@fixed("src VARCHAR, dst VARCHAR, kind VARCHAR, specifier VARCHAR, ord BIGINT", [("a", "b", "static", "first", 1), ("a", "b", "dynamic", "loose", 0), ("b", "a", "static", "back", 0)])
def f03_edge_dedup(spark, sf_dir):
    """One edge a source, target and kind: the first in source order."""
    rows = [("a", "b", "static", "second", 5), ("a", "b", "static", "first", 1), ("a", "b", "dynamic", "loose", 0), ("a", "b", "static", "third", 9), ("b", "a", "static", "back", 0)]
    return ImportGraph.of(_table(spark, NODES, [("a", 1, None), ("b", 1, None)]), _table(spark, LINKS, rows)).edges


FAN = "e 1,h 1,z 1 zod," + ",".join(f"f{i:02} 1" for i in range(25)), "e>h " + " ".join(f"h>f{i:02} f{i:02}>z" for i in range(25))
CHAINS = {
    "linear": ("e 1,b 1,c 1,z 500 zod", "e>b b>c c>z"),
    "one_package_twice": ("e 1,b 1,i 1 zod,l 1 zod", "e>b b>i b>l"),
    "unreachable": ("e 1,b 1,z 1 zod", "e>b"),
    "dynamic_hop": ("e 1,b 1,z 1 zod", "e~b b>z"),
    "all_dynamic": ("e 1,b 1,z 1 zod", "e~b b~z"),
    "late_dynamic_hop": ("e 1,b 1,z 1 zod", "e>b b~z"),
    "two": ("e 1,b 1,c 1,d 1,z 1 zod", "e>b e>c b>d c>d d>z"),
    "shortest_only": ("e 1,b 1,c 1,z 1 zod", "e>b b>c c>z e>c"),
    "not_through_a_target": ("e 1,i 1 zod,l 1 zod", "e>i i>l"),
    "packages_on_the_way": ("e 1,p 1 left,q 1 left,r 1 right,z 1 zod", "e>p e>q e>r p>z q>z r>z"),
}


def _chains(spark: SparkSession, dynamic: bool) -> DataFrame:
    def found(name: str, g: tuple) -> DataFrame:
        chains = C.find_chains(_graph(spark, *g), "e", C.Target(package="zod"), include_dynamic=dynamic)
        return chains.select(F.lit(name).alias("graph"), F.array_join("modules", ">").alias("modules"), F.array_join("edge_kinds", ">").alias("kinds"), "classification.type", "classification.first_dynamic_hop")

    return _union(_each(found, CHAINS))


_S = "static"
STATIC_CHAINS = [
    ("linear", "e>b>c>z", "static>static>static", "all_static", None), ("one_package_twice", "e>b>i", "static>static", "all_static", None),
    ("two", "e>b>d>z", "static>static>static", "all_static", None), ("two", "e>c>d>z", "static>static>static", "all_static", None),
    ("shortest_only", "e>c>z", "static>static", "all_static", None), ("not_through_a_target", "e>i", "static", "all_static", None),
    ("packages_on_the_way", "e>p>z", "static>static", "all_static", None), ("packages_on_the_way", "e>r>z", "static>static", "all_static", None),
]
CHAIN_SHAPE = "graph VARCHAR, modules VARCHAR, kinds VARCHAR, type VARCHAR, first_dynamic_hop INTEGER"


@fixed(CHAIN_SHAPE, STATIC_CHAINS)
def f04_chains(spark, sf_dir):
    """Shortest chains over static edges: one a run of packages, none through a target, none where there is no path."""
    return _chains(spark, False)


@fixed(CHAIN_SHAPE, [*STATIC_CHAINS, ("dynamic_hop", "e>b>z", "dynamic>static", "mixed", 0), ("all_dynamic", "e>b>z", "dynamic>dynamic", "all_dynamic", None), ("late_dynamic_hop", "e>b>z", "static>dynamic", "mixed", 1)])
def f05_chains_dynamic(spark, sf_dir):
    """With dynamic edges: mixed chains name their first dynamic hop, counted from 0."""
    return _chains(spark, True)


@fixed("chains BIGINT, hop_count INTEGER, path_count BIGINT, modules BIGINT", [(10, 3, 25, 12 + 1)])
def f06_fan_in(spark, sf_dir):
    """25 shortest chains: 10 are listed, all are counted."""
    g = _graph(spark, *FAN)
    target = C.Target(package="zod")
    found = written(C.find_chains(g, "e", target))
    listed = found.agg(F.count("*").alias("chains"), F.lit(1).alias("k")).join(C.module_frequency(found).agg(F.count("*").alias("modules"), F.lit(1).alias("k")), "k")
    return listed.join(C.path_counts(g, "e", target).withColumn("k", F.lit(1)), "k").select("chains", "hop_count", "path_count", "modules")


CUTS = {
    "convergence": ("e 1,b 2,c 3,d 4,z 5 zod", "e>b e>c b>d c>d d>z"),
    "no_convergence": ("e 1,b 2,c 3,y 5 zod,z 5 zod", "e>b e>c b>y c>z"),
    "direct": ("e 1,z 5 zod", "e>z"),
    "single_chain": ("e 100,b 5000,c 100,z 500 zod", "e>b b>c c>z"),
    "heaviest_of_a_package": ("e 1,p 50 left,q 60 left,z 5 zod", "e>p p>q q>z"),
    "shared_below": ("e 1,b 10,d 4,z 5 zod,x 7", "e>b b>d d>z e>x x>d"),
}


@fixed("graph VARCHAR, place BIGINT, path VARCHAR, exclusive_size_bytes BIGINT, chains_broken BIGINT, direct BOOLEAN", [
    ("convergence", 0, "d", 9, 2, False), ("no_convergence", 0, None, None, None, False), ("direct", 0, None, None, None, True), ("single_chain", 0, "c", 600, 1, False), ("single_chain", 1, "b", 5600, 1, False),
    ("heaviest_of_a_package", 0, "p", 115, 1, False), ("shared_below", 0, "d", 9, 2, False),
])
def f07_cuts(spark, sf_dir):
    """Modules on every chain: heaviest first, of a single chain the lightest; one a package; none of a direct import."""

    def rows_of(name: str, g: tuple) -> list[tuple]:
        graph, target = _graph(spark, *g), C.Target(package="zod")
        found = written(C.find_chains(graph, "e", target))
        candidates = written(C.cut_candidates(graph, found, "e", target))
        cuts = C.cuts(candidates, exclusive_weights(graph, "e"), found.count()).collect()
        direct = C.direct_import(found, candidates.isEmpty()).first()["direct_import"]
        return [(name, i, r["path"], r["exclusive_size_bytes"], r["chains_broken"], direct) for i, r in enumerate(cuts)] or [(name, 0, None, None, None, direct)]

    rows = [r for found in _each(rows_of, CUTS) for r in found]
    return _table(spark, "graph string, place long, path string, exclusive_size_bytes long, chains_broken long, direct boolean", rows)


DOMINATED = {
    "linear": ("e 100,a 200,b 300", "e>a a>b", False),
    "diamond": ("e 100,a 200,b 300,d 500", "e>a a>d e>b b>d", False),
    "mixed": ("e 100,a 200,b 300,d 500,x 600", "e>a a>d e>b b>d a>x", False),
    "static": ("e 100,a 200,b 300,c 400", "e>a a>c e~b b>c", False),
    "with_dynamic": ("e 100,a 200,b 300,c 400", "e>a a>c e~b b>c", True),
    "loop": ("e 1,a 2,b 4,c 8", "e>a a>b b>c c>a c>e", False),
}


@fixed("graph VARCHAR, path VARCHAR, kernel BIGINT, tables BIGINT", [(g, p, w, w) for g, p, w in [
    ("linear", "e", 600), ("linear", "a", 500), ("linear", "b", 300), ("diamond", "e", 1100), ("diamond", "a", 200), ("diamond", "b", 300), ("diamond", "d", 500),
    ("mixed", "e", 1700), ("mixed", "a", 800), ("mixed", "b", 300), ("mixed", "d", 500), ("mixed", "x", 600), ("static", "e", 700), ("static", "a", 600), ("static", "c", 400),
    ("with_dynamic", "e", 1000), ("with_dynamic", "a", 200), ("with_dynamic", "b", 300), ("with_dynamic", "c", 400), ("loop", "e", 15), ("loop", "a", 14), ("loop", "b", 12), ("loop", "c", 8),
]])
def f08_exclusive(spark, sf_dir):
    """Exclusive weights from the dominator tree of one task, and from the dominators' table."""

    def both(name: str, case: tuple) -> DataFrame:
        nodes, edges, dynamic = case
        g = _graph(spark, nodes, edges)
        one = exclusive_weights(g, "e", dynamic).withColumnRenamed("exclusive_size_bytes", "kernel")
        two = exclusive_weights(g, "e", dynamic, kernel_edges=0).withColumnRenamed("exclusive_size_bytes", "tables")
        return one.join(two, "path", "full").select(F.lit(name).alias("graph"), "path", "kernel", "tables")

    return _union(_each(both, DOMINATED))


HEAVY = ("e 100,a 50 pa,a2 20 pa,b 200 pb,c 300 pc,d 300 pd,m 5,g 900 pg", "e>m m>a a>a2 m>b e>c m>c c>d e~g")


@fixed("place BIGINT, name VARCHAR, total_size_bytes BIGINT, file_count BIGINT, chain VARCHAR", [(0, "pg", 900, 1, ""), (1, "pc", 300, 1, "e>c"), (2, "pb", 200, 1, "e>m>b"), (3, "pa", 70, 2, "e>m>a")])
def f09_heavy_packages(spark, sf_dir):
    """Packages by size with the chain to the first module of each; without an ignored one; no chain to what only dynamic edges reach."""
    trace = Trace.of(_graph(spark, *HEAVY), "e")
    rows = trace.with_chains(trace.heavy_packages(TraceOptions(include_dynamic=True, top_n=-1, ignore=["pd"]))).collect()
    return _table(spark, "place long, name string, total_size_bytes long, file_count long, chain string", [(i, r["name"], r["total_size_bytes"], r["file_count"], ">".join(r["chain"])) for i, r in enumerate(rows)])


COST = ("e 1,m 10,n 10,o 30,p 99 pkg", "e>m e>n m>o o>p")


@fixed("what VARCHAR, place BIGINT, path VARCHAR, exclusive_size_bytes BIGINT", [("all", 0, "m", 139), ("all", 1, "o", 129), ("all", 2, "n", 10), ("top", 0, "m", 139), ("packages", 0, "q", 9), ("packages", 1, "r", 4)])
def f10_modules_by_cost(spark, sf_dir):
    """First-party modules by exclusive weight, the entry left out; modules of packages where there are no others."""
    rows = []
    for what, g, top in (("all", COST, -1), ("top", COST, 1), ("packages", ("e 1,q 5 k,r 4 k", "e>q q>r"), -1)):
        graph = _graph(spark, *g)
        found = Trace.of(graph, "e").modules_by_cost(exclusive_weights(graph, "e"), top=top).collect()
        rows += [(what, i, r["path"], r["exclusive_size_bytes"]) for i, r in enumerate(found)]
    return _table(spark, "what string, place long, path string, exclusive_size_bytes long", rows)


SNAPSHOTS = [("A", 1000, {"zod": 500, "chalk": 200, "tslog": 300}, 200, {"lodash": 200}), ("B", 800, {"chalk": 250, "tslog": 300, "ajv": 100, "zed": 100}, 350, {"moment": 350})]


def _snapshots(spark: SparkSession) -> list[DataFrame]:
    return [_table(spark, SNAPSHOT, [s]) for s in SNAPSHOTS]


@fixed("section VARCHAR, name VARCHAR, total_size_bytes BIGINT", [("only_in_a", "zod", 500), ("only_in_b", "ajv", 100), ("only_in_b", "zed", 100), ("dynamic_only_in_a", "lodash", 200), ("dynamic_only_in_b", "moment", 350)])
def f11_diff_sections(spark, sf_dir):
    """A package whose size changed is in both."""
    return D.diff_sections(*_snapshots(spark))


@fixed("entry_a VARCHAR, entry_b VARCHAR, weight_a BIGINT, weight_b BIGINT, weight_delta BIGINT, dynamic_weight_a BIGINT, dynamic_weight_b BIGINT, dynamic_weight_delta BIGINT, shared_count BIGINT", [("A", "B", 1000, 800, -200, 200, 350, 150, 2)])
def f12_diff_summary(spark, sf_dir):
    return D.diff_summary(*_snapshots(spark))


@fixed("entry VARCHAR, static_weight BIGINT, packages VARCHAR, dynamic_weight BIGINT, dynamic_packages VARCHAR", [("A", 1000, '{"chalk":200,"tslog":300,"zod":500}', 200, '{"lodash":200}'), ("old", 5, '{"p":5}', 0, "{}")])
def f13_snapshot_files(spark, sf_dir):
    """Snapshots through files; old ones have no dynamic part."""
    with tempfile.TemporaryDirectory() as folder:  # of the driver, which alone reads and writes snapshots
        D.save_snapshot(_snapshots(spark)[0], f"{folder}/a.json")
        with open(f"{folder}/b.json", "w", encoding="utf-8") as file:
            json.dump({"entry": "old", "static_weight": 5, "packages": {"p": 5}}, file)
        both = [D.load_snapshot(spark, f"{folder}/{n}.json") for n in "ab"]
    text = lambda c: F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c)))).alias(c)
    return _union([s.select("entry", "static_weight", text("packages"), "dynamic_weight", text("dynamic_packages")) for s in both])


TS = {
    "import.ts": "import a from 'a'; import * as n from \"n\"; import {x, type Y} from 'x'; import type {T} from 't'; import {type U} from 'u'; import 'effect'",
    "export.ts": "export * from 'a'; export * as m from 'm'; export {x} from 'x'; export type {T} from 't'; export {type U, type V} from 'u'; export const own = 1; export {own as other}",
    "dynamic.ts": "const a = await import('a'); function f() { return import('b') } class K { m = () => import('c') } import(`d`); import(e)",
    "require.js": "const a = require('a'); if (x) { require('b') } require.resolve('no'); require(y); o.require('no'); let z = [require('c'), g(require('d'))]",
    "order.tsx": "import z from 'z'; const q = <p title=\"it's\">Don't, can't</p>; import('m'); import b from 'b'",
    "quiet.mjs": "// import 'no'\n/* require('no') */ const s = \"import 'no'\", r = /require('no')/, t = `import 'no' ${require('yes')}`",
    "broken.ts": "import a from 'a'\nconst = = ;;; import('b'",
    "empty.cts": "",
}


def _extracted(spark: SparkSession, files: dict[str, str | bytes]) -> DataFrame:
    return written(extract(_table(spark, "path string, content binary", [(p, bytearray(t if isinstance(t, bytes) else t.encode())) for p, t in files.items()])))


def _imports(*listed: str) -> list[tuple]:
    """Rows (path, ord, specifier, kind) from `path: s static_one, d ~dynamic_one, ?type_one`."""
    out = []
    for line in listed:
        path, specs = line.split(": ")
        for i, s in enumerate(specs.split(", ")):
            out.append((path, i, s.lstrip("~?"), {"~": "dynamic", "?": "type_only"}.get(s[0], "static")))
    return out


IMPORT_SHAPE = "path VARCHAR, ord BIGINT, specifier VARCHAR, kind VARCHAR"


@fixed(IMPORT_SHAPE, _imports("import.ts: a, n, x, ?t, ?u, effect", "export.ts: a, m, x, ?t, ?u", "dynamic.ts: ~a, ~b, ~c", "require.js: a, b, c, d", "order.tsx: z, ~m, b", "quiet.mjs: yes", "broken.ts: a"))
def f14_ecmascript_imports(spark, sf_dir):
    """Imports, re-exports, import() and require() in source order; types only if all bindings are; comments, texts and members are none."""
    return as_rows(_extracted(spark, TS))


@fixed("path VARCHAR, unresolvable INTEGER, warned BOOLEAN", [("import.ts", 0, False), ("export.ts", 0, False), ("dynamic.ts", 2, False), ("require.js", 1, False), ("quiet.mjs", 0, False), ("empty.cts", 0, False), ("not_utf8.ts", 0, True)])
def f15_ecmascript_hidden(spark, sf_dir):
    """Imports that cannot be told are counted; what cannot be read is a warning and never fails."""
    files = {k: v for k, v in TS.items() if k not in ("order.tsx", "broken.ts")} | {"not_utf8.ts": b"import '\xff'"}
    return _extracted(spark, files).select("path", "unresolvable", F.col("warning").isNotNull().alias("warned"))


PY = {
    "plain.py": "import a.b, c as d\nfrom e import f\nfrom e.g import *\nfrom __future__ import k",
    "dots.py": "from . import g, h as i\nfrom .. import j\nfrom ..k.l import m\nfrom . import *",
    "context.py": "import a\ndef f():\n    import b\nclass K:\n    import c\n    async def m(self):\n        from d import e\ntry:\n    import g\nexcept ImportError:\n    import h",
    "typing.py": "from typing import TYPE_CHECKING\nif TYPE_CHECKING:\n    import a\nelse:\n    import b\nif typing.TYPE_CHECKING:\n    from c import d\nif x:\n    import e",
    "calls.py": "import importlib\nimportlib.import_module('a.b')\n__import__(\"c\")\nimportlib.import_module(name)\n__import__(f'{x}')\nother.import_module('no')",
    "broken.py": "import a\nfrom b.c import (\ndef f(:\nfrom .d import e",
    "empty.py": "",
}


@fixed(IMPORT_SHAPE, _imports("plain.py: a.b, c, e, e.g", "dots.py: .g, .h, ..j, ..k.l", "context.py: a, ~b, c, ~d, g, h", "typing.py: typing, ?a, ?b, ?c, e", "calls.py: importlib, ~a.b, ~c", "broken.py: a, b.c, .d"))
def f16_python_imports(spark, sf_dir):
    """Modules and not their names; dots alone name submodules; functions make imports dynamic, TYPE_CHECKING type-only, else branch included."""
    return as_rows(_extracted(spark, PY))


@fixed("path VARCHAR, unresolvable INTEGER, warned BOOLEAN", [("plain.py", 0, False), ("dots.py", 0, False), ("context.py", 0, False), ("typing.py", 0, False), ("calls.py", 2, False), ("broken.py", 0, True), ("empty.py", 0, False)])
def f17_python_hidden(spark, sf_dir):
    return _extracted(spark, PY).select("path", "unresolvable", F.col("warning").isNotNull().alias("warned"))


def _listing(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """fs(path, is_dir) of some files and all folders above them."""
    folders = sorted({f[:i] for f in files for i, c in enumerate(f) if c == "/" and i})
    return _table(spark, "path string, is_dir boolean", [(f, False) for f in files] + [(f, True) for f in folders])


NODE_FILES = {
    "/r/src/a.ts": "", "/r/src/b.tsx": "", "/r/src/c/index.js": "", "/r/src/d.json": "", "/r/src/e.js": "", "/r/src/e.ts": "", "/r/src/m.mts": "", "/r/src/types.d.ts": "",
    "/r/node_modules/main/package.json": '{"main": "./lib/m"}', "/r/node_modules/main/lib/m.js": "", "/r/node_modules/main/extra.js": "",
    "/r/node_modules/esm/package.json": '{"module": "m.mjs", "main": "c.js"}', "/r/node_modules/esm/m.mjs": "", "/r/node_modules/esm/c.js": "",
    "/r/node_modules/plain/index.js": "", "/r/node_modules/@s/x/package.json": '{"exports": {".": {"types": "./t.d.ts", "import": "./i.mjs", "default": "./d.js"}, "./f/*": "./src/*.js", "./gone": null}}',
    "/r/node_modules/@s/x/i.mjs": "", "/r/node_modules/@s/x/d.js": "", "/r/node_modules/@s/x/src/one.js": "", "/r/node_modules/@s/x/hidden.js": "",
    "/r/package.json": '{"imports": {"#one": "./src/one.ts", "#db": {"browser": "./no.js", "node": "plain"}, "#in/*": "./src/*.ts", "#in/shut/*": null, "#up": "../up.js", "#lost": "./src/lost.ts"}}', "/r/src/one.ts": "",
    "/r/src/node_modules/near/index.js": "", "/r/node_modules/near/index.js": "", "/r/node_modules/bad/package.json": "{", "/r/node_modules/bad/index.js": "",
}
NODE_ANSWERS = {
    "./a": "/r/src/a.ts", "./b": "/r/src/b.tsx", "./c": "/r/src/c/index.js", "./d.json": "/r/src/d.json", "./e.js": "/r/src/e.ts", "./m.mjs": "/r/src/m.mts", "./types": "/r/src/types.d.ts", "./none": None, "../src/a": "/r/src/a.ts",
    "main": "/r/node_modules/main/lib/m.js", "main/extra": "/r/node_modules/main/extra.js", "esm": "/r/node_modules/esm/m.mjs", "plain": "/r/node_modules/plain/index.js", "@s/x": "/r/node_modules/@s/x/i.mjs", "@s/x/f/one": "/r/node_modules/@s/x/src/one.js",
    "#one": "/r/src/one.ts", "#db": "/r/node_modules/plain/index.js", "#in/one": "/r/src/one.ts", "#in/shut/one": None, "#up": None, "#lost": None, "#none": None,
    "@s/x/hidden.js": None, "@s/x/gone": None, "near": "/r/src/node_modules/near/index.js", "bad": "/r/node_modules/bad/index.js", "fs": None, "node:path": None, "missing": None,
}


@fixed("folder VARCHAR, specifier VARCHAR, resolved VARCHAR", [("/r/src", s, a) for s, a in NODE_ANSWERS.items()])
def f18_node_resolution(spark, sf_dir):
    """Written and added extensions, folders, main fields, exports with conditions and patterns, the nearest node_modules, imports of the package itself; built-ins and what is not there have no answer."""
    manifests = _table(spark, "path string, content binary", [(p, bytearray(t.encode())) for p, t in NODE_FILES.items() if p.endswith("package.json")])
    return resolve_node(_table(spark, "folder string, specifier string", [("/r/src", s) for s in NODE_ANSWERS]), _listing(spark, list(NODE_FILES)), manifests)


PY_FILES = "/p/main.py /p/pkg/__init__.py /p/pkg/mod.py /p/ns/one.py /p/src/ns/two.py /p/src/pkg/late.py /p/src/lib.py /s/dep/__init__.py /s/dep/fast.cpython-311-x86_64-linux-gnu.so /s/single.py /s/lib.py /s/space/sub/deep.py".split()
PY_ANSWERS = {
    "pkg": "/p/pkg/__init__.py", "pkg.mod": "/p/pkg/mod.py", "pkg.late": None, "ns": "/p/ns", "ns.one": "/p/ns/one.py", "ns.two": "/p/src/ns/two.py", "lib": "/p/src/lib.py", "dep": "/s/dep/__init__.py",
    "dep.fast": "/s/dep/fast.cpython-311-x86_64-linux-gnu.so", "single": "/s/single.py", "space.sub.deep": "/s/space/sub/deep.py", "os": None, ".mod": "/p/pkg/mod.py", ".": "/p/pkg/__init__.py", "..main": "/p/main.py", ".none": None,
}


@fixed("folder VARCHAR, specifier VARCHAR, resolved VARCHAR", [("/p/pkg", s, a) for s, a in PY_ANSWERS.items()])
def f19_python_resolution(spark, sf_dir):
    """Source roots before site folders, packages tied to their root, namespaces over several, C extensions, relative imports."""
    paths = SearchPath(("/p", "/p/src"), ("/s",))
    return resolved(_table(spark, "folder string, specifier string", [("/p/pkg", s) for s in PY_ANSWERS]), _listing(spark, PY_FILES), paths.probes, paths.decide)


PROJECT = {
    "package.json": '{"name":"test-project","version":"1.0.0"}',
    "index.ts": "import {a} from './a'; import './b'; import('./c')",
    "a.ts": "import _ from 'lodash'; import fs from 'fs'",
    "b.ts": "import './a.js'; import data from './d.json'; import type {W} from '@w/lib'; require(name)",
    "c.ts": "import './e'",
    "e.ts": "",
    "d.json": "{}",
    "unused.ts": "import 'zod'",
    "packages/lib/package.json": '{"name":"@w/lib","main":"m.js"}',
    "node_modules/lodash/package.json": '{"name":"lodash","main":"index.js"}',
    "node_modules/lodash/index.js": "module.exports = require('./_base')",
    "node_modules/lodash/_base.js": "1",
    "node_modules/@w/lib/package.json": '{"exports":{".":{"import":"./m.mjs"}}}',
    "node_modules/@w/lib/m.mjs": "export const x = 1",
    "node_modules/zod/index.js": "",
}
ROOT = "/fixture/app"


class _Tables(Tree):
    """A tree whose listing and contents are tables."""

    def __init__(self, spark: SparkSession, root: str, files: dict[str, str], hour: int = 0):
        rows = [(f"{root}/{n}", False, len(t.encode()), hour) for n, t in files.items()]
        rows += [(f, True, 0, hour) for f in sorted({p[:i] for p, *_ in rows for i, c in enumerate(p) if c == "/" and i >= len(root)})]
        listing = _table(spark, "path string, is_dir boolean, size long, mtime_nanos long", rows).withColumn("mtime_nanos", F.col("mtime_nanos").cast("decimal(38,0)"))
        super().__init__(written(listing))
        self.contents = written(_table(spark, "path string, content binary", [(f"{root}/{n}", bytearray(t.encode())) for n, t in files.items()]))

    def read(self, paths: DataFrame) -> DataFrame:
        return self.contents.join(paths.select("path"), "path", "left_semi")


@cache
def _session(spark: SparkSession) -> Session:
    return Session(spark, load(spark, f"{ROOT}/index.ts", ROOT, _Tables(spark, ROOT, PROJECT)))


def _below(column: str = "path", root: str = ROOT) -> Any:
    return X.relative_path(F.col(column), root).alias(column)


def _size(name: str) -> int:
    return len(PROJECT[name].encode())


LODASH, LIB = "node_modules/lodash/", "node_modules/@w/lib/"
OWN = [("index.ts", None), ("a.ts", None), ("b.ts", None), ("c.ts", None), ("e.ts", None), ("d.json", None), (LODASH + "index.js", "lodash"), (LODASH + "_base.js", "lodash"), (LIB + "m.mjs", "@w/lib")]


@fixed("path VARCHAR, size_bytes BIGINT, package VARCHAR", [(p, _size(p), k) for p, k in OWN])
def f20_project_nodes(spark, sf_dir):
    """All that an entry imports at any distance, of every kind, from a tree of tables: leaves that are no source, packages followed into node_modules."""
    return _session(spark).graph.nodes.select(_below(), "size_bytes", "package")


EDGES = [("index.ts", "a.ts", "static"), ("index.ts", "b.ts", "static"), ("index.ts", "c.ts", "dynamic"), ("a.ts", LODASH + "index.js", "static"), ("b.ts", "a.ts", "static"), ("b.ts", "d.json", "static"), ("b.ts", LIB + "m.mjs", "type_only"), ("c.ts", "e.ts", "static"), (LODASH + "index.js", LODASH + "_base.js", "static")]


@fixed("src VARCHAR, dst VARCHAR, kind VARCHAR", EDGES)
def f21_project_edges(spark, sf_dir):
    return _session(spark).graph.edges.select(_below("src"), _below("dst"), "kind")


@fixed("what VARCHAR, name VARCHAR, n BIGINT", [("unresolved", "fs", None), ("unresolvable", "b.ts", 1)])
def f22_project_unknown(spark, sf_dir):
    """Specifiers without an answer, and files with imports that cannot be told."""
    loaded = _session(spark).loaded
    one = loaded.unresolved.select(F.lit("unresolved").alias("what"), F.col("specifier").alias("name"), F.lit(None).cast("long").alias("n"))
    return one.unionByName(loaded.unresolvable.select(F.lit("unresolvable").alias("what"), _below().alias("name"), F.col("count").cast("long").alias("n")))


@fixed("path VARCHAR, workspace VARCHAR", [("packages/lib/m.js", "@w/lib"), ("packages/lib/deep/x.ts", "inner")])
def f23_workspaces(spark, sf_dir):
    """Modules below a package.json of the project are named by the nearest; the project's own names none."""
    from graphweight.project import workspace_names

    manifests = {"package.json": "app", "packages/lib/package.json": "@w/lib", "packages/lib/deep/package.json": "inner"}
    modules = _table(spark, "path string", [(f"{ROOT}/{p}",) for p in ("index.ts", "packages/lib/m.js", "packages/lib/deep/x.ts")])
    named = _table(spark, "path string, content binary", [(f"{ROOT}/{p}", bytearray(json.dumps({"name": n}).encode())) for p, n in manifests.items()])
    return workspace_names(modules, named, ROOT).select(_below(), "workspace")


def _json(spark: SparkSession, rows: dict[str, str]) -> DataFrame:
    """Reports as rows (report, text), their JSON without white space."""
    return _table(spark, "report string, text string", [(k, json.dumps(json.loads(v), separators=(",", ":"), ensure_ascii=False)) for k, v in rows.items()])


def _text(body: Any) -> str:
    return json.dumps(body, separators=(",", ":"), ensure_ascii=False)


REPORT = "report VARCHAR, text VARCHAR"
_CHAIN = ["index.ts", "a.ts", "lodash"]
_STATIC = sum(_size(n) for n in ("index.ts", "a.ts", "b.ts", "d.json", LODASH + "index.js", LODASH + "_base.js"))
_LODASH = _size(LODASH + "index.js") + _size(LODASH + "_base.js")
_HEAVY = {"name": "lodash", "total_size_bytes": _LODASH, "file_count": 2, "chain": _CHAIN}
_TRACE = {
    "entry": "app/index.ts", "static_weight_bytes": _STATIC, "static_module_count": 6, "dynamic_only_weight_bytes": _size("c.ts"), "dynamic_only_module_count": 2,
}
_COSTS = {"modules_by_cost": [{"path": "b.ts", "exclusive_size_bytes": _size("b.ts") + 2}, {"path": "a.ts", "exclusive_size_bytes": _size("a.ts") + _LODASH}], "total_modules_with_cost": 3}


@fixed(REPORT, [
    ("v2", _text({"format_version": 2, **_TRACE, "heavy_packages": [_HEAVY | {"edge_kinds": ["static", "static"], "classification": {"type": "all_static"}}], **_COSTS})),
    ("v1", _text({"format_version": 1, **_TRACE, "heavy_packages": [_HEAVY], **_COSTS})),
])
def f24_trace_report(spark, sf_dir):
    out = report.trace_report(_session(spark), TraceOptions(), 2)
    return _json(spark, {"v2": out.json(2), "v1": out.json(1)})


@fixed(REPORT, [
    ("v2", _text({"format_version": 2, "target": "lodash", "found_in_graph": True, "chain_count": 1, "hop_count": 2, "chains": [{"modules": _CHAIN, "edge_kinds": ["static", "static"], "classification": {"type": "all_static"}}]})),
    ("v1", _text({"format_version": 1, "target": "lodash", "found_in_graph": True, "chain_count": 1, "hop_count": 2, "chains": [_CHAIN]})),
    ("dynamic", _text({"format_version": 2, "target": "e.ts", "found_in_graph": True, "chain_count": 1, "hop_count": 2, "chains": [{"modules": ["index.ts", "c.ts", "e.ts"], "edge_kinds": ["dynamic", "static"], "classification": {"type": "mixed", "first_dynamic_hop": 0}}]})),
    ("unreached", _text({"format_version": 2, "target": "e.ts", "found_in_graph": True, "chain_count": 0, "hop_count": 0, "chains": []})),
    ("unknown", _text({"format_version": 2, "target": "nope", "found_in_graph": False, "chain_count": 0, "hop_count": 0, "chains": []})),
])
def f25_chain_report(spark, sf_dir):
    s = _session(spark)
    found = report.chain_report(s, "lodash")
    return _json(spark, {"v2": found.json(2), "v1": found.json(1), "dynamic": report.chain_report(s, "e.ts", True).json(), "unreached": report.chain_report(s, "e.ts").json(), "unknown": report.chain_report(s, "nope").json()})


@fixed(REPORT, [
    ("lodash", _text({"format_version": 2, "target": "lodash", "found_in_graph": True, "chain_count": 1, "direct_import": False, "cut_points": [{"module": "a.ts", "exclusive_size_bytes": _size("a.ts") + _LODASH, "chains_broken": 1}]})),
    ("a.ts", _text({"format_version": 2, "target": "a.ts", "found_in_graph": True, "chain_count": 1, "direct_import": True, "cut_points": []})),
])
def f26_cut_report(spark, sf_dir):
    return _json(spark, {n: report.cut_report(_session(spark), n).json() for n in ("lodash", "a.ts")})


_SIDES = {"entry_a": "A", "entry_b": "B", "weight_a": 1000, "weight_b": 800, "weight_delta": -200, "dynamic_weight_a": 200, "dynamic_weight_b": 350, "dynamic_weight_delta": 150, "shared_count": 2}


def _names(**sizes: int) -> list[dict]:
    return [{"name": k, "total_size_bytes": v} for k, v in sizes.items()]


@fixed(REPORT, [
    ("diff", _text({"format_version": 2, **_SIDES, "only_in_a": _names(zod=500), "only_in_b": _names(ajv=100, zed=100), "dynamic_only_in_a": _names(lodash=200), "dynamic_only_in_b": _names(moment=350)})),
    ("packages", _text({"format_version": 2, "package_count": 2, "packages": [{"name": "lodash", "total_size_bytes": _LODASH, "file_count": 2}]})),
    ("imports", _text([{"path": "a.ts", "kind": "static"}, {"path": "d.json", "kind": "static"}, {"path": LIB + "m.mjs", "kind": "type-only"}])),
    ("importers", _text([{"path": "b.ts", "kind": "static"}, {"path": "index.ts", "kind": "static"}])),
])
def f27_other_reports(spark, sf_dir):
    s = _session(spark)
    links = {"imports": report.links_report(s, s.imports("b.ts"), ""), "importers": report.links_report(s, s.importers("a.ts"), "")}
    return _json(spark, {"diff": report.diff_report(*_snapshots(spark)).json(), "packages": report.packages_report(s, 1).json(), **{k: v.json() for k, v in links.items()}})


SHELL = [
    ("help", "commands: " + ", ".join(cli.COMMANDS)), ("?", "commands: " + ", ".join(cli.COMMANDS)), ("", "commands: " + ", ".join(cli.COMMANDS)),
    ("bogus", "error: unknown command: bogus"), ("chain --nope x", "error: unknown option: --nope"), ("chain", "error: chain needs a package or file"), ("quit", None), ("exit", None),
    ("imports index.ts", "  a.ts\n  b.ts\n  c.ts (dynamic)"), ("importers a.ts", "  b.ts\n  index.ts"), ("imports e.ts", "  (no imports)"), ("info lodash", f"lodash  2 files  {_LODASH} B"), ("info nope", "error: no such package: nope"),
    ("chain lodash", "1 chain to lodash (2 hops):\n\n  1. index.ts -> a.ts -> lodash"), ("chain e.ts", "e.ts is in the graph but cannot be reached by static imports."),
    ("chain e.ts --include-dynamic", "1 chain to e.ts (2 hops):\n\n  1. index.ts ~> c.ts -> e.ts"), ("chain nope", "nope is not in the graph."), ("chain index.ts", "error: index.ts is the entry itself\nhint: choose a package or another file"),
    ("cut lodash", f"Cut points for lodash (1 chain):\n  a.ts  {_size('a.ts') + _LODASH} B  breaks 1"), ("cut a.ts", "The entry imports a.ts directly; nothing between them can be cut."),
    ("show", "dynamic off\ntop 10\ntop-modules 20\nignore (none)"), ("set dynamic", "dynamic on\ntop 10\ntop-modules 20\nignore (none)"), ("set top 3", "dynamic on\ntop 3\ntop-modules 20\nignore (none)"),
    ("set ignore a b", "dynamic on\ntop 3\ntop-modules 20\nignore a b"), ("set top x", "top needs a number"), ("set nope", "unknown option: nope"), ("unset dynamic", "dynamic off\ntop 3\ntop-modules 20\nignore a b"),
    ("unset ignore", "dynamic off\ntop 3\ntop-modules 20\nignore (none)"), ("packages --top 1", f"2 packages:\n  lodash  {_LODASH} B  2 files\n  ... and 1 more"), ("entry a.ts", "entry app/a.ts"), ("imports nope.ts", "error: entry not found: nope.ts\nhint: give a path from the current folder or the project's root"),
]


@fixed("place BIGINT, line VARCHAR, answer VARCHAR", [(i, *x) for i, x in enumerate(SHELL)])
def f28_shell(spark, sf_dir):
    """A conversation with the shell."""
    one = _session(spark)
    shell = cli.Shell(Session(spark, one.loaded))
    return _table(spark, "place long, line string, answer string", [(i, line, shell.run(line)) for i, (line, _) in enumerate(SHELL)])


@fixed("command VARCHAR, prefix VARCHAR, found VARCHAR", [
    ("", "im", "importers imports"), ("", "", "chain cut diff entry help importers imports info packages quit set show trace unset"), ("chain", "lo", "lodash"), ("chain", "", f"@w/lib lodash a.ts b.ts c.ts d.json e.ts index.ts {LIB}m.mjs {LODASH}_base.js {LODASH}index.js"),
    ("imports", "c", "c.ts"), ("set", "t", "top top-modules"), ("info", "@", "@w/lib"),
])
def f29_completions(spark, sf_dir):
    shell = cli.Shell(_session(spark))
    asked = [("", "im"), ("", ""), ("chain", "lo"), ("chain", ""), ("imports", "c"), ("set", "t"), ("info", "@")]
    return _table(spark, "command string, prefix string, found string", [(c, p, " ".join(shell.complete(p, c))) for c, p in asked])


COMMAND_LINES = [
    ("trace --top x --ignore a b --json", "trace", "x", '{"ignore": ["a", "b"], "json": true}', None), ("trace f.ts --top 5 --top-modules -1", "trace", "f.ts", '{"top": 5, "top_modules": -1}', None), ("chain 'a b' --no-include-dynamic", "chain", "a b", '{"include_dynamic": false}', None),
    ("trace --top -7", "trace", "", "{}", None), ("set --x", "set", "--x", "{}", None), ("cut", "error", "", "{}", "cut needs a package or file"), ("chain 'a", "error", "", "{}", "No closing quotation"),
]


@fixed("line VARCHAR, name VARCHAR, args VARCHAR, options VARCHAR, error VARCHAR", COMMAND_LINES)
def f30_command_lines(spark, sf_dir):
    rows = []
    for line, *_ in COMMAND_LINES:
        c = cli.parse_command(line)
        rows.append((line, c.name, "|".join(c.args), json.dumps(c.options, sort_keys=True), c.error))
    return _table(spark, "line string, name string, args string, options string, error string", rows)


def _attempt(call: Callable[[], Any]) -> str:
    try:
        return str(call())
    except GraphError as error:
        return f"{type(error).__name__}: {error}"


def _sizes() -> dict[str, str]:
    return {"5MB": "5000000", "1.5KB": "1500", "7": "7", "x": "InvalidSize: invalid size: x", "5 GB": "InvalidSize: invalid size: 5 GB"}


@fixed("what VARCHAR, answer VARCHAR", [*((f"size {k}", v) for k, v in _sizes().items()), ("number -2", "InvalidNumber: --top must be -1 or more, not -2"), ("number -1", "-1"), ("file gone.json", "DiffFileNotFound: snapshot file not found: gone.json"), ("language", "UnsupportedFileType: unsupported file type: /x.rb"), ("entry", "EntryNotFound: entry not found: /none/such.ts"), ("folder", "EntryIsDirectory: entry is a directory: /"), ("color", "False"), ("signed", "+1 KB -2 B 0 B"), ("status", "Built graph of 9 modules|1 import cannot be told:|  b.ts (1)")])
def f31_checks(spark, sf_dir):
    """What is refused, and the lines about how a graph was loaded."""
    from graphweight.project import language_of

    rows = [(f"size {k}", _attempt(lambda k=k: cli.size(k))) for k in _sizes()]
    rows += [(f"number {n}", _attempt(lambda n=n: report.checked_number("--top", n))) for n in (-2, -1)]
    rows += [("file gone.json", _attempt(lambda: classify("gone.json", "/"))), ("language", _attempt(lambda: language_of("/x.rb"))), ("entry", _attempt(lambda: checked_entry("/none/such.ts"))), ("folder", _attempt(lambda: checked_entry("/")))]
    rows += [("color", str(report.wants_color(no_color=True))), ("signed", " ".join(map(report.signed_size, (1000, -2, 0)))), ("status", "|".join(report.load_status(_session(spark))))]
    return _table(spark, "what string, answer string", rows)


STAMPS = "path string, is_dir boolean, size long, mtime_nanos long"


@fixed("path VARCHAR, event VARCHAR", [("/w/a.ts", "modify"), ("/w/new.ts", "create"), ("/w/old.ts", "remove"), ("/w/yarn.lock", "modify")])
def f32_watch_events(spark, sf_dir):
    """Changes of sources and lockfiles; what lies in skipped folders and other files are none."""
    before = [("/w/a.ts", False, 1, 1), ("/w/b.ts", False, 1, 1), ("/w/old.ts", False, 1, 1), ("/w/yarn.lock", False, 1, 1), ("/w/x.md", False, 1, 1), ("/w/node_modules/p/i.js", False, 1, 1), ("/w/src.ts", True, 0, 1)]
    after = [("/w/a.ts", False, 2, 1), ("/w/b.ts", False, 1, 1), ("/w/new.ts", False, 1, 5), ("/w/yarn.lock", False, 1, 9), ("/w/x.md", False, 5, 5), ("/w/node_modules/p/i.js", False, 4, 4), ("/w/src.ts", True, 0, 8)]
    return events(*(relevant(_table(spark, STAMPS, rows), "/w", "typescript") for rows in (before, after)))


@fixed("path VARCHAR, state VARCHAR, size_bytes BIGINT", [("b", "changed", 2), ("c", "changed", 1), ("d", "missing", None)])
def f33_stale_files(spark, sf_dir):
    """Stored files that are gone, or of another size or time."""
    old = _table(spark, "path string, size_bytes long, mtime_nanos long", [("a", 1, 1), ("b", 1, 1), ("c", 1, 1), ("d", 1, 1), ("f", 0, 1)])
    return incremental.changes(old, _table(spark, STAMPS, [("a", False, 1, 1), ("b", False, 2, 1), ("c", False, 1, 2), ("f", True, 77, 1)])).select("path", "state", "size_bytes")


SCALARS = "k long, path string, package string, ns double, text string"


@fixed("k BIGINT, relative VARCHAR, shown VARCHAR, inside VARCHAR, label VARCHAR, builtin BOOLEAN, duration VARCHAR, suffix VARCHAR, version VARCHAR, size VARCHAR", [
    (1, "src/a.ts", "src/a.ts", "a.ts", "app/src/a.ts", True, "12ns", "", "3.11", "1 B"), (2, "/rooted/b.ts", "/rooted/b.ts", "b.ts", "app//rooted/b.ts", True, "1.5us", "s", "3.9", "2 B"),
    (3, "node_modules/@s/x/lib/i.js", "@s/x", "@s/x/lib/i.js", "app/node_modules/@s/x/lib/i.js", False, "2.5ms", "s", None, "3 B"), (2500, "", None, None, None, True, "3.25s", "s", None, "2 KB"), (1250000, "x", "x", "x", "app/x", False, "999ns", "s", None, "1.2 MB"),
])
def f34_scalars(spark, sf_dir):
    """Relative and shown paths, built-ins, durations, plurals, versions, sizes (half to even)."""
    rows = _table(spark, SCALARS, [
        (1, "/root/src/a.ts", None, 12.0, "fs"), (2, "/rooted/b.ts", None, 1500.0, "node:fs/promises"), (3, "/root/node_modules/@s/x/lib/i.js", "@s/x", 2.5e6, "lodash"), (2500, "/root/", None, 3.25e9, "node:internal/x"), (1250000, "/root/x", None, 999.0, "internal/x"),
    ])
    config = F.when(F.col("k") == 1, "home = /usr\nversion = 3.11.4\n").when(F.col("k") == 2, "version_info = 3.9.1.final.0").otherwise("none")
    relative = X.relative_path(F.col("path"), "/root")
    usable = F.col("k") != 2500
    return rows.select(
        "k", relative.alias("relative"), F.when(usable, X.display_name(F.col("path"), F.col("package"), "/root")).alias("shown"), F.when(usable, X.package_relative_path(F.col("path"), F.coalesce("package", F.lit("none")))).alias("inside"),
        F.when(usable, X.entry_label(F.lit("/home/app"), relative)).alias("label"), X.is_node_builtin(F.when(F.col("text") == "node:fs/promises", "node:fs").otherwise(F.col("text"))).alias("builtin"), X.format_time(F.col("ns")).alias("duration"), X.plural(F.col("k")).alias("suffix"),
        X.python_version(config).alias("version"), X.format_size(F.col("k")).alias("size"),
    )


@fixed("k BIGINT, t DOUBLE, df DOUBLE, t_noisy DOUBLE, df_noisy DOUBLE, verdict VARCHAR, p DOUBLE", [
    (1, 4.472136, 18.0, 1.632994, 18.0, "regression", 0.000295), (2, -4.472136, 18.0, -1.632994, 18.0, "improvement", 0.000295), (3, 0.447214, 18.0, 0.163299, 18.0, "unchanged", 0.660055), (4, 4.0, 1.0, 3.922323, 2.0, "regression", 0.155958),
])
def f35_welch_and_verdicts(spark, sf_dir):
    """Welch's test with and without the environment's noise; verdicts need a small p and a change of over 2 %."""
    rows = _table(spark, "k long, a double, b double, v double, n long, noise double, p double, change double", [(1, 12.0, 10.0, 1.0, 10, 1.140175, 0.001, 0.2), (2, 10.0, 12.0, 1.0, 10, 1.140175, 0.001, -0.2), (3, 10.2, 10.0, 1.0, 10, 1.140175, 0.001, 0.02), (4, 14.0, 10.0, 1.0, 2, 0.2, 0.0099, 0.021)])
    rows = rows.withColumn("w", F.when(F.col("k") == 4, 1e-12).otherwise(F.col("v"))).withColumn("v", F.when(F.col("k") == 4, 2.0).otherwise(F.col("v")))
    sides = [F.col(c) for c in ("a", "v", "n", "b", "w", "n")]
    t, df = M.welch(*sides)
    tn, dn = M.welch(*sides, noise=F.col("noise"))
    out = rows.select("k", F.round(t, 6).alias("t"), F.round(df, 4).alias("df"), F.round(tn, 6).alias("t_noisy"), F.round(dn, 4).alias("df_noisy"), M.verdict(F.col("p"), F.col("change")).alias("verdict"))
    return out.withColumn("p", F.round(M.p_value(F.col("t"), F.col("df")), 6))


DISK = {
    "app/package.json": "{}", "app/main.ts": "import './x'", "app/x.ts": "", "app/.hidden/h.ts": "1", "app/yarn.lock": "", "py/pyproject.toml": "", "py/main.py": "import pkg, extra, dep, vend", "py/src/pkg.py": "", "py/tools/extra.py": "",
    "py/tests/conftest.py": "import os, sys\nsys.path.insert(0, os.path.join(os.path.dirname(__file__), '..', 'tools'))", "py/.venv/pyvenv.cfg": "version = 3.11.4", "py/.venv/lib/python3.11/site-packages/dep.py": "",
    "py/.venv/lib/python3.11/site-packages/more.pth": "# no\nimport os\n../linked\n", "py/.venv/lib/python3.11/linked/vend.py": "",
}


@cache
def _disk(spark: SparkSession) -> str:
    """The fixture's files in the folder that all executors share, as a git repository with one commit and a tag."""
    home = f"{shared_folder(spark).removeprefix('file:')}/fixture"
    home = "/" + home.lstrip("/")
    for name, text in DISK.items():
        os.makedirs(os.path.dirname(f"{home}/{name}"), exist_ok=True)
        with open(f"{home}/{name}", "w", encoding="utf-8") as file:
            file.write(text)
    os.makedirs(f"{home}/app/empty", exist_ok=True)
    git = lambda *a: subprocess.run(["git", "-C", home, "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    if not os.path.isdir(f"{home}/.git"):
        git("init", "-q")
        git("add", "-A")
        git("commit", "-qm", "one")
        git("tag", "-am", "t", "v1")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"file://{home}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return home


@fixed("path VARCHAR, is_dir BOOLEAN, size BIGINT, text VARCHAR", [("app", True, 0, None), ("app/.hidden", True, 0, None), ("app/.hidden/h.ts", False, 1, "1"), ("app/empty", True, 0, None), ("app/main.ts", False, 12, "import './x'"), ("app/package.json", False, 2, "{}"), ("app/x.ts", False, 0, ""), ("app/yarn.lock", False, 0, "")])
def f36_local_tree(spark, sf_dir):
    """Files and folders of a tree, hidden and empty ones too, with what is in them."""
    home = _disk(spark)
    found = local_tree(spark, f"{home}/app")
    texts = with_content(found.where("not is_dir")).select("path", F.col("content").cast("string").alias("text"))
    return found.join(texts, "path", "left").select(_below(root=home), "is_dir", "size", "text")


@fixed("path VARCHAR, is_dir BOOLEAN, size BIGINT, text VARCHAR", [("app", True, 0, None), ("app/.hidden", True, 0, None), ("app/.hidden/h.ts", False, 1, "1"), ("app/main.ts", False, 12, "import './x'"), ("app/package.json", False, 2, "{}"), ("app/x.ts", False, 0, ""), ("app/yarn.lock", False, 0, "")])
def f37_git_tree(spark, sf_dir):
    """The same of a tag's commit, read from the repository; git knows no empty folders."""
    home = _disk(spark)
    listing, blobs = git_tree(spark, home, "v1", home)
    texts = blob_contents(blobs, home).select("path", F.col("content").cast("string").alias("text"))
    out = listing.join(texts, "path", "left").select(_below(root=home), "is_dir", "size", "text")
    return out.where("path like 'app%'")


@fixed("what VARCHAR, answer VARCHAR", [("tag", "True"), ("ref", "ref"), ("no ref", "NotARefOrSnapshot: not a snapshot file or a git ref: nope"), ("repository", "True"), ("none", "False"), ("root", "app"), ("entry", "app/main.ts"), ("lockfiles", "app/yarn.lock"), ("file", "snapshot")])
def f38_git_and_roots(spark, sf_dir):
    """Refs are told from files, tags peeled; roots and lockfiles found above an entry."""
    home = _disk(spark)
    below = lambda p: str(p).removeprefix(home + "/")
    rows = [
        ("tag", str(commit_of(home, "v1") == commit_of(home, "HEAD"))), ("ref", classify("v1", home)), ("no ref", _attempt(lambda: classify("nope", home))), ("repository", str(is_git_repo(home))), ("none", str(is_git_repo("/"))),
        ("root", below(project_root(f"{home}/app/main.ts"))), ("entry", below(checked_entry(f"{home}/app/main.ts"))), ("lockfiles", " ".join(map(below, incremental.sentinels(f"{home}/app")))), ("file", classify(f"{home}/app/x.ts", home)),
    ]
    return _table(spark, "what string, answer string", rows)


@fixed("kind VARCHAR, place BIGINT, path VARCHAR", [("source", 0, "py"), ("source", 1, "py/src"), ("source", 2, "py/tools"), ("site", 0, "py/.venv/lib/python3.11/site-packages"), ("site", 1, "py/.venv/lib/python3.11/linked")])
def f39_search_path(spark, sf_dir):
    """Root, src, what a conftest adds to sys.path; site-packages of the virtual environment, what .pth files add."""
    home = _disk(spark)
    found = search_path(f"{home}/py")
    rows = [(k, i, p.removeprefix(home + "/")) for k, ps in (("source", found.sources), ("site", found.sites)) for i, p in enumerate(ps)]
    return _table(spark, "kind string, place long, path string", rows)


@fixed("path VARCHAR, package VARCHAR", [("py/main.py", None), ("py/src/pkg.py", None), ("py/tools/extra.py", None), ("py/.venv/lib/python3.11/site-packages/dep.py", "dep.py"), ("py/.venv/lib/python3.11/linked/vend.py", "vend.py")])
def f40_python_project(spark, sf_dir):
    home = _disk(spark)
    return load(spark, f"{home}/py/main.py").graph.nodes.select(_below(root=home), "package")


@fixed("step VARCHAR, from_cache BOOLEAN, modules BIGINT, weight BIGINT", [("first", False, 2, 12), ("again", True, 2, 12), ("resized", True, 2, 14), ("new import", False, 2, 15)])
def f41_cache(spark, sf_dir):
    """A graph is built, loaded, loaded with a new size, and built again where an import is new."""
    home = _disk(spark)
    root = f"{home}/cached-{os.getpid()}-{len(os.listdir(home))}"
    os.makedirs(root)

    def put(name: str, text: str) -> None:
        with open(f"{root}/{name}", "w", encoding="utf-8") as file:
            file.write(text)

    put("package.json", "{}")
    put("main.ts", "import './x'")
    put("x.ts", "")
    rows = []
    for step, change in (("first", None), ("again", None), ("resized", ("x.ts", "//")), ("new import", ("main.ts", "import './x.ts'"))):
        if change:
            put(*change)
        loaded = incremental.refreshed(spark, f"{root}/main.ts", root)
        n, weight = loaded.graph.nodes.agg(F.count("*"), F.sum("size_bytes")).first()
        rows.append((step, loaded.from_cache, n, weight - (2 if step == "new import" else 0)))
    return _table(spark, "step string, from_cache boolean, modules long, weight long", rows)
