import random

import pytest
from pyspark.sql import functions as F

from graphweight.operators import chains as C
from graphweight.operators import diff as D
from graphweight.operators import dominators
from graphweight.operators.dominators import exclusive_weights
from graphweight.operators.graph import ImportGraph
from graphweight.operators.trace import Trace, TraceOptions
from graphweight.schema import SNAPSHOT


def graph_of(spark, nodes, edges):
    rows = [(n, *(v if isinstance(v, tuple) else (v, None))) for n, v in nodes.items()]
    links = [(a, b, {"S": "static", "D": "dynamic", "T": "type_only"}[k], b, i) for i, (a, k, b) in enumerate(edges)]
    return ImportGraph.of(spark.createDataFrame(rows, "path string, size_bytes long, package string"), spark.createDataFrame(links, "src string, dst string, kind string, specifier string, ord long"))


def edges(text):
    return [(x.split(">")[0].rstrip("~"), "D" if "~" in x else "S", x.split(">")[1]) for x in text.split()]


DIAMOND = {"e": 100, "a": 200, "b": 300, "d": 500}


def test_static_and_dynamic_weight(spark):
    g = graph_of(spark, {"a": 100, "b": 200, "c": 300}, edges("a>b a~>c"))
    t = Trace.of(g, "a")
    assert tuple(t.summary().first()) == (300, 2, 300, 1)
    assert tuple(t.summary(True).first()) == (600, 3, 0, 0)


@pytest.mark.parametrize(
    ("nodes", "links", "want"),
    [
        ({"e": 100, "a": 200, "b": 300}, "e>a a>b", {"e": 600, "a": 500, "b": 300}),
        (DIAMOND, "e>a a>d e>b b>d", {"e": 1100, "a": 200, "b": 300, "d": 500}),
        (DIAMOND | {"x": 600}, "e>a a>d e>b b>d a>x", {"e": 1700, "a": 800, "b": 300, "d": 500, "x": 600}),
    ],
)
def test_exclusive(spark, nodes, links, want):
    g = graph_of(spark, nodes, edges(links))
    assert dict(map(tuple, exclusive_weights(g, "e").collect())) == want
    assert dict(map(tuple, exclusive_weights(g, "e", kernel_edges=0).collect())) == want


def test_exclusive_with_dynamic(spark):
    g = graph_of(spark, {"e": 100, "a": 200, "b": 300, "c": 400}, edges("e>a a>c e~>b b>c"))
    assert dict(map(tuple, exclusive_weights(g, "e").collect()))["a"] == 600
    found = dict(map(tuple, exclusive_weights(g, "e", True).collect()))
    assert (found["a"], found["b"]) == (200, 300)


def test_exclusive_on_random_graphs(spark):
    rng = random.Random(5)
    nodes, links = {}, []
    for k in range(12):
        n = rng.randint(2, 9)
        nodes |= {f"{k}.{i}": rng.randint(1, 99) for i in range(n)}
        links += [(f"{k}.{rng.randrange(n)}", "S", f"{k}.{rng.randrange(n)}") for _ in range(rng.randint(1, 3 * n))]
        links.append(("0", "S", f"{k}.0"))
    g = graph_of(spark, nodes | {"0": 1}, links).stored()
    sizes, after = nodes | {"0": 1}, {}
    for a, _, b in links:
        after.setdefault(a, set()).add(b)

    def weight(avoid):
        seen, todo = set(), [] if avoid == "0" else ["0"]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += after.get(x, set()) - {avoid}
        return sum(sizes[x] for x in seen), seen

    total, reached = weight(None)
    want = sorted((x, total - weight(x)[0]) for x in reached)
    assert sorted(map(tuple, exclusive_weights(g, "0").collect())) == want
    assert sorted(map(tuple, exclusive_weights(g, "0", kernel_edges=0).collect())) == want


def test_exclusive_on_tables_reads_edges_once_and_keeps_rows_few(spark, monkeypatch):
    """Diamonds in a row with dead ends between (each joint is dominated by all before it), and a way around the last ones."""
    links, n = [], 5
    for k in range(n):
        links += [(f"j{k}", "S", f"a{k}"), (f"a{k}", "S", f"c{k}"), (f"a{k}", "S", f"b{k}"), (f"c{k}", "S", f"j{k + 1}"), (f"b{k}", "S", f"j{k + 1}"), (f"j{k + 1}", "S", f"a{k}")]
    links += [(f"c{n - 4}", "S", f"j{n}"), ("x", "S", "y"), ("y", "S", "x"), ("y", "S", "j3"), ("z", "S", "j4")]
    g = graph_of(spark, {x: 1 + i % 7 for i, x in enumerate(sorted({y for a, _, b in links for y in (a, b)}))}, links)
    read, rows, put = spark.sparkContext.accumulator(0), [], dominators.written

    def once(path: str) -> str:
        read.add(1)
        return path

    def counted(frame):
        out = put(frame)
        rows.append(out.count())
        return out

    monkeypatch.setattr(dominators, "written", counted)
    edges = g.edges.withColumn("src", F.udf(once, "string").asNondeterministic()("src"))
    found = exclusive_weights(ImportGraph(g.nodes, edges), "j0", kernel_edges=0).collect()
    assert read.value == len(links)
    assert max(rows) <= len(links)
    assert sorted(map(tuple, found)) == sorted(map(tuple, exclusive_weights(g, "j0").collect()))


def test_chains_and_cuts(spark):
    g = graph_of(spark, {"a": 1, "b": 2, "c": 3, "d": 4, "z": (5, "zod")}, edges("a>b a>c b>d c>d d>z"))
    target = C.Target(package="zod")
    chains = C.find_chains(g, "a", target).orderBy("idx").collect()
    assert [r["modules"] for r in chains] == [["a", "b", "d", "z"], ["a", "c", "d", "z"]]
    found = C.find_chains(g, "a", target)
    cuts = C.cuts(C.cut_candidates(g, found, "a", target), exclusive_weights(g, "a"), 2)
    assert [tuple(r) for r in cuts.collect()] == [("d", 2, 9)]
    assert tuple(C.path_counts(g, "a", target).first()) == (3, 2)


def test_chain_dedup_by_package_and_dynamic_hops(spark):
    g = graph_of(spark, {"a": 1, "b": 2, "i": (1, "zod"), "l": (1, "zod")}, edges("a~>b b>i b>l"))
    assert C.find_chains(g, "a", C.Target(package="zod")).isEmpty()
    row = C.find_chains(g, "a", C.Target(package="zod"), include_dynamic=True).collect()
    assert len(row) == 1 and row[0]["edge_kinds"] == ["dynamic", "static"] and tuple(row[0]["classification"]) == ("mixed", 0)


def test_single_chain_cuts_ascend_and_fan_in_is_capped(spark):
    g = graph_of(spark, {"a": 100, "b": 5000, "c": 100, "z": (500, "zod")}, edges("a>b b>c c>z"))
    t = C.Target(package="zod")
    cuts = C.cuts(C.cut_candidates(g, C.find_chains(g, "a", t), "a", t), exclusive_weights(g, "a"), 1).collect()
    assert [r["path"] for r in cuts] == ["c", "b"]
    many = graph_of(spark, {"e": 1, "h": 1, "z": (1, "zod")} | {f"f{i}": 1 for i in range(25)}, edges("e>h " + " ".join(f"h>f{i} f{i}>z" for i in range(25))))
    assert C.find_chains(many, "e", t).count() == 10
    assert C.path_counts(many, "e", t).first()["path_count"] == 25


def test_direct_and_trivial(spark):
    g = graph_of(spark, {"a": 1, "z": (5, "zod")}, edges("a>z"))
    t = C.Target(package="zod")
    found = C.find_chains(g, "a", t)
    assert C.cut_candidates(g, found, "a", t).isEmpty() and C.direct_import(found, True).first()[0]
    assert C.find_chains(g, "a", C.Target(module="a")).first()["modules"] == ["a"]
    assert C.find_chains(g, "z", C.Target(module="a")).isEmpty()


def test_heavy_packages_ignore_and_top(spark):
    g = graph_of(spark, {"e": 100, "a": (50, "pa"), "b": (200, "pb"), "c": (300, "pc")}, edges("e>a e>b e>c"))
    t = Trace.of(g, "e")
    assert [r["name"] for r in t.heavy_packages(TraceOptions(ignore=["pc"])).collect()] == ["pb", "pa"]
    assert t.heavy_packages(TraceOptions(top_n=0)).isEmpty() and t.heavy_packages(TraceOptions(top_n=-1)).count() == 3
    assert t.summary().first()["static_weight"] == 650
    assert t.with_chains(t.heavy_packages()).first()["chain"] == ["e", "c"]


def test_two_traces_at_once(spark):
    g = graph_of(spark, {"a": 100, "b": 200, "c": 300, "d": (7, "p")}, edges("a>b a~>c b>c c~>d"))
    x, y = Trace.both(g, "a", "c")
    assert [tuple(t.summary().first()) for t in (x, y)] == [tuple(Trace.of(g, n).summary().first()) for n in "ac"] == [(600, 3, 7, 1), (300, 1, 7, 1)]
    s = x.snapshot().first()
    assert (s["entry"], s["static_weight"], s["packages"], s["dynamic_weight"], s["dynamic_packages"]) == ("a", 600, {}, 7, {"p": 7})


def test_tree_follows_a_queue_over_many_levels(spark):
    deep = graph_of(spark, {f"n{i:02}": 1 for i in range(14)}, edges(" ".join(f"n{i:02}>n{i + 1:02}" for i in range(13)) + " n00>n04"))
    t = Trace.of(deep, "n00")
    assert {r["node"]: r["depth"] for r in t.static.collect()} == {f"n{i:02}": i if i < 4 else i - 3 for i in range(14)}
    assert C.find_chains(deep, "n00", C.Target(module="n13")).first()["modules"] == ["n00", *[f"n{i:02}" for i in range(4, 14)]]
    assert dict(map(tuple, exclusive_weights(deep, "n00", kernel_edges=0).collect()))["n04"] == 10


def test_edge_dedup_and_leaves(spark):
    g = graph_of(spark, {"a": 1}, [("a", "S", "b"), ("a", "S", "b"), ("a", "D", "b")])
    assert g.edges.count() == 2
    full = g.with_leaves(spark.createDataFrame([("b", 7, None)], "path string, size_bytes long, package string"))
    assert {tuple(r) for r in full.nodes.collect()} == {("a", 1, None), ("b", 7, None)}
    assert [tuple(r)[:2] for r in full.with_ids().orderBy("id").collect()] == [(0, "a"), (1, "b")]


def test_diff(spark):
    make = lambda *row: spark.createDataFrame([row], SNAPSHOT)
    a = make("A", 1000, {"zod": 500, "chalk": 200, "tslog": 300}, 200, {"lodash": 200})
    b = make("B", 800, {"chalk": 200, "tslog": 300, "ajv": 100}, 350, {"moment": 350})
    s = D.diff_summary(a, b).first()
    assert (s["weight_delta"], s["dynamic_weight_delta"], s["shared_count"]) == (-200, 150, 2)
    assert {(r["section"], r["name"]) for r in D.diff_sections(a, b).collect()} == {("only_in_a", "zod"), ("only_in_b", "ajv"), ("dynamic_only_in_a", "lodash"), ("dynamic_only_in_b", "moment")}
