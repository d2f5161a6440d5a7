"""All queries of the engine by name, over the foreign-key graph and the events of the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweight.functions import scalar as X
from graphweight.functions import stats as M
from graphweight.operators import chains as C
from graphweight.operators import diff as D
from graphweight.operators.closure import tree
from graphweight.operators.dominators import exclusive_weights
from graphweight.operators.graph import ImportGraph, followed
from graphweight.operators.trace import Trace, TraceOptions, transitive_importers
from graphweight.sources.tables import ENTRY, fk_graph
from graphweight.storage import written

from . import fixtures
from .oracle import ORACLES

Query = Callable[[SparkSession, str], DataFrame]
OTHER_ENTRY, TARGET_PACKAGE, THRESHOLD = "region/1", "Brand#7", 1_000_000
_QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    _QUERIES[function.__name__] = function
    return function


def _trace(spark: SparkSession, sf_dir: str, entry: str = ENTRY) -> Trace:
    return Trace.of(fk_graph(spark, sf_dir).stored(), entry)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value")


@query
def q01_edge_counts(spark, sf_dir):
    return fk_graph(spark, sf_dir).edge_counts()


@query
def q02_dangling(spark, sf_dir):
    """Edges of orders whose parts of size 1 are taken away, by source kind."""
    graph = fk_graph(spark, sf_dir)
    graph.nodes = graph.nodes.where("not (path like 'part/%' and size_bytes = 1)")
    return graph.dangling().groupBy("kind").agg(F.count("*").alias("unresolved"), F.countDistinct("dst").alias("targets"))


@query
def q03_packages(spark, sf_dir):
    return fk_graph(spark, sf_dir).packages(10).drop("entry_module")


@query
def q04_imports(spark, sf_dir):
    graph = fk_graph(spark, sf_dir)
    graph.edges = graph.edges.withColumn("ord", F.lit(0))
    return graph.imports("nation/3")


@query
def q05_importers(spark, sf_dir):
    return fk_graph(spark, sf_dir).importers("nation/3")


@query
def q06_static_weight(spark, sf_dir):
    return _trace(spark, sf_dir).static_summary()


@query
def q07_dynamic_only_weight(spark, sf_dir):
    return _trace(spark, sf_dir).dynamic_summary()


@query
def q07b_include_dynamic(spark, sf_dir):
    return _trace(spark, sf_dir).summary(include_dynamic=True)


@query
def q08_heavy_packages(spark, sf_dir):
    return _trace(spark, sf_dir).heavy_packages()


@query
def q09_heavy_packages_ignoring(spark, sf_dir):
    return _trace(spark, sf_dir).heavy_packages(TraceOptions(ignore=["Brand#1", "nation-3"], top_n=-1))


@query
def q10_dynamic_packages(spark, sf_dir):
    return _trace(spark, sf_dir).dynamic_packages()


@query
def q11_exclusive_weight(spark, sf_dir):
    """Of every module that the entry reaches, from the dominator tree."""
    return exclusive_weights(fk_graph(spark, sf_dir), ENTRY)


@query
def q11b_exclusive_weight_dynamic(spark, sf_dir):
    """With dynamic edges, from the dominators' table (no task holds the graph)."""
    return exclusive_weights(fk_graph(spark, sf_dir), ENTRY, include_dynamic=True, kernel_edges=0)


@query
def q11c_modules_by_cost(spark, sf_dir):
    """The modules other than packages' by their exclusive weight."""
    trace = _trace(spark, sf_dir)
    return trace.modules_by_cost(exclusive_weights(trace.graph, ENTRY))


@query
def q12_depths(spark, sf_dir):
    return _trace(spark, sf_dir).static.groupBy("depth").agg(F.count("*").alias("modules"))


@query
def q13_threshold(spark, sf_dir):
    return _trace(spark, sf_dir).exceeds(THRESHOLD)


@query
def q14_path_count(spark, sf_dir):
    return C.path_counts(fk_graph(spark, sf_dir).stored(), ENTRY, C.Target(package=TARGET_PACKAGE))


def _module_target(graph) -> C.Target:
    """The first part by path that has the fewest hops from the entry."""
    depth = tree(graph.edges.where(followed(False)), ENTRY, stop=F.col("node").startswith("part/"))
    return C.Target(module=depth.where("node like 'part/%'").agg(F.min("node").alias("n")).first()["n"] or "part/0")


def _chains(spark, sf_dir):
    graph = fk_graph(spark, sf_dir).stored()
    target = _module_target(graph)
    return graph, target, written(C.find_chains(graph, ENTRY, target, max_chains=100))


@query
def q15_chains(spark, sf_dir):
    found = _chains(spark, sf_dir)[2]
    return found.select(F.array_join("modules", ">").alias("chain"), F.array_join("edge_kinds", ">").alias("kinds"), F.col("classification.type").alias("type"))


@query
def q16_chain_frequency(spark, sf_dir):
    return C.module_frequency(_chains(spark, sf_dir)[2])


@query
def q17_cuts(spark, sf_dir):
    graph, target, found = _chains(spark, sf_dir)
    candidates = written(C.cut_candidates(graph, found, ENTRY, target))
    return C.cuts(candidates, exclusive_weights(graph, ENTRY), found.count())


def _pair(spark, sf_dir):
    return Trace.both(fk_graph(spark, sf_dir).stored(), ENTRY, OTHER_ENTRY)


@query
def q18_diff_sections(spark, sf_dir):
    """The entry in two states of the graph: without two packages of suppliers, and without two of parts."""
    graph, sides = fk_graph(spark, sf_dir).stored(), []
    for names in (["nation-3", "nation-4"], ["Brand#1", "Brand#2"]):
        gone = graph.nodes.where(F.col("package").isin(names)).select(F.col("path").alias("dst"))
        sides.append(Trace.of(ImportGraph(graph.nodes, graph.edges.join(gone, "dst", "left_anti")), ENTRY))
    a, b = sides
    return D.sections(a.packages(), b.packages(), a.dynamic_packages(), b.dynamic_packages())


@query
def q19_shared_packages(spark, sf_dir):
    a, b = _pair(spark, sf_dir)
    return D.shared_count(a.packages(), b.packages())


@query
def q20_diff_dynamic(spark, sf_dir):
    x, y = (t.dynamic_packages() for t in _pair(spark, sf_dir))
    return x.join(y.withColumnRenamed("total_size_bytes", "other"), "name", "full").select("name", F.col("total_size_bytes").alias("size_a"), F.col("other").alias("size_b"))


@query
def q21_diff_summary(spark, sf_dir):
    return D.diff_summary(*(t.snapshot() for t in _pair(spark, sf_dir)))


@query
def q22_snapshot_json(spark, sf_dir):
    """A snapshot through JSON and back."""
    from graphweight.schema import SNAPSHOT

    one = _trace(spark, sf_dir).snapshot().select(F.to_json(F.struct("*")).alias("j")).select(F.from_json("j", SNAPSHOT).alias("s")).select("s.*")
    total = lambda c: F.aggregate(F.map_values(c), F.lit(0).cast("long"), lambda a, x: a + x)
    return one.select("entry", "static_weight", F.size("packages").cast("long").alias("n_packages"), total("packages").alias("package_bytes"), "dynamic_weight", F.size("dynamic_packages").cast("long").alias("n_dynamic"))


@query
def q23_format_size(spark, sf_dir):
    return fk_graph(spark, sf_dir).nodes.select("path", X.format_size(F.col("size_bytes")).alias("size"))


@query
def q24_parse_size(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    text = F.concat(F.lit(" "), F.col("p_size").cast("string"), F.element_at(F.array(*map(F.lit, (".5 MB", "KB", "B", "", "x"))), (F.col("p_partkey") % 5 + 1).cast("int")), F.lit(" "))
    return parts.select("p_partkey", text.alias("text"), X.parse_size(text).alias("bytes"))


def _paths(spark, sf_dir):
    """Made-up module paths of parts."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    k, kind = F.col("p_partkey").cast("string"), F.col("p_partkey") % 8
    name = F.lower(F.regexp_replace("p_brand", "#", ""))
    path = F.when(kind == 0, F.concat(F.lit("app/src/m"), k, F.lit(".ts")))
    path = path.when(kind == 1, F.concat(F.lit("app/node_modules/"), name, F.lit("/index.js")))
    path = path.when(kind == 2, F.concat(F.lit("app/node_modules/@s/"), name, F.lit("/lib/x"), k, F.lit(".mjs")))
    path = path.when(kind == 3, F.concat(F.lit("app/node_modules/.pnpm/"), name, F.lit("@1/node_modules/"), name, F.lit("/a.js")))
    path = path.when(kind == 4, F.concat(F.lit("venv/site/"), name, F.lit("/__init__.py")))
    path = path.when(kind == 5, F.concat(F.lit("venv/site/"), name, F.lit(".cpython-311.so")))
    path = path.when(kind == 6, F.concat(F.lit("venv/site/"), name, F.lit("-1.dist-info/RECORD"))).otherwise(F.concat(F.lit("app/.git/o"), k, F.lit(".ts")))
    return parts.select("p_partkey", path.alias("path"), name.alias("name"))


@query
def q25_node_package(spark, sf_dir):
    return _paths(spark, sf_dir).select("p_partkey", X.node_package(F.col("path")).alias("package"))


@query
def q26_python_package(spark, sf_dir):
    return _paths(spark, sf_dir).select("p_partkey", X.python_package(F.col("path"), ["venv/site"]).alias("package"))


@query
def q27_looks_like_path(spark, sf_dir):
    text = F.when(F.col("p_partkey") % 3 == 0, F.col("path")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("@"), F.col("name"))).otherwise(F.concat("name", F.lit(".ts")))
    return _paths(spark, sf_dir).select("p_partkey", text.alias("text")).select("*", X.looks_like_path(F.col("text"), X.LANGUAGE_EXTENSIONS["typescript"]).alias("is_path"))


@query
def q28_watch_filter(spark, sf_dir):
    return _paths(spark, sf_dir).select("p_partkey", X.is_relevant_event(F.col("path"), X.LANGUAGE_EXTENSIONS["typescript"]).alias("relevant"))


@query
def q28b_package_relative_path(spark, sf_dir):
    return _paths(spark, sf_dir).select("p_partkey", X.package_relative_path(F.col("path"), F.col("name")).alias("shown"))


@query
def q29_completion(spark, sf_dir):
    """The first 20 paths with a prefix."""
    nodes = fk_graph(spark, sf_dir).nodes.select("path")
    return nodes.where(F.col("path").startswith("part/1")).orderBy("path").limit(20)


@query
def q30_median(spark, sf_dir):
    return M.medians(_events(spark, sf_dir), "value", ["event_type"])


@query
def q31_mad(spark, sf_dir):
    return M.mads(_events(spark, sf_dir), "value", ["event_type"]).select("event_type", F.round("mad", 9).alias("mad"))


@query
def q32_moments(spark, sf_dir):
    r = lambda c: F.round(c, 6).alias(c)
    return M.moments(_events(spark, sf_dir), "value", ["event_type"]).select("event_type", "n", r("mean"), r("variance"), r("cv"))


@query
def q33_trimmed_mean(spark, sf_dir):
    return M.trimmed_means(_events(spark, sf_dir), "value", ["event_type"]).select("event_type", F.round("trimmed_mean", 6).alias("trimmed_mean"))


@query
def q34_welch(spark, sf_dir):
    """Each event type against clicks."""
    m = M.moments(_events(spark, sf_dir), "value", ["event_type"])
    one = m.where("event_type = 'click'").select(F.col("mean").alias("m0"), F.col("variance").alias("v0"), F.col("n").alias("n0"))
    rows = m.where("event_type <> 'click'").join(F.broadcast(one))  # one row
    t, df = M.welch(F.col("mean"), F.col("variance"), F.col("n"), F.col("m0"), F.col("v0"), F.col("n0"))
    return rows.select("event_type", F.round(t, 6).alias("t"), F.round(df, 4).alias("df"))


@query
def q34b_p_value(spark, sf_dir):
    """As q34, with the p-value of Student's distribution; the SQL integrates its density."""
    rows = q34_welch(spark, sf_dir)
    return rows.select("event_type", F.round(M.p_value(F.col("t"), F.col("df")), 6).alias("p"))


def _changes(spark, sf_dir):
    """Relative change of each user's mean value of odd against even events."""
    e = _events(spark, sf_dir).withColumn("odd", F.col("event_id") % 2 == 1)
    m = e.groupBy("user_id").agg(F.avg(F.when(F.col("odd"), F.col("value"))).alias("a"), F.avg(F.when(~F.col("odd"), F.col("value"))).alias("b"))
    return m.where("a is not null and b > 0").select("user_id", (F.col("a") / F.col("b") - 1).alias("change"))


@query
def q35_noise_floor(spark, sf_dir):
    return M.noise_floor(_changes(spark, sf_dir), "change").select(F.round("noise_floor", 6).alias("noise_floor"))


@query
def q35b_bias_adjusted(spark, sf_dir):
    return M.bias_adjusted(_changes(spark, sf_dir), "change").select("user_id", F.round("change", 6).alias("change"))


@query
def q36_transitive_importers(spark, sf_dir):
    return transitive_importers(fk_graph(spark, sf_dir).stored(), "part/1").groupBy("depth").agg(F.count("*").alias("modules"))


def queries() -> dict[str, Query]:
    return _QUERIES | fixtures.QUERIES


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, sql in (ORACLES | fixtures.ORACLES).items() if name in queries()}
