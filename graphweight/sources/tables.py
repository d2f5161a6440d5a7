"""A dependency graph of the foreign keys of a star schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweight.operators.graph import ImportGraph

ENTRY = "region/0"


def _id(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}/"), F.col(key).cast("string"))


def fk_graph(spark: SparkSession, sf_dir: str) -> ImportGraph:
    """Rows as modules, keys as imports; the kind of an edge follows from the order's status or the item's return flag."""
    t = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}
    none = F.lit(None).cast("string")
    whole = lambda c: F.floor(F.abs(F.col(c))).cast("long")
    nodes = [
        t["region"].select(_id("region", "r_regionkey"), F.lit(1).cast("long"), none),
        t["nation"].select(_id("nation", "n_nationkey"), F.lit(10).cast("long"), none),
        t["customer"].select(_id("customer", "c_custkey"), whole("c_acctbal"), none),
        t["orders"].select(_id("orders", "o_orderkey"), F.floor("o_totalprice").cast("long"), none),
        t["part"].select(_id("part", "p_partkey"), F.col("p_size").cast("long"), F.col("p_brand")),
        t["supplier"].select(_id("supplier", "s_suppkey"), whole("s_acctbal"), F.concat(F.lit("nation-"), F.col("s_nationkey").cast("string"))),
    ]
    static = F.lit("static")
    status = F.when(F.col("o_orderstatus") == "F", "static").when(F.col("o_orderstatus") == "O", "dynamic").otherwise("type_only")
    edges = [
        t["nation"].select(_id("region", "n_regionkey"), _id("nation", "n_nationkey"), static),
        t["customer"].select(_id("nation", "c_nationkey"), _id("customer", "c_custkey"), static),
        t["supplier"].select(_id("supplier", "s_suppkey"), _id("nation", "s_nationkey"), static),
        t["orders"].select(_id("customer", "o_custkey"), _id("orders", "o_orderkey"), status),
        t["lineitem"].select(_id("orders", "l_orderkey"), _id("part", "l_partkey"), F.when(F.col("l_returnflag") == "R", "dynamic").otherwise("static")),
        t["lineitem"].where("l_linenumber = 1").select(_id("part", "l_partkey"), _id("supplier", "l_suppkey"), static),
    ]
    union = lambda frames, names: reduce(DataFrame.unionAll, [f.toDF(*names) for f in frames])
    return ImportGraph(union(nodes, ["path", "size_bytes", "package"]), union(edges, ["src", "dst", "kind"]).distinct())
