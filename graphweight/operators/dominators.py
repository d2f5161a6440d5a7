"""Exclusive weights: the size of what becomes unreachable without a module."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweight.storage import release, written

from .closure import by_level, reach
from .graph import ImportGraph, followed

#: Edges of a graph that one task may turn into a dominator tree.
KERNEL_EDGES = 5_000_000


def immediate_dominators(n: int, src: np.ndarray, dst: np.ndarray, entry: int) -> tuple[np.ndarray, np.ndarray]:
    """Immediate dominator of each node (-1 if not reachable), and the reachable nodes in reverse post-order.

    Dominators are found as fixed point over reverse post-order: the nearest common dominator of a node's predecessors.
    """
    by = np.argsort(src, kind="stable")
    heads, bounds = dst[by].tolist(), np.searchsorted(src[by], np.arange(n + 1)).tolist()
    number = [-1] * n
    post: list[int] = []
    visited = [False] * n
    visited[entry] = True
    path = [(entry, bounds[entry])]
    while path:
        node, at = path.pop()
        end = bounds[node + 1]
        while at < end and visited[heads[at]]:
            at += 1
        if at == end:
            number[node] = len(post)
            post.append(node)
        else:
            path.append((node, at + 1))
            visited[heads[at]] = True
            path.append((heads[at], bounds[heads[at]]))
    before: list[list[int]] = [[] for _ in range(n)]
    for u in post:
        for v in heads[bounds[u] : bounds[u + 1]]:
            before[v].append(u)
    order = post[::-1]
    idom = [-1] * n
    idom[entry] = entry
    moved = True
    while moved:
        moved = False
        for v in order[1:]:
            best = -1
            for u in before[v]:
                if idom[u] < 0:
                    continue
                if best < 0:
                    best = u
                    continue
                while u != best:
                    if number[u] < number[best]:
                        u = idom[u]
                    else:
                        best = idom[best]
            if best != idom[v]:
                idom[v], moved = best, True
    return np.array(idom), np.array(order)


def subtree_sums(idom: np.ndarray, order: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Size of each node's dominator subtree; 0 for nodes that the entry doesn't reach."""
    out = np.zeros(len(size), np.int64)
    out[order] = size[order]
    for v in order[:0:-1].tolist():
        out[idom[v]] += out[v]
    return out


def reached_part(nodes: DataFrame, edges: DataFrame, entry: str) -> tuple[DataFrame, DataFrame]:
    """The nodes (path, size_bytes) that the entry reaches and the edges (src, dst) between them, as tables."""
    reached = reach(edges, edges.sparkSession.createDataFrame([(entry,)], "node string")).select(F.col("node").alias("path"))
    sizes = written(reached.join(nodes.select("path", "size_bytes"), "path"))
    own = edges.join(sizes.select(F.col("path").alias("src")), "src", "left_semi").join(sizes.select(F.col("path").alias("dst")), "dst", "left_semi")
    return sizes, written(own.select("src", "dst").distinct())


def climbed(rows: DataFrame, circles: bool) -> DataFrame:
    """rows(node, up, chain), one a node: up becomes the root above the node (what is no node of the rows), chain what lies between, the root's end first.

    Pointers double: a round joins the rows that are not done with all rows. If there may be circles, chains must be
    of nodes: rows on circles have no root and are dropped; a row that leads into one may keep a node of it as its root.
    """
    now = written(rows.select("node", "up", "chain", F.lit(False).alias("done")))
    while not now.where("not done").isEmpty():
        above = now.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("chain").alias("_chain"), F.col("done").alias("_done"))
        new = now.where("not done").join(above, "up", "left")
        new = new.select("node", F.coalesce("_up", "up").alias("up"), F.when(F.col("_chain").isNull(), F.col("chain")).otherwise(F.concat("_chain", "chain")).alias("chain"), F.coalesce("_done", F.lit(True)).alias("done"))
        new = written(now.where("done").unionByName(new.where("not array_contains(chain, up)") if circles else new))
        release(now)
        now = new
    return now.drop("done")


def _in_order(rows: DataFrame, name: str, *by: str) -> DataFrame:
    """rows with a number that ascends with their order, as a table. They are range-partitioned, so no task holds them all."""
    return written(rows.repartitionByRange(*map(F.col, by)).sortWithinPartitions(*by).withColumn(name, F.monotonically_increasing_id()))


def _common(a: str, b: str) -> Column:
    """Length of the common start of two arrays."""
    differ = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(differ == 0, F.size(a)).otherwise(differ - 1).cast("int")


def grouped(edges: DataFrame, entry: str) -> tuple[DataFrame, DataFrame]:
    """The graph with every node that has one edge in it put to the node it hangs on: members and links, as tables.

    members(node, root, chain, pos): the chain leads from the group's root (not in it) to the node, each one's
    immediate dominator being the one before; pos numbers groups and their trees in pre-order. links(g, v, lo, hi):
    roots by pos; lo and hi are the first and the last member of g with an edge to v.
    """
    tagged = written(edges.join(edges.groupBy("dst").agg(F.count("*").alias("n")), "dst"))
    hung = climbed(tagged.where("n = 1").select(F.col("dst").alias("node"), F.col("src").alias("up"), F.array("dst").alias("chain")), circles=True)
    roots = tagged.where("n > 1").select("dst").distinct().unionByName(edges.sparkSession.createDataFrame([(entry,)], "dst string"))
    roots = roots.select(F.col("dst").alias("node"), F.col("dst").alias("root"), F.array().cast("array<string>").alias("chain"))
    members = _in_order(hung.select("node", F.col("up").alias("root"), "chain").unionByName(roots), "pos", "root", "chain")
    number = lambda of, to: members.where("node = root").select(F.col("node").alias(of), F.col("pos").alias(to))
    links = tagged.where("n > 1").join(members.select(F.col("node").alias("src"), "root", "pos"), "src")
    links = links.groupBy("root", "dst").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    links = written(links.join(number("dst", "v"), "dst").join(number("root", "g"), "root").where("g <> v").select("g", "v", "lo", "hi"))
    release(tagged)
    return members, links


def _above(members: DataFrame, links: DataFrame, keys: DataFrame) -> DataFrame:
    """(node, up, place): for each root the lowest node above all members that link to it, in the tree of keys(node, key, rank).

    In pre-order the lowest node above a set is that above its first and its last. Two groups' keys part below a
    group `up`; where that is not one of the two, the place is above what the keys name next.
    """
    ranked = links.join(keys.select(F.col("node").alias("g"), "rank"), "g")
    ends = ranked.groupBy("v").agg(F.min("rank").alias("first"), F.max("rank").alias("last"), F.min_by("lo", "rank").alias("lo"), F.min_by("hi", "rank").alias("hi"))
    by = lambda rank, key: keys.select(F.col("rank").alias(rank), F.col("key").alias(key))
    at = ((_common("a", "b") + 1) / 2).cast("int") * 2 - 1
    found = ends.join(by("first", "a"), "first").join(by("last", "b"), "last").withColumn("at", at).withColumn("up", F.element_at("a", F.col("at")))
    own = F.size("a") == F.col("at")
    below = lambda key: F.expr(f"try_element_at({key}, at + 1)")
    found = found.select("v", "up", "first", "last", own.alias("own"), F.when(own, F.col("lo")).otherwise(below("a")).alias("lo"), F.when(own, F.col("hi")).otherwise(below("a")).alias("hi"), below("b").alias("end"))
    found = written(found)
    # where `up` itself links to the root, what lies first among the others counts too
    mixed = found.where("own and first < last and lo <> up")
    if not mixed.isEmpty():
        second = ranked.join(mixed.select("v", "first"), "v").where("rank > first").groupBy("v").agg(F.min("rank").alias("second"))
        second = second.join(by("second", "a"), "second").join(mixed.select("v", "up"), "v").select("v", F.element_at("a", (F.array_position("a", F.col("up")) + 1).cast("int")).alias("start"))
        found = found.join(second, "v", "left")
    else:
        found = found.withColumn("start", F.lit(None).cast("long"))
    found = found.select(F.col("v").alias("node"), "up", F.least("lo", "start", "end").alias("lo"), F.greatest("hi", "start", "end").alias("hi"))
    plain = (F.col("lo") == F.col("hi")) | (F.col("lo") == F.col("up"))
    found = written(found)
    out = found.where(plain).select("node", "up", F.col("lo").alias("place"))
    loose = found.where(~plain)
    if loose.isEmpty():
        return out
    chain = lambda pos, to: members.select(F.col("pos").alias(pos), F.col("chain").alias(to))
    loose = loose.join(chain("lo", "a"), "lo").join(chain("hi", "b"), "hi").select("node", "up", F.when(_common("a", "b") > 0, F.element_at("a", _common("a", "b"))).alias("name"))
    loose = loose.join(members.select(F.col("node").alias("name"), "pos"), "name", "left")
    return out.unionByName(loose.select("node", "up", F.coalesce("pos", "up").alias("place")))


def dominators(members: DataFrame, links: DataFrame, entry: str) -> DataFrame:
    """(node, up, place, key) of the roots that the entry reaches, by pos: each one's immediate dominator is `place`, a member of the group `up`.

    key lists entry, place, root, place, root and so on down to the node. It starts as a spanning tree, which holds
    the dominators; a round hangs every root on the lowest node of the tree above all its predecessors, until none
    moves. What hangs on a root moves with it, so rounds are few. A round reads the links once, by partial minima and
    maxima, so that no root's links lie in one task.
    """
    first = members.where(F.col("node") == entry).select(F.col("pos").alias("node"), F.lit(None).cast("long").alias("up"), F.lit(None).cast("long").alias("place"))
    hops = links.select(F.col("g").alias("node"), "v", "lo")

    def step(frontier: DataFrame, visited: DataFrame) -> DataFrame:
        found = frontier.select("node").join(hops, "node").groupBy("v").agg(F.min("node").alias("up"), F.min_by("lo", "node").alias("place"))
        return found.withColumnRenamed("v", "node").join(visited, "node", "left_anti")

    tree = written(by_level(first, step, ["node"]).select("node", "up", "place").where("up is not null"))
    start = members.where(F.col("node") == entry).select(F.col("pos").alias("node"), F.array("pos").alias("key"))
    while True:
        up = climbed(tree.select("node", "up", F.array("place", "node").alias("chain")), circles=False)
        root = start.select(F.col("node").alias("up"), F.col("key").alias("_key"))
        keys = up.join(F.broadcast(root), "up").select("node", F.concat("_key", "chain").alias("key")).unionByName(start)
        keys = _in_order(keys, "rank", "key")
        new = written(_above(members, links, keys))
        moved = new.join(tree.select("node", F.col("place").alias("_place")), "node").where("place <> _place")
        if moved.isEmpty():
            return keys.join(tree, "node", "left").select("node", "up", "place", "key")
        release(tree, keys)
        tree = new


def dominated_sizes(nodes: DataFrame, edges: DataFrame, entry: str) -> DataFrame:
    """path, exclusive_size_bytes of every node that the entry reaches, on tables alone."""
    members, links = grouped(edges, entry)
    found = written(dominators(members, links, entry))
    reached = found.join(members.select(F.col("pos").alias("node"), "root"), "node").select("root", "node")
    sized = written(members.join(nodes.select(F.col("path").alias("node"), "size_bytes"), "node").join(reached.withColumnRenamed("node", "group"), "root"))
    line = F.explode(F.concat(F.array("root"), "chain")).alias("path")
    totals = sized.groupBy(F.col("group").alias("node")).agg(F.sum("size_bytes").alias("size_bytes"))
    above = F.explode(F.filter("key", lambda x, i: i % 2 == 0)).alias("node")
    totals = found.join(totals, "node").select(above, "size_bytes").groupBy("node").agg(F.sum("size_bytes").alias("size_bytes"))
    hung = totals.join(found.where("place is not null").select("node", F.col("place").alias("pos")), "node").join(members, "pos")
    out = sized.select(line, "size_bytes").unionByName(hung.select(line, "size_bytes"))
    return out.groupBy("path").agg(F.sum("size_bytes").cast("long").alias("exclusive_size_bytes"))


def exclusive_weights(graph: ImportGraph, entry: str, include_dynamic: bool = False, kernel_edges: int = KERNEL_EDGES) -> DataFrame:
    """path, exclusive_size_bytes of every module the entry reaches: the sizes of all that it dominates.

    Up to kernel_edges edges one task builds the dominator tree of what is reached; larger graphs go through
    dominated_sizes(). Both give the same rows.
    """
    edges = written(graph.edges.where(followed(include_dynamic)).select("src", "dst").where((F.col("src") != F.col("dst")) & (F.col("dst") != entry)))
    if edges.count() > kernel_edges:
        return dominated_sizes(graph.nodes, edges, entry)
    sizes, own = reached_part(graph.nodes, edges, entry)
    rows = sizes.select(F.lit(0).alias("g"), F.col("path").alias("src"), F.lit(None).cast("string").alias("dst"), "size_bytes")
    rows = rows.unionByName(own.select(F.lit(0).alias("g"), "src", "dst", F.lit(None).cast("long").alias("size_bytes")))

    def kernel(frame: pd.DataFrame) -> pd.DataFrame:
        own = frame[frame.dst.isna()].sort_values("src")
        links = frame[frame.dst.notna()]
        names = pd.Index(own.src)
        src, dst = names.get_indexer(links.src), names.get_indexer(links.dst)
        good = (src >= 0) & (dst >= 0)
        idom, order = immediate_dominators(len(names), src[good], dst[good], int(names.get_loc(entry)))
        return pd.DataFrame({"path": names, "exclusive_size_bytes": subtree_sums(idom, order, own.size_bytes.to_numpy(np.int64))})

    return rows.groupBy("g").applyInPandas(kernel, "path string, exclusive_size_bytes long")
