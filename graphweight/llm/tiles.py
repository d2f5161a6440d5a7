"""Exact comparison of all pairs inside clusters of any size, in tiles of bounded size, without a row for each pair."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written

#: Rows of a block of a comparison.
BLOCK = 1024


#: A cluster is cut into so many chunks before its chunks reach the budget, so that a middling one is not one task.
SPREAD = 8


def chunked(members: DataFrame, budget: int) -> DataFrame:
    """members(node, cluster, weight) with q: the chunks that the member's cluster is cut into.

    A cluster of total weight up to `budget` / SPREAD is one chunk. A larger one has up to SPREAD, and as many as it
    needs where these would be beyond the budget. The clusters' table
    is written, so that both sides of the join are plain exchanges and a large cluster's members spread over tasks;
    what is compared comes in later, by node.
    """
    members = written(members)
    chunks = written(members.groupBy("cluster").agg(F.greatest(F.ceil(F.sum("weight") / budget), F.least(F.lit(SPREAD), F.ceil(F.sum("weight") * SPREAD / budget))).cast("int").alias("q")))
    return members.join(chunks, "cluster")


def dealt(rows: DataFrame) -> DataFrame:
    """rows(node, cluster, q, ...) with a row for each tile that each member takes part in: tile_i, tile_j, side in place of q.

    A hash of the node names the member's chunk, and each pair of chunks is a tile: a chunk's rows go to as many
    tiles as there are chunks.
    """
    own = F.pmod(F.xxhash64("node"), F.col("q")).cast("int")
    rows = rows.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("q") - 1)))
    return rows.select("*", F.least("_own", "_other").alias("tile_i"), F.greatest("_own", "_other").alias("tile_j"), (F.col("_own") > F.col("_other")).cast("int").alias("side")).drop("_own", "_other", "q")


def grouped(rows: DataFrame) -> DataFrame:
    keys = ["cluster", "tile_i", "tile_j"]
    return rows.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of one tile after another, from batches sorted by tile."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = [batch.column(k).to_numpy(zero_copy_only=False) for k in ("cluster", "tile_i", "tile_j")]
        new = np.flatnonzero(np.any([x[1:] != x[:-1] for x in key], axis=0)) + 1
        bounds = [0, *new.tolist(), batch.num_rows]
        if rest and all(rest[0].column(k)[0].as_py() == batch.column(k)[0].as_py() for k in ("cluster", "tile_i", "tile_j")):
            rest.append(batch.slice(0, bounds[1]))
            bounds = bounds[1:]
        if len(bounds) > 1:
            if rest:
                yield pa.Table.from_batches(rest).combine_chunks().to_batches()[0]
            for x, y in zip(bounds[:-2], bounds[1:-1], strict=True):
                yield batch.slice(x, y - x)
            rest = [batch.slice(bounds[-2], bounds[-1] - bounds[-2])]
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks().to_batches()[0]


Linked = Callable[[slice, slice], tuple[np.ndarray, np.ndarray]]
#: Added to a member's weight, so that a chunk of small members has no more of them than its pairs' blocks can hold.
MEMBER = 128


def links_of(n: int, size: np.ndarray, node: np.ndarray, split: int | None, linked: Linked) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of n members of a tile: rows that it links with (size counts those of a member), the least node that links inside the tile reach, and the least similarity of its links (infinite without one).

    linked(x, y) compares two ranges of members: which pairs link, and the pairs' similarities. split: where the second chunk begins, in a tile of two.
    """
    count, root, low = np.zeros(n, np.int64), node.copy(), np.full(n, np.inf)
    found: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    lefts, right = (n if split is None else split), (0 if split is None else split)
    for i in range(0, lefts, BLOCK):
        x = slice(i, min(i + BLOCK, lefts))
        for j in range(max(right, i if split is None else 0), n, BLOCK):
            y = slice(j, min(j + BLOCK, n))
            hit, similarity = linked(x, y)
            if split is None and i == j:
                np.fill_diagonal(hit, False)
            if not hit.any():
                continue
            similarity = np.where(hit, similarity, np.inf)
            low[x] = np.minimum(low[x], similarity.min(axis=1))
            low[y] = np.minimum(low[y], similarity.min(axis=0))
            count[x] += hit @ size[y]
            if split is not None or i != j:
                count[y] += size[x] @ hit
            found.append((i, j, hit, np.zeros(0)))
    changed = bool(found)
    while changed:
        before = root.copy()
        for i, j, hit, _ in found:
            a, b = slice(i, i + hit.shape[0]), slice(j, j + hit.shape[1])
            top = np.iinfo(np.int64).max
            root[a] = np.minimum(root[a], np.where(hit, root[b][None, :], top).min(axis=1))
            root[b] = np.minimum(root[b], np.where(hit, root[a][:, None], top).min(axis=0))
        changed = bool((root != before).any())
    return count, root, low


def result(batches: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """(node, links, root, low) of tiles as larger batches; members without a link are left out."""
    held: list[tuple[np.ndarray, ...]] = []
    rows = 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], names=["node", "links", "root", "low"])

    for node, count, root, low in batches:
        some = count > 0
        if some.any():
            held.append((node[some], count[some], root[some], low[some]))
            rows += int(some.sum())
        if rows > 50_000:
            yield out()
            held, rows = [], 0
    if held:
        yield out()


RESULT = "node long, links long, root long, low double"
