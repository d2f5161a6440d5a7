"""Embedding near-dedup by iterative quantisation and multi-index Hamming tables."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tiles
from .components import components
from .storage import NULL_ID, written

MIN_COSINE = 0.95
#: The code of a length is learned from at most so many of its distinct vectors, those of least hash; so many of the most common lengths have a learned code.
SAMPLE, LENGTHS, ITERATIONS, SEED = 20_000, 16, 40, 11
MOST_BITS = 64
#: Radius of the search: this share of sample vectors moved to exactly MIN_COSINE stays within it.
RADIUS_SHARE = 0.995
#: Components of a chunk of a tile of the rerank.
BUDGET = 1 << 21
#: Entries of a bucket that one task compares; larger buckets are cut into tiles.
MOST_MET = 8192


@dataclass
class Quantiser:
    """Codes of unit vectors of one length: signs of (x - mean) @ axes, cut into tables of bits searched within `near` flips each."""

    mean: np.ndarray
    axes: np.ndarray
    radius: int
    cuts: list[tuple[int, int]]
    near: int

    def codes(self, x: np.ndarray) -> np.ndarray:
        bits = ((x - self.mean) @ self.axes > 0).astype(np.uint64)
        return (bits << np.arange(bits.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def flips(self, table: int) -> np.ndarray:
        """What a probe changes in a table's part of the code: nothing first, then up to `near` bits."""
        lo, hi = self.cuts[table]
        return np.array([sum(1 << b for b in bits) for k in range(self.near + 1) for bits in combinations(range(hi - lo), k)], np.uint64)

    def part(self, codes: np.ndarray, table: int) -> np.ndarray:
        lo, hi = self.cuts[table]
        return codes >> np.uint64(lo) & np.uint64((1 << (hi - lo)) - 1)


def cut_into_tables(bits: int, radius: int, n: int) -> tuple[list[tuple[int, int]], int]:
    """Tables of the code and flips a table, the cheapest that find every pair within the radius.

    Of m tables one differs by at most radius // m bits. A vector costs a row for each probe and a comparison
    for each vector that it meets; more vectors make for fewer and wider tables.
    """
    best = None
    for m in range(1, min(bits, radius + 1) + 1):
        near, width = radius // m, bits / m
        probes = m * sum(math.comb(math.ceil(width), k) for k in range(near + 1))
        if probes > 20_000:
            continue
        cost = probes * (1 + n / 2**width / 64)
        if best is None or cost < best[0]:
            best = cost, m, near
    _, m, near = best
    edges = [round(i * bits / m) for i in range(m + 1)]
    return list(zip(edges[:-1], edges[1:], strict=True)), near


def learn(sample: np.ndarray, n: int, cosine: float = MIN_COSINE) -> Quantiser:
    """Iterative quantisation: principal axes of the sample, then alternately the signs and the rotation nearest to them."""
    rng = np.random.default_rng(SEED)
    dim = sample.shape[1]
    bits = min(MOST_BITS, dim)
    mean = sample.mean(axis=0)
    centred = sample - mean
    _, vectors = np.linalg.eigh(centred.T @ centred / max(len(sample), 1))
    principal = vectors[:, ::-1][:, :bits]
    v = centred @ principal
    rotation, _ = np.linalg.qr(rng.standard_normal((bits, bits)))
    for _ in range(ITERATIONS):
        signs = np.where(v @ rotation > 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(v.T @ signs)
        rotation = left @ right
    return calibrated(Quantiser(mean, principal @ rotation, 0, [], 0), sample, n, cosine, rng)


def unlearned(dim: int, n: int, cosine: float = MIN_COSINE) -> Quantiser:
    """Random axes for a rare length, their radius measured on random vectors."""
    rng = np.random.default_rng(SEED + dim)
    q = Quantiser(np.zeros(dim), rng.standard_normal((dim, min(MOST_BITS, dim))), 0, [], 0)
    return calibrated(q, _unit(rng.standard_normal((2000, dim))), n, cosine, rng)


def calibrated(q: Quantiser, sample: np.ndarray, n: int, cosine: float, rng: np.random.Generator) -> Quantiser:
    """With the radius that RADIUS_SHARE of sample vectors moved to exactly the cosine stay within, and tables for it."""
    bits = q.axes.shape[1]
    aside = rng.standard_normal(sample.shape)
    aside -= (aside * sample).sum(axis=1, keepdims=True) * sample
    norm = np.linalg.norm(aside, axis=1, keepdims=True)
    moved = cosine * sample + math.sqrt(max(0.0, 1 - cosine * cosine)) * aside / np.where(norm > 0, norm, 1)
    distance = np.bitwise_count(q.codes(sample) ^ q.codes(moved))
    q.radius = int(np.quantile(distance, RADIUS_SHARE, method="higher")) if len(sample) else 0
    q.cuts, q.near = cut_into_tables(bits, min(q.radius, bits), n)
    return q


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _met(pairs: list[tuple[np.ndarray, np.ndarray]], codes: np.ndarray, node: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges between members of a tile whose codes lie within the radius: each to the least node that they reach. pairs: places that are compared with places."""
    root = node.copy()
    found = []
    for left, right in pairs:
        for i in range(0, len(left), tiles.BLOCK):
            for j in range(0, len(right), tiles.BLOCK):
                a, b = left[i : i + tiles.BLOCK], right[j : j + tiles.BLOCK]
                x, y = np.nonzero(np.bitwise_count(codes[a][:, None] ^ codes[b][None, :]) <= radius)
                if len(x):
                    found.append((a[x], b[y]))
    changed = bool(found)
    while changed:
        before = root.copy()
        for a, b in found:
            np.minimum.at(root, a, root[b])
            np.minimum.at(root, b, root[a])
        changed = bool((root != before).any())
    some = root != node
    return root[some], node[some]


def linked_vectors(x: np.ndarray, cosine: float) -> tiles.Linked:
    norm = np.sqrt((x * x).sum(axis=1))

    def linked(a: slice, b: slice) -> tuple[np.ndarray, np.ndarray]:
        cosines = x[a] @ x[b].T / (norm[a][:, None] * norm[b][None, :])
        return cosines >= cosine, cosines

    return linked


def vector_dedup(vectors: DataFrame, cosine: float = MIN_COSINE, sample: int = SAMPLE, budget: int = BUDGET, most_met: int = MOST_MET) -> DataFrame:
    """Links between vectors whose cosine, in double precision, is `cosine` or more.

    vectors: vec_id, embedding. Returns per row vec_id, n_links (other rows linked directly), component_id (least vec_id
    that links reach) and kept (vec_id = component_id).

    Equal vectors are one class. For each of the LENGTHS most common lengths a quantiser is learned from a bounded
    sample of its classes; the codes of all go into the Hamming tables, and what a bucket's neighbours bring within
    the radius becomes edges to least nodes. Buckets of more than most_met entries are cut into tiles.
    The components of these hold all candidate pairs, and inside them all pairs are reranked by the original
    vectors, in tiles of bounded size. So links are never wrong, and missed only where the codes miss a chain.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing and are kept. Vectors link only
    with those of their length; rarer lengths than LENGTHS have random axes, with a radius measured alike. Rows
    that repeat a vec_id count as rows. A null vec_id counts as smallest. Other columns are not looked at. An empty table
    gives an empty one.
    """
    spark = vectors.sparkSession
    clean = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    values = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NULL_ID)).alias("d"), values.alias("x"))
    usable = F.coalesce(F.forall("x", clean) & F.exists("x", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("x", F.when(usable, F.transform("x", lambda x: x + F.lit(0.0))))  # no negative zeros
    node = F.xxhash64(F.to_json(F.struct("x")), F.size("x"))
    classes = written(rows.where("x is not null").groupBy("x").agg(F.min("d").alias("class_d"), F.count("*").alias("class_size")).select("*", node.alias("node")))
    sizes = classes.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(LENGTHS).collect()
    if not sizes:
        return rows.select(F.nullif(F.col("d"), F.lit(NULL_ID)).alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.nullif(F.col("d"), F.lit(NULL_ID)).alias("component_id"), F.lit(True).alias("kept"))
    codes_of = {}
    for dim, n in sizes:  # one length's sample at a time
        chosen = classes.where(F.size("x") == dim).orderBy(F.xxhash64("node", F.lit(SEED)), "node").limit(sample).select("x").toArrow().column("x").combine_chunks()
        codes_of[dim] = learn(_unit(_matrix(chosen)), n, cosine)
    learned, rare = spark.sparkContext.broadcast(codes_of), min(n for _, n in sizes)
    OUT = "dim long, bucket_table long, bucket long, node long, code long, probe int"

    def quantiser(size: int) -> Quantiser:
        own = learned.value  # each worker's own copy
        if size not in own:
            own[size] = unlearned(size, rare, cosine)
        return own[size]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("x").value_lengths().to_numpy(zero_copy_only=False)
            for size in np.unique(lengths):
                own = batch.filter(pa.array(lengths == size))
                q, nodes = quantiser(int(size)), own.column("node").to_numpy(zero_copy_only=False)
                codes = q.codes(_unit(_matrix(own.column("x"))))
                for table in range(len(q.cuts)):
                    part = q.part(codes, table)
                    for k, flip in enumerate(q.flips(table)):
                        m = len(nodes)
                        columns = [np.full(m, size, np.int64), np.full(m, table, np.int64), (part ^ flip).view(np.int64), nodes, codes.view(np.int64)]
                        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(np.full(m, min(k, 1), np.int32))], names=["dim", "bucket_table", "bucket", "node", "code", "probe"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us: list[np.ndarray] = []
        vs: list[np.ndarray] = []
        for tile in tiles.groups(batches):
            node, code, probe, side = (tile.column(c).to_numpy(zero_copy_only=False) for c in ("node", "code", "probe", "side"))
            if probe.all() or len(node) < 2:
                continue
            index = probe == 0
            if tile.column("tile_i")[0] == tile.column("tile_j")[0]:
                pairs = [(np.flatnonzero(index), np.arange(len(node)))]
            else:  # two chunks of a large bucket
                pairs = [(np.flatnonzero(index & (side == 0)), np.flatnonzero(side == 1)), (np.flatnonzero(index & (side == 1)), np.flatnonzero(~index & (side == 0)))]
            u, v = _met(pairs, code.view(np.uint64), node, quantiser(tile.column("dim")[0].as_py()).radius)
            us.append(u)
            vs.append(v)
        if us:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])

    keys = ["dim", "bucket_table", "bucket"]
    entries = classes.select("x", "node").mapInArrow(index, OUT)
    hot = written(entries.groupBy(*keys).agg(F.count("*").alias("m")).where(F.col("m") > most_met).select(*keys, F.ceil(F.col("m") * 2 / most_met).cast("int").alias("q")))
    dealt = entries.join(hot, keys, "left").select(F.xxhash64(*keys).alias("cluster"), "dim", "node", "code", "probe", F.coalesce("q", F.lit(1)).alias("q"))
    met = tiles.grouped(tiles.dealt(dealt)).mapInArrow(search, "u long, v long")
    clusters = components(met).withColumnRenamed("root", "cluster")
    members = tiles.chunked(clusters.join(classes.select("node", (F.size("x") + tiles.MEMBER).cast("long").alias("weight")), "node"), budget)
    members = members.join(classes, "node").select("node", "cluster", "q", "class_size", "x")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple[np.ndarray, ...]]:
            for tile in tiles.groups(batches):
                order = np.argsort(tile.column("side").to_numpy(zero_copy_only=False), kind="stable")
                node, side, size = (tile.column(c).to_numpy(zero_copy_only=False)[order] for c in ("node", "side", "class_size"))
                x = _matrix(tile.column("x"))[order]
                x = x / np.abs(x).max(axis=1, keepdims=True)
                split = None if tile.column("tile_i")[0] == tile.column("tile_j")[0] else int(np.searchsorted(side, 1))
                yield node, *tiles.links_of(len(node), size, node, split, linked_vectors(x, cosine))

        yield from tiles.result(each())

    found = written(tiles.grouped(tiles.dealt(members)).mapInArrow(rerank, tiles.RESULT))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = written(components(found.where("node <> root").select(F.col("root").alias("u"), F.col("node").alias("v"))))
    least = written(groups.join(classes.select("node", "class_d"), "node").groupBy("root").agg(F.min("class_d").alias("component_d")))
    named = groups.join(least, "root").select("node", "component_d")
    about = written(classes.drop("x").join(links, "node", "left").join(named, "node", "left"))  # so that the rows of a hot class can be split
    out = rows.select("d", F.when(F.col("x").isNotNull(), node).alias("node")).join(about, "node", "left")
    component = F.coalesce("component_d", "class_d", "d")
    plain = lambda c: F.nullif(c, F.lit(NULL_ID))
    links = F.coalesce("class_size", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))
    return out.select(plain(F.col("d")).alias("vec_id"), links.cast("long").alias("n_links"), plain(component).alias("component_id"), (F.col("d") == component).alias("kept"))
